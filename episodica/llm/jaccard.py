"""N-gram Jaccard join: a blocked product of the sparse document by n-gram incidence matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructType

from episodica.llm.common import Scratch, connected_components, fingerprints, mapped, mixed, prefix_sums, runs_of_rows, text_or_empty, utf8_column

#: Documents in a block of the product, on average.
BLOCK = 512
#: Bytes of text that one vectorised step works on; a longer document is cut between words.
STEP = 1 << 20
#: Longer words are hashed one by one, as sums over powers are meant for short slices.
LONG_WORD = 64
#: Signatures that a task remembers in each of two generations.
REMEMBERED = 1 << 16
#: Ways to deal columns into blocks that are tried on large groups of candidates.
DEALS = 5
#: Frequent n-grams are found by slots of their fingerprints' first bits; a task names slots of LEAST and more texts, SLOTS at most.
SLOT_BITS, LEAST, SLOTS = 22, 8, 1 << 16
#: Column blocks that may be empty without being looked at, beside a sixth of those that may differ; see block_signatures.
SPARE = 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of texts that lie end to end in data, edges apart."""
    own = _LOWER[data]
    blank = np.ones(len(own) + 1, bool)
    blank[:-1] = _BLANK[own]
    before = np.ones(len(own) + 1, bool)
    before[1:] = blank[:-1]
    before[edges] = True  # a text begins a word, and ends one
    starts = np.flatnonzero(~blank & before)
    stop = np.zeros(len(own) + 1, bool)
    stop[edges] = True
    stop |= blank
    ends = np.flatnonzero(stop)
    ends = ends[np.searchsorted(ends, starts, "right")] if len(starts) else starts
    h = fingerprints(prefix_sums(own), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(own[starts[i] : ends[i]].tobytes())
    return starts, h


def pieces_between_words(data: np.ndarray) -> Iterator[np.ndarray]:
    """Cuts of a long text at blanks, about STEP bytes each; a longer word stays whole."""
    at = 0
    while at < len(data):
        stop = at + STEP
        while stop < len(data) and not (found := np.flatnonzero(_BLANK[data[stop : stop + 4096]])).size:
            stop += 4096
        stop = stop + int(found[0]) if stop < len(data) else len(data)
        yield data[at:stop]
        at = stop


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted 64-bit fingerprints of the distinct word n-grams of each text; of fewer words the whole sequence is one."""
    out: list[np.ndarray] = []
    for first, last in runs_of_rows(offsets, STEP):
        own = data[offsets[first] : offsets[last]]
        if len(own) > STEP:
            h = np.concatenate([word_hashes(p, np.array([0, len(p)]))[1] for p in pieces_between_words(own)])
            firsts = np.array([0, len(h)])
        else:
            edges = offsets[first : last + 1] - offsets[first]
            starts, h = word_hashes(own, edges)
            firsts = np.searchsorted(starts, edges)
        n = max(0, len(h) - words + 1)
        total = np.zeros(n, np.uint64)
        for k in range(words):
            total += h[k : k + n] * (_ODD + np.uint64(2 * k * k))
        grams = mixed(total)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(grams[a : b - words + 1]))
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for k in range(a, b):
                    whole = whole * _ODD + h[k : k + 1]
                out.append(mixed(whole))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def size_bands(percent: int, largest: int) -> np.ndarray:
    """Edges of size bands such that two linked sets lie in one band or in neighbours: size ratios are at least percent / 100.

    Two edges beyond the first above `largest` are given. A larger `largest` only adds edges, so rows get the same bands in every batch.
    """
    edges, beyond = [1], 0
    while beyond < 3:
        edges.append(max(-(-edges[-1] * 100 // percent), edges[-1] + 1))
        beyond += edges[-1] > largest
    return np.array(edges, np.int64)


def block_signatures(sets: list[np.ndarray], percent: int, deal: int = 0, within: np.ndarray | None = None, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the column blocks in which a row of the incidence matrix may agree entirely with a linked one.

    Linked rows of sizes x and y differ in at most d = (x + y)(100 - p) / (100 + p) columns. For each pair of neighbouring bands the
    columns are dealt into d + 1 + spare blocks, d taken for the largest sizes there, so linked rows agree in 1 + spare blocks at
    least, and only rows with a common signature need be multiplied. Empty blocks are alike in all rows and give none: if one of two linked rows
    has at most `spare` empty blocks, they have a common block that isn't empty. Rows with more empty blocks give the signatures of
    another deal too, and so on; in the last one the few that remain keep their empty blocks. So two linked rows meet in the first deal in which either has few.
    Rows that differ in `within` never share a signature, and every `deal` is another way to deal columns out.

    The same holds for any part of the columns, so frequent ones (marked by slot) are left out of the first deal, lest passages that many
    texts share make blocks alike.
    """
    if frequent is None:
        row, signature, poor = _dealt(sets, percent, deal, within, sets)
    else:
        row, signature, poor = _dealt(sets, percent, deal, within, [s[~frequent[slot_of(s)]] for s in sets])
    if len(poor):
        more = _further([sets[i] for i in poor], percent, deal + 1000, None if within is None else within[poor], 1)
        row, signature = np.concatenate([row, poor[more[0]]]), np.concatenate([signature, more[1]])
    return row, signature


def _further(sets: list[np.ndarray], percent: int, deal: int, within: np.ndarray | None, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of rows that an earlier deal left too many empty blocks: of another deal, and so on; the last keeps empty blocks."""
    row, signature, poor = _dealt(sets, percent, deal, within, sets, keep_empty=turn == 4)
    if len(poor) and turn < 4:
        more = _further([sets[i] for i in poor], percent, deal + 1000, None if within is None else within[poor], turn + 1)
        row, signature = np.concatenate([row, poor[more[0]]]), np.concatenate([signature, more[1]])
    return row, signature


def slot_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _dealt(sets: list[np.ndarray], percent: int, deal: int, within: np.ndarray | None, parts: list[np.ndarray], keep_empty: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature) of one way to deal out parts of the columns, and the rows with more empty blocks than are to spare; sizes are those of the whole sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = size_bands(percent, int(sizes.max()))
    band = np.searchsorted(edges, sizes, "right") - 1
    values = np.concatenate(parts)
    spread = mixed(values ^ np.uint64(0x5851F42D4C957F2D))
    dealt = mixed(values + np.uint64(deal * int(_ODD) % (1 << 64)))
    row_of = np.repeat(np.arange(len(sets)), np.fromiter(map(len, parts), np.int64, len(parts)))
    poor = np.zeros(len(sets), bool)
    rows, signatures = [], []
    for shift in (0, 1):
        own = band + shift
        differ = 2 * (edges[own + 1] - 1) * (100 - percent) // (100 + percent)
        spare = SPARE + differ // 6
        blocks = np.where((differ > 0) & (sizes > 0), differ + 1 + spare, 0)
        bases = np.cumsum(blocks) - blocks
        n = int(blocks.sum())
        if not n:
            continue
        use = blocks[row_of] > 0
        at = bases[row_of[use]] + (dealt[use] % blocks[row_of[use]].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, at, spread[use])
        held = np.bincount(at, minlength=n)
        row = np.repeat(np.arange(len(sets)), blocks)
        place = np.arange(n) - bases[row]
        empty = np.bincount(row[held == 0], minlength=len(sets))
        poor |= empty > spare
        keep = (held > 0) | (keep_empty & (empty > spare)[row])
        salt = (own[row].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64)
        if within is not None:
            salt += mixed(within)[row]
        rows.append(row[keep])
        signatures.append(mixed(sums[keep] + mixed(salt[keep] * np.uint64(2) + np.uint64(1))))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.flatnonzero(poor)
    return np.concatenate(rows), np.concatenate(signatures).view(np.int64), np.flatnonzero(poor)


class Holders:
    """The first rows of a task that held each signature: the combiner before the shuffle.

    Bounded by two generations of REMEMBERED signatures. One that keeps coming back is never forgotten, so it leaves a task once, however many rows have it.
    """

    def __init__(self):
        self.young: dict[int, int] = {}
        self.old: dict[int, int] = {}

    def tie(self, nodes: np.ndarray, row: np.ndarray, signature: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
        """For each row the signatures that it is the first to hold, and the first holders of its others."""
        order = np.argsort(row, kind="stable")
        bounds = np.searchsorted(row[order], np.arange(len(nodes) + 1))
        listed = signature[order].tolist()
        fresh, near = [], []
        for i, node in enumerate(nodes.tolist()):
            new, others = [], set()
            for s in listed[bounds[i] : bounds[i + 1]]:
                other = self.young.get(s)
                if other is None:
                    other = self.old.get(s)
                    if other is None:
                        new.append(s)
                        other = node
                    self.young[s] = other
                others.add(other)
            others.discard(node)
            fresh.append(new)
            near.append(list(others))
            if len(self.young) > REMEMBERED:
                self.old, self.young = self.young, {}
        return fresh, near


def candidate_edges(signed: DataFrame) -> DataFrame:
    """(a, b) such that nodes with a common signature are connected; a common signature has about a row per task, see Holders."""
    holders = signed.select(F.explode("signatures").alias("signature"), "node")
    before = F.lag("node").over(Window.partitionBy("signature").orderBy("node"))
    across = holders.select("node", before.alias("before")).where("before IS NOT NULL AND before <> node").select(F.col("node").alias("a"), F.col("before").alias("b"))
    inside = signed.select(F.col("node").alias("a"), F.explode("near").alias("b"))
    return across.unionByName(inside).distinct()


def linked_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of a block of rows with 100 |x and y| >= percent |x or y|, by accumulating overlap counts.

    Columns held by few rows are summed pair by pair, the others by dense products over slices of columns. After each slice, rows go
    whose every pair is out by size: what a pair has counted so far and may still count stays below what its sizes ask for.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    n = len(sets)
    need = -(-percent * (sizes[:, None] + sizes[None, :]) // (100 + percent))  # the least overlap that links
    open_ = (np.minimum(sizes[:, None], sizes[None, :]) >= need) & (sizes[:, None] > 0) & np.triu(np.ones((n, n), bool), 1)
    counts = np.zeros((n, n), np.int64)
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    held = np.diff(np.append(first, len(values)))
    for c in range(2, 9):
        at = first[held == c]
        for i in range(0, len(at), 1 << 16):
            members = rows[at[i : i + (1 << 16), None] + np.arange(c)]
            codes = [members[:, a] * n + members[:, b] for a in range(c) for b in range(a + 1, c)]
            counts += np.bincount(np.concatenate(codes), minlength=n * n).reshape(n, n)
    many = np.flatnonzero(held > 8)
    left = np.bincount(np.concatenate([rows[first[k] : first[k] + held[k]] for k in many]), minlength=n) if len(many) else np.zeros(n, np.int64)
    for i in range(0, len(many), 2048):
        open_ &= counts + np.minimum(left[:, None], left[None, :]) >= need
        live = np.flatnonzero(open_.any(axis=0) | open_.any(axis=1))
        if not len(live):
            break
        place = np.full(n, -1)
        place[live] = np.arange(len(live))
        part = many[i : i + 2048]
        column = np.repeat(np.arange(len(part)), held[part])
        row = rows[np.concatenate([np.arange(first[k], first[k] + held[k]) for k in part])]
        left -= np.bincount(row, minlength=n)
        use = place[row] >= 0
        dense = np.zeros((len(live), len(part)), np.float32)
        dense[place[row[use]], column[use]] = 1
        counts[np.ix_(live, live)] += (dense @ dense.T).astype(np.int64)
    return np.nonzero(open_ & (counts >= need))


def forest(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, smallest node of its tree) of a spanning forest of the pairs."""
    parent = list(range(len(ids)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        i, j = find(i), find(j)
        if i != j:
            i, j = (i, j) if ids[i] < ids[j] else (j, i)
            parent[j] = i
    return [(int(ids[i]), int(ids[r])) for i in range(len(ids)) if (r := find(i)) != i]


def frequent_slots(docs: DataFrame, words: int, text: str) -> np.ndarray:
    """Marks of the slots with the most texts, 4 * SLOTS at most: what every task names of its own rows, summed. 4 MB at any size of the corpus.

    Which slots are marked changes no result, only how well signatures tell texts apart.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << SLOT_BITS, np.int32)
        for batch in batches:
            sets = shingle_sets(*utf8_column(batch.column(0)), words)
            if sets:
                np.add.at(held, slot_of(np.concatenate(sets)), 1)
        top = np.flatnonzero(held >= LEAST)
        top = top[np.argsort(-held[top], kind="stable")[:SLOTS]]
        yield pa.RecordBatch.from_arrays([pa.array(top), pa.array(held[top].astype(np.int64))], names=["slot", "n"])

    named = mapped(docs.select(text_or_empty(text)), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    marks = np.zeros(1 << SLOT_BITS, bool)
    marks[[r["slot"] for r in named.orderBy(F.desc("n"), "slot").limit(4 * SLOTS).select("slot").collect()]] = True
    return marks


def _signer(percent: int, deal: int, marks):
    """Signatures of further deals for rows (group, node, grams, ...), apart for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders = Holders()
        for batch in batches:
            nodes, groups = (batch.column(c).to_numpy() for c in ("node", "group"))
            sets = [np.frombuffer(g, np.uint64) for g in batch.column("grams").to_pylist()]
            if sets:
                fresh, near = holders.tie(nodes, *block_signatures(sets, percent, deal, groups.view(np.uint64), marks.value))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(fresh, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64()))], names=["node", "signatures", "near"])

    return run


def _product(percent: int):
    """Edges of spanning forests of the linked rows of each block, from rows (x, y, node, grams) sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, {}

        def links() -> pa.RecordBatch:
            ids = np.array(sorted(own), np.int64)
            edges = forest(ids, *linked_pairs([np.frombuffer(own[i], np.uint64) for i in ids.tolist()], percent))
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *key, node, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != block:
                    if len(own) > 1:
                        yield links()
                    block, own = key, {}
                own[node] = grams
        if len(own) > 1:
            yield links()

    return run


def multiplied(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the linked rows within each block (group, x, y) of rows (node, grams); a task holds one block at a time."""
    sorted_ = blocks.select("group", "x", "y", "node", "grams").repartition("group", "x", "y").sortWithinPartitions("group", "x", "y")
    return mapped(sorted_, _product(percent), "a long, b long")


def read_from_files(docs: DataFrame) -> bool:
    """Whether every row of docs is a row of a Parquet file, as it was or chosen by a test that always says the same, so that file and row number are its key."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.relation().toString() == "parquet"


def places_in_files(docs: DataFrame, columns: list, scratch: Scratch) -> DataFrame:
    """The columns of docs with the key of each row (file, row): of Parquet files their own, otherwise that of a copy, which is written first."""
    rows = docs.select(*columns)
    if not read_from_files(docs):
        rows = scratch.write(rows, "texts")
        columns = [F.col(c) for c in rows.columns]
        docs = rows
    return docs.select(*columns, F.unhex(F.md5("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row"))


def size_band(percent: int):
    """Bands of the sizes of sets such that linked ones lie in one or in neighbours; a little wider than the ratio of linked sizes, for the sake of rounding."""
    return F.floor(F.log(F.length("grams") / 8) / F.log(F.lit(1.0001 * 100 / percent)))


def open_tiles(members: DataFrame, open_: DataFrame, percent: int, block: int) -> DataFrame:
    """(group, x, y, node, grams): tiles in which every open row meets all rows of its group whose size allows a link.

    A row lies in the band of its size; an open row also goes to the neighbouring ones. Bands of a group are cut by hash into as many
    parts as hold about `block` rows, for open rows and for all.
    """
    every = members.join(open_.select("group").distinct(), "group").withColumn("band", size_band(percent))
    bands = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    a = every.join(open_.select("node"), "node", "left_semi").select("group", "node", "grams", bands.alias("band"))
    down = a.groupBy("group", "band").agg(F.ceil(F.count("*") / block).alias("down"))
    across = every.groupBy("group", "band").agg(F.ceil(F.count("*") / block).alias("across"))
    cuts = down.join(across, ["group", "band"])
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = F.concat_ws(":", "band", F.pmod(F.xxhash64("node"), "down"))
    a = a.join(cuts, ["group", "band"]).withColumn("y", upto("across")).select("group", place.alias("x"), "y", "node", "grams")
    b = every.join(cuts, ["group", "band"]).withColumn("part", upto("down")).select("group", F.concat_ws(":", "band", "part").alias("x"), F.pmod(F.xxhash64("node"), "across").alias("y"), "node", "grams")
    return a.unionByName(b)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id) for every row: which documents links of Jaccard similarity >= percent / 100 connect.

    Sets are the distinct word n-grams of the text with A-Z in lower case; words lie between runs of [\\x20\\x09-\\x0D]. Null and empty
    texts have no n-grams and link with nothing; with fewer words than n the whole sequence is one n-gram. Rows have keys of their own: a null id
    takes its component's smallest id, and null where nothing else has one; rows that repeat an id each have a verdict. Equal sets (by 128-bit keys) are one node,
    so copies are never paired; within the product, n-grams are compared by 64-bit fingerprints. Texts of any length are read in steps of a MiB; other
    columns are dropped; an empty table gives no rows.

    Candidates come from block_signatures, of which a task hands on the first holder only (later ones are tied to it at once), so a common
    signature has about as many rows as there are tasks. Groups that candidates make larger than `block`, as texts with a common passage may,
    are taken apart by other deals of the columns as long as that helps. The rows that candidates connect are multiplied in blocks of about `block`; a larger
    group is first cut into blocks that share one pivot row, and then only rows outside its largest component meet the rows of the group that have about their size.

    Rows of Parquet files are told apart by file and place there, and read once for frequent n-grams, once for signatures and once for the sets of candidates;
    rows from elsewhere are written first.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, met, earlier = Holders(), set(), set()
        for batch in batches:
            sets = shingle_sets(*utf8_column(batch.column(0)), words)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            first = []  # of equal sets of this task only the first is signed
            for i, (key, own) in enumerate(zip(keys, sets, strict=True)):
                if len(own) and key not in met and key not in earlier:
                    first.append(i)
                if len(own):
                    met.add(key)
            if len(met) > REMEMBERED:
                met, earlier = set(), met
            rows = batch.column(2).to_numpy()
            signatures, near = [[]] * len(sets), [[]] * len(sets)
            chosen = [sets[i] for i in first]
            if chosen:
                for i, fresh, others in zip(first, *holders.tie(rows[first], *block_signatures(chosen, percent, frequent=marks.value)), strict=True):
                    signatures[i], near[i] = fresh, others
            empty = np.fromiter(map(len, sets), np.int64, len(sets)) == 0
            leads = np.zeros(len(sets), bool)
            leads[first] = True
            hi, lo = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(list(map(len, sets)), pa.int64()), pa.array(hi, mask=empty), pa.array(lo, mask=empty), pa.array(leads), pa.array(signatures, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64()))],
                names=kinds.names,
            )

    own = [F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{id_col}`").alias("id")]
    whole = places_in_files(docs, own, scratch)
    marks = spark.sparkContext.broadcast(frequent_slots(whole, words, "text"))
    keyed = whole.select("text", "id", F.monotonically_increasing_id().alias("node"), "file", "row")  # the number stays once it is written
    kinds = StructType(keyed.schema.fields[1:])
    for name in ("n_shingles", "hi", "lo"):
        kinds = kinds.add(name, LongType())
    kinds = kinds.add("leads", BooleanType()).add("signatures", ArrayType(LongType())).add("near", ArrayType(LongType()))
    signed = scratch.write(mapped(keyed, sign, kinds), "signed")
    sets = scratch.write(signed.select("id", "node", "file", "row", "n_shingles", "hi", "lo", "leads"), "sets")
    candidates = scratch.write(candidate_edges(signed.select("node", "signatures", "near")), "candidates")
    groups = connected_components(spark, candidates, scratch, "groups")
    # of equal sets the least of the rows that were signed stands for all
    scratch.drop("signed", "candidates")
    nodes = scratch.write(sets.where("leads").groupBy("hi", "lo").agg(F.min("node").alias("node")), "nodes")
    groups = scratch.write(groups.join(nodes.select("node"), "node").select("node", F.col("component").alias("group")), "grouped")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(*utf8_column(batch.column(2)), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "group", "grams"])

    # the candidates grow with the corpus, so they are never broadcast: one plan at every size
    places = groups.join(sets.where("leads").select("node", "file", "row"), "node")
    texts = places.hint("merge").join(whole.select("file", "row", "text"), ["file", "row"])
    members = scratch.write(mapped(texts.select("node", "group", "text"), sets_of, "node long, group long, grams binary"), "members")
    sizes = scratch.write(groups.groupBy("group").agg(F.count("*").alias("members")), "sizes")
    held = None
    for deal in range(1, DEALS):
        large = sizes.where(F.col("members") > block).agg(F.sum("members")).first()[0] or 0
        if large == 0 or (held is not None and large > 0.8 * held):
            break
        held = large
        again = mapped(members.join(sizes.where(F.col("members") > block).select("group"), "group"), _signer(percent, deal, marks), "node long, signatures array<long>, near array<long>")
        edges = scratch.write(candidate_edges(scratch.write(again, f"signed-{deal}")), f"candidates-{deal}")
        finer = connected_components(spark, edges, scratch, f"groups-{deal}").withColumnRenamed("component", "finer")
        stay = members.join(sizes, "group").join(finer, "node", "left").where(f"members <= {block} OR finer IS NOT NULL")
        members = scratch.write(stay.select("node", F.coalesce("finer", "group").alias("group"), "grams"), f"members-{deal}")
        sizes = scratch.write(members.groupBy("group").agg(F.count("*").alias("members")), f"sizes-{deal}")
        groups = scratch.write(members.select("node", "group"), f"grouped-{deal}")
        scratch.drop(f"signed-{deal}", "members" if deal == 1 else f"members-{deal - 1}")
    dealt = members.join(sizes, "group").withColumn("blocks", F.ceil(F.col("members") / block))
    dealt = dealt.withColumn("part", F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), "blocks")))
    pivot = F.col("node") == F.col("group")  # the smallest node of a group goes to all its blocks
    dealt = dealt.withColumn("x", F.explode(F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("part")))).withColumn("y", F.lit(0))
    links = scratch.write(multiplied(dealt, percent), "links")
    large = scratch.write(sizes.where(F.col("members") > block), "large")
    if large.limit(1).count():
        found = connected_components(spark, links, scratch, "within")
        inside = groups.join(large, "group").join(found, "node", "left").select("node", "group", "members", F.coalesce("component", "node").alias("part_of"))
        inside = scratch.write(inside, "inside")
        main = inside.groupBy("group", "part_of").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("part_of", F.struct("n", "part_of")).alias("main"))
        main = scratch.write(main, "main")
        open_ = scratch.write(inside.join(main, "group").where("part_of <> main").select("node", "group"), "open")
        tiles = open_tiles(members, open_, percent, block)
        links = links.unionByName(scratch.write(multiplied(tiles, percent), "more"))
    found = connected_components(spark, links, scratch, "found")
    labelled = scratch.write(nodes.join(found, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component")), "labelled")
    rows = scratch.write(sets.join(labelled, ["hi", "lo"], "left").select("id", "n_shingles", "component"), "rows")
    least = scratch.write(rows.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("component_id")), "least")
    scratch.drop("texts", "sets", "nodes", "labelled", "members", "links", "more", *(f"members-{d}" for d in range(1, DEALS)))
    return rows.join(least, "component", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
