"""Removal of repeated substrings by merging Burrows-Wheeler transforms of shards.

A string of LENGTH bytes (a window) is repeated when two suffixes of the corpus share it as a prefix. Only windows that may be repeated
need a place in a transform, so the search narrows down first, always by keys of 128 bits whose counts combine before the shuffle:

1. The anchor of a window is its K-gram of least hash, so equal windows have equal anchors; windows of one anchor that follow each other are a
   run. Runs whose anchor occurs once hold nothing repeated; runs that occur twice as a whole are repeated as a whole.
2. Of runs that share an anchor but differ, one of each kind is cut into steps of 16 windows, later of 4. The bytes that all windows of a step
   share are its core: a step whose core no other kind of step has is done, one that occurs twice is repeated, the others go on.
3. The windows that remain are dealt by hash into parts, and each part by row into shards. Every shard's Burrows-Wheeler transform is built once
   and kept as a table; a part's transforms are merged by Holt and McMillan's interleave refinement, whose blocks after LENGTH
   rounds are the repeated intervals.

No step gathers the rows of a key: a key has one row per task at most where rows of equal content meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import Scratch, fingerprints, mapped, prefix_sums, runs_of_rows, text_or_empty, utf8_column

LENGTH = 200
K = 32
#: Windows in a step of each narrowing; a multiple of the next one.
STEPS = (16, 4)
#: Windows in a part of the merge on average, and shards that a part is made of.
PART, SHARDS = 1 << 16, 4
#: Texts that a task remembers in each of two generations, to list the runs of equal ones once.
REMEMBERED = 1 << 16
#: Bytes that one vectorised step works on; a longer text is cut. Positions within a step take 24 bits beside 40 of the hash.
CHUNK = 1 << 20


def window_anchors(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, place, hash) of the anchors in texts that lie end to end in data, edges apart.

    Every window of LENGTH bytes within a text has one anchor: of its K-grams the leftmost with the least hash. Windows of one
    anchor are consecutive.
    """
    n = len(data) - K + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH - K + 1:
        return none, none, none, np.zeros(0, np.uint64)
    starts = np.arange(n)
    hashes = fingerprints(prefix_sums(data), starts, starts + K)
    packed = (hashes & np.uint64(0xFFFFFFFFFF000000)) | starts.astype(np.uint64)
    w = LENGTH - K + 1
    rows = -(-n // w) + 1
    square = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    square[:n] = packed
    square = square.reshape(rows, w)
    forward = np.minimum.accumulate(square, axis=1).ravel()
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(data) - LENGTH + 1
    least = np.minimum(backward[:m], forward[w - 1 : w - 1 + m])
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(edges, np.arange(m), "right") - 1
    valid = np.arange(m) + LENGTH <= edges[text + 1]
    change = np.ones(m, bool)
    change[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], m) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    return first, last, place[first], hashes[place[first]]


def anchors_of_rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first window, last window, place, hash) for each text, places counted from the text's start."""
    for begin, end in runs_of_rows(offsets, CHUNK):
        if offsets[end] - offsets[begin] > CHUNK:  # a single long text, in pieces that overlap by a window
            parts = []
            for at in range(int(offsets[begin]), int(offsets[end]), CHUNK):
                stop = min(at + CHUNK + LENGTH - 1, int(offsets[end]))
                own = window_anchors(data[at:stop], np.array([0, stop - at]))
                shift = at - int(offsets[begin])
                parts.append((own[0] + shift, own[1] + shift, own[2] + shift, own[3]))
            yield (begin, *(np.concatenate(c) for c in zip(*parts, strict=True)))
            continue
        edges = offsets[begin : end + 1] - offsets[begin]
        first, last, place, h = window_anchors(data[offsets[begin] : offsets[end]], edges)
        bounds = np.searchsorted(first, edges)
        for i in range(begin, end):
            part, shift = slice(bounds[i - begin], bounds[i - begin + 1]), edges[i - begin]
            yield i, first[part] - shift, last[part] - shift, place[part] - shift, h[part]


def shard_transform(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of a shard's windows (rows of bytes), and its transform, a row per depth.

    The windows are read backwards, as strings whose suffixes are the windows' prefixes: row h has the byte that stands next to
    each prefix of h bytes, in the order of those prefixes. That order is colexicographic, and rows follow from each other by a stable deal.
    """
    order = np.arange(len(windows))
    transform = np.empty((windows.shape[1], len(windows)), np.uint8)
    for h in range(windows.shape[1]):
        transform[h] = windows[order, h]
        order = order[np.argsort(transform[h], kind="stable")]
    return order, transform


def merge_transforms(transforms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interleave, interval, common) of the merged transforms, a place for each entry of the shards.

    Holt and McMillan's refinement: the interleave starts with all of shard 0, then of shard 1, and so on; each round deals its
    entries out by the next symbol, which shards give up in their own order, and so sorts by one more
    symbol without looking at a string again. Entries of one block share a prefix of as many symbols as there were rounds, and
    blocks only ever split: `common` is the longest prefix that an entry shares with another one, the last round in which it was not alone.
    After the last round the blocks of several entries are the repeated intervals.
    """
    sizes = [t.shape[1] for t in transforms]
    rows = np.concatenate(transforms, axis=1)
    interleave = np.repeat(np.arange(len(transforms), dtype=np.uint8 if len(transforms) <= 256 else np.int64), sizes)
    block, common = np.zeros(len(interleave), np.int32), np.zeros(len(interleave), np.int16)
    symbol, border = np.empty(len(interleave), np.uint8), np.ones(len(interleave), bool)
    for h in range(len(rows)):
        symbol[np.argsort(interleave, kind="stable")] = rows[h]
        deal = np.argsort(symbol, kind="stable")
        interleave, sorted_, before, common = interleave[deal], symbol[deal], block[deal], common[deal]
        border[1:] = (sorted_[1:] != sorted_[:-1]) | (before[1:] != before[:-1])
        block = np.cumsum(border, dtype=np.int32) - 1
        alone = border & np.append(border[1:], True)
        common[~alone] = h + 1
    return interleave, block, common


def _digests(pieces: Iterator[tuple[memoryview, int]]) -> np.ndarray:
    """128-bit keys of (bytes, salt) as rows of two long."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(p, salt) for p, salt in pieces]), "<i8").reshape(-1, 2)


def packed(low, middle, small):
    """Three numbers of one piece in a long: an offset, one under 4096 and one under 256. They travel through every shuffle."""
    return (low << 20) | (middle << 8) | small


def unpacked(span: str = "span"):
    """The three numbers as columns."""
    return F.shiftright(span, 20).cast("int"), F.shiftright(span, 8).bitwiseAND(0xFFF).cast("int"), F.col(span).bitwiseAND(0xFF).cast("int")


def _anchored():
    """Rows (row, n_bytes, node, runs): size, a key and all runs of each text (row, text), but no runs of texts that the task has met before."""
    run_type = pa.struct([(c, pa.int64()) for c in ("anchor", "span", "hi", "lo")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, earlier = set(), set()
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            view = memoryview(data)
            nodes = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            parts = []
            for i, first, last, place, h in anchors_of_rows(data, offsets):
                again = nodes[i] in met or nodes[i] in earlier
                met.add(nodes[i])
                parts.append((np.full(len(h), offsets[i]), first, last + LENGTH, place, h) if not again else (np.zeros(0, np.int64),) * 5)
            if len(met) > REMEMBERED:
                met, earlier = set(), met
            shift, low, end, place, h = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 5
            keys = _digests((view[a:b], 0) for a, b in zip((shift + low).tolist(), (shift + end).tolist(), strict=True))
            columns = [pa.array(h.view(np.int64)), pa.array(packed(low, end - low, place - low)), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
            bounds = np.concatenate([[0], np.cumsum([len(p[1]) for p in parts])]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(columns, fields=list(run_type)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(offsets)), pa.array(nodes, pa.binary()), runs], names=["row", "n_bytes", "node", "runs"])

    return run


UNITS = "row long, low int, at int, heavy boolean, data binary"


def _units(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "low", "at", "heavy", "data"])


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of (row, text, runs): the bytes of each listed run."""
    for batch in batches:
        data, offsets = utf8_column(batch.column("text"))
        for row, base, runs in zip(batch.column("row").to_pylist(), offsets.tolist(), batch.column("runs").to_pylist()):
            yield _units([(row, r["low"], r["at"], r["heavy"], data[base + r["low"] : base + r["low"] + r["size"]].tobytes()) for r in runs])


def _cut_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of (row, low, at, data, steps): the bytes of each listed step."""
    for batch in batches:
        rows = []
        for row, low, at, data, steps in zip(*(batch.column(c).to_pylist() for c in ("row", "low", "at", "data", "steps")), strict=True):
            rows += [(row, low + s["begin"], at - s["begin"], s["heavy"], data[s["begin"] : s["begin"] + s["n"] - 1 + LENGTH]) for s in steps]
        yield _units(rows)


def step_bounds(n: int, at: int, step: int) -> list[tuple[int, int, int]]:
    """(number, first window, windows) of the steps of a unit of n windows: borders are multiples of step before the anchor, alike in all texts."""
    out = []
    for g in range((at - n + 1) // step, at // step + 1):
        a, b = max(0, at - g * step - step + 1), min(n - 1, at - g * step)
        if a <= b:
            out.append((g, a, b - a + 1))
    return out


def _stepped(step: int):
    """Rows (row, span, heavy, core, hi, lo) of the steps of units: keys of the bytes that a step's windows share, and of all its bytes.

    A span holds the unit's place, and the step's first window and number of windows. Steps that share a 64-bit core by chance are only looked into in vain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, spans, cores, wholes = [], [], [], []
            for i, (low, at, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("low", "at", "data")), strict=True)):
                view = memoryview(data)
                for g, a, n in step_bounds(len(data) - LENGTH + 1, at, step):
                    core = at - g * step
                    entry.append(i)
                    spans.append(packed(low, a, n))
                    cores.append(xxhash.xxh3_64_intdigest(view[core : core - step + 1 + LENGTH], (core - at) % (1 << 64)))
                    wholes.append((view[a : a + n - 1 + LENGTH], at - a))
            whole = _digests(wholes)
            taken = [batch.column(c).take(pa.array(entry, pa.int64())) for c in ("row", "heavy")]
            columns = [*taken, pa.array(spans, pa.int64()), pa.array(np.array(cores, np.uint64).view(np.int64)), *(pa.array(np.ascontiguousarray(whole[:, i])) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "heavy", "span", "core", "hi", "lo"])

    return run


def narrow(scratch: Scratch, pieces: DataFrame, shared: str, times, name: str) -> tuple[DataFrame, DataFrame]:
    """(row, span) of pieces that are repeated as a whole, and (row, span, heavy) of pieces to look into.

    Pieces have a key of their content (hi, lo) and one of what they share. Equal content is one kind, which is repeated if `times`, an aggregate, is over 1;
    pieces of such kinds are returned unless they were heavy, that is known to be repeated. One piece of each kind that meets another kind
    is looked into, heavy if its kind is repeated. All counts combine before the shuffle, and joins have plain exchanges, so rows of a key never gather.
    """
    kinds = pieces.groupBy("hi", "lo").agg(times.alias("times"), *(F.first(c).alias(c) for c in (shared, "row", "span")))
    kinds = scratch.write(kinds.select("hi", "lo", shared, "row", "span", (F.col("times") > 1).alias("heavy")), f"{name}-kinds")
    repeated = scratch.write(pieces.where("NOT heavy").select("hi", "lo", "row", "span").join(kinds.where("heavy").select("hi", "lo"), ["hi", "lo"]).select("row", "span"), f"{name}-repeated")
    several = scratch.write(kinds.groupBy(shared).agg(F.count("*").alias("kinds")).where("kinds > 1").select(shared), f"{name}-several")
    return repeated, scratch.write(kinds.select(shared, "row", "span", "heavy").join(several, shared).select("row", "span", "heavy"), f"{name}-open")


def _windows(parts: int):
    """Rows (part, shard, window, heavy): the windows of units, equal ones of a task and shard once, and heavy if that happened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], bool] = {}

        def flush() -> pa.RecordBatch:
            part = [xxhash.xxh3_64_intdigest(w) % parts for _, w in seen]
            columns = [pa.array(part, pa.int32()), pa.array([s for s, _ in seen], pa.int32()), pa.array([w for _, w in seen], pa.binary()), pa.array(list(seen.values()), pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "shard", "window", "heavy"])

        for batch in batches:
            for row, heavy, data in zip(*(batch.column(c).to_pylist() for c in ("row", "heavy", "data")), strict=True):
                shard = (row ^ row >> 33) % SHARDS
                for j in range(len(data) - LENGTH + 1):
                    key = shard, data[j : j + LENGTH]
                    seen[key] = heavy or key in seen
            if len(seen) > 1 << 14:
                yield flush()
                seen.clear()
        yield flush()

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hi, lo, row, low): the key and place of every window of units."""
    for batch in batches:
        rows, lows, data = (batch.column(c).to_pylist() for c in ("row", "low", "data"))
        keys = _digests((memoryview(d)[j : j + LENGTH], 0) for d in data for j in range(len(d) - LENGTH + 1))
        n = np.array([max(0, len(d) - LENGTH + 1) for d in data], np.int64)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        columns = [keys[:, 0], keys[:, 1], np.repeat(np.array(rows, np.int64), n), (np.repeat(np.array(lows, np.int64), n) + within).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["hi", "lo", "row", "low"])


TRANSFORMS = "part int, shard int, transform binary, heavy binary, keys binary"


def build_transforms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A transform for each (part, shard) of sorted windows, with the key of each entry and whether it is repeated already."""

    def built(key: tuple[int, int], windows: dict[bytes, bool]) -> pa.RecordBatch:
        order, transform = shard_transform(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, LENGTH))
        heavy = np.fromiter(windows.values(), bool, len(windows))[order].tobytes()
        columns = [[key[0]], [key[1]], [transform.tobytes()], [heavy], [_digests((w, 0) for w in windows)[order].tobytes()]]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "shard", "transform", "heavy", "keys"])

    key, windows = None, {}
    for batch in batches:
        for part, shard, window, heavy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (part, shard):
                if windows:
                    yield built(key, windows)
                key, windows = (part, shard), {}
            windows[window] = heavy or window in windows
    if windows:
        yield built(key, windows)


def repeated_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo): the key of each repeated interval of the merge of a part's shards, sorted by part, and of each entry that was repeated before."""

    def merged(shards: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        interleave, block, common = merge_transforms([np.frombuffer(t, np.uint8).reshape(LENGTH, -1) for t, _, _ in shards])
        again, keys = common == LENGTH, np.empty((len(block), 2), "<i8")
        for k, (_, heavy, own) in enumerate(shards):  # a shard's entries stand in its own order
            mine = np.flatnonzero(interleave == k)
            again[mine] |= np.frombuffer(heavy, bool)
            keys[mine] = np.frombuffer(own, "<i8").reshape(-1, 2)
        chosen = np.flatnonzero(again)
        keys = keys[chosen[np.unique(block[chosen], return_index=True)[1]]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, i])) for i in (0, 1)], names=["hi", "lo"])

    part, shards = None, []
    for batch in batches:
        for own, *shard in zip(*(batch.column(c).to_pylist() for c in ("part", "transform", "heavy", "keys")), strict=True):
            if own != part and shards:
                yield merged(shards)
                shards = []
            part = own
            shards.append(tuple(shard))
    if shards:
        yield merged(shards)


def merged_spans(units: DataFrame, scratch: Scratch, part: int = PART) -> DataFrame:
    """(row, start, end) of the windows of units that occur more than once, by transforms of shards and their merge.

    Transforms know windows, not who has them: an entry stands for all copies in a shard, so a hot window is as small as any other, and places are
    found by a join on the windows' keys with plain exchanges, which adaptive execution can split.
    """
    windows = units.agg(F.sum(F.octet_length("data") - (LENGTH - 1))).first()[0] or 0
    parts = max(1, -(-windows // part))
    dealt = mapped(units.select("row", "heavy", "data"), _windows(parts), "part int, shard int, window binary, heavy boolean")
    dealt = dealt.repartition("part", "shard").sortWithinPartitions("part", "shard")
    transforms = scratch.write(mapped(dealt, build_transforms, TRANSFORMS), "transforms")
    sorted_ = transforms.repartition("part").sortWithinPartitions("part", "shard")
    again = scratch.write(mapped(sorted_, repeated_intervals, "hi long, lo long"), "intervals")
    places = mapped(units.select("row", "low", "data"), _places, "hi long, lo long, row long, low int")
    return scratch.write(places.join(again, ["hi", "lo"]).select("row", F.col("low").alias("start"), (F.col("low") + LENGTH).alias("end")), "window-spans")


def repeated_spans(texts: DataFrame, anchored: DataFrame, scratch: Scratch, part: int = PART) -> DataFrame:
    """(row, start, end), as they come and overlapping, that together cover every repeated window of texts (row, text).

    `anchored` (row, node, runs) is the scratch's table of that name and goes once it is read. Texts of one node are the same text and count once.
    """
    runs = anchored.select("row", "node", F.explode("runs").alias("run")).select("row", "run.*", F.xxhash64("node", "run.span").alias("place"))
    elsewhere = F.min("place") != F.max("place")  # equal texts have equal places
    twice = scratch.write(runs.groupBy("anchor").agg(elsewhere.alias("twice")).where("twice").select("anchor"), "anchors")
    listed = scratch.write(runs.join(twice, "anchor").withColumn("heavy", F.lit(False)), "listed")
    scratch.drop("anchored", "anchors")
    repeated, open_ = narrow(scratch, listed, "anchor", F.when(elsewhere, 2).otherwise(1), "runs")
    low, size, at = unpacked()
    spans = repeated.select("row", low.alias("start"), (low + size).alias("end"))
    per_text = open_.groupBy("row").agg(F.collect_list(F.struct(low.alias("low"), size.alias("size"), at.alias("at"), "heavy")).alias("runs"))
    units = scratch.write(mapped(texts.select("row", "text").join(per_text, "row"), _cut_texts, UNITS), "units")
    scratch.drop("listed", "runs-kinds")
    before = "units"
    for step in STEPS:
        name = f"steps-{step}"
        steps = scratch.write(mapped(units, _stepped(step), "row long, heavy boolean, span long, core long, hi long, lo long"), name)
        repeated, open_ = narrow(scratch, steps, "core", F.sum(1 + F.col("heavy").cast("int")), name)
        low, begin, n = unpacked()
        spans = spans.unionByName(repeated.select("row", (low + begin).alias("start"), (low + begin + n - 1 + LENGTH).alias("end")))
        per_unit = open_.groupBy("row", low.alias("low")).agg(F.collect_list(F.struct(begin.alias("begin"), n.alias("n"), "heavy")).alias("steps"))
        finer = units.drop("heavy").join(per_unit, ["row", "low"]).select("row", "low", "at", "data", "steps")
        units = scratch.write(mapped(finer, _cut_units, UNITS), f"units-{step}")
        scratch.drop(name, f"{name}-kinds", before)
        before = f"units-{step}"
    return spans.unionByName(merged_spans(units, scratch, part))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: int = PART, carry: list[str] | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) for every row: each text's UTF-8 without repeated strings.

    A byte goes when a string of LENGTH bytes covers it that also starts anywhere else, in the same text or another, overlaps
    included; strings are judged on the input and never cross texts. Null and empty texts, and texts under LENGTH bytes, keep
    everything. Equal texts of LENGTH bytes or more go entirely, and one of them stands for all in the search. Rows get keys of their own,
    so null and repeated ids do no harm: rows that repeat an id and a long text are copies of each other like any. Other columns are dropped,
    or handed through if `carry` names them in the id's place; an empty table gives no rows. Texts of any length are searched in steps of a MiB.
    What is cut may end within a character, so kept is binary.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    carry = [id_col] if carry is None else carry
    own = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("own")
    source = docs.select(own, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = source.schema["own"].dataType.simpleString()
    texts = scratch.write(source.withColumn("row", F.monotonically_increasing_id()), "texts")  # once written, a row's key stays
    schema = "row long, n_bytes long, node binary, runs array<struct<anchor:long,span:long,hi:long,lo:long>>"
    anchored = scratch.write(mapped(texts.select("row", "text"), _anchored(), schema), "anchored")
    long_ = anchored.where(f"n_bytes >= {LENGTH}").select("row", "node")
    copies = scratch.write(long_.groupBy("node").agg(F.count("*").alias("copies")).where("copies > 1").select("node"), "copies")
    gone = scratch.write(long_.join(copies, "node").select("row", F.lit(True).alias("gone")), "gone")
    spans = repeated_spans(texts, anchored, scratch, part)
    cuts = scratch.write(spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "cuts")
    scratch.drop(f"units-{STEPS[-1]}", "transforms", "intervals", "window-spans", "runs-repeated", *(f"steps-{n}-repeated" for n in STEPS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, gone_, spans_ in zip(*(batch.column(c).to_pylist() for c in ("text", "gone", "spans")), strict=True):
                body = body.encode()
                if gone_:
                    out.append((len(body), len(body), 1, b""))
                    continue
                left, removed, runs, at = [], 0, 0, 0
                end = -1
                for s in sorted((x["start"], x["end"]) for x in spans_ or []):
                    if s[0] > end:
                        left.append(body[at : s[0]])
                        runs += 1
                        at = s[0]
                    end = max(end, s[1])
                    removed += max(0, end - max(at, s[0]))
                    at = max(at, end)
                left.append(body[at:])
                out.append((len(body), removed, runs, b"".join(left)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("own"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["own", "n_bytes", "n_removed", "n_spans", "kept"])

    verdict = texts.select("row", "own", "text").join(cuts, "row", "left").join(gone, "row", "left").select("own", "text", "gone", "spans")
    return mapped(verdict, cut, f"own {kind}, n_bytes long, n_removed long, n_spans long, kept binary").select("own.*", "n_bytes", "n_removed", "n_spans", "kept")


def removal_digests(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of what remove_repeats returns."""
    return cut.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
