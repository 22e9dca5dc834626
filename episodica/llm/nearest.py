"""Approximate nearest neighbours: lists around centres, scanned by blocks of rotated dimensions with early abandonment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import Scratch, mapped

#: Vectors of a list that one tile holds, and queries that meet a tile together, on average.
TILE, QUERIES = 1024, 1024
#: Rotated dimensions that a scan adds between two tests, and the tests' confidence: a near candidate is lost with a chance of about exp(-c EPSILON**2).
BLOCK, EPSILON = 16, 2.1


@dataclass
class Lists:
    """Centres of the lists of vectors of one length, the rotation, and how many lists a query needs; bounded by the sample."""

    centres: np.ndarray
    rotation: np.ndarray
    probes: int
    sizes: np.ndarray | None = None

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([self.gaps(part).argmin(axis=1) for part in _parts(vectors)])

    def gaps(self, vectors: np.ndarray) -> np.ndarray:
        return (self.centres**2).sum(axis=1)[None, :] - 2 * vectors @ self.centres.T

    def chosen(self, vectors: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
        """(query, list, stage): the nearest lists with `least` vectors in all are stage 0, further ones up to `probes` stage 1."""
        for start, part in zip(range(0, len(vectors), 4096), _parts(vectors), strict=False):
            order = np.argsort(self.gaps(part), axis=1, kind="stable")
            held = np.cumsum(self.sizes[order], axis=1)
            first = 1 + (held < least).sum(axis=1)  # so many lists are needed for enough vectors
            for i, row in enumerate(order):
                for place, one in enumerate(row[: max(self.probes, first[i])].tolist()):
                    if self.sizes[one]:
                        yield start + i, one, int(place >= first[i])


def _parts(vectors: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(0, max(1, len(vectors)), 4096):
        yield vectors[i : i + 4096]


def _by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the vectors of each length in a column of lists."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
    for width in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == width)
        yield width, at, flat[starts[at][:, None] + np.arange(width)[None, :]]


def make_lists(sample: np.ndarray, wanted: int, k: int, recall: float, seed: int) -> Lists:
    """k-means over a sample, and the number of lists that hold `recall` of the k nearest in it, by a trial of 256 of its vectors.

    The whole table is at least as dense as its sample, so its nearest are nearer and lie in fewer lists.
    """
    rng = np.random.default_rng(seed)
    n, width = sample.shape
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    lists = Lists(sample[rng.permutation(n)[: max(1, min(wanted, n // 32))]].copy(), rotation, 1)
    for _ in range(12):
        own = lists.assign(sample)
        counts = np.bincount(own, minlength=len(lists.centres))
        sums = np.zeros_like(lists.centres)
        np.add.at(sums, own, sample)
        lists.centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], lists.centres)
    own = lists.assign(sample)
    trial = rng.permutation(n)[:256]
    order = np.argsort(lists.gaps(sample[trial]), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    gaps = (sample**2).sum(axis=1)[None, :] - 2 * sample[trial] @ sample.T
    gaps[np.arange(len(trial)), trial] = np.inf
    near = np.argsort(gaps, axis=1)[:, : min(k, n - 1)]
    ranks = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    lists.probes = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1
    return lists


def scan(rotated: np.ndarray, originals: np.ndarray, ids: list, query: np.ndarray, turned: np.ndarray, limit: float, k: int, epsilon: float = EPSILON, block: int = BLOCK) -> tuple[list[tuple[float, int]], int]:
    """The k nearest of a tile to a query, (squared distance, row), by (distance, id), among those not farther than limit; and the dimensions summed.

    rotated holds the tile by columns. After each block the partial squared distance over d of D dimensions, times D / d, tests whether
    the whole one can be within the limit: beyond (1 + epsilon / sqrt(d))**2 times the limit a candidate is abandoned. Survivors are measured
    on the original vectors. Without a limit the first rows set one. What rounding of the rotation can add is allowed for.
    """
    width, n = rotated.shape
    slack = 1e-12 * ((query**2).sum() + (originals**2).sum(axis=1).max(initial=0))
    best: list[tuple] = []
    done, cost = 0, 0
    while done < n:
        alive = np.arange(done, min(n, done + (4 * k if limit == np.inf else n)))
        done = alive[-1] + 1
        partial = np.zeros(len(alive))
        for d in range(0, width, block):
            if limit < np.inf and d:
                reach = limit * (d / width) * (1 + epsilon / np.sqrt(d)) ** 2
                stay = partial <= reach + slack
                alive, partial = alive[stay], partial[stay]
                if not len(alive):
                    break
            part = rotated[d : d + block]
            part = part[:, alive] if len(alive) < n else part
            partial += ((part - turned[d : d + block, None]) ** 2).sum(axis=0)
            cost += len(alive) * min(block, width - d)
        if len(alive):
            exact = ((originals[alive] - query) ** 2).sum(axis=1)
            best += [(e, ids[i] is None, ids[i] or 0, i) for e, i in zip(exact.tolist(), alive.tolist(), strict=True) if e <= limit]
            best = sorted(best)[:k]
            if len(best) == k:
                limit = min(limit, best[-1][0])
    return [(e, i) for e, *_, i in best], cost


def _usable(vector):
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return vector.isNotNull() & fine


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", sample: int = 32_768, recall: float = 0.99, seed: int = 7, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest rows of vectors found, by Euclidean distance, ties to the smaller id.

    queries has the columns of vectors; a query that is a row of vectors by id and vector doesn't find that row, once. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, on either side; vectors of different length never meet. Of equal vectors only the
    k + 1 rows of least id are searched, which are all that an answer can name, so copies make no large lists; equal queries are searched once.
    Rows without an id come after others; other columns are dropped; an empty table gives no rows; fewer than k candidates are all returned.

    Lists come from k-means over at most `sample` vectors of each length, chosen by hash: that is what the driver and the model hold. Every row
    is dealt to its nearest list, lists of any size to tiles of about `tile`. A query first scans its nearest lists, as many as hold k + 1
    rows, which gives it a limit, then the others that the model's trial asks for. Only its best of each tile leave a task.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    kind = vectors.schema[id_col].dataType.simpleString()

    def plain(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        return df.select(F.col(id_col).alias("id"), v.alias("v")).where(_usable(F.col("v"))).withColumn("v", F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)))

    asked = scratch.write(plain(queries).withColumn("own", F.monotonically_increasing_id()), "queries")
    apart = scratch.write(asked.groupBy("v").agg(F.min("own").alias("q")), "distinct-queries")
    first = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    rows = plain(vectors).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).drop("place")
    rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("width", F.size("v")), "rows")

    widths = scratch.write(rows.groupBy("width").agg(F.count("*").alias("n")), "widths")
    counts = {r["width"]: r["n"] for r in widths.collect()}
    share = F.when(F.col("n") <= sample, 1.0).otherwise(0.95 * sample / F.col("n"))  # a little less, so that chance does not go beyond the bound
    drawn = rows.join(widths, "width").where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share * (1 << 30))
    taken: dict[int, list] = {}
    for r in drawn.select("width", "row", "v").toLocalIterator():
        own = taken.setdefault(r["width"], [])
        if len(own) < sample:
            own.append((r["row"], np.array(r["v"])))
    models = {w: make_lists(np.stack([v for _, v in sorted(own, key=lambda x: x[0])]), int(np.ceil(np.sqrt(counts[w]))), k + 1, recall, seed) for w, own in taken.items()}
    del taken
    trained = spark.sparkContext.broadcast(models)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int32)
            for width, at, data in _by_width(batch.column(1)):
                out[at] = trained.value[width].assign(data)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=["id", "v", "width", "row", "list"])

    dealt = scratch.write(mapped(rows.select("id", "v", "width", "row"), assign, f"id {kind}, v array<double>, width int, row long, list int"), "dealt")
    sizes = scratch.write(dealt.groupBy("width", "list").agg(F.count("*").alias("n")), "sizes")
    for w, model in models.items():
        model.sizes = np.zeros(len(model.centres), np.int64)
    for r in sizes.collect():  # a row per list, of which there are fewer than sampled vectors
        models[r["width"]].sizes[r["list"]] = r["n"]
    shared = spark.sparkContext.broadcast(models)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, one, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = np.array([m["v"] for m in members], "<f8")
                turned = np.ascontiguousarray((data @ shared.value[width].rotation).T, "<f8")
                yield pa.RecordBatch.from_pylist([{"width": width, "list": one, "ids": [m["id"] for m in members], "rows": [m["row"] for m in members], "rotated": turned.tobytes(), "originals": data.tobytes()}], pa.schema([("width", pa.int32()), ("list", pa.int32()), ("ids", pa.list_(batch.schema.field("members").type.value_type.field("id").type)), ("rows", pa.list_(pa.int64())), ("rotated", pa.binary()), ("originals", pa.binary())]))

    parts = sizes.select("width", "list", F.ceil(F.col("n") / tile).alias("parts"))
    tiles = dealt.join(parts, ["width", "list"]).groupBy("width", "list", F.pmod(F.xxhash64("row"), "parts").alias("part")).agg(F.collect_list(F.struct("id", "row", "v")).alias("members")).select("width", "list", "members")
    tiles = scratch.write(mapped(tiles, pack, f"width int, list int, ids array<{kind}>, rows array<long>, rotated binary, originals binary"), "tiles")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(1).to_numpy()
            for width, at, data in _by_width(batch.column(0)):
                found = list(shared.value[width].chosen(data, k + 1)) if width in shared.value else []
                if found:
                    own, lists, stages = (np.array(c, np.int64) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(q[at[own]]), pa.array(np.full(len(own), width, np.int32)), pa.array(lists.astype(np.int32)), pa.array(stages.astype(np.int32))], names=["q", "width", "list", "stage"])

    probes = scratch.write(mapped(apart.select("v", "q"), choose, "q long, width int, list int, stage int"), "probes")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rotated = np.frombuffer(r["rotated"], "<f8").reshape(r["width"], -1)
                originals = np.frombuffer(r["originals"], "<f8").reshape(-1, r["width"])
                out: list[tuple] = []
                for a in r["asked"]:
                    query = np.array(a["v"])
                    found, _ = scan(rotated, originals, r["ids"], query, query @ shared.value[r["width"]].rotation, np.inf if a["limit"] is None else a["limit"], k + 1)
                    out += [(a["q"], r["rows"][i], r["ids"][i], e) for e, i in found]
                own = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(own[0], pa.int64()), pa.array(own[1], pa.int64()), pa.array(own[2], batch.schema.field("ids").type.value_type), pa.array(own[3], pa.float64())], names=["q", "row", "id", "gap"])

    best = Window.partitionBy("q").orderBy("gap", F.col("id").asc_nulls_last(), "row")

    def searched(stage: int, limits: DataFrame | None) -> DataFrame:
        """The k + 1 best of each query in the lists of a stage."""
        own = probes.where(F.col("stage") == stage).drop("stage")
        crowd = scratch.write(own.groupBy("width", "list").agg(F.ceil(F.count("*") / QUERIES).alias("parts")), f"crowd-{stage}")
        own = own.join(apart, "q")
        own = own.withColumn("limit", F.lit(None).cast("double")) if limits is None else own.join(limits, "q", "left")
        groups = own.join(crowd, ["width", "list"]).groupBy("width", "list", F.pmod(F.xxhash64("q"), "parts").alias("part")).agg(F.collect_list(F.struct("q", "v", "limit")).alias("asked"))
        pairs = scratch.write(groups.select("width", "list", "asked"), f"asked-{stage}").join(tiles, ["width", "list"])
        pairs = pairs.repartition(F.xxhash64(F.col("asked")[0]["q"], F.col("rows")[0])).select("width", "ids", "rows", "rotated", "originals", "asked")
        found = mapped(pairs, meet, f"q long, row long, id {kind}, gap double")
        return scratch.write(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"), f"found-{stage}")

    near = searched(0, None)
    limits = near.groupBy("q").agg(F.max("gap").alias("limit"), F.count("*").alias("n")).where(F.col("n") == k + 1).drop("n")
    found = near.unionByName(searched(1, limits)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")
    # each query row has its vector's answers, but for one that is the row itself: of gap 0 and its id
    by_row = asked.select(F.col("id").alias("query_id"), "own", "v").join(apart, "v").select("query_id", "own", "q").join(found, "q")
    itself = (F.col("gap") == 0) & F.col("id").eqNullSafe(F.col("query_id"))
    order = Window.partitionBy("own").orderBy("gap", F.col("id").asc_nulls_last(), "row")
    twin = Window.partitionBy("own", itself).orderBy("row")
    others = by_row.withColumn("mine", itself & (F.row_number().over(twin) == 1)).where(~F.col("mine"))
    ranked = others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.col("id").alias("vec_id"), F.sqrt("gap").alias("score"))
