"""Near-duplicate vectors by int8 tile products with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import Scratch, connected_components, mapped

#: Distinct vectors in one side of a tile, on average.
TILE = 1024


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: exact, and no norm over- or underflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values, scale and the norm of what rounding left out, of each row of a matrix of unit vectors.

    A row is u = s q + e with s = max|u| / 127; ||e|| is measured, not estimated.
    """
    scale = np.abs(unit).max(axis=1, initial=0) / 127
    q = np.rint(unit / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    left = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q, scale, left


def tile_links(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two matrices of vectors whose cosine is at least `least`; of one tile with itself only i < j.

    u.v = st q.r + s q.f + e.(t r) + e.f, so |u.v - st q.r| <= ||sq|| ||f|| + ||e|| (||tr|| + ||f||) for u = sq + e
    and v = tr + f. Only pairs which that bound lets reach the threshold are computed again in double precision. The products of
    int8 values are summed exactly: they stay under 2**24 in float32 up to 1040 dimensions, above that float64 is used.
    """
    a, b = scaled(a), scaled(b)
    ua, ub = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    (q, s, e), (r, t, f) = quantised(ua), quantised(ub)
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    whole_q, whole_r = np.linalg.norm(q * s[:, None], axis=1), np.linalg.norm(r * t[:, None], axis=1)
    rows, columns = [], []
    for i in range(0, len(q), 256):
        part = slice(i, i + 256)
        near = (q[part].astype(kind) @ r.T.astype(kind)).astype(np.float64) * s[part, None] * t[None, :]
        bound = whole_q[part, None] * f[None, :] + e[part, None] * (whole_r + f)[None, :]
        x, y = np.nonzero(near + bound + 1e-9 >= least)
        x += i
        if same:
            x, y = x[x < y], y[x < y]
        for j in range(0, len(x), 1 << 16):
            xs, ys = x[j : j + (1 << 16)], y[j : j + (1 << 16)]
            dots = np.einsum("ij,ij->i", a[xs], b[ys]) / (np.linalg.norm(a[xs], axis=1) * np.linalg.norm(b[ys], axis=1))
            rows.append(xs[dots >= least])
            columns.append(ys[dots >= least])
    return np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*columns, np.zeros(0, np.int64)]).astype(np.int64)


def _tiles(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, copies, data = (np.frombuffer(row[k], kind) for k, kind in (("ids", "<i8"), ("copies", "<i8"), ("vectors", "<f8")))
                other_ids, other_copies, other = (np.frombuffer(row[k], kind) for k, kind in (("other_ids", "<i8"), ("other_copies", "<i8"), ("other_vectors", "<f8")))
                same = row["block"] == row["other_block"]
                a, b = data.reshape(len(ids), -1), other.reshape(len(other_ids), -1)
                if not len(ids) or not len(other_ids) or a.shape[1] != b.shape[1]:
                    continue
                x, y = tile_links(a, b, least, same)
                every = np.concatenate([ids, other_ids])
                found = np.concatenate([np.bincount(x, other_copies[y], len(ids)), np.bincount(y, copies[x], len(other_ids))]).astype(np.int64)
                parent = np.arange(len(every))

                def find(i: int) -> int:
                    while parent[i] != i:
                        parent[i] = parent[parent[i]]
                        i = parent[i]
                    return i

                place = {v: i for i, v in enumerate(ids.tolist())}
                at = np.fromiter((place.get(v, i + len(ids)) for i, v in enumerate(other_ids.tolist())), np.int64, len(other_ids))
                for i, j in zip(x.tolist(), at[y].tolist(), strict=True):
                    i, j = find(i), find(j)
                    if i != j:
                        i, j = (i, j) if every[i] < every[j] else (j, i)
                        parent[j] = i
                roots = np.fromiter((find(i) for i in range(len(every))), np.int64, len(every))
                keep = np.flatnonzero(found > 0)
                yield pa.RecordBatch.from_arrays([pa.array(every[keep]), pa.array(every[roots[np.concatenate([np.arange(len(ids)), at])[keep]]]), pa.array(found[keep])], names=["a", "b", "n"])

    return run


def may_link(q: np.ndarray, s: np.ndarray, e: np.ndarray, r: np.ndarray, t: np.ndarray, f: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the rows of two int8 tiles that the bound of tile_links lets link with any row of the other; of one tile with itself, with another row."""
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    whole_q, whole_r = np.linalg.norm(q * s[:, None], axis=1), np.linalg.norm(r * t[:, None], axis=1)
    here, there = np.zeros(len(q), bool), np.zeros(len(r), bool)
    for i in range(0, len(q), 256):
        part = slice(i, i + 256)
        near = (q[part].astype(kind) @ r.T.astype(kind)).astype(np.float64) * s[part, None] * t[None, :]
        near += whole_q[part, None] * f[None, :] + e[part, None] * (whole_r + f)[None, :]
        may = near + 1e-9 >= least
        if same:
            may[np.arange(len(may)), i + np.arange(len(may))] = False
        here[part] |= may.any(axis=1)
        there |= may.any(axis=0)
    return here, there


def _screened(least: float):
    """Ids of the vectors of pairs of int8 blocks that may have a link there."""

    def side(row: dict, prefix: str) -> tuple[np.ndarray, ...]:
        ids, scale, left = (np.frombuffer(row[prefix + c], k) for c, k in (("ids", "<i8"), ("scale", "<f8"), ("error", "<f8")))
        return ids, np.frombuffer(row[prefix + "q"], np.int8).reshape(len(ids), -1), scale, left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (ids, *a), (other, *b) = side(row, ""), side(row, "other_")
                here, there = may_link(*a, *b, least, row["block"] == row["other_block"])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([ids[here], other[there]])))], names=["id"])

    return run


def _packed_int8(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in groups:
        columns: list[list] = [[], [], [], []]
        for rows in batch.column(2).to_pylist():
            vectors = scaled(np.array([r["vector"] for r in rows], "<f8"))
            q, scale, left = quantised(vectors / np.linalg.norm(vectors, axis=1)[:, None])
            for c, x in zip(columns, (np.array([r["id"] for r in rows], "<i8"), q, scale.astype("<f8"), left.astype("<f8")), strict=True):
                c.append(np.ascontiguousarray(x).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in columns)], names=["label", "block", "ids", "q", "scale", "error"])


def _packed(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in groups:
        sides = batch.column(2).to_pylist()
        ids = [np.array([r["id"] for r in rows], "<i8").tobytes() for rows in sides]
        copies = [np.array([r["copies"] for r in rows], "<i8").tobytes() for rows in sides]
        data = [np.array([r["vector"] for r in rows], "<f8").tobytes() for rows in sides]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(copies, pa.binary()), pa.array(data, pa.binary())], names=["label", "block", "ids", "copies", "vectors"])


def embedding_near_dedup(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) per row: links are other rows of equal, non-null label with cosine >= least.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with
    nothing; so do vectors of different length. Equal vectors are collapsed first, and their copies counted; the distinct
    vectors of a label are dealt by hash into blocks of about `tile`, and every pair of blocks is one small task. First the blocks meet as int8 with their
    error norms, an eighth of the bytes, to find the vectors that may link at all; only those meet again in double precision, with output
    linear in their rows (a spanning forest and sums), never a list of pairs. Vectors are scaled by powers of two, so norms of any size are right. Rows have keys of their own: those that repeat an id or a vector link as
    copies do, and a null id takes its component's smallest id, or null where nothing else has one. Other columns are dropped; an empty table gives no rows. The work in a label is quadratic, as its
    definition is: tiles make it dense arithmetic that spreads over the cluster.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("own"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = scratch.write(rows.withColumn("id", F.monotonically_increasing_id()), "rows")  # once written, a row's key stays
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite).withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, 0.0).otherwise(x)))
    grouped = scratch.write(usable.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "distinct")
    kind = vectors.schema[label].dataType.simpleString()

    def met(distinct: DataFrame, pack, columns: dict[str, str], work, schema: str, name: str) -> DataFrame:
        """What work makes of every pair of packed blocks of a label and width."""
        counts = distinct.groupBy("label", F.size("vector").alias("width")).agg(F.ceil(F.count("*") / tile).alias("blocks"))
        counts = scratch.write(counts, f"{name}-counts")  # so that the join below has plain exchanges, whose large labels can be split
        dealt = distinct.withColumn("width", F.size("vector")).join(counts, ["label", "width"])
        blocks = dealt.withColumn("block", F.struct("width", F.pmod(F.xxhash64("id"), "blocks").alias("part"))).groupBy("label", "block")
        blocks = blocks.agg(F.collect_list(F.struct("id", "copies", "vector")).alias("rows")).select("label", "block", "rows")
        fields = ", ".join(f"{c} {k}" for c, k in columns.items())
        packed = scratch.write(mapped(blocks, pack, f"label {kind}, block struct<width:int,part:long>, {fields}"), f"{name}-blocks")
        other = packed.select("label", *(F.col(c).alias(f"other_{c}") for c in ("block", *columns)))
        pairs = packed.join(other, "label").where("block.width = other_block.width AND block.part <= other_block.part")
        pairs = pairs.repartition(F.xxhash64("label", "block", "other_block")).drop("label")
        return scratch.write(mapped(pairs, work, schema), name)

    binary = dict.fromkeys(("ids", "q", "scale", "error"), "binary")
    active = met(grouped, _packed_int8, binary, _screened(least), "id long", "screened").distinct()
    near = scratch.write(grouped.join(active, "id"), "active")
    links = met(near, _packed, dict.fromkeys(("ids", "copies", "vectors"), "binary"), _tiles(least), "a long, b long, n long", "links")
    components = connected_components(spark, links.select("a", "b"), scratch)
    found = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    members = usable.select(F.col("id"), "label", "vector")
    classes = grouped.select("label", "vector", F.col("id").alias("rep"), "copies")
    classes = classes.join(found, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    classes = scratch.write(classes.select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "classes")
    linked = scratch.write(members.join(classes, ["label", "vector"]).select("id", "n_links", "component_id"), "linked")
    whole = rows.select("id", "own").join(linked, "id", "left")
    whole = scratch.write(whole.select("own", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component")), "whole")
    least = scratch.write(whole.groupBy("component").agg(F.min("own").alias("component_id")), "least")
    answer = whole.join(least, "component").select(F.col("own").alias(id_col), "n_links", "component_id")
    return answer.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
