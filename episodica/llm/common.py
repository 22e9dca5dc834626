"""Pieces that several operators share: scratch tables, connected components, byte fingerprints."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches have so many rows and bytes at most (a longer row is a batch of its own), whatever the texts.
ROWS_PER_BATCH, BYTES_PER_BATCH = 1024, 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor must see. Unset is an error, but for local[...], where a temporary one does."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="episodica-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables as Parquet in the shared folder; written tables cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        small_batches(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; the rest goes with the shared folder."""
        jvm = self.spark._jvm
        for name in names:
            place = jvm.org.apache.hadoop.fs.Path(self.path(name))
            place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """Readies a session for the operators' Python: small Arrow batches, and this package on every worker's path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    # joins whose smaller side has at most so much in any partition need no sort
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "16m")
    context = spark.sparkContext
    if getattr(context, "_episodica_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="episodica-"), "episodica_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, Path(package.name, source.relative_to(package)))
    context.addPyFile(str(archive))
    context._episodica_shipped = True


_kept: dict[str, Any] = {}


def kept(token: str, make: Callable[[], Any]) -> Any:
    """What make() gives, kept in this worker for later tasks of the same token; what another token kept goes."""
    if token not in _kept:
        _kept.clear()
        _kept[token] = make()
    return _kept[token]


def release_memory() -> None:
    """Gives what a worker has freed back to the system, so that the stages of a long application don't add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, token: str = "") -> DataFrame:
    """mapInArrow whose tasks begin without what other operators kept in the worker and give their memory back at the end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _kept:
            _kept.clear()
        try:
            yield from run(batches)
        finally:
            release_memory()

    small_batches(df.sparkSession)
    return df.mapInArrow(task, schema)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows (n + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs_of_rows(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes at most; one row may be longer."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = last


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else _INVERSE
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        _powers[kind] = have = np.cumprod(grown)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i], shifted to a common origin, a fingerprint of data[i:j]."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of many slices at once, equal for equal bytes wherever they stand."""
    raw = (sums[ends] - sums[starts]) * _power("down", len(sums))[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Up to so many edges of spanning forests one task may finish alone: some 150 MB.
ONE_TASK_EDGES = 500_000
#: A task that contracts edges hands on its forest whenever it holds so many nodes: some 200 MB. Twice ONE_TASK_EDGES at least, as these must end in one forest.
FOREST_NODES = 1 << 20


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str = "components", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge; edges has (a, b) long.

    Alternates large-star and small-star rounds (Kiveris et al., 2014) over tables in the shared folder until the
    edges stay the same; each task first contracts its own edges to a spanning forest, which keeps the number of
    rounds small (a new forest after every FOREST_NODES nodes, so a task's memory has a bound), and once there are at most `one_task` edges left in all one task contracts them. Every table is linear in the edges; only a count and a checksum reach the driver. Loops and repeated edges are
    allowed; no edges give no rows.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        def forest() -> Iterator[pa.RecordBatch]:
            nodes = [x for x in parent if find(x) != x]
            for i in range(0, len(nodes), 65536):
                part = nodes[i : i + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > FOREST_NODES:
                yield from forest()
                parent.clear()
        yield from forest()

    current = scratch.write(mapped(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), contract, "a long, b long"), f"{name}-0")
    before, turn = None, 0
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == before:
            break
        if state[0] <= one_task:
            current = scratch.write(mapped(current.coalesce(1), contract, "a long, b long"), f"{name}-last")
            scratch.drop(f"{name}-{turn}")
            break
        before = tuple(state)
        # a > b holds on every edge; large-star: neighbours above a node are tied to the smallest one around it
        least = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        large = current.join(least, F.col("b") == F.col("node"), "left").select("a", F.least("b", F.coalesce("least", "b")).alias("b"))
        # small-star: all smaller neighbours of a node, and itself, are tied to the smallest of them
        small = scratch.write(large.distinct(), f"{name}-large-{turn}")
        least = small.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        tied = small.join(least, F.col("a") == F.col("node")).select(
            F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")
        )
        following = scratch.write(tied.select("e.a", "e.b").where("a <> b").distinct(), f"{name}-{turn + 1}")
        scratch.drop(f"{name}-{turn}", f"{name}-large-{turn}")
        current, turn = following, turn + 1
    nodes = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
