"""Vectors and matrices in .npy files as a data source: read by ranges of rows, written in parts and joined by the commit."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from episodica.sources.namedfiles import exists, place

#: Rows of a reader's task and of its batches, and the bytes that are copied or zeroed at once.
TASK_ROWS, BATCH_ROWS, COPY = 1 << 20, 1 << 16, 4 << 20


@dataclass
class Header:
    kind: np.dtype
    shape: tuple[int, ...]
    columns_first: bool
    offset: int


def header(path: str) -> Header:
    """What a file's first bytes say; only numbers in one or two dimensions are read."""
    system, at = place(path)
    with system.open_input_file(at) as f:
        version = np.lib.format.read_magic(f)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
        if read is None:
            raise ValueError(f"{path}: version {version} of the format")
        shape, columns_first, kind = read(f)
        if kind.kind not in "fiub" or len(shape) not in (1, 2):
            raise ValueError(f"{path}: {kind} of shape {shape}, not numbers in one or two dimensions")
        return Header(kind, shape, columns_first and len(shape) == 2, f.tell())


@dataclass
class Range(InputPartition):
    number: int
    path: str
    start: int
    end: int


def _whole(kind: np.dtype) -> bool:
    return kind.kind in "iub"


class NpyReader(DataSourceReader):
    def __init__(self, paths: list[str], rows: int):
        self.paths, self.rows = paths, rows

    def partitions(self) -> list[Range]:
        out = []
        for number, path in enumerate(self.paths):
            n = header(path).shape[0]
            out += [Range(number, path, i, min(n, i + self.rows)) for i in range(0, n, self.rows)]
        return out or [Range(0, "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        about = header(partition.path)
        width = about.shape[1] if len(about.shape) == 2 else 1
        size, kind = about.kind.itemsize, pa.int64() if _whole(about.kind) else pa.float64()
        system, at = place(partition.path)
        with system.open_input_file(at) as f:

            def part(first: int, count: int) -> np.ndarray:
                f.seek(about.offset + first * size)
                body = f.read(count * size)
                if len(body) < count * size:
                    raise ValueError(f"{partition.path} is cut short")
                return np.frombuffer(body, about.kind)

            for i in range(partition.start, partition.end, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.end - i)
                if about.columns_first:
                    columns = [part(c * about.shape[0] + i, n) for c in range(width)]
                else:
                    columns = list(part(i * width, n * width).reshape(n, width).T)
                values = [pa.array(np.ascontiguousarray(c).astype(np.int64 if _whole(about.kind) else np.float64), kind) for c in columns]
                names = [f"c{c}" for c in range(width)] if len(about.shape) == 2 else ["value"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, partition.number, np.int32)), pa.array(np.arange(i, i + n)), *values], names=["file", "i", *names])


@dataclass
class Part(WriterCommitMessage):
    """Rows [first, end) in a raw file of float64, or nothing."""

    name: str = ""
    first: int = 0
    end: int = 0
    rows: int = 0


class NpyWriter(DataSourceArrowWriter):
    """Rows (i, value), by ranges of i and in order: a dense vector of `length`, zero where no row is, or without a length the pairs as a matrix."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.length = int(options["length"]) if "length" in options else None
        system, at = place(self.path)
        if exists(system, at) and not overwrite:
            raise FileExistsError(f"{self.path} already exists")
        folder, _, name = at.rpartition("/")
        self.staging = f"{folder}/.{name}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, _ = place(self.path)
        part, out = Part(), None
        for batch in iterator:
            if not batch.num_rows:
                continue
            ids, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype("<f8")
            if batch.column(0).null_count or batch.column(1).null_count:
                raise ValueError("rows must have a place and a value")
            if self.length is not None and (ids[0] < 0 or ids[-1] >= self.length):
                raise ValueError(f"places {ids[0]} to {ids[-1]} are not within 0 to {self.length - 1}")
            if (np.diff(ids) <= 0).any() or (out is not None and ids[0] < part.end):
                raise ValueError("places must ascend and not repeat")
            if out is None:
                system.create_dir(self.staging, recursive=True)
                part = Part(f"{self.staging}/{uuid.uuid4().hex}", int(ids[0]), int(ids[0]))
                out = system.open_output_stream(part.name)
            if self.length is None:
                out.write(np.column_stack([ids.astype("<f8"), values]).tobytes())
            else:
                for start in range(0, len(ids), BATCH_ROWS):
                    self._fill(out, ids[start : start + BATCH_ROWS], values[start : start + BATCH_ROWS], part.end if start == 0 else int(ids[start - 1]) + 1)
            part.end, part.rows = int(ids[-1]) + 1, part.rows + len(ids)
        if out is not None:
            out.close()
        return part

    @staticmethod
    def _zeros(out, count: int) -> None:
        while count > 0:
            now = min(count, COPY // 8)
            out.write(bytes(8 * now))
            count -= now

    def _fill(self, out, ids: np.ndarray, values: np.ndarray, at: int) -> None:
        """Writes values at their places, with zeros between them; wide gaps are written on their own."""
        wide = np.flatnonzero(np.diff(ids, prepend=at) > COPY // 8)
        for start, end in zip([0, *wide], [*wide, len(ids)], strict=True):
            if start == end:
                continue
            if ids[start] > at:
                self._zeros(out, int(ids[start]) - at)
            dense = np.zeros(int(ids[end - 1] - ids[start]) + 1, "<f8") if end - start > 1 else np.zeros(1, "<f8")
            dense[ids[start:end] - ids[start]] = values[start:end]
            out.write(dense.tobytes())
            at = int(ids[end - 1]) + 1

    def commit(self, messages: list[Part | None]) -> None:
        """Streams the parts behind one header into a file that then takes its name; the driver holds a few MB, whatever the vector's length."""
        system, at = place(self.path)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)
        if any(b.first < a.end for a, b in zip(parts, parts[1:], strict=False)):
            self.abort(messages)
            raise ValueError("places must not repeat")
        system.create_dir(self.staging, recursive=True)
        shape = (sum(p.rows for p in parts), 2) if self.length is None else (self.length,)
        with system.open_output_stream(f"{self.staging}/whole") as out:
            np.lib.format.write_array_header_1_0(out, {"descr": "<f8", "fortran_order": False, "shape": shape})
            end = 0
            for part in parts:
                if self.length is not None:
                    self._zeros(out, part.first - end)
                with system.open_input_stream(part.name) as body:
                    while piece := body.read(COPY):
                        out.write(piece)
                end = part.end
            if self.length is not None:
                self._zeros(out, self.length - end)
        if exists(system, at) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} already exists")
        system.move(f"{self.staging}/whole", at)
        system.delete_dir(self.staging)

    def abort(self, messages: list[Part | None]) -> None:
        system, _ = place(self.path)
        if exists(system, self.staging):
            system.delete_dir(self.staging)


class Npy(DataSource):
    """Reads (file, i, value) of vectors, (file, i, c0, c1, ...) of matrices; file is the place in `paths` (JSON) and i the row. Writes (i, value)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _paths(self) -> list[str]:
        return json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]

    def schema(self) -> StructType:
        about = [header(p) for p in self._paths()]
        if len({(a.shape[1:], _whole(a.kind)) for a in about}) != 1:
            raise ValueError("files of one read must have the same width and kind of number")
        kind = LongType() if _whole(about[0].kind) else DoubleType()
        out = StructType().add("file", IntegerType(), False).add("i", LongType(), False)
        for c in ["value"] if len(about[0].shape) == 1 else [f"c{c}" for c in range(about[0].shape[1])]:
            out = out.add(c, kind, False)
        return out

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self._paths(), int(self.options.get("rows", TASK_ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(dict(self.options), overwrite)


def read_npy(spark: SparkSession, paths: list[str], rows: int = TASK_ROWS) -> DataFrame:
    """(file, i, value or c0, c1, ...) of .npy files, a task for every `rows` rows; nothing of them reaches the driver but their headers."""
    spark.dataSource.register(Npy)
    return spark.read.format("npy").option("paths", json.dumps(paths)).option("rows", rows).load()


def write_npy(pairs: DataFrame, path: str, index: str, value: str, length: int | None = None) -> None:
    """A dense vector of `length` with zeros where no row is, or the (index, value) pairs in order as a matrix; the file is replaced in one step."""
    pairs.sparkSession.dataSource.register(Npy)
    rows = pairs.select(F.col(index).cast("long").alias("i"), F.col(value).cast("double").alias("value"))
    rows.repartitionByRange("i").sortWithinPartitions("i").write.format("npy").mode("overwrite").option("path", path).options(**({} if length is None else {"length": length})).save()


cloudpickle.register_pickle_by_value(sys.modules[__name__])
