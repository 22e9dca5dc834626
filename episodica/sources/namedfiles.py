"""A Parquet sink whose rows say which file they belong to; all files become visible together or not at all."""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: The first column of what is written: the file's name below the path.
FILE = "__file"
#: Rows and bytes of a row group at most.
GROUP_ROWS, GROUP_BYTES = 1 << 16, 64 << 20


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]] = field(default_factory=list)


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    system, at = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
    return system, at.rstrip("/")


def exists(system: pafs.FileSystem, at: str) -> bool:
    return system.get_file_info(at).type != pafs.FileType.NotFound


class _File:
    """A file that is written as rows come and takes its name when it is whole."""

    def __init__(self, system: pafs.FileSystem, final: str, schema: pa.Schema):
        self.system, self.final = system, final
        self.temporary = f"{final}.{uuid.uuid4().hex}.tmp"
        system.create_dir(final.rsplit("/", 1)[0], recursive=True)
        self.writer = pq.ParquetWriter(self.temporary, schema, filesystem=system)
        self.held: list[pa.RecordBatch] = []
        self.rows = self.pending = self.weight = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.rows += batch.num_rows
        self.pending += batch.num_rows
        self.weight += batch.get_total_buffer_size()
        if self.pending >= GROUP_ROWS or self.weight >= GROUP_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held))
        self.held, self.pending, self.weight = [], 0, 0

    def close(self) -> None:
        self.flush()
        self.writer.close()
        self.system.move(self.temporary, self.final)


class NamedParquetWriter(DataSourceArrowWriter):
    """Tasks write whole files into a hidden folder beside the path; commit gives the folder its name, abort deletes it."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        if not schema.fields or schema.fields[0].name != FILE:
            raise ValueError(f"the first column must be {FILE}")
        self.path, self.overwrite = options["path"], overwrite
        self.texts, self.listing = json.loads(options.get("texts", "{}")), options.get("listing")
        system, at = place(self.path)
        if exists(system, at) and not overwrite:
            raise FileExistsError(f"{self.path} already exists")
        folder, _, name = at.rpartition("/")
        self.staging = f"{folder}/.{name}.{uuid.uuid4().hex}.staging"
        self.aside = f"{folder}/.{name}.{uuid.uuid4().hex}.old"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _ = place(self.path)
        message, done, name, out = Written(), set(), None, None
        for batch in iterator:
            names, start = batch.column(0).to_pylist(), 0
            rest = batch.select(list(range(1, batch.num_columns)))
            for i in range(1, len(names) + 1):
                if i < len(names) and names[i] == names[start]:
                    continue
                if names[start] != name or out is None:
                    if out is not None:
                        out.close()
                        message.files.append((name, out.rows))
                    name = names[start]
                    if not name or name in done or ".." in name.split("/"):
                        raise ValueError(f"rows of a file must come together, under a name: {name}")
                    done.add(name)
                    out = _File(system, f"{self.staging}/{name}", rest.schema)
                out.add(rest.slice(start, i - start))
                start = i
        if out is not None:
            out.close()
            message.files.append((name, out.rows))
        return message

    def commit(self, messages: list[Written | None]) -> None:
        """Names the folder, once every file is there once; a row per file reaches the driver, as the listing of a folder does."""
        system, at = place(self.path)
        files = sorted(f for m in messages if m for f in m.files)
        names = [f for f, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"rows of a file came from several tasks: {sorted({f for f in names if names.count(f) > 1})[:5]}")
        system.create_dir(self.staging, recursive=True)
        texts = dict(self.texts)
        if self.listing:
            lines = [{"episode_index": int(m[1]), "length": n, "file": f} if (m := re.search(r"(\d+)\.[a-z]+$", f)) else {"file": f, "length": n} for f, n in files]
            texts[self.listing] = "".join(json.dumps(line) + "\n" for line in lines)
        for name, text in texts.items():
            system.create_dir(f"{self.staging}/{name}".rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(f"{self.staging}/{name}") as out:
                out.write(text.encode())
        old = exists(system, at)
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} already exists")
        if old:
            system.move(at, self.aside)
        system.move(self.staging, at)
        if old:
            system.delete_dir(self.aside)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = place(self.path)
        if exists(system, self.staging):
            system.delete_dir(self.staging)


class NamedParquet(DataSource):
    """Options: path; texts (JSON: name to content of small files beside the rows'); listing (name of a file with a line per Parquet file)."""

    @classmethod
    def name(cls) -> str:
        return "named_parquet"

    def writer(self, schema: StructType, overwrite: bool) -> NamedParquetWriter:
        return NamedParquetWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedParquet)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
