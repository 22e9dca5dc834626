"""A log of metrics that a stream appends to exactly once: JSON lines in parts, and an entry per batch that says which parts count.

parts/ has a file per task that had rows, under a name that no other attempt takes; batches/ has an entry per committed batch. An entry gets its name
in one step when it is whole, and the parts that it names were whole before. A batch that ends between its parts and its entry leaves parts
that nothing names; one that is run again after its entry was there adds nothing.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from episodica.sources.namedfiles import exists, place

ENTRY = "stream string, batch long, parts array<struct<name: string, rows: long>>"


@dataclass
class MetricPart(WriterCommitMessage):
    name: str = ""
    rows: int = 0


class MetricWriter(DataSourceStreamWriter):
    """Rows are one column of lines. Options: path, and stream, which names the stream: numbers of batches are its own."""

    def __init__(self, options: dict[str, str], schema: StructType):
        if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("metric lines are one column of texts")
        self.path, self.stream = options["path"], options["stream"]

    def write(self, iterator: Iterator[Row]) -> MetricPart:
        system, at = place(self.path)
        part, out = MetricPart(), None
        for row in iterator:
            if out is None:
                part.name = f"{uuid.uuid4().hex}.jsonl"
                system.create_dir(f"{at}/parts", recursive=True)
                out = system.open_output_stream(f"{at}/parts/{part.name}")
            out.write((row[0] + "\n").encode())
            part.rows += 1
        if out is not None:
            out.close()
        return part

    def _drop(self, messages: list[MetricPart | None]) -> None:
        system, at = place(self.path)
        for message in messages:
            if message and message.name and exists(system, f"{at}/parts/{message.name}"):
                system.delete_file(f"{at}/parts/{message.name}")

    def commit(self, messages: list[MetricPart | None], batchId: int) -> None:
        system, at = place(self.path)
        entry = f"{at}/batches/{self.stream}-{batchId:012d}.json"
        if exists(system, entry):
            self._drop(messages)
            return
        system.create_dir(f"{at}/batches", recursive=True)
        parts = [{"name": m.name, "rows": m.rows} for m in messages if m and m.name]
        temporary = f"{at}/batches/.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(temporary) as out:
            out.write(json.dumps({"stream": self.stream, "batch": batchId, "parts": parts}).encode())
        system.move(temporary, entry)

    def abort(self, messages: list[MetricPart | None], batchId: int) -> None:
        system, at = place(self.path)
        if not exists(system, f"{at}/batches/{self.stream}-{batchId:012d}.json"):  # what is committed stays, whatever failed later
            self._drop(messages)


class MetricLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "metric_log"

    def streamWriter(self, schema: StructType, overwrite: bool) -> MetricWriter:
        return MetricWriter(dict(self.options), schema)


def stream_name(checkpoint: str) -> str:
    """The name of the stream that a checkpoint folder belongs to: made on its first start and kept there, so a new checkpoint is a new stream."""
    system, at = place(checkpoint)
    kept = f"{at}/metric_stream"
    if not exists(system, kept):
        system.create_dir(at, recursive=True)
        temporary = f"{at}/.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(temporary) as out:
            out.write(uuid.uuid4().hex.encode())
        system.move(temporary, kept)
    with system.open_input_stream(kept) as f:
        return f.read().decode()


def log_metrics(stream: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts appending a stream's rows to a log; with `once` it ends when what is there now has been read. One query runs per checkpoint at a time."""
    stream.sparkSession.dataSource.register(MetricLog)
    lines = stream.select(F.to_json(F.struct("*")).alias("line"))
    writer = lines.writeStream.format("metric_log").option("path", folder).option("stream", stream_name(checkpoint)).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def committed_parts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, rows, stream, batch) of the parts that count."""
    system, at = place(folder)
    if not exists(system, f"{at}/batches"):
        return spark.createDataFrame([], "name string, rows long, stream string, batch long")
    entries = spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").json(f"{folder}/batches")
    return entries.select(F.explode("parts").alias("part"), "stream", "batch").select("part.name", "part.rows", "stream", "batch")


def read_metrics(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The rows of a log with the columns of schema; lines of parts that no entry names are left out by a join on file names. A log without any is empty."""
    system, at = place(folder)
    if not exists(system, f"{at}/parts"):
        return spark.createDataFrame([], schema)
    lines = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(f"{folder}/parts")
    names = committed_parts(spark, folder).select(F.col("name").alias("__part"))
    return lines.withColumn("__part", F.col("_metadata.file_name")).join(names, "__part", "left_semi").drop("__part")


def vacuum_metrics(spark: SparkSession, folder: str) -> int:
    """Deletes parts that no entry names, and returns how many; not while a query writes, whose batch has no entry yet."""
    system, at = place(folder)
    if not exists(system, f"{at}/parts"):
        return 0
    named = {r["name"] for r in committed_parts(spark, folder).select("name").toLocalIterator()}
    lost = [f for f in system.get_file_info(pafs.FileSelector(f"{at}/parts")) if f.base_name not in named]
    for f in lost:
        system.delete_file(f.path)
    return len(lost)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
