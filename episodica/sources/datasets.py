"""Episode datasets: a Parquet file for each episode under its number, and the files that describe them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from episodica.operators.episodes import episode_ranges, number_frames
from episodica.sources.namedfiles import FILE, register

#: Fixed values of the format: folders hold so many episodes; names of the columns that a dataset has besides its features.
CHUNK = 1000
OWN = ["timestamp", "frame_index", "episode_index", "index", "task_index"]
DATA_PATH = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"


def feature(kind: DataType) -> dict[str, object]:
    """How info.json describes a column."""
    inner = kind.elementType if isinstance(kind, ArrayType) else kind
    names = {"double": "float64", "float": "float32", "bigint": "int64", "int": "int32", "boolean": "bool", "binary": "image"}
    return {"dtype": "struct" if isinstance(kind, StructType) else names.get(inner.simpleString(), inner.simpleString()), "shape": [None] if isinstance(kind, ArrayType) else [1]}


def task_numbers(frames: DataFrame, episode: str, task: str) -> DataFrame:
    """(task_index, task): tasks in order of the first episode that has them, then by name; null is no task. A row per task is numbered in one task."""
    first = frames.where(F.col(task).isNotNull()).groupBy(F.col(task).alias("task")).agg(F.min(episode).alias("first"))
    return first.select((F.row_number().over(Window.orderBy("first", "task")) - 1).cast("long").alias("task_index"), "task")


def write_dataset(frames: DataFrame, root: str, episode: str = "ep", order: str | list[str] = "j", task: str = "task", fps: int = 10, overwrite: bool = False) -> None:
    """Writes data/chunk-*/episode_*.parquet, exactly one file per episode, with meta/tasks.jsonl, meta/episodes.jsonl and meta/info.json.

    Frames get frame_index (place in the episode), index (place among all, by episode), timestamp (frame_index / fps), episode_index and
    task_index; other columns are features and stay. An existing root is refused unless overwritten. All of it is visible at once, or nothing: tasks write
    below a hidden folder, which is renamed at the end. Episode numbers must not be null or negative. An episode is one task's work, streamed, since it is one file.
    """
    spark = frames.sparkSession
    sort = [order] if isinstance(order, str) else list(order)
    features = [c for c in frames.columns if c not in (episode, task, *OWN)]
    listed = task_numbers(frames, episode, task)
    tasks = [(r["task_index"], r["task"]) for r in listed.orderBy("task_index").collect()]  # as many as the file has lines
    rows = number_frames(frames, episode, sort, "frame_index", "__n")
    rows = rows.withColumn("frame_index", F.col("frame_index").cast("long")).withColumn("episode_index", F.col(episode).cast("long"))
    sizes = frames.groupBy(F.col(episode).cast("long").alias("episode_index")).agg(F.count("*").alias("n"))
    totals = sizes.agg(F.count("*").alias("episodes"), F.sum("n").alias("frames"), F.min("episode_index").alias("least"), F.count_if(F.col("episode_index").isNull()).alias("none")).first()
    if totals["none"] or (totals["least"] or 0) < 0:
        raise ValueError("episode numbers must not be null or negative")
    rows = rows.join(episode_ranges(sizes, "episode_index").select("episode_index", "start"), "episode_index").withColumn("index", F.col("start") + F.col("frame_index"))
    rows = rows.join(listed.withColumnRenamed("task", "__task"), F.col(task) == F.col("__task"), "left").withColumn("timestamp", (F.col("frame_index") / fps).cast("float"))
    name = F.format_string("data/chunk-%03d/episode_%06d.parquet", F.floor(F.col("episode_index") / CHUNK), "episode_index")
    out = rows.select(name.alias(FILE), *features, *OWN).repartition(FILE).sortWithinPartitions(FILE, "frame_index")
    described = {c: feature(out.schema[c].dataType) for c in (*features, *OWN)}
    info = {"fps": fps, "total_episodes": totals["episodes"], "total_frames": totals["frames"] or 0, "total_tasks": len(tasks), "chunks_size": CHUNK, "data_path": DATA_PATH, "features": described}
    texts = {"meta/info.json": json.dumps(info, indent=2), "meta/tasks.jsonl": "".join(json.dumps({"task_index": i, "task": t}) + "\n" for i, t in tasks)}
    register(spark)
    out.write.format("named_parquet").mode("overwrite" if overwrite else "append").option("path", root).option("texts", json.dumps(texts)).option("listing", "meta/episodes.jsonl").save()
