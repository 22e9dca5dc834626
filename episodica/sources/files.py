"""Episode files, task lists, index files, statistics and score files."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.functions.text import episode_number, natural_key
from episodica.operators.episodes import episode_ranges
from episodica.sources.npy import read_npy


#: Names of score files.
DENSE, COMPACT = "datamodels.npy", "candidate_scores_compact.npy"
#: The name that save_score_arrays does not write, but that dense vectors may have as well.
DENSE_TOO = "scores.npy"


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of any Spark file system."""
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def read_frames(spark: SparkSession, root: str) -> DataFrame:
    """All Parquet files below root/data, with file (path), file_index (place in the file) and no decoded cell."""
    frames = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data")
    frames = frames.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("file_index"))
    return frames.withColumn("file_rows", F.count(F.lit(1)).over(Window.partitionBy("file")))


def discover_episodes(spark: SparkSession, root: str) -> DataFrame:
    """(file, n, position, ep, start, end): one row per file in natural order of paths; only row counts are read.

    Two files of one episode number are an error, and so is a root without files.
    """
    files = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    ranges = episode_ranges(files.withColumn("key", natural_key(F.col("file"))), "key")
    placed = ranges.withColumn("position", F.row_number().over(Window.orderBy("key")).cast("long") - 1)
    episodes = placed.withColumn("ep", episode_number(F.col("file"), F.col("position"))).drop("key")
    repeated = episodes.groupBy("ep").count().where("count > 1").limit(10).collect()
    if repeated:
        raise ValueError(f"episode numbers in more than one file: {sorted(r['ep'] for r in repeated)}")
    return episodes


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(task_index, task) from JSON lines; of repeated ids the last line holds. Names of either field may differ."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).where("trim(value) <> ''")

    entries = F.from_json("value", "map<string,string>")

    def field(*names: str) -> Column:
        """The first of the names that the line has, null or not."""
        found = F.lit(None).cast("string")
        for n in reversed(names):
            found = F.when(F.map_contains_key(entries, F.lit(n)), entries[n]).otherwise(found)
        return found

    rows = lines.select("line", field("task_index", "task_id", "index").cast("long").alias("task_index"), field("task", "name", "prompt").alias("task"))
    return rows.groupBy("task_index").agg(F.max_by("task", "line").alias("task"))


def load_fps(spark: SparkSession, path: str, default: int = 10) -> int:
    """Frames per second from meta/info.json, or the default where there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        return int(json.loads(read_text(spark, path)).get("fps", default))
    except AnalysisException:
        return default


def load_include_index(spark: SparkSession, path: str) -> DataFrame | None:
    """(pos, ep) in file order with repeats, from JSON or a vector in .npy; None when the file names no list, which stands for everything."""
    if path.endswith(".npy"):
        return read_npy(spark, [path]).select(F.col("i").alias("pos"), F.col("value").cast("long").alias("ep"))
    data = json.loads(read_text(spark, path))
    listed = next((data[k] for k in ("episode_indices", "sample_indices", "indices") if k in data), None)
    return None if listed is None else spark.createDataFrame(list(enumerate(map(int, listed))), "pos long, ep long")


def load_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(key, dim, mean, std, q01, q99) from nested JSON; quantiles may be missing."""
    data = json.loads(read_text(spark, path))
    data = data.get("norm_stats", data)
    rows = []
    for key, own in sorted(data.items()):
        for dim, (mean, std) in enumerate(zip(own["mean"], own["std"], strict=True)):
            rows.append((key, dim, float(mean), float(std), *(float(own[q][dim]) if own.get(q) else None for q in ("q01", "q99"))))
    return spark.createDataFrame(rows, "key string, dim int, mean double, std double, q01 double, q99 double")


def _known_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, sorted; none is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at)
    return sorted(f.getPath().toString() for f in found or [])


def _settings(spark: SparkSession, path: str, *keys: str) -> object:
    """What a JSON file holds under nested keys; None where the file or a key is missing."""
    value = json.loads(read_text(spark, path)) if _known_files(spark, path) else None
    for key in keys:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _statistics_places(spark: SparkSession, checkpoint: str) -> Iterator[tuple[str, list[str]]]:
    """Places where a checkpoint may keep its statistics, the first that has any decides: (description, files there)."""
    named = _settings(spark, f"{checkpoint}/norm_stats_info.json", "checkpoint_relative_path")
    yield "what norm_stats_info.json names", _known_files(spark, f"{checkpoint}/{named}") if named else []
    yield "assets/*/norm_stats.json", _known_files(spark, f"{checkpoint}/assets/*/norm_stats.json")


def find_statistics(spark: SparkSession, checkpoint: str, explicit: str | None = None) -> str:
    """The statistics file of a checkpoint. An explicit path is taken as it is; otherwise the first place with files decides, and must hold one."""
    if explicit:
        return explicit
    looked = []
    for description, found in _statistics_places(spark, checkpoint):
        if len(found) > 1:
            raise ValueError(f"{description} of {checkpoint} is ambiguous, name one of {found}")
        if found:
            return found[0]
        looked.append(description)
    raise FileNotFoundError(f"{checkpoint} has no statistics; looked at {', '.join(looked)}")


def load_model_config(spark: SparkSession, checkpoint: str, known: tuple[str, ...], **changes: object) -> tuple[dict[str, object], list[bool] | None]:
    """(fields, mask): the known fields of the model's settings in metadata.json with changes that aren't None, and which actions are normalised."""
    stored, mask = (_settings(spark, f"{checkpoint}/metadata.json", "config", *keys) for keys in (("model",), ("data", "action_normalization_mask")))
    fields = {name: (stored or {})[name] for name in known if name in (stored or {})}
    fields.update((name, value) for name, value in changes.items() if value is not None)
    return fields, mask and [bool(m) for m in mask]


def load_scores(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(iter, ep, score) from .npy files of iteration folders: compact pairs if present, else dense vectors without their zeros. A folder with neither is an error.

    Files are read by ranges of rows in tasks; all of one form are one scan. The driver holds a path and a header for each.
    """
    chosen: dict[bool, list[tuple[int, str]]] = {True: [], False: []}
    for turn, folder in enumerate(folders):
        found = next((f for name in (COMPACT, DENSE, DENSE_TOO) for f in _known_files(spark, f"{folder}/{name}")), None)
        if found is None:
            raise FileNotFoundError(f"{folder} has neither {COMPACT} nor {DENSE}")
        chosen[found.endswith(COMPACT)].append((turn, found))
    out = None
    for compact, listed in chosen.items():
        if listed:
            turn = F.element_at(F.array(*(F.lit(t) for t, _ in listed)), F.col("file") + 1).alias("iter")
            rows = read_npy(spark, [path for _, path in listed])
            rows = rows.select(turn, F.col("c0").cast("long").alias("ep"), F.col("c1").cast("double").alias("score")) if compact else rows.where("value <> 0").select(turn, F.col("i").alias("ep"), F.col("value").cast("double").alias("score"))
            out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "iter int, ep long, score double") if out is None else out


def image_kind(column: Column) -> Column:
    """png, jpeg or none, by the first bytes of an encoded picture: a check of structure, not of pixels."""
    head = F.hex(F.substring(column, 1, 8))
    return F.when(head == "89504E470D0A1A0A", "png").when(F.substring(head, 1, 6) == "FFD8FF", "jpeg").otherwise("none")
