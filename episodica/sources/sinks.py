"""Small files for results, and episode tables that are never half written."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.sources.files import COMPACT, DENSE
from episodica.sources.npy import write_npy


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _replace(spark: SparkSession, temporary, final) -> None:
    """Renames a file over another one in one step, so that at any moment either the old or the new one is there."""
    fs = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(final.toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(temporary, final, options)


def rename_new(spark: SparkSession, source: str, target: str) -> None:
    """Gives a file or folder a name, which must be free, in one step."""
    jvm = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.NONE
    fs, at = _files(spark, source)
    jvm.FileContext.getFileContext(fs.makeQualified(at).toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(at, jvm.Path(target), options)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A JSON file on any file system: written under a temporary name, then renamed."""
    fs, final = _files(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(value, indent=2, default=str).encode()))
    out.close()
    _replace(spark, temporary, final)


def save_include_index(selected: DataFrame, path: str, episode: str = "ep", **more: object) -> list[int]:
    """The selected ids, sorted, as {version, unit, episode_indices} and further fields; a row per episode reaches the driver."""
    ids = sorted(r[0] for r in selected.select(episode).collect())
    write_json(selected.sparkSession, path, {"version": 2, "unit": "episode", "episode_indices": ids} | more)
    return ids


def save_statistics(statistics: DataFrame, path: str) -> None:
    """(key, dim, mean, std, q01, q99) as nested JSON."""
    data: dict[str, dict[str, list[float]]] = {}
    for r in statistics.orderBy("key", "dim").collect():
        own = data.setdefault(r["key"], {"mean": [], "std": [], "q01": [], "q99": []})
        for name in own:
            own[name].append(r[name])
    write_json(statistics.sparkSession, path, {"norm_stats": data})


def save_scores(scores: DataFrame, path: str, episode: str = "ep", score: str = "score") -> None:
    """(episode, score) sorted by episode, as Parquet."""
    scores.select(F.col(episode).cast("long").alias(episode), F.col(score).cast("double").alias(score)).orderBy(episode).write.mode("overwrite").parquet(path)


def save_score_arrays(scores: DataFrame, folder: str, episodes: int, episode: str = "ep", score: str = "score", settings: dict[str, object] | None = None) -> None:
    """(episode, score) as a dense vector and as the pairs that are not zero, in the files that load_scores reads; given settings are config.json beside them.

    Null scores count as zero, repeated episodes and ones outside 0..episodes-1 are an error. Tasks write ranges of episodes, which the commit
    joins without holding them; a file takes its name when it is whole.
    """
    present = scores.select(F.col(episode).cast("long").alias("ep"), F.col(score).cast("double").alias("score")).where("score <> 0")
    write_npy(present, f"{folder}/{DENSE}", "ep", "score", episodes)
    write_npy(present, f"{folder}/{COMPACT}", "ep", "score")
    if settings is not None:
        write_json(scores.sparkSession, f"{folder}/config.json", settings)


def save_split(episodes: DataFrame, path: str, episode: str = "ep", task: str = "task", **more: object) -> dict[str, object]:
    """A split file: the include index's fields with the number of episodes and how many each task has; a row per episode reaches the driver."""
    rows = sorted((r[0], r[1]) for r in episodes.select(episode, F.coalesce(F.col(task).cast("string"), F.lit(""))).distinct().collect())
    counts: dict[str, int] = {}
    for _, name in rows:
        counts[name] = counts.get(name, 0) + 1
    value = {"version": 2, "unit": "episode", "num_episodes": len(rows), "episodes_per_task": dict(sorted(counts.items())), "episode_indices": [e for e, _ in rows]} | more
    write_json(episodes.sparkSession, path, value)
    return value


def write_episodes(frames: DataFrame, root: str, episode: str = "ep", order: str = "j", overwrite: bool = False) -> None:
    """One folder per episode below root/data, rows in order; an existing root is refused unless overwritten."""
    sorted_frames = frames.repartition(episode).sortWithinPartitions(episode, order)
    sorted_frames.write.partitionBy(episode).mode("overwrite" if overwrite else "errorifexists").parquet(f"{root}/data")


def rewrite(df: DataFrame, path: str, backup: str | None = None, apply: bool = False) -> int:
    """Replaces a Parquet table by df, which may read it: written beside it, then renamed; a backup is made once. Without apply only counts.

    The old table is moved aside before the new one takes its name and deleted last, so a crash never leaves less than one whole table.
    """
    rows = df.count()
    if not apply:
        return rows
    spark = df.sparkSession
    fs, at = _files(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.parquet(temporary)
    keep = backup is not None and not fs.exists(path_of(backup))
    aside = path_of(backup if keep else f"{temporary}.old")
    if not fs.rename(at, aside):
        raise OSError(f"cannot move {path} aside; {temporary} has the new rows")
    if not fs.rename(path_of(temporary), at):
        fs.rename(aside, at)
        raise OSError(f"cannot rename {temporary} to {path}")
    if not keep:
        fs.delete(aside, True)
    return rows
