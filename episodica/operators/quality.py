"""Damaged cells: reports, early stops and repair from the nearest valid neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def damage_report(frames: DataFrame, bad: str = "bad", episode: str = "ep", index: str = "j", stop_early: bool = False, *keys: str) -> DataFrame:
    """Checked frames, failures, and episodes with any. With stop_early an episode is only read up to its first failure."""
    rows = frames
    if stop_early:
        first = F.min(F.when(F.col(bad), F.col(index))).over(Window.partitionBy(episode))
        rows = frames.withColumn("__first", first).where(F.col("__first").isNull() | (F.col(index) <= F.col("__first")))
    return rows.groupBy(*keys).agg(F.count("*").alias("checked"), F.count_if(bad).alias("failures"), F.count_distinct(F.when(F.col(bad), F.col(episode))).alias("bad_episodes"))


def damage_by_column(frames: DataFrame, states: dict[str, Column], episode: str = "ep") -> DataFrame:
    """(column, state, frames, episodes): how many frames of how many episodes have each state, for every column that a state is given for; null counts as missing."""
    cells = F.explode(F.array(*(F.struct(F.lit(name).alias("column"), F.coalesce(state.cast("string"), F.lit("missing")).alias("state")) for name, state in states.items())))
    rows = frames.select(F.col(episode).alias("__ep"), cells.alias("c")).groupBy("c.column", "c.state", "__ep").agg(F.count("*").alias("n"))
    return rows.groupBy("column", "state").agg(F.sum("n").alias("frames"), F.count("*").alias("episodes"))


def nearest_valid(frames: DataFrame, value: str = "v", bad: str = "bad", episode: str = "ep", index: str = "j") -> DataFrame:
    """For each damaged frame: (episode, index, source index, its value), from the nearest valid frame; the left one wins ties.

    Two running aggregates over one sort. An episode without a valid frame gives null sources.
    """
    good = F.when(~F.col(bad), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    order = Window.partitionBy(episode).orderBy(index)
    left = F.last(good, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(good, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    sided = frames.withColumn("__l", left).withColumn("__r", right).where(bad)
    near = F.when(F.col("__l").isNull() | (F.col("__r")["i"] - F.col(index) < F.col(index) - F.col("__l")["i"]), F.col("__r")).otherwise(F.col("__l"))
    return sided.select(episode, index, near["i"].alias("source"), near["v"].alias(value))


def repair(frames: DataFrame, value: str = "v", bad: str = "bad", episode: str = "ep", index: str = "j") -> DataFrame:
    """All frames with damaged values replaced; an episode without a valid frame is an error when its rows are computed."""
    fixes = nearest_valid(frames, value, bad, episode, index).withColumnRenamed(value, "__fix")
    joined = frames.join(fixes, [episode, index], "left")
    none = F.raise_error(F.concat(F.lit("no valid frame in episode "), F.col(episode).cast("string")))
    return joined.withColumn(value, F.when(F.col(bad), F.when(F.col("source").isNull(), none.cast(frames.schema[value].dataType)).otherwise(F.col("__fix"))).otherwise(F.col(value))).drop("__fix")


def bad_episodes(report: DataFrame, root: str) -> DataFrame:
    """Distinct bad episodes that a report lists for a root: reports is an array of (root, bad_episode_indices)."""
    one = report.select(F.explode("reports").alias("r")).where(F.col("r.root") == root)
    return one.select(F.explode("r.bad_episode_indices").alias("ep")).distinct()
