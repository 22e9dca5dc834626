"""Frames, episodes, tasks and fixed-horizon action chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.operators.ranks import running_total

#: Ids of an episode range that share a part of a running total.
IDS = 1 << 16


def first_column(df: DataFrame, *names: str) -> str:
    """The first of the names that the table has; an error lists what it has."""
    for name in names:
        if name in df.columns:
            return name
    raise KeyError(f"none of {', '.join(names)} among the columns {', '.join(df.columns)}")


def number_frames(rows: DataFrame, episode: str, order: list[str | Column], index: str = "j", count: str = "n") -> DataFrame:
    """Adds each row's place in its episode, from 0, and the episode's length; one sort and one exchange serve both."""
    within = Window.partitionBy(episode)
    return rows.withColumn(index, F.row_number().over(within.orderBy(*order)) - 1).withColumn(count, F.count(F.lit(1)).over(within))


def id_part(rows: DataFrame, key: str) -> Column:
    """A coarser form of an id for running totals; ids that aren't integers are one part."""
    return F.floor(F.col(key) / IDS) if dict(rows.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") else F.lit(0)


def episode_ranges(counts: DataFrame, order: Column | str, n: str = "n", part: Column | None = None) -> DataFrame:
    """Running [start, end) of files or episodes in the given order.

    Integer ids are summed up in parts of 65,536 ids, other orders in the given parts (a coarser form of the order); without one, a single
    task sorts a row per file.
    """
    if part is None:
        part = id_part(counts, order) if isinstance(order, str) else F.lit(0)
    return running_total(counts, part, order, n, "end").withColumn("start", F.col("end") - F.col(n))


def locate_frames(indices: DataFrame, ranges: DataFrame, index: str = "i", width: int = 1 << 16) -> DataFrame:
    """Joins global row numbers to the episode whose [start, end) holds them.

    A range join as an equi-join: ranges are cut at multiples of `width`, so both sides are hashed by that block and nothing is compared with every range.
    """
    cut = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    keyed = indices.withColumn("block", F.floor(F.col(index) / width))
    return keyed.join(cut, "block").where((F.col(index) >= F.col("start")) & (F.col(index) < F.col("end"))).drop("block")


def first_frame(frames: DataFrame, episode: str, value: str, index: str = "j") -> DataFrame:
    """(episode, value of its first frame)."""
    return frames.groupBy(episode).agg(F.min_by(value, index).alias(value))


def with_task_text(frames: DataFrame, tasks: DataFrame, key: str = "task_index", text: str = "task", default: str | None = "") -> DataFrame:
    """Left lookup of the task text with a default (None: an unknown task is an error when its row is computed); the planner broadcasts tasks when it knows them small."""
    missing = F.raise_error(F.concat(F.lit("no text of task "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("string") if default is None else F.lit(default)
    return frames.join(tasks.select(key, text), key, "left").withColumn(text, F.coalesce(F.col(text), missing))


def matches_task(prompt: Column, tasks: list[str] | None = None, contains: str | None = None, regex: str | None = None) -> Column:
    """All given tests: in the list, a part of the lower-cased text, a regex found anywhere."""
    test = F.lit(True)
    if tasks:
        test = test & prompt.isin(tasks)
    if contains:
        test = test & F.lower(prompt).contains(contains.lower())
    if regex:
        test = test & prompt.rlike(regex)
    return test


def chunks(frames: DataFrame, value: str, horizon: int, episode: str = "ep", index: str = "j", out: str = "chunk") -> DataFrame:
    """Adds the values of the next `horizon` frames; past the episode's end the last one repeats. A null value keeps its place, and repeats like others."""
    ahead = Window.partitionBy(episode).orderBy(index).rowsBetween(Window.currentRow, horizon - 1)
    own = F.transform(F.collect_list(F.struct(F.col(value).alias("v"))).over(ahead), lambda s: s["v"])  # a list of structs keeps nulls
    return frames.withColumn(out, own).withColumn(out, F.concat(out, F.array_repeat(F.element_at(out, -1), horizon - F.size(out))))


def valid_starts(frames: DataFrame, horizon: int, index: str = "j", count: str = "n") -> DataFrame:
    """Frames whose chunk lies within the episode; shorter episodes vanish."""
    return frames.where(F.col(index) <= F.col(count) - horizon)


def frames_in_order(frames: DataFrame, listed: DataFrame, episode: str = "ep", index: str = "j", position: str = "pos") -> DataFrame:
    """(position, and the frames) of listed episodes, once for each time an episode is listed; order by position and index. Unknown ones are an error."""
    require_known(listed.select(episode), frames.select(episode), episode)
    return listed.select(position, episode).join(frames, episode)


def labelled_subset(frames: DataFrame, wanted: DataFrame, key: str, episode: str = "ep", labelled: bool = True) -> DataFrame:
    """Frames whose key is wanted, labelled with their episode, or with -1 where labels don't apply."""
    return frames.join(wanted.select(key), key, "left_semi").withColumn("label", (F.col(episode) if labelled else F.lit(-1)).cast("long"))


def chunk_weight(horizon: int, index: str = "j", count: str = "n") -> Column:
    """In how many valid chunks a frame lies; aggregates weighted by it equal those over exploded chunks with horizon times fewer rows."""
    return F.greatest(F.lit(0), F.least(F.col(index), F.col(count) - horizon) - F.greatest(F.lit(0), F.col(index) - (horizon - 1)) + 1)


def visible_positions(rows: DataFrame, starts: str = "starts", valid: str = "valid", episode: str = "ep", index: str = "j") -> DataFrame:
    """(episode, index, visible) for every valid row: how many valid ones its attention mask lets it see, those whose running block number is not larger.

    Block numbers never fall along an episode, so a running count in their order does without a join of all pairs.
    """
    within = Window.partitionBy(episode)
    run = rows.withColumn("__block", F.sum(F.col(starts).cast("long")).over(within.orderBy(index)))
    upto = within.orderBy("__block").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = run.withColumn("visible", F.sum(F.col(valid).cast("long")).over(upto)).where(valid)
    return counted.select(episode, F.col(index).cast("long").alias(index), "visible")


def require_known(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows of ids, in an error-checked way: unknown ids raise with the first ten."""
    missing = [r[0] for r in ids.select(key).distinct().join(known, key, "left_anti").orderBy(key).limit(10).collect()]
    if missing:
        raise ValueError(f"unknown {key}: {missing}")
    return ids
