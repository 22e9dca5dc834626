"""Scores of episodes: aggregation over iterations, bottom-k and percentile selection, weighted losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.operators.ranks import first_rows, percentiles


def mean_of_nonzero(scores: DataFrame, available: DataFrame | None = None, episode: str = "ep", score: str = "score", turn: str | None = None) -> DataFrame:
    """(episode, score): the mean over iterations, zeros left out; episodes that aren't available are ignored, NaN stays.

    With the column of the iteration's number, scores are summed in its order (an episode has a score per iteration), so that the mean's last bit doesn't depend on how rows are dealt.
    """
    known = scores.join(available.select(episode), episode, "left_semi") if available is not None else scores
    own = known.where(F.col(score) != 0).groupBy(episode)
    if turn is None:
        return own.agg(F.avg(score).alias(score))
    listed = own.agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(score).alias("score")))).alias("__listed"))
    total = F.aggregate("__listed", F.lit(0.0), lambda s, x: s + x["score"])
    return listed.select(episode, (total / F.size("__listed")).alias(score))


def bottom_k(scores: DataFrame, share: float, n_available: int, episode: str = "ep", score: str = "score") -> DataFrame:
    """The k episodes of least score, k = max(1, int(n_available * share)) and never more than are scored; ties by id, NaN last."""
    if not 0 < share <= 1:
        raise ValueError("the share must lie in (0, 1]")
    return first_rows(scores, [score, episode], max(1, int(n_available * share)))


def percentile_select(scores: DataFrame, existing: DataFrame, low: float = 20, high: float = 80, episode: str = "ep", score: str = "score") -> DataFrame:
    """Existing episodes, plus candidates at or below the low percentile, without those at or above the high one.

    Percentiles are interpolated over the scores that aren't zero; if all are zero, the existing ones stay as they are. Zeros are
    compared as well, and existing episodes without a score stay. The two percentiles are found exactly, without sorting the scores.
    """
    edges = percentiles(scores.where(F.col(score) != 0), score, [low / 100, high / 100])
    if edges is None:
        return existing.select(episode).distinct()
    merged = scores.select(episode, score).join(existing.select(episode).distinct().withColumn("__old", F.lit(True)), episode, "full_outer")
    old = F.coalesce("__old", F.lit(False))
    joins = F.col(score).isNotNull() & (F.col(score) <= edges[0])
    leaves = F.col(score).isNotNull() & (F.col(score) >= edges[1])
    return merged.where(joins | (old & ~leaves)).select(episode)


def dense(scores: DataFrame, size: int, episode: str = "ep", score: str = "score") -> DataFrame:
    """A row for every id below size, 0 where nothing is scored."""
    ids = scores.sparkSession.range(size).withColumnRenamed("id", episode)
    return ids.join(scores.select(F.col(episode).cast("long").alias(episode), score), episode, "left").select(episode, F.coalesce(score, F.lit(0.0)).alias(score))


def include_index(listed: DataFrame, available: DataFrame, key: str = "ep") -> DataFrame:
    """Listed ids that are available, in their order and with repeats."""
    return listed.join(available.select(key), key, "left_semi")


def episode_weight(episode: Column, selected: Column, candidate: Column, w_selected: Column, w_candidate: Column, prefer_candidate: bool) -> Column:
    """1 for unlabelled rows (negative ids); else by membership, of which the candidates' comes first if preferred; else 0."""
    order = [(candidate, w_candidate), (selected, w_selected)]
    if not prefer_candidate:
        order.reverse()
    case = F.when(episode < 0, 1.0)
    for test, w in order:
        case = case.when(test, w)
    return case.otherwise(0.0)


def weighted_loss(rows: DataFrame, loss: str = "loss", weight: str = "weight") -> DataFrame:
    """The mean of loss * weight over all rows, not over the sum of weights."""
    return rows.agg(F.avg(F.col(loss) * F.col(weight)).alias("loss"), F.count("*").alias("rows"))


def batch_weighted_loss(batch_means: DataFrame, mean: str = "mean", rows: str = "rows") -> DataFrame:
    """The mean over all rows from (mean, rows) of batches: each counts by its size, so an incomplete batch doesn't count more."""
    return batch_means.agg((F.sum(F.col(mean) * F.col(rows)) / F.sum(rows)).alias("loss"), F.sum(rows).alias("rows"))


def score_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    s = F.col(score)
    return scores.agg(F.count(s).alias("scored"), F.count_if(s != 0).alias("nonzero"), F.min(s).alias("least"), F.max(s).alias("most"), F.avg(s).alias("mean"), F.coalesce(F.max(F.abs(s)) == 0, F.lit(True)).alias("all_zero"))


def iteration_order(names: DataFrame, name: str = "name") -> DataFrame:
    """Numbered iterations in the order of the number that ends their name."""
    from episodica.functions.text import trailing_number

    return names.withColumn("turn", F.row_number().over(Window.orderBy(trailing_number(F.col(name)), name)))


def bitmap_index(ids: DataFrame, key: str = "ep") -> DataFrame:
    """(bucket, bitmap): ids as bits, 32,768 to a bucket of 4 kB at most; a billion dense ids are 122 MB. Null ids are left out, repeats are one bit."""
    own = ids.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"))
    return own.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap"))


def in_bitmap(rows: DataFrame, index: DataFrame, key: str = "ep") -> DataFrame:
    """Rows whose id is in the index: they meet its buckets, and the id's bit decides. A null id is in none."""
    place = F.bitmap_bit_position(F.col(key).cast("long"))
    byte = F.conv(F.hex(F.substring("__bitmap", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), place % 8)), F.lit(2)) == 1
    own = index.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap"))
    return rows.join(own, F.bitmap_bucket_number(F.col(key).cast("long")) == F.col("__bucket")).where(bit).drop("__bucket", "__bitmap")
