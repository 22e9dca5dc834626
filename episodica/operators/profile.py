"""Profiles of vector columns: moments, range, histogram quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.operators.episodes import id_part
from episodica.operators.ranks import running_total
from episodica.operators.sampling import prefix_sample

BINS = 5000


def moments(values: DataFrame, *keys: str, value: str = "x", weight: str | None = None) -> DataFrame:
    """Per key: rows, mean, population std as sqrt(E[x^2] - E[x]^2), min, max; with a weight a row counts that often.

    A null is no value: it counts in nothing, rows included, and a key of nulls alone has no row. NaN is a value, and makes mean and std NaN.
    """
    x, w = F.col(value).cast("double"), F.col(weight) if weight else F.lit(1)
    rows = values.where(x.isNotNull() & (w > 0)).groupBy(*keys).agg(F.sum(w).alias("rows"), F.sum(w * x).alias("s"), F.sum(w * x * x).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    mean = F.col("s") / F.col("rows")
    return rows.select(*keys, "rows", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("rows") - mean * mean)).alias("std"), "lo", "hi")


def vector_moments(values: DataFrame, vector: str, width: int) -> DataFrame:
    """One row with arrays mean and std over the first `width` components: one aggregate, nothing exploded."""
    x = [F.get(vector, F.lit(i)).cast("double") for i in range(width)]
    sums = values.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.avg(c * c).alias(f"q{i}") for i, c in enumerate(x)))
    stds = [F.sqrt(F.greatest(F.lit(0.0), F.col(f"q{i}") - F.col(f"m{i}") * F.col(f"m{i}"))) for i in range(width)]
    return sums.select(F.array(*(F.col(f"m{i}") for i in range(width))).alias("mean"), F.array(*stds).alias("std"))


def histogram_quantiles(values: DataFrame, *keys: str, probabilities: tuple[float, ...] = (0.01, 0.99), value: str = "x", weight: str | None = None, bins: int = BINS) -> DataFrame:
    """(keys, p, quantile): the left edge of the first bin at which the cumulative count reaches p of all rows.

    Two aggregates: the range, then counts of equal bins (bins rows per key at most), so no value is sorted. A constant is its own quantile. Nulls and NaN
    have no place among values and are left out, of all rows too.
    """
    x = F.col(value).cast("double")
    values = values.where(x.isNotNull() & ~F.isnan(x))
    ranges = moments(values, *keys, value=value, weight=weight).select(*keys, "rows", "lo", "hi")
    rows = values.join(ranges, list(keys)) if keys else values.crossJoin(F.broadcast(ranges))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value).cast("double") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    w = F.col(weight) if weight else F.lit(1)
    counted = rows.where(w > 0).groupBy(*keys, place.alias("bin"), "rows", "lo", "hi").agg(F.sum(w).alias("c"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counted.withColumn("upto", F.sum("c").over(upto)).withColumn("p", F.explode(F.array(*map(F.lit, probabilities)))).where(F.col("upto") >= F.col("p") * F.col("rows"))
    first = reached.groupBy(*keys, "p", "lo", "hi").agg(F.min("bin").alias("bin"))
    return first.select(*keys, "p", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("quantile"))


def exact_quantiles(values: DataFrame, *keys: str, probabilities: tuple[float, ...] = (0.01, 0.99), value: str = "x", bins: int = BINS) -> DataFrame:
    """(keys, p, quantile) with linear interpolation between ranks, as an exact companion of histogram_quantiles; null values and keys are left out.

    Counts of equal bins tell which bins hold the ranks asked for, and only distinct values of those bins are ranked, so no task holds a key.
    """
    rows = values.select(*keys, F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    ranges = rows.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    placed = rows.join(ranges, list(keys)) if keys else rows.crossJoin(F.broadcast(ranges))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = placed.groupBy(*keys, place.alias("bin"), "x", "n").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = counted.groupBy(*keys, "bin", "n").agg(F.sum("c").alias("c")).withColumn("upto", F.sum("c").over(upto))
    spots = held.withColumn("p", F.explode(F.array(*map(F.lit, probabilities)))).withColumn("spot", (F.col("n") - 1) * F.col("p"))
    ranks = spots.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("spot"), F.ceil("spot"))))).where((F.col("rank") >= F.col("upto") - F.col("c")) & (F.col("rank") < F.col("upto")))
    wanted = ranks.select(*keys, "bin", "p", (F.col("spot") - F.floor("spot")).alias("part"), (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))
    own = counted.select(*keys, "bin", "x", "c").join(wanted.select(*keys, "bin").distinct(), [*keys, "bin"], "left_semi")
    own = own.withColumn("within", F.sum("c").over(Window.partitionBy(*keys, "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hit = own.join(wanted, [*keys, "bin"]).where((F.col("rank") >= F.col("within") - F.col("c")) & (F.col("rank") < F.col("within")))
    ends = hit.groupBy(*keys, "p").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("part").alias("part"))
    return ends.select(*keys, "p", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") * (1 - F.col("part")) + F.col("hi") * F.col("part")).alias("quantile"))


def sampled_frames(frames: DataFrame, episodes: int, seed: int, most: int | None = None, source: str = "source", episode: str = "ep", index: str = "j") -> DataFrame:
    """The frames that statistics of a sample read: those of randomly chosen episodes over all sources, and of these the first `most` in order of
    source, episode and place. Where an episode begins comes from running totals of lengths, so frames are not sorted.
    """
    if episodes <= 0:
        raise ValueError("the number of episodes must be positive")
    counts = frames.groupBy(source, episode).agg(F.count("*").alias("__n"))
    chosen = prefix_sample(counts.withColumn("__key", F.concat_ws("/", source, episode)), "__key", episodes, seed).drop("__key")
    if most is None:
        return frames.join(chosen.select(source, episode), [source, episode], "left_semi")
    part = F.struct(F.col(source), id_part(chosen, episode))
    starts = running_total(chosen, part, F.struct(source, episode), "__n", "__end").select(source, episode, (F.col("__end") - F.col("__n")).alias("__start"))
    return frames.join(starts, [source, episode]).where(F.col("__start") + F.col(index) < most).drop("__start")


def component_rows(frames: DataFrame, vector: str, *keep: str) -> DataFrame:
    """(keep, dim, x): a row per component of a vector column."""
    return frames.select(*keep, F.posexplode(vector).alias("dim", "x"))
