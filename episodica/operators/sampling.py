"""Samples that depend on a seed and ids alone; every limit here is the operator's meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions.hashing import draw_key, uniform
from episodica.functions.permutation import place_of, row_at
from episodica.operators.episodes import id_part
from episodica.operators.ranks import AT_ONCE, first_rows, running_total
from episodica.plans.scratch import written_once


def stratified(rows: DataFrame, stratum: str, key: str, k: int, seed: int) -> DataFrame:
    """min(k, size) rows of each stratum without replacement."""
    if k <= 0:
        raise ValueError("k must be positive")
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(draw_key(seed, key), key))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def prefix_sample(rows: DataFrame, key: str, n: int, seed: int, at_once: int = AT_ONCE) -> DataFrame:
    """n rows in one fixed random order, so a larger sample extends a smaller one: a top-n, or for many a filter by the digest at the last place."""
    if n <= at_once:
        return rows.orderBy(draw_key(seed, key), key).limit(n)
    digest = draw_key(seed, key)
    parts = {f"__digest{i}": F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(3)}
    return first_rows(rows.withColumns(parts), [*parts, key], n, at_once).drop(*parts)


def share_size(count: int, share: float) -> int:
    """max(1, round half even of count * share); all for shares of 1 and more."""
    return count if share >= 1 else max(1, round(count * share))


def numbered(rows: DataFrame, order: str | Column, part: Column, name: str = "number") -> DataFrame:
    """Row numbers from 0 in an order without ties, of which part is a coarser form; no task numbers the whole table."""
    return running_total(rows, part, order, F.lit(1), name).withColumn(name, F.col(name) - 1)


def mixture(spark, sizes: list[int], weights: list[float], length: int, seed: int) -> DataFrame:
    """(i, source, row): row i of a virtual table draws a source by weight, then one of its rows, with replacement."""
    if len(sizes) != len(weights) or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("one weight for each source, none negative, not all zero")
    u, total, edge = F.col("u"), sum(weights), 0.0
    source, size = F.lit(len(sizes) - 1), F.lit(sizes[-1])
    cases = []
    for k, w in enumerate(weights[:-1]):
        edge += w / total
        cases.append((u < edge, k))
    for test, k in reversed(cases):
        source, size = F.when(test, k).otherwise(source), F.when(test, sizes[k]).otherwise(size)
    draws = spark.range(length).withColumnRenamed("id", "i").withColumn("u", uniform(seed, "i"))
    return draws.select("i", source.alias("source"), F.floor(uniform(seed + 1, "i") * size).alias("row"))


def bootstrap_chunks(starts: DataFrame, seed: int, episode: str = "ep", start: str = "j") -> DataFrame:
    """(i, episode, start): as many draws as there are valid starts; each takes an episode uniformly, then one of its starts."""
    sizes = written_once(starts.groupBy(episode).agg(F.count("*").alias("starts")), "starts")
    ranked = numbered(sizes, episode, id_part(sizes, episode))
    total = sizes.agg(F.count("*").alias("episodes"), F.sum("starts").alias("rows")).first()
    if not total["rows"]:
        raise ValueError("no valid start")
    draws = starts.sparkSession.range(total["rows"]).withColumnRenamed("id", "i").withColumn("number", F.floor(uniform(seed, "i") * total["episodes"]))
    return draws.join(ranked, "number").select("i", episode, F.floor(uniform(seed + 1, "i") * F.col("starts")).alias(start))


def coverage_first(starts: DataFrame, budget: int, seed: int, episode: str = "ep", start: str = "j") -> DataFrame:
    """`budget` starts: one of every episode first, then draws with replacement; with a smaller budget than episodes, a random part of them."""
    if budget <= 0:
        raise ValueError("the budget must be positive")
    sizes = written_once(starts.groupBy(episode).agg(F.count("*").alias("starts")), "starts")
    digest = draw_key(seed, episode)
    ranked = numbered(sizes, F.struct(digest, episode), F.substring(digest, 1, 4))
    first = ranked.where(F.col("number") < budget).select(F.col("number").cast("long").alias("i"), episode, F.floor(uniform(seed + 1, episode) * F.col("starts")).alias(start))
    episodes = sizes.count()
    more = starts.sparkSession.range(episodes, max(episodes, budget)).withColumnRenamed("id", "i").withColumn("number", F.floor(uniform(seed + 2, "i") * episodes))
    return first.unionByName(more.join(ranked, "number").select("i", episode, F.floor(uniform(seed + 3, "i") * F.col("starts")).alias(start)))


def batches(rows: DataFrame, key: str, size: int, seed: int | None = None) -> DataFrame:
    """Adds batch and place. Shuffled batches (with a seed) drop the last incomplete one; otherwise rows keep their order.

    Places come from numbers within parts of the order and the parts' running sizes, so no task sorts the table.
    """
    if seed is None:
        placed = numbered(rows, key, id_part(rows, key), "__number")
    else:
        digest = draw_key(seed, key)
        placed = numbered(rows, F.struct(digest, key), F.substring(digest, 1, 4), "__number")
    out = placed.withColumn("batch", F.floor(F.col("__number") / size)).withColumn("place", F.col("__number") % size).drop("__number")
    return out if seed is None else out.where(F.col("batch") < rows.count() // size)


def modulo_batches(spark, n: int, size: int, count: int) -> DataFrame:
    """(batch, place, row): batch i of a table of n rows holds rows (i * size + j) mod n."""
    return spark.range(count * size).select(F.floor(F.col("id") / size).alias("batch"), (F.col("id") % size).alias("place"), (F.col("id") % n).alias("row"))


def episode_subset(ids: DataFrame, key: str, n: int, seed: int | None = None) -> DataFrame:
    """n ids: the first ones, or random ones with a seed; more than there are is an error."""
    if n > ids.count():
        raise ValueError(f"{n} episodes asked for, fewer are there")
    return ids.orderBy(key).limit(n) if seed is None else prefix_sample(ids, key, n, seed)


def sample_count(rows: int, size: int, shuffled: bool, most: int | None = None) -> int:
    """How many rows a pass yields: shuffled passes drop the last incomplete batch, and there may be a limit of batches."""
    whole = rows // size * size if shuffled else rows
    return whole if most is None else min(max(0, most) * size, whole)


def passes(rows: DataFrame, key: str, size: int, count: int = 1, seed: int | None = None, most: int | None = None) -> DataFrame:
    """(pass, batch, place) beside the rows of `count` passes; each shuffled pass has an order of its own, and `most` limits the batches of a pass."""
    out = None
    for turn in range(count):
        one = batches(rows, key, size, None if seed is None else seed + turn).withColumn("pass", F.lit(turn).cast("long"))
        one = one if most is None else one.where(F.col("batch") < max(0, most))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("at least one pass")
    return out


def frame_mixture(sources: list[DataFrame], weights: list[float], length: int, seed: int, key: str, episode: str = "ep", labelled: int | None = None) -> DataFrame:
    """(i, source, label, and the columns of the drawn frame): a mixture over frames, joined back to them.

    Every frame of a source is as likely as the others. The label is the frame's episode, or -1 outside the labelled source (None labels all).
    """
    sizes = [s.count() for s in sources]
    pool = None
    for k, own in enumerate(sources):
        one = numbered(own, key, id_part(own, key), "row").withColumn("source", F.lit(k))
        pool = one if pool is None else pool.unionByName(one)
    label = F.col(episode) if labelled is None else F.when(F.col("source") == labelled, F.col(episode)).otherwise(F.lit(-1))
    drawn = mixture(sources[0].sparkSession, sizes, weights, length, seed).join(pool, ["source", "row"]).drop("row")
    return drawn.withColumn("label", label.cast("long"))


def computed_batches(rows: DataFrame, index: str, n: int, size: int, seed: int, turns: int = 1, drop_last: bool = True) -> DataFrame:
    """(pass, batch, place) beside rows numbered 0..n-1 by index, for each of `turns` shuffled passes: computed from the number alone, so nothing is shuffled.

    Every pass has an order of its own. The last incomplete batch of a pass is left out unless kept.
    """
    if turns < 1:
        raise ValueError("at least one pass")
    out = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("pass"))
    out = out.withColumn("__at", place_of(F.col(index), n, seed, F.col("pass")))
    out = out.withColumn("batch", F.floor(F.col("__at") / size)).withColumn("place", F.col("__at") % size).drop("__at")
    return out.where(F.col("batch") < n // size) if drop_last else out


def computed_batch(spark, n: int, size: int, batch: int, seed: int, turn: int = 0) -> DataFrame:
    """(place, i): the rows of one batch of one shuffled pass, without looking at any other; a batch that no pass has is an error."""
    if batch < 0 or batch * size >= n:
        raise ValueError(f"{n} rows have no batch {batch} of {size}")
    return spark.range(batch * size, min(n, (batch + 1) * size)).select((F.col("id") - batch * size).alias("place"), row_at(F.col("id"), n, seed, turn).alias("i"))


def draws_in_passes(spark, n: int, count: int, seed: int) -> DataFrame:
    """(draw, i): `count` draws from a pool of n, pass after pass: a draw beyond the pool begins a new shuffled pass, and fewer draws are the first of more."""
    if count and not n:
        raise ValueError("nothing to draw from")
    place = F.col("id") % max(n, 1)
    return spark.range(count).select(F.col("id").alias("draw"), row_at(place, max(n, 1), seed, (F.col("id") - place) / max(n, 1)).alias("i"))
