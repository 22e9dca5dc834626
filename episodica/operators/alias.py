"""Draws from any number of weighted sources by Walker's alias method: a table of cells instead of a comparison for each source.

Sources are dealt by hash to parts of about `cells` sources; each part's cells are made in a task of their own, and a small table of the same form
draws a part by its weight. A draw looks up one cell of the first and one of the second table, so a heavy source's draws spread over all
cells of its part and no key of the join is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.functions.hashing import uniform

CELLS = 1 << 16


def cells_of(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share, other) of each cell: cell c gives c with probability share[c], else other[c]; a cell is drawn like any other. Weights are positive."""
    scaled = np.asarray(weights, float) / np.max(weights)
    scaled = scaled * (len(scaled) / scaled.sum())
    share, other = np.ones(len(scaled)), np.arange(len(scaled))
    order = np.argsort(scaled, kind="stable")
    left, poor, rich = scaled.tolist(), [], []
    for c in order[::-1].tolist():
        (poor if left[c] < 1 else rich).append(c)
    while poor and rich:
        c, giver = poor.pop(), rich[-1]
        share[c], other[c] = left[c], giver
        left[giver] -= 1 - left[c]
        if left[giver] < 1:
            poor.append(rich.pop())
    return share, other


@dataclass(frozen=True)
class AliasTable:
    """cells: (part, cell, share, source, size, other, other_size); tops: (top, share, part, cells, other, other_cells), a row per part; weights: (part, weight)."""

    cells: DataFrame
    tops: DataFrame
    weights: DataFrame
    parts: int


def alias_table(sources: DataFrame, source: str = "source", weight: str = "weight", size: str = "size", cells: int = CELLS) -> AliasTable:
    """The tables for (source, weight, size). Rows that repeat a source add their weights and keep the largest size; null sources are left out.

    Sources of weight zero are never drawn. A weight that is negative, null, infinite or not a number is an error, and so are weights that are all zero.
    A row per part reaches the driver: one for `cells` sources.
    """
    w = F.col(weight).cast("double")
    sound = F.when(w.isNotNull() & (w >= 0) & (w < float("inf")), w).otherwise(F.raise_error(F.lit("weights must be numbers of at least zero")).cast("double"))
    whole = sources.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), sound.alias("weight"), F.col(size).cast("long").alias("size"))
    whole = whole.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("size").alias("size")).where("weight > 0")
    n = whole.count()
    if not n:
        raise ValueError("no source has a weight")
    parts = -(-n // cells)
    dealt = whole.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(parts)).cast("long"))
    kind = whole.schema["source"].dataType.simpleString()

    def fill(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("source", ignore_index=True)
        share, other = cells_of(own["weight"].to_numpy())
        return pd.DataFrame({"part": own["part"], "cell": np.arange(len(own)), "share": share, "source": own["source"], "size": own["size"], "other": own["source"].to_numpy()[other], "other_size": own["size"].to_numpy()[other]})

    made = dealt.groupBy("part").applyInPandas(fill, f"part long, cell long, share double, source {kind}, size long, other {kind}, other_size long")
    totals = dealt.groupBy("part").agg(F.sum("weight").alias("weight"), F.count("*").alias("cells")).orderBy("part").collect()
    share, other = cells_of(np.array([t["weight"] for t in totals]))
    tops = [(k, float(share[k]), totals[k]["part"], totals[k]["cells"], totals[o]["part"], totals[o]["cells"]) for k, o in enumerate(other.tolist())]
    spark = sources.sparkSession
    top = spark.createDataFrame(tops, "top long, share double, part long, cells long, other long, other_cells long")
    return AliasTable(made, top, spark.createDataFrame([(t["part"], t["weight"]) for t in totals], "part long, weight double"), len(totals))


def probabilities(table: AliasTable) -> DataFrame:
    """(source, probability) as the tables give it, which tells whether they are those of the weights."""
    both = F.explode(F.array(F.struct(F.col("part"), F.col("share").alias("p")), F.struct(F.col("other").alias("part"), (1 - F.col("share")).alias("p")))).alias("t")
    chosen = table.tops.select(both).groupBy("t.part").agg((F.sum("t.p") / table.parts).alias("chance"))
    sizes = table.cells.groupBy("part").agg(F.count("*").alias("n"))
    each = F.explode(F.array(F.struct(F.col("source"), F.col("share").alias("p")), F.struct(F.col("other").alias("source"), (1 - F.col("share")).alias("p")))).alias("t")
    rows = table.cells.join(sizes.join(chosen, "part"), "part").select(each, "chance", "n")
    return rows.groupBy("t.source").agg(F.sum(F.col("t.p") * F.col("chance") / F.col("n")).alias("probability"))


def alias_mixture(table: AliasTable, length: int, seed: int) -> DataFrame:
    """(i, source, row): draw i takes a source by weight, then one of its rows (null for a source without rows), with replacement.

    The plan does not depend on how many sources there are.
    """
    draws = table.cells.sparkSession.range(length).withColumnRenamed("id", "i").withColumn("top", F.floor(uniform(seed, "i") * table.parts))
    first = uniform(seed + 1, "i") < F.col("share")
    parted = draws.join(table.tops, "top").select("i", F.when(first, F.col("part")).otherwise(F.col("other")).alias("part"), F.when(first, F.col("cells")).otherwise(F.col("other_cells")).alias("cells"))
    placed = parted.select("i", "part", F.floor(uniform(seed + 2, "i") * F.col("cells")).alias("cell")).join(table.cells, ["part", "cell"])
    own = uniform(seed + 3, "i") < F.col("share")
    drawn = placed.select("i", F.when(own, F.col("source")).otherwise(F.col("other")).alias("source"), F.when(own, F.col("size")).otherwise(F.col("other_size")).alias("size"))
    return drawn.select("i", "source", F.when(F.col("size") > 0, F.floor(uniform(seed + 4, "i") * F.col("size"))).alias("row"))
