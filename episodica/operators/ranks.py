"""Exact ranks, first rows and running totals without a task that sorts the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.plans.scratch import written_once

#: Bins a round, rows whose values the driver sorts itself, and rows a single top-n task may take.
BINS, FEW, AT_ONCE = 4096, 10_000, 100_000


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def _bin(x: Column, lo, hi) -> Column:
    """Monotone in x: the two ends have bins of their own, so every round narrows, infinities and NaN included."""
    share = (x.cast("double") / 2 - F.lit(lo).cast("double") / 2) / (F.lit(hi).cast("double") / 2 - F.lit(lo).cast("double") / 2)
    inner = F.when(F.isnan(share), 1).otherwise(F.least(F.lit(BINS), 1 + F.floor(F.nanvl(share, F.lit(0.0)) * BINS)))
    return F.when(x == F.lit(lo), 0).when(x == F.lit(hi), BINS + 1).otherwise(inner)


def at_places(rows: DataFrame, column: str, places: list[int] | Callable[[int], list[int]]) -> dict[int, tuple[object, int]]:
    """{place: (value, how many are less)} of places (from 0) among the values of a numeric column; nulls don't count, NaN comes last.

    Places may be given as a function of the number of values. Counts per bin narrow each place to the bin that holds it, round by round, so the driver sees a few thousand numbers and no task sorts.
    """
    values = rows.select(F.col(column).alias("x")).where("x IS NOT NULL").persist()
    try:
        ends = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
        if callable(places):
            places = places(ends["n"])
        if places and not 0 <= min(places) <= max(places) < ends["n"]:
            raise ValueError(f"places beyond the {ends['n']} values")
        todo = {p: (ends["lo"], ends["hi"], 0, ends["n"]) for p in places}
        found: dict[int, tuple[object, int]] = {}
        while todo:
            parts = list({part[2]: part for part in todo.values()}.values())
            x, which, place = F.col("x"), F.lit(None).cast("int"), F.lit(None).cast("long")
            for i, (lo, hi, _, n) in enumerate(parts):
                within = x.between(F.lit(lo), F.lit(hi))
                which = F.when(within, i).otherwise(which)
                if n > FEW:
                    place = F.when(within, _bin(x, lo, hi)).otherwise(place)
            single = [i for i, part in enumerate(parts) if part[3] <= FEW]
            exact = F.when(F.col("which").isin(single), x) if single else F.lit(None).cast(values.schema["x"].dataType)
            counted = values.select("x", which.alias("which"), place.alias("bin")).where("which IS NOT NULL").groupBy("which", "bin", exact.alias("value")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("c"))
            bins: dict[int, list] = {}
            for r in counted.orderBy("which", "lo").collect():
                bins.setdefault(r["which"], []).append(r)
            for p, part in list(todo.items()):
                i, below = next(i for i, q in enumerate(parts) if q[2] == part[2]), part[2]
                for r in bins[i]:
                    if p < below + r["c"]:
                        break
                    below += r["c"]
                if _same(r["lo"], r["hi"]):
                    found[p] = (r["lo"], below)
                    del todo[p]
                else:
                    todo[p] = (r["lo"], r["hi"], below, r["c"])
        return found
    finally:
        values.unpersist()


def percentiles(rows: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """Percentiles (shares from 0 to 1) with linear interpolation between ranks; None where there is no value."""
    spots: list[float] = []

    def places(n: int) -> list[int]:
        spots.extend((n - 1) * s for s in shares if n)
        return sorted({int(p) for p in spots} | {min(n - 1, int(p) + 1) for p in spots})

    values = {p: float(v) for p, (v, _) in at_places(rows, column, places).items()}
    if not values:
        return None
    return [values[int(p)] if p == int(p) else (int(p) + 1 - p) * values[int(p)] + (p - int(p)) * values[int(p) + 1] for p in spots]


def first_rows(rows: DataFrame, columns: list[str], k: int, at_once: int = AT_ONCE) -> DataFrame:
    """The k rows that come first in the order of the columns (nulls first, NaN last), in no order of their own when there are many.

    Few are a top-n. For many the value at the last place is found first and rows are filtered by it, so that no task holds k rows (the input is evaluated once, into a table that the rounds read); columns but
    the last must be numeric, and a last one that isn't decides between equals by a top-n.
    """
    if k <= at_once:
        return rows.orderBy(*columns).limit(k)
    kinds = dict(rows.dtypes)
    kept, rest = [], written_once(rows, "ranked")
    for column in columns:
        c = F.col(column)
        n, nulls = rest.agg(F.count("*"), F.count_if(c.isNull())).first()
        if k >= n:
            kept.append(rest)
            k = 0
            break
        if kinds[column] in ("string", "date", "timestamp", "timestamp_ntz", "binary"):
            kept.append(rest.orderBy(column).limit(k))
            k = 0
            break
        if k <= nulls:
            rest = rest.where(c.isNull())
            continue
        value, below = at_places(rest, column, [k - nulls - 1])[k - nulls - 1]
        kept.append(rest.where(c.isNull() | (c < F.lit(value))))
        rest, k = rest.where(c == F.lit(value)), k - nulls - below
    if k:
        kept.append(rest.limit(k))
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def running_total(rows: DataFrame, part: Column, order: Column | str, n: Column | str, name: str) -> DataFrame:
    """Adds the sum of n over the rows up to each one, in an order of which part is a coarser form (never falling where the order rises).

    Sums run within parts; what the parts before hold comes from a row per part.
    """
    amount = F.col(n) if isinstance(n, str) else n
    keyed = rows.withColumn("__part", part)
    within = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("__part").agg(F.sum(amount).alias("__size"))
    bases = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__base"))
    return keyed.withColumn(name, F.sum(amount).over(within)).join(bases, "__part").withColumn(name, F.col(name) + F.col("__base")).drop("__part", "__base")
