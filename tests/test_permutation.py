"""Keyed permutations: bijections of any size, places and rows inverse to each other, batches without a shuffle."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from episodica.functions.permutation import place_of, row_at
from episodica.operators import sampling as S


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 960, 1000, 4097, 50_000])
def test_every_row_has_one_place(spark, n):
    got = spark.range(n).select("id", row_at(F.col("id"), n, 3).alias("row"), place_of(row_at(F.col("id"), n, 3), n, 3).alias("back")).collect()
    assert sorted(r["row"] for r in got) == list(range(n)) and all(r["back"] == r["id"] for r in got)


def test_large_sizes_stay_exact(spark):
    n = (1 << 61) + 12345
    got = spark.range(0, n, n // 999).select("id", row_at(F.col("id"), n, 8).alias("row")).withColumn("back", place_of(F.col("row"), n, 8)).collect()
    assert len({r["row"] for r in got}) == len(got) and all(r["back"] == r["id"] and 0 <= r["row"] < n for r in got)


def test_order_looks_random(spark):
    n = 40_000
    rows = [r["row"] for r in spark.range(n).select("id", row_at(F.col("id"), n, 1).alias("row")).orderBy("id").collect()]
    cells = Counter((i * 20 // n, r * 20 // n) for i, r in enumerate(rows))
    assert sum((c - n / 400) ** 2 / (n / 400) for c in (cells[i, j] for i in range(20) for j in range(20))) < 460  # 361 degrees of freedom
    up = sum(b > a for a, b in zip(rows, rows[1:], strict=False))
    assert abs(up - n / 2) < 4 * (n / 12) ** 0.5
    other = [r["row"] for r in spark.range(n).select("id", row_at(F.col("id"), n, 2).alias("row")).orderBy("id").collect()]
    assert sum(a == b for a, b in zip(rows, other, strict=True)) < 10


def test_batches_of_a_shuffled_pass(spark):
    rows = spark.range(103).select(F.col("id").alias("i"), (F.col("id") * 2).alias("x"))
    got = S.computed_batches(rows, "i", 103, 10, seed=4, turns=2)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    seen = [(r["pass"], r["batch"], r["place"], r["i"]) for r in got.collect()]
    assert len(seen) == 200 and len({(p, i) for p, _, _, i in seen}) == 200 and Counter((p, b) for p, b, _, _ in seen) == {(p, b): 10 for p in (0, 1) for b in range(10)}
    one = {(r["place"], r["i"]) for r in S.computed_batch(spark, 103, 10, 7, seed=4, turn=1).collect()}
    assert one == {(j, i) for p, b, j, i in seen if (p, b) == (1, 7)}
    assert S.computed_batches(rows, "i", 103, 10, seed=4, turns=1, drop_last=False).count() == 103
    with pytest.raises(ValueError):
        S.computed_batch(spark, 103, 10, 11, seed=4)


def test_draws_beyond_the_pool(spark):
    got = [r["i"] for r in S.draws_in_passes(spark, 7, 17, seed=3).orderBy("draw").collect()]
    assert len(got) == 17 and sorted(got[:7]) == sorted(got[7:14]) == list(range(7)) and got[:7] != got[7:14]
    assert [r["i"] for r in S.draws_in_passes(spark, 7, 10, seed=3).orderBy("draw").collect()] == got[:10]
    assert S.draws_in_passes(spark, 0, 0, seed=1).count() == 0
    with pytest.raises(ValueError):
        S.draws_in_passes(spark, 0, 1, seed=1)


def test_only_numbers_that_are_not_below_n_walk_on(spark, monkeypatch):
    """With a walk that fails at once, all rows whose first step leads below n still have their place."""
    from episodica.functions import permutation

    first, n = permutation._rounds, 10_001  # of 101 * 101 numbers, 200 are not below n

    def counted(x, a, keys, back):
        return first(x, a, keys, back) if x is start else F.raise_error(F.lit("walked")).cast("long")

    start = F.col("id").cast("long")
    below = [r["id"] for r in spark.range(n).select("id", first(start, permutation.side(n), [F.lit(k).cast("long") for k in permutation.round_keys(3)], True).alias("at")).where(F.col("at") < n).collect()]
    monkeypatch.setattr(permutation, "_rounds", counted)
    monkeypatch.setattr(permutation, "WALK", 10**7)  # an array that long for every row would take hours
    got = spark.range(n).where(F.col("id").isin(below[:2000])).select(permutation._walked(start, n, 3, 0, True).alias("at")).collect()
    assert len(got) == 2000 and all(0 <= r["at"] < n for r in got)
