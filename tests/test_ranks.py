"""Exact ranks, first rows and running totals against a plain sort."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import profile as P
from episodica.operators import ranks
from episodica.operators import sampling as S
from episodica.operators.episodes import episode_ranges


@pytest.mark.parametrize("few", [0, 10_000])
def test_places_and_percentiles(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "BINS", 8)
    draw = random.Random(3)
    xs = [draw.choice([draw.gauss(0, 1), draw.gauss(0, 1) * 1e9, 0.0, 5.0]) for _ in range(500)] + [float("inf"), float("-inf"), 1.7e308, -1.7e308]
    rows = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    own = sorted(xs)
    got = ranks.at_places(rows, "x", [0, 1, 250, 400, 503])
    assert got == {p: (own[p], sum(x < own[p] for x in own)) for p in (0, 1, 250, 400, 503)}
    plain = rows.where("abs(x) < 1e300")
    assert np.allclose(ranks.percentiles(plain, "x", [0.0, 0.2, 0.8, 1.0]), np.percentile(sorted(x for x in xs if abs(x) < 1e300), [0, 20, 80, 100]))
    assert ranks.percentiles(plain.limit(0), "x", [0.5]) is None
    with_nan = spark.createDataFrame([(x,) for x in [1.0, float("nan"), 2.0, float("nan")]], "x double")
    last = ranks.at_places(with_nan, "x", [1, 2])
    assert last[1] == (2.0, 1) and math.isnan(last[2][0]) and last[2][1] == 2
    with pytest.raises(ValueError):
        ranks.at_places(plain, "x", [10**6])


def test_first_rows_equal_a_sort(spark):
    draw = random.Random(5)
    data = [(draw.choice([None, 0.0, 1.0, float("nan"), draw.random()]), i) for i in range(300)]
    rows = spark.createDataFrame(data, "x double, id long")
    for k in (1, 40, 100, 150, 299, 300, 400):
        want = sorted(r["id"] for r in rows.orderBy("x", "id").limit(k).collect())
        assert sorted(r["id"] for r in ranks.first_rows(rows, ["x", "id"], k, at_once=0).collect()) == want
    ids = spark.range(500).withColumn("name", F.concat(F.lit("n"), "id"))
    for key in ("id", "name"):
        assert S.prefix_sample(ids, key, 120, 9, at_once=0).exceptAll(S.prefix_sample(ids, key, 120, 9)).count() == 0
        assert S.prefix_sample(ids, key, 120, 9, at_once=0).count() == 120


def test_many_first_rows_evaluate_their_input_once(spark):
    turns = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            turns.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 400, 1, 3).select((F.col("id") % 7).alias("x"), "id").mapInArrow(seen, "x long, id long")
    got = ranks.first_rows(rows, ["x", "id"], 100, at_once=0)
    assert sorted((r["x"], r["id"]) for r in got.collect()) == sorted((i % 7, i) for i in range(400))[:100] and turns.value == 400


def test_running_totals_in_parts(spark):
    draw = random.Random(7)
    lengths = {draw.randrange(1 << 20): draw.randrange(1, 9) for _ in range(300)}
    rows = spark.createDataFrame(list(lengths.items()), "ep long, n long")
    at, want = 0, {}
    for e in sorted(lengths):
        want[e] = (at, at + lengths[e])
        at += lengths[e]
    assert {r["ep"]: (r["start"], r["end"]) for r in episode_ranges(rows, "ep").collect()} == want


def test_exact_quantiles_by_bins(spark):
    draw = random.Random(11)
    data = [(k, draw.choice([draw.gauss(0, 1), 3.0, draw.gauss(0, 1e6)])) for k in "ab" for _ in range(400)] + [("c", 1.0), ("a", None)]
    got = {(r["k"], r["p"]): r["quantile"] for r in P.exact_quantiles(spark.createDataFrame(data, "k string, x double"), "k", probabilities=(0.0, 0.01, 0.5, 1.0), bins=16).collect()}
    for k in "abc":
        own = [x for n, x in data if n == k and x is not None]
        assert np.allclose([got[k, p] for p in (0.0, 0.01, 0.5, 1.0)], np.percentile(own, [0, 1, 50, 100]))


def test_passes_and_counts(spark):
    assert [S.sample_count(10, 4, True), S.sample_count(10, 4, False), S.sample_count(10, 4, False, 9), S.sample_count(10, 4, True, 1)] == [8, 10, 10, 4]
    rows = spark.range(50).withColumnRenamed("id", "ep")
    got = S.passes(rows, "ep", 8, 3, seed=1)
    assert got.count() == 3 * 48 and got.where("batch = 0 AND place = 0").select("ep").distinct().count() > 1
    assert S.passes(rows, "ep", 8).count() == 50
