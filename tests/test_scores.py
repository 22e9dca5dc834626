"""Scores of iterations: zero where a mean is the zero point in decimals, and the same however the table is split."""

import itertools

import pytest
from pyspark.sql import functions as F

from episodica.plans.queries import QUERIES, scores

SF = "/root/testdata/sf0.1"


def plain(values):
    total = 0.0
    for v in values:
        total += v
    return total / len(values) - 49.6


def missing_zero():
    """Values with a mean of 49.6 whose doubles, summed in their order, have another."""
    return next(v for v in itertools.permutations([0.1, 0.7, 49.3, 99.1, 71.4, 77.0]) if plain(v) != 0)


@pytest.fixture
def folder(spark, tmp_path):
    values = missing_zero()
    rows = [(5 * i, 3, v) for i, v in enumerate(values)] + [(5 * i + 1, 3, 50.6) for i in range(3)] + [(5, 9, 49.6), (10, 9, float("nan")), (6, 9, 1e12), (11, 9, None)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_a_mean_at_the_zero_point_is_no_score(spark, folder):
    got = {(r["ep"], r["iter"]): r["score"] for r in scores(spark, folder).collect()}
    assert got[3, 0] == 0 and got[9, 0] != got[9, 0] and got[9, 1] == 1e12 - 49.6
    summary = QUERIES["score_summary"](spark, folder).first()
    assert (summary["scored"], summary["nonzero"]) == (4, 3)
    assert {(r["ep"], r["score"]) for r in QUERIES["mean_nonzero_scores"](spark, folder).where("ep = 3").collect()} == {(3, 1.0)}
    assert [r["score"] for r in QUERIES["scores_dense"](spark, folder).where("ep = 3").collect()] == [1.0]
    assert {(r["ep"], r["iter"]) for r in QUERIES["score_vectors"](spark, folder).collect()} == {(3, 1), (9, 0), (9, 1)}


@pytest.mark.parametrize("name", ["mean_nonzero_scores", "scores_dense", "select_bottom_k"])
def test_means_do_not_depend_on_how_the_table_is_split(spark, tmp_path, name):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for at, order in (("a", F.col("event_id")), ("b", F.crc32(F.col("event_id").cast("string")))):
        events.repartitionByRange(7, order).sortWithinPartitions(order).write.parquet(f"{tmp_path}/{at}/events.parquet")
    one, other = ({tuple(r) for r in QUERIES[name](spark, at).collect()} for at in (f"{tmp_path}/a", f"{tmp_path}/b"))
    assert one == other == {tuple(r) for r in QUERIES[name](spark, SF).collect()}
