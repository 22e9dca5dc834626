"""Alias tables give the probabilities of their weights, and draws follow them."""

import numpy as np
import pytest

from episodica.operators.alias import alias_mixture, alias_table, cells_of, probabilities


def sources(spark, weights):
    return spark.createDataFrame([(i, float(w), 1 + i % 7) for i, w in enumerate(weights)], "source long, weight double, size long")


@pytest.mark.parametrize("weights", [[3.0], [1, 1, 1], [1e-9, 1, 1e9], list(np.random.default_rng(1).pareto(0.7, 500) + 1e-6), [0.5] * 64 + [1e6]])
def test_cells_add_up_to_the_weights(weights):
    share, other = cells_of(np.array(weights, float))
    got = np.bincount(np.arange(len(share)), share) + np.bincount(other, 1 - share, len(share))
    assert got / len(share) == pytest.approx(np.array(weights) / np.sum(weights), abs=1e-12)
    assert ((share >= 0) & (share <= 1)).all()


@pytest.mark.parametrize("cells", [1 << 16, 64, 1])
def test_tables_of_any_number_of_parts(spark, cells):
    weights = np.random.default_rng(2).pareto(1.0, 300)
    table = alias_table(sources(spark, weights), cells=cells)
    got = {r["source"]: r["probability"] for r in probabilities(table).collect()}
    assert sum(got.values()) == pytest.approx(1)
    for i, w in enumerate(weights):
        assert got[i] == pytest.approx(w / weights.sum(), rel=1e-9, abs=1e-13)


def test_draws_follow_ten_thousand_weights_in_a_flat_plan(spark):
    weights, n = np.arange(10_000) % 10 + 0.0, 60_000
    table = alias_table(sources(spark, weights), cells=1024)
    rows = alias_mixture(table, n, 7)
    drawn = rows.toPandas()
    assert sorted(drawn["i"]) == list(range(n)) and (drawn["row"] < 1 + drawn["source"] % 7).all() and (drawn["row"] >= 0).all()
    seen, want = np.bincount(drawn["source"] % 10, minlength=10)[1:], n * np.arange(1, 10) / 45
    assert not (drawn["source"] % 10 == 0).any()  # weight zero
    assert ((seen - want) ** 2 / want).sum() < 26.1  # chi-square, 8 degrees, 0.001
    folded = np.bincount(drawn["row"][drawn["source"] % 7 == 6], minlength=7)
    assert ((folded - folded.mean()) ** 2 / folded.mean()).sum() < 22.5
    few = alias_mixture(alias_table(sources(spark, [1, 2, 3]), cells=1024), n, 7)

    def size(df):
        return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert size(rows) == size(few)
    again = {tuple(r) for r in alias_mixture(alias_table(sources(spark, weights).repartition(7), cells=1024), n, 7).collect()}
    assert again == set(drawn.itertuples(index=False, name=None))


def test_defined_cases(spark):
    def table(rows):
        return alias_table(spark.createDataFrame(rows, "source string, weight double, size long"))

    repeated = table([("a", 1.0, 2), ("a", 2.0, 5), ("b", 1.0, None), (None, 9.0, 1), ("c", 0.0, 3)])
    assert {r["source"]: r["probability"] for r in probabilities(repeated).collect()} == pytest.approx({"a": 0.75, "b": 0.25})
    drawn = alias_mixture(repeated, 200, 1).collect()
    assert {r["row"] for r in drawn if r["source"] == "b"} == {None} and {r["row"] for r in drawn if r["source"] == "a"} == set(range(5))
    assert alias_mixture(repeated, 0, 1).count() == 0
    for bad in ([("a", 0.0, 1)], []):
        with pytest.raises(ValueError):
            table(bad)
    for weight in (-1.0, float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="weights must be numbers"):
            table([("a", weight, 1), ("b", 1.0, 1)])
