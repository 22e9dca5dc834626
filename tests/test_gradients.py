"""Matrix-free gradients, Hessian products and replays against sums over all rows and finite differences."""

import numpy as np
import pytest

from episodica.operators import gradients as G
from episodica.operators import influence as I
from episodica.plans.workflows import score_and_select

RNG = np.random.default_rng(3)
X = RNG.normal(size=(120, 4))
Y = (X @ [1.0, -2.0, 0.5, 0.0] + RNG.normal(size=120) > 0).astype(float)
THETA = np.array([0.3, -0.2, 0.1, 0.5])


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, i % 6, i % 4, i % 5, [float(v) for v in X[i]], float(Y[i]), 1.0 + i % 3) for i in range(120)]
    return spark.createDataFrame(data, "i long, ep long, batch long, part long, x array<double>, y double, w double").repartition(3).persist()


@pytest.mark.parametrize("loss", [G.SQUARED, G.LOGISTIC, G.huber(0.7)])
def test_gradient_and_product_equal_differences_of_the_loss(rows, loss):
    def value(t):
        return loss.value(X @ t, Y).mean()

    def slope(t):
        return X.T @ loss.slope(X @ t, Y) / len(Y)

    v, h = np.array([0.5, 1.0, -1.0, 0.2]), 1e-6
    got = G.mean_sum(rows, THETA, loss)
    assert got == pytest.approx([(value(THETA + h * e) - value(THETA - h * e)) / (2 * h) for e in np.eye(4)], rel=1e-3, abs=1e-7)
    assert G.mean_sum(rows, THETA, loss, v) == pytest.approx((slope(THETA + h * v) - slope(THETA - h * v)) / (2 * h), rel=1e-3, abs=1e-7)
    assert G.mean_loss(rows, THETA, loss) == pytest.approx(value(THETA))


def test_weights_and_first_batches(rows):
    w = 1.0 + np.arange(120) % 3
    assert G.mean_sum(rows, THETA, G.LOGISTIC, weight="w") == pytest.approx((w * G.LOGISTIC.slope(X @ THETA, Y)) @ X / 120)
    first = np.arange(120) % 4 < 2
    assert G.mean_loss(rows, THETA, G.LOGISTIC, steps=2) == pytest.approx(G.LOGISTIC.value(X[first] @ THETA, Y[first]).mean())
    with pytest.raises(ValueError):
        G.mean_loss(rows, THETA, G.LOGISTIC, steps=0)


def test_tasks_hand_on_one_vector_each_at_any_width(spark):
    width = 4096
    wide = spark.range(64, numPartitions=4).selectExpr("id", f"transform(sequence(1, {width}), d -> sin(id * d)) AS x", "cast(id % 2 AS double) AS y")
    t, v = np.cos(np.arange(width)) / width, np.sin(np.arange(width)) / width
    parts = G.partial_sums(wide, t, G.LOGISTIC, v).collect()
    assert len(parts) == 4 and {len(p["s"]) for p in parts} == {width} and sum(p["rows"] for p in parts) == 64
    xs = np.sin(np.arange(64)[:, None] * np.arange(1, width + 1))
    want = xs.T @ (G.LOGISTIC.curvature(xs @ t, None) * (xs @ v)) / 64
    assert G.mean_sum(wide, t, G.LOGISTIC, v) == pytest.approx(want, abs=1e-12)


def test_nulls_take_no_part_and_broken_vectors_are_errors(spark, rows):
    some = spark.createDataFrame([(0, [1.0, 2.0], 1.0), (1, None, 1.0), (2, [1.0, 1.0], None)], "ep int, x array<double>, y double")
    assert G.mean_sum(some, [0.0, 0.0], G.LOGISTIC) == pytest.approx([-0.5, -1.0])
    assert [tuple(r) for r in G.episode_dots(some, [0.0, 0.0], [1.0, 0.0], G.LOGISTIC).collect()] == [(0, -0.5)]
    assert list(G.mean_sum(rows.where("i < 0"), THETA, G.LOGISTIC)) == [0, 0, 0, 0]
    for bad in ([[1.0, None]], [[1.0]], [[1.0], [1.0, 2.0, 3.0]]):
        with pytest.raises(Exception, match="every vector must have 2 numbers"):
            G.mean_sum(spark.createDataFrame([(x, 1.0) for x in bad], "x array<double>, y double").coalesce(1), [0.0, 0.0], G.LOGISTIC)


def test_squared_loss_equals_the_closed_form(rows):
    train, cand, val = (rows.where(f"part {p}") for p in ("< 2", "= 2", "> 2"))
    optimiser = I.Optimiser(rate=0.01, eps_root=1e-2)
    want = {r["ep"]: r["score"] for r in I.replay_scores(train, cand, val, THETA, 6, 3, optimiser, segment=4).collect()}
    assert {r["ep"]: r["score"] for r in G.replay_scores(train, cand, val, THETA, 6, 3, G.SQUARED, optimiser, segment=4).collect()} == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize(("inner", "back"), [(0, 1), (5, 2)])
def test_logistic_replay_equals_finite_differences(rows, inner, back):
    optimiser = I.Optimiser(rate=0.01, eps_root=1e-2)
    part, ep, batch = np.arange(120) % 5, np.arange(120) % 6, np.arange(120) % 4
    train, cand, val = part < 2, part == 2, part > 2
    got = {r["ep"]: r["score"] for r in G.replay_scores(rows.where("part < 2"), rows.where("part = 2"), rows.where("part > 2"), THETA, inner, back, G.LOGISTIC, optimiser, segment=2).collect()}

    def loss(episode, weight):
        state = I.State(THETA, np.zeros(4), np.zeros(4))
        for step, b in enumerate(I.steps_of(inner, back)):
            use, w = (cand, np.where(ep == episode, weight, 0.0)) if b is None else (train & (batch == b % 4), np.ones(120))
            gradient = (w[use] * G.LOGISTIC.slope(X[use] @ state.t, Y[use])) @ X[use] / use.sum()
            state = I.forward(state, step, gradient, optimiser)
        return G.LOGISTIC.value(X[val] @ state.t, Y[val]).mean()

    assert set(got) == set(range(6))
    for e, score in got.items():
        assert score == pytest.approx((loss(e, 1e-5) - loss(e, -1e-5)) / 2e-5, rel=1e-3, abs=1e-9)
    if inner == 0:
        single = {r["ep"]: r["score"] for r in G.one_step_scores(rows.where("part = 2"), rows.where("part > 2"), THETA, G.LOGISTIC, optimiser).collect()}
        assert single == pytest.approx(got, rel=1e-6)


def test_selection_through_a_trajectory(spark, rows):
    train, cand, val = (rows.where(f"part {p}") for p in ("< 2", "= 2", "> 2"))
    none = spark.createDataFrame([], "ep long")
    for loss in (G.SQUARED, G.LOGISTIC):
        scores, _ = score_and_select(cand, val, THETA, none, training=train, inner=4, back_off=2, loss=loss)
        want = G.replay_scores(train, cand, val, THETA, 4, 2, loss)
        assert dict(map(tuple, scores.collect())) == pytest.approx(dict(map(tuple, want.collect())), rel=1e-6)
    with pytest.raises(ValueError):
        score_and_select(cand, val, THETA, none, inner=4)
