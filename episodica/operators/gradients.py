"""What episodes are worth under losses without closed sums: gradients and Hessian products by passes over rows, without a matrix.

The loss of a row is a function of its margin x.t and its target. The gradient is a sum of slope * x, the Hessian times a vector v a sum of
curvature * (x.v) * x, so a pass needs the parameters and one more vector in every task; a task adds up its rows and hands on one vector, and
the driver holds vectors alone. Rows without features, target or weight take no part; vectors of another width or with nulls in them are an error.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.operators.influence import Optimiser, cotangents_of, steps_of

#: A function of margins and targets.
Rule = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Loss:
    """A loss of margin and target, with its first and second derivative by the margin."""

    value: Rule
    slope: Rule
    curvature: Rule


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * m))


SQUARED = Loss(lambda m, y: (m - y) ** 2, lambda m, y: 2 * (m - y), lambda m, y: np.full(len(m), 2.0))
#: Targets are 0 or 1 (or between).
LOGISTIC = Loss(lambda m, y: np.logaddexp(0, m) - m * y, lambda m, y: _sigmoid(m) - y, lambda m, y: _sigmoid(m) * _sigmoid(-m))


def huber(width: float = 1.0) -> Loss:
    """Squared up to a width, linear beyond it."""
    return Loss(
        lambda m, y: np.where(np.abs(m - y) <= width, 0.5 * (m - y) ** 2, width * (np.abs(m - y) - 0.5 * width)),
        lambda m, y: np.clip(m - y, -width, width),
        lambda m, y: (np.abs(m - y) <= width).astype(float),
    )


def _chosen(rows: DataFrame, x: str, y: str, weight: str | None, *more: str) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    out = rows.select(F.col(x).cast("array<double>").alias("__x"), F.col(y).cast("double").alias("__y"), w.cast("double").alias("__w"), *more)
    return out.where(F.col("__x").isNotNull() & F.col("__y").isNotNull() & F.col("__w").isNotNull())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch's vectors as a matrix, without a copy."""
    flat = column.flatten()
    if len(flat) != len(column) * width or flat.null_count or np.any(np.diff(column.offsets.to_numpy()) != width):
        raise ValueError(f"every vector must have {width} numbers and no nulls")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), width)


def partial_sums(rows: DataFrame, theta: Sequence[float], loss: Loss, direction: Sequence[float] | None = None, x: str = "x", y: str = "y", weight: str | None = None) -> DataFrame:
    """(s, rows): a row per task with its sum of gradients, or of Hessians times the direction."""
    t, v = np.asarray(theta, float), None if direction is None else np.asarray(direction, float)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(len(t)), 0
        for batch in batches:
            xs, ys, w = _matrix(batch.column(0), len(t)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            margin = xs @ t
            factor = loss.slope(margin, ys) if v is None else loss.curvature(margin, ys) * (xs @ v)
            total, count = total + (w * factor) @ xs, count + len(ys)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64())), pa.array([count], pa.int64())], ["s", "rows"])

    return _chosen(rows, x, y, weight).mapInArrow(add, "s array<double>, rows long")


def mean_sum(rows: DataFrame, theta: Sequence[float], loss: Loss, direction: Sequence[float] | None = None, x: str = "x", y: str = "y", weight: str | None = None) -> np.ndarray:
    """The mean loss's gradient, or its Hessian times the direction: a number per dimension reaches the driver. Without rows it is zero."""
    parts = partial_sums(rows, theta, loss, direction, x, y, weight).select(F.posexplode("s").alias("d", "v"), "rows")
    out, n = np.zeros(len(theta)), 1
    for r in parts.groupBy("d").agg(F.sum("v").alias("v"), F.sum("rows").alias("rows")).collect():
        out[r["d"]], n = r["v"], r["rows"]
    return out / n


def mean_loss(rows: DataFrame, theta: Sequence[float], loss: Loss, x: str = "x", y: str = "y", steps: int | None = None, batch: str = "batch") -> float:
    """The mean loss at theta, of the first `steps` batches if given; of no rows it is an error."""
    t = np.asarray(theta, float)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            losses = loss.value(_matrix(own.column(0), len(t)) @ t, own.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([float(losses.sum())]), pa.array([len(losses)], pa.int64())], ["s", "rows"])

    used = rows if steps is None else rows.where((F.col(batch) >= 0) & (F.col(batch) < steps))
    total = _chosen(used, x, y, None).mapInArrow(add, "s double, rows long").agg(F.sum("s").alias("s"), F.sum("rows").alias("rows")).first()
    if not total["rows"]:
        raise ValueError("no rows to validate on")
    return total["s"] / total["rows"]


def episode_dots(rows: DataFrame, theta: Sequence[float], direction: Sequence[float], loss: Loss, episode: str = "ep", x: str = "x", y: str = "y") -> DataFrame:
    """(episode, score): sum over the episode's rows of <direction, gradient>, divided by the number of all rows that take part."""
    t, v = np.asarray(theta, float), np.asarray(direction, float)
    kind = rows.schema[episode].dataType.simpleString()

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = _matrix(batch.column(0), len(t))
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(loss.slope(xs @ t, batch.column(1).to_numpy()) * (xs @ v))], ["e", "s"])

    sums = _chosen(rows, x, y, None, episode).mapInArrow(dots, f"e {kind}, s double").groupBy("e").agg(F.sum("s").alias("s"))
    total = _chosen(rows, x, y, None).count()
    return sums.select(F.col("e").alias(episode), (F.col("s") / max(1, total)).alias("score"))


def one_step_scores(candidates: DataFrame, validation: DataFrame, theta: Sequence[float], loss: Loss, optimiser: Optimiser = Optimiser(), episode: str = "ep") -> DataFrame:
    """Scores when the candidate step is the only one: its gradient is zero at weight zero, so the root epsilon alone scales it."""
    after = np.asarray(theta, float) * (1 - optimiser.rate * optimiser.decay)
    direction = -optimiser.rate / np.sqrt(optimiser.eps_root) * mean_sum(validation, after, loss)
    return episode_dots(candidates, theta, direction, loss, episode)


def replay_scores(training: DataFrame, candidates: DataFrame, validation: DataFrame, theta: Sequence[float], inner: int, back_off: int, loss: Loss, optimiser: Optimiser = Optimiser(), episode: str = "ep", weight: str | None = None, segment: int = 25) -> DataFrame:
    """(episode, score) through a whole trajectory, as influence.replay_scores, for any loss.

    A step reads its batch once forwards, once more when its segment is replayed, and once for its Hessian product, so training should be kept
    or laid out by batch. The driver holds a segment's states and gradients: some vectors for each of its steps.
    """
    plan, batches = steps_of(inner, back_off), training.agg(F.count_distinct("batch")).first()[0]

    def part(first: int, last: int):
        def rows(step: int) -> DataFrame:
            return training.where(F.col("batch") == plan[step] % batches)

        def gradient(step: int, t: np.ndarray) -> np.ndarray:
            return np.zeros(len(t)) if plan[step] is None else mean_sum(rows(step), t, loss, weight=weight)

        def product(step: int, t: np.ndarray, v: np.ndarray) -> np.ndarray:
            return np.zeros(len(t)) if plan[step] is None else mean_sum(rows(step), t, loss, v, weight=weight)

        return gradient, product

    at, direction = cotangents_of(plan, theta, part, lambda t: mean_sum(validation, t, loss), optimiser, segment)
    return episode_dots(candidates, at, direction, loss, episode)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
