"""What episodes are worth to a linear model: the derivative of the validation loss by an episode's weight.

Rows have a feature vector x and a target y; the loss is (x.t - y)^2, so gradients and Hessians are closed forms: Spark sums over rows, and the
driver keeps the optimiser's state of a few dozen numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.vectors import constants, dot


@dataclass(frozen=True)
class Optimiser:
    """Adam with the root epsilon inside the square root. The defaults."""

    rate: float = 2.5e-5 / 401
    b1: float = 0.9
    b2: float = 0.95
    eps_root: float = 1e-8
    decay: float = 1e-10

    def momenta(self, step: int) -> tuple[float, float]:
        b1 = self.b1 * min(1.0, 0.85 + 0.15 * step / 25)
        return b1, 1 - (1 - b1) * (1 - self.b2) / (1 - self.b1)


def trajectory(inner: int, back_off: int) -> tuple[int, int, int]:
    """(steps in all, steps before the candidate step, steps after it); one that begins behind its end is an error."""
    if back_off <= 0:
        raise ValueError("the back-off must be positive")
    if inner <= 0:
        return 1, 0, 0
    before = max(0, inner - back_off)
    return inner, before, inner - before - 1


def save_points(total: int, segment: int) -> list[int]:
    """0, segment, 2 segment, ... and total."""
    if segment <= 0:
        raise ValueError("the segment must be positive")
    return [*range(0, total, segment), total]


def trajectory_columns(inner: Column, back_off: int) -> tuple[Column, Column, Column]:
    """trajectory() for a column of lengths."""
    total, before, after = trajectory(1, back_off)[0], F.greatest(F.lit(0), inner - back_off), F.lit(0)
    some = inner > 0
    return F.when(some, inner).otherwise(total), F.when(some, before).otherwise(0), F.when(some, inner - before - 1).otherwise(after)


def save_point_steps(total: Column, segment: int) -> Column:
    """save_points() for a column of lengths, as an array."""
    if segment <= 0:
        raise ValueError("the segment must be positive")
    own = F.when(total > 0, F.sequence(F.lit(0).cast("long"), total.cast("long") - 1, F.lit(segment).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(own, F.array(total.cast("long")))


def regular_batch(step: Column, candidate_step: int | Column) -> Column:
    """The batch of a regular step: the candidate step uses none, so later ones are one behind."""
    return F.when(step > candidate_step, step - 1).otherwise(step)


def gradient_dot(x: Column, y: Column, theta: Sequence[float], direction: Sequence[float]) -> Column:
    """<direction, gradient of a row's loss at theta>."""
    return 2 * (dot(x, constants(map(float, theta))) - y) * dot(x, constants(map(float, direction)))


def mean_gradient(rows: DataFrame, theta: Sequence[float], x: str = "x", y: str = "y") -> np.ndarray:
    """Gradient of the mean loss; a row per component reaches the driver."""
    residual = rows.select(x, (2 * (dot(F.col(x), constants(map(float, theta))) - F.col(y))).alias("r"))
    parts = residual.select(F.posexplode(x).alias("d", "v"), "r").groupBy("d").agg(F.avg(F.col("v") * F.col("r")).alias("g")).collect()
    out = np.zeros(len(theta))
    for row in parts:
        out[row["d"]] = row["g"]
    return out


def episode_dots(rows: DataFrame, theta: Sequence[float], direction: Sequence[float], episode: str = "ep", x: str = "x", y: str = "y") -> DataFrame:
    """(episode, score): sum over the episode's rows of <direction, gradient>, divided by the number of all rows."""
    sums = rows.groupBy(episode).agg(F.sum(gradient_dot(F.col(x), F.col(y), theta, direction)).alias("s"), F.count("*").alias("rows"))
    total = rows.count()
    return sums.select(episode, (F.col("s") / max(1, total)).alias("score"))


def one_step_scores(candidates: DataFrame, validation: DataFrame, theta: Sequence[float], optimiser: Optimiser = Optimiser(), episode: str = "ep") -> DataFrame:
    """Scores when the candidate step is the only one: its gradient is zero at weight zero, so the root epsilon alone scales it."""
    after = np.asarray(theta, float) * (1 - optimiser.rate * optimiser.decay)
    direction = -optimiser.rate / np.sqrt(optimiser.eps_root) * mean_gradient(validation, after)
    return episode_dots(candidates, theta, direction, episode)


def batch_sums(rows: DataFrame, batch: str = "batch", x: str = "x", y: str = "y", weight: str | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """Per batch: sum w x x', sum w x y, rows. Every task adds up its own rows first, so what is shuffled depends on tasks and batches, not on rows."""

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in parts:
            for name, own in pdf.groupby("batch"):
                xs, ys, w = np.stack(own["x"].to_numpy()).astype(float), own["y"].to_numpy(float), own["w"].to_numpy(float)[:, None]
                sums = np.concatenate([((xs * w).T @ xs).ravel(), (xs * w).T @ ys, [len(ys)]])
                held[name] = held[name] + sums if name in held else sums
        for name, sums in held.items():
            yield pd.DataFrame({"batch": [name], "s": [sums]})

    w = F.col(weight) if weight else F.lit(1.0)
    chosen = rows.select(F.col(batch).cast("long").alias("batch"), F.col(x).alias("x"), F.col(y).cast("double").alias("y"), w.cast("double").alias("w"))
    parts = chosen.mapInPandas(add, "batch long, s array<double>").select("batch", F.posexplode("s").alias("i", "v"))
    whole = parts.groupBy("batch", "i").agg(F.sum("v").alias("v")).groupBy("batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("s"))
    out = {}
    for r in whole.collect():
        s = np.array(r["s"])
        d = int((np.sqrt(4 * len(s) - 3) - 1) / 2 + 0.5)
        out[r["batch"]] = s[: d * d].reshape(d, d), s[d * d : -1], int(s[-1])
    return out


@dataclass
class State:
    """Parameters and both moments before a step."""

    t: np.ndarray
    mu: np.ndarray
    nu: np.ndarray


def forward(state: State, step: int, gradient: np.ndarray, optimiser: Optimiser) -> State:
    """The state after a step."""
    b1, b2 = optimiser.momenta(step)
    mu, nu = b1 * state.mu + (1 - b1) * gradient, b2 * state.nu + (1 - b2) * gradient * gradient
    m, v = mu / (1 - b1 ** (step + 1)), nu / (1 - b2 ** (step + 1)) + optimiser.eps_root
    return State(state.t - optimiser.rate * (m / np.sqrt(v) + optimiser.decay * state.t), mu, nu)


def backward(after: State, cotangent: State, step: int, gradient: np.ndarray, product: Callable[[np.ndarray], np.ndarray], optimiser: Optimiser) -> tuple[State, np.ndarray]:
    """The cotangent before a step, and that of its gradient, from the state and the cotangent after it; product multiplies by the step's Hessian."""
    b1, b2 = optimiser.momenta(step)
    fix1, fix2 = 1 - b1 ** (step + 1), 1 - b2 ** (step + 1)
    m, v = after.mu / fix1, after.nu / fix2 + optimiser.eps_root
    dmu = cotangent.mu - optimiser.rate * cotangent.t / np.sqrt(v) / fix1
    dnu = cotangent.nu + optimiser.rate * cotangent.t * m * 0.5 * v**-1.5 / fix2
    own = (1 - b1) * dmu + (1 - b2) * 2 * gradient * dnu
    return State(cotangent.t * (1 - optimiser.rate * optimiser.decay) + product(own), b1 * dmu, b2 * dnu), own


def steps_of(inner: int, back_off: int) -> list[int | None]:
    """The batch of every step of a trajectory; the candidate step has none."""
    _, before, after = trajectory(inner, back_off)
    return [*range(before), None, *range(before, before + after)]


def cotangents_of(plan: list[int | None], theta: Sequence[float], part: Callable, last_gradient: Callable[[np.ndarray], np.ndarray], optimiser: Optimiser, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """(parameters at the candidate step, direction that its rows' gradients are met with), by a run forwards and one backwards.

    part(first, last) gives a segment's gradient(step, t) and Hessian product(step, t, v); last_gradient is that of the validation loss. States are kept at
    the ends of segments only; a segment is run again before it is replayed.
    """
    zero, ends = np.zeros(len(theta)), save_points(len(plan), segment)
    state, saved = State(np.asarray(theta, float), zero, zero), []
    for first, last in pairwise(ends):
        saved.append(state)
        gradient, _ = part(first, last)
        for step in range(first, last):
            state = forward(state, step, gradient(step, state.t), optimiser)
    cotangent = State(last_gradient(state.t), zero, zero)
    for (first, last), start in zip(reversed(list(pairwise(ends))), reversed(saved), strict=True):
        (gradient, product), states, gradients = part(first, last), [start], []
        for step in range(first, last):
            gradients.append(gradient(step, states[-1].t))
            states.append(forward(states[-1], step, gradients[-1], optimiser))
        for step in reversed(range(first, last)):
            at = states[step - first].t
            cotangent, direction = backward(states[step - first + 1], cotangent, step, gradients[step - first], partial(product, step, at), optimiser)
            if plan[step] is None:
                return at, direction
    raise AssertionError("a plan has a candidate step")


def replay_scores(training: DataFrame, candidates: DataFrame, validation: DataFrame, theta: Sequence[float], inner: int, back_off: int, optimiser: Optimiser = Optimiser(), episode: str = "ep", weight: str | None = None, segment: int = 25) -> DataFrame:
    """(episode, score) through a whole trajectory: training steps, the candidate step at weight zero, more steps, then all of it backwards.

    training has a batch number for each step (weights, if given, are those of its rows). The backward pass is exact: a step's
    Jacobian needs the batch's sum of x x' alone. A segment's sums are computed when it is run and again when it is replayed backwards,
    so the driver holds a segment's matrices at a time.
    """
    plan, batches = steps_of(inner, back_off), training.agg(F.count_distinct("batch")).first()[0]

    def part(first: int, last: int):
        wanted = sorted({b % batches for b in plan[first:last] if b is not None})
        sums = batch_sums(training.where(F.col("batch").isin(wanted)), weight=weight) if wanted else {}

        def gradient(step: int, t: np.ndarray) -> np.ndarray:
            if plan[step] is None:
                return np.zeros(len(t))
            a, b, n = sums[plan[step] % batches]
            return 2 * (a @ t - b) / n

        def product(step: int, t: np.ndarray, v: np.ndarray) -> np.ndarray:
            if plan[step] is None:
                return np.zeros(len(t))
            a, _, n = sums[plan[step] % batches]
            return 2 * a @ v / n

        return gradient, product

    at, direction = cotangents_of(plan, theta, part, lambda t: mean_gradient(validation, t), optimiser, segment)
    return episode_dots(candidates, at, direction, episode)
