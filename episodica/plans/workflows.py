"""Whole workflows: score and select, aggregate iterations, and the data of a training run."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions import vectors as V
from episodica.functions.text import clean_prompt
from episodica.operators import episodes as E
from episodica.operators import gradients as G
from episodica.operators import influence as I
from episodica.operators import quality as D
from episodica.operators import sampling as S
from episodica.operators import selection as C
from episodica.operators.profile import component_rows, histogram_quantiles, moments
from episodica.plans.config import Workflow, iteration_folder, previous_index
from episodica.sources import files, sinks
from episodica.sources.filetable import FileTable


def score_and_select(frames: DataFrame, validation: DataFrame, theta: Sequence[float], existing: DataFrame, config: Workflow = Workflow(), share: float = 1.0, job: int = 0, training: DataFrame | None = None, inner: int = 0, back_off: int = 1, loss: G.Loss = G.SQUARED) -> tuple[DataFrame, DataFrame]:
    """(scores, selected): candidates are a seeded share of the episodes, scored and merged into the existing selection.

    frames and validation have x and y, frames also ep; existing has ep. With training (x, y, batch) and inner steps scores are replayed through
    that trajectory, without them the candidate step is the only one.
    """
    if inner > 0 and training is None:
        raise ValueError("inner steps need training rows")
    ids = frames.select("ep").distinct()
    E.require_known(existing.select("ep"), ids, "ep")
    chosen = ids if share >= 1 else S.prefix_sample(ids, "ep", S.share_size(ids.count(), share), config.seed + job)
    candidates = frames.join(chosen, "ep", "left_semi")
    if inner <= 0:
        scores = I.one_step_scores(candidates, validation, theta, config.optimiser) if loss is G.SQUARED else G.one_step_scores(candidates, validation, theta, loss, config.optimiser)
    elif loss is G.SQUARED:
        scores = I.replay_scores(training, candidates, validation, theta, inner, back_off, config.optimiser)
    else:
        scores = G.replay_scores(training, candidates, validation, theta, inner, back_off, loss, config.optimiser)
    return scores, C.percentile_select(scores, existing, config.low, config.high)


def aggregate_and_select(scores: DataFrame, available: DataFrame, share: float) -> DataFrame:
    """(ep, score) of the selected episodes: mean of nonzero scores over iterations, then the least share of those available."""
    return C.bottom_k(C.mean_of_nonzero(scores, available), share, available.select("ep").distinct().count())


def split(first_frames: DataFrame, target: Column | str, per_task: int | None, seed: int) -> DataFrame:
    """(split, task, ep): all source episodes, and per_task target episodes of every task (all without a number)."""
    test = F.expr(target) if isinstance(target, str) else target
    chosen = first_frames.where(test)
    chosen = chosen if per_task is None else S.stratified(chosen, "task", "ep", per_task, seed)
    return first_frames.where(~test).withColumn("split", F.lit("source")).unionByName(chosen.withColumn("split", F.lit("target"))).select("split", "task", "ep")


def training_data(source: DataFrame, target: DataFrame, selected: DataFrame, config: Workflow = Workflow(), vector: str = "a") -> tuple[DataFrame, DataFrame]:
    """(draws, statistics): a mixture of episode-first bootstraps of both pools, and statistics over exactly their valid chunks.

    Pools have ep, j, n and a vector; the source is cut to the selected episodes.
    """
    h = config.data.horizon
    pools = [source.join(selected.select("ep"), "ep", "left_semi"), target]
    draws = [S.bootstrap_chunks(E.valid_starts(p, h), config.seed + k).select(F.lit(k).alias("source"), F.col("i").alias("row"), "ep", "j") for k, p in enumerate(pools)]
    pool = draws[0].unionByName(draws[1])
    mixed = S.mixture(pool.sparkSession, [d.count() for d in draws], list(config.data.weights), config.data.mixture_rows, config.seed).join(pool, ["source", "row"])
    frames = pools[0].select("n", "j", vector).unionByName(pools[1].select("n", "j", vector)).where(F.col("n") >= h).withColumn("w", E.chunk_weight(h))
    long = component_rows(frames, vector, "w")
    quantiles = histogram_quantiles(long, "dim", weight="w").groupBy("dim").agg(F.min_by("quantile", "p").alias("q01"), F.max_by("quantile", "p").alias("q99"))
    return mixed.select("i", "source", "ep", "j"), moments(long, "dim", weight="w").join(quantiles, "dim")


def iterate(frames: DataFrame, validation: DataFrame, theta: Sequence[float], base: str, turns: int, config: Workflow = Workflow(), share: float = 1.0, first: int = 0, include: str | None = None) -> str:
    """Scores and selects `turns` times; returns the path of the last index.

    A turn starts from the index that the turn before it left below base, the first one from `include` if given, else from its predecessor's
    or, as turn 0, from all episodes. Every turn leaves scores (Parquet) and include.json in its folder, so a run may be resumed with `first`.
    """
    if turns < 1:
        raise ValueError("at least one turn")
    spark, path = frames.sparkSession, ""
    for turn in range(first, first + turns):
        start = include if turn == first and include else previous_index(base, turn)
        listed = files.load_include_index(spark, start) if start else None
        existing = (frames if listed is None else listed).select("ep").distinct()
        scores, _ = score_and_select(frames, validation, theta, existing, config, share, turn)
        folder = iteration_folder(base, turn)
        sinks.save_scores(scores, f"{folder}/scores")
        kept = spark.read.parquet(f"{folder}/scores")
        path = f"{folder}/include.json"
        sinks.save_include_index(C.percentile_select(kept, existing, config.low, config.high), path, seed=config.seed, turn=turn)
    return path


def iterate_and_prepare(source: DataFrame, target: DataFrame, validation: DataFrame, theta: Sequence[float], base: str, turns: int, config: Workflow = Workflow(), share: float = 1.0, vector: str = "a") -> tuple[DataFrame, DataFrame]:
    """The turns of iterate over the source's episodes, then the training data of what they select."""
    index = iterate(source, validation, theta, base, turns, config, share)
    return training_data(source, target, files.load_include_index(source.sparkSession, index).select("ep"), config, vector)


def repair_table(spark: SparkSession, path: str, bad: Column, summary: str, report: DataFrame | None = None, root: str = "", episodes: Sequence[int] = (), value: str = "v", apply: bool = False, backup: str | None = None) -> DataFrame:
    """(ep, repaired): damaged cells of the listed episodes of a Parquet table are filled from their nearest valid frames.

    Episodes are those a report lists for the root and those given; none at all is an error. Without apply nothing but the JSON summary is written.
    """
    if report is None and not episodes:
        raise ValueError("neither a report nor episodes are given")
    frames = spark.read.parquet(path)
    ids = spark.createDataFrame([(int(e),) for e in episodes], "ep long")
    if report is not None:
        ids = ids.unionByName(D.bad_episodes(report, root).select(F.col("ep").cast("long").alias("ep")))
    ids = ids.distinct()
    if ids.isEmpty():
        raise ValueError(f"no episode of {root} to repair")
    listed = frames.join(ids.withColumn("__listed", F.lit(True)), "ep", "left").withColumn("__bad", bad & F.col("__listed").isNotNull())
    counts = ids.join(listed.where("__bad").groupBy("ep").agg(F.count("*").alias("repaired")), "ep", "left").select("ep", F.coalesce("repaired", F.lit(0)).alias("repaired"))
    rows = [(r["ep"], r["repaired"]) for r in counts.orderBy("ep").collect()]  # a row per listed episode, as the summary file has
    sinks.rewrite(D.repair(listed, value, "__bad").select(*frames.columns), path, backup, apply)
    sinks.write_json(spark, summary, {"root": root or path, "apply": apply, "results": [{"episode_index": e, "num_repaired_cells": n} for e, n in rows]})
    return spark.createDataFrame(rows, "ep long, repaired long")


def repair_files(table: FileTable, bad: Column, values: Sequence[str], episodes: DataFrame | None = None, summary: str | None = None, apply: bool = True, episode: str = "episode_index", index: str = "frame_index") -> tuple[int, DataFrame]:
    """(version, cells): damaged cells of a file table get the value of their episode's nearest valid frame, the earlier one on ties.

    bad is a condition on the row; episodes (ep) limits the search. cells has (__file, __row, episode, index, column, source) for each, source being the frame the value came from.
    Only files with damaged rows are written anew, and together become the next version; the one before stays readable, as a backup, until vacuum. An episode without a valid frame is an
    error. Without apply nothing but the summary is written, and the version is the latest.
    """
    rows = table.read(places=True)
    if episodes is not None:
        rows = rows.join(episodes.select(F.col("ep").alias(episode)).distinct(), episode, "left_semi")
    rows = rows.select("__file", "__row", episode, index, *values, bad.alias("__bad"))
    near = D.nearest_valid(rows.withColumn("__values", F.struct(*values)), "__values", "__bad", episode, index)
    fixes = rows.where("__bad").select("__file", "__row", episode, index).join(near, [episode, index])
    none = F.raise_error(F.concat(F.lit("no valid frame in episode "), F.col(episode).cast("string"))).cast(fixes.schema["source"].dataType)
    fixes = fixes.withColumn("source", F.when(F.col("source").isNull(), none).otherwise(F.col("source")))
    kept = f"{table.root}/_repairs/{uuid.uuid4().hex}"
    fixes.write.parquet(kept)  # once: what is counted, reported and written must be the same
    fixes = table.spark.read.parquet(kept)
    version = table.update(fixes.select("__file", "__row", "__values.*")) if apply else table.latest()
    cells = fixes.select("__file", "__row", episode, index, F.explode(F.array(*(F.lit(v) for v in values))).alias("column"), "source")
    if summary is not None:
        counts = [(r[0], r["n"]) for r in cells.groupBy(episode).agg(F.count("*").alias("n")).orderBy(episode).collect()]
        sinks.write_json(table.spark, summary, {"root": table.root, "apply": apply, "version": version, "results": [{"episode_index": e, "num_repaired_cells": n} for e, n in counts]})
    return version, cells


def statistics_of(statistics: DataFrame, key: str, quantiles: bool = False) -> tuple[Column, Column]:
    """(mean, std) or (q01, q99) of a key as constant vectors; missing ones are an error. A row per dimension reaches the driver."""
    names = ("q01", "q99") if quantiles else ("mean", "std")
    rows = statistics.where(F.col("key") == key).orderBy("dim").select(*names).collect()
    if not rows or any(v is None for r in rows for v in r):
        raise ValueError(f"no {' and '.join(names)} of {key}")
    return V.constants(float(r[0]) for r in rows), V.constants(float(r[1]) for r in rows)


def model_inputs(frames: DataFrame, statistics: DataFrame, width: int, delta_mask: list[bool] | None = None, keep_mask: list[bool] | None = None, quantiles: bool = False, state: str = "state", actions: str | None = "actions", prompt: str = "prompt") -> DataFrame:
    """State, action chunk (None when there is none, as in inference) and prompt as a model takes them.

    The order is fixed: actions relative to the raw state, then both normalised (actions outside keep_mask stay), the prompt cleaned, and vectors
    padded to width. All of it are column expressions of one projection.
    """
    low, high = statistics_of(statistics, state, quantiles)
    norm = V.rescale_quantiles if quantiles else V.standardise
    out = frames
    if actions is not None:
        a_low, a_high = statistics_of(statistics, actions, quantiles)

        def step(a: Column) -> Column:
            moved = V.delta(a, F.col(state), delta_mask) if delta_mask else a
            scaled = norm(moved, a_low, a_high) if quantiles else V.standardise(moved, a_low, a_high, keep_mask)
            return V.pad(scaled, width)

        out = out.withColumn(actions, F.transform(actions, step))
    return out.withColumn(state, V.pad(norm(F.col(state), low, high), width)).withColumn(prompt, clean_prompt(F.col(prompt)))
