"""The .npy data source, repairs through file tables, and nulls in statistics and chunks."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions import vectors as V
from episodica.operators import episodes as E
from episodica.operators import evaluate as Q
from episodica.operators import influence as I
from episodica.operators import profile as P
from episodica.plans import workflows as W
from episodica.sources import files, sinks
from episodica.sources.datasets import write_dataset
from episodica.sources.filetable import FileTable
from episodica.sources.npy import read_npy, write_npy


@pytest.mark.parametrize("kind", ["<f8", "<f4", ">f8", "<i4", ">i8", "|u1", "|b1"])
@pytest.mark.parametrize("shape", [(7,), (7, 3), (0,), (200_000, 2)])
@pytest.mark.parametrize("order", "CF")
def test_read_equals_numpy(spark, tmp_path, kind, shape, order):
    if (shape[0] > 7 and kind not in ("<f8", ">i8")) or (len(shape) == 1 and order == "F"):
        pytest.skip("as the others")
    want = np.asarray(np.random.default_rng(1).integers(0, 100, shape), kind, order=order)
    np.save(tmp_path / "x.npy", want)
    got = read_npy(spark, [str(tmp_path / "x.npy")], rows=3 if shape[0] < 10 else 70_001).orderBy("i").toPandas()
    assert got.columns.tolist() == ["file", "i", *([f"c{c}" for c in range(shape[1])] if len(shape) == 2 else ["value"])]
    assert np.array_equal(got.iloc[:, 2:].to_numpy().reshape(shape), want) and got["i"].tolist() == list(range(shape[0]))


def test_odd_files_are_errors(spark, tmp_path):
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    np.save(tmp_path / "names.npy", np.array(["a"]))
    np.save(tmp_path / "one.npy", np.zeros(3))
    np.save(tmp_path / "two.npy", np.zeros((3, 2)))
    for names in (["cube"], ["names"], ["one", "two"]):
        with pytest.raises(Exception, match="not numbers|same width"):
            read_npy(spark, [f"{tmp_path}/{n}.npy" for n in names]).collect()
    (tmp_path / "cut.npy").write_bytes((tmp_path / "one.npy").read_bytes()[:-4])
    with pytest.raises(Exception, match="cut short"):
        read_npy(spark, [f"{tmp_path}/cut.npy"]).collect()


def test_write_dense_and_pairs(spark, tmp_path):
    at = str(tmp_path / "x.npy")
    rows = spark.createDataFrame([(5, 1.5), (0, float("nan")), (1_200_000, -2.0), (1_200_001, 3.0)], "ep long, s double").repartition(3)
    write_npy(rows, at, "ep", "s", 1_300_000)
    got = np.load(at)
    assert got.shape == (1_300_000,) and np.flatnonzero(got).tolist() == [0, 5, 1_200_000, 1_200_001] and np.isnan(got[0]) and got[5] == 1.5
    write_npy(rows, at, "ep", "s")
    assert np.load(at)[:, 0].tolist() == [0, 5, 1_200_000, 1_200_001] and os.listdir(tmp_path) == ["x.npy"]
    for bad, length in ((rows.union(rows), 1_300_000), (rows, 10), (rows.withColumn("s", F.lit(None).cast("double")), None)):
        with pytest.raises(Exception, match="places|place and a value"):
            write_npy(bad, at, "ep", "s", length)
    assert len(np.load(at)) == 4 and os.listdir(tmp_path) == ["x.npy"]
    write_npy(rows.where("false"), at, "ep", "s", 3)
    assert np.load(at).tolist() == [0, 0, 0]


def test_ten_million_scores(spark, tmp_path):
    """Round trip of a long vector; what the driver's Python holds doesn't grow with it."""
    import tracemalloc

    n = 10_000_000
    scores = spark.range(0, n, 1, 4).select(F.col("id").alias("ep"), (F.col("id") % 1000 / 8.0).alias("score"))
    tracemalloc.start()
    write_npy(scores, f"{tmp_path}/iter_0/{files.DENSE}", "ep", "score", n)
    got = files.load_scores(spark, [f"{tmp_path}/iter_0"]).agg(F.count("*"), F.sum("score"), F.sum(F.col("ep") * (F.col("score") * 8).cast("long"))).first()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = scores.agg(F.count_if(F.col("score") != 0), F.sum("score"), F.sum(F.col("ep") * (F.col("score") * 8).cast("long"))).first()
    assert tuple(got) == tuple(want) and peak < 20e6


def test_settings_and_split_files(spark, tmp_path):
    sinks.save_score_arrays(spark.createDataFrame([(1, 0.5), (2, None)], "ep long, score double"), f"{tmp_path}/a", 4, settings={"seed": 3})
    assert json.loads((tmp_path / "a/config.json").read_text()) == {"seed": 3} and np.load(tmp_path / "a" / files.DENSE).tolist() == [0, 0.5, 0, 0]
    split = sinks.save_split(spark.createDataFrame([(4, "b"), (1, "a"), (2, "b"), (2, "b"), (3, None)], "ep long, task string"), f"{tmp_path}/split.json", seed=7)
    assert json.loads((tmp_path / "split.json").read_text()) == split
    assert split["episode_indices"] == [1, 2, 3, 4] and split["num_episodes"] == 4 and split["episodes_per_task"] == {"": 1, "a": 1, "b": 2} and split["seed"] == 7


def test_repair_writes_only_damaged_files(spark, tmp_path):
    rows = spark.createDataFrame([(e, j, "t", None if (e, j) in ((3, 0), (3, 2), (9, 3)) else 10.0 * e + j) for e in range(12) for j in range(4)], "ep long, j int, task string, v double")
    write_dataset(rows, str(tmp_path / "set"))
    table = FileTable(spark, str(tmp_path / "set"))
    table.adopt()
    bad, summary = F.col("v").isNull(), str(tmp_path / "summary.json")
    version, cells = W.repair_files(table, bad, ["v"], summary=summary, apply=False)
    assert version == 1 and cells.count() == 3 and json.loads((tmp_path / "summary.json").read_text())["results"] == [{"episode_index": 3, "num_repaired_cells": 2}, {"episode_index": 9, "num_repaired_cells": 1}]
    assert W.repair_files(table, bad, ["v"], spark.createDataFrame([(3,)], "ep long"))[0] == 2
    got = {(r["episode_index"], r["frame_index"]): r["v"] for r in table.read().collect()}
    assert got[3, 0] == got[3, 2] == 31.0 and got[9, 3] is None and len(got) == 48
    assert [r["path"] for r in table.files().collect() if "_changes" in r["path"]] == [r["path"] for r in table.files().collect() if r["path"].endswith("episode_000003.parquet")]
    assert table.read(1).where(bad).count() == 3
    with pytest.raises(Exception, match="no valid frame"):
        W.repair_files(table, F.lit(True), ["v"])
    assert table.versions() == [1, 2]


def test_nulls_in_statistics_and_chunks(spark):
    values = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", None), ("c", 5.0)], "k string, x double")
    got = {r["k"]: r for r in P.moments(values, "k").collect()}
    assert set(got) == {"a", "c"} and (got["a"]["rows"], got["a"]["mean"], got["a"]["std"], got["a"]["hi"]) == (2, 1.5, 0.5, 2.0)
    quantiles = {(r["k"], r["p"]): r["quantile"] for r in P.histogram_quantiles(values, "k", probabilities=(0.5, 1.0)).collect()}
    assert quantiles["a", 0.5] == 1.0 and quantiles["a", 1.0] == pytest.approx(2.0, abs=1e-3) and quantiles["c", 0.5] == 5.0 and len(quantiles) == 4
    nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "x double")
    assert P.histogram_quantiles(nan, probabilities=(0.5,)).first()["quantile"] == 1.0 and np.isnan(P.moments(nan).first()["mean"])
    frames = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0), (1, 0, None)], "ep long, j int, v double")
    chunk = {(r["ep"], r["j"]): r["chunk"] for r in E.chunks(frames, "v", 3).collect()}
    assert chunk == {(0, 0): [1.0, None, 3.0], (0, 1): [None, 3.0, 3.0], (0, 2): [3.0] * 3, (1, 0): [None] * 3}


def test_lengths_that_do_not_fit(spark):
    one = spark.sql("SELECT CAST(array() AS array<double>) AS none, array(1D, 2D) AS two, array(array(1D)) AS p, array(array(1D, 2D)) AS a")
    assert one.select(V.standardise(F.col("none"), V.constants([1.0, 2.0]), V.constants([1.0, 1.0]), [True]).alias("z")).first()["z"] == []
    assert one.select(V.standardise(F.col("two"), V.constants([1.0, 1.0]), V.constants([1.0, 1.0]), [False, True]).alias("z")).first()["z"] == [1.0, pytest.approx(1.0, abs=1e-5)]
    with pytest.raises(Exception, match="differ in length"):
        Q.chunk_errors(one, "p", "a").collect()
    with pytest.raises(Exception, match="no validation rows"):
        Q.validation_loss(one.limit(0).withColumn("l", F.lit(1.0)), "l").collect()
    batches = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0), (2, 100.0)], "batch long, l double")
    assert tuple(Q.validation_loss(batches, "l", "batch", 2).first()) == (3.0, 3)
    with pytest.raises(ValueError):
        I.trajectory(10, 0)
