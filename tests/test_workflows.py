"""Workflows and nested samples on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions import structs
from episodica.operators import sampling as S
from episodica.operators.episodes import number_frames
from episodica.plans import workflows as W
from episodica.sources import files
from episodica.plans.config import Data, Workflow, iteration_folder, previous_index, with_overrides


def test_config_checks():
    assert with_overrides(Workflow(), seed=7, low=None) == Workflow(seed=7)
    with pytest.raises(ValueError):
        Workflow(data=Data(roots=("a",)))
    with pytest.raises(ValueError):
        Workflow(data=Data(roots=("a", "a")))
    assert previous_index("x/", 0) is None and previous_index("x/", 3) == "x/iter_2/include.json" and iteration_folder("x", 1) == "x/iter_1"


def test_nesting_round_trip(spark):
    df = spark.sql("SELECT 1 AS id, struct(2 AS b, struct(3 AS d) AS c) AS a")
    flat = structs.flatten(df)
    assert flat.columns == ["id", "a/b", "a/c/d"] and structs.nest(flat).schema == df.schema
    assert structs.rename(flat, {r"a/(.)": r"x_\1", "id": None}).columns == ["x_b", "a/c/d"]
    assert structs.repack(flat, {"s": {"k": ["no", "a/b"]}, "id": "id"}).first()["s"]["k"] == 2
    with pytest.raises(KeyError):
        structs.repack(flat, {"x": ["no"]})
    images, masks = structs.camera_slots(F.lit(b"x"), F.lit(None).cast("binary"))
    row = spark.range(1).select(images.alias("i"), masks.alias("m")).first()
    assert row["i"]["right"] is None and tuple(row["m"]) == (True, False, False)


def test_prompt_tokens(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    from episodica.functions.tokens import prompt_tokens

    model = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = prompt_tokens(spark.createDataFrame([(1, " open_the drawer\n"), (2, "word " * 100)], "id int, prompt string"), model).orderBy("id").collect()
    want = [own.bos_id(), *own.encode("open the drawer"), *own.encode("\n")]
    assert rows[0]["tokens"] == want + [0] * (48 - len(want)) and sum(rows[0]["token_mask"]) == len(want)
    assert len(rows[1]["tokens"]) == 48 and all(rows[1]["token_mask"])
    with pytest.raises(Exception, match="a prompt is empty"):
        prompt_tokens(spark.createDataFrame([(" ",)], "prompt string"), model).collect()


def test_score_and_select(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i % 10, rng.normal(size=3).tolist(), float(rng.normal())) for i in range(200)], "ep int, x array<double>, y double")
    scores, selected = W.score_and_select(rows, rows.limit(50), [0.1, 0.2, 0.3], rows.select("ep").distinct())
    by = {r["ep"]: r["score"] for r in scores.collect()}
    high = np.percentile(list(by.values()), 80)
    assert sorted(r["ep"] for r in selected.collect()) == sorted(e for e, s in by.items() if s < high)
    some, _ = W.score_and_select(rows, rows.limit(50), [0.1, 0.2, 0.3], rows.select("ep").distinct(), share=0.3)
    assert some.count() == 3
    twice = scores.unionByName(scores.withColumn("score", F.lit(0.0)))
    assert [r["ep"] for r in W.aggregate_and_select(twice, rows.select("ep"), 0.25).collect()] == sorted(by, key=by.get)[:2]
    with pytest.raises(ValueError):
        S.episode_subset(rows.select("ep").distinct(), "ep", 11)
    assert [r["ep"] for r in S.episode_subset(rows.select("ep").distinct(), "ep", 2).collect()] == [0, 1]


def test_training_data(spark):
    frames = number_frames(spark.range(400).select((F.col("id") % 8).alias("ep"), "id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("a")), "ep", ["id"])
    config = Workflow(data=Data(horizon=15, mixture_rows=500))
    draws, statistics = W.training_data(frames.where("ep < 5"), frames.where("ep >= 5"), frames.where("ep IN (1, 2)").select("ep").distinct(), config)
    rows = draws.collect()
    assert len(rows) == 500 and {r["ep"] for r in rows if r["source"] == 0} <= {1, 2} and all(r["j"] <= 35 for r in rows)
    got = {r["dim"]: r for r in statistics.collect()}
    assert got[0]["rows"] == 5 * 36 * 15 and got[1]["q01"] == got[1]["q99"] == 1.0 and got[0]["q01"] < got[0]["q99"]
    first = frames.where("j = 0").select("ep", (F.col("ep") % 2).alias("task"))
    counts = {tuple(r)[:2]: r["count"] for r in W.split(first, "ep >= 4", 1, 42).groupBy("split", "task").count().collect()}
    assert counts == {("source", 0): 2, ("source", 1): 2, ("target", 0): 1, ("target", 1): 1}


def test_score_arrays_and_index_vectors(spark, tmp_path):
    import numpy as np
    import pytest

    from episodica.sources.files import load_include_index, load_scores, load_tasks
    from episodica.sources.sinks import rewrite, save_score_arrays, write_json

    scores = spark.createDataFrame([(3, -0.5), (0, 0.25), (7, 0.0), (5, None)], "ep long, score double")
    save_score_arrays(scores, f"{tmp_path}/iter_0", 9)
    dense = np.load(f"{tmp_path}/iter_0/datamodels.npy")
    assert dense.tolist() == [0.25, 0, 0, -0.5, 0, 0, 0, 0, 0]
    assert sorted(map(tuple, load_scores(spark, [f"{tmp_path}/iter_0"]).collect())) == [(0, 0, 0.25), (0, 3, -0.5)]
    (tmp_path / "other").mkdir()
    np.save(tmp_path / "other" / "strange.npy", dense)
    with pytest.raises(FileNotFoundError):
        load_scores(spark, [f"{tmp_path}/other"])
    np.save(tmp_path / "index.npy", np.array([4, 2, 4]))
    assert [tuple(r) for r in load_include_index(spark, f"{tmp_path}/index.npy").orderBy("pos").collect()] == [(0, 4), (1, 2), (2, 4)]
    (tmp_path / "tasks.jsonl").write_text('{"task_index": 1, "task": null, "name": "not this"}\n{"index": 2, "name": "second"}\n')
    assert sorted(map(tuple, load_tasks(spark, f"{tmp_path}/tasks.jsonl").collect())) == [(1, None), (2, "second")]
    for value in (1, 2):
        write_json(spark, f"{tmp_path}/x.json", value)
    assert (tmp_path / "x.json").read_text() == "2" and not list(tmp_path.glob("*.tmp"))
    scores.write.parquet(f"{tmp_path}/t")
    for _ in range(2):
        assert rewrite(spark.read.parquet(f"{tmp_path}/t").limit(2), f"{tmp_path}/t", backup=f"{tmp_path}/backup", apply=True) == 2
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2 and spark.read.parquet(f"{tmp_path}/backup").count() == 4
    assert sorted(p.name for p in tmp_path.iterdir() if "tmp" in p.name) == []


def test_iterations_chain(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i % 10, rng.normal(size=3).tolist(), float(rng.normal())) for i in range(200)], "ep long, x array<double>, y double")
    theta, base = [0.1, 0.2, 0.3], str(tmp_path / "runs")
    last = W.iterate(rows, rows.limit(50), theta, base, 2)
    first = set(r["ep"] for r in files.load_include_index(spark, f"{base}/iter_0/include.json").collect())
    _, want = W.score_and_select(rows, rows.limit(50), theta, spark.createDataFrame([(e,) for e in first], "ep long"), Workflow(), 1.0, 1)
    assert last == f"{base}/iter_1/include.json" and {r["ep"] for r in files.load_include_index(spark, last).collect()} == {r["ep"] for r in want.collect()}
    with pytest.raises(ValueError):
        W.iterate(rows, rows, theta, base, 0)


def test_repair_table(spark, tmp_path):
    path, summary = str(tmp_path / "t"), str(tmp_path / "summary.json")
    spark.createDataFrame([(e, j, None if (e, j) in ((1, 1), (2, 0)) else 10.0 * e + j) for e in (1, 2) for j in range(4)], "ep long, j int, v double").write.parquet(path)
    report = spark.sql("SELECT array(struct('r' AS root, array(1L) AS bad_episode_indices)) AS reports")
    bad = F.col("v").isNull()
    assert [tuple(r) for r in W.repair_table(spark, path, bad, summary, report, "r").collect()] == [(1, 1)]
    assert spark.read.parquet(path).where(bad).count() == 2
    assert [tuple(r) for r in W.repair_table(spark, path, bad, summary, report, "r", [2], apply=True, backup=str(tmp_path / "b")).orderBy("ep").collect()] == [(1, 1), (2, 1)]
    got = {(r["ep"], r["j"]): r["v"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 8 and got[1, 1] == 10.0 and got[2, 0] == 21.0 and spark.read.parquet(str(tmp_path / "b")).where(bad).count() == 2
    assert json.loads((tmp_path / "summary.json").read_text())["apply"]
    with pytest.raises(ValueError):
        W.repair_table(spark, path, bad, summary)


def test_model_inputs(spark):
    stats = spark.createDataFrame([(k, d, 1.0, 2.0, 0.0, 4.0) for k in ("state", "actions") for d in range(2)], "key string, dim int, mean double, std double, q01 double, q99 double")
    rows = spark.sql("SELECT array(1D, 3D) AS state, array(array(4D, 5D), array(1D, 1D)) AS actions, ' open_it\n' AS prompt")
    got = W.model_inputs(rows, stats, 3, delta_mask=[True, False]).first()
    assert np.allclose(got["state"], [0, 1, 0], atol=1e-5) and np.allclose(got["actions"], [[1, 2, 0], [-0.5, 0, 0]], atol=1e-5) and got["prompt"] == "open it"
    assert np.allclose(W.model_inputs(rows, stats, 2, quantiles=True, actions=None).first()["state"], [-0.5, 0.5], atol=1e-5)
    with pytest.raises(ValueError):
        W.model_inputs(rows, stats.withColumn("q01", F.lit(None).cast("double")), 2, quantiles=True)


def test_statistics_of_a_checkpoint(spark, tmp_path):
    at = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        files.find_statistics(spark, at)
    for name in ("a", "b"):
        (tmp_path / "assets" / name).mkdir(parents=True)
    (tmp_path / "assets/a/norm_stats.json").write_text("{}")
    assert files.find_statistics(spark, at).endswith("assets/a/norm_stats.json") and files.find_statistics(spark, at, "x") == "x"
    (tmp_path / "assets/b/norm_stats.json").write_text("{}")
    with pytest.raises(ValueError):
        files.find_statistics(spark, at)
    (tmp_path / "norm_stats_info.json").write_text('{"checkpoint_relative_path": "assets/b/norm_stats.json"}')
    assert files.find_statistics(spark, at).endswith("assets/b/norm_stats.json")
    assert files.load_model_config(spark, at, ("width",)) == ({}, None)
    (tmp_path / "metadata.json").write_text('{"config": {"model": {"width": 4, "other": 1}, "data": {"action_normalization_mask": [1, 0]}}}')
    assert files.load_model_config(spark, at, ("width", "kind"), kind="x") == ({"width": 4, "kind": "x"}, [True, False])
