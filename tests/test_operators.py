"""Edge cases of the operators, properties, and files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions import text as X
from episodica.functions import vectors as V
from episodica.functions.hashing import draw_key
from episodica.operators import episodes as E
from episodica.operators import evaluate as Q
from episodica.operators import influence as I
from episodica.operators import profile as P
from episodica.operators import quality as D
from episodica.operators import sampling as S
from episodica.operators import selection as C
from episodica.sources import files, sinks
from episodica.streaming import streams as R


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def episode_rows(spark, lengths):
    return E.number_frames(spark.createDataFrame([(e, i, float(10 * e + i)) for e, n in enumerate(lengths) for i in range(n)], "ep long, t long, v double"), "ep", ["t"])


def test_chunks_repeat_the_last_row(spark):
    rows = E.chunks(episode_rows(spark, [4]), "v", 5).orderBy("j").collect()
    assert rows[2]["chunk"] == [2, 3, 3, 3, 3] and rows[0]["chunk"] == [0, 1, 2, 3, 3]


def test_valid_starts_and_weights(spark):
    rows = episode_rows(spark, [14, 15, 16, 40])
    starts = {r["ep"]: r["c"] for r in E.valid_starts(rows, 15).groupBy("ep").agg(F.count("*").alias("c")).collect()}
    assert starts == {1: 1, 2: 2, 3: 26}
    weighted = P.moments(rows.where("n >= 15").withColumn("x", F.col("v")).withColumn("w", E.chunk_weight(15)), weight="w").first()
    exploded = P.moments(E.valid_starts(E.chunks(rows, "v", 15), 15).select(F.explode("chunk").alias("x"))).first()
    assert weighted["rows"] == exploded["rows"] and weighted["mean"] == pytest.approx(exploded["mean"]) and weighted["std"] == pytest.approx(exploded["std"])


def test_histogram_quantiles_equal_numpy(spark):
    x = np.random.default_rng(0).normal(size=3000)
    got = {r["p"]: r["quantile"] for r in P.histogram_quantiles(spark.createDataFrame([(float(v),) for v in x], "x double"), probabilities=(0.01, 0.5, 0.99)).collect()}
    counts, edges = np.histogram(x, bins=5000)
    for p, q in got.items():
        assert q == pytest.approx(edges[np.searchsorted(np.cumsum(counts), p * len(x))])
    assert P.histogram_quantiles(spark.createDataFrame([(0.0,)] * 4, "x double")).first()["quantile"] == 0.0


def test_percentile_selection(spark):
    def select(scores, existing):
        s = spark.createDataFrame(list(scores.items()), "ep long, score double")
        return sorted(r["ep"] for r in C.percentile_select(s, spark.createDataFrame([(e,) for e in existing], "ep long")).collect())

    assert select({0: -2.0, 1: -1.0, 2: 0.0, 3: 1.0, 4: 2.0}, [3, 4]) == [0, 3]
    assert select({0: 0.0, 1: 1.0, 2: 2.0}, []) == [0, 1]
    assert select({0: 0.0, 1: 0.0}, [1, 9]) == [1, 9]
    assert select({0: -2.0, 1: 2.0}, [9]) == [0, 9]


def test_bottom_k_and_means(spark):
    rows = spark.createDataFrame([(e, float(e % 7)) for e in range(135)], "ep long, score double")
    assert C.bottom_k(rows, 0.1, 135).count() == 13 and C.bottom_k(rows, 0.001, 135).count() == 1 and C.bottom_k(rows.limit(3), 1.0, 135).count() == 3
    with pytest.raises(ValueError):
        C.bottom_k(rows, 0, 135)
    three = spark.createDataFrame([(1, 0.0), (1, 2.0), (1, 4.0), (2, 0.0)], "ep long, score double")
    assert [tuple(r) for r in C.mean_of_nonzero(three).collect()] == [(1, 3.0)]


def test_discretise_and_masks(spark):
    got = one(spark, *(X.discretise(F.lit(v)) for v in (-1.5, -1.0, 0.0, 0.999, 1.0, 2.0)))
    assert tuple(max(-1, v) for v in got) == (-1, 0, 128, 255, 255, 255)
    assert X and V.bool_mask(6, -1) == [True] * 6 + [False] and V.bool_mask(0, 2) == [True, True]
    prompt = one(spark, X.state_prompt(F.lit(" open_it\n"), F.array(F.lit(-1.5), F.lit(0.0))))[0]
    assert prompt == "Task: open it, State: -1 128;\nAction: "


@pytest.mark.parametrize(
    ("name", "drop", "prompt"),
    [
        ("KITCHEN_SCENE10_put_the_bowl_demo.hdf5", True, "put the bowl"),
        ("KITCHEN_SCENE3_turn_on_the_stove_demo.hdf5", False, "turn on the stove demo"),
        ("a/b/plain_name.hdf5", True, "plain"),
        ("single", True, "single"),
    ],
)
def test_name_to_prompt(spark, name, drop, prompt):
    assert one(spark, X.name_to_prompt(F.lit(name), drop))[0] == prompt


def test_natural_order_and_numbers(spark):
    rows = spark.createDataFrame([("x2",), ("x10",), ("x1",), ("x1b3",), ("x1b20",), ("x01",)], "s string")
    assert [r["s"] for r in rows.where("s <> 'x01'").orderBy(X.natural_key(F.col("s"))).collect()] == ["x1", "x1b3", "x1b20", "x2", "x10"]
    assert one(spark, X.trailing_number(F.lit("iter_12")), X.trailing_number(F.lit("iter")), X.episode_number(F.lit("a/episode-07.parquet"), F.lit(3)), X.episode_number(F.lit("a/b.parquet"), F.lit(3))) == (12, -1, 7, 3)


def test_vectors(spark):
    x = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    mean, std = F.array(*map(F.lit, (0.5, 0.5, 0.5, 9.0))), F.array(*map(F.lit, (2.0, 2.0, 2.0, 9.0)))
    short, tail = one(spark, V.standardise(x, mean, std, [False]), V.destandardise(V.standardise(x, mean, std), mean, std, 2))
    assert short[0] == 1.0 and short[2] == pytest.approx(1.25, abs=1e-5) and tail == pytest.approx([1.0, 2.0])
    assert one(spark, V.delta(x, F.array(F.lit(1.0), F.lit(1.0)), [True, False, True]))[0] == [0.0, 2.0, 3.0]
    assert one(spark, V.gripper_from_unit(V.gripper_to_unit(x)), V.pad(x, 4), V.pad(x, 2, truncate=True)) == ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 0.0], [1.0, 2.0])
    assert one(spark, V.axis_angle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))[0] == [0.0, 0.0, 0.0]
    assert one(spark, V.axis_angle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))[0] == pytest.approx([np.pi, 0, 0])
    with pytest.raises(ValueError):
        V.sinusoidal(F.lit(1.0), 3, 1, 2)


def test_nearest_repair(spark):
    rows = spark.createDataFrame([(0, 0, "a", False), (0, 1, None, True), (0, 2, "b", False), (0, 3, None, True), (0, 4, None, True), (0, 5, "c", False), (1, 0, None, True)], "ep long, j long, v string, bad boolean")
    got = {(r["ep"], r["j"]): (r["source"], r["v"]) for r in D.nearest_valid(rows).collect()}
    assert got == {(0, 1): (0, "a"), (0, 3): (2, "b"), (0, 4): (5, "c"), (1, 0): (None, None)}
    assert [r["v"] for r in D.repair(rows.where("ep = 0")).orderBy("j").collect()] == ["a", "a", "b", "b", "c", "c"]
    with pytest.raises(Exception, match="no valid frame"):
        D.repair(rows).collect()


def test_metric_windows(spark):
    got = Q.metric_windows(spark.range(120).select(F.col("id").alias("step"), F.col("id").cast("double").alias("value")), 50).orderBy("window").collect()
    assert [(r["rows"], r["logged"]) for r in got] == [(1, 1), (50, 51), (50, 101), (19, 120)]


def test_weighted_loss_divides_by_rows(spark):
    assert C.weighted_loss(spark.createDataFrame([(1.0, 1.0), (2.0, 0.0), (3.0, 1.0)], "loss double, weight double")).first()["loss"] == pytest.approx(4 / 3)


def test_samples(spark):
    rows = spark.range(500).select(F.col("id").alias("ep"), (F.col("id") % 3).alias("task"))
    got = S.stratified(rows, "task", "ep", 7, 1).groupBy("task").count().collect()
    assert [r["count"] for r in got] == [7, 7, 7]
    small, large = ({r["ep"] for r in S.prefix_sample(rows, "ep", n, 3).collect()} for n in (20, 50))
    assert small < large and len(large) == 50
    assert S.share_size(5, 0.5) == 2 and S.share_size(3, 0.01) == 1 and S.share_size(9, 1) == 9
    starts = E.valid_starts(episode_rows(spark, [14, 15, 16, 40]), 15)
    first = S.coverage_first(starts, 10, 5).collect()
    assert {r["ep"] for r in first if r["i"] < 3} == {1, 2, 3} and len(first) == 10
    assert S.coverage_first(starts, 2, 5).count() == 2 and S.bootstrap_chunks(starts, 5).count() == starts.count()
    whole = S.batches(rows, "ep", 64).orderBy("ep").collect()
    assert [(r["batch"], r["place"]) for r in whole] == [(i // 64, i % 64) for i in range(500)]
    assert S.batches(rows, "ep", 64, seed=2).groupBy("batch").count().where("count <> 64").count() == 0
    repeat = S.batches(rows.repartition(7), "ep", 64, seed=2)
    assert repeat.exceptAll(S.batches(rows, "ep", 64, seed=2)).count() == 0
    with pytest.raises(ValueError):
        S.stratified(rows, "task", "ep", 0, 1)


def test_range_join_equals_brute_force(spark):
    counts = spark.createDataFrame([(e, 1 + (e * 7) % 40) for e in range(60)], "ep long, n long")
    got = {r["i"]: r["ep"] for r in E.locate_frames(spark.range(2000).withColumnRenamed("id", "i"), E.episode_ranges(counts, "ep"), width=16).collect()}
    owner = [e for e in range(60) for _ in range(1 + (e * 7) % 40)]
    assert got == {i: e for i, e in enumerate(owner) if i < 2000}


def test_unknown_ids_raise(spark):
    have = spark.range(5).withColumnRenamed("id", "ep")
    E.require_known(have.limit(2), have, "ep")
    with pytest.raises(ValueError, match=r"\[7, 8\]"):
        E.require_known(spark.createDataFrame([(8,), (7,), (1,)], "ep long"), have, "ep")


def test_trajectories():
    assert I.save_points(10, 4) == [0, 4, 8, 10] and I.save_points(8, 4) == [0, 4, 8]
    assert I.trajectory(100, 10) == (100, 90, 9) and I.trajectory(0, 10) == (1, 0, 0)
    with pytest.raises(ValueError):
        I.save_points(4, 0)


def linear_problem(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(120, 4)), rng.normal(size=120)
    rows = spark.createDataFrame([(int(i % 6), int(i % 4), x[i].tolist(), float(y[i])) for i in range(120)], "ep long, batch long, x array<double>, y double")
    return x, y, rows


@pytest.mark.parametrize(("inner", "back"), [(0, 1), (6, 3)])
def test_influence_equals_finite_differences(spark, inner, back):
    x, y, rows = linear_problem(spark)
    theta = np.array([0.3, -0.2, 0.1, 0.5])
    optimiser = I.Optimiser(rate=0.01, eps_root=1e-2)
    train, cand, val = np.arange(120) % 5 < 2, np.arange(120) % 5 == 2, np.arange(120) % 5 > 2
    keyed = rows.withColumn("i", F.monotonically_increasing_id())
    index = {tuple(r["x"]): i for i, r in enumerate(rows.collect())}
    part = F.udf(lambda v: index[tuple(v)] % 5, "int")(F.col("x"))
    keyed = keyed.withColumn("part", part).persist()
    got = {r["ep"]: r["score"] for r in I.replay_scores(keyed.where("part < 2"), keyed.where("part = 2"), keyed.where("part > 2"), theta, inner, back, optimiser).collect()}
    ep, batch = np.arange(120) % 6, np.arange(120) % 4

    def loss(weights):
        t, mu, nu = theta.copy(), np.zeros(4), np.zeros(4)
        _, before, after = I.trajectory(inner, back)
        for step, b in enumerate([*range(before), None, *range(before, before + after)]):
            if b is None:
                r = 2 * (x[cand] @ t - y[cand]) * np.array([weights.get(e, 0.0) for e in ep[cand]])
                g = x[cand].T @ r / cand.sum()
            else:
                use = train & (batch == b % 4)
                g = 2 * x[use].T @ (x[use] @ t - y[use]) / use.sum()
            b1, b2 = optimiser.momenta(step)
            mu, nu = b1 * mu + (1 - b1) * g, b2 * nu + (1 - b2) * g * g
            t = t - optimiser.rate * (mu / (1 - b1 ** (step + 1)) / np.sqrt(nu / (1 - b2 ** (step + 1)) + optimiser.eps_root) + optimiser.decay * t)
        return np.mean((x[val] @ t - y[val]) ** 2)

    for e, score in got.items():
        assert score == pytest.approx((loss({e: 1e-5}) - loss({e: -1e-5})) / 2e-5, rel=1e-3, abs=1e-9)
    if inner == 0:
        single = {r["ep"]: r["score"] for r in I.one_step_scores(keyed.where("part = 2"), keyed.where("part > 2"), theta, optimiser).collect()}
        assert single == pytest.approx(got, rel=1e-6)


def test_files_round_trip(spark, tmp_path):
    root = f"{tmp_path}/root"
    for n, name in ((3, "episode_10"), (2, "episode_2"), (4, "episode_1")):
        spark.range(n).selectExpr("id AS t", "cast(id as double) AS v").coalesce(1).write.parquet(f"{root}/data/x_{name}")
    for folder in (tmp_path / "root/data").iterdir():
        (part,) = folder.glob("part-*.parquet")
        part.rename(tmp_path / f"root/data/{folder.name[2:]}.parquet")
        for rest in folder.iterdir():
            rest.unlink()
        folder.rmdir()
    got = [(r["ep"], r["n"], r["start"], r["end"]) for r in files.discover_episodes(spark, root).orderBy("position").collect()]
    assert got == [(1, 4, 0, 4), (2, 2, 4, 6), (10, 3, 6, 9)]
    assert files.read_frames(spark, root).where("file_index = v").count() == 9
    (tmp_path / "tasks.jsonl").write_text('{"task_index": 0, "task": "a"}\n\n{"task_id": 1, "name": "b"}\n{"index": 0, "prompt": "c"}\n')
    assert {r["task_index"]: r["task"] for r in files.load_tasks(spark, f"{tmp_path}/tasks.jsonl").collect()} == {0: "c", 1: "b"}
    assert files.load_fps(spark, f"{tmp_path}/info.json") == 10
    (tmp_path / "info.json").write_text('{"fps": 20}')
    assert files.load_fps(spark, f"{tmp_path}/info.json") == 20
    index = f"{tmp_path}/include.json"
    assert sinks.save_include_index(spark.createDataFrame([(5,), (2,)], "ep long"), index, seed=1) == [2, 5]
    assert [(r["pos"], r["ep"]) for r in files.load_include_index(spark, index).orderBy("pos").collect()] == [(0, 2), (1, 5)]
    assert json.loads((tmp_path / "include.json").read_text())["unit"] == "episode"
    (tmp_path / "none.json").write_text("{}")
    assert files.load_include_index(spark, f"{tmp_path}/none.json") is None
    statistics = spark.createDataFrame([("a", 0, 1.0, 2.0, 0.5, 3.0), ("a", 1, 1.5, 2.5, None, None)], "key string, dim int, mean double, std double, q01 double, q99 double")
    sinks.save_statistics(statistics.fillna(0.0), f"{tmp_path}/stats.json")
    assert files.load_statistics(spark, f"{tmp_path}/stats.json").where("dim = 1").first()["mean"] == 1.5
    for turn, name, value in ((0, "candidate_scores_compact.npy", np.array([[3, 0.5], [4, -1.0]])), (1, "scores.npy", np.array([0.0, 2.0]))):
        (tmp_path / f"iter_{turn}").mkdir()
        np.save(tmp_path / f"iter_{turn}" / name, value)
    loaded = files.load_scores(spark, [f"{tmp_path}/iter_{t}" for t in (0, 1)])
    assert sorted(map(tuple, loaded.collect())) == [(0, 3, 0.5), (0, 4, -1.0), (1, 1, 2.0)]


def test_sinks_do_not_half_write(spark, tmp_path):
    rows = episode_rows(spark, [3, 2])
    sinks.write_episodes(rows, f"{tmp_path}/out")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_episodes(rows, f"{tmp_path}/out")
    sinks.write_episodes(rows, f"{tmp_path}/out", overwrite=True)
    place = f"{tmp_path}/t"
    rows.write.parquet(place)
    read = spark.read.parquet(place)
    assert sinks.rewrite(read.where("ep = 0"), place) == 3 and spark.read.parquet(place).count() == 5
    sinks.rewrite(read.where("ep = 0"), place, backup=f"{place}.bak", apply=True)
    assert spark.read.parquet(place).count() == 3 and spark.read.parquet(f"{place}.bak").count() == 5
    sinks.save_scores(rows.select("ep", F.col("v").alias("score")), f"{tmp_path}/scores")
    assert spark.read.parquet(f"{tmp_path}/scores").count() == 5


def test_image_kinds(spark):
    rows = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\nxx"),), (bytearray(b"\xff\xd8\xff\xe0"),), (bytearray(b"no"),), (None,)], "b binary")
    assert [r[0] for r in rows.select(files.image_kind(F.col("b"))).collect()] == ["png", "jpeg", "none", "none"]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.range(300).selectExpr("id AS event_id", "id % 3 AS user_id", "cast(id as double) AS value", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts")
    for part in range(3):
        events.where(f"event_id % 3 = {part}").write.mode("append").parquet(f"{tmp_path}/events")
    stream = R.read_events(spark, f"{tmp_path}/events", files_per_trigger=1)
    moments = R.run_once(R.running_moments(stream, "user_id"), f"{tmp_path}/moments", "complete").orderBy("user_id").collect()
    assert [(r["rows"], r["mean"]) for r in moments] == [(100, 148.5), (100, 149.5), (100, 150.5)]
    counts = R.count_windows(stream, f"{tmp_path}/counts", 40, "user_id")
    assert counts.count() == 6 and counts.where("rows <> 40").count() == 0
    whole = R.count_windows(stream, f"{tmp_path}/whole", 40, "user_id", unfinished=True)
    assert sorted((r["key"], r["window"], r["rows"]) for r in whole.collect()) == [(str(k), w, n) for k in range(3) for w, n in ((0, 40), (1, 40), (2, 20))]
    hours = R.run_once(R.tumbling_counts(R.read_events(spark, f"{tmp_path}/events"), "1 hour", "1 hour"), f"{tmp_path}/hours", "complete")
    assert hours.count() == 5 and hours.agg(F.sum("rows")).first()[0] == 300


def test_count_windows_go_on_over_batches(spark, tmp_path):
    """Keys that last over several micro-batches and parts of the time, a null key, ties of time."""
    rows = [(i, None if i % 5 == 4 else "hot" if i % 3 else "rare", float(i * i % 17)) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, kind string, value double").withColumn("ts", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, event_id div 2 * 7)"))
    for first in (0, 150, 160):
        events.where(f"event_id >= {first} AND event_id < {dict(((0, 150), (150, 160), (160, 400)))[first]}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = R.read_events(spark, f"{tmp_path}/events", files_per_trigger=1)
    got = R.count_windows(stream, f"{tmp_path}/out", 30, "kind", order=("ts", "event_id"), part="minute", unfinished=True).collect()
    want = []
    for kind in ("hot", "rare", None):
        own = [v for _, k, v in rows if k == kind]
        want += [(kind, w, len(own[w * 30 : w * 30 + 30]), round(sum(own[w * 30 : w * 30 + 30]) / len(own[w * 30 : w * 30 + 30]), 9)) for w in range(-(-len(own) // 30))]
    assert sorted(((r["key"], r["window"], r["rows"], round(r["mean"], 9)) for r in got), key=str) == sorted(want, key=str)


def test_blank_prompts(spark):
    rows = spark.createDataFrame([(None,), ("",), (" \n\t",), (" a",)], "p string")
    assert [r[0] for r in rows.select(X.is_blank(F.col("p"))).collect()] == [True, True, True, False]


def test_batches_of_negative_keys(spark):
    got = S.batches(spark.range(-70_000, 70_000, 7000).withColumnRenamed("id", "k"), "k", 6).orderBy("k").collect()
    assert [(r["batch"], r["place"]) for r in got] == [(i // 6, i % 6) for i in range(20)]


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(100)
    assert rows.repartition(9).select("id", draw_key(1, "id")).exceptAll(rows.select("id", draw_key(1, "id"))).count() == 0


def test_columns_by_alias(spark):
    assert E.first_column(spark.range(1).withColumnRenamed("id", "actions"), "action", "actions") == "actions"
    with pytest.raises(KeyError, match="actions"):
        E.first_column(spark.range(1).withColumnRenamed("id", "actions"), "state")


def test_visible_positions_of_all_rows(spark):
    rng = np.random.default_rng(15)
    rows = [(e, j, int(rng.integers(2)), bool(rng.integers(4))) for e in range(23) for j in range(e)]
    got = {(r["ep"], r["j"]): r["visible"] for r in E.visible_positions(spark.createDataFrame(rows, "ep int, j int, starts int, valid boolean")).collect()}
    block = {(e, j): sum(s for f, k, s, _ in rows if f == e and k <= j) for e, j, _, _ in rows}
    valid = [(e, j) for e, j, _, v in rows if v]
    assert got == {a: sum(block[b] <= block[a] for b in valid if b[0] == a[0]) for a in valid}
