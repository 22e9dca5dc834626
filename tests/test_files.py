"""Datasets of a file per episode, versions of file tables, score vectors as a data source."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.sources import filetable, namedfiles
from episodica.sources.datasets import write_dataset
from episodica.sources.files import discover_episodes, load_fps, load_tasks
from episodica.sources.filetable import FileTable


def frames(spark, sizes):
    rows = [(e, j, f"task {e % 3}" if e % 5 else None, float(10 * e + j), [float(j), 1.0]) for e, n in sizes.items() for j in range(n)]
    return spark.createDataFrame(rows, "ep long, j int, task string, v double, state array<double>")


def below(root):
    return {os.path.relpath(os.path.join(d, f), root): os.stat(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if not f.startswith(".")}


def test_dataset_has_a_file_per_episode(spark, tmp_path):
    root, sizes = str(tmp_path / "set"), {0: 3, 1: 1, 7: 70, 1002: 4}
    write_dataset(frames(spark, sizes).repartition(5), root, fps=5)
    names = {f"data/chunk-{e // 1000:03d}/episode_{e:06d}.parquet": n for e, n in sizes.items()}
    assert set(below(root)) == {*names, "meta/info.json", "meta/tasks.jsonl", "meta/episodes.jsonl"}
    for name, n in names.items():
        own = spark.read.parquet(f"{root}/{name}").collect()
        assert [r["frame_index"] for r in own] == list(range(n)) and own[-1]["timestamp"] == pytest.approx((n - 1) / 5)
    found = {r["ep"]: (r["start"], r["end"]) for r in discover_episodes(spark, root).collect()}
    assert found == {0: (0, 3), 1: (3, 4), 7: (4, 74), 1002: (74, 78)}
    whole = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data")
    assert [r["index"] for r in whole.orderBy("index").collect()] == list(range(78))
    assert load_fps(spark, f"{root}/meta/info.json") == 5 and {r["task"] for r in load_tasks(spark, f"{root}/meta/tasks.jsonl").collect()} == {"task 1", "task 0"}
    assert whole.where("episode_index = 0 AND task_index IS NOT NULL").count() == 0
    assert [json.loads(x)["length"] for x in (tmp_path / "set/meta/episodes.jsonl").read_text().splitlines()] == [3, 1, 70, 4]
    with pytest.raises(Exception, match="already exists"):
        write_dataset(frames(spark, {0: 1}), root)
    write_dataset(frames(spark, {0: 1}), root, overwrite=True)
    assert len([n for n in below(root) if n.endswith(".parquet")]) == 1
    assert sorted(os.listdir(tmp_path)) == ["set"]
    with pytest.raises(ValueError):
        write_dataset(frames(spark, {0: 1}).withColumn("ep", F.lit(None).cast("long")), str(tmp_path / "none"))


def test_failed_task_leaves_nothing(spark, tmp_path):
    bad = frames(spark, {e: 5 for e in range(20)}).withColumn("v", F.when((F.col("ep") == 13) & (F.col("j") == 4), F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        write_dataset(bad, str(tmp_path / "set"))
    assert os.listdir(tmp_path) == []
    namedfiles.register(spark)
    scattered = spark.range(0, 8, 1, 4).select(F.lit("a.parquet").alias("__file"), "id")
    with pytest.raises(Exception, match="several tasks"):
        scattered.write.format("named_parquet").mode("append").option("path", str(tmp_path / "x")).save()
    assert os.listdir(tmp_path) == []


@pytest.fixture
def stored(spark, tmp_path):
    root = str(tmp_path / "set")
    write_dataset(frames(spark, {e: 4 for e in range(40)}), root)
    table = FileTable(spark, root)
    assert table.adopt() == 1
    return table, root


def changes(table, episodes):
    return table.read(places=True).where(F.col("episode_index").isin(episodes) & (F.col("frame_index") == 2)).select("__file", "__row", F.lit(-1.0).alias("v"))


def test_update_touches_only_changed_files(spark, stored):
    table, root = stored
    before = below(root)
    want = {(r["episode_index"], r["frame_index"]): r["v"] for r in table.read().collect()} | {(7, 2): -1.0}
    assert table.update(changes(table, [7])) == 2
    after = below(root)
    assert all(after[f].st_ino == s.st_ino and after[f].st_mtime_ns == s.st_mtime_ns for f, s in before.items())
    assert [f for f in after if f not in before and f.endswith(".parquet") and f.startswith("_changes")] == [f for f in after if "_changes" in f and f.endswith("data/chunk-000/episode_000007.parquet")]
    assert {(r["episode_index"], r["frame_index"]): r["v"] for r in table.read().collect()} == want
    assert table.read(1).where("v < 0").count() == 0
    again = table.read(places=True).where("episode_index = 7")
    assert [r["frame_index"] for r in again.orderBy("__row").collect()] == [0, 1, 2, 3]
    assert table.update(changes(table, [7, 8])) == 3 and table.read().where("v = -1").count() == 2
    assert table.restore(1) == 4 and table.read().where("v < 0").count() == 0
    assert table.update(table.read(places=True).where("false").select("__file", "__row", "v")) == 4
    assert len(table.vacuum()) == 2 and table.read().count() == 160 and table.versions() == [4]
    for wrong in ("'data/none' AS __file, 0L AS __row, 1D AS v", "'data/chunk-000/episode_000001.parquet' AS __file, 4L AS __row, 1D AS v", "'data/chunk-000/episode_000001.parquet' AS __file, 1L AS __row, 1D AS other"):
        with pytest.raises(ValueError):
            table.update(spark.sql(f"SELECT {wrong}"))


@pytest.mark.parametrize("step", ["files", "manifest", "rename"])
def test_a_crash_leaves_the_old_version(spark, stored, monkeypatch, step):
    table, root = stored

    def crash(*_, **__):
        raise RuntimeError("crashed")

    changed = changes(table, [3, 4])
    with monkeypatch.context() as patch:
        if step == "files":
            patch.setattr(filetable, "register", crash)
        else:
            patch.setattr(FileTable, "_commit" if step == "manifest" else "_rename_new", crash)
        with pytest.raises(RuntimeError):
            table.update(changed)
    assert table.versions() == [1] and table.read().where("v < 0").count() == 0
    assert table.update(changed) == 2 and table.read().where("v = -1").count() == 2
    table.vacuum(keep=2)
    assert len(os.listdir(f"{root}/_changes")) == 1 and table.read().where("v = -1").count() == 2


def test_two_writers_of_a_version(spark, stored):
    table, _ = stored
    files = table.files()
    table._commit(files, 2)
    with pytest.raises(Exception, match="exist"):
        table._commit(files, 2)
    assert np.array_equal(table.versions(), [1, 2])
