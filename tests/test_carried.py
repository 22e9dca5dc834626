"""Carried statistics, footers, files opened by row number, bitmaps as include indexes."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from episodica.operators import carried as K
from episodica.operators import selection as C
from episodica.sources.datasets import write_dataset
from episodica.sources.filetable import FileTable
from episodica.sources.footers import footers, missing_columns

SAMPLES = {
    "normal": np.random.default_rng(1).normal(5, 3, 4000),
    "far from zero": 1e12 + np.random.default_rng(2).random(3000),
    "tiny": np.random.default_rng(3).random(2000) * 1e-290,
    "huge": np.random.default_rng(4).normal(size=500) * 1e300,
    "constant": np.full(70, 3.25),
    "zero": np.zeros(5),
    "signs": np.array([-1e-9, 1e9]),
}


@pytest.mark.parametrize("bins", [16, 4096])
@pytest.mark.parametrize("name", SAMPLES)
def test_merging_equals_one_pass(spark, name, bins):
    x = SAMPLES[name]
    rows = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(x)] + [(0, None), (1, float("nan")), (2, float("inf"))], "part int, x double")
    parts = [K.state(rows.where(F.col("part") == p), bins=bins) for p in range(3)]
    left = K.merged(K.merged(parts[0].unionByName(parts[1]), bins=bins).unionByName(parts[2]), bins=bins).first()
    right = K.merged(parts[2].unionByName(parts[1]).unionByName(parts[0]), bins=bins).first()
    whole = K.state(rows, bins=bins).first()
    for c in ("n", "lo", "hi", "e", "bins"):
        assert left[c] == right[c] == whole[c], c
    assert whole["n"] == len(x) and len(whole["bins"]) <= bins and left["s"] == pytest.approx(whole["s"], rel=1e-9, abs=1e-300)
    for r in K.statistics(K.state(rows, bins=bins), probabilities=(0.01, 0.5, 0.99)).collect():
        exact = np.sort(x)[int(np.ceil(r["p"] * len(x))) - 1]
        assert exact - 2.0 ** whole["e"] <= r["quantile"] <= exact
        if name != "huge":
            assert r["mean"] == pytest.approx(x.mean(), rel=1e-9)
    assert 2.0 ** whole["e"] <= max(4 * (x.max() - x.min()) / bins, np.abs(x).max() * 2.0**-51, 2.0**-1000)


def test_profile_reads_new_files_only(spark, tmp_path):
    data, folder = str(tmp_path / "data"), str(tmp_path / "profile")
    rows = spark.range(3000).select((F.col("id") % 2).cast("string").alias("k"), F.sin("id").alias("x"))
    profile = K.CarriedProfile(spark, folder, ("k",))
    assert profile.states() is None
    for part in range(3):
        rows.where(F.pmod(F.floor(F.col("x") * 1e6), F.lit(3)) == part).coalesce(2).write.mode("append").parquet(data)
        assert profile.add(spark.read.parquet(data)) == 2
    assert profile.add(spark.read.parquet(data)) == 0
    got = {r["k"]: r for r in profile.compact().collect()}
    for r in K.state(rows, "k").collect():
        assert all(got[r["k"]][c] == r[c] for c in ("n", "lo", "hi", "e", "bins"))


def test_footers_tell_drift(spark, tmp_path):
    pq.write_table(pa.table({"image": ["a", None], "state": [[1.0], [2.0]]}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"observation.image": pa.array([1, 2, 3], pa.int32())}), tmp_path / "b.parquet")
    pq.write_table(pa.table({"image": pa.array([], pa.string())}), tmp_path / "c.parquet")
    (tmp_path / "d.parquet").write_bytes(b"PAR1 no footer")
    found = footers(spark.createDataFrame([(str(tmp_path / f"{n}.parquet"),) for n in "abcde"], "path string")).persist()
    got = {(r["path"][-9], r["column"]): (r["rows"], r["type"], r["nulls"]) for r in found.where("error IS NULL").collect()}
    assert got == {("a", "image"): (2, "string", 1), ("a", "state"): (2, "list<element: double>", None), ("b", "observation.image"): (3, "int32", 0), ("c", "image"): (0, "string", 0)}
    assert {r["path"][-9] for r in found.where("error IS NOT NULL").collect()} == {"d", "e"}
    report = {(r["path"][-9], r["logical"]): (r["column"], r["type"]) for r in missing_columns(found.where("error IS NULL"), {"image": ["image", "observation.image"], "state": ["state"]}).collect()}
    assert report == {("a", "image"): ("image", "string"), ("a", "state"): ("state", "list<element: double>"), ("b", "image"): ("observation.image", "int32"), ("b", "state"): (None, None), ("c", "image"): ("image", "string"), ("c", "state"): (None, None)}


def test_rows_by_number_open_their_files_only(spark, tmp_path):
    rows = spark.createDataFrame([(e, j, "t", 100 * e + j) for e in range(60) for j in range(1 + e % 4)], "ep long, j int, task string, v long")
    write_dataset(rows, str(tmp_path / "set"))
    table = FileTable(spark, str(tmp_path / "set"))
    table.adopt()
    every = [r["v"] for r in rows.orderBy("ep", "j").collect()]
    asked = [0, 7, 7, 90, len(every) - 1]
    got = table.rows_at(spark.createDataFrame([(i,) for i in asked], "i long"))
    assert sorted((r["i"], r["v"], r["index"]) for r in got.collect()) == sorted((i, every[i], i) for i in asked)
    assert sum("/data/" in f for f in got.inputFiles()) == 4
    changed = table.read(places=True).where("v = 0").select("__file", "__row", F.lit(-5).cast("long").alias("v"))
    table.update(changed)
    assert [r["v"] for r in table.rows_at(spark.sql("SELECT 0L AS i")).collect()] == [-5]
    assert table.rows_at(spark.range(0).withColumnRenamed("id", "i")).count() == 0
    with pytest.raises(IndexError):
        table.rows_at(spark.createDataFrame([(len(every),)], "i long"))


def test_bitmap_equals_a_semi_join(spark):
    rng = np.random.default_rng(6)
    ids = [0, 1, 32767, 32768, 32769, 65536, -1, -32768, -40000, *rng.integers(-100_000, 10_000_000_000, 300).tolist(), *range(500_000, 500_300)]
    index = C.bitmap_index(spark.createDataFrame([(i,) for i in [*ids, *ids, None]], "ep long"))
    rows = spark.createDataFrame([(i, i % 7) for i in {*ids, *range(-50, 50), *range(32700, 32800), *range(499_900, 500_400)}] + [(None, 1)], "ep long, x long")
    got = [r["ep"] for r in C.in_bitmap(rows, index).collect()]
    assert sorted(got) == sorted({r["ep"] for r in rows.collect()} & set(ids)) and index.agg(F.max(F.octet_length("bitmap"))).first()[0] <= 4096
