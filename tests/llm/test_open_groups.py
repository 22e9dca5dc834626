"""Rows outside the largest component of a group meet the rows of about their size, all of them; rows of files keep their keys without a copy."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from episodica.llm import jaccard
from episodica.llm.common import Scratch


@pytest.mark.parametrize("percent", [80, 90, 100])
def test_linked_sizes_lie_in_neighbouring_bands(spark, percent):
    sizes = [*range(1, 300), *range(990, 1010), 12_345, 99_999, 100_000]
    rows = [(x, y) for x in sizes for y in {x, x * 100 // percent} if 100 * x >= percent * y]
    bands = spark.createDataFrame(rows, "x int, y int")
    for name in ("x", "y"):
        bands = bands.withColumn("grams", F.repeat(F.lit("8 bytes."), F.col(name)).cast("binary")).withColumn(f"{name}_band", jaccard.size_band(percent)).drop("grams")
    assert bands.where("y_band - x_band NOT BETWEEN 0 AND 1").count() == 0


def test_open_rows_meet_whoever_may_link(spark):
    """A group of 5,000 rows, 300 of them open: every pair that its sizes allow is in one tile, and tiles hold a fraction of all pairs."""
    rng = random.Random(3)
    percent, block = 90, 128
    sizes = [int(20 * 1.002 ** rng.randrange(2500)) for _ in range(5000)]
    rows = spark.createDataFrame([(i, 7, n) for i, n in enumerate(sizes)], "node long, group long, n int").repartition(8)
    members = rows.select("node", "group", F.repeat(F.lit("8 bytes."), F.col("n")).cast("binary").alias("grams"))
    open_ = rows.where("node % 17 = 0").select("node", "group")
    tiles = {}
    for r in jaccard.open_tiles(members, open_, percent, block).select("x", "y", "node").collect():
        tiles.setdefault((r["x"], r["y"]), []).append(r["node"])
    together = set()
    for own in tiles.values():
        chosen = set(own)
        together |= {(a, b) for a in chosen if a % 17 == 0 for b in chosen}
    wanted = [(a, b) for a in range(0, 5000, 17) for b in range(5000) if 100 * min(sizes[a], sizes[b]) >= percent * max(sizes[a], sizes[b])]
    assert all(pair in together for pair in wanted)
    assert max(Counter({k: len(set(v)) for k, v in tiles.items()}).values()) < 4 * block
    assert len(together) < 0.15 * 295 * 5000


def test_open_rows_link_as_brute_force_says(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        words = [f"w{j}" for j in range(60 + 60 * (i % 2))]
        for j in rng.sample(range(len(words)), rng.randrange(4)):
            words[j] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(words[: len(words) - rng.randrange(5)])))
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}
    for a, b in ((a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])):
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {i: new if r == old else r for i, r in root.items()}
    tiles, make = [], jaccard.open_tiles
    monkeypatch.setattr(jaccard, "open_tiles", lambda *a: tiles.append(make(*a)) or tiles[-1])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, block=4).collect()}
    assert got == root and len(tiles) == 1 and len(set(root.values())) > 10


def texts():
    rng = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = []
    for i in range(150):
        own = [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([60, 80, 120]))]
        rows.append((2 * i, f"{shared} {' '.join(own)}"))
        if i % 3 == 0:
            rows.append((2 * i + 1, f"{shared} {' '.join(own)} tail"))
    return [*rows, (None, rows[0][1]), (9, None), (9, "")]


def answers(docs):
    return sorted(map(tuple, jaccard.jaccard_components(docs, 3, 90, block=8).collect()), key=repr)


def test_rows_of_files_have_keys_of_their_own(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").withColumn("file", F.lit("f")).withColumn("row", F.lit(1.5))
    want = answers(docs)
    assert {c for i, _, c in want if i is not None and i % 6 == 1 and i != 9} <= {i for i, _, _ in want if i is not None and i % 6 == 0}
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    spark.read.parquet(str(tmp_path / "docs")).write.saveAsTable("open_group_docs")
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: written.append(name) or write(self, df, name))
    try:
        for stored in (spark.read.parquet(str(tmp_path / "docs")), spark.table("open_group_docs"), spark.read.parquet(str(tmp_path / "docs")).withColumn("doc_id", F.col("doc_id") + 0).where("doc_id IS NULL OR doc_id >= 0")):
            assert jaccard.read_from_files(stored)
            assert answers(stored) == want
        assert "texts" not in written
        assert answers(spark.read.parquet(str(tmp_path / "docs")).union(docs.limit(0))) == want and "texts" in written
        twice = spark.read.parquet(str(tmp_path / "docs"), str(tmp_path / "docs"))
        assert {(i, c) for i, _, c in answers(twice)} == {(i, c) for i, _, c in want}
    finally:
        spark.sql("DROP TABLE open_group_docs")
    assert not jaccard.read_from_files(spark.read.parquet(str(tmp_path / "docs")).where(F.rand() < 2))
