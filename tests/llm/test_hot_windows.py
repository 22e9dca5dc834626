"""A window that very many texts share takes no more room in the transforms than any other."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import suffix
from episodica.llm.common import Scratch

RNG = np.random.default_rng(5)
PASSAGE = bytes(RNG.integers(97, 123, 203, dtype=np.uint8))
APART = [bytes(RNG.integers(97, 123, 201, dtype=np.uint8)) for _ in range(3)]


@pytest.mark.parametrize("copies", [2, 300, 3000])
def test_owners_stay_out_of_the_transforms(spark, copies):
    rows = [(i, 10 * (i % 7), False, PASSAGE) for i in range(copies)] + [(copies + i, 0, i == 2, b) for i, b in enumerate(APART)]
    units = spark.createDataFrame(rows, "row long, low int, heavy boolean, data binary").repartition(5)
    scratch = Scratch(spark, "hot")
    kept, scratch.write = {}, lambda df, name, write=scratch.write: kept.setdefault(name, write(df, name))
    spans = sorted(tuple(r) for r in suffix.merged_spans(units, scratch).collect())
    want = [(i, 10 * (i % 7) + j, 10 * (i % 7) + j + 200) for i in range(copies) for j in range(4)] + [(copies + 2, j, j + 200) for j in range(2)]
    assert spans == sorted(want)
    entries = kept["transforms"].agg(F.sum(F.octet_length("keys") / 16)).first()[0]
    assert entries <= (4 + 6) * suffix.SHARDS and kept["intervals"].count() == 6
    if copies > 2:
        assert kept["transforms"].count() == suffix.SHARDS


def test_whole_texts_with_a_hot_passage(spark):
    def noise(n):
        return "".join(chr(c) for c in RNG.integers(97, 123, n))

    texts = [noise(60) + PASSAGE.decode() + noise(60) for _ in range(400)] + [noise(400) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffix.remove_repeats(docs).collect()}
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for doc, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            gone[i : i + 200] |= seen[t[i : i + 200]] > 1
        assert got[doc] == (gone.sum(), bytes(np.frombuffer(t.encode(), np.uint8)[~gone])) and gone.any() == (PASSAGE.decode() in t)
