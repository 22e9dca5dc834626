"""Merkle manifests against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from episodica.llm.merkle import DOCUMENT, fold, merkle_manifest, verified_documents

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, h string, g string, row string, pos long, n long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))


def tree(nodes):
    """(root, proof of each): lists of (left, right) from the leaf up."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            run, own = level[k // 8 * 8 : k // 8 * 8 + 8], k % 8
            proofs[i].append(("".join(run[:own]), "".join(run[own + 1 :])))
            at[i] = k // 8
        level = [digest(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], proofs


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([h for *_, h in sorted((r[0] is not None, r[0] or 0, leaf(r, r[4])) for r in groups[g])]) for g in order}
    root, upper = tree([trees[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for r, proof in zip(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))), trees[g][1], strict=True):
            steps = proof + upper[k]
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = leaf(r, text)
            for a, b in steps:
                h = digest(a, h, b)
            out.append((r[0], leaf(r, r[4]), trees[g][0], root, digest(*(a + b for a, b in steps)), h, h == root))
    return sorted(out, key=str)


def table(n, langs, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(10 * n), rng.choice(["web", None, "é"]), rng.choice(langs), rng.randrange(9), rng.choice(["Ab É", "ab", None, "", "x" * rng.randrange(3000)]), "h", "g", "r", 1, 2) for _ in range(n)]


CASES = {
    "none": [],
    "one": table(1, ["en"]),
    "one of each group": [(i, "s", lang, 1, "T", "h", "g", "r", 1, 2) for i, lang in enumerate([None, "", "a", "é", "漢", "😀", "z", "b", "c", "d"])],
    "eight": table(8, ["en"]),
    "nine": table(9, ["en"]),
    "a hot group": table(700, ["en"] * 30 + ["de", None, "fr", "only " + "l" * 99]),
    "repeats and nulls": [*table(60, ["en", None]) * 2, (None, None, None, None, None, "h", "g", "r", 1, 2), (None, "a", None, 3, "Text", "h", "g", "r", 1, 2), (3, "s", "en", 1, "T" * 3_000_000, "h", "g", "r", 1, 2)],
    "many groups": table(150, [f"l{i}" for i in range(80)]),
}


@pytest.mark.parametrize("case", CASES)
def test_proofs(spark, case):
    rows = CASES[case]
    got = verified_documents(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == (expected(rows) if rows else [])


def test_manifest_tells_what_changed(spark):
    docs = spark.createDataFrame(CASES["a hot group"], SCHEMA)
    docs = docs.dropDuplicates(["doc_id"])
    made = merkle_manifest(docs, DOCUMENT, present={"n_chars": F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    bad = made.proofs.where(fold(F.col("row.present"), F.col("proof")) != F.lit(made.root)).select("row.id")
    assert {r[0] for r in bad.collect()} == {r[0] for r in docs.where("doc_id % 7 = 0").select("doc_id").collect()}
    assert merkle_manifest(docs.limit(0), DOCUMENT).root is None
