"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from episodica.llm.nearest import make_lists, nearest, scan

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, q long, row int, list int, width int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "v", 6, 7, 8, 9) for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    out = {}
    usable = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for n, (i, v) in enumerate(usable):
        if queries(i):
            others = [(float(((w - v) ** 2).sum()), j is None, j or 0) for m, (j, w) in enumerate(usable) if m != n and len(w) == len(v)]
            out.setdefault(i, []).append([(None if none else j, d**0.5) for d, none, j in sorted(others)[:k]])
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def single(x):
    return [float(np.float32(v)) for v in x]


def test_edge_cases_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, single(rng.standard_normal(8))) for i in range(230)]
    rows += [(1000 + i, single(np.ones(8))) for i in range(120)]  # ties beyond k, some of them queries
    rows += [(100, None), (200, []), (300, [0.0] * 8), (400, [1.0, None] * 4), (500, [float("nan")] * 8), (600, [float("inf")] * 8)]
    rows += [(None, single(rng.standard_normal(8))), (700, [1.0, 2.0]), (701, [1.0, 2.5]), (800, [-0.0, 1.0]), (3, rows[3][1]), (101, rows[0][1])]
    data = frame(spark, rows).repartition(5)
    got = answers(nearest(data, data.where("vec_id % 100 = 0"), k=10))
    want = brute(rows, lambda i: i is not None and i % 100 == 0, 10)
    assert set(got) == set(want)
    for q, found in got.items():
        assert len(want[q]) == 1
        assert [(r, i) for r, i, _ in found] == [(n + 1, i) for n, (i, _) in enumerate(want[q][0])], q
        assert [s for *_, s in found] == pytest.approx([s for _, s in want[q][0]], abs=1e-12)
    assert nearest(data.limit(0), data.limit(0)).count() == 0
    assert nearest(data, data.where("vec_id = 300")).count() == 0


def test_repeated_query_rows_each_have_answers(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 3.0]), (7, [1.0, 1.0])]
    data = frame(spark, rows)
    got = [tuple(r) for r in nearest(data, data.where("vec_id = 100"), k=2).collect()]
    assert sorted(got) == sorted([(100, 1, 100, 0.0), (100, 2, 7, 1.0)] * 2 + [(100, 1, 7, 5**0.5), (100, 2, 100, 10**0.5)])


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_recall(spark, spread):
    """Over clustered and over structureless vectors, with lists and tiles that are really cut."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 32))
    rows = [(i, single(centres[rng.integers(20)] + spread * rng.standard_normal(32))) for i in range(6000)]
    data = frame(spark, rows)
    got = answers(nearest(data, data.where("vec_id % 100 = 0"), k=10, sample=2000, tile=64))
    want = brute(rows, lambda i: i % 100 == 0, 10)
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q][0]}) for q in want)
    assert hits / (10 * len(want)) > 0.95 and all(len(v) == 10 for v in got.values())
    assert all(b[2] >= a[2] for v in got.values() for a, b in zip(v, v[1:], strict=False))


def test_scan_abandons_without_losing_the_nearest():
    rng = np.random.default_rng(5)
    data, rotation = rng.standard_normal((1024, 64)), np.linalg.qr(rng.standard_normal((64, 64)))[0]
    rotated, lost, cost = np.ascontiguousarray((data @ rotation).T), 0, 0
    for _ in range(50):
        query = data[rng.integers(1024)] + 0.5 * rng.standard_normal(64)
        gaps = ((data - query) ** 2).sum(axis=1)
        found, dims = scan(rotated, data, list(range(1024)), query, query @ rotation, np.sort(gaps)[9], 10)
        lost += 10 - len({i for _, i in found} & set(np.argsort(gaps)[:10].tolist()))
        cost += dims
    assert lost <= 5 and cost < 0.95 * 50 * 1024 * 64


def test_lists_need_no_more_than_there_are():
    rng = np.random.default_rng(6)
    for n in (1, 2, 40, 700):
        lists = make_lists(rng.standard_normal((n, 4)), 30, 11, 0.99, 1)
        assert 1 <= lists.probes <= len(lists.centres) <= max(1, n // 32)
