"""The operators of the llm subpackage against brute force on small fixtures."""

import hashlib
import random
import re
import threading
import uuid
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import bpe, jaccard, packing, suffix, toxicity
from episodica.llm.common import Scratch, connected_components, fingerprints, prefix_sums
from episodica.llm.embeddings import embedding_near_dedup
from episodica.llm.exactdedup import DigestIndex, exact_dedup
from episodica.llm.queries import vocabulary
from episodica.llm.sharding import ShardStore, shard_documents
from episodica.llm.tokencount import count_tokens
from episodica.llm.warc import digest32, read_warc, write_warc

DOCS = "doc_id long, text string, id string, score double, node string"
EDGE = [(1, None), (2, ""), (3, "  "), (4, "\t\n"), (5, "a"), (6, "A"), (7, "a  b"), (8, "a b"), (9, "word " * 40_000), (10, "é漢😀 <s> ▁ x"), (10, "é漢😀 <s> ▁ x")]


def frame(spark, rows, schema=DOCS):
    """Rows of (id, text) with further columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "x", 0.5, "n") for r in rows], schema)


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_depend_on_bytes_alone():
    data = np.frombuffer(b"abcabcab" * 50, np.uint8)
    got = fingerprints(prefix_sums(data), np.array([0, 3, 8, 1, 0]), np.array([3, 6, 11, 4, 2]))
    assert got[0] == got[1] == got[2] and len(set(got.tolist())) == 3


@pytest.mark.parametrize("one_task", [0, 500_000])
def test_connected_components(spark, one_task):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 9), (9, 7)] + [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), one_task=one_task).collect()}
    want = components({x for e in edges for x in e}, [e for e in edges if e[0] != e[1]])
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in want if k not in got)
    assert connected_components(spark, spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_components_of_forests_in_parts(spark, monkeypatch):
    rows = spark.range(0, 30_000, 1, 4).select((F.col("id") * 7919 % 30_000).alias("i")).where("i % 1000 <> 0").selectExpr("i AS a", "i - 1 AS b")
    from episodica.llm import common

    monkeypatch.setattr(common, "FOREST_NODES", 2000)
    got = connected_components(spark, rows, Scratch(spark, "t"), one_task=0)
    assert got.where("component <> node - node % 1000").count() == 0 and got.count() == 30_000


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    path = vocabulary("byte_bpe_50k.tiktoken")
    tables = bpe.make_tables(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tables[0], special_tokens={})
    rng = random.Random(2)
    pieces = ["'", "s", "t", "re", "ll", "d", " ", "  ", "\n", "\t", "1", "é", "漢", "😀", "<|endoftext|>", "\x1c", "\x85", "\xa0", "́", "B", "\0", "½", "Ⅷ", "hello"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [t or "" for _, t in EDGE]
    coder = bpe.ByteBPE(*tables)
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
    rows = frame(spark, EDGE)
    encoded = bpe.encode_documents(rows, path)
    decoded = {(r["doc_id"], bytes(r["bytes"])) for r in bpe.decode_documents(encoded, path).collect()}
    assert decoded == {(i, (t or "").encode()) for i, t in EDGE}
    digests = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip_digests(rows, path).collect()]
    want = [(i, np.array(library.encode_ordinary(t or ""), "<u4"), (t or "").encode()) for i, t in EDGE]
    assert sorted(digests) == sorted((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t).hexdigest()) for i, ids, t in want)
    assert bpe.round_trip_digests(frame(spark, []), path).count() == 0


def test_long_texts_are_cut_between_pre_tokens(monkeypatch):
    coder = bpe.ByteBPE(*bpe.make_tables(vocabulary("byte_bpe_50k.tiktoken")))
    text = " ".join(random.Random(3).choices(["don't", "a", "\n\n b", "  c", "1234", "x" * 90], k=500))
    whole = coder.encode([text])
    monkeypatch.setattr(bpe, "STEP", 50)
    assert coder.encode([text]) == whole


def test_perfect_hash_tells_strangers_apart():
    keys = [b"%d" % i for i in range(5000)] + [b"a" * n for n in range(1, 60)]
    own = bpe.PerfectHash(keys, np.arange(len(keys)))
    asked = keys + [b"x" + k for k in keys] + [b"a" * 60]
    ends = np.cumsum([len(k) for k in asked])
    found = own.lookup(np.frombuffer(b"".join(asked), np.uint8), np.append(0, ends[:-1]), ends)
    assert found.tolist() == [*range(len(keys)), *[-1] * (len(keys) + 1)]


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    texts = ["".join(rng.choice(" ab\n\t▁é漢😀<s>") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    rows = EDGE + [(100 + i, t) for i, t in enumerate(texts)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(frame(spark, rows), path, cache=50).collect())
    want = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows]
    assert got == sorted((*w, w[2] > 4096) for w in want)
    assert count_tokens(frame(spark, []), path).count() == 0


def test_exact_dedup_and_index(spark):
    rows = EDGE + [(20, "q"), (19, "q"), (21, "q ")]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(frame(spark, rows)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert got == {(i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]
    index = DigestIndex(spark, f"index_{uuid.uuid4().hex[:8]}")
    exact_dedup(frame(spark, [(5, "old"), (6, "both")]), index).count()
    second = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup(frame(spark, [(1, "both"), (2, "new")]), index).collect()}
    assert second == {1: (6, False), 2: (2, True)} and index.rows().count() == 3
    assert exact_dedup(frame(spark, [])).count() == 0


def near_copies(rng):
    base = [f"w{i}" for i in range(300)]
    rows = list(EDGE[:8])
    for i in range(120):
        words = base[: rng.choice([9, 10, 11, 12, 25, 60, 300])]
        for _ in range(rng.randint(0, max(1, len(words) // 60))):
            words = words.copy()
            words[rng.randrange(len(words))] = f"z{rng.randint(0, 3)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(700, " ".join(f"long{i}" for i in range(30_000))), (701, " ".join(f"long{i}" for i in range(29_990)))]
    return rows


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 90, 512), (5, 80, 10)])
def test_jaccard_components(spark, words, percent, block):
    rows = near_copies(random.Random(5))  # with equal texts and a very long pair
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    linked = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, linked)
    docs = frame(spark, rows, "doc_id long, text string, node string, hi double, group string").union(frame(spark, [(None, rows[20][1]), (None, "alone"), (700, "x y"), (700, rows[20][1])]))
    answers = jaccard.jaccard_components(docs, words, percent, block=block).collect()
    extra = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in answers) - Counter((i, len(s), want[i]) for i, s in sets.items())
    assert extra == Counter([(None, len(sets[rows[20][0]]), want[rows[20][0]]), (None, 1, None), (700, 1, 700), (700, len(sets[rows[20][0]]), want[rows[20][0]])])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in answers if r["doc_id"] not in (None, 700)} | {700: (len(sets[700]), want[700])}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    assert len(set(want.values())) < len(rows) - 20


@pytest.mark.parametrize("percent", [80, 90, 100])
def test_signatures_do_not_depend_on_the_batch(percent):
    rng = np.random.default_rng(12)
    largest = rng.integers(0, 1 << 63, 3000).astype(np.uint64)

    def signatures(*sets):
        row, signature = jaccard.block_signatures(list(sets), percent)
        return sorted(signature[row == 0].tolist())

    for n in [*range(1, 40), *range(1690, 1750, 10)]:
        own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert signatures(own) == signatures(own, largest)


def test_linked_rows_of_two_batches_meet():
    rng = np.random.default_rng(13)
    large = np.unique(rng.integers(0, 1 << 63, 1750).astype(np.uint64))
    small = large[:1700]
    assert set(jaccard.block_signatures([small], 80)[1].tolist()) & set(jaccard.block_signatures([large], 80)[1].tolist())


def test_a_signature_leaves_a_task_once():
    holders = jaccard.Holders()
    rows = np.repeat(np.arange(3), 4)
    fresh, near = holders.tie(np.array([7, 8, 9]), rows, np.array([1, 2, 3, 4, 1, 2, 3, 5, 1, 2, 3, 4]))
    assert fresh == [[1, 2, 3, 4], [5], []] and near == [[], [7], [7]]


def test_long_words_and_texts_in_pieces(monkeypatch):
    text = " ".join(["Word" * n for n in (1, 2, 40, 3)] * 30 + ["a" * 500, "b c"])
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    whole = jaccard.shingle_sets(data, offsets, 3)
    monkeypatch.setattr(jaccard, "STEP", 100)
    assert np.array_equal(whole[0], jaccard.shingle_sets(data, offsets, 3)[0])
    assert len(whole[0]) == len({tuple(text.lower().split()[i : i + 3]) for i in range(len(text.split()) - 2)})


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0
    assert [r["component_id"] for r in jaccard.jaccard_components(frame(spark, [(3, None), (4, "")])).orderBy("doc_id").collect()] == [3, 4]


def repeats_of(rows):
    """Brute force: (id, bytes, removed, spans, kept bytes) of each row."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[i : i + 200] for _, b in texts for i in range(len(b) - 199))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                gone[j : j + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


@pytest.mark.parametrize("part", [1 << 16, 50])
def test_suffix_dedup(spark, part):
    rng = random.Random(7)
    passages = ["".join(rng.choice("abcdefgh ij\né") for _ in range(n)) for n in (199, 200, 201, 205, 230, 900)]

    def noise(n):
        return "".join(rng.choice("klmnop qr") for _ in range(n))

    rows = [(1, None), (2, ""), (3, "a" * 600), (4, "b" * 450), (5, "ab" * 130), (6, "same" * 60), (7, "same" * 60), (8, "short"), (9, "short")]
    rows += [(100 + i, noise(rng.randint(0, 200)) + rng.choice(passages) + noise(rng.randint(0, 200)) + rng.choice(passages)) for i in range(60)]
    rows += [(200 + i, rng.choice("xyz") + passages[1][: 200 - i % 2] + rng.choice("xyz")) for i in range(30)]  # neighbours of one character
    rows += [(5, "repeated id " * 30), (5, None), (None, noise(300)), (None, rows[40][1]), (300, (noise(99) + "é") * 700)]
    docs = frame(spark, rows, "doc_id long, text string, own string, row double, low string")
    got = sorted((tuple(r) for r in suffix.remove_repeats(docs, part=part).collect()), key=str)
    assert [(*r[:4], bytes(r[4])) for r in got] == repeats_of(rows)
    assert suffix.remove_repeats(frame(spark, [])).count() == 0
    carried = suffix.remove_repeats(docs, part=part, carry=["low", "doc_id", "own"])
    assert carried.columns == ["low", "doc_id", "own", "n_bytes", "n_removed", "n_spans", "kept"] and carried.count() == len(rows)


def test_merged_transform_equals_one_sort():
    rng = random.Random(8)
    windows = list({"".join(rng.choice("ab") for _ in range(n)).rjust(200, "x").encode() for n in [3] * 6 + [8] * 60})
    shards = [windows[:20], windows[10:35], windows[5:7], windows[30:]]
    built = [suffix.shard_transform(np.frombuffer(b"".join(s), np.uint8).reshape(-1, 200)) for s in shards]
    interleave, block, common = suffix.merge_transforms([t for _, t in built])
    merged, taken = [], [0] * len(shards)
    for k in interleave.tolist():
        merged.append(shards[k][built[k][0][taken[k]]])
        taken[k] += 1
    assert merged == sorted(merged, key=lambda w: w[::-1])
    assert np.array_equal(np.diff(block) == 0, [a == b for a, b in zip(merged, merged[1:])])
    for i, w in enumerate(merged):
        others = merged[:i] + merged[i + 1 :]
        assert common[i] == max(next((n for n in range(200) if w[n] != o[n]), 200) for o in others)


def test_anchors_of_a_text_in_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 105, 30_000).astype(np.uint8)
    whole = [x[1:] for x in suffix.anchors_of_rows(data, np.array([0, len(data)]))][0]
    monkeypatch.setattr(suffix, "CHUNK", 7_000)
    parts = [x[1:] for x in suffix.anchors_of_rows(data, np.array([0, len(data)]))][0]
    assert set(zip(whole[2].tolist(), whole[3].tolist(), strict=True)) == set(zip(parts[2].tolist(), parts[3].tolist(), strict=True))
    assert sum((whole[1] - whole[0] + 1)) == sum((parts[1] - parts[0] + 1)) == len(data) - 199


def test_embedding_near_dedup(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 64))
    rows = [(i, (centres[i % 12] + rng.normal(scale=rng.choice([0.05, 0.14, 1]), size=64)).tolist(), int(i % 3)) for i in range(240)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(5)]
    rows += [(500, [1e200, 0.0], 1), (501, [2e200, 1e190], 1), (502, [1e-200, 0.0], 1), (503, [2e-200, 0.0], 1), (504, [5e-324, 0.0], 2), (505, [1e308, 1e307], 2), (506, [1e308, -1e308], 2)]
    rows += [(600, rows[3][1], 0), (600, rows[3][1], 0), (None, rows[3][1], 0)]
    rows += [(400, None, 1), (401, [0.0] * 64, 1), (402, [float("nan")] * 64, 1), (403, [1.0] * 64, None), (404, [1.0], 1), (405, [1.0], 1), (406, [None, 1.0], 1), (407, [], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, id string")
    answers = [tuple(r) for r in embedding_near_dedup(table, 0.98, tile=16).collect()]
    plain = [(n, i, np.array(v, float), y) for n, (i, v, y) in enumerate(rows) if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = {n: (w := np.ldexp(v, -np.frexp(np.abs(v).max())[1])) / np.linalg.norm(w) for n, _, v, _ in plain}
    linked = [(a, b) for (a, _, v, x), (b, _, w, y) in combinations(plain, 2) if x == y and len(v) == len(w) and unit[a] @ unit[b] >= 0.98]
    links, roots = Counter(x for p in linked for x in p), components(range(len(rows)), linked)
    least = {}
    for n, (i, _, _) in enumerate(rows):
        least[roots[n]] = min(filter(lambda x: x is not None, (least.get(roots[n]), i)), default=None)
    assert sorted(answers, key=str) == sorted(((i, links[n], least[roots[n]], i == least[roots[n]]) for n, (i, _, _) in enumerate(rows)), key=str) and len(linked) > 100
    assert embedding_near_dedup(table.limit(0)).count() == 0


def test_dominance_keeps_the_optimum():
    def optimum(items, capacity):
        items, best = sorted(items, reverse=True), [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity:
                    go(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1 :])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    for seed in range(150):
        rng = random.Random(seed)
        capacity = rng.randint(5, 30)
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 7)))
        left = dict(counts)
        fixed = packing.dominant_sets(left, capacity)
        rest = list(Counter({n: c for n, c in left.items() if c}).elements())
        assert sum(t for _, t in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(list(counts.elements()), capacity)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(9)
    pieces = ["a", "B", "é", "é", " ", "\n", "\x1c", "\x85", "　", "'s", "1", "½", "漢", "Σ", "İ", "<|endoftext|>", "😀"]
    rows = EDGE[:10] + [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 120)))) for i in range(200)]
    got = packing.pack_documents(frame(spark, rows), path, capacity=64).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    filled = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(by[i], key=lambda r: r["piece"])
        want = [(p, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 64))]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == want
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, [*places[1:], (sum(n for _, n in places), 0)], strict=True)) and sum(n for _, n in places) <= 64
    assert len(filled) <= 1.02 * sum(r["length"] for r in got) / 64 + 1
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_toxicity(spark):
    rng = random.Random(10)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(700):
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(1, 12))]
        toxic = rng.random() < 0.2
        if toxic:
            sentences[rng.randrange(len(sentences))] += rng.choice([" vilemost", " vilesome", " nasty"])
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    docs = frame(spark, rows + [(9000, None), (9001, "")])
    marks = spark.createDataFrame([*labels, (9000, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    truth = dict(labels)
    tested = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(tested)) for i in truth)
    assert np.mean([got[i]["predicted"] == truth[i] for i in tested]) > 0.97
    assert got[9000]["score"] == got[9001]["score"] < 0.5
    found = toxicity.offending_sentences(docs, model).collect()
    assert np.mean([("vile" in r["sentence"] or "nasty" in r["sentence"]) for r in found]) > 0.95
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in got.values())
    assert toxicity.score_documents(frame(spark, []), toxicity.train(docs, marks.limit(0))).count() == 0


def test_toxicity_of_very_long_texts(spark):
    rng = random.Random(14)
    words = [f"word{i}" for i in range(300)]
    texts = [". ".join(" ".join(rng.choices(words, k=8)) for _ in range(6)) for _ in range(400)]
    labels = [int(i % 5 == 0) for i in range(400)]
    model = toxicity.fit([(t + " vilemost." * y, y) for t, y in zip(texts, labels, strict=True)])
    clean = "plain talk here. " * 100_000
    rows = [(1, clean), (2, clean + "vilemost. " + clean), (3, ". ".join(texts))]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(frame(spark, rows), model).collect()}
    assert got == {1: 0, 2: 1, 3: 0}
    assert [r["doc_id"] for r in toxicity.drop_toxic(frame(spark, rows), model).orderBy("doc_id").select("doc_id").collect()] == [1, 3]
    assert toxicity.ToxicityModel({}, -6.9).score(clean) < 0.01


def test_training_sample_takes_texts_of_any_length(spark):
    docs = frame(spark, [(i, "a" * (100_000 if i % 7 == 0 else 10)) for i in range(300)] + [(300, None)])
    labels = spark.range(301).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))

    def lengths(rows):
        return [len(r["text"]) for r in toxicity.training_sample(docs, labels, rows, "doc_id", "text", "toxic").collect()]

    assert sorted(lengths(400)) == sorted(100_000 if i % 7 == 0 else 10 for i in range(300) if zlib.crc32(str(i).encode()) % 5)
    assert len(lengths(30)) in (29, 30) and 100_000 in lengths(100)
    many = docs.unionByName(frame(spark, [(i % 3, f"copy {i} {i % 50}") for i in range(3000)]))
    assert toxicity.training_sample(many, labels, 400, "doc_id", "text", "toxic").count() == len(lengths(400))
    assert toxicity.training_sample(many, labels, 2, "doc_id", "text", "toxic").count() <= 2
    assert toxicity.training_sample(many.repartition(7), labels, 400, "doc_id", "text", "toxic").collect() == toxicity.training_sample(many, labels, 400, "doc_id", "text", "toxic").collect()


def test_offending_sentences_of_odd_texts(spark):
    model = toxicity.ToxicityModel({"worse": 9.0}, -3.0)
    rows = [(1, None), (2, ""), (3, " \n. !"), (None, "fine. é worse! fine"), (4, "worse " * 50_000), (4, "worse " * 50_000)]
    got = sorted((str(r["doc_id"]), r["start"], r["end"], r["sentence"][:8]) for r in toxicity.offending_sentences(frame(spark, rows), model).collect())
    assert got == [("4", 0, 300_000, "worse wo")] * 2 + [("None", 5, 13, " é worse")]


def test_scores_are_a_noisy_or_of_sentences(spark):
    model = toxicity.ToxicityModel({"bad": 2.0, "worse": 3.5, "wors-4": 0.5, "good": 0.0}, -3.0)
    rng = random.Random(15)
    rows = [*EDGE, (None, "bad. worse!"), (11, "bad"), (11, "BAD\nworst?? bad bad"), (12, ". ".join(["bad bad"] * 30)), *((20 + n, "x. worse worse. x. " * n) for n in (1, 9, 100))]
    rows += [(100 + i, "".join(rng.choice(["bad ", "worse ", "worst ", "good ", "x", ". ", "! ", "\n"]) for _ in range(rng.randint(0, 40)))) for i in range(100)]

    def weight(word):
        return sum(model.weights.get(f, 0.0) for f in [word, *(f"{word[:n]}-{n}" for n in (4, 5, 6) if len(word) >= n)])

    want = []
    for i, t in rows:
        evidence = [sum(map(weight, re.findall(r"[^\W\d_]+", s))) for s in re.findall(r"[^.!?\n]+", (t or "").lower())]
        told, none = [x for x in evidence if x > 0] or [0.0], 1.0
        for x in told:
            none *= 1 - 1 / (1 + len(told) * np.exp(3.0 - x))
        want.append((str(i), i is not None and zlib.crc32(str(i).encode()) % 5 == 0, round(1 - none, 9), int(1 - none >= 0.5)))
    got = [(str(r[0]), r[1], round(r[2], 9), r[3]) for r in toxicity.score_documents(frame(spark, rows), model).collect()]
    assert sorted(got) == sorted(want)
    extra = spark.createDataFrame([(1, "bad. worse. worst.", 0.9, True)], "doc_id long, text string, score double, held_out boolean")
    assert [tuple(r) for r in toxicity.score_documents(extra, model).select("doc_id", "predicted").collect()] == [(1, 1)]


def test_warc_round_trip_and_determinism(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 20}</p>" * (i % 7)) for i in range(150)] + [(500, None, None), (501, "u\r\n1", ""), (502, "x", "é" * 9)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, page int")
    folders = [Scratch(spark, "w").path("out") for _ in range(2)]
    manifests = [write_warc(p, f, roll_bytes=3000, rows_per_shard=40).collect() for p, f in zip((pages, pages.repartition(5)), folders, strict=True)]
    assert len(manifests[0]) > 4 and sorted(manifests[0]) == sorted(manifests[1])
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(i, largest.get(h or "", -1))
    got = read_warc(spark, folders[0], payloads=True).collect()
    want = {(i, len((h or "").encode()), digest32((h or "").encode()), "response" if largest[h or ""] == i else "revisit", None if largest[h or ""] == i else largest[h or ""]) for i, _, h in rows}
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(rows)
    assert all(bytes(r["payload"]).decode() == (dict((i, h) for i, _, h in rows)[r["page_id"]] or "") for r in got if r["record_type"] == "response")
    again = [(5, "a", "same"), (5, "b", "other"), (5, "a", "same"), (9, "c", "same"), (9, "d", "third"), (None, "e", "same"), (None, None, None), (3, "f", "x" * 2_000_000)]
    repeated = Scratch(spark, "w").path("out")
    write_warc(spark.createDataFrame([(*r, 1, "d") for r in again], "page_id long, url string, html string, page int, digest string"), repeated)
    back = sorted((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in read_warc(spark, repeated).where("page_id IS NOT NULL").collect())
    assert back == [(3, "f", "response", None, 2_000_000), (5, "a", "revisit", 9, 4), (5, "a", "revisit", 9, 4), (5, "b", "response", None, 5), (9, "c", "response", None, 4), (9, "d", "response", None, 5)]
    assert sorted(r["record_type"] for r in read_warc(spark, repeated).where("page_id IS NULL").collect()) == ["response", "response"]
    empty = Scratch(spark, "w").path("out")
    write_warc(pages.limit(0), empty)
    assert read_warc(spark, empty).count() == 0


def test_sharding(spark):
    docs = frame(spark, EDGE + [(i, f"text {i}" * 20) for i in range(100, 400)] + [(None, "no id")])
    store, back = shard_documents(docs, target_bytes=1 << 20)
    assert back.exceptAll(docs).count() == docs.exceptAll(back).count() == 0
    assert len(store.shards()) == 1 and store.version() > 4
    with pytest.raises(RuntimeError):
        store._commit(store.version() - 1, [], "late writer")
    again = ShardStore(spark, store.folder, target_bytes=1 << 20)
    again.append(docs.limit(3))
    assert again.read().count() == docs.count() + 3 and store.read(store.version() - 1).count() == docs.count()
    again.append(docs.limit(2))
    before = again.version()
    again.compact(everything=True)
    assert again.read(before).count() == again.read().count() == docs.count() + 5  # an earlier version can be read until it goes
    assert again.vacuum() == 3 and again.read().count() == docs.count() + 5 and again.vacuum() == 0
    shards, base, ended = again.shards(), again.version(), []

    def commit():
        try:
            ended.append(ShardStore(spark, store.folder)._commit(base, shards, "race"))
        except RuntimeError:
            ended.append(None)

    racers = [threading.Thread(target=commit) for _ in range(4)]
    [t.start() for t in racers]
    [t.join() for t in racers]
    assert sorted(ended, key=str) == [base + 1, None, None, None] and again.version() == base + 1
    assert again._claim(base + 2) and not again._claim(base + 2) and again.abandon() and again._claim(base + 2)
    assert shard_documents(docs.limit(0))[1].count() == 0


def test_pipeline_on_small_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=60)) + (" vilemost." if i % 10 == 3 else "."), "en", "s", 1) for i in range(200)]
    shared = " ".join(rng.choices(words, k=80))
    rows += [(300, rows[0][1].replace(" ", " \n", 1), "en", "s", 1), (301, rows[1][1] + " tail", "en", "s", 1)]
    rows += [(400 + k, " ".join(rng.choices(words, k=300)) + " " + shared, "en", "s", 1) for k in range(2)] + [(500, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 3)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic = {i for i in range(200) if i % 10 == 3}
    assert len(toxic & set(kept[0])) <= 2 and {i for i in range(200)} - toxic <= set(kept[0])
    assert set(kept[0]) - set(kept[1]) == {300} and set(kept[1]) - set(kept[2]) == {301}
    assert all(shared not in kept[3][i] and shared in kept[2][i] for i in (400, 401)) and kept[3][5] == kept[2][5]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept[3])


@pytest.mark.parametrize("source", ["memory", "files"])
def test_pipeline_keeps_rows_apart(spark, tmp_path, source):
    """Nulls, repeated rows and ids, empty and very long texts, an empty table, clashing names: each stage against brute force."""
    import corpus_pipeline

    rng = random.Random(16)
    words = [f"w{i}" for i in range(800)]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    base, shared, long_ = prose(90), prose(60), prose(20_000)
    rows = [(1, base), (1, base), (2, prose(70)), (None, prose(80)), (None, None), (3, ""), (4, None), (4, " "), (5, base.replace(" ", "\t ")), (None, base)]
    near = prose(100)
    rows += [(7, near + " end"), (6, near), (None, near + " other"), (8, long_), (9, long_ + " tail"), (10, prose(40) + " " + shared), (10, prose(40) + " " + shared), (11, "a"), (12, "b")]
    names = "doc_id long, text string, lang string, source string, n_chars long, row_key string, own int, node int, keep_id int, component_id int"
    every = spark.createDataFrame([(*r, "en", "s", 1, f"k{i}", i, 1, 2, 3) for i, r in enumerate(rows)], names)
    every.repartition(3).write.parquet(f"{tmp_path}/rows")
    docs = every.repartition(3) if source == "memory" else spark.read.parquet(f"{tmp_path}/rows")

    def result(stage, docs):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema["doc_id"] == docs.schema["doc_id"]
        return out, {r["own"]: r for r in out.collect()}

    def order(i):
        return (rows[i][0] is None, rows[i][0] or 0)

    exact, got = result(corpus_pipeline.drop_exact_copies, docs)
    groups = {}
    for i, (_, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert exact.count() == len(groups)
    for members in groups.values():
        stay = [i for i in members if i in got]
        assert len(stay) == 1 and order(stay[0]) == min(map(order, members)) and got[stay[0]]["text"] == rows[stay[0]][1]
    assert any(r["doc_id"] is None and r["text"] == rows[3][1] for r in got.values())
    close, kept = result(corpus_pipeline.drop_near_copies, exact.persist())
    sets = {}
    for i in got:
        w = (rows[i][1] or "").split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = components(sets, [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    for r in set(root.values()):
        members = [i for i in root if root[i] == r]
        assert [i for i in members if i in kept] == [min(members, key=order)]
    assert {6, 8} <= {r["doc_id"] for r in kept.values()} and not {7, 9} & {r["doc_id"] for r in kept.values()}
    _, cut = result(corpus_pipeline.cut_repeated_passages, close.persist())
    mine = sorted(kept)
    want = {i: b.decode("utf-8", "ignore") for i, _, _, _, b in repeats_of([(i, kept[i]["text"]) for i in mine])}
    assert {i: r["text"] for i, r in cut.items()} == want and all(r["n_chars"] == len(r["text"]) and r["row_key"] == f"k{i}" for i, r in cut.items())
    assert any(len(want[i]) < len(kept[i]["text"] or "") for i in mine)
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    _, calm = result(corpus_pipeline.drop_toxic_documents, every)
    assert len(calm) == len(rows)
    assert corpus_pipeline.pack_sequences(spark, every, str(tmp_path)).where("piece = 0").count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, every.limit(0), str(tmp_path)).count() == 0
