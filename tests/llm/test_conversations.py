"""Conversation repair against all edit scripts, and against a plain dynamic programme."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from episodica.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, g string, at long, n long, cost long"


def harmed(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        if rule:
            mine.extend([(turn, "user" if rule == 4 else role, text)] * (2 if rule == 3 else 1))
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest())) for k, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) by what is left to do, row by row from the end; more than two insertions in a row never help."""
    found, best = faults(rows), {}
    for i in reversed(range(len(rows) + 1)):
        own = {}
        for last in ("", "s", "u", "a"):
            follows = "a" if last == "u" else "u"
            name = {"u": "user", "a": "assistant"}[follows]
            ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
            if i < len(rows):
                _, role, text = rows[i]
                arcs = [(3, "D", (), last)]
                if found[i] not in ("blank", "duplicate"):
                    late = found[i] == "truncated"
                    if role[:1] == follows or (last == "" and role[:1] == "s"):
                        arcs.append((late, "K", (f"{role}:{text}",), role[:1]))
                    arcs.append((2 + late, "R", (f"{name}:{text}",), follows))
                ways += [(c + best[to][0], x + best[to][1], w + best[to][2]) for c, x, w, to in arcs if to in best]
            own[last] = ways
        for _ in range(2):
            grown = {k: list(v) for k, v in own.items()}
            for last in own:
                follows = "a" if last == "u" else "u"
                name = {"u": "user", "a": "assistant"}[follows]
                grown[last] += [(2 + c, "I" + x, (f"{name}:", *w)) for c, x, w in own[follows]]
            own = {k: [min(v, key=lambda w: w[:2])] if v else [] for k, v in grown.items()}
        best = {k: v[0] for k, v in own.items() if v}
    return best[""]


def expected(table):
    out = []
    for conv, rows in harmed(table).items():
        found, turns = faults(rows), [r[0] for r in rows if r[0] is not None]
        cost, audit, lines = cheapest(tuple(rows))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_expectation_is_the_best_of_all_scripts():
    """For tiny conversations every string of edits is tried, the shortest paths and the test's own recursion must agree with the best of them."""
    rng = random.Random(3)
    for _ in range(60):
        rows = [(t, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b", "", "a."])) for t in range(rng.randrange(4))]
        found, best = faults(rows), None
        for size in range(len(rows) + 4):
            for script in product("DIKR", repeat=size):
                if sum(c != "I" for c in script) != len(rows):
                    continue
                i, last, cost, good = 0, "", 0, True
                for c in script:
                    follows = "a" if last == "u" else "u"
                    if c == "I":
                        cost, last = cost + 2, follows
                        continue
                    late, i = found[i] == "truncated", i + 1
                    if c == "D":
                        cost += 3
                        continue
                    first = rows[i - 1][1][:1]
                    good &= found[i - 1] not in ("blank", "duplicate") and (c == "R" or first == follows or (last == "" and first == "s"))
                    cost += late + 2 * (c == "R")
                    last = follows if c == "R" or first != "s" else "s"
                if good and last in ("", "a"):
                    best = min(best or (cost, "".join(script)), (cost, "".join(script)))
        keyed = [{"turn": t, "role": r, "text": x, "key": f"{r}:{x}".encode()} for t, r, x in rows]
        codes, _ = C.judged(keyed, set())
        got = C.edited(keyed, codes, C.END, C.START)
        assert (got["cost"], got["audit"]) == best == cheapest(tuple(rows))[:2]


def conversations(n, seed, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "User"]), rng.choice(["Yes.", "No", "", " \t", None, "So?", f"é {rng.random()}.", "漢!"])))
    return rows


def hot(n, seed=5):
    rng = random.Random(seed)
    return [(7, t if t % 50 else None, ("user", "assistant")[t % 2] if rng.random() < 0.8 else rng.choice(["system", "tool", "user"]), rng.choice([f"Line {t}.", f"line {t}", "same.", ""])) for t in range(n)]


TABLES = {
    "none": [],
    "small": conversations(120, 1),
    "null conversation": [(None, None, None, None), (None, 1, "user", "Hm."), (3, None, "user", "x" * 2_000_000 + ".")],
    "one hot": conversations(30, 2) + hot(1500),
    "equal rows": [(1, 0, "user", "Same.")] * 700 + [(2, 1, "assistant", "Same.")] * 3,
}


@pytest.mark.parametrize("rows", [3, 256])
@pytest.mark.parametrize("case", TABLES)
def test_report(spark, case, rows):
    table = TABLES[case]
    data = spark.createDataFrame([(*r, "g", 1, 2, 3) for r in table], SCHEMA).repartition(7)
    got = C.repair_report(C.repair_pieces(C.damaged(data), segment=rows))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(table)


@pytest.mark.parametrize("cut", [1, 2, 5])
def test_segments_compose(cut):
    """A conversation cut into segments has the edits of the whole."""
    rng = random.Random(cut)
    for _ in range(200):
        codes = [(rng.randrange(4), rng.random() < 0.3, rng.random() < 0.2) for _ in range(rng.randrange(14))]
        codes = [(k, t and not d, d) for k, t, d in codes]
        dist = C.distances(codes, C.END)
        audit, _, _ = C.walk(codes, dist, C.END, C.START)
        parts = [codes[i : i + cut] for i in range(0, len(codes), cut)] or [[]]
        after = [C.END]
        for p in reversed(parts):
            costs = [C.distances(p, tuple(0 if s == e else C.FAR for s in range(4)))[:4] for e in range(4)]
            after.append(tuple(min(C.FAR, *(costs[e][s] + after[-1][e] for e in range(4))) for s in range(4)))
        after = after[::-1][1:]
        state, pieces = C.START, []
        for p, a in zip(parts, after, strict=True):
            letters, _, state = C.walk(p, C.distances(p, a), a, state)
            pieces.append(letters)
        assert "".join(pieces) == audit


def test_repaired_rows(spark):
    data = spark.createDataFrame([(1, 0, "tool", "Who."), (1, 1, "assistant", "Me."), (2, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    got = C.repaired_rows(C.repair_pieces(data)).orderBy("conv_id", "at", "place").select("conv_id", "edit", "role", "text").collect()
    assert [tuple(r) for r in got] == [(1, "R", "user", "Who."), (1, "K", "assistant", "Me."), (2, "K", "user", "Hi."), (2, "I", "assistant", "")]
