"""Repair of the structure of conversations by cheapest edits: shortest paths over (rows read, last role), by buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import Scratch, mapped

#: Rows and bytes of text of a segment at most (a longer row is a segment of its own); only conversations beyond it, or across tasks, are in several.
SEGMENT_ROWS, SEGMENT_BYTES = 256, 1 << 20
WHITE = " \t\n\x0b\x0c\r"
#: Role initials of a conversation: nothing, or an optional s, then one or more times ua. States are its last initial; 0 is none yet.
START, SYSTEM, USER, ASSISTANT = range(4)
KINDS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The only role that may come next, where it isn't a first s, is what an inserted or renamed row gets.
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLES = ("", "", "user", "assistant")
LEGAL = {"su", "ua", "au"}
DELETE, INSERT, RENAME, UNFINISHED = 3, 2, 2, 1
#: No path; less than any 32-bit number's end, more than any cost.
FAR = 1 << 60
END = (0, FAR, FAR, 0)

Row = tuple[int, bool, bool]  # kind of the role (0 for others), truncated, must go


def kept_state(state: int, kind: int) -> int | None:
    """The state after a row that stays as it is, if it may stand there."""
    return kind if kind == FOLLOWS[state] or (state == START and kind == SYSTEM) else None


def distances(rows: list[Row], after: tuple[int, ...]) -> list[int]:
    """Cheapest cost from each node (4 * rows read + state) to the end, where ending in a state costs after[state].

    Dial's algorithm from the end: arcs cost 3 at most, so a ring of buckets, one per cost in reach, is the queue.
    """
    n = len(rows)
    dist = [FAR] * (4 * n + 4)
    ends = [a for a in after if a < FAR]
    if not ends:
        return dist
    base = min(ends)
    size = max(DELETE, RENAME + UNFINISHED, max(ends) - base) + 1
    ring: list[list[int]] = [[] for _ in range(size)]
    left = 0

    def reach(node: int, cost: int) -> int:
        if cost < dist[node]:
            dist[node] = cost
            ring[(cost - base) % size].append(node)
            return 1
        return 0

    for state, a in enumerate(after):
        if a < FAR:
            left += reach(4 * n + state, a)
    cost = base
    while left:
        bucket = ring[(cost - base) % size]
        while bucket:
            node = bucket.pop()
            left -= 1
            if dist[node] != cost:
                continue
            i, state = divmod(node, 4)
            into = [s for s in range(4) if FOLLOWS[s] == state]
            for s in into:
                left += reach(4 * i + s, cost + INSERT)
            if i:
                kind, truncated, gone = rows[i - 1]
                left += reach(node - 4, cost + DELETE)
                if not gone:
                    for s in into:
                        left += reach(4 * i - 4 + s, cost + RENAME + truncated)
                    for s in range(4):
                        if kept_state(s, kind) == state:
                            left += reach(4 * i - 4 + s, cost + truncated)
        cost += 1
    return dist


def walk(rows: list[Row], dist: list[int], after: tuple[int, ...], state: int) -> tuple[str, list[int], int]:
    """From the first node along arcs that lose no cost, by the least letter each time: the letters, the state after each, and the last one."""
    audit, states, i, n = [], [], 0, len(rows)
    while True:
        d = dist[4 * i + state]
        if i == n and d == after[state]:
            return "".join(audit), states, state
        follows = FOLLOWS[state]
        if i < n and dist[4 * i + 4 + state] + DELETE == d:
            letter, i = "D", i + 1
        elif dist[4 * i + follows] + INSERT == d:
            letter, state = "I", follows
        else:
            kind, truncated, _ = rows[i]
            stays = kept_state(state, kind)
            if stays is not None and dist[4 * i + 4 + stays] + truncated == d:
                letter, state = "K", stays
            else:
                letter, state = "R", follows
            i += 1
        audit.append(letter)
        states.append(state)


def judged(rows: list[dict], seen: set[bytes]) -> tuple[list[Row], dict]:
    """What the edits need to know of each row, and the counts of a segment; rows hold turn, role, text and key (a digest of role and text)."""
    found, facts, turns = [], {"n": len(rows), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, [r["turn"] for r in rows if r["turn"] is not None]
    seen = set(seen)
    for before, r in zip([None, *rows], rows, strict=False):
        text = r["text"].rstrip(WHITE)
        fault = "blank" if not text else "duplicate" if r["key"] in seen else "truncated" if text[-1] not in ".!?" else None
        seen.add(r["key"])
        if fault:
            facts[fault] += 1
        found.append((KINDS.get(r["role"][:1], 0), fault == "truncated", fault in ("blank", "duplicate")))
        if before and before["role"][:1] + r["role"][:1] not in LEGAL:
            facts["illegal"] += 1
    facts |= {"first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns))}
    facts |= {"first_initial": rows[0]["role"][:1] if rows else None, "last_initial": rows[-1]["role"][:1] if rows else None}
    return found, facts


def edited(rows: list[dict], codes: list[Row], after: tuple[int, ...], state: int) -> dict:
    """The cheapest edits of a segment from a state, and the rows they leave."""
    dist = distances(codes, after)
    audit, states, last = walk(codes, dist, after, state)
    edits, source = [], iter(rows)
    for letter, s in zip(audit, states, strict=True):
        r = next(source) if letter != "I" else None
        if letter == "K":
            edits.append({"edit": letter, "role": r["role"], "text": r["text"]})
        elif letter != "D":
            edits.append({"edit": letter, "role": ROLES[s], "text": r["text"] if r else ""})
    return {"cost": dist[state] - after[last], "audit": audit, "edits": edits}


COUNTS = [("n", "long"), ("first_turn", "long"), ("last_turn", "long"), ("turns", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("first_initial", "string"), ("last_initial", "string")]
ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32()}
EDITS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("key", pa.binary())]))
PIECE_SQL = ", ".join(f"{c} {k}" for c, k in COUNTS) + ", cost long, audit string, edits array<struct<edit:string,role:string,text:string>>"
PIECE = [(c, ARROW[k]) for c, k in COUNTS] + [("cost", pa.int64()), ("audit", pa.string()), ("edits", EDITS)]


def _emit(rows: Iterator[tuple[int, dict]], fields: list) -> Iterator[pa.RecordBatch]:
    """Batches of rows, which come with their bytes; a batch has a few MB, or one row."""
    schema, held, weight = pa.schema(fields), [], 0
    for size, row in rows:
        held.append(row)
        weight += size + 64
        if weight > SEGMENT_BYTES or len(held) == 512:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cut(most: int):
    """Solves conversations that lie within a task in one segment of at most so many rows; the others, and those at its edges, come out as segments."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        kind: list[pa.DataType] = []

        def segment(g, conv, number: int, rows: list[dict], weight: int, is_open: bool) -> tuple[int, dict]:
            out = {"g": g, "conv": conv, "at": part + number}
            if is_open:
                return weight, out | {"rows": rows}
            codes, facts = judged(rows, set())
            return weight, out | facts | edited(rows, codes, END, START)

        def run() -> Iterator[tuple[int, dict]]:
            g = conv = None
            rows, weight, number, first, none_yet = [], 0, 0, True, True
            for batch in batches:
                kind[:] = [batch.schema.field("conv").type]
                for r in batch.to_pylist():
                    if none_yet or r["g"] != g:
                        if not none_yet:
                            yield segment(g, conv, number, rows, weight, first or number > 0)
                            first = False
                        g, conv, rows, weight, number, none_yet = r["g"], r["conv"], [], 0, 0, False
                    if r["text"] is None:  # a row that the damage dropped only says that its conversation was there
                        continue
                    size = 4 * (len(r["text"]) + len(r["role"]))
                    if rows and (len(rows) >= most or weight + size > SEGMENT_BYTES):
                        yield segment(g, conv, number, rows, weight, True)
                        rows, weight, number = [], 0, number + 1
                    rows.append({"turn": r["turn"], "role": r["role"], "text": r["text"], "key": r["key"]})
                    weight += size
            if not none_yet:
                yield segment(g, conv, number, rows, weight, True)

        source = run()
        head = next(source, None)
        if head is not None:
            yield from _emit(_chained(head, source), [("g", pa.string()), ("conv", kind[0]), ("at", pa.int64()), *PIECE, ("rows", ROWS)])

    return task


def _chained(head, rest):
    yield head
    yield from rest


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of open segments: the rows' codes, the counts, and the cheapest cost from each state to each (16 numbers)."""

    def run() -> Iterator[tuple[int, dict]]:
        for batch in batches:
            for r in batch.to_pylist():
                codes, facts = judged(r["rows"], set(r["seen"] or ()))
                by_end = [distances(codes, tuple(0 if s == e else FAR for s in range(4)))[:4] for e in range(4)]
                yield 1024, {"g": r["g"], "at": r["at"], "codes": bytes(k + 4 * t + 8 * d for k, t, d in codes), "costs": [by_end[e][s] for s in range(4) for e in range(4)]} | facts

    yield from _emit(run(), [("g", pa.string()), ("at", pa.int64()), ("codes", pa.binary()), ("costs", pa.list_(pa.int64())), *PIECE[: len(COUNTS)]])


def _coded(codes: bytes) -> list[Row]:
    return [(c & 3, bool(c & 4), bool(c & 8)) for c in codes]


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left to pay after each segment, by state; segments of a conversation come last first."""

    def run() -> Iterator[tuple[int, dict]]:
        g, after = None, END
        for batch in batches:
            for r in batch.to_pylist():
                if r["g"] != g:
                    g, after = r["g"], END
                yield 64, {"g": g, "at": r["at"], "after": list(after)}
                after = tuple(min(FAR, *(r["costs"][4 * s + e] + after[e] for e in range(4))) for s in range(4))

    yield from _emit(run(), [("g", pa.string()), ("at", pa.int64()), ("after", pa.list_(pa.int64()))])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which the walk leaves a segment, by the one in which it comes."""

    def run() -> Iterator[tuple[int, dict]]:
        for batch in batches:
            for r in batch.to_pylist():
                codes, after = _coded(r["codes"]), tuple(r["after"])
                dist = distances(codes, after)
                yield 64, {"g": r["g"], "at": r["at"], "after": r["after"], "exits": [walk(codes, dist, after, s)[2] if dist[s] < FAR else s for s in range(4)]}

    yield from _emit(run(), [("g", pa.string()), ("at", pa.int64()), ("after", pa.list_(pa.int64())), ("exits", pa.list_(pa.int32()))])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which the walk comes into each segment; segments of a conversation come in order."""

    def run() -> Iterator[tuple[int, dict]]:
        g, state = None, START
        for batch in batches:
            for r in batch.to_pylist():
                if r["g"] != g:
                    g, state = r["g"], START
                yield 64, {"g": g, "at": r["at"], "after": r["after"], "state": state}
                state = r["exits"][state]

    yield from _emit(run(), [("g", pa.string()), ("at", pa.int64()), ("after", pa.list_(pa.int64())), ("state", pa.int32())])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of open segments."""
    for batch in batches:
        kind = batch.schema.field("conv").type

        def run(batch=batch) -> Iterator[tuple[int, dict]]:
            for r in batch.to_pylist():
                made = edited(r["rows"], _coded(r["codes"]), tuple(r["after"]), r["state"])
                yield sum(4 * len(x["text"]) for x in r["rows"]), {k: r[k] for k in ("g", "conv", "at", *(c for c, _ in COUNTS))} | made

        yield from _emit(run(), [("g", pa.string()), ("conv", kind), ("at", pa.int64()), *PIECE])


def repair_pieces(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT_ROWS) -> DataFrame:
    """Pieces of all conversations with their cheapest edits: (g, conv, at, whole, counts, cost, audit, edits); by `at` they follow each other.

    A conversation's rows go by turn (nulls first), those of one turn by a digest of role and text. A null text says that a conversation had a row
    which is gone: it counts for nothing, but a conversation of such rows alone still has a piece. Roles other than by their initials s, u and a
    must be renamed or deleted. Null roles count as one space; a null conversation is one of its own; repeated rows are duplicates; other columns
    are dropped; an empty table gives no pieces.

    Rows are sorted by ranges, so that a conversation of any length spreads over tasks. What lies within a task in one segment is solved there.
    The segments of others hand on the cost from each state to each: a row per segment is streamed, backwards for what is left to pay and forwards
    for the states; everything that reads rows works on segments.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    kind = rows.schema[conv].dataType.simpleString()
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.col(text).alias("text"))
    own = own.withColumn("g", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("-")))
    own = own.withColumn("key", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    order = ["g", "turn", "key", "tie"]
    dealt = own.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    head = f"g string, conv {kind}, at long"
    cut = scratch.write(mapped(dealt, _cut(segment), f"{head}, {PIECE_SQL}, rows array<struct<turn:bigint,role:string,text:string,key:binary>>"), "cut")
    whole = cut.where("rows IS NULL").drop("rows").withColumn("whole", F.lit(True))
    segments = cut.where("rows IS NOT NULL").select("g", "conv", "at", "rows")

    keys = segments.select("g", "at", F.explode(F.array_distinct("rows.key")).alias("key"))
    first = keys.groupBy("g", "key").agg(F.min("at").alias("first"))
    later = keys.join(first, ["g", "key"]).where("at > first").groupBy("g", "at").agg(F.collect_list("key").alias("seen"))
    counts = ", ".join(f"{c} {k}" for c, k in COUNTS)
    measured = segments.join(later, ["g", "at"], "left").select("g", "at", "rows", "seen")
    measured = scratch.write(mapped(measured, _measure, f"g string, at long, codes binary, costs array<long>, {counts}"), "measured")
    last_first = measured.select("g", "at", "costs").repartition("g").sortWithinPartitions("g", F.desc("at"))
    after = scratch.write(mapped(last_first, _backward, "g string, at long, after array<long>"), "after")
    exits = scratch.write(mapped(measured.select("g", "at", "codes").join(after, ["g", "at"]), _exits, "g string, at long, after array<long>, exits array<int>"), "exits")
    states = mapped(exits.repartition("g").sortWithinPartitions("g", "at"), _forward, "g string, at long, after array<long>, state int")
    states = scratch.write(states, "states").join(measured.drop("costs"), ["g", "at"])
    settled = scratch.write(mapped(segments.join(states, ["g", "at"]), _settle, f"{head}, {PIECE_SQL}"), "settled")
    return whole.unionByName(settled.withColumn("whole", F.lit(False)))


def repaired_rows(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conversation, at, place, edit, role, text): the rows that the edits leave, in order by (at, place)."""
    return pieces.select(F.col("conv").alias(conv), "at", F.posexplode("edits").alias("place", "e")).select(conv, "at", "place", "e.edit", "e.role", "e.text")


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its pieces, which come in order; a text is hashed as it passes."""
    kind: list[pa.DataType] = []

    def run() -> Iterator[tuple[int, dict]]:
        g, out = None, None
        for batch in batches:
            kind[:] = [batch.schema.field("conv").type]
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if out is None or r["g"] != g:
                    if out is not None:
                        yield len(out["audit"]), _closed(out)
                    g, out = r["g"], {"conv": r["conv"], "sum": hashlib.sha256(), "begun": False, "audit": [], "low": None, "high": None, "turns": 0, "initial": None} | dict.fromkeys(RESULT, 0)
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    out[c] += r[c]
                if r["n"]:
                    if out["initial"] is not None and out["initial"] + r["first_initial"] not in LEGAL:
                        out["illegal"] += 1
                    out["initial"] = r["last_initial"]
                if r["first_turn"] is not None:
                    out["turns"] += r["turns"] - (r["first_turn"] == out["high"])
                    out["low"], out["high"] = r["first_turn"] if out["low"] is None else out["low"], r["last_turn"]
                out["audit"].append(r["audit"])
                for e in r["edits"]:
                    out["sum"].update(f"{chr(10) if out['begun'] else ''}{e['role']}:{e['text']}".encode())
                    out["begun"] = True
        if out is not None:
            yield len(out["audit"]), _closed(out)

    source = run()
    head = next(source, None)
    if head is not None:
        yield from _emit(_chained(head, source), [("conv", kind[0]), *((c, pa.int64()) for c in RESULT), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _closed(out: dict) -> dict:
    gaps = 0 if out["low"] is None else out["high"] - out["low"] + 1 - out["turns"]
    return {c: out[c] for c in ("conv", *RESULT)} | {"gaps": gaps, "audit": "".join(out["audit"]), "repaired_sha256": out["sum"].hexdigest()}


def repair_report(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row each.

    A conversation in one piece needs no shuffle. The pieces of others are streamed in order through a task, which holds a hash and the audit,
    never the rows: a hash of a text can't be taken in parts.
    """
    lines = F.transform("edits", lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    kind = pieces.schema["conv"].dataType.simpleString()
    whole = pieces.where("whole").select("conv", gaps.alias("gaps"), *RESULT[1:], "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    rest = pieces.where("NOT whole").drop("whole").repartition("g").sortWithinPartitions("g", "at")
    rest = mapped(rest, _fold, f"conv {kind}, {', '.join(f'{c} long' for c in RESULT)}, audit string, repaired_sha256 string")
    return whole.unionByName(rest).withColumnRenamed("conv", conv)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows harmed by crc32 of `conv_id:turn` modulo 20 (nulls count as one space): 0 dropped, which leaves a row whose text is null, 1 emptied,
    2 without [.!?], 3 there twice, 4 said by the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    rule = F.crc32(key.cast("binary")) % 20
    said, who = F.coalesce(F.col(text), space), F.coalesce(F.col(role), space)
    harmed = F.when(rule == 1, "").when(rule == 2, F.translate(said, ".!?", "")).when(rule != 0, said)
    out = rows.select(conv, turn, F.when(rule == 4, "user").otherwise(who).alias(role), harmed.alias(text), F.sequence(F.lit(1), F.when(rule == 3, 2).otherwise(1)).alias("__times"))
    return out.withColumn("__times", F.explode("__times")).drop("__times")
