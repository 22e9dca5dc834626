"""Packing documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import Scratch, kept, mapped, text_or_empty

#: Controls that Python takes for white space and the tokenizer does not: such texts are encoded whole.
ODD_SPACE = re.compile(r"[\x1c-\x1f]")


#: Lower-case words in letters of Latin-1: normalised as they are, and one pre-token each.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is visible, else the next one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


class WordEncoder:
    """Ids by a `tokenizers` file whose pre-tokens never hold white space, remembered word by word.

    The normaliser composes and lower-cases characters and every pre-token lies within a word, so the ids of a text are those
    of its words in turn. A comma or full stop after a Latin letter is a pre-token of its own, and words in Latin-1 may be lower-cased first, so
    a new word often has a known stem; a plain stem goes to the library's merges alone, any other word to the whole of it. At most
    `cache` words are remembered in each of two generations, of which the older goes when the younger is full: 50 MB each at most, given back when another operator's task comes.
    """

    def __init__(self, path: str, cache: int = 1 << 18):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = {mark: self._whole(mark) for mark in (",", ".")}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= 64:
            if len(self.known) >= self.cache:
                self.old, self.known = self.known, {}
            self.known[word] = ids
        return ids

    def _learn(self, word: str) -> bytes:
        """Ids of a word that the younger generation doesn't have; it has them then."""
        ids = self.old.get(word)
        if ids is not None:
            return self._keep(word, ids)
        stem, mark = word, ""
        if word[-1] in ",." and (word[-2:-1].isascii() or word[-2:-1] <= "\u00ff") and word[-2:-1].isalpha():
            stem, mark = word[:-1], word[-1]
        if "<" not in stem and (stem.isascii() or max(stem) <= "\u00ff"):
            stem = stem.lower()
        if stem == word:
            if PLAIN.fullmatch(word):
                ids_ = [t.id for t in self.model.tokenize(word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode())))]
                return self._keep(word, struct.pack(f"<{len(ids_)}I", *ids_))
            return self._keep(word, self._whole(word))
        own = self.known.get(stem)
        return self._keep(word, (self._learn(stem) if own is None else own) + (self.marks[mark] if mark else b""))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            if ODD_SPACE.search(text):
                out.append(self._whole(text))
                continue
            words = text.split()
            ids = list(map(self.known.get, words))
            if None in ids:
                ids = [self.known.get(w) or self._learn(w) if i is None else i for i, w in zip(ids, words, strict=True)]
            out.append(b"".join(ids))
        return out


def dominant_sets(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello and Toth's reduction on a histogram of lengths: sets to fix for good, and how often; counts shrinks.

    For each length L from the longest down, and the longest k that fits beside it: {L} alone is fixed when nothing fits; {L, k}
    when it fills the sequence, when nothing fits beside the two smallest, or when at most two more documents fit and no feasible pair is longer than k -
    in each case any packing can be changed to hold the set without another sequence.
    """
    fixed = []
    lengths = sorted(counts)
    place = len(lengths)
    while place:
        place -= 1
        large = lengths[place]
        while counts.get(large, 0) > 0:
            own = counts[large]
            room = capacity - large
            beside = [n for n in lengths if counts[n] > (n == large)]
            at = bisect.bisect_right(beside, room) - 1
            if at < 0:
                fixed.append(((large,), own))
                counts[large] = 0
                break
            k = beside[at]
            small = []
            for n in beside[:3]:
                small += [n] * min(3, counts[n] - (n == large))
            fits = 1 + (len(small) > 1 and small[0] + small[1] <= room) + (len(small) > 2 and sum(small[:3]) <= room)
            dominant = k == room or fits == 1
            if not dominant and fits == 2:
                best, i, j = 0, 0, at
                while i <= j:  # the longest feasible pair, by two pointers
                    total = beside[i] + beside[j]
                    if total > room or (i == j and counts[beside[i]] - (beside[i] == large) < 2):
                        j -= 1
                    else:
                        best, i = max(best, total), i + 1
                dominant = best <= k
            if not dominant:
                break
            times = own // 2 if k == large else min(own, counts[k])
            fixed.append(((large, k), times))
            counts[large] -= times
            counts[k] -= times
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: sequences that are filled alike are handled together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                pattern, times, room = (), left, capacity
                each = min(capacity // length, left)
                times = left // each
                pattern, used = (length,) * each, each * times
                rest = capacity - each * length
            else:
                room = rooms[at]
                pattern, have = open_[room].pop()
                times = min(have, left)
                if have > times:
                    open_[room].append((pattern, have - times))
                if not open_[room]:
                    rooms.pop(at)
                pattern, used, rest = (*pattern, length), times, room - length
            left -= used
            if not open_[rest]:
                bisect.insort(rooms, rest)
            open_[rest].append((pattern, times))
    return [x for patterns in open_.values() for x in patterns]


def plan_packing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Slots (length, first rank, first sequence, offset), sorted: the i-th piece of a length belongs to the last slot whose first rank is at most i."""
    counts = dict(counts)
    patterns = dominant_sets(counts, capacity) + best_fit({n: c for n, c in counts.items() if c}, capacity)
    ranks: dict[int, int] = defaultdict(int)
    slots, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            slots.append((length, ranks[length], sequence, offset))
            ranks[length] += times
            offset += length
        sequence += times
    return np.array(sorted(slots), np.int64).reshape(-1, 4)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every document's tokens, placed in sequences of at most `capacity`.

    A document is its ids and then end_id, so a null or empty text is one token; only documents longer than capacity are cut, into
    pieces of capacity and a last shorter one. The plan is made on the driver from the number of pieces of each
    length (capacity numbers at most, whatever the corpus); the pieces of a length are numbered by task and place in the
    task, so no length gathers in one task. Repeated rows are packed one by one; other columns are dropped; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    token = f"packing-{uuid.uuid4().hex}"  # what a worker learns serves this call's tasks alone

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(token, lambda: WordEncoder(path))
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows, keys = [], []
            for i, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[start * 4 : (start + capacity) * 4]
                    length = len(own) // 4
                    keys.append(i)
                    rows.append((piece, start, length, zlib.crc32(own), task, seen[length]))
                    seen[length] += 1
            if rows:
                columns = [batch.column(0).take(pa.array(keys)), *map(lambda c: pa.array(c, pa.int64()), zip(*rows, strict=True))]
                columns[1] = columns[1].cast(pa.int32())
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32", "task", "place"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, task long, place long"
    pieces = scratch.write(mapped(docs.select(id_col, text_or_empty(text)), cut, schema, token), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.write(by_task.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # a slot for each length of each pattern: some tens of thousands (a few MB) at any size of the corpus, for only lengths up to capacity exist
    slots = spark.sparkContext.broadcast(plan_packing(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            sequence = table[at, 2] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(table[at, 3])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = pieces.join(bases.select("length", "task", "base"), ["length", "task"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    return mapped(ranked, place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
