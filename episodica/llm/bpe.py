"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import fingerprints, mapped, mixed, prefix_sums, text_or_empty

#: Characters of text that one vectorised step works on; longer texts are cut between pre-tokens.
STEP = 1 << 20

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def character_classes() -> np.ndarray:
    """Class of every code point, as \\p{L}, \\p{N} and \\s have it; about 1 MB."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            classes[code_points(run.group())] = kind
    return classes


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pre_token_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Marks where the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ cuts.

    kinds has EDGE before the first and after the last character of every text. Of a run of white space the last
    character goes apart when text follows, and a blank there joins what follows; an apostrophe that begins a
    token takes a contraction's letters with it.
    """
    n = len(points)
    before = np.empty(n, np.uint8)
    before[:1], before[1:] = EDGE, kinds[:-1]
    after = np.empty(n, np.uint8)
    after[-1:], after[:-1] = EDGE, kinds[1:]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = points[:-1] == 32
    white = kinds == SPACE
    starts = np.where(white, (before != SPACE) | ((after != SPACE) & (after != EDGE)), (kinds != before) & ~blank_before)
    quotes = np.flatnonzero((points == 39) & starts & (after == LETTER))
    if len(quotes):
        letters = np.zeros(n + 3, np.uint32)
        letters[:n] = np.where(kinds == LETTER, points, 0)
        first, second = letters[quotes + 1], letters[quotes + 2]
        pair = first * np.uint32(256) + second
        one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        two = ~one & np.isin(pair, [ord("r") * 256 + ord("e"), ord("v") * 256 + ord("e"), ord("l") * 256 + ord("l")]) & (first < 256) & (second < 256)
        starts[quotes[one | two] + 1] = False
        for chosen, width in ((one, 2), (two, 3)):
            cut = quotes[chosen] + width
            cut = cut[letters[cut] > 0]
            starts[cut] = True
    return starts


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings by hash and displace; slots hold the strings themselves.

    A lookup costs two gathers and one comparison of the bytes, so strings outside the set are always told apart.
    """

    def __init__(self, keys: list[bytes], values: np.ndarray):
        joined = np.frombuffer(b"".join(keys), np.uint8)
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        ends = np.cumsum(lengths)
        prints = fingerprints(prefix_sums(joined), ends - lengths, ends)
        if len(np.unique(prints)) < len(keys):
            raise ValueError("two keys share a fingerprint")
        n = len(keys)
        self.buckets = np.uint64(max(1, n // 4))
        self.size = np.uint64(n)
        self.shift = np.zeros(int(self.buckets), np.uint64)
        bucket = (prints % self.buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(int(self.buckets) + 1))
        taken = np.zeros(n, bool)
        slots = np.zeros(n, np.int64)
        for b in np.argsort(edges[:-1] - edges[1:], kind="stable"):
            members = order[edges[b] : edges[b + 1]]
            if not len(members):
                break
            tries = 64
            found = None
            start = 0
            while found is None:  # the smallest displacement that puts the whole bucket in free slots
                d = np.arange(start, start + tries, dtype=np.uint64)
                at = (mixed(prints[members][None, :] + (d * np.uint64(0x9E3779B97F4A7C15))[:, None]) % self.size).astype(np.int64)
                free = ~taken[at].any(axis=1)
                if len(members) > 1:
                    apart = np.sort(at, axis=1)
                    free &= (apart[:, 1:] != apart[:, :-1]).all(axis=1)
                good = np.flatnonzero(free)
                if len(good):
                    found = (int(d[good[0]]), at[good[0]])
                start, tries = start + tries, min(tries * 2, 1 << 14)
            self.shift[b] = found[0] * 0x9E3779B97F4A7C15 % (1 << 64)
            taken[found[1]] = True
            slots[members] = found[1]
        inverse = np.empty(n, np.int64)
        inverse[slots] = np.arange(n)
        self.values = np.asarray(values)[inverse]
        self.lengths = lengths[inverse]
        self.offsets = np.zeros(n, np.int64)
        self.offsets[1:] = np.cumsum(self.lengths)[:-1]
        self.blob = np.frombuffer(b"".join(keys[i] for i in inverse) + bytes(8), np.uint8)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Value of each slice data[start:end], -1 where it is not among the keys."""
        prints = fingerprints(prefix_sums(data), starts, ends)
        slot = (mixed(prints + self.shift[(prints % self.buckets).astype(np.int64)]) % self.size).astype(np.int64)
        same = np.flatnonzero(self.lengths[slot] == ends - starts)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        step = np.arange(8)
        done = 0
        width = ends - starts
        while len(rest := same[width[same] > done]):  # eight bytes at a time; most pre-tokens are done at once
            a = padded[(starts[rest] + done)[:, None] + step]
            b = self.blob[(self.offsets[slot[rest]] + done)[:, None] + step]
            beyond = step[None, :] >= (width[rest] - done)[:, None]
            wrong = rest[~((a == b) | beyond).all(axis=1)]
            if len(wrong):
                width = width.copy()
                width[wrong] = -1
            done += 8
        out = np.full(len(starts), -1, np.int64)
        right = same[width[same] >= 0]
        out[right] = self.values[slot[right]]
        return out


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank merges first, the leftmost of equals; O(n log n)."""
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    ends = list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if ends[i] == 0 or j >= n or ends[j] != end:  # one of the two has merged otherwise meanwhile
            continue
        ends[i], ends[j] = end, 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : ends[k]])) is not None:
                heapq.heappush(heap, (r, i, ends[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    return [ranks[piece[i : ends[i]]] for i in range(n) if ends[i]]


class ByteBPE:
    """Encoder and decoder of one vocabulary; `cache` pre-tokens outside it are remembered at most."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray, whole: PerfectHash, cache: int = 1 << 18):
        self.ranks, self.classes, self.whole, self.cache = ranks, classes, whole, cache
        top = max(ranks.values()) + 1
        self.singles = [i.to_bytes(4, "little") for i in range(top)]
        self.runs: list[bytes] = list(self.singles)
        self.known: dict[bytes, int] = {}
        tokens = [b""] * top
        for token, rank in ranks.items():
            tokens[rank] = token
        self.widths = np.fromiter(map(len, tokens), np.int64, top)
        self.places = np.zeros(top, np.int64)
        self.places[1:] = np.cumsum(self.widths)[:-1]
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)

    def _of_misses(self, data: bytes, starts: list[int], ends: list[int]) -> list[int]:
        out = []
        for s, e in zip(starts, ends, strict=True):
            piece = data[s:e]
            at = self.known.get(piece)
            if at is None:
                at = len(self.runs)
                self.runs.append(np.array(merge_bytes(piece, self.ranks), "<u4").tobytes())
                if e - s <= 64:
                    self.known[piece] = at
            out.append(at)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.runs) > len(self.singles) + self.cache:
            self.known, self.runs = {}, list(self.singles)
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for text in texts:
            if len(text) > STEP:
                out += self._encode_group(group)
                group, size = [], 0
                out.append(b"".join(part for piece in cut_between_tokens(text) for part in self._encode_group([piece])))
                continue
            if size + len(text) > STEP:
                out += self._encode_group(group)
                group, size = [], 0
            group.append(text)
            size += len(text) + 1
        return out + self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        points = code_points("\0".join(texts) + "\0")
        kinds = self.classes[points]
        edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kinds[edges] = EDGE
        starts = pre_token_starts(points, kinds)
        starts[edges] = True
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.cumsum(width) - width
        data = "\0".join(texts).encode() + b"\0"
        first = np.flatnonzero(starts)
        edge = kinds[first] == EDGE
        begin = place[first]
        end = np.append(begin[1:], len(data))
        begin, end = begin[~edge], end[~edge]
        found = self.whole.lookup(np.frombuffer(data, np.uint8), begin, end)
        missing = np.flatnonzero(found < 0)
        found[missing] = self._of_misses(data, begin[missing].tolist(), end[missing].tolist())
        runs = list(map(self.runs.__getitem__, found.tolist()))
        bounds = np.cumsum(~edge)[edge].tolist()
        return [b"".join(runs[a:b]) for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        parts = []
        every = np.frombuffer(ids, "<u4")
        for i in range(0, len(every), STEP):
            own = every[i : i + STEP].astype(np.int64)
            widths = self.widths[own]
            ends = np.cumsum(widths)
            parts.append(self.letters[np.repeat(self.places[own] - (ends - widths), widths) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)


def cut_between_tokens(text: str) -> Iterator[str]:
    """Pieces of a long text that start at a blank between two visible characters, where a pre-token always starts."""
    begin = 0
    while len(text) - begin > STEP:
        at = begin + STEP
        while at < len(text) - 1 and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()):
            at += 1
        yield text[begin:at]
        begin = at
    yield text[begin:]


def make_tables(path: str) -> tuple[dict[bytes, int], np.ndarray, PerfectHash]:
    """What a vocabulary needs on every worker: a few MB, set by the vocabulary alone."""
    ranks = read_ranks(path)
    return ranks, character_classes(), PerfectHash(list(ranks), np.fromiter(ranks.values(), np.int64, len(ranks)))


def _map_texts(docs: DataFrame, path: str, id_col: str, text: str, schema: str, row) -> DataFrame:
    tables = docs.sparkSession.sparkContext.broadcast(make_tables(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBPE(*tables.value)
        for batch in batches:
            columns = row(coder, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns.values()], names=[id_col, *columns])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, text_or_empty(text)), run, f"`{id_col}` {kind}, {schema}")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) per row, in the vocabulary of a rank file.

    Null and empty texts have no ids; a very long text is encoded in pieces cut between pre-tokens; repeated rows each give a row;
    other columns are dropped; an empty table gives no rows. Special tokens are ordinary text.
    """

    def row(coder: ByteBPE, texts: list[str]) -> dict:
        ids = coder.encode(texts)
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))}

    return _map_texts(docs, path, id_col, text, "ids array<int>", row)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, bytes binary) per row; null ids give empty bytes."""
    tables = encoded.sparkSession.sparkContext.broadcast(make_tables(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBPE(*tables.value)
        for batch in batches:
            decoded = [coder.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], names=[id_col, "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return mapped(encoded.select(id_col, F.col(ids)), run, f"`{id_col}` {kind}, bytes binary")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: encodes each whole text, then decodes the ids; edge cases as encode_documents."""

    def row(coder: ByteBPE, texts: list[str]) -> dict:
        ids = coder.encode(texts)
        return {
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            "decoded_sha256": pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]),
        }

    return _map_texts(docs, path, id_col, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)
