"""Token counts by a piece model, without tokenising every word again."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import mapped, text_or_empty

#: A unit is a run of spaces with what follows up to the next space; no piece of the model reaches over its end.
UNIT = re.compile(r" +[^ ]*")
ESCAPED_SPACE = "▁"


def units(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space: encoding puts that one back."""
    words = text.split(" ")
    if "" not in words:
        return words
    return [u[1:] for u in UNIT.findall(" " + text)] if text else []


def _frequent_of_partition(keep: int):
    """Lossy counting: at most 8 * keep words in memory, the keep most frequent of a partition leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(text.split(" "))
                if len(seen) > 8 * keep:
                    seen = Counter(dict(seen.most_common(4 * keep)))
        top = [(w, n) for w, n in seen.most_common(keep) if w and len(w) <= 64 and ESCAPED_SPACE not in w]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    return run


def frequent_lengths(docs: DataFrame, model: str, text: str = "text", entries: int = 1 << 15) -> dict[str, int]:
    """Token counts of the corpus's frequent pre-tokens, at most `entries` of them (a few MB however large the corpus).

    Every task summarises its own rows by lossy counting in bounded memory and hands on at most `entries` words, so no
    pre-tokens are shuffled, only those summaries. The table makes counting faster and never changes a count.
    """
    import sentencepiece

    rows = (
        mapped(docs.select(text_or_empty(text)), _frequent_of_partition(entries), "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(entries)
        .collect()
    )
    words = [r["word"] for r in rows]
    pieces = sentencepiece.SentencePieceProcessor(model_file=model).encode(words, num_threads=1)
    return {w: len(p) for w, p in zip(words, pieces, strict=True)}


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", limit: int = 4096, entries: int = 1 << 15, cache: int = 1 << 18) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row, as sentencepiece counts the whole text without begin or end tokens.

    Two tiers, both on the map side: a broadcast table of frequent pre-token lengths (frequent_lengths), then a cache in
    the worker of at most `cache` pre-tokens, filled by encoding the misses of a batch together. A text that holds
    U+2581 is encoded whole, as the model cannot tell it from a space; a pre-token over 64 characters is encoded
    without entering the cache. A model with other special pieces or a normaliser is refused, for pre-tokens need not
    be independent there. Null and empty texts have 0 tokens; repeated ids are counted row by row; other columns are dropped;
    an empty table gives no rows.
    """
    import sentencepiece

    check = sentencepiece.SentencePieceProcessor(model_file=model)
    inner = [p for p in map(check.id_to_piece, range(check.get_piece_size())) if ESCAPED_SPACE in p.lstrip(ESCAPED_SPACE)]
    if inner or check.encode("a b ", out_type=str)[-1] != ESCAPED_SPACE or check.encode("") or len(check.encode("  ")) != len(check.encode(ESCAPED_SPACE * 2)):
        raise ValueError("pieces of this model reach over spaces; its texts cannot be counted by pre-token")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model, text, entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        # an empty unit is a space at the end of a text; both tiers share one dictionary, of which the first never leaves
        frequent = table.value | {"": 1}
        known = dict(frequent)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, missing = [], []
            for t in texts:
                if ESCAPED_SPACE in t:
                    counts.append(len(encoder.encode(t)))
                    continue
                words = units(t)
                lengths = list(map(known.get, words))
                if None in lengths:
                    missing.append((len(counts), [w for w, n in zip(words, lengths, strict=True) if n is None]))
                    counts.append(sum(filter(None, lengths)))
                else:
                    counts.append(sum(lengths))
            fresh = list({w for _, words in missing for w in words})
            found = {w: len(p) for w, p in zip(fresh, encoder.encode(fresh, num_threads=1), strict=True)} if fresh else {}
            for row, words in missing:
                counts[row] += sum(map(found.__getitem__, words))
            if len(known) + len(found) > len(frequent) + cache:
                known = dict(frequent)
            known.update((w, n) for w, n in found.items() if len(w) <= 64)
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, text_or_empty(text)), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
