"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import mapped, text_or_empty

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Beside itself, a word is known by its first letters, which inflected forms share.
PREFIXES = (4, 5, 6)


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-{n}" for n in PREFIXES if len(word) >= n)]


@dataclass
class ToxicityModel:
    """Weights of features and the bias of a text; a few MB, bounded by the training sample.

    The bias is the prior log odds of a text, which its sentences with toxic evidence share: of n each begins at bias - log(n). So what says
    next to nothing doesn't add up with length, and clean sentences around a toxic one don't hide it.
    """

    weights: dict[str, float]
    bias: float
    cache: int = 1 << 18

    def __post_init__(self):
        self.words: dict[str, float] = {}

    def word_weight(self, word: str) -> float:
        w = self.words.get(word)
        if w is None:
            if len(self.words) > self.cache:
                self.words.clear()
            w = self.words[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def logits(self, text: str) -> list[float]:
        """A logit for each sentence with toxic evidence; a text without any counts as one empty sentence."""
        known, unknown = self.words, self.word_weight
        out = []
        for sentence in SENTENCE.findall(text.lower()):
            total = 0.0
            for w in WORD.findall(sentence):
                x = known.get(w)
                total += unknown(w) if x is None else x
            if total > 0:
                out.append(total)
        prior = self.bias - math.log(max(1, len(out)))
        return [prior + x for x in out or [0.0]]

    def score(self, text: str) -> float:
        """Noisy-or 1 - prod(1 - p) of all sentences with toxic evidence."""
        return float(-np.expm1(-np.logaddexp(0, self.logits(text)).sum()))


def held_out(id_col: str = "doc_id"):
    """True on the fold that training never sees: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text: str, label: str) -> DataFrame:
    """(label, text) of at most `rows` labelled ids outside the held-out fold, the first ones by a hash of the id, whatever their texts' length.

    An id has the largest of its labels, and of rows that repeat it one counts, that of the least text by hash: no more than `rows` rows come out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).alias("__label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(text), text)
    sample = docs.where(F.col(text).isNotNull()).select(id_col, text).join(F.broadcast(chosen), id_col).withColumn("__row", F.row_number().over(first)).where("__row = 1").drop("__row")
    return sample.repartition(16, id_col).sortWithinPartitions(F.xxhash64(id_col), id_col, text).select("__label", text)


def train(docs: DataFrame, labels: DataFrame, rows: int = 12_000, id_col: str = "doc_id", text: str = "text", label: str = "toxic", epochs: int = 80, lasso: float = 0.01) -> ToxicityModel:
    """Fits sentence weights so that the noisy-or of a document's sentences explains its label.

    Trained on the driver with Adam over a sample bounded by `rows`. Its texts stream in by sixteenths and are forgotten once read; what stays are
    two 32-bit numbers for each word. Without labelled rows, or with one class only, a model results that gives every sentence the base rate.
    """
    sample = training_sample(docs, labels, rows, id_col, text, label)
    return fit(((r[1], r[0]) for r in sample.toLocalIterator()), epochs, lasso)


def fit(sample: Iterable[tuple[str, float]], epochs: int = 80, lasso: float = 0.01) -> ToxicityModel:
    """train() on (text, label) pairs.

    Weights are not negative: a sentence is toxic for what it holds, whatever else stands beside it, so long sentences hide
    nothing. They start at a lower confidence bound of the log odds between toxic and clean documents and are then
    fitted to the noisy-or of all sentences by Adam with soft thresholding.
    """
    vocabulary: dict[str, int] = {}
    occurrences, sentence_of, document_of, targets = array("i"), array("i"), array("i"), []
    for body, y in sample:
        for sentence in SENTENCE.findall(body.lower()) or [""]:
            words = [vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(sentence)]
            occurrences.extend(words)
            sentence_of.extend([len(document_of)] * len(words))
            document_of.append(len(targets))
        targets.append(float(y > 0))
    y = np.array(targets)
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return ToxicityModel({}, float(np.log(rate / (1 - rate))))
    occ, sent, doc = (np.frombuffer(x, np.int32) for x in (occurrences, sentence_of, document_of))
    # document frequency decides which features are kept: a feature of fewer than 3 documents says nothing
    pairs = np.unique(doc[sent].astype(np.int64) * len(vocabulary) + occ)
    word_documents = np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
    hashes, word_at = array("I"), array("i")  # features by hash: their names would take more than all else
    for word, i in vocabulary.items():
        own = features(word)
        hashes.extend(zlib.crc32(f.encode()) for f in own)
        word_at.extend([i] * len(own))
    distinct, feature_at = np.unique(np.frombuffer(hashes, np.uint32), return_inverse=True)
    word_at, n_features = np.frombuffer(word_at, np.int32), len(distinct)
    kept = np.bincount(feature_at, word_documents[word_at], n_features) >= 3
    use = kept[feature_at]
    word_at, feature_at = word_at[use], feature_at[use]
    n_sentences, n_words = len(doc), len(vocabulary)

    def documents_with(chosen: np.ndarray) -> np.ndarray:
        own = pairs[chosen[pairs // n_words]]
        return np.bincount(feature_at, np.bincount(own % n_words, minlength=n_words)[word_at], n_features)

    toxic, clean = documents_with(y > 0) + 0.5, documents_with(y <= 0) + 0.5
    odds = np.log(toxic / (y.sum() + 1)) - np.log(clean / ((1 - y).sum() + 1))
    w = np.maximum(0, odds - 2 * np.sqrt(1 / toxic + 1 / clean)) * kept
    b = np.log(y.mean() / 4)
    first = np.append(0, np.flatnonzero(np.diff(doc)) + 1)  # each document's first sentence
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, epochs + 1):
        per_word = np.bincount(word_at, w[feature_at], n_words)
        s = np.bincount(sent, per_word[occ], n_sentences)
        told = s > 0
        told[first] |= np.bincount(doc, told, len(y)) == 0  # without evidence, one sentence has the prior
        s += b - np.log(np.bincount(doc, told, len(y)))[doc]
        p = told / (1 + np.exp(-np.clip(s, -40, 40)))
        none = np.exp(-np.bincount(doc, told * np.logaddexp(0, s), len(y)))
        # d loss / d s is p for a clean document and -p * none / (1 - none) for a toxic one
        g = p * np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)[doc]
        gw = np.bincount(feature_at, np.bincount(occ, g[sent], n_words)[word_at], n_features) / len(y) * 100
        gb = g.sum() / len(y) * 100
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix1, fix2 = 1 - 0.9**t, 1 - 0.99**t
        step = 0.1 * (1 - t / (epochs + 1)) + 0.01
        w = np.maximum(0, w - step * (m / fix1 + lasso) / (np.sqrt(v / fix2) + lasso)) * kept
        b -= step * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-3)
    strong = {int(distinct[i]): float(w[i]) for i in np.flatnonzero(kept & (w > 1e-3))}
    return ToxicityModel({f: strong[h] for word in vocabulary for f in features(word) if (h := zlib.crc32(f.encode())) in strong}, float(b))


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted) for every row, from its whole text alone.

    A null or empty text has the score of one empty sentence; repeated rows are scored alike, each on its own; a null id counts as
    not held out; other columns are dropped; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=[id_col, "held_out", "score", "predicted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, held_out(id_col).alias("held_out"), text_or_empty(text)), run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns; edge cases as score_documents, and nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(t or "") < threshold for t in batch.column(place).to_pylist()], pa.bool_()))

    return mapped(docs, run, docs.schema)


def offending_sentences(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, start, end, score, sentence): the sentences that would be toxic as texts of their own, with their place (in characters) in the text.

    Null and empty texts and those of blanks have none, a text without ends of sentences is one of any length, repeated rows each have theirs, a null id
    stays null, other columns are dropped, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for place in SENTENCE.finditer(body):
                    p = own.score(place.group())
                    if p >= threshold:
                        rows.append((key, place.start(), place.end(), p, place.group()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.string())],
                names=[id_col, "start", "end", "score", "sentence"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, text_or_empty(text)), run, f"`{id_col}` {kind}, start long, end long, score double, sentence string")
