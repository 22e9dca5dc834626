"""A corpus pipeline: from raw documents to packed training sequences.

STAGES lists (name, function) in order. Each function takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents, of any names. Null texts count as empty throughout, texts may be of any length, and an empty
table passes through.

A row is told from others by a key of its own, never by doc_id: rows without an id and
rows that repeat one are rows like any other, and no stage makes one row into two.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.common import Scratch, mapped
from episodica.llm.exactdedup import exact_dedup
from episodica.llm.jaccard import jaccard_components
from episodica.llm.packing import pack_documents
from episodica.llm.queries import table, vocabulary
from episodica.llm.suffix import remove_repeats
from episodica.llm.toxicity import drop_toxic, train

#: Near copies share this percentage of their word n-grams, and n-grams have so many words.
SIMILARITY, WORDS = 80, 5


def unused(name: str, columns: list[str]) -> str:
    """A column name that differs from those given, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(spark: SparkSession, docs: DataFrame, stage: str) -> tuple[DataFrame, str, str]:
    """Rows with a key of their own and an order: by doc_id (nulls last), then by key; and the names of the two.

    The key of a row of Parquet files is its file and its place there. Rows from elsewhere are written with a number first, so
    that the key stays the same however often a task runs again.
    """
    key = unused("row_key", docs.columns)
    order = unused("row_order", docs.columns)
    try:
        rows = docs.select("*", F.struct(F.unhex(F.md5("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row")).alias(key))
    except AnalysisException:
        rows = Scratch(spark, f"rows-{stage}").write(docs.withColumn(key, F.struct(F.monotonically_increasing_id().alias("row"))), "rows")
    return rows.withColumn(order, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", f"{key}.*")), key, order


def first_of_each(docs: DataFrame, key: str, order: str, verdicts: DataFrame, first: str) -> DataFrame:
    """The rows that come first in their group: verdicts have every row's place in the order, and that of its group's first row."""
    stay = verdicts.where(F.col(order) == F.col(first)).select(*(F.col(f"{order}.{c}") for c in docs.schema[key].dataType.names))
    same = [docs[f"{key}.{c}"] == stay[c] for c in stay.columns]
    return docs.join(stay, same, "left_semi").drop(key, order)


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the model trained on the labels predicts toxic.

    Every row is judged by its own whole text: empty ones stay, repeated rows share their fate, and ids matter only to find labels.
    """
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space runs as one space) one row stays, that of the smallest doc_id.

    Rows that repeat an id and a text are copies too, so one of them stays; a row without an id stays unless its text has one with an id; empty and null
    texts are equal to each other.
    """
    rows, key, order = with_row_key(spark, docs, "exact")
    return first_of_each(rows, key, order, exact_dedup(rows, id_col=order), "keep_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word n-gram sets one stays, that of the smallest doc_id.

    Rows without words link with nothing and stay, each of them; ids as in drop_exact_copies.
    """
    rows, key, order = with_row_key(spark, docs, "near")
    return first_of_each(rows, key, order, jaccard_components(rows, words=WORDS, percent=SIMILARITY, id_col=order), "component_id")


def _decoded(place: int):
    """Bytes as text; a character of which only a part was left goes too."""

    def run(batches):
        for batch in batches:
            texts = [b.decode("utf-8", "ignore") for b in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns)], names=[f"c{i}" for i in range(batch.num_columns)])

    return run


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes bytes in strings of 200 bytes that occur more than once; a document may end up empty but stays.

    Every row comes out once, with its other columns as they were and n_chars as its text is now; rows of equal long texts, should the stage
    meet any, lose the text in all of them. A null text becomes an empty one.
    """
    others = [c for c in docs.columns if c != "text"]
    cut = remove_repeats(docs, carry=others)
    placed = cut.select(*(cut[i] for i in range(len(others))), cut[len(others) + 3])
    kinds = [docs.schema[c].dataType.simpleString() for c in others]
    plain = mapped(placed, _decoded(len(others)), ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), f"c{len(others)} string"]))
    named = plain.toDF(*others, "text").select(*(F.col(f"`{c}`") for c in docs.columns))
    if "n_chars" in docs.columns:
        named = named.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return named


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences of 4096.

    Every row gives its pieces, whatever its id; an empty text is its end token alone.
    """
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: A trained model and byte-level merges have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
