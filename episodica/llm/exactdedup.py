"""Exact deduplication against a persistent index of text digests, in DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.common import Scratch

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text"):
    """White space runs as one blank; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE_SPACE, " ")


class DigestIndex:
    """Table (digest binary, keep_id, of the ids' type) bucketed and sorted by digest; batches are merged into it and appended.

    The number of buckets is that of the shuffle partitions when the table is made, so the exchange of a batch's
    distinct digests lines up with the buckets and the merge anti-join reads the table without shuffling it.
    """

    def __init__(self, spark: SparkSession, table: str, location: str | None = None, kind: str = "bigint"):
        self.spark, self.table = spark, table
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        place = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id {kind}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS{place}")

    def append_new(self, batch: DataFrame) -> None:
        """Adds the rows of batch (digest unique, keep_id) whose digest the index does not hold yet."""
        known = self.spark.table(self.table).select("digest")
        batch.hint("merge").join(known, "digest", "left_anti").select("digest", "keep_id").write.insertInto(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row, dropped rows too.

    Texts are equal when identical after each run of white space is replaced by one space. Of equal texts in the
    batch the smallest id stays, unless the index already holds the text from an earlier batch: then keep_id is that batch's id and no row
    of this one is kept. group_size counts the batch's rows. Null text counts as empty; rows that repeat an id with
    equal text share one verdict; null ids never win against others; ids may be of any type that can be sorted; other columns are dropped; an empty table gives no rows. Without an index a new one is
    made for this call and dropped before it returns. Hot texts are pre-aggregated before the shuffle, and the join that hands verdicts back has plain
    exchanges on both sides, so adaptive execution splits skewed partitions.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    own = None if index else DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}", kind=docs.schema[id_col].dataType.simpleString())
    index = index or own
    digests = scratch.write(docs.select(id_col, F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest")), "digests")
    fresh = scratch.write(digests.groupBy("digest").agg(F.min(id_col).alias("keep_id"), F.count("*").alias("group_size")), "fresh")
    index.append_new(fresh)
    verdicts = fresh.select("digest", "group_size").hint("merge").join(index.rows(), "digest")
    verdicts = scratch.write(verdicts.select("digest", "keep_id", "group_size"), "verdicts")
    scratch.drop("fresh")
    if own:
        own.drop()
    return digests.join(verdicts, "digest").select(
        id_col,
        "keep_id",
        "group_size",
        F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
