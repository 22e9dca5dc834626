"""The queries opN_<name> of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.bpe import round_trip_digests
from episodica.llm.common import Scratch
from episodica.llm.conversations import damaged, repair_pieces, repair_report
from episodica.llm.embeddings import embedding_near_dedup
from episodica.llm.exactdedup import exact_dedup
from episodica.llm.jaccard import jaccard_components
from episodica.llm.merkle import verified_documents
from episodica.llm.nearest import nearest
from episodica.llm.packing import pack_documents
from episodica.llm.sharding import shard_documents
from episodica.llm.suffix import removal_digests, remove_repeats
from episodica.llm.tokencount import count_tokens
from episodica.llm.toxicity import score_documents, train
from episodica.llm.warc import read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(remove_repeats(table(spark, sf_dir, "documents")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it comes back from the compacted store."""
    _, rows = shard_documents(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"), "lang", "source")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from the archives."""
    folder = Scratch(spark, "archive").path("warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).drop("url")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"), least=0.98)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(repair_pieces(damaged(table(spark, sf_dir, "conversations"))))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_packing": op5_packing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_sharding": op7_sharding,
    "op8_warc": op8_warc,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_nearest": op12_nearest,
    "op13_merkle": op13_merkle,
}



def _encoded(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


#: crc32 of decimal text, a bit at a time: the generator polynomial is a fixed value.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, len(s) + 1), lambda i: [ascii(s[i]), 0, 0, 0, 0, 0, 0, 0]))),
            lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"""
_HEAD = " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars"))
_MERKLE = f"""
    WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS s, coalesce('=' || lang, '-') AS g FROM documents),
    t AS (SELECT *, CASE WHEN {_CRC32} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS present FROM d),
    h AS (SELECT doc_id, g, sha256({_HEAD} || {_encoded("text")}) AS leaf, sha256({_HEAD} || {_encoded("present")}) AS start FROM t),
    leaves AS (SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM h),
    up AS (SELECT g, 0 AS lvl, pos, n, leaf AS h FROM leaves
           UNION ALL SELECT g, lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, lvl, pos // 8),
    runs AS (SELECT g, lvl, pos // 8 AS parent, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY ALL),
    tops AS (SELECT g, lvl, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
    up2 AS (SELECT 0 AS lvl, pos, n, h FROM tops
            UNION ALL SELECT lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up2 WHERE n > 1 GROUP BY lvl, pos // 8),
    runs2 AS (SELECT lvl, pos // 8 AS parent, list(h ORDER BY pos) AS hs FROM up2 WHERE n > 1 GROUP BY ALL),
    path AS (SELECT k, g, 0 AS lvl, pos, '' AS sib, start AS fold FROM leaves
             UNION ALL SELECT k, p.g, p.lvl + 1, p.pos // 8, sib || array_to_string(hs[1:p.pos % 8] || hs[p.pos % 8 + 2:], ''),
                              sha256(array_to_string(hs[1:p.pos % 8] || [fold] || hs[p.pos % 8 + 2:], ''))
                       FROM path p JOIN runs r ON r.g = p.g AND r.lvl = p.lvl AND r.parent = p.pos // 8),
    path2 AS (SELECT k, 0 AS lvl, t.pos, sib, fold FROM path p JOIN tops t ON t.g = p.g AND t.lvl = p.lvl
              UNION ALL SELECT k, p.lvl + 1, p.pos // 8, sib || array_to_string(hs[1:p.pos % 8] || hs[p.pos % 8 + 2:], ''),
                               sha256(array_to_string(hs[1:p.pos % 8] || [fold] || hs[p.pos % 8 + 2:], ''))
                        FROM path2 p JOIN runs2 r ON r.lvl = p.lvl AND r.parent = p.pos // 8),
    root AS (SELECT lvl, h FROM up2 WHERE n = 1)
    SELECT l.doc_id, l.leaf, t.h AS subroot, root.h AS root, sha256(p.sib) AS proof_sha256, p.fold AS folded_root, p.fold = root.h AS verified
    FROM leaves l JOIN tops t ON t.g = l.g JOIN root ON true JOIN path2 p ON p.k = l.k AND p.lvl = root.lvl"""

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op7_sharding": """
        SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, lang, source
        FROM documents""",
    "op13_merkle": _MERKLE,
}
