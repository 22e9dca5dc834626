"""Merkle manifests: a digest for every row, one root for the table, and a proof that ties each row to the root."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from episodica.llm.common import Scratch, mapped

#: Consecutive nodes that one parent covers.
FAN_OUT = 8


def encoded(column: Column) -> Column:
    """A value that nothing else is encoded as: - for null, else its length in UTF-8 bytes, a colon and itself."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of a row: sha256 in lowercase hex over its encoded columns."""
    return F.sha2(F.concat(*(encoded(c) for c in columns)), 256)


def joined(nodes: Column) -> Column:
    """Digests of an array of nodes as one string."""
    return F.array_join(F.transform(nodes, lambda m: m["h"]), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof: at each level the siblings' digests close around it."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf's to those below the root, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each row's place among the task's rows of its group; rows come sorted by group, the first column."""
    part, last, i = TaskContext.get().partitionId(), None, -1
    for batch in batches:
        places = []
        for g in batch.column(0).to_pylist():
            i, last = (i + 1 if g == last else 0), g
            places.append(i)
        parts = pa.array([part] * len(places), pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"])


def ranked(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """Rows with pos, their place (from 0) in their group g by the given columns (nulls first), and n, the rows of the group; and the largest n.

    Rows are sorted by ranges of (g, order), so a group of any size spreads over tasks; a row per task and group carries the counts on.
    The number a row has in the input decides between equals.
    """
    keys = ["g", *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    schema = StructType(list(dealt.schema)).add("part", IntegerType()).add("place", LongType())
    numbered = scratch.write(mapped(dealt, _number, schema), f"{name}-numbered")
    parts = numbered.groupBy("g", "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("g", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(Window.partitionBy("g")).alias("n"))
    bases = scratch.write(bases, f"{name}-bases")
    nodes = numbered.join(bases, ["g", "part"]).withColumn("pos", F.col("base") + F.col("place")).drop("part", "place", "base")
    return nodes, bases.agg(F.max("n")).first()[0] or 0


def build(nodes: DataFrame, largest: int, scratch: Scratch, name: str, fan_out: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels from the leaves up, and the top node (g, h, level) of every group.

    nodes has (g, pos, n, h, row). A level is a table of runs: (g, parent, n of the parent's level, members, h of the parent); each is written,
    and a row holds fan_out nodes at most. Groups that have come down to one node leave.
    """
    levels: list[DataFrame] = []
    tops = [nodes.where("n = 1").select("g", "h", F.lit(0).alias("level"))]
    own = ["pos", "h", "row"]
    while largest > 1:
        runs = nodes.where("n > 1").groupBy("g", F.expr(f"pos div {fan_out}").alias("parent"), F.expr(f"(n + {fan_out - 1}) div {fan_out}").alias("n"))
        runs = runs.agg(F.sort_array(F.collect_list(F.struct(*own))).alias("members")).withColumn("h", F.sha2(joined(F.col("members")), 256))
        levels.append(scratch.write(runs, f"{name}-level-{len(levels)}"))
        nodes, own = levels[-1].select("g", F.col("parent").alias("pos"), "n", "h"), ["pos", "h"]
        tops.append(nodes.where("n = 1").select("g", "h", F.lit(len(levels)).alias("level")))
        largest = -(-largest // fan_out)
    return levels, reduce(DataFrame.unionByName, tops)


def push(levels: list[DataFrame], lone: DataFrame, tops: DataFrame, carried: list[str], scratch: Scratch, name: str) -> DataFrame:
    """(g, h, row, proof, carried) for every leaf, from the top down.

    tops has (g, level, proof, carried) for the top node of every group. Each level joins its runs to their parents' proofs, and a child's proof
    is its siblings in the run before what it inherits; levels above the leaves are written. lone has the leaves of groups of one.
    """

    def at(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).drop("level")

    above = at(len(levels)).withColumn("parent", F.lit(0).cast("long"))
    for k in reversed(range(len(levels))):
        down = levels[k].drop("n", "h").join(above, ["g", "parent"]).select("g", "members", "proof", *carried, F.posexplode("members").alias("i", "node"))
        left, right = F.expr("slice(members, 1, i)"), F.expr("slice(members, i + 2, size(members))")
        proof = F.concat(F.array(F.struct(joined(left).alias("left"), joined(right).alias("right"))), "proof").alias("proof")
        if k == 0:
            rest = lone.join(at(0), "g").select("g", "h", "row", "proof", *carried)
            return down.select("g", "node.h", "node.row", proof, *carried).unionByName(rest)
        down = down.select("g", F.col("node.pos").alias("parent"), proof, *carried).unionByName(at(k).withColumn("parent", F.lit(0).cast("long")))
        above = scratch.write(down, f"{name}-proofs-{k}")
    return lone.join(at(0), "g").select("g", "h", "row", "proof", *carried)


@dataclass
class Manifest:
    """What merkle_manifest made: proofs has a row for each of the table's; root is None for an empty table."""

    proofs: DataFrame
    root: str | None
    folder: str


def merkle_manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group: str = "lang", present: dict[str, Column] | None = None, fan_out: int = FAN_OUT) -> Manifest:
    """A tree over all rows. proofs: (row: struct of the id and present leaf, group, leaf, subroot, root, proof).

    A leaf is the digest of the given columns. Within a group leaves ascend by id (nulls first, then by leaf); fan_out consecutive nodes become
    their parent until one is left, the subroot. Groups, null first and then by UTF-8 bytes, become one tree in the same way; its top is the root.
    A proof is an array of (left, right): the digests beside the node at each level, none where a run has one node only.

    present replaces columns by what is to be verified, and row.present is the leaf of the row as it is then: fold(row.present, proof) equals
    the root for rows that are the same. Null columns are values of their own; a null id comes first; rows that repeat are leaves of their own;
    a group of one row is its own subroot; texts may be of any length, since only digests are sorted and joined; other columns are left out;
    an empty table has no rows and no root. Levels stay in the manifest's folder until it is deleted.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    now = [(present or {}).get(c, F.col(c)) for c in columns]
    name = F.col(group).cast("string")
    rows = docs.select(F.coalesce(F.concat(F.lit("="), name), F.lit("-")).alias("g"), leaf_digest([F.col(c) for c in columns]).alias("h"), F.struct(F.col(id_col).alias("id"), name.alias("group"), leaf_digest(now).alias("present")).alias("row"))
    nodes, largest = ranked(rows.withColumn("id", F.col("row.id")), ["id", "h"], scratch, "rows")
    nodes = nodes.drop("id")
    levels, subroots = build(nodes, largest, scratch, "rows", fan_out)
    subroots = scratch.write(subroots, "subroots")

    upper = subroots.select(F.lit("").alias("g"), "h", F.struct("g", "level", F.col("h").alias("subroot")).alias("row"), F.col("g").alias("key"))
    upper_nodes, groups = ranked(upper, ["key"], scratch, "groups")
    upper_nodes = upper_nodes.drop("key")
    upper_levels, top = build(upper_nodes, groups, scratch, "groups", fan_out)
    root = top.first()
    no_proof = F.array().cast("array<struct<left:string,right:string>>")
    held = push(upper_levels, upper_nodes.where("n = 1"), top.select("g", "level", no_proof.alias("proof"), F.col("h").alias("root")), ["root"], scratch, "groups")
    tops = scratch.write(held.select("row.*", "proof", "root"), "tops")
    proofs = push(levels, nodes.where("n = 1"), tops, ["subroot", "root"], scratch, "rows")
    return Manifest(proofs.select("row", F.col("row.group").alias("group"), F.col("h").alias("leaf"), "subroot", "root", "proof"), root["h"] if root else None, scratch.root)


#: A document's leaf is of these, in this order.
DOCUMENT = ["doc_id", "source", "lang", "n_chars", "text"]


def verified_documents(docs: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every document's proof checked against a copy in which the texts of
    one id in three have lost their capitals A-Z. Edge cases as merkle_manifest; a row without an id is not tampered with."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    present = {"text": F.when(third, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))}
    proofs = merkle_manifest(docs, DOCUMENT, present=present, fan_out=fan_out).proofs
    answer = proofs.select(F.col("row.id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.col("row.present"), F.col("proof")).alias("folded_root"))
    return answer.withColumn("verified", F.col("folded_root") == F.col("root"))
