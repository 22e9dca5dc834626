"""Immutable shards of a growing table, compacted by size tiers under a versioned manifest."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.common import shared_folder, small_batches


@dataclass(frozen=True)
class Shard:
    """One Parquet file: its path below the store, bytes, rows and the version that added it."""

    path: str
    bytes: int
    rows: int
    version: int


class ShardStore:
    """A table kept as Parquet shards in a folder.

    append() writes arrivals as small shards; compact() merges runs of similar size into files of about target_bytes. A manifest
    lists the live shards; each change is a new manifest. A writer first claims the version's number by creating a file that must not exist
    yet, which only one can, then renames the finished manifest to it; a claim without a manifest is a writer at work, or one that died: abandon() frees
    it. Readers follow one manifest, so they never see half a change, and what a merge replaces stays until vacuum(); shards that no
    manifest lists (from lost or failed writers) are never read. The driver holds the list of shards, never their rows.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, target_bytes: int = 256 << 20, fan_in: int = 4, smallest: int = 1 << 20):
        small_batches(spark)
        self.spark, self.target, self.fan_in, self.smallest = spark, target_bytes, fan_in, smallest
        self.folder = folder or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex[:12]}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))

    def version(self) -> int:
        """The newest committed version; 0 when nothing was committed."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{version:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def _commit(self, base: int, shards: list[Shard], what: str) -> int:
        new = base + 1
        temporary = self._path(f"{self.folder}/manifests/.{new}-{uuid.uuid4().hex}")
        final = self._path(f"{self.folder}/manifests/{new:012d}.json")
        if self._fs.exists(final) or not self._claim(new):
            raise RuntimeError(f"version {new} was taken by another writer; read the manifest again and retry")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps({"version": new, "change": what, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        if not self._fs.rename(temporary, final):
            raise RuntimeError(f"version {new} could not be committed")
        return new

    def _claim(self, version: int) -> bool:
        """Takes a version's number; of writers that try, one succeeds."""
        claim = self._path(f"{self.folder}/manifests/.claim-{version:012d}")
        if self._fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
            try:
                os.close(os.open(claim.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            except FileExistsError:
                return False
            return True
        try:
            self._fs.create(claim, False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def abandon(self) -> bool:
        """Frees the next version's number from a writer that is known to have died."""
        return self._fs.delete(self._path(f"{self.folder}/manifests/.claim-{self.version() + 1:012d}"), False)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the shards and manifests that only versions before the newest `keep` need, once no reader uses those; returns how many shards went."""
        newest = self.version()
        live = {s.path for v in range(max(1, newest - keep + 1), newest + 1) for s in self.shards(v)}
        old: dict[str, None] = {}
        for v in range(newest - keep, 0, -1):
            manifest = self._path(f"{self.folder}/manifests/{v:012d}.json")
            if not self._fs.exists(manifest):  # an earlier call was here
                break
            old |= dict.fromkeys(s.path for s in self.shards(v) if s.path not in live)
        for path in old:
            self._fs.delete(self._path(f"{self.folder}/{path}"), False)
        for v in range(newest - keep, 0, -1):
            manifest = self._path(f"{self.folder}/manifests/{v:012d}.json")
            if not self._fs.exists(manifest):
                break
            self._fs.delete(manifest, False)
        return len(old)

    def _write(self, rows: DataFrame, version: int) -> list[Shard]:
        """Writes rows and returns its non-empty files with exact row counts."""
        name = f"data/{version:012d}-{uuid.uuid4().hex[:12]}"
        rows.write.option("maxRecordsPerFile", 0).parquet(f"{self.folder}/{name}")
        counted = self.spark.read.parquet(f"{self.folder}/{name}").groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).collect()
        rows_of = {r["file"].rsplit("/", 1)[1]: r["n"] for r in counted}
        listed = self._fs.listStatus(self._path(f"{self.folder}/{name}"))
        sizes = {s.getPath().getName(): s.getLen() for s in listed}
        return [Shard(f"{name}/{f}", sizes[f], n, version) for f, n in sorted(rows_of.items())]

    def append(self, arrivals: DataFrame) -> int:
        """Adds rows as new shards, as many as the arrivals have partitions; without rows no version is made."""
        base = self.version()
        added = self._write(arrivals, base + 1)
        return self._commit(base, self.shards(base) + added, "append") if added else base

    def tier(self, size: int) -> int:
        """0 for files up to smallest, one more for each factor of fan_in; files of half the target and more are settled (-1)."""
        if size * 2 >= self.target:
            return -1
        t, edge = 0, self.smallest
        while size > edge:
            t, edge = t + 1, edge * self.fan_in
        return t

    def plan(self, everything: bool = False) -> list[list[Shard]]:
        """Groups of shards to merge: a tier with fan_in shards or more, cut into groups of about the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.shards():
            tiers.setdefault(self.tier(s.bytes), []).append(s)
        tiers.pop(-1, None)
        if everything:
            tiers = {0: [s for k in sorted(tiers) for s in tiers[k]]} if tiers else {}
        groups = []
        for members in tiers.values():
            if len(members) < (2 if everything else self.fan_in):
                continue
            group, held = [], 0
            for s in sorted(members, key=lambda s: (s.version, s.path)):
                if group and held + s.bytes > self.target:
                    groups.append(group)
                    group, held = [], 0
                group.append(s)
                held += s.bytes
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self, everything: bool = False) -> int:
        """One round of merges; the old shards stay for readers of earlier versions until vacuum().

        A group is read by one task and makes one file, and up to 64 groups share a job.
        """
        base = self.version()
        groups = self.plan(everything)
        if not groups:
            return base
        merged: list[Shard] = []
        for i in range(0, len(groups), 64):
            parts = [self.spark.read.parquet(*(f"{self.folder}/{s.path}" for s in group)).coalesce(1) for group in groups[i : i + 64]]
            merged += self._write(reduce(DataFrame.union, parts), base + 1)
        gone = {s.path for g in groups for s in g}
        if sum(s.rows for s in merged) != sum(s.rows for g in groups for s in g):
            raise RuntimeError("a merge has lost rows; the manifest stays as it was")
        return self._commit(base, [s for s in self.shards(base) if s.path not in gone] + merged, "compact")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version; an empty store has no schema and is an error."""
        live = self.shards(version)
        if not live:
            raise ValueError("the store has no rows")
        return self.spark.read.parquet(*(f"{self.folder}/{s.path}" for s in live))


def shard_documents(docs: DataFrame, arrivals: int = 4, id_col: str = "doc_id", text: str = "text", target_bytes: int = 64 << 20) -> tuple[ShardStore, DataFrame]:
    """Replays a table as arrivals (by a hash of the id) into a store, compacting after each, and reads it back.

    Null ids arrive last; repeated rows, null texts and columns of any name are kept as they are; an empty table gives an empty store and no rows.
    """
    store = ShardStore(docs.sparkSession, target_bytes=target_bytes, fan_in=4)
    turn = F.coalesce(F.pmod(F.xxhash64(id_col), F.lit(arrivals)), F.lit(arrivals - 1))
    for i in range(arrivals):
        store.append(docs.where(turn == i))
        store.compact()
        store.vacuum()
    store.compact(everything=True)
    store.vacuum()
    return store, store.read() if store.shards() else docs.limit(0)
