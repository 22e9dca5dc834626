"""Tables of Parquet files with versions: a change writes the files it touches anew, and a manifest says which files count."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions.text import natural_key
from episodica.operators.episodes import episode_ranges, locate_frames
from episodica.sources.namedfiles import FILE, register
from episodica.sources.sinks import rename_new

MANIFESTS, CHANGES = "_versions", "_changes"


class FileTable:
    """A folder of Parquet files under a manifest: a row (path below the root, rows) for each file of a version.

    Files are never changed. A version is a folder of the manifests, and it is there once that folder has its name: until then readers see the one
    before, and what a writer that died left behind counts for nothing and goes with vacuum. Two writers of one version can't both succeed.
    File names must be plain (nothing that a URI would encode). The driver holds a path per file, as for any table that Spark lists.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # file system

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _children(self, name: str) -> list[str]:
        at = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs().listStatus(at)) if self._fs().exists(at) else []

    def _rename_new(self, source: str, target: str) -> None:
        rename_new(self.spark, f"{self.root}/{source}", f"{self.root}/{target}")

    def _relative(self, column: Column) -> Column:
        """What a full path has below the root."""
        base = f"{self._path().toUri().getPath()}/"
        return F.substring(column, F.instr(column, base) + F.lit(len(base)), F.length(column))

    # versions

    def versions(self) -> list[int]:
        return [int(n[1:]) for n in self._children(MANIFESTS) if n.startswith("v")]

    def latest(self) -> int:
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"{self.root} has no manifest; adopt it first")
        return known[-1]

    def files(self, version: int | None = None) -> DataFrame:
        """(path, rows) of a version."""
        number = self.latest() if version is None else version
        return self.spark.read.schema("path string, rows long").parquet(f"{self.root}/{MANIFESTS}/v{number:09d}")

    def _commit(self, files: DataFrame, number: int) -> int:
        temporary = f"{MANIFESTS}/tmp-{uuid.uuid4().hex}"
        files.select("path", F.col("rows").cast("long")).write.parquet(f"{self.root}/{temporary}")
        self._rename_new(temporary, f"{MANIFESTS}/v{number:09d}")
        return number

    def adopt(self, folder: str = "data") -> int:
        """Makes the Parquet files below a folder the first version, as they are; only their row counts are read."""
        if self.versions():
            raise FileExistsError(f"{self.root} has a manifest already")
        found = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_path").alias("at")).agg(F.count("*").alias("rows"))
        return self._commit(found.select(self._relative(F.col("at")).alias("path"), "rows"), 1)

    def read(self, version: int | None = None, paths: list[str] | None = None, places: bool = False) -> DataFrame:
        """The rows of a version, or of some of its files; with places also __file (path below the root) and __row (place in the file)."""
        chosen = [r["path"] for r in self.files(version).select("path").collect()] if paths is None else paths
        rows = self.spark.read.parquet(*(f"{self.root}/{p}" for p in chosen))
        return rows.select("*", self._relative(F.col("_metadata.file_path")).alias(FILE), F.col("_metadata.row_index").alias("__row")) if places else rows

    # changes

    def update(self, changed: DataFrame) -> int:
        """A version in which some rows have other values: changed has __file, __row and any columns of the table. Returns its number.

        Files with such rows are read and written anew, in the order they have; all others stay the files they are. Rows that are changed twice, or aren't
        there, are an error; no changed rows leave the version as it is.
        """
        number = self.latest()
        manifest = self.files(number)
        values = [c for c in changed.columns if c not in (FILE, "__row")]
        touched = changed.groupBy(FILE).agg(F.count("*").alias("n"), F.count_distinct("__row").alias("distinct"), F.min("__row").alias("least"), F.max("__row").alias("most"))
        found = touched.join(manifest, F.col(FILE) == F.col("path"), "left").collect()  # a row per file that changes
        wrong = [r[FILE] for r in found if r["path"] is None or r["n"] != r["distinct"] or r["least"] < 0 or r["most"] >= r["rows"]]
        if wrong:
            raise ValueError(f"rows changed twice or not there, in {sorted(map(str, wrong))[:5]}")
        if not found:
            return number
        names = [r[FILE] for r in found]
        old = self.read(paths=names, places=True)
        unknown = [c for c in values if c not in old.columns]
        if unknown:
            raise ValueError(f"no columns {unknown}")
        new = changed.select(FILE, "__row", F.struct(*values).alias("__new")).withColumn("__is", F.lit(True))
        rows = old.join(new, [FILE, "__row"], "left")
        columns = [F.when(F.col("__is"), F.col("__new")[c]).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c in values else F.col(c) for c in old.columns if c not in (FILE, "__row")]
        folder = f"{CHANGES}/{uuid.uuid4().hex}"
        plain = F.regexp_replace(FILE, f"^{CHANGES}/[0-9a-f]+/", "")
        register(self.spark)
        out = rows.select(plain.alias(FILE), *columns, "__row").repartition(FILE).sortWithinPartitions(FILE, "__row").drop("__row")
        out.write.format("named_parquet").mode("append").option("path", f"{self.root}/{folder}").save()
        gone = self.spark.createDataFrame([(n,) for n in names], "path string").withColumn("__is", F.lit(True))
        path = F.when(F.col("__is"), F.concat(F.lit(f"{folder}/"), F.regexp_replace("path", f"^{CHANGES}/[0-9a-f]+/", ""))).otherwise(F.col("path"))
        return self._commit(manifest.join(gone, "path", "left").select(path.alias("path"), "rows"), number + 1)

    def restore(self, version: int) -> int:
        """A new version that is as an earlier one was."""
        return self._commit(self.files(version), self.latest() + 1)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Forgets all versions but the last ones and deletes changed files that none of these has, and what dead writers left; files that were adopted stay."""
        known = self.versions()
        for number in known[: max(0, len(known) - max(1, keep))]:
            self._fs().delete(self._path(f"{MANIFESTS}/v{number:09d}"), True)
        for name in self._children(MANIFESTS):
            if not name.startswith("v"):
                self._fs().delete(self._path(f"{MANIFESTS}/{name}"), True)
        used = set()
        for number in self.versions():
            used |= {r[0] for r in self.files(number).select(F.regexp_extract("path", f"^{CHANGES}/([^/]+)/", 1)).distinct().collect()}
        gone = [n for n in self._children(CHANGES) if n not in used]
        for name in gone:
            self._fs().delete(self._path(f"{CHANGES}/{name}"), True)
        return gone

    # frames by number

    def catalogue(self, version: int | None = None) -> DataFrame:
        """(path, start, end): where each file's rows lie in the numbering of all rows, files in natural order of their names; reads the manifest alone."""
        files = self.files(version).withColumn("key", natural_key(F.regexp_replace("path", f"^{CHANGES}/[0-9a-f]+/", "")))
        ranges = episode_ranges(files.withColumnRenamed("rows", "n"), "key", part=F.substring_index(F.regexp_replace("path", f"^{CHANGES}/[0-9a-f]+/", ""), "/", 2))
        return ranges.select("path", "start", "end")

    def rows_at(self, numbers: DataFrame, column: str = "i", version: int | None = None) -> DataFrame:
        """The rows with the given numbers beside them, opening only files that hold one; a number listed twice has two rows, one beyond the table is an error.

        The driver sees the paths of those files, and how many numbers were found.
        """
        ranges = self.catalogue(version)
        found = locate_frames(numbers.select(F.col(column).cast("long").alias("__i")), ranges, "__i").select("__i", F.col("path").alias(FILE), (F.col("__i") - F.col("start")).alias("__row"))
        per_file = found.groupBy(FILE).agg(F.count("*").alias("n")).collect()
        if sum(r["n"] for r in per_file) < numbers.count():
            raise IndexError(f"{self.root} has not so many rows")
        if not per_file:
            return self.read(version).limit(0).withColumn(column, F.lit(None).cast("long"))
        return self.read(paths=[r[FILE] for r in per_file], places=True).join(found, [FILE, "__row"]).drop(FILE, "__row").withColumnRenamed("__i", column)
