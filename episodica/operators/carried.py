"""Statistics that are carried on: mergeable states of moments and histograms, kept as tables and added to by new files only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BINS = 4096


def exponent(lo: Column, hi: Column, bins: int) -> Column:
    """The least e for which [lo, hi] touches at most `bins` of the intervals [k 2^e, (k + 1) 2^e); not so small that k would need more than 53 bits.

    It depends on the range alone, and intervals of a larger e are unions of those of a smaller one. That makes merging exact and its order idle.
    """
    first = F.floor(F.log2((hi - lo) / bins)).cast("int")

    def fits(e: Column) -> Column:
        return F.floor(hi / F.pow(F.lit(2.0), e)) - F.floor(lo / F.pow(F.lit(2.0), e)) < bins

    fitting = F.when(fits(first), first).when(fits(first + 1), first + 1).otherwise(first + 2)
    largest = F.greatest(F.abs(lo), F.abs(hi))
    finest = F.when(largest > 0, F.floor(F.log2(largest)).cast("int") - 52).otherwise(F.lit(-1000))
    return F.when(hi > lo, F.greatest(fitting, finest)).otherwise(finest)


def _with_exponent(ranges: DataFrame, bins: int) -> DataFrame:
    return ranges.withColumn("e", exponent(F.col("lo"), F.col("hi"), bins))


def _packed(keys: tuple[str, ...], counted: DataFrame, ranges: DataFrame) -> DataFrame:
    """A row per key: its sums and its bins, which are `bins` at most."""
    lists = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "c"))).alias("bins"))
    return ranges.join(lists, list(keys)) if keys else ranges.where("n > 0").crossJoin(F.broadcast(lists))


def state(values: DataFrame, *keys: str, value: str = "x", bins: int = BINS) -> DataFrame:
    """(keys, n, s, q, lo, hi, e, bins): count, sums of x and x * x, range, and counts of bins of width 2^e. Nulls, NaN and infinities are left out; keys must not be null."""
    x = F.col(value).cast("double")
    own = values.select(*keys, x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    ranges = own.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ranges = _with_exponent(ranges, bins)
    wide = own.join(ranges.select(*keys, "e"), list(keys)) if keys else own.crossJoin(F.broadcast(ranges.select("e")))
    counted = wide.groupBy(*keys, F.floor(F.col("x") / F.pow(F.lit(2.0), F.col("e"))).alias("bin")).agg(F.count("*").alias("c"))
    return _packed(keys, counted, ranges)


def merged(states: DataFrame, *keys: str, bins: int = BINS) -> DataFrame:
    """One state per key from any number of them. Counts, range, width and bins equal those of one pass over all values, whatever the order; sums but for rounding."""
    ranges = states.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ranges = _with_exponent(ranges, bins)
    parts = states.select(*keys, F.col("e").alias("own"), F.explode("bins").alias("b"))
    wide = parts.join(ranges.select(*keys, "e"), list(keys)) if keys else parts.crossJoin(F.broadcast(ranges.select("e")))
    place = F.floor(F.col("b.bin") / F.pow(F.lit(2.0), F.col("e") - F.col("own"))).alias("bin")
    return _packed(keys, wide.groupBy(*keys, place).agg(F.sum("b.c").alias("c")), ranges)


def statistics(states: DataFrame, *keys: str, probabilities: tuple[float, ...] = (0.01, 0.99)) -> DataFrame:
    """(keys, p, rows, mean, std, lo, hi, quantile) of merged states. A quantile is the left edge of the first bin at which the count reaches p of all,
    not below the least value: at most 2^e, so twice the range over `bins`, below the exact one."""
    mean = F.col("s") / F.col("n")
    own = states.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))).withColumn("p", F.explode(F.array(*map(F.lit, probabilities))))
    none = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("bin"))

    def step(a: Column, b: Column) -> Column:
        upto = a["upto"] + b["c"]
        return F.struct(upto.alias("upto"), F.coalesce(a["bin"], F.when(upto >= F.col("p") * F.col("n"), b["bin"])).alias("bin"))

    found = F.aggregate("bins", none, step, lambda a: a["bin"])
    return own.select(*keys, "p", F.col("n").alias("rows"), "mean", "std", "lo", "hi", F.greatest("lo", found * F.pow(F.lit(2.0), F.col("e"))).alias("quantile"))


class CarriedProfile:
    """States of a growing set of Parquet files: a folder per addition, with the files it read. What has been read once isn't read again."""

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...], value: str = "x", bins: int = BINS):
        self.spark, self.folder, self.keys, self.value, self.bins = spark, folder.rstrip("/"), keys, value, bins

    def _additions(self, name: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/add-*/{name}")
        found = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at)
        return sorted(f.getPath().toString() for f in found or [])

    def states(self) -> DataFrame | None:
        """All states, several per key; None before the first addition."""
        paths = self._additions("states")
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, rows: DataFrame) -> int:
        """Adds what rows (read from Parquet files) has in files that weren't added before; returns how many these are. An addition is there as a whole or not at all."""
        held = rows.withColumn("__path", F.col("_metadata.file_path"))
        files, known = held.select(F.col("__path").alias("path")).distinct(), self._additions("files")
        new = files.join(self.spark.read.parquet(*known), "path", "left_anti") if known else files
        paths = [r["path"] for r in new.collect()]  # a path per new file, as a scan's own listing
        if not paths:
            return 0
        from episodica.sources.sinks import rename_new

        temporary = f"tmp-{uuid.uuid4().hex}"
        own = held.where(F.col("_metadata.file_path").isin(paths)) if len(paths) <= 1000 else held.join(self.spark.createDataFrame([(p,) for p in paths], "__path string"), "__path", "left_semi")
        state(own, *self.keys, value=self.value, bins=self.bins).write.parquet(f"{self.folder}/{temporary}/states")
        self.spark.createDataFrame([(p,) for p in paths], "path string").write.parquet(f"{self.folder}/{temporary}/files")
        rename_new(self.spark, f"{self.folder}/{temporary}", f"{self.folder}/add-{uuid.uuid4().hex}")
        return len(paths)

    def compact(self) -> DataFrame:
        """The merged state."""
        states = self.states()
        if states is None:
            raise FileNotFoundError(f"{self.folder} has no additions")
        return merged(states, *self.keys, bins=self.bins)
