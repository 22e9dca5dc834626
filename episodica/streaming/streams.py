"""Structured Streaming counterparts of the running aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream with the schema of what is there now; event time is cast from local to instant so that it can carry a watermark."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def running_moments(stream: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Count, mean, population std and range so far."""
    v = F.col(value).cast("double")
    return stream.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def tumbling_counts(stream: DataFrame, width: str = "1 hour", late: str = "1 hour", *keys: str, slide: str | None = None) -> DataFrame:
    """Rows per event-time window; rows later than the watermark are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = stream.withWatermark("ts", late).groupBy(window, *keys).agg(F.count("*").alias("rows"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "rows")


def session_counts(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows per key and session. In append mode a session comes out once the watermark has passed it; complete mode has those that are open too."""
    counted = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("rows"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "rows")


def distinct_events(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first of the events that share a key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def count_windows(stream: DataFrame, folder: str, size: int, key: str, value: str = "value", order: tuple[str, ...] = ("ts",), part: str = "hour", unfinished: bool = False) -> DataFrame:
    """(key, window, rows, mean) for every `size` rows of a key, of all that is there now; with unfinished also for the window that is still open.

    Rows of a micro-batch are numbered in the given order, whose first column is a time, on top of what earlier ones held of their key. Numbers come from places within
    a part of the time and running totals of the parts, so a key that holds most of the rows is still spread over tasks. Below
    folder every micro-batch leaves the rows so far of each key, which is all that the next one reads, and its sums for the windows it met;
    one that is run again replaces them. Null keys are a key of their own.
    """
    spark = stream.sparkSession
    names = [f"order{i}" for i in range(len(order))]
    state, sums = "key string, held long", "key string, window long, rows long, total double, batch long"

    def fold(batch: DataFrame, turn: int) -> None:
        sizes = batch.groupBy("key", "part").agg(F.count("*").alias("n"))
        earlier = spark.read.schema(state).parquet(f"{folder}/state/batch={turn - 1}").withColumnRenamed("key", "known")
        upto = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        placed = sizes.join(earlier, F.col("key").eqNullSafe(F.col("known")), "full_outer")
        placed = placed.withColumn("held", F.coalesce("held", F.lit(0))).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)) + F.col("held"))
        bases = placed.where("n IS NOT NULL").select(F.col("key").alias("own"), F.col("part").alias("own_part"), "before")
        within = F.row_number().over(Window.partitionBy("key", "part").orderBy(*names)) - 1
        rows = batch.withColumn("place", within).join(bases, F.col("key").eqNullSafe(F.col("own")) & F.col("part").eqNullSafe(F.col("own_part")))
        window = F.floor((F.col("before") + F.col("place")) / size).cast("long").alias("window")
        rows.groupBy("key", window).agg(F.count("*").alias("rows"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{folder}/sums/batch={turn}")
        now = placed.groupBy(F.coalesce("key", "known").alias("key")).agg((F.max("held") + F.coalesce(F.sum("n"), F.lit(0))).alias("held"))
        now.write.mode("overwrite").parquet(f"{folder}/state/batch={turn}")

    rows = stream.select(F.col(key).cast("string").alias("key"), F.date_trunc(part, order[0]).alias("part"), F.col(value).cast("double").alias("value"), *(F.col(c).alias(n) for c, n in zip(order, names, strict=True)))
    for name, schema in (("state", state), ("sums", sums.removesuffix(", batch long"))):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{name}/batch=-1")
    rows.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    whole = spark.read.schema(sums).parquet(f"{folder}/sums").groupBy("key", "window").agg(F.sum("rows").alias("rows"), (F.sum("total") / F.sum("rows")).alias("mean"))
    return whole if unfinished else whole.where(F.col("rows") == size)


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs all that is there now into Parquet below folder and returns it; in complete mode the last result holds."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, turn: int) -> None:
        place = f"{folder}/result" if mode == "complete" else f"{folder}/result/batch={turn}"
        batch.write.mode("overwrite").parquet(place)

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/result" if mode == "complete" else f"{folder}/result/batch=-1")
    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/result").select(*stream.columns)
