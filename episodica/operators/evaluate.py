"""Grouped errors, success rates and metric windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Named component ranges [first, end).
GROUPS = (("translation", 0, 3), ("rotation", 3, 6), ("gripper", 6, 7))


def chunk_errors(chunks: DataFrame, predicted: str, actual: str, *keep: str) -> DataFrame:
    """(keep, h, d, e): squared error of every step and component of arrays of vectors; arrays of different length are an error, null ones have no rows."""

    def pairs(p: Column, a: Column) -> Column:
        return F.when(F.size(p) != F.size(a), F.raise_error(F.lit("predicted and actual values differ in length"))).otherwise(F.arrays_zip(p.alias("p"), a.alias("a")))

    steps = chunks.select(*keep, F.col(predicted).alias("p"), F.col(actual).alias("a"))
    steps = steps.select(*keep, F.posexplode(pairs(F.col("p"), F.col("a"))).alias("h", "z")).select(*keep, "h", F.col("z.p").alias("p"), F.col("z.a").alias("a"))
    both = steps.select(*keep, "h", F.posexplode(pairs(F.col("p"), F.col("a"))).alias("d", "z"))
    return both.select(*keep, "h", "d", F.pow(F.col("z.p") - F.col("z.a"), 2).alias("e"))


def error_cube(errors: DataFrame) -> DataFrame:
    """(h, d, mse) over all, by step, by component and by both; null stands for all. Grouping sets are formed over the sums of each step and component."""
    h, d = F.col("h"), F.col("d")
    sums = errors.groupBy(h, d).agg(F.sum("e").alias("s"), F.count("e").alias("c"))
    return sums.groupingSets([[], [h], [d], [h, d]], h, d).agg((F.sum("s") / F.sum("c")).alias("mse"))


def group_errors(errors: DataFrame, groups=GROUPS, dim: int | None = None) -> DataFrame:
    """(name, h, mse) of named component ranges, cut to the real number of components."""
    name = F.lit(None).cast("string")
    for label, first, end in reversed(groups):
        name = F.when((F.col("d") >= first) & (F.col("d") < min(end, dim or end)), label).otherwise(name)
    return errors.withColumn("name", name).where("name IS NOT NULL").groupBy("name", "h").agg(F.avg("e").alias("mse"))


def best_step(errors_by_step: DataFrame, *keys: str) -> DataFrame:
    """The step of least error; the first of equals."""
    return errors_by_step.groupBy(*keys).agg(F.min_by("h", F.struct("mse", "h")).alias("best"), F.min("mse").alias("mse"))


def loss_breakdown(losses: DataFrame, loss_dims: int, real_dims: int = 7, gripper: int = 6) -> DataFrame:
    """Means of component losses (d, e): counted components, all, real, continuous, gripper, padding."""
    d, e = F.col("d"), F.col("e")
    parts = {"loss": d < loss_dims, "whole": F.lit(True), "real": d < real_dims, "continuous": d < gripper, "gripper": d == gripper, "padding": d >= real_dims}
    return losses.agg(*(F.avg(F.when(test, e)).alias(name) for name, test in parts.items()))


def success_rates(log: DataFrame, task: str = "task", success: str = "success") -> DataFrame:
    """Episodes, successes and rate per task, and the running totals in task order; a row per task, so one task may run them up."""
    per = log.groupBy(task).agg(F.count("*").alias("episodes"), F.sum(F.col(success).cast("long")).alias("successes"))
    upto = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select(
        task, "episodes", "successes", (F.col("successes") / F.greatest(F.lit(1), F.col("episodes"))).alias("rate"),
        F.sum("episodes").over(upto).alias("total_episodes"), F.sum("successes").over(upto).alias("total_successes"),
    )


def status(done: Column, error: Column) -> Column:
    """success, else error if there is an error text, else failure."""
    return F.when(done, "success").when(F.length(error) > 0, "error").otherwise("failure")


def metric_windows(log: DataFrame, interval: int, step: str = "step", value: str = "value") -> DataFrame:
    """Windows that end where step is a multiple of the interval, so step 0 is one alone and the last may be short: mean, last value, logged step."""
    window = F.ceil(F.col(step) / interval).alias("window")
    return log.groupBy(window).agg(F.avg(value).alias("mean"), F.max_by(value, step).alias("instant"), (F.max(step) + 1).alias("logged"), F.count("*").alias("rows"))


def numeric_means(log: DataFrame, *exclude: str) -> DataFrame:
    """Mean of every numeric or boolean column over the rows that have it."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    names = [n for n, t in log.dtypes if (t in kinds or t.startswith("decimal")) and n not in exclude]
    return log.agg(*(F.avg(F.col(n).cast("double")).alias(n) for n in names))


def task_summary(sample: DataFrame, task: str, prompt: str) -> DataFrame:
    """(task, prompt, n), repeats counted."""
    return sample.groupBy(task, prompt).agg(F.count("*").alias("n"))


def validation_loss(rows: DataFrame, loss: str, batch: str | None = None, steps: int | None = None) -> DataFrame:
    """(loss, rows): the mean over rows, or over those of the first `steps` batches (numbered from 0); no rows at all are an error when it is computed."""
    own = rows if steps is None else rows.where(F.col(batch) < steps)
    got = own.agg(F.sum(loss).alias("total"), F.count("*").alias("rows"))
    return got.select(F.when(F.col("rows") == 0, F.raise_error(F.lit("no validation rows")).cast("double")).otherwise(F.col("total") / F.col("rows")).alias("loss"), "rows")
