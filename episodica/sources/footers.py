"""What the footers of Parquet files say, read by executors; no page of data is touched."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.sources.namedfiles import place

FOOTER = "path string, rows long, column string, type string, nulls long, error string"


def leaves(kind: pa.DataType) -> int:
    """Columns of a file that a type takes."""
    return sum(leaves(kind.field(i).type) for i in range(kind.num_fields)) if pa.types.is_nested(kind) else 1


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows: list[tuple] = []
            try:
                system, at = place(path)
                with system.open_input_file(at) as f:
                    about = pq.read_metadata(f)
                i = 0
                for field in about.schema.to_arrow_schema():
                    counts = [about.row_group(g).column(i).statistics for g in range(about.num_row_groups)]
                    known = not pa.types.is_nested(field.type) and all(s is not None and s.has_null_count for s in counts)
                    rows.append((path, about.num_rows, field.name, str(field.type), sum(s.null_count for s in counts) if known else 0 if not about.num_rows else None, None))
                    i += leaves(field.type)
                rows = rows or [(path, about.num_rows, None, None, None, None)]
            except (OSError, pa.ArrowException) as problem:
                rows = [(path, None, None, None, None, f"{type(problem).__name__}: {problem}"[:200])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "rows", "column", "type", "nulls", "error"])


def footers(paths: DataFrame, path: str = "path", tasks: int | None = None) -> DataFrame:
    """(path, rows, column, type, nulls, error): a row per file and column. Null counts are those of the footers, null where these have none or the column is nested;
    a file that isn't there or isn't Parquet has one row, with the error."""
    listed = paths.select(F.col(path).alias("path"))
    listed = listed.repartition(tasks or max(1, listed.sparkSession.sparkContext.defaultParallelism), "path")
    return listed.mapInArrow(_read, FOOTER)


def missing_columns(found: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """(path, rows, logical, column, type): for each file and logical column the first of its candidates that the file has; none is a null column."""
    have = found.groupBy("path").agg(F.max("rows").alias("rows"), F.map_from_entries(F.collect_list(F.when(F.col("column").isNotNull(), F.struct("column", "type")))).alias("kinds"))
    listed = F.array(*(F.struct(F.lit(name).alias("logical"), F.array(*map(F.lit, options)).alias("options")) for name, options in wanted.items()))
    each = have.select("path", "rows", "kinds", F.explode(listed).alias("w"))
    first = F.element_at(F.concat(F.filter("w.options", lambda c: F.map_contains_key("kinds", c)), F.array(F.lit(None).cast("string"))), 1)
    return each.select("path", "rows", "w.logical", first.alias("column"), F.element_at("kinds", first).alias("type"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
