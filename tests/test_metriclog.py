"""The metric log: every row once, whenever a run ends, and whatever is run again."""

import math
import os

import pytest
from pyspark.sql import Row
from pyspark.sql.types import LongType, StringType, StructType

from episodica.sources import metriclog
from episodica.sources.metriclog import MetricLog, MetricWriter, committed_parts, log_metrics, read_metrics, stream_name, vacuum_metrics

LINES = StructType().add("line", StringType())
PAIRS = StructType().add("line", StringType()).add("n", LongType())
SCHEMA = "step long, loss double, name string"


def source(spark, folder, steps):
    spark.createDataFrame([(i, i / 2, f"é {i}") for i in steps], SCHEMA).coalesce(2).write.mode("append").json(str(folder))
    return spark.readStream.schema(SCHEMA).json(str(folder))


def steps(spark, log):
    return sorted(r["step"] for r in read_metrics(spark, str(log), SCHEMA).collect())


def test_rows_come_back_as_they_were(spark, tmp_path):
    log, inbox, checkpoint = tmp_path / "log", tmp_path / "in", str(tmp_path / "check")
    assert read_metrics(spark, str(log), SCHEMA).count() == 0 and vacuum_metrics(spark, str(log)) == 0
    log_metrics(source(spark, inbox, range(5)), str(log), checkpoint, once=True).awaitTermination()
    log_metrics(source(spark, inbox, range(5, 9)), str(log), checkpoint, once=True).awaitTermination()
    assert [tuple(r) for r in read_metrics(spark, str(log), SCHEMA).orderBy("step").collect()] == [(i, i / 2, f"é {i}") for i in range(9)]
    assert committed_parts(spark, str(log)).agg({"rows": "sum"}).first()[0] == 9
    other = log_metrics(source(spark, tmp_path / "more", range(20, 22)), str(log), str(tmp_path / "other"), once=True)
    other.awaitTermination()
    assert steps(spark, log) == [*range(9), 20, 21]  # batch 0 of another stream is not batch 0 of the first


def test_values_without_a_number(spark, tmp_path):
    rows = spark.createDataFrame([(0, float("nan"), None), (1, float("inf"), "a\nb"), (None, None, "")], SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    log_metrics(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "check"), once=True).awaitTermination()
    got = {r["step"]: (r["loss"], r["name"]) for r in read_metrics(spark, str(tmp_path / "log"), SCHEMA).collect()}
    assert math.isnan(got[0][0]) and got[0][1] is None and got[1] == (math.inf, "a\nb") and got[None] == (None, "")


def test_batch_that_is_run_again_after_its_entry_adds_nothing(spark, tmp_path):
    log, checkpoint, inbox = tmp_path / "log", tmp_path / "check", tmp_path / "in"
    log_metrics(source(spark, inbox, range(6)), str(log), str(checkpoint), once=True).awaitTermination()
    for name in ("0", ".0.crc"):  # ended after the entry, before Spark noted the batch as done
        if (checkpoint / "commits" / name).exists():
            os.remove(checkpoint / "commits" / name)
    log_metrics(source(spark, inbox, range(6, 8)), str(log), str(checkpoint), once=True).awaitTermination()
    assert steps(spark, log) == list(range(8)) and vacuum_metrics(spark, str(log)) == 0


def test_run_that_ends_between_parts_and_entry(spark, tmp_path, monkeypatch):
    class Failing(MetricWriter):
        """Ends between the parts and the entry, once, without cleaning up."""

        def commit(self, messages, batchId):
            flag = f"{self.path}.failed"
            if not os.path.exists(flag):
                open(flag, "w").close()
                raise RuntimeError("lost before the entry")
            super().commit(messages, batchId)

        def abort(self, messages, batchId):
            pass

    class FailingLog(MetricLog):
        def streamWriter(self, schema, overwrite):
            return Failing(dict(self.options), schema)

    log, checkpoint, inbox = tmp_path / "log", str(tmp_path / "check"), tmp_path / "in"
    rows = source(spark, inbox, range(6))
    monkeypatch.setattr(metriclog, "MetricLog", FailingLog)
    with pytest.raises(Exception, match="lost before the entry"):
        log_metrics(rows, str(log), checkpoint, once=True).awaitTermination()
    assert steps(spark, log) == [] and os.listdir(log / "parts")
    log_metrics(rows, str(log), checkpoint, once=True).awaitTermination()
    assert steps(spark, log) == list(range(6))
    assert vacuum_metrics(spark, str(log)) > 0 and steps(spark, log) == list(range(6))


def test_writer_alone(tmp_path):
    def writer():
        return MetricWriter({"path": str(tmp_path / "log"), "stream": "s"}, LINES)

    first, again = writer().write(iter([Row(line="{}")] * 3)), writer().write(iter([Row(line="{}")] * 3))
    assert first.rows == 3 and first.name != again.name and writer().write(iter([])).name == ""
    writer().commit([first, None], 4)
    writer().commit([again, None], 4)
    assert os.listdir(tmp_path / "log/parts") == [first.name]
    writer().abort([first], 4)  # committed
    assert os.listdir(tmp_path / "log/parts") == [first.name]
    writer().abort([first], 5)
    assert os.listdir(tmp_path / "log/parts") == []
    assert stream_name(str(tmp_path / "a")) == stream_name(str(tmp_path / "a")) != stream_name(str(tmp_path / "b"))
    with pytest.raises(ValueError):
        MetricWriter({"path": "x", "stream": "s"}, PAIRS)
