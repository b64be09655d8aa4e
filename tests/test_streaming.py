"""Streams over availableNow equal their batch operators; late rows beyond
the watermark are dropped."""

import datetime as dt
import os

from pyspark.sql import functions as F

from obslytics.operators import metrics as MT
from obslytics.sources import adapter as A
from obslytics.streaming import streams as ST
from conftest import SF_SMALL


def _run(stream, tmp, mode="append", key=None):
    return ST.run_to_table(stream, f"{tmp}/out", f"{tmp}/chk", mode, key)


def test_metric_alerts_stream_equals_batch(spark, tmp_dir):
    s = _run(ST.stream_metric_alerts(ST.metrics_stream(spark, f"{SF_SMALL}/events.parquet")), tmp_dir)
    b = MT.metric_alerts(A.load_metrics(spark, SF_SMALL))
    cols = ["host", "type", "severity", "message", "value"]
    assert sorted(s.select(*cols).collect()) == sorted(b.select(*cols).collect())


def test_summary_stream_equals_batch(spark, tmp_dir):
    s = _run(ST.stream_summary(ST.activities_stream(spark, f"{SF_SMALL}/events.parquet")), tmp_dir, "complete")
    a = A.load_activities(spark, SF_SMALL)
    b = a.groupBy("activity_type", F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(s.select("activity_type", "hour", "n").collect()) == sorted(b.collect())


def _write_batch(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "id string, timestamp timestamp, activity_type string, confidence double, "
                                     "session_id string")
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def test_watermark_drops_late_rows(spark, tmp_dir):
    src = f"{tmp_dir}/src"
    os.makedirs(src)
    t = dt.datetime(2024, 1, 1, 10, 0)
    _write_batch(spark, src, "b1", [("1", t, "wandering", 0.9, "s"), ("2", t + dt.timedelta(hours=3), "wandering", 0.9, "s")])
    schema = spark.read.parquet(f"{src}/b1").schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    windows = ST.stream_alert_windows(stream, "1 hour", "1 hour", "10 minutes")
    out, chk = f"{tmp_dir}/out", f"{tmp_dir}/chk"
    q = windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk) \
        .outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    # second file: one row far behind the watermark (dropped), one that closes the 13:00 window
    _write_batch(spark, src, "b2", [("3", t + dt.timedelta(minutes=5), "wandering", 0.9, "s"),
                                    ("4", t + dt.timedelta(hours=6), "wandering", 0.9, "s")])
    q = windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk) \
        .outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["window_start"].hour: r["alerts"] for r in spark.read.parquet(out).collect()}
    assert got.get(10) == 1  # the late row at 10:05 did not count
    assert got.get(13) == 1


def test_history_bounded(spark, tmp_dir):
    s = _run(ST.stream_history(ST.metrics_stream(spark, f"{SF_SMALL}/events.parquet"), 50), tmp_dir, "update",
             ["host"])
    rows = s.collect()
    assert len(rows) == 5 and all(r["retained"] == 50 for r in rows)


def test_history_across_batches(spark, tmp_dir):
    """Two input files -> two micro-batches; the state carries over and the
    newest row per host wins."""
    src = f"{tmp_dir}/src"
    os.makedirs(src)
    t = dt.datetime(2024, 1, 1)
    mk = lambda rows: spark.createDataFrame(rows, "timestamp timestamp, host string, cpu_percent double")
    mk([(t + dt.timedelta(minutes=i), "a", float(i)) for i in range(5)] + [(t, "b", 1.0)]) \
        .coalesce(1).write.parquet(f"{src}/f1")
    mk([(t + dt.timedelta(minutes=10 + i), "a", float(10 + i)) for i in range(3)]).coalesce(1).write.parquet(f"{src}/f2")
    schema = spark.read.parquet(f"{src}/f1").schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    got = {r["host"]: r for r in _run(ST.stream_history(stream, 4), tmp_dir, "update", ["host"]).collect()}
    assert got["a"]["retained"] == 4 and got["a"]["cpu_avg"] == (4 + 10 + 11 + 12) / 4
    assert got["b"]["retained"] == 1


def test_alerts_sink_idempotent(spark, tmp_dir):
    stream = ST.stream_metric_alerts(ST.metrics_stream(spark, f"{SF_SMALL}/events.parquet"))
    q = ST.alerts_sink(stream, f"{tmp_dir}/alerts", f"{tmp_dir}/chk")
    q.awaitTermination()
    n = spark.read.parquet(f"{tmp_dir}/alerts").count()
    assert n == MT.metric_alerts(A.load_metrics(spark, SF_SMALL)).count()


def _two_batches(spark, tmp_dir, schema_ddl, first, second, build):
    """Run ``build(stream)`` in append mode over two files written one after
    the other; returns the rows written to the sink."""
    src = f"{tmp_dir}/src"
    os.makedirs(src)
    spark.createDataFrame(first, schema_ddl).coalesce(1).write.parquet(f"{src}/b1")
    schema = spark.read.parquet(f"{src}/b1").schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    q_df = build(stream)
    out, chk = f"{tmp_dir}/out", f"{tmp_dir}/chk"

    def run():
        q = q_df.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk) \
            .outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    run()
    spark.createDataFrame(second, schema_ddl).coalesce(1).write.parquet(f"{src}/b2")
    run()
    return spark.read.parquet(out).collect()


def test_health_watermark_drops_late_sample(spark, tmp_dir):
    t = dt.datetime(2024, 1, 1, 10, 0)
    ddl = "timestamp timestamp, host string, cpu_percent double, memory_percent double"
    first = [(t, "h", 50.0, 10.0), (t + dt.timedelta(hours=3), "h", 50.0, 10.0)]
    second = [(t + dt.timedelta(minutes=30), "h", 99.0, 10.0),   # late: its window is already final
              (t + dt.timedelta(hours=6), "h", 50.0, 10.0)]       # advances the watermark
    rows = _two_batches(spark, tmp_dir, ddl, first, second, lambda s: ST.stream_health(s, "1 hour"))
    got = {r["window_start"].hour: r for r in rows}
    assert got[10]["samples"] == 1 and got[10]["cpu_max"] == 50.0 and got[13]["samples"] == 1


def test_concerning_watermark_drops_late_rows(spark, tmp_dir):
    t = dt.datetime(2024, 1, 1, 0, 0)
    ddl = "id string, timestamp timestamp, activity_type string, confidence double, session_id string"
    first = [("1", t, "wandering", 0.9, "s"), ("2", t + dt.timedelta(minutes=1), "self_harm", 0.9, "s"),
             ("3", t + dt.timedelta(days=2), "wandering", 0.9, "s")]
    # late row for the first day; and a row that moves the watermark far ahead
    second = [("4", t + dt.timedelta(minutes=2), "head_banging", 0.9, "s"),
              ("5", t + dt.timedelta(days=5), "wandering", 0.9, "s")]
    rows = _two_batches(spark, tmp_dir, ddl, first, second,
                        lambda s: ST.stream_concerning(s, "1 day", "1 day", 1))
    day0 = [r for r in rows if r["window_start"] == t]
    assert len(day0) == 1 and day0[0]["concerning_types"] == 2  # head_banging arrived too late
