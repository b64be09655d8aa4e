"""Faults that equal results on the test tables cannot show: time zones, missing times, long label lists, stream paths."""

import datetime as dt
import os
import subprocess
import sys

from pyspark.sql import functions as F

from conftest import SF_SMALL
from obslytics.operators import filters as FL
from obslytics.operators import jobs as J
from obslytics.operators import metrics as MT
from obslytics.operators import summary as SM

ZONE_SCRIPT = """
import datetime as dt, sys
sys.path.insert(0, {root!r})
from obslytics.session import get_spark
from obslytics.operators import filters as FL
from obslytics.sources import adapter as A
spark = get_spark("local[2]", 2, extra={{"spark.ui.showConsoleProgress": "false"}})
a = A.load_activities(spark, {sf!r}, since=dt.datetime(2024, 1, 10))
print("COUNTS", a.count(), FL.since(a, dt.datetime(2024, 1, 31), days=7).count(), FL.older_than(a, dt.datetime(2024, 1, 20)).count(),
      FL.analytics_filter(a, dt.datetime(2024, 1, 12), dt.datetime(2024, 1, 13)).count())
"""


def test_time_bounds_do_not_depend_on_the_drivers_zone(spark):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    seen = set()
    for zone in ("UTC", "America/New_York"):
        out = subprocess.run([sys.executable, "-c", ZONE_SCRIPT.format(root=root, sf=SF_SMALL)], env=os.environ | {"TZ": zone},
                             capture_output=True, text=True, timeout=300).stdout
        seen.add(next(x for x in out.splitlines() if x.startswith("COUNTS")))
    assert len(seen) == 1


def test_retention_keeps_rows_without_a_time(spark, tmp_dir):
    as_of = dt.datetime(2024, 2, 1)
    rows = [("old", dt.datetime(2023, 12, 1)), ("new", dt.datetime(2024, 1, 31)), ("none", None)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp").withColumn("date", F.to_date("timestamp"))
    gone = J.retention_stats({"t": df}, as_of, 30).first()["t_deleted"]
    kept = J.apply_retention(df, f"{tmp_dir}/kept", as_of, 30)
    assert {r["id"] for r in kept.collect()} == {"new", "none"} and gone + kept.count() == df.count()
    assert FL.older_than(df, as_of).count() + FL.newer_than(df, as_of).count() == 3


def test_first_records_keep_all_their_labels(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"r{i}", t0 + dt.timedelta(hours=i // 2), [{"activity": f"a{k}"} for k in range(12)]) for i in range(10)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp, labels array<struct<activity:string>>")
    got = SM.first_label_records(df, 8).collect()
    assert [r["id"] for r in got] == ["r8", "r9", "r6", "r7", "r4", "r5", "r2", "r3"] and {r["n_labels"] for r in got} == {12}


def test_stream_reads_files_and_folders_by_path_and_uri(spark, tmp_dir):
    from obslytics.streaming import streams as ST
    folder = f"{tmp_dir}/events.parquet"
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(3).write.parquet(folder)
    counts = set()
    for i, path in enumerate([folder, f"file://{folder}", f"{SF_SMALL}/events.parquet", f"file://{SF_SMALL}/events.parquet"]):
        q = (ST.events_stream(spark, path).writeStream.format("parquet").option("path", f"{tmp_dir}/o{i}")
             .option("checkpointLocation", f"{tmp_dir}/c{i}").trigger(availableNow=True).start())
        q.awaitTermination()
        counts.add(spark.read.parquet(f"{tmp_dir}/o{i}").count())
    assert len(counts) == 1 and counts.pop() > 0


def test_latest_sample_breaks_ties_by_host(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t, h, 1.0, 2.0, d, p) for h, d, p in [("b", 5.0, 7), ("a", 9.0, 8), ("c", 1.0, 3)]]
    df = spark.createDataFrame(rows, "timestamp timestamp, host string, cpu_percent double, memory_percent double, disk_usage_percent double, process_count long")
    row = MT.metrics_summary(df, t).first()
    assert (row["disk_current"], row["process_current"]) == (1.0, 3)
