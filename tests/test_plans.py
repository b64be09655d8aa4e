"""Physical-plan checks: pushdown, pruning, broadcast, no single-partition
exchange of row data."""

import datetime as dt
import tempfile

from obslytics import schemas as S
from obslytics.functions import features as X
from obslytics.operators import charts as C
from obslytics.operators import filters as FL
from obslytics.plans import catalog
from obslytics.sources import adapter as A
from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_bound_pushed_to_scan(spark):
    df = A.load_activities(spark, SF_SMALL, since=dt.datetime(2024, 1, 24))
    p = plan(df.select("id"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in p


def test_session_filter_pushed(spark):
    stored = A.load_activities(spark, SF_SMALL).select("id", "session_id")
    path = tempfile.mkdtemp() + "/stored"
    stored.write.parquet(path)
    p = plan(FL.by_session(spark.read.parquet(path), "session_7").select("id"))
    assert "EqualTo(session_id,session_7)" in p


def test_taxonomy_lookup_is_broadcast(spark):
    df = X.add_category(A.load_activities(spark, SF_SMALL), S.taxonomy(spark))
    p = plan(df)
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_global_gap_has_no_single_partition_exchange(spark):
    """The only exchange by the (absent) key carries the table of minutes
    (an aggregate keyed by the bucket), never event rows."""
    g = C.gap_minutes(catalog.enriched(spark, SF_SMALL))
    g.count()
    lines = g._jdf.queryExecution().executedPlan().toString().splitlines()
    singles = [i for i, ln in enumerate(lines) if "Exchange SinglePartition" in ln or "Exchange hashpartitioning(_g#" in ln and ".key" in ln]
    for i in singles:
        assert any("Aggregate(keys=[_g" in ln for ln in lines[i + 1:i + 6]), lines[i + 1:i + 6]


def test_summary_is_partial_aggregate(spark):
    from obslytics.operators import summary as SM
    s = SM.summary(A.load_activities(spark, SF_SMALL), A.AS_OF)
    p = plan(s)
    assert "partial_count" in p


def test_two_level_top_n_limits_before_each_shuffle(spark):
    """The middle level of ``top_n`` is itself a window group limit: each task
    forwards at most n rows per bucket before the shuffle."""
    from pyspark.sql import functions as F
    from obslytics.operators import summary as SM
    a = A.load_activities(spark, SF_SMALL).repartition(12)
    t = SM.top_n(a, [F.col("timestamp").desc(), F.col("id").desc()], 10, fan_in=3)
    t.write.format("noop").mode("overwrite").save()
    lines = t._jdf.queryExecution().executedPlan().toString().splitlines()
    ex = [i for i, ln in enumerate(lines) if "Exchange hashpartitioning(_b" in ln]
    assert ex and all("WindowGroupLimit" in lines[i + 1] and "Partial" in lines[i + 1] for i in ex)
