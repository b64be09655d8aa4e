"""System-metric analyses: threshold alerts, summaries, bounded history
(F9, P21, A24, W7, W8)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslytics import schemas as S
from obslytics.functions import features as X
from obslytics.operators import filters as FL


def alert_array() -> F.Column:
    """One struct per rule that fires (NULL otherwise), strict ``>``."""
    items = []
    for kind, severity, metric, threshold, fmt in S.METRIC_ALERT_RULES:
        v = F.col(metric)
        text = F.format_string(fmt.replace("%.1f", "%s"), X.fixed(v, 1))
        items.append(F.when(v > threshold, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
                                                    text.alias("message"), v.alias("value"))))
    return F.array_compact(F.array(*items))


def metric_alerts(metrics: DataFrame) -> DataFrame:
    """One row per (sample, rule that fires).  Row-local: no shuffle."""
    return (metrics.select("timestamp", "host", F.explode(alert_array()).alias("a"))
                   .select("timestamp", "host", "a.type", "a.severity", "a.message", "a.value"))


def details_text(m) -> F.Column:
    """One ``key: value`` line per map entry (the alert details list)."""
    m = F.col(m) if isinstance(m, str) else m
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def alert_details(alerts: DataFrame) -> DataFrame:
    """Alerts with their details text (type, severity, message, value)."""
    m = F.create_map(F.lit("type"), F.col("type"), F.lit("severity"), F.col("severity"),
                     F.lit("message"), F.col("message"), F.lit("value"), F.col("value").cast("string"))
    return alerts.withColumn("details", details_text(m))


def metrics_summary(metrics: DataFrame, as_of: _dt.datetime, hours: int = 24, by_host: bool = False) -> DataFrame:
    """avg/max/min CPU and memory, latest disk and process count,
    average process count, over the last ``hours``.  ``max_by`` gives the
    latest value without a sort; of samples at the same time that of the
    last host, then the highest value."""
    m = FL.since(metrics, as_of, hours=hours)
    keys = ["host"] if by_host else []
    return m.groupBy(*keys).agg(
        F.lit(hours).alias("period_hours"),
        F.count(F.lit(1)).alias("sample_count"),
        F.avg("cpu_percent").alias("cpu_avg"), F.max("cpu_percent").alias("cpu_max"),
        F.min("cpu_percent").alias("cpu_min"),
        F.avg("memory_percent").alias("memory_avg"), F.max("memory_percent").alias("memory_max"),
        F.min("memory_percent").alias("memory_min"),
        F.max_by("disk_usage_percent", F.struct("timestamp", "host", "disk_usage_percent")).alias("disk_current"),
        F.avg("process_count").alias("process_avg"),
        F.max_by("process_count", F.struct("timestamp", "host", "process_count")).alias("process_current"),
    )


def keep_latest(metrics: DataFrame, n: int = 1000, key: str = "host", fan_in: int = 64) -> DataFrame:
    """The newest ``n`` samples per host: a window group limit with a
    middle level, so a host present in every task never makes one task merge n
    rows from all of them (see ``summary.top_n_per_group``)."""
    from obslytics.operators.summary import top_n_per_group
    return top_n_per_group(metrics, key, [F.col("timestamp").desc()], n, fan_in)


def health_windows(metrics: DataFrame, duration: str = "1 hour") -> DataFrame:
    """T6 batch form: tumbling-window health per host (also used by the stream)."""
    return (metrics.groupBy(F.window("timestamp", duration).alias("w"), "host")
                   .agg(F.count(F.lit(1)).alias("samples"), F.avg("cpu_percent").alias("cpu_avg"),
                        F.max("cpu_percent").alias("cpu_max"), F.avg("memory_percent").alias("memory_avg"),
                        F.count_if(F.col("cpu_percent") > 80).alias("cpu_alerts"))
                   .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "host",
                           "samples", "cpu_avg", "cpu_max", "memory_avg", "cpu_alerts"))
