"""Structured Streaming versions of the live paths.

Each builder takes a streaming DataFrame and returns a streaming DataFrame
(or starts a query with a sink); the transformations are the batch operators
of ``obslytics.operators``, so a stream and a batch over the same rows agree.

Event time: driver timestamps are TIMESTAMP_NTZ and ``withWatermark`` needs
TIMESTAMP, so the adapter casts them under a UTC session first.  The default
watermark delay is 10 minutes; rows later than that are dropped by Spark.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from obslytics.functions import features as X
from obslytics.operators import filters as FL
from obslytics.operators import metrics as MT
from obslytics.operators import sequences as SQ
from obslytics.session import default_parallelism
from obslytics.sources import adapter as A

WATERMARK = "10 minutes"


def events_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Driver ``events`` files as a stream (schema given, never inferred).

    ``path`` is a folder of parquet files, or one file, in which case its
    folder is watched for files with that name.  Spark's own listing tells
    which, so the path may be in any store.  ``max_files`` limits the files of
    a micro-batch; without it a batch takes all new files.
    """
    known = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(known.schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = known.inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}") and not files[0].endswith(f"/{name}/{name}"):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def activities_stream(spark: SparkSession, events_path: str) -> DataFrame:
    return A.activities_from_events(events_stream(spark, events_path))


def metrics_stream(spark: SparkSession, events_path: str) -> DataFrame:
    return A.metrics_from_events(events_stream(spark, events_path))


def stream_detections(frames: DataFrame, source: str = "live", threshold: float = 0.6) -> DataFrame:
    """Frames -> box rule -> detections above 0.6 (stateless, append)."""
    d = FL.significant_detections(SQ.detections(frames), threshold)
    return d.withColumn("video_source", F.lit(source))


def stream_alerts(activities: DataFrame) -> DataFrame:
    """T2 rows: alertable detections as they arrive (stateless, append)."""
    return FL.alertable(activities).select("id", "timestamp", "activity_type", "confidence", "session_id")


def stream_alert_windows(activities: DataFrame, window: str = "1 hour", slide: str = "5 minutes",
                         delay: str = WATERMARK) -> DataFrame:
    """T2 windows: alert counts per session over a sliding hour, with a
    watermark so old windows are finalised and their state dropped."""
    a = FL.alertable(activities).withWatermark("timestamp", delay)
    return (a.groupBy(F.window("timestamp", window, slide).alias("w"), "session_id")
             .agg(F.count(F.lit(1)).alias("alerts"))
             .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                     "session_id", "alerts"))


def stream_summary(activities: DataFrame) -> DataFrame:
    """Running counts per (type, hour) for the dashboard (complete/update)."""
    return (activities.groupBy("activity_type", X.hour("timestamp").alias("hour"))
                      .agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("conf_sum")))


def stream_concerning(activities: DataFrame, window: str = "1 day", slide: str = "30 minutes",
                      threshold: int = 1, delay: str = WATERMARK) -> DataFrame:
    """T4: distinct Concerning types per sliding day; alert rows above the
    threshold.  ``countDistinct`` is not supported on streams, so the set of
    types (at most 15) is collected and sized."""
    a = X.add_category(activities).filter(F.col("behavioral_category") == "Concerning")
    a = a.withWatermark("timestamp", delay)
    g = (a.groupBy(F.window("timestamp", window, slide).alias("w"))
          .agg(F.size(F.collect_set("activity_type")).alias("concerning_types"),
               F.count(F.lit(1)).alias("events")))
    return (g.filter(F.col("concerning_types") > threshold)
             .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                     "concerning_types", "events",
                     F.format_string("Detected %d concerning behavioral patterns",
                                     F.col("concerning_types")).alias("message")))


def stream_metric_alerts(metrics: DataFrame) -> DataFrame:
    """T5: threshold alerts on every metric sample (stateless)."""
    return MT.metric_alerts(metrics)


def stream_health(metrics: DataFrame, duration: str = "1 hour", delay: str = WATERMARK) -> DataFrame:
    """Tumbling-window health per host ("1 hour" or "1 day")."""
    return MT.health_windows(metrics.withWatermark("timestamp", delay), duration)


HISTORY_SCHEMA = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("retained", T.LongType()),
    T.StructField("oldest", T.TimestampType()),
    T.StructField("newest", T.TimestampType()),
    T.StructField("cpu_avg", T.DoubleType()),
])
_HIST_ROW = "timestamp timestamp, cpu_percent double"


def _trim(parts: list[pd.DataFrame], n: int) -> pd.DataFrame:
    """Newest ``n`` samples of the given pieces (never more than n + one batch)."""
    keep = [p for p in parts if len(p)]
    if not keep:
        return pd.DataFrame({"timestamp": pd.Series(dtype="datetime64[us]"), "cpu_percent": pd.Series(dtype="float64")})
    return pd.concat(keep, ignore_index=True).sort_values("timestamp").tail(n)


def _summary_row(host: str, hist: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [host], "retained": [len(hist)], "oldest": [hist["timestamp"].min()],
                         "newest": [hist["timestamp"].max()], "cpu_avg": [float(hist["cpu_percent"].mean())]})


class _KeepNewest(StatefulProcessor):
    """List state per host holding its newest ``n`` samples."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hist = handle.getListState("history", _HIST_ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = list(self.hist.get())
        parts = [pd.DataFrame(old, columns=["timestamp", "cpu_percent"])] if old else []
        hist = None
        for batch in rows:
            hist = _trim(parts + [batch[["timestamp", "cpu_percent"]]], self.n)
            parts = [hist]
        hist = hist if hist is not None else _trim(parts, self.n)
        self.hist.clear()
        self.hist.put(list(hist.itertuples(index=False, name=None)))
        yield _summary_row(key[0], hist)

    def close(self) -> None:
        pass


def stream_history(metrics: DataFrame, n: int = 1000) -> DataFrame:
    """Bounded per-host history of the newest ``n`` samples kept in list
    state (``transformWithStateInPandas``, RocksDB store), emitting the
    history summary of every host that received samples in a batch."""
    grouped = metrics.select("host", "timestamp", "cpu_percent").groupBy("host")
    if hasattr(grouped, "transformWithStateInPandas"):
        return grouped.transformWithStateInPandas(statefulProcessor=_KeepNewest(n), outputStructType=HISTORY_SCHEMA,
                                                  outputMode="Update", timeMode="None")

    # older Spark: one value state holding the two columns as arrays
    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = []
        if state.exists:
            ts, cpu = state.get
            parts.append(pd.DataFrame({"timestamp": pd.to_datetime(list(ts)), "cpu_percent": list(cpu)}))
        for b in batches:
            parts = [_trim(parts + [b[["timestamp", "cpu_percent"]]], n)]
        hist = _trim(parts, n)
        state.update((list(hist["timestamp"]), [float(x) for x in hist["cpu_percent"]]))
        yield _summary_row(key[0], hist)

    return grouped.applyInPandasWithState(keep, HISTORY_SCHEMA, "ts array<timestamp>, cpu array<double>", "update",
                                          GroupStateTimeout.NoTimeout)


HISTORY_ROW = "host string, timestamp timestamp, cpu_percent double"


def history_sink(stream: DataFrame, path: str, checkpoint: str, n: int = 1000, buckets: int = 16, expire: str | None = None, trigger_once: bool = True):
    """T7 in built-in operators: the newest ``n`` samples of every host, kept as a table.

    A micro-batch is first trimmed to the newest ``n`` of each host and bucket (by hash; each map task forwards no more),
    so that no task sees more than ``n * (buckets + 1)`` rows of a host, then merged with the table of the batch before
    and written to its own folder with overwrite: a retried batch replaces itself.  With ``expire`` (an interval such as
    "7 days") hosts whose newest sample is older than that, by event time, leave the table."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("host", "timestamp", "cpu_percent")
        newest = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("timestamp"), F.desc("cpu_percent")))
        rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("timestamp", "cpu_percent"), F.lit(buckets)))
        rows = rows.withColumn("_k", newest("host", "_bucket")).where(F.col("_k") <= n).drop("_k", "_bucket")
        if batch_id:
            rows = rows.unionByName(spark.read.schema(HISTORY_ROW).parquet(f"{path}/batch={batch_id - 1}"))
        kept = rows.withColumn("_k", newest("host")).where(F.col("_k") <= n).drop("_k")
        if expire:
            now = rows.agg(F.max("timestamp")).first()[0]
            last = Window.partitionBy("host")
            kept = (kept.withColumn("_last", F.max("timestamp").over(last))
                        .where(F.col("_last") >= F.lit(now) - F.expr(f"interval {expire}")).drop("_last")) if now is not None else kept
        kept.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def history_summary(spark, path: str) -> DataFrame:
    """Samples kept, their time range and mean CPU per host, from the newest batch's table."""
    rows = spark.read.schema(HISTORY_ROW + ", batch long").parquet(path)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == F.lit(last)).groupBy("host").agg(
        F.count(F.lit(1)).alias("retained"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"), F.avg("cpu_percent").alias("cpu_avg"))


def alerts_sink(stream: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """Deliver alerts to a table.  Each micro-batch is written to its own
    ``batch=<id>`` folder with overwrite, so a retried batch replaces itself
    instead of duplicating rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                 key: list[str] | None = None, state_partitions: int | None = None):
    """Run a stream over all available input (availableNow) into ``path``.

    ``append`` writes parquet files.  ``complete`` overwrites the table with
    each batch's full result.  ``update`` writes each batch's changed rows to
    ``batch=<id>``; reading back keeps the newest row per ``key``.  Every
    batch write is an overwrite of its own folder, so retries are idempotent.

    Stateful queries keep one state store per shuffle partition, fixed in
    the checkpoint when the query first starts; ``state_partitions`` (default:
    the cluster's default parallelism) sets that number for this query only.
    """
    spark = stream.sparkSession
    previous = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions",
                   str(state_partitions or default_parallelism(spark)))
    try:
        q = _start(stream, path, checkpoint, mode)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", previous)
    q.awaitTermination()
    out = spark.read.parquet(path)
    if mode == "update" and key:
        from pyspark.sql import Window
        w = Window.partitionBy(*key).orderBy(F.col("batch").desc())
        out = out.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "batch")
    return out


def _start(stream: DataFrame, path: str, checkpoint: str, mode: str):
    """Start an availableNow query writing to ``path`` (see ``run_to_table``)."""
    if mode == "append":
        q = (stream.writeStream.format("parquet").option("path", path)
                   .option("checkpointLocation", checkpoint).outputMode("append")
                   .trigger(availableNow=True).start())
    elif mode == "complete":
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(path)
        q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                   .outputMode(mode).trigger(availableNow=True).start())
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                   .outputMode(mode).trigger(availableNow=True).start())
    return q

