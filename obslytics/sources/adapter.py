"""Adapter from the driver's generated tables to this package's schemas.

The rules are the ones in FIXTURES.md section 4.  The same rules are written in
SQL in ``obslytics.plans.oracle`` so both engines start from equal inputs.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obslytics import schemas as S
from obslytics.functions import features as X
from obslytics.operators.ordered import ordered_index

# Fixed evaluation instant used by every oracle query (UTC).
AS_OF = _dt.datetime(2024, 1, 31, 0, 0, 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def activities_from_events(events: DataFrame, since: _dt.datetime | None = None,
                           keep_k: bool = False) -> DataFrame:
    """events(event_id, ts, user_id, event_type, value, props) -> activities.

    A ``since`` bound is applied to the raw ``ts`` column so that it reaches
    the parquet scan as a pushed filter.  ``keep_k`` also returns the parsed
    ``props.k`` (a sequence feature) without a second pass over the events.
    """
    if since is not None:
        events = events.filter(F.col("ts") >= F.lit(since.isoformat(" ")).cast("timestamp_ntz"))
    # block of three classes per event type (NULL for an unknown type)
    block = F.try_element_at(F.create_map(*[F.lit(x) for i, t in enumerate(S.EVENT_TYPE_ORDER)
                                            for x in (t, i * 3 + 1)]), F.col("event_type"))
    names = F.array(*[F.lit(t) for t in S.ACTIVITY_TYPES])
    activity = F.try_element_at(names, (block + F.pmod(_k(), F.lit(3))).cast("int"))
    eid = F.col("event_id")
    box = F.create_map(
        F.lit("x"), (eid % 640).cast("double"),
        F.lit("y"), (eid % 480).cast("double"),
        F.lit("width"), (F.lit(20) + eid % 120).cast("double"),
        F.lit("height"), (F.lit(20) + eid % 90).cast("double"))
    conf = F.least(F.col("value"), F.lit(100.0)) / F.lit(100.0)
    return events.select(
        eid.cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        activity.alias("activity_type"),
        conf.alias("confidence"),
        box.alias("bounding_box"),
        X.description(activity, conf).alias("description"),
        F.lit(None).cast("string").alias("ai_analysis"),
        F.when(eid % 2 == 0, "live").otherwise("uploaded").alias("video_source"),
        F.concat(F.lit("session_"), F.col("user_id").cast("string")).alias("session_id"),
        *([_k().alias("k")] if keep_k else []),
    )


def load_activities(spark: SparkSession, sf_dir: str, since: _dt.datetime | None = None) -> DataFrame:
    return activities_from_events(table(spark, sf_dir, "events"), since)


def labeling_from_labels(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) -> labeling_data."""
    item = lambda name: F.struct(F.lit(name).alias("activity"), F.lit(1.0).alias("confidence"))
    arr = F.array_compact(F.array(F.when(F.col("quality") == 1, item("quality")),
                                  F.when(F.col("toxic") == 1, item("toxic"))))
    doc = F.col("doc_id")
    return labels.select(
        doc.cast("string").alias("id"),
        (F.lit(_dt.datetime(2024, 1, 1)).cast("timestamp") + F.make_dt_interval(mins=doc)).alias("timestamp"),
        F.lit(None).cast("string").alias("video_frame"),
        arr.alias("labels"),
        (doc % 3).cast("string").alias("annotator_id"),
        F.concat(F.lit("session_"), (doc % 150).cast("string")).alias("session_id"),
    )


def load_labeling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling_from_labels(table(spark, sf_dir, "labels"))


def metrics_from_events(events: DataFrame) -> DataFrame:
    """events -> system_metrics samples (one per event, host = user_id % 5)."""
    k = _k()
    eid = F.col("event_id")
    return events.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("host_"), (F.col("user_id") % 5).cast("string")).alias("host"),
        F.least(F.col("value"), F.lit(100.0)).alias("cpu_percent"),
        k.cast("double").alias("memory_percent"),
        ((k * 7) % 100).cast("double").alias("disk_usage_percent"),
        F.create_map(F.lit("bytes_sent"), eid * 1000, F.lit("bytes_recv"), eid * 2000,
                     F.lit("packets_sent"), eid, F.lit("packets_recv"), eid * 2).alias("network_io"),
        (F.lit(100) + k).cast("int").alias("process_count"),
        F.array((F.col("value") / 100.0), (k / 100.0).cast("double")).alias("load_average"),
    )


def load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_from_events(table(spark, sf_dir, "events"))


def frames_from_events(events: DataFrame) -> DataFrame:
    """events -> frames: one upload per user, frames numbered by time from 0.

    The numbering uses the skew-safe ordered index, so a user with most of
    the events is still spread over many tasks.
    """
    # only the ordering columns go through the range shuffle and checkpoint;
    # the detection boxes are rebuilt from the event id afterwards
    base = events.select(F.col("user_id").cast("string").alias("upload_id"), "ts", "event_id")
    indexed = ordered_index(base, ["upload_id"], "ts", "event_id", prev_col=None)
    eid = F.col("event_id")
    detections = F.array(F.create_map(
        F.lit("x"), (eid % 640).cast("double"),
        F.lit("y"), (eid % 480).cast("double"),
        F.lit("width"), (F.lit(20) + eid % 120).cast("double"),
        F.lit("height"), (F.lit(20) + eid % 90).cast("double"),
        F.lit("confidence"), F.lit(0.8)))
    return indexed.select("upload_id", (F.col("rn") - 1).cast("long").alias("frame_index"),
                          F.lit(None).cast("binary").alias("payload"), detections.alias("detections"))


def load_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_from_events(table(spark, sf_dir, "events"))
