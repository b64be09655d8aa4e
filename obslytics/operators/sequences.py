"""Sequence construction and per-key features (W3, W9, M15-M17) and the
frame/detection path (P13, S14, L6).

Per-key ordering (row numbers, previous timestamp) uses the skew-safe
``ordered_index``; after that every group is bounded by the sequence length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array

from obslytics.functions import features as X
from obslytics.operators import filters as FL
from obslytics.operators.ordered import minutes_between, ordered_index, time_bucket
from obslytics.operators.quantiles import exact_quantiles
from obslytics.operators.summary import first_per_group

HOT_ROWS = 100_000  # rows of a key that one task orders

FEATURES = ["confidence", "hour", "k", "weekday", "gap_minutes"]


def _with_hot(df: DataFrame, key: str) -> DataFrame:
    """Marks the rows of keys with more than ``HOT_ROWS`` rows in ``_hot``."""
    hot = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select("_key", F.lit(True).alias("_hot"))
    return df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def _hot_time_bucket(col: str) -> F.Column:
    """The minute for hot keys only: the rows of any other key are one bucket, after those without a time."""
    return F.when(F.col("_hot"), time_bucket(col)).when(F.col(col).isNotNull(), F.timestamp_seconds(F.lit(0)))


def sequence_rows(df: DataFrame, key: str = "session_id", k_col: str = "k",
                  label: str = "activity_type") -> DataFrame:
    """Per-event sequence features in key order: confidence, hour, k,
    weekday (Mon=0) and minutes since the key's previous event (0 first)."""
    base = df.select("id", key, "timestamp", "confidence", F.col(k_col).cast("double").alias("k"),
                     F.col(label).alias("label"))
    o = ordered_index(_with_hot(base, key), [key], "timestamp", "id", rn_col="rn", prev_col="_prev", bucket=_hot_time_bucket)
    return o.select(key, "rn", "id", "timestamp", "label",
                    F.col("confidence").cast("double").alias("confidence"),
                    X.hour("timestamp").cast("double").alias("hour"), "k",
                    F.weekday("timestamp").cast("double").alias("weekday"),
                    F.coalesce(minutes_between(F.col("timestamp"), F.col("_prev")), F.lit(0.0)).alias("gap_minutes"))


def sequences(df: DataFrame, length: int = 10, step: int | None = None, key: str = "session_id",
              k_col: str = "k") -> DataFrame:
    """Fixed-length sequences of successive events per key, long form
    (key, seq_index, step_index, features...).  Only complete sequences are
    kept.  ``step`` defaults to ``length`` (non-overlapping); a smaller step
    gives sliding windows and copies each row ``ceil(length/step)`` times.
    """
    step = step or length
    rows = sequence_rows(df, key, k_col)
    r0 = F.col("rn") - 1
    first = F.greatest(F.ceil((r0 - (length - 1)) / step), F.lit(0)).cast("long")
    last = F.floor(r0 / step).cast("long")
    ex = rows.withColumn("seq_index", F.explode(F.sequence(first, last)))
    ex = ex.withColumn("step_index", (r0 - F.col("seq_index") * step).cast("long"))
    # complete sequences only; the window group has at most ``length`` rows
    w = Window.partitionBy(key, "seq_index")
    ex = ex.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") == length).drop("_n")
    return ex.select(key, "seq_index", "step_index", "label", *FEATURES)


def _steps(seq: DataFrame, key: str, label: str | None) -> DataFrame:
    """One row per sequence: its steps in order as ``_steps`` and the last step's label."""
    extra = [F.max_by(label, "step_index").alias(label)] if label else []
    return seq.groupBy(key, "seq_index").agg(F.array_sort(F.collect_list(F.struct("step_index", *FEATURES))).alias("_steps"), *extra)


def _flat() -> F.Column:
    return F.flatten(F.transform("_steps", lambda s: F.array(*[s[f] for f in FEATURES])))


def _folds(decays: tuple[float, ...] = (0.5, 0.9)) -> list[F.Column]:
    weights = lambda d: (1 - F.pow(F.lit(d), F.size("_steps"))) / (1 - d)
    fold = lambda f, d: F.aggregate("_steps", F.lit(0.0), lambda s, x: F.lit(d) * s + x[f]) / weights(d)
    return [fold(f, d).alias(f"d{i}_{f}") for i, d in enumerate(decays) for f in FEATURES]


def flatten_sequences(seq: DataFrame, key: str = "session_id", label: str | None = "label") -> DataFrame:
    """One row per sequence with the features flattened step by step
    (length x 5 values) as an ML vector; the label is the last step's.
    Groups hold ``length`` rows."""
    return _steps(seq, key, label).select(key, "seq_index", *([label] if label else []), array_to_vector(_flat()).alias("features"))


def order_features(seq: DataFrame, key: str = "session_id", decays: tuple[float, ...] = (0.5, 0.9), label: str | None = "label") -> DataFrame:
    """Per sequence the state of a decayed fold over its steps, ``state = decay * state + x``, for each feature and decay,
    over the sum of the weights: what a recurrent cell without gates would remember.  Columns ``d<i>_<feature>``."""
    return _steps(seq, key, label).select(key, "seq_index", *([label] if label else []), *_folds(decays))


def flat_columns(seq: DataFrame, key: str = "session_id", length: int = 10) -> DataFrame:
    """M17 as plain columns ``f0 .. f<5 length - 1>``, step by step."""
    flat = flatten_sequences(seq, key).withColumn("_f", vector_to_array("features"))
    return flat.select(key, "seq_index", "label", *(F.col("_f")[i].alias(f"f{i}") for i in range(length * len(FEATURES))))


def sequence_vectors(seq: DataFrame, key: str = "session_id") -> DataFrame:
    """The flat vector of each sequence followed by its order features, in one grouping; a null key has none."""
    g = _steps(seq.where(F.col(key).isNotNull()), key, "label")
    return g.select(key, "seq_index", "label", array_to_vector(F.concat(_flat(), F.array(*_folds()))).alias("features"))


def statistical_features(df: DataFrame, key: str, value: str = "confidence") -> DataFrame:
    """Mean, std, min, max, median, p25, p75, var, peak-to-peak, length
    per key (population std/var; exact interpolated percentiles, see
    ``quantiles.exact_quantiles``)."""
    v = F.col(value)
    q = exact_quantiles(df, key, value, [0.5, 0.25, 0.75]).select(F.col(key).alias("_key"), "q")
    stats = df.groupBy(key).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.var_pop(v).alias("var"), (F.max(v) - F.min(v)).alias("ptp"), F.count(v).alias("length"))
    return (stats.join(q, F.col(key).eqNullSafe(F.col("_key")), "left")
            .select(key, "mean", "std", "min", "max", F.col("q")[0].alias("median"), F.col("q")[1].alias("p25"),
                    F.col("q")[2].alias("p75"), "var", "ptp", "length"))


def temporal_features(df: DataFrame, key: str = "session_id") -> DataFrame:
    """mean/std hour, mean weekday, distinct days, mean/std seconds
    between successive events (0, 0 when a key has one event).

    Sample std; the gaps come from the skew-safe ordered index.
    """
    base = df.select("id", key, "timestamp")
    o = ordered_index(base, [key], "timestamp", "id", rn_col="_rn", prev_col="_prev")
    gap = (F.unix_micros("timestamp") - F.unix_micros("_prev")) / F.lit(1_000_000.0)
    h = X.hour("timestamp")
    return o.groupBy(key).agg(
        F.avg(h).alias("hour_mean"), F.stddev_samp(h).alias("hour_std"),
        F.avg(F.weekday("timestamp")).alias("weekday_mean"),
        F.count_distinct(F.to_date("timestamp")).alias("distinct_days"),
        # mean of successive gaps telescopes to (last - first) / (n - 1)
        F.coalesce(F.try_divide(F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp")),
                                F.count(F.lit(1)) - 1) / F.lit(1_000_000.0), F.lit(0.0)).alias("gap_mean"),
        F.coalesce(F.stddev_samp(gap), F.lit(0.0)).alias("gap_std"))


# --- frames and detections -----------------------------------------------------

def box_activity(box: str = "box") -> tuple[F.Column, F.Column]:
    """Activity and confidence from the bounding-box area."""
    area = F.col(box)["width"] * F.col(box)["height"]
    activity = F.when(area > 10000, "standing").when(area > 5000, "sitting").otherwise("focused_activity")
    conf = F.when(area > 10000, 0.75).when(area > 5000, 0.70).otherwise(0.65)
    return activity, conf


def detections(frames: DataFrame) -> DataFrame:
    """One row per box of each frame with activity, confidence, text."""
    ex = frames.select("upload_id", "frame_index", F.explode("detections").alias("box"))
    activity, conf = box_activity("box")
    return ex.select("upload_id", "frame_index", "box", activity.alias("activity_type"),
                     conf.alias("confidence")).withColumn(
        "description", X.description("activity_type", "confidence"))


def ingest_detections(frames: DataFrame, source: str = "live", session_id: str | None = None,
                      threshold: float = 0.6) -> DataFrame:
    """Significant detections shaped as activity rows.  An upload keeps
    one session id for all its detections (``session_id`` or the upload id)."""
    d = FL.significant_detections(detections(frames), threshold)
    session = F.lit(session_id) if session_id else F.concat(F.lit("upload_"), F.col("upload_id"))
    return d.select(F.expr("uuid()").alias("id"), F.current_timestamp().alias("timestamp"), "activity_type",
                    "confidence", F.col("box").alias("bounding_box"), "description",
                    F.lit(source).alias("video_source"), session.alias("session_id"),
                    "upload_id", "frame_index")


def upload_detections(frames: DataFrame, n: int = 10, stride: int = 10, cap: int = 100) -> DataFrame:
    """F8 + P13 + F6 + L6: detections of the sampled frames of each upload,
    first ``n`` per upload in frame order."""
    d = FL.significant_detections(detections(FL.sample_frames(frames, stride, cap)))
    return first_per_group(d, "upload_id", "frame_index", n)
