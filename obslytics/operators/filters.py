"""Filters and predicates (F1-F14).  All are plain ``filter`` expressions, so
Catalyst pushes the column comparisons into the parquet scan."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslytics import schemas as S


def instant(moment: _dt.datetime) -> F.Column:
    """A point of time as a literal; a naive one is UTC, whatever the zone of
    the Python process."""
    moment = moment.replace(tzinfo=_dt.timezone.utc) if moment.tzinfo is None else moment
    return F.timestamp_micros(F.lit((moment - _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)) // _dt.timedelta(microseconds=1)))


def by_session(df: DataFrame, session_id: str | None = None) -> DataFrame:
    """optional session equality."""
    return df if session_id is None else df.filter(F.col("session_id") == session_id)


def since(df: DataFrame, as_of: _dt.datetime, days: float = 0, hours: float = 0,
          ts: str = "timestamp") -> DataFrame:
    """trailing time bound ``ts >= as_of - interval`` (plus a date bound
    when the table is partitioned by ``date``)."""
    lo = as_of - _dt.timedelta(days=days, hours=hours)
    out = df.filter(F.col(ts) >= instant(lo))
    if "date" in df.columns:
        out = out.filter(F.col("date") >= F.lit(lo.date()))
    return out


def alertable(df: DataFrame, col: str = "activity_type") -> DataFrame:
    """alertable activity types only."""
    return df.filter(F.col(col).isin(*S.ALERTABLE))


def min_confidence(df: DataFrame, threshold: float = 0.7, strict: bool = False) -> DataFrame:
    """F4 (inclusive, default 0.7) and F14 (``strict=True``, e.g. 0.8)."""
    c = F.col("confidence")
    return df.filter(c > threshold if strict else c >= threshold)


def activity_types(df: DataFrame, types, col: str = "activity_type") -> DataFrame:
    """Membership in a list of types, or in a DataFrame of types."""
    if isinstance(types, DataFrame):
        keys = types.select(F.col(types.columns[0]).alias(col)).distinct()
        return df.join(keys, col, "left_semi")
    return df.filter(F.col(col).isin(*types))


def significant_detections(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """detections stored only when confidence is strictly above 0.6."""
    return df.filter(F.col("confidence") > threshold)


def notify(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """notification rows, confidence strictly above 0.7."""
    return df.filter(F.col("confidence") > threshold)


def sample_frames(frames: DataFrame, stride: int = 10, cap: int = 100, double_read: bool = True,
                  idx: str = "frame_index") -> DataFrame:
    """F8: frames the upload loop analyses.

    The loop reads ``1 + double_read`` frames per turn and analyses the last
    one on every ``stride``-th turn, for at most ``cap`` turns.  Pure
    arithmetic on the frame index: no ordering, no shuffle.
    """
    i = F.col(idx)
    if double_read:
        turn = F.floor(i / 2)
        keep = (i % 2 == 1) & (turn % stride == 0) & (turn < cap)
    else:
        keep = (i % stride == 0) & (i < cap)
    return frames.filter(keep)


def older_than(df: DataFrame, cutoff: _dt.datetime, ts: str = "timestamp") -> DataFrame:
    """rows a retention job removes (with a ``date`` bound on tables
    partitioned by day, so newer days are never read)."""
    out = df.filter(F.col(ts) < instant(cutoff))
    if "date" in df.columns:
        out = out.filter(F.col("date") <= F.lit(cutoff.date()))
    return out


def newer_than(df: DataFrame, cutoff: _dt.datetime, ts: str = "timestamp") -> DataFrame:
    """F11 complement: rows a retention job keeps, those without a time included
    (older days pruned)."""
    out = df.filter(~F.coalesce(F.col(ts) < instant(cutoff), F.lit(False)))
    if "date" in df.columns:
        out = out.filter((F.col("date") >= F.lit(cutoff.date())) | F.col("date").isNull())
    return out


def analytics_filter(df: DataFrame, start: _dt.datetime | None = None, end: _dt.datetime | None = None,
                     types=None, session_id: str | None = None,
                     min_conf: float | None = None) -> DataFrame:
    """composable query over time range, types, session and confidence."""
    out = df
    if start is not None:
        out = out.filter(F.col("timestamp") >= instant(start))
    if end is not None:
        out = out.filter(F.col("timestamp") <= instant(end))
    if types is not None:
        out = activity_types(out, types)
    out = by_session(out, session_id)
    if min_conf is not None:
        out = min_confidence(out, min_conf)
    return out


class InsufficientData(ValueError):
    """raised by jobs that need a minimum number of rows or groups."""


def require_rows(df: DataFrame, minimum: int, what: str = "rows") -> DataFrame:
    """F13 guard for model jobs: checks ``minimum`` rows without a full count."""
    error = guard(df, minimum, what).first()["error"]
    if error:
        raise InsufficientData(error)
    return df


def guard(df: DataFrame, minimum: int, what: str = "rows") -> DataFrame:
    """F13 as a row: how many of at most ``minimum`` rows are there, whether they suffice, and the error's text if not."""
    n = len(df.limit(minimum).take(minimum))
    error = None if n >= minimum else f"need at least {minimum} {what}, found {n}"
    return df.sparkSession.createDataFrame([(what, minimum, n, error is None, error)], "what string, needed int, found int, enough boolean, error string")
