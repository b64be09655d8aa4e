"""Readers, appenders and validation for the stored tables."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obslytics import schemas as S
from obslytics.functions import features as X
from obslytics.operators import filters as FL


def since_bound(as_of: _dt.datetime, days: float | None = None, hours: float | None = None) -> _dt.datetime:
    return as_of - _dt.timedelta(days=days or 0, hours=hours or 0)


def _time_bound(df: DataFrame, lo: _dt.datetime, ts: str = "timestamp") -> DataFrame:
    out = df.filter(F.col(ts) >= FL.instant(lo))
    if "date" in df.columns:  # partition column of stored tables: prune whole days
        out = out.filter(F.col("date") >= F.lit(lo.date()))
    return out


def enrich(df: DataFrame, include_midnight: bool = False) -> DataFrame:
    """S1/S2 derived columns: time features, confidence band, category."""
    out = X.add_time_features(df, "timestamp", include_midnight)
    out = X.add_confidence_band(out)
    return X.add_category(out)


def read_activities(spark: SparkSession, source, as_of: _dt.datetime, days_back: int = 30,
                    include_midnight: bool = False) -> DataFrame:
    """Activities of the last ``days_back`` days with analysis columns.

    ``source`` is an activities DataFrame or the path of a stored activities
    table (parquet, partitioned by ``date``).
    """
    lo = since_bound(as_of, days=days_back)
    if isinstance(source, str):
        stored = T.StructType(S.ACTIVITIES.fields + [T.StructField("date", T.DateType())])  # no in-place add
        df = spark.read.schema(stored).parquet(source)
    else:
        df = source
    return enrich(_time_bound(df, lo), include_midnight)


def read_labels(labels: DataFrame, limit: int = 50) -> DataFrame:
    """S3/L4: newest label records first (a stored, date-partitioned table is
    first pruned to the newest days holding ``limit`` records)."""
    if "date" in labels.columns:
        from obslytics.operators.summary import newest_days_bound
        bound = newest_days_bound(labels, limit)
        if bound is not None:
            labels = labels.filter(F.col("date") >= F.lit(bound))
    from obslytics.operators.summary import top_n
    return top_n(labels, [F.col("timestamp").desc(), F.col("id")], limit)


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Full scan of one table of a snapshot written by ``backup``."""
    return spark.read.parquet(f"{root}/{name}")


def _with_identity(df: DataFrame) -> DataFrame:
    if "id" not in df.columns:
        df = df.withColumn("id", F.expr("uuid()"))
    if "timestamp" not in df.columns:
        df = df.withColumn("timestamp", F.current_timestamp())
    return df


def prepare_activities(df: DataFrame) -> DataFrame:
    """S5 shaping: id/time filled in, description, and analysis text for
    alertable types.  The language-model call is not part of the engine (its
    prompts are ``summary.analysis_requests``); alertable rows get the fallback
    text the reference stores when no answer is available."""
    df = _with_identity(df)
    if "description" not in df.columns:
        df = df.withColumn("description", X.description())
    if "ai_analysis" not in df.columns:
        df = df.withColumn("ai_analysis", F.when(X.is_alertable(), F.lit(S.AI_UNAVAILABLE)))
    if "bounding_box" not in df.columns:
        df = df.withColumn("bounding_box", F.lit(None).cast(S.BOX))
    cols = [f.name for f in S.ACTIVITIES.fields]
    return df.select(*[F.col(c).cast(S.ACTIVITIES[c].dataType) for c in cols])


def append_activities(df: DataFrame, path: str) -> None:
    """Append detections, partitioned by day for pruning."""
    (prepare_activities(df).withColumn("date", X.to_date("timestamp"))
        .write.mode("append").partitionBy("date").parquet(path))


def append_labels(df: DataFrame, path: str) -> None:
    """Append label records."""
    df = _with_identity(df)
    cols = [f.name for f in S.LABELING_DATA.fields]
    (df.select(*[F.col(c).cast(S.LABELING_DATA[c].dataType) if c in df.columns
                 else F.lit(None).cast(S.LABELING_DATA[c].dataType).alias(c) for c in cols])
       .withColumn("date", X.to_date("timestamp"))
       .write.mode("append").partitionBy("date").parquet(path))


def split_valid(df: DataFrame, schema: T.StructType,
                ranges: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose required fields are present, castable and in range.

    Returns (valid rows cast to ``schema``, rejected rows with a ``reasons``
    array).  A value that is present but does not cast counts as a type
    error; ``ranges`` adds inclusive bounds checks.  Row-local, no shuffle.
    """
    checks = []
    for name, (lo, hi) in (ranges or {}).items():
        c = F.col(name).try_cast("double")
        checks.append(F.when(c.isNotNull() & ((c < lo) | (c > hi)), F.lit(f"range:{name}")))
    for f in schema.fields:
        if f.name not in df.columns:
            if not f.nullable:
                checks.append(F.lit(f"missing:{f.name}"))
            continue
        c = F.col(f.name)
        if not f.nullable:
            checks.append(F.when(c.isNull(), F.lit(f"null:{f.name}")))
        if isinstance(f.dataType, (T.AtomicType,)) and df.schema[f.name].dataType != f.dataType:
            checks.append(F.when(c.isNotNull() & c.try_cast(f.dataType).isNull(), F.lit(f"type:{f.name}")))
    reasons = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    tagged = df.withColumn("reasons", reasons)
    valid = tagged.filter(F.size("reasons") == 0).select(
        *[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns
           else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
    rejected = tagged.filter(F.size("reasons") > 0)
    return valid, rejected


VIDEO_TYPES = {"mp4": "video/mp4", "m4v": "video/mp4", "avi": "video/x-msvideo", "mov": "video/quicktime", "mkv": "video/x-matroska", "webm": "video/webm"}


def read_videos(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Uploaded files, video files alone (by their extension, in any case): path, length, modification time and type.

    The file names are filtered while listing; contents are read only if asked for."""
    any_case = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(map(any_case, VIDEO_TYPES)) + "}").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.create_map(*(F.lit(x) for pair in VIDEO_TYPES.items() for x in pair))[ext]
    return files.select("path", "length", "modificationTime", kind.alias("content_type"), *(["content"] if content else []))


def write_uploads(files: DataFrame, folder: str) -> DataFrame:
    """Store uploads (name, content) as files of a shared folder; returns (name, length) of those written.

    A task that is run again writes the same files."""
    def write(batches):
        import pyarrow.fs as pafs
        store, path = pafs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "", 1))
        store.create_dir(path, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                with store.open_output_stream(f"{path}/{name}", compression=None) as f:
                    f.write(content)
            yield pdf.assign(length=pdf["content"].map(len))[["name", "length"]]

    return files.select("name", "content").mapInPandas(write, "name string, length long")
