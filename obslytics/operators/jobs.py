"""Operational jobs: retention, backup snapshots, reports.

Jobs write to the folder they are given (on a cluster: a shared folder).  A
snapshot is written table by table and is only named in the manifest once
all parts are complete, so a lost executor at worst leaves an unreferenced
folder that the next run overwrites.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obslytics.operators import filters as FL
from obslytics.operators.summary import combine_rows


def retention_stats(tables: dict[str, DataFrame], as_of: _dt.datetime, days_to_keep: int = 30) -> DataFrame:
    """Rows each table would lose at the cutoff (one row).

    Each count is one global aggregate of a pushed-down ``ts < cutoff`` filter.
    """
    cutoff = as_of - _dt.timedelta(days=days_to_keep)
    parts = [FL.older_than(t, cutoff).agg(F.count(F.lit(1)).alias(f"{name}_deleted"))
             for name, t in tables.items()]
    out = combine_rows(*parts)
    return out.withColumn("cutoff_date", F.lit(cutoff.isoformat()))


def apply_retention(df: DataFrame, path: str, as_of: _dt.datetime, days_to_keep: int = 30) -> DataFrame:
    """Write the rows newer than the cutoff as a new snapshot at ``path``
    and return its reader.  When the table is partitioned by ``date`` the filter prunes
    whole partitions.  ``retention.retain`` drops expired days without rewriting the others."""
    cutoff = as_of - _dt.timedelta(days=days_to_keep)
    kept = FL.newer_than(df, cutoff)
    writer = kept.write.mode("overwrite")
    if "date" in kept.columns:
        writer = writer.partitionBy("date")
    writer.parquet(path)
    return df.sparkSession.read.schema(kept.schema).parquet(path)


def backup(tables: dict[str, DataFrame], root: str, as_of: _dt.datetime) -> DataFrame:
    """Timestamped snapshot of every table plus a manifest with counts.

    Returns the manifest as a DataFrame (one row per table).  Counts are taken
    from the written files, so they describe exactly what was saved.
    """
    spark: SparkSession = next(iter(tables.values())).sparkSession
    stamp = as_of.strftime("%Y%m%d_%H%M%S")
    base = f"{root}/backup_{stamp}"
    rows = []
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{base}/{name}")
        rows.append((name, f"{base}/{name}"))
    counts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows"))
                   .select(F.lit(n).alias("table"), F.lit(p).alias("path"), "rows", F.lit(stamp).alias("timestamp"))
              for n, p in rows]
    manifest = counts[0]
    for c in counts[1:]:
        manifest = manifest.unionByName(c)
    manifest.coalesce(1).write.mode("overwrite").json(f"{base}/_manifest")
    return spark.read.json(f"{base}/_manifest")


def write_report(report: DataFrame, path: str) -> str:
    """Write a one-row report as JSON (the row is already aggregated,
    so one output file is one task on a handful of bytes)."""
    report.coalesce(1).write.mode("overwrite").json(path)
    return path


def report_to_dict(report: DataFrame) -> dict:
    """Read a written/aggregated one-row report back as a Python dict (tests, UI)."""
    row = report.first()
    out = row.asDict(recursive=True) if row else {}
    if "report" in out:
        out = {k: json.loads(v) for k, v in out["report"].items()}
    return out
