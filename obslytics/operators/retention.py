"""Retention over stored tables without rewriting what is kept.

A store is a folder with one folder per table, below it one folder per generation of files and below that one folder
per day.  A snapshot names, for every table, the day folders that make it up; readers follow the newest snapshot.
Retention of all tables is one step to the next snapshot: folders of expired days are left out by name, only the day
that holds the cutoff is read and written anew, and the snapshot is published last.  A run that is lost before leaves
the former snapshot as it was; run again, it replaces the folders it had written.  Files that no snapshot names are
left to ``unnamed_folders`` and the store's own clean-up.

A snapshot has a row for each table and day, so the driver holds as many names as there are days.  Rows without a time
belong to no day that can expire and are kept.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obslytics.operators import filters as FL

SNAPSHOT = "table string, schema string, folder string, day string, rows long, version int"


def _published(spark: SparkSession, root: str) -> list:
    """Rows of the newest snapshot; of a store without one, none."""
    try:
        found = spark.read.schema(SNAPSHOT).json(f"{root}/snapshots")
    except Exception as e:  # noqa: BLE001 - Spark reports a missing folder only through its error class
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    newest = found.agg(F.max("version")).first()[0]
    return [] if newest is None else found.where(F.col("version") == newest).orderBy("table", "day").collect()


def publish(spark: SparkSession, root: str, rows: list[tuple], version: int) -> None:
    """Switch to a snapshot: one file, which appears as a whole when its write is committed."""
    named = [(*r, version) for r in rows] or [(None, None, None, None, 0, version)]
    spark.createDataFrame(named, SNAPSHOT).coalesce(1).write.mode("append").json(f"{root}/snapshots")


def _write(df: DataFrame, root: str, table: str, version: int) -> list[tuple]:
    """Write day folders of a new generation (replacing those of a lost run) and name them with their row counts."""
    spark, path = df.sparkSession, f"{root}/{table}/generation={version}"
    dated = df.withColumn("date", F.to_date("timestamp"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    days = spark.read.schema(dated.schema).parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("rows")).collect()
    return [(table, df.schema.json(), f"generation={version}/date={r.date or '__HIVE_DEFAULT_PARTITION__'}", None if r.date is None else str(r.date), r.rows)
            for r in days]


def store_tables(tables: dict[str, DataFrame], root: str) -> None:
    """The first snapshot of a store; every table has a column ``timestamp``.  An empty table is kept with its schema."""
    spark: SparkSession = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        rows += _write(df, root, name, 0) or [(name, df.schema.json(), None, None, 0)]
    publish(spark, root, rows, 0)


def read_stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table as the newest snapshot names it."""
    rows = [r for r in _published(spark, root) if r.table == table]
    if not rows:
        raise FileNotFoundError(f"no table {table} in {root}")
    schema = T.StructType.fromJson(json.loads(rows[0].schema))
    paths = [f"{root}/{table}/{r.folder}" for r in rows if r.folder]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


STATS = "table string, rows_read long, rows_deleted long, rows_kept long, days_dropped long, cutoff string"


def retain(spark: SparkSession, root: str, as_of: _dt.datetime, days_to_keep: int = 30) -> DataFrame:
    """Drop what is older than the cutoff from every table of the store, in one switch.

    Returns a row for each table: rows read (those of the cutoff's day alone), deleted and kept, whole days dropped."""
    cutoff = as_of - _dt.timedelta(days=days_to_keep)
    before = _published(spark, root)
    version = max((r.version for r in before), default=-1) + 1
    after, stats = [], []
    for table in sorted({r.table for r in before if r.table}):
        own = [r for r in before if r.table == table]
        schema = own[0].schema
        expired = [r for r in own if r.day and r.day < str(cutoff.date())]
        split = [r for r in own if r.day == str(cutoff.date()) and cutoff.time() != _dt.time()]
        kept = [(table, r.schema, r.folder, r.day, r.rows) for r in own if r.folder and r not in expired and r not in split]
        for r in split:
            day = spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{root}/{table}/{r.folder}")
            kept += _write(FL.newer_than(day, cutoff), root, table, version)
        total, left = sum(r.rows for r in own), sum(r[4] for r in kept)
        stats.append((table, sum(r.rows for r in split), total - left, left, len(expired), cutoff.isoformat()))
        after += kept or [(table, schema, None, None, 0)]
    publish(spark, root, after, version)
    return spark.createDataFrame(stats, STATS)


def unnamed_folders(spark: SparkSession, root: str, table: str) -> list[str]:
    """Day folders of a table that were written but that no snapshot so far names: those of lost runs."""
    named = {r.folder for r in spark.read.schema(SNAPSHOT).json(f"{root}/snapshots").where(F.col("table") == table).select("folder").distinct().collect()}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/{table}").select("path")
    folders = files.select(F.regexp_extract("path", r"(generation=[0-9]+/date=[^/]+)/[^/]+$", 1).alias("f")).distinct()
    return sorted(r.f for r in folders.collect() if r.f not in named)
