"""Dashboard summaries, counts and ordered lists.

Every summary starts with one partial/final hash aggregate keyed by a small
domain (activity type x hour), so the shuffle carries at most a few hundred
rows per map task however large the table is, and a hot key only makes one
counter bigger.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obslytics.functions import features as X
from obslytics.operators import filters as FL


def py_ts_text(c) -> F.Column:
    """``str(pandas.Timestamp)``: fraction printed only when non-zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.unix_micros(c) % 1000000 == 0, F.date_format(c, "yyyy-MM-dd HH:mm:ss")) \
            .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _most_common(name="activity_type", n="n") -> F.Column:
    # highest count, ties to the lowest name
    return F.min_by(F.col(name), F.struct((-F.col(n)).alias("k"), F.col(name).alias("v")))


def type_hour_counts(df: DataFrame) -> DataFrame:
    """(activity_type, hour) -> n, confidence sum; the base of A1."""
    return (df.groupBy("activity_type", X.hour("timestamp").alias("hour"))
              .agg(F.count(F.lit(1)).alias("n"),
                   F.sum(F.coalesce(F.col("confidence"), F.lit(0.0))).alias("conf_sum")))


def summary(df: DataFrame, as_of: _dt.datetime, session_id: str | None = None, days: int = 7) -> DataFrame:
    """A1: one row with total, per-type counts (map), dense 24-slot hour
    array, mean confidence (0 when empty) and most common type.

    Unlike the reference there is no cap of 1000 fetched rows.
    """
    f = FL.since(FL.by_session(df, session_id), as_of, days=days)
    cube = type_hour_counts(f)
    # map keys cannot be NULL: rows without a time count in the totals only
    per_type = (cube.groupBy("activity_type")
                    .agg(F.sum("n").alias("n"), F.sum("conf_sum").alias("conf_sum"),
                         F.map_from_entries(F.collect_list(F.when(F.col("hour").isNotNull(), F.struct("hour", "n"))))
                         .alias("hours")))
    hours24 = F.transform(F.sequence(F.lit(0), F.lit(23)),
                          lambda h: F.coalesce(F.try_element_at("hours", h), F.lit(0).cast("long")))
    per_type = per_type.withColumn("hours", hours24)
    zeros = F.array_repeat(F.lit(0).cast("long"), 24)
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return per_type.agg(
        total.alias("total_activities"),
        F.coalesce(F.try_divide(F.sum("conf_sum"), F.sum("n")), F.lit(0.0)).alias("average_confidence"),
        _most_common().alias("most_common_activity"),
        F.map_from_entries(F.collect_list(F.when(F.col("activity_type").isNotNull(),
                                                 F.struct("activity_type", "n")))).alias("activity_distribution"),
        F.aggregate(F.collect_list("hours"), zeros,
                    lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b)).alias("hourly_distribution"),
    )


def summary_by_type(summary_row: DataFrame) -> DataFrame:
    return summary_row.select(F.explode("activity_distribution").alias("activity_type", "n"))


def summary_by_hour(summary_row: DataFrame) -> DataFrame:
    return summary_row.select(F.posexplode("hourly_distribution").alias("hour", "n"))


def type_stats(df: DataFrame) -> DataFrame:
    """Per type: count, confidence sum, first and last time (category rides along)."""
    return (df.groupBy("activity_type")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("conf_sum"),
                   F.min("timestamp").alias("t_min"), F.max("timestamp").alias("t_max"),
                   F.min("behavioral_category").alias("behavioral_category")))


def chart_summary(df: DataFrame) -> DataFrame:
    """Total, date range, distinct types, mean confidence, modal type,
    distinct categories -- one row, computed from the per-type aggregate."""
    t = type_stats(df)
    return t.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_activities"),
        X.date_range_text(F.to_date(F.min("t_min")), F.to_date(F.max("t_max"))).alias("date_range"),
        F.count("activity_type").alias("unique_activity_types"),
        F.try_divide(F.sum("conf_sum"), F.sum("n")).alias("avg_confidence"),
        F.coalesce(_most_common(), F.lit("None")).alias("most_common_activity"),
        F.count_distinct("behavioral_category").alias("behavioral_categories"),
    )


def distinct_types(df: DataFrame, approx: bool = False) -> DataFrame:
    """Number of distinct activity types."""
    agg = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(agg("activity_type").alias("unique_activity_types"))


def frequent_types(df: DataFrame, min_count: int = 5) -> DataFrame:
    """Per-type count and mean confidence, keeping types with count > min_count."""
    return (df.groupBy("activity_type")
              .agg(F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("avg_confidence"))
              .filter(F.col("count") > min_count))


def confidence_by_hour(df: DataFrame) -> DataFrame:
    """The 24 per-hour confidence groups, dense over hours.

    The groups are kept as aggregates (count, sum, min, max) rather than
    collected lists, so a busy hour never becomes one in-memory list.
    ``confidence_lists`` gives the lists themselves, in chunks.
    """
    spine = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"),
                                             F.lit(None).cast("double").alias("confidence"))
    rows = df.select(X.hour("timestamp").alias("hour"), "confidence").unionByName(spine)
    return (rows.groupBy("hour")
                .agg(F.count("confidence").alias("n"), F.sum("confidence").alias("conf_sum"),
                     F.min("confidence").alias("conf_min"), F.max("confidence").alias("conf_max")))


def confidence_lists(df: DataFrame, length: int = 1000) -> DataFrame:
    """The 24 lists of confidences by hour, in the order of time, as numbered chunks of at most ``length`` values.

    Rows (hour, chunk, n, confidences); places come from the skew-safe ordered index, so a busy hour is many chunks and
    never one list in memory.  Rows without a time are left out."""
    from obslytics.operators.ordered import ordered_index
    rows = df.filter(F.col("timestamp").isNotNull()).select("id", "timestamp", "confidence", X.hour("timestamp").alias("hour"))
    placed = ordered_index(rows, ["hour"], "timestamp", "id", rn_col="_rn", prev_col=None)
    chunk = F.floor((F.col("_rn") - 1) / length).cast("long")
    # null confidences keep their place in the list
    lists = placed.groupBy("hour", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("_rn", "confidence"))).alias("v"))
    return lists.select("hour", "chunk", F.size("v").cast("long").alias("n"), F.transform("v", lambda x: x["confidence"]).alias("confidences"))


def total_confidence(df: DataFrame) -> DataFrame:
    """Running total of confidence == its sum."""
    return df.agg(F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("total_confidence"))


def newest_days_bound(df: DataFrame, n: int):
    """The latest ``date`` such that the days from it onwards hold at least
    ``n`` rows (None if the table has fewer).  Counts per day read only the
    partition column; the per-day table has one row per day."""
    per_day = df.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    cum = per_day.withColumn("_cum", F.sum("_n").over(
        Window.orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    return cum.filter(F.col("_cum") >= n).agg(F.max("date").alias("d")).first()["d"]


def recent(df: DataFrame, n: int = 100, session_id: str | None = None) -> DataFrame:
    """L1: newest detections first.  A top-k keeps n rows per task and merges
    them in one task; on a table partitioned by ``date`` the scan is first
    pruned to the newest days that hold n rows, so that merge stays small."""
    f = FL.by_session(df, session_id)
    if "date" in f.columns:
        bound = newest_days_bound(f, n)
        if bound is not None:
            f = f.filter(F.col("date") >= F.lit(bound))
    return top_n(f, [F.col("timestamp").desc(), F.col("id").desc()], n)


def timeline(df: DataFrame, as_of: _dt.datetime, session_id: str | None = None, hours: int = 24,
             cap: int = 1000) -> DataFrame:
    """Oldest first within the last ``hours``, ISO time text."""
    f = FL.since(FL.by_session(df, session_id), as_of, hours=hours)
    top = top_n(f, [F.col("timestamp").asc(), F.col("id").asc()], cap)
    return top.select(X.iso_time("timestamp").alias("timestamp"), "activity_type", "confidence",
                      "description")


def alerts(df: DataFrame, as_of: _dt.datetime, session_id: str | None = None, hours: int = 1,
           cap: int = 10) -> DataFrame:
    """Alertable detections of the last hour, newest first, capped;
    ``count`` is the size of the capped list (as in the reference)."""
    f = FL.alertable(FL.since(FL.by_session(df, session_id), as_of, hours=hours))
    top = top_n(f, [F.col("timestamp").desc(), F.col("id").desc()], cap)
    return top.select("id", X.iso_time("timestamp").alias("timestamp"), "activity_type", "confidence",
                      "session_id", F.count(F.lit(1)).over(Window.partitionBy()).alias("count"))


#: buckets of the middle level of a top-n
FAN_IN = 64


def top_n_per_group(df: DataFrame, group: str, order: list, n: int, fan_in: int = FAN_IN) -> DataFrame:
    """The first ``n`` rows per ``group`` in ``order`` (a list of columns or
    sort expressions; remaining ties are broken by a hash of the row).

    ``row_number() <= n`` is planned as a window group limit: every map task
    forwards at most n rows per group.  A middle level keeps n rows per
    (group, one of ``fan_in`` buckets of input partitions), so the last task of
    a group merges n x ``fan_in`` rows even for a group present everywhere.
    """
    # a hash of the whole row breaks remaining ties, so both levels (and any
    # recomputation) keep the same rows
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    order = list(order) + ([F.xxhash64(*hashable)] if hashable else [])
    out = df.withColumn("_b", F.spark_partition_id() % fan_in)
    w1 = Window.partitionBy(group, "_b").orderBy(*order)
    out = out.withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= n).drop("_rn", "_b")
    w = Window.partitionBy(group).orderBy(*order)
    return out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_n(df: DataFrame, order: list, n: int, fan_in: int = FAN_IN) -> DataFrame:
    """The first ``n`` rows in ``order`` (ending in a unique key), sorted.

    ``orderBy().limit()`` alone would merge n rows from every task in one
    task; a middle level first keeps n rows per bucket of input partitions, so
    that merge sees at most n x ``fan_in`` rows.
    """
    df = df.withColumn("_b", F.spark_partition_id() % fan_in)
    w = Window.partitionBy("_b").orderBy(*order)
    df = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn", "_b")
    return df.orderBy(*order).limit(n)


def first_per_group(df: DataFrame, group: str, order: str, n: int = 10) -> DataFrame:
    """First ``n`` rows per group (see ``top_n_per_group``)."""
    return top_n_per_group(df, group, [F.col(order)], n)


def bounded_sample(df: DataFrame, n: int = 1000, seed: int = 42, key: str = "id") -> DataFrame:
    """Repeatable sample of at most ``n`` rows: the n smallest
    ``md5(seed || key)``, by the two-level top-n.
    """
    h = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    return top_n(df.withColumn("_h", h), [F.col("_h"), F.col(key)], n).drop("_h")


def first_label_records(labels: DataFrame, n: int = 8) -> DataFrame:
    """The newest ``n`` label records, with the full number of their labels."""
    newest = top_n(labels, [F.col("timestamp").desc(), F.col("id")], n)
    return newest.withColumn("n_labels", X.label_count("labels"))


def label_stats(labels: DataFrame, name: str | None = None) -> DataFrame:
    """Labels per record and whether a given label is present."""
    return labels.select("id", X.label_count("labels").alias("n_labels"),
                         X.has_label("labels", name).alias("has_label"))


def combine_rows(*rows: DataFrame) -> DataFrame:
    """Put single-row aggregates side by side without a join: union them with
    the missing columns NULL, then keep the one non-NULL value per column."""
    cols = [c for r in rows for c in r.columns]
    stacked = None
    for r in rows:
        part = r.select(*[F.col(c) if c in r.columns else F.lit(None).alias(c) for c in cols])
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row with ``total_<name>`` = row count of each table (a global
    count reads no column)."""
    return combine_rows(*[t.agg(F.count(F.lit(1)).alias(f"total_{n}")) for n, t in tables.items()])


def analysis_requests(df: DataFrame) -> DataFrame:
    """Prompt text for alertable detections (the model call itself is
    a network service and not part of the engine)."""
    return FL.alertable(df).select("id", "activity_type",
                                   X.analysis_prompt().alias("prompt"))


def display_fields(df: DataFrame) -> DataFrame:
    """UI texts derived on the engine side."""
    return df.select("id", X.display_name("activity_type").alias("display_name"),
                     X.percent_text("confidence").alias("confidence_text"),
                     X.is_alertable("activity_type").alias("alertable"))

