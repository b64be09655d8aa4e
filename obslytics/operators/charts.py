"""Aggregates behind the chart panels.

Pivots use an explicit value list, so no second pass discovers the values; Spark
aggregates by key and pivot value first, then per key.  Dense
outputs are made by a union with a tiny spine of keys, never by a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obslytics import schemas as S
from obslytics.functions import features as X
from obslytics.operators.ordered import minutes_between, ordered_index
from obslytics.operators.quantiles import exact_quantiles
from obslytics.operators.summary import combine_rows

CATEGORIES = [c for c, _ in S.CATEGORY_COLORS]
HOURS = list(range(24))

# Grouping keys whose domain is fixed and small (weekdays, categories, hours,
# periods): a per-group table keyed by one of them is safe to broadcast.
BOUNDED_KEYS = {"day_of_week": 7, "behavioral_category": len(CATEGORIES) + 1, "hour": 24,
                "time_period": len(S.TIME_PERIODS) + 1, "is_weekend": 2}


def _small(df: DataFrame, key: str) -> DataFrame:
    """Broadcast hint only for tables keyed by a bounded domain; otherwise
    AQE decides at run time from the measured size."""
    return F.broadcast(df) if key in BOUNDED_KEYS else df


# --- timeline panel --------------------------------------------------------

def by_date(df: DataFrame) -> DataFrame:
    """A9 (fluent-chain aggregate): per date count, mean confidence, modal category
    (ties to the lowest name)."""
    return df.groupBy(F.col("date")).agg(
        F.count("activity_type").alias("activity_type"),  # non-null values, as a column count
        F.avg("confidence").alias("confidence"),
        F.mode("behavioral_category", True).alias("behavioral_category"))


def daily_counts(df: DataFrame) -> DataFrame:
    """A10."""
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def daily_category(df: DataFrame) -> DataFrame:
    """Date x category counts, zero filled, categories as columns."""
    return (df.filter(F.col("behavioral_category").isNotNull())
              .groupBy("date").pivot("behavioral_category", CATEGORIES).count().na.fill(0))


def daily_confidence(df: DataFrame) -> DataFrame:
    """Daily mean and sample std of confidence, NaN -> 0."""
    return (df.groupBy("date")
              .agg(F.avg("confidence").alias("mean"), F.stddev_samp("confidence").alias("std"))
              .na.fill(0.0, ["mean", "std"]))


def daily_activity(df: DataFrame) -> DataFrame:
    """Daily count and mean confidence."""
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("activity_count"),
                                  F.avg("confidence").alias("avg_confidence"))


def daily_trend(df: DataFrame) -> DataFrame:
    """Least-squares line of daily counts over the day index 0..n-1.

    The daily aggregate has one row per day, so the ordered window that
    numbers the days runs over a small table.
    """
    d = daily_counts(df)
    d = d.withColumn("day_index", F.row_number().over(Window.orderBy("date")) - 1)
    return d.agg(F.regr_slope("n", "day_index").alias("slope"),
                 F.regr_intercept("n", "day_index").alias("intercept"),
                 F.count(F.lit(1)).alias("days"))


def confidence_trend(df: DataFrame) -> DataFrame:
    """Least-squares line of confidence on hour (global partial aggregate)."""
    h = X.hour("timestamp").cast("double")
    return df.agg(F.regr_slope("confidence", h).alias("slope"),
                  F.regr_intercept("confidence", h).alias("intercept"))


# --- heatmaps ----------------------------------------------------------------

def hour_by_weekday(df: DataFrame) -> DataFrame:
    """Hour x day-of-week counts, Monday first, zero filled (observed hours)."""
    return df.groupBy("hour").pivot("day_of_week", S.DAY_ORDER).count().na.fill(0)


def activity_by_hour(df: DataFrame) -> DataFrame:
    """Activity x hour counts (hours 0..23 as columns h0..h23); rows
    without a type are dropped like NaN group keys."""
    out = (df.filter(F.col("activity_type").isNotNull())
             .groupBy("activity_type").pivot("hour", HOURS).count().na.fill(0))
    return out.select("activity_type", *[F.col(str(h)).alias(f"h{h}") for h in HOURS])


def category_by_period(df: DataFrame) -> DataFrame:
    """Category x time period counts; rows without a period or category
    are dropped, absent periods are 0."""
    return (df.filter(F.col("time_period").isNotNull() & F.col("behavioral_category").isNotNull())
              .groupBy("behavioral_category").pivot("time_period", S.TIME_PERIODS).count().na.fill(0))


def confidence_matrix(df: DataFrame) -> DataFrame:
    """Mean confidence per (activity, category), observed pairs only."""
    return (df.filter(F.col("behavioral_category").isNotNull() & F.col("activity_type").isNotNull())
              .groupBy("activity_type", "behavioral_category")
              .agg(F.avg("confidence").alias("avg_confidence")))


def hour_by_activity(df: DataFrame) -> DataFrame:
    """Hour x activity counts, the 15 classes as columns (observed hours)."""
    return df.groupBy("hour").pivot("activity_type", S.ACTIVITY_TYPES).count().na.fill(0)


def weekday_by_hour(df: DataFrame) -> DataFrame:
    """Day x hour counts with all 7 days present (Monday first).

    Missing days come from a 7-row spine unioned in before the pivot; its
    NULL hour matches no pivot value, so it only creates the row.
    """
    spark = df.sparkSession
    spine = spark.createDataFrame([(d, None) for d in S.DAY_ORDER], "day_of_week string, hour int")
    rows = df.select("day_of_week", "hour").unionByName(spine)
    out = rows.groupBy("day_of_week").pivot("hour", HOURS).count().na.fill(0)
    order = F.array_position(F.array(*[F.lit(d) for d in S.DAY_ORDER]), F.col("day_of_week")) - 1
    return out.select(order.alias("day_index"), "day_of_week",
                      *[F.col(str(h)).alias(f"h{h}") for h in HOURS])


def activity_correlation(df: DataFrame) -> DataFrame:
    """Pearson correlation of hourly counts between activity types
    over the observed hours, strict lower triangle (a > b by name).

    One aggregate over the rows gives 24 counts per type; the types' arrays meet in one row
    (at most one array per activity type), where the pairs are formed.  A zero-variance side gives NULL.
    """
    wide = df.filter(F.col("activity_type").isNotNull()).groupBy("activity_type").pivot("hour", HOURS).count()
    counts = ", ".join(f"coalesce(`{h}`, 0l)" for h in HOURS)
    one = wide.selectExpr("activity_type as type", f"array({counts}) as n").groupBy().agg(F.collect_list(F.struct("type", "n")).alias("types"))
    # hours at which some type has an event
    one = one.selectExpr("types", "filter(sequence(0, 23), h -> exists(types, t -> t.n[h] > 0)) as hours")
    pairs = (one.selectExpr("types", "hours", "explode(types) as a")
                .selectExpr("hours", "a", "explode(filter(types, t -> t.type < a.type)) as b"))
    total = lambda e: f"aggregate(hours, 0d, (s, h) -> s + {e})"
    pairs = pairs.selectExpr("a.type as activity_a", "b.type as activity_b", "double(size(hours)) as k", f"{total('a.n[h]')} as x", f"{total('b.n[h]')} as y",
                             f"{total('double(a.n[h]) * a.n[h]')} as xx", f"{total('double(b.n[h]) * b.n[h]')} as yy", f"{total('double(a.n[h]) * b.n[h]')} as xy")
    return pairs.selectExpr("activity_a", "activity_b", "try_divide(k * xy - x * y, sqrt(k * xx - x * x) * sqrt(k * yy - y * y)) as correlation")


# --- distributions -------------------------------------------------------------

def activity_frequency(df: DataFrame) -> DataFrame:
    """Counts per type, most frequent first (missing types dropped)."""
    return (df.filter(F.col("activity_type").isNotNull()).groupBy("activity_type").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("color", X.activity_color("activity_type"))
              .orderBy(F.col("n").desc(), F.col("activity_type")))


def hourly_distribution(df: DataFrame) -> DataFrame:
    """Counts per observed hour."""
    return df.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))


def category_counts(df: DataFrame) -> DataFrame:
    """Counts per category, NULL dropped, with the display colour."""
    return (df.filter(F.col("behavioral_category").isNotNull())
              .groupBy("behavioral_category").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("color", X.category_color("behavioral_category")))


def box_stats(df: DataFrame, by: str, value: str = "confidence") -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count of ``value`` per ``by``.

    Quartiles are exact (``exact_quantiles``).  The second pass joins the
    per-group bounds back; the bounds table has one row per group, broadcast
    when the key's domain is bounded (weekday, category).
    """
    # rows without a group are left out (as the reference's plots leave out NaN groups)
    df = df.filter(F.col(by).isNotNull())
    v = F.col(value)
    q = (exact_quantiles(df, by, value, [0.25, 0.5, 0.75])
         .select(by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")))
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    # one more pass over the rows: the per-group quartiles ride along with the
    # fences, so the result needs no join back to ``q``
    joined = df.select(by, value).join(_small(q, by), by)
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    return joined.groupBy(by).agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def confidence_density(df: DataFrame, by: str = "behavioral_category", value: str = "confidence",
                       points: int = 100, cut: float = 2.0) -> DataFrame:
    """Gaussian KDE of ``value`` per group on ``points`` grid points from
    min - cut*bw to max + cut*bw, Scott bandwidth ``n^(-1/5) * std``.

    Pass 1 takes the moments per group; pass 2 sums every row's kernel at its group's grid points, one column for
    each point, so rows never multiply; a group's points become rows at the end.
    """
    base = df.filter(F.col(by).isNotNull() & F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).cast("double").alias("v"))
    stats = base.groupBy("_by").agg(F.expr("count(v) as n"), F.expr("min(v) as vmin"), F.expr("max(v) as vmax"), F.expr("stddev_samp(v) as sd"))
    grid = (stats.selectExpr("_by as _group", "n", "pow(n, -0.2d) * sd as bw", "vmin", "vmax").where("bw > 0")
                 .selectExpr("_group", "n", "bw", f"vmin - {float(cut)}d * bw as lo", f"(vmax - vmin + {2 * float(cut)}d * bw) / {points - 1} as step"))
    near = base.join(_small(grid, by), F.expr("_by = _group"))
    near = near.selectExpr("_by", "n", "bw", "lo", "step", "(v - lo) / bw as z", "step / bw as w")
    sums = near.groupBy("_by").agg(F.expr("first(n) as n"), F.expr("first(bw) as bw"), F.expr("first(lo) as lo"), F.expr("first(step) as step"),
                                   *(F.expr(f"sum(exp(-0.5d * (z - {i} * w) * (z - {i} * w))) as s{i}") for i in range(points)))
    rows = sums.selectExpr("_by", "n", "bw", "lo", "step", f"posexplode(array({', '.join(f's{i}' for i in range(points))})) as (point, s)")
    return rows.selectExpr(f"_by as `{by}`", "point", "lo + step * point as x", f"s / (n * bw * {(2 * 3.141592653589793) ** 0.5!r}d) as density")


def density(df: DataFrame, by: str = "behavioral_category", points: int = 100) -> DataFrame:
    """KDE of confidence per group (see ``confidence_density``)."""
    return confidence_density(df, by, "confidence", points)


# --- gaps --------------------------------------------------------------------

def gaps_by_activity(df: DataFrame) -> DataFrame:
    """Minutes since the previous event of the same type (NULL for the first)."""
    o = ordered_index(df.select("id", "activity_type", "timestamp"), ["activity_type"], "timestamp", "id",
                      rn_col="_rn", prev_col="_prev")
    return o.select("id", "activity_type", minutes_between(F.col("timestamp"), F.col("_prev")).alias("gap_minutes"))


def gap_minutes(df: DataFrame) -> DataFrame:
    """Minutes since the previous event in global time order.

    A global ``lag`` would pull every row into one task; the ordered index
    works minute by minute and carries each minute's last time into the next.
    """
    o = ordered_index(df.select("id", "timestamp"), [], "timestamp", "id",
                      rn_col="_rn", prev_col="_prev")
    return o.select("id", minutes_between(F.col("timestamp"), F.col("_prev")).alias("gap_minutes"))


def _short(g: DataFrame, limit: float) -> DataFrame:
    return g.filter(F.col("gap_minutes").isNotNull() & (F.col("gap_minutes") < limit))


def gap_histogram(gaps: DataFrame, bins: int = 30, limit: float = 120.0) -> DataFrame:
    """``bins`` equal-width bins over [min, max] of the gaps below
    ``limit``; the maximum falls in the last bin; all bins present."""
    g = _short(gaps, limit)
    # the range is two numbers: one aggregate pass, fetched to the driver and
    # used as literals (scalar subqueries would be re-run per reference)
    r = g.agg(F.min("gap_minutes").alias("lo"), F.max("gap_minutes").alias("hi")).first()
    lo_v, hi_v = r["lo"], r["hi"]
    if lo_v is None:
        lo_v, hi_v = 0.0, 1.0
    elif lo_v == hi_v:
        lo_v, hi_v = lo_v - 0.5, hi_v + 0.5
    lo, hi = F.lit(float(lo_v)), F.lit(float(hi_v))
    width = (hi - lo) / bins
    idx = F.least(F.floor((F.col("gap_minutes") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    counted = g.select(idx.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    spine = g.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (spine.join(counted, "bin", "left")
                 .select("bin", (lo + width * F.col("bin")).alias("bin_start"),
                         (lo + width * (F.col("bin") + 1)).alias("bin_end"),
                         F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def gap_stats(gaps: DataFrame, limit: float = 120.0) -> DataFrame:
    """Mean and exact median of gaps below ``limit`` (one row, also without gaps)."""
    g = _short(gaps, limit).withColumn("_all", F.lit(0))
    med = exact_quantiles(g, "_all", "gap_minutes", [0.5]).select(F.col("q")[0].alias("median_gap"))
    stats = g.agg(F.count(F.lit(1)).alias("n"), F.avg("gap_minutes").alias("mean_gap"))
    return combine_rows(stats, med.agg(F.max("median_gap").alias("median_gap")))
