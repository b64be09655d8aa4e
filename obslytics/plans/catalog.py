"""Registered queries: one per operator of the inventory, each with its
DuckDB twin.  Every query reads the driver tables of one scale directory.

Results are normalised for comparison: integers as BIGINT, doubles rounded
to 6 places, dates and times as text.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obslytics import schemas as S
from obslytics.functions import features as X
from obslytics.operators import charts as C
from obslytics.operators import filters as FL
from obslytics.operators import patterns as P
from obslytics.operators import summary as SM
from obslytics.plans import ml_sql as MQ
from obslytics.plans import oracle as O
from obslytics.sources import adapter as A
from obslytics.sources import readers as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def normalize(df: DataFrame, places: int = 6, exact: tuple = ()) -> DataFrame:
    """``exact`` columns are quotients of integers computed the same way in
    both engines (bit-identical doubles); rounding them could only split ties."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif f.name in exact:
            pass
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), places)
        elif isinstance(t, T.DecimalType):
            c = F.round(c.cast("double"), places)
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = X.ts_text(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None, exact: tuple = ()):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: normalize(fn(spark, sf_dir), exact=exact)
        if sql is not None:
            SQL[name] = O.q(sql)
        return fn
    return deco


def acts(spark: SparkSession, sf: str) -> DataFrame:
    return A.load_activities(spark, sf)


def enriched(spark: SparkSession, sf: str, days_back: int = 30) -> DataFrame:
    return R.read_activities(spark, acts(spark, sf), A.AS_OF, days_back)


def r6(c: str) -> str:
    return f"round({c}, 6)"


# --- scans and projections -------------------------------------------------

@register("activities_enriched", f"""
SELECT id, {O.TS_TEXT.format(c='"timestamp"')} AS ts, activity_type, {r6('confidence')} AS confidence,
       description, session_id, video_source, hour, day_of_week, cast(date AS VARCHAR) AS date, week, month,
       is_weekend, time_period, confidence_category, behavioral_category
FROM enriched""")
def q_activities_enriched(spark, sf):
    """The analysis frame."""
    df = enriched(spark, sf)
    return df.select("id", X.ts_text("timestamp").alias("ts"), "activity_type", "confidence", "description",
                     "session_id", "video_source", "hour", "day_of_week", "date", "week", "month",
                     "is_weekend", "time_period", "confidence_category", "behavioral_category")


@register("confidence_band", f"""
SELECT id, confidence_category, {r6('confidence * 1.2')} AS scaled_confidence FROM enriched""")
def q_confidence_band(spark, sf):
    """P9/P24."""
    df = enriched(spark, sf)
    return df.select("id", "confidence_category", X.scaled("confidence", 1.2).alias("scaled_confidence"))


@register("category_lookup", f"""
SELECT a.id, t.behavioral_category, {O.ACT_COLOR.replace('activity_type', 'a.activity_type')} AS activity_color,
       {O.CAT_COLOR.replace('behavioral_category', 't.behavioral_category')} AS category_color,
       a.activity_type IN ({O.ALERTABLE}) AS alertable
FROM activities a LEFT JOIN taxonomy t USING (activity_type)""")
def q_category_lookup(spark, sf):
    """Broadcast lookup against the 15-row taxonomy."""
    df = X.add_category(acts(spark, sf), S.taxonomy(spark))
    return df.select("id", "behavioral_category", X.activity_color().alias("activity_color"),
                     X.category_color().alias("category_color"), X.is_alertable().alias("alertable"))


@register("display_fields", f"""
SELECT id, CASE WHEN position('_' IN activity_type) > 0
                THEN regexp_replace(activity_type, '^([^_]*)_', '\\1 ') ELSE activity_type END AS display_name,
       {O.fixed('confidence * 100', 1)} || '%' AS confidence_text,
       activity_type IN ({O.ALERTABLE}) AS alertable
FROM activities""")
def q_display_fields(spark, sf):
    """P17/P18/P20."""
    return SM.display_fields(acts(spark, sf))


@register("analysis_requests", f"""
SELECT id, activity_type,
       'Analyze this activity detection:' || chr(10) || 'Activity: ' || activity_type || chr(10) ||
       'Confidence: ' || {O.fixed('confidence', 4)} || chr(10) || 'Description: ' || description || chr(10) ||
       'Timestamp: ' || {O.ISO_TEXT.format(c='"timestamp"')} || chr(10) || chr(10) ||
       'Provide behavioral insights and recommendations.' AS prompt
FROM described WHERE activity_type IN ({O.ALERTABLE})""")
def q_analysis_requests(spark, sf):
    """Analysis request text for alertable detections."""
    return SM.analysis_requests(acts(spark, sf))


# --- filters -------------------------------------------------------------------

@register("analytics_filter", f"""
SELECT id, activity_type, {r6('confidence')} AS confidence FROM activities
WHERE "timestamp" >= TIMESTAMP '2024-01-10 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-20 00:00:00'
  AND activity_type IN ('sitting', 'walking', 'rocking', 'wandering', 'therapy_exercise')
  AND session_id = 'session_7' AND confidence >= 0.1""")
def q_analytics_filter(spark, sf):
    """Composable filter."""
    import datetime as dt
    df = FL.analytics_filter(acts(spark, sf), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20),
                             ["sitting", "walking", "rocking", "wandering", "therapy_exercise"],
                             "session_7", 0.1)
    return df.select("id", "activity_type", "confidence")


@register("confidence_filters", f"""
SELECT count(*) FILTER (WHERE confidence >= 0.7) AS at_least_70,
       count(*) FILTER (WHERE confidence > 0.6) AS stored_over_60,
       count(*) FILTER (WHERE confidence > 0.7) AS notify_over_70,
       count(*) FILTER (WHERE confidence > 0.8) AS over_80
FROM activities""")
def q_confidence_filters(spark, sf):
    """F4/F6/F7/F14 (counts of each filter's output)."""
    df = acts(spark, sf).select("confidence")
    n = F.count(F.lit(1))
    return SM.combine_rows(FL.min_confidence(df, 0.7).agg(n.alias("at_least_70")), FL.significant_detections(df).agg(n.alias("stored_over_60")),
                           FL.notify(df).agg(n.alias("notify_over_70")), FL.min_confidence(df, 0.8, strict=True).agg(n.alias("over_80")))


# --- summary (A1) ------------------------------------------------------------------

_S7 = """, s AS (SELECT * FROM activities WHERE "timestamp" >= TIMESTAMP '2024-01-24 00:00:00')"""


@register("summary", _S7 + """
SELECT (SELECT count(*) FROM s) AS total_activities,
       round(coalesce((SELECT avg(coalesce(confidence, 0)) FROM s), 0), 6) AS average_confidence,
       (SELECT activity_type FROM (SELECT activity_type, count(*) AS n FROM s GROUP BY 1)
        ORDER BY n DESC, activity_type LIMIT 1) AS most_common_activity""")
def q_summary(spark, sf):
    """A1 scalar part."""
    s = SM.summary(acts(spark, sf), A.AS_OF, days=7)
    return s.select("total_activities", "average_confidence", "most_common_activity")


@register("summary_by_type", _S7 + """
SELECT activity_type, count(*) AS n FROM s GROUP BY 1""")
def q_summary_by_type(spark, sf):
    """A1 per-type distribution."""
    return SM.summary_by_type(SM.summary(acts(spark, sf), A.AS_OF, days=7))


@register("summary_by_hour", _S7 + """
SELECT h.hour, count(s.id) AS n FROM range(24) h(hour) LEFT JOIN s ON hour(s."timestamp") = h.hour GROUP BY 1""")
def q_summary_by_hour(spark, sf):
    """A1/J3 dense 24-slot hour distribution."""
    return SM.summary_by_hour(SM.summary(acts(spark, sf), A.AS_OF, days=7))


@register("chart_summary", """
SELECT count(*) AS total_activities,
       cast(cast(min("timestamp") AS DATE) AS VARCHAR) || ' to ' || cast(cast(max("timestamp") AS DATE) AS VARCHAR)
         AS date_range,
       count(DISTINCT activity_type) AS unique_activity_types,
       round(avg(confidence), 6) AS avg_confidence,
       (SELECT activity_type FROM (SELECT activity_type, count(*) AS n FROM enriched GROUP BY 1)
        ORDER BY n DESC, activity_type LIMIT 1) AS most_common_activity,
       count(DISTINCT behavioral_category) AS behavioral_categories
FROM enriched""")
def q_chart_summary(spark, sf):
    """A23/S9."""
    return SM.chart_summary(enriched(spark, sf))


@register("analysis_report", f"""
, ins AS (
  SELECT count(*) AS total_patterns,
         (SELECT activity_type FROM patterns ORDER BY frequency DESC, activity_type LIMIT 1)
           AS most_frequent_activity,
         round(avg(avg_confidence), 3) AS overall_confidence,
         count(DISTINCT coalesce(behavioral_category, chr(0))) AS behavioral_diversity,
         count(*) FILTER (WHERE behavioral_category = 'Concerning') AS concerning_behaviors
  FROM patterns)
SELECT (SELECT count(*) FROM enriched) AS total_activities,
       (SELECT {O.PY_TEXT.format(c='min("timestamp")')} || ' to ' || {O.PY_TEXT.format(c='max("timestamp")')}
        FROM enriched) AS date_range,
       (SELECT count(DISTINCT activity_type) FROM enriched) AS unique_activity_types,
       ins.*
FROM ins""")
def q_analysis_report(spark, sf):
    """Scalar fields of the analysis report."""
    return P.report_flat(enriched(spark, sf))


@register("distinct_types", "SELECT count(DISTINCT activity_type) AS unique_activity_types FROM enriched")
def q_distinct_types(spark, sf):
    """A35."""
    return SM.distinct_types(enriched(spark, sf))


@register("total_confidence", "SELECT round(sum(confidence), 6) AS total_confidence FROM enriched")
def q_total_confidence(spark, sf):
    """A34."""
    return SM.total_confidence(enriched(spark, sf))


@register("frequent_types", """
SELECT activity_type, count(*) AS count, round(avg(confidence), 6) AS avg_confidence
FROM enriched GROUP BY 1 HAVING count(*) > 5""")
def q_frequent_types(spark, sf):
    """A32."""
    return SM.frequent_types(enriched(spark, sf), 5)


@register("confidence_by_hour", """
SELECT h.hour, count(e.confidence) AS n, round(sum(e.confidence), 6) AS conf_sum,
       round(min(e.confidence), 6) AS conf_min, round(max(e.confidence), 6) AS conf_max
FROM range(24) h(hour) LEFT JOIN enriched e ON e.hour = h.hour GROUP BY 1""")
def q_confidence_by_hour(spark, sf):
    """A33/J3."""
    return SM.confidence_by_hour(enriched(spark, sf))


# --- patterns and insights ----------------------------------------------------------

@register("patterns", """
SELECT p.activity_type, p.frequency, round(p.avg_confidence, 6) AS avg_confidence,
       round(p.duration_minutes, 6) AS duration_minutes, h.time_of_day, p.behavioral_category
FROM patterns p JOIN pattern_hours h USING (activity_type)""")
def q_patterns(spark, sf):
    """A2/A3/W6."""
    return P.patterns(enriched(spark, sf))


@register("top_patterns", """
SELECT activity_type AS activity, frequency, round(avg_confidence, 3) AS confidence, behavioral_category AS category
FROM patterns ORDER BY frequency DESC, activity_type LIMIT 5""")
def q_top_patterns(spark, sf):
    """L5/P23."""
    return P.top_patterns(P.patterns(enriched(spark, sf)), 5)


@register("pattern_progress", """
SELECT row_number() OVER w - 1 AS index, activity_type,
       round(row_number() OVER w / count(*) OVER () * 100, 2) AS percentage_complete
FROM patterns WINDOW w AS (ORDER BY frequency DESC, activity_type)""")
def q_pattern_progress(spark, sf):
    """W4."""
    return P.pattern_progress(P.patterns(enriched(spark, sf)))


@register("pattern_progress_top3", """
, t AS (SELECT * FROM patterns ORDER BY frequency DESC, activity_type LIMIT 3)
SELECT row_number() OVER w - 1 AS index, activity_type,
       round(row_number() OVER w / count(*) OVER () * 100, 2) AS percentage_complete
FROM t WINDOW w AS (ORDER BY frequency DESC, activity_type)""")
def q_pattern_progress_top3(spark, sf):
    """Progress over the first three patterns."""
    return P.pattern_progress(P.patterns(enriched(spark, sf)), 3)


@register("insights", """
SELECT behavioral_category AS category, cast(sum(frequency) AS BIGINT) AS total_occurrences,
       round(avg(avg_confidence), 3) AS average_confidence, count(*) AS activity_count,
       array_to_string(list_slice(list(activity_type ORDER BY frequency DESC, activity_type), 1, 2), ', ')
         AS dominant_activities,
       CASE WHEN behavioral_category = 'Concerning' THEN
              CASE WHEN sum(frequency) > 5 AND avg(avg_confidence) > 0.8 THEN 'High'
                   WHEN sum(frequency) > 2 AND avg(avg_confidence) > 0.7 THEN 'Medium' ELSE 'Low' END
            WHEN behavioral_category = 'Stimming' THEN CASE WHEN sum(frequency) > 10 THEN 'Medium' ELSE 'Low' END
            ELSE 'Low' END AS risk_level
FROM patterns GROUP BY behavioral_category""")
def q_insights(spark, sf):
    """A5/A7/W5."""
    return P.insights(P.patterns(enriched(spark, sf)))


@register("insight_summary", """
SELECT count(*) AS total_patterns,
       (SELECT activity_type FROM patterns ORDER BY frequency DESC, activity_type LIMIT 1) AS most_frequent_activity,
       round(avg(avg_confidence), 3) AS overall_confidence,
       count(DISTINCT coalesce(behavioral_category, chr(0))) AS behavioral_diversity,
       count(*) FILTER (WHERE behavioral_category = 'Concerning') AS concerning_behaviors
FROM patterns""")
def q_insight_summary(spark, sf):
    """A6."""
    return P.insight_summary(P.patterns(enriched(spark, sf)))


def _rec_sql() -> str:
    r = S.RECOMMENDATIONS
    conds = ["concerning > 2", "concerning > 0", "stimming > 0", "stimming > 0", "therapeutic > 0",
             "active > 0 AND calm > 0"]
    parts = " UNION ALL ".join(f"SELECT {i} AS k, '{t}' AS recommendation FROM flags WHERE {c}"
                               for i, (t, c) in enumerate(zip(r, conds)))
    return f"""
, flags AS (
  SELECT count(*) FILTER (WHERE behavioral_category = 'Concerning') AS concerning,
         count(*) FILTER (WHERE behavioral_category = 'Stimming') AS stimming,
         count(*) FILTER (WHERE behavioral_category = 'Therapeutic') AS therapeutic,
         count(*) FILTER (WHERE behavioral_category = 'Active') AS active,
         count(*) FILTER (WHERE behavioral_category = 'Calm') AS calm
  FROM patterns),
recs AS ({parts})
SELECT row_number() OVER (ORDER BY k) - 1 AS position, recommendation FROM recs"""


@register("recommendations", _rec_sql())
def q_recommendations(spark, sf):
    """A8."""
    return P.recommendations(P.patterns(enriched(spark, sf)))


@register("concerning_alert", """
, c AS (SELECT count(*) FILTER (WHERE behavioral_category = 'Concerning') AS n FROM patterns)
SELECT 'Concerning Activity Alert' AS subject,
       'Detected ' || cast(n AS VARCHAR) || ' concerning behavioral patterns' AS message,
       n AS concerning_behaviors
FROM c WHERE n > 1""")
def q_concerning_alert(spark, sf):
    """A31 (threshold 1; the reference's 5 cannot fire with 4 Concerning types)."""
    return P.concerning_alert(P.patterns(enriched(spark, sf)), threshold=1)


# --- timeline panel ------------------------------------------------------------------

@register("by_date", """
SELECT cast(date AS VARCHAR) AS date, count(activity_type) AS activity_type, round(avg(confidence), 6) AS confidence,
       (SELECT behavioral_category FROM enriched e2 WHERE e2.date = e.date AND behavioral_category IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS behavioral_category
FROM enriched e GROUP BY date""")
def q_by_date(spark, sf):
    """A9."""
    return C.by_date(enriched(spark, sf))


@register("daily_counts", "SELECT cast(date AS VARCHAR) AS date, count(*) AS n FROM enriched GROUP BY 1")
def q_daily_counts(spark, sf):
    """A10."""
    return C.daily_counts(enriched(spark, sf))


@register("daily_category", """
SELECT cast(date AS VARCHAR) AS date,
       count(*) FILTER (WHERE behavioral_category = 'Calm') AS Calm,
       count(*) FILTER (WHERE behavioral_category = 'Active') AS Active,
       count(*) FILTER (WHERE behavioral_category = 'Stimming') AS Stimming,
       count(*) FILTER (WHERE behavioral_category = 'Concerning') AS Concerning,
       count(*) FILTER (WHERE behavioral_category = 'Therapeutic') AS Therapeutic
FROM enriched WHERE behavioral_category IS NOT NULL GROUP BY 1""")
def q_daily_category(spark, sf):
    """A11."""
    return C.daily_category(enriched(spark, sf))


@register("daily_confidence", """
SELECT cast(date AS VARCHAR) AS date, round(avg(confidence), 6) AS mean,
       round(coalesce(stddev_samp(confidence), 0), 6) AS std
FROM enriched GROUP BY 1""")
def q_daily_confidence(spark, sf):
    """A12."""
    return C.daily_confidence(enriched(spark, sf))


@register("daily_activity", """
SELECT cast(date AS VARCHAR) AS date, count(*) AS activity_count, round(avg(confidence), 6) AS avg_confidence
FROM enriched GROUP BY 1""")
def q_daily_activity(spark, sf):
    """A19."""
    return C.daily_activity(enriched(spark, sf))


@register("daily_trend", """
, d AS (SELECT date, count(*) AS n FROM enriched GROUP BY 1),
di AS (SELECT n, row_number() OVER (ORDER BY date) - 1 AS day_index FROM d)
SELECT round(regr_slope(n, day_index), 6) AS slope, round(regr_intercept(n, day_index), 6) AS intercept,
       count(*) AS days FROM di""")
def q_daily_trend(spark, sf):
    """M18/W10."""
    return C.daily_trend(enriched(spark, sf))


@register("confidence_trend", """
SELECT round(regr_slope(confidence, hour), 6) AS slope, round(regr_intercept(confidence, hour), 6) AS intercept
FROM enriched""")
def q_confidence_trend(spark, sf):
    """M18."""
    return C.confidence_trend(enriched(spark, sf))


# --- heatmaps --------------------------------------------------------------------

def _count_cols(col: str, values, alias=lambda v: v, quote=True) -> str:
    out = []
    for v in values:
        lit = f"'{v}'" if quote else str(v)
        out.append(f"count(*) FILTER (WHERE {col} = {lit}) AS \"{alias(v)}\"")
    return ", ".join(out)


@register("hour_by_weekday", f"""
SELECT hour, {_count_cols('day_of_week', S.DAY_ORDER)} FROM enriched GROUP BY hour""")
def q_hour_by_weekday(spark, sf):
    """A13."""
    return C.hour_by_weekday(enriched(spark, sf))


@register("activity_by_hour", f"""
SELECT activity_type, {_count_cols('hour', range(24), lambda h: f'h{h}', quote=False)}
FROM enriched WHERE activity_type IS NOT NULL GROUP BY activity_type""")
def q_activity_by_hour(spark, sf):
    """A14."""
    return C.activity_by_hour(enriched(spark, sf))


@register("category_by_period", f"""
SELECT behavioral_category, {_count_cols('time_period', S.TIME_PERIODS)}
FROM enriched WHERE time_period IS NOT NULL AND behavioral_category IS NOT NULL GROUP BY 1""")
def q_category_by_period(spark, sf):
    """A15."""
    return C.category_by_period(enriched(spark, sf))


@register("confidence_matrix", """
SELECT activity_type, behavioral_category, round(avg(confidence), 6) AS avg_confidence
FROM enriched WHERE behavioral_category IS NOT NULL AND activity_type IS NOT NULL GROUP BY 1, 2""")
def q_confidence_matrix(spark, sf):
    """A16."""
    return C.confidence_matrix(enriched(spark, sf))


@register("hour_by_activity", f"""
SELECT hour, {_count_cols('activity_type', S.ACTIVITY_TYPES)} FROM enriched GROUP BY hour""")
def q_hour_by_activity(spark, sf):
    """A21."""
    return C.hour_by_activity(enriched(spark, sf))


_DAYS_VALUES = ", ".join(f"({i}, '{d}')" for i, d in enumerate(S.DAY_ORDER))


@register("weekday_by_hour", f"""
, days(day_index, day_of_week) AS (VALUES {_DAYS_VALUES})
SELECT cast(d.day_index AS BIGINT) AS day_index, d.day_of_week,
       {', '.join(f'count(e.hour) FILTER (WHERE e.hour = {h}) AS h{h}' for h in range(24))}
FROM days d LEFT JOIN enriched e ON e.day_of_week = d.day_of_week GROUP BY 1, 2""")
def q_weekday_by_hour(spark, sf):
    """A22/J3."""
    return C.weekday_by_hour(enriched(spark, sf))


@register("activity_correlation", """
, c AS (SELECT activity_type, hour, count(*) AS n FROM enriched WHERE activity_type IS NOT NULL GROUP BY 1, 2),
hrs AS (SELECT DISTINCT hour FROM c),
tys AS (SELECT DISTINCT activity_type FROM c),
dense AS (SELECT t.activity_type, h.hour, coalesce(c.n, 0) AS n
          FROM tys t CROSS JOIN hrs h LEFT JOIN c ON c.activity_type = t.activity_type AND c.hour = h.hour)
SELECT a.activity_type AS activity_a, b.activity_type AS activity_b,
       round(CASE WHEN stddev_pop(a.n) * stddev_pop(b.n) = 0 THEN NULL
                  ELSE covar_pop(a.n, b.n) / (stddev_pop(a.n) * stddev_pop(b.n)) END, 6) AS correlation
FROM dense a JOIN dense b ON a.hour = b.hour AND a.activity_type > b.activity_type
GROUP BY 1, 2""")
def q_activity_correlation(spark, sf):
    """M19/J3/J4."""
    return C.activity_correlation(enriched(spark, sf))


# --- distributions -------------------------------------------------------------

@register("activity_frequency", f"""
SELECT activity_type, count(*) AS n, {O.ACT_COLOR} AS color FROM enriched WHERE activity_type IS NOT NULL GROUP BY 1""")
def q_activity_frequency(spark, sf):
    """A17/P11."""
    return C.activity_frequency(enriched(spark, sf))


@register("hourly_distribution", "SELECT hour, count(*) AS n FROM enriched GROUP BY 1")
def q_hourly_distribution(spark, sf):
    """A18."""
    return C.hourly_distribution(enriched(spark, sf))


@register("category_counts", f"""
SELECT behavioral_category, count(*) AS n, {O.CAT_COLOR} AS color
FROM enriched WHERE behavioral_category IS NOT NULL GROUP BY 1""")
def q_category_counts(spark, sf):
    """A20/P11."""
    return C.category_counts(enriched(spark, sf))


def _box_sql(by: str) -> str:
    return f"""
, q AS (SELECT {by}, count(confidence) AS n, quantile_cont(confidence, 0.25) AS q1,
               quantile_cont(confidence, 0.5) AS median, quantile_cont(confidence, 0.75) AS q3
        FROM enriched WHERE {by} IS NOT NULL GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.{by}, f.n, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       round(min(e.confidence) FILTER (WHERE e.confidence >= f.lo AND e.confidence <= f.hi), 6) AS whisker_low,
       round(max(e.confidence) FILTER (WHERE e.confidence >= f.lo AND e.confidence <= f.hi), 6) AS whisker_high,
       count(*) FILTER (WHERE e.confidence < f.lo OR e.confidence > f.hi) AS outliers
FROM f JOIN enriched e ON e.{by} = f.{by}
GROUP BY f.{by}, f.n, f.q1, f.median, f.q3"""


@register("box_by_weekday", _box_sql("day_of_week"))
def q_box_by_weekday(spark, sf):
    """A27 by day of week."""
    return C.box_stats(enriched(spark, sf), "day_of_week")


@register("box_by_category", _box_sql("behavioral_category"))
def q_box_by_category(spark, sf):
    """A27 by category."""
    df = enriched(spark, sf).filter(F.col("behavioral_category").isNotNull())
    return C.box_stats(df, "behavioral_category")


@register("confidence_density", """
, st AS (SELECT behavioral_category, count(*) AS n, min(confidence) AS vmin, max(confidence) AS vmax,
                pow(count(*), -0.2) * stddev_samp(confidence) AS bw
         FROM enriched WHERE behavioral_category IS NOT NULL GROUP BY 1),
g AS (SELECT behavioral_category, n, bw, i AS point,
             (vmin - 2 * bw) + ((vmax + 2 * bw) - (vmin - 2 * bw)) * i / 99 AS x
      FROM st, range(100) r(i) WHERE bw > 0),
v AS (SELECT behavioral_category, confidence, count(*) AS m FROM enriched
      WHERE behavioral_category IS NOT NULL GROUP BY 1, 2)
SELECT g.behavioral_category, g.point, round(g.x, 6) AS x,
       round(sum(v.m * exp(-0.5 * ((g.x - v.confidence) / g.bw) * ((g.x - v.confidence) / g.bw)))
             / (g.n * g.bw * sqrt(2 * pi())), 6) AS density
FROM g JOIN v USING (behavioral_category)
GROUP BY g.behavioral_category, g.point, g.x, g.n, g.bw""")
def q_confidence_density(spark, sf):
    """A28."""
    return C.confidence_density(enriched(spark, sf))


# --- gaps --------------------------------------------------------------------------

_GAPS = """, gaps AS (
  SELECT id, (epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (ORDER BY "timestamp", id))) / 60000000.0::DOUBLE
           AS gap_minutes
  FROM enriched),
short AS (SELECT gap_minutes FROM gaps WHERE gap_minutes IS NOT NULL AND gap_minutes < 120)"""


@register("gaps_by_activity", """
SELECT id, activity_type,
       (epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY activity_type
              ORDER BY "timestamp", id))) / 60000000.0::DOUBLE AS gap_minutes
FROM enriched""", exact=("gap_minutes",))
def q_gaps_by_activity(spark, sf):
    """W1."""
    return C.gaps_by_activity(enriched(spark, sf))


@register("gap_minutes", _GAPS + """
SELECT id, gap_minutes FROM gaps""", exact=("gap_minutes",))
def q_gap_minutes(spark, sf):
    """W2."""
    return C.gap_minutes(enriched(spark, sf))


@register("gap_histogram", _GAPS + """,
rng AS (SELECT CASE WHEN min(gap_minutes) = max(gap_minutes) THEN min(gap_minutes) - 0.5 ELSE min(gap_minutes) END AS lo,
               CASE WHEN min(gap_minutes) = max(gap_minutes) THEN max(gap_minutes) + 0.5 ELSE max(gap_minutes) END AS hi
        FROM short),
b AS (SELECT cast(least(floor((gap_minutes - lo) / (hi - lo) * 30), 29) AS BIGINT) AS bin FROM short, rng)
SELECT r.bin, round(lo + (hi - lo) / 30 * r.bin, 6) AS bin_start, round(lo + (hi - lo) / 30 * (r.bin + 1), 6) AS bin_end,
       (SELECT count(*) FROM b WHERE b.bin = r.bin) AS n
FROM range(30) r(bin), rng""")
def q_gap_histogram(spark, sf):
    """A29/F10."""
    return C.gap_histogram(C.gap_minutes(enriched(spark, sf)))


@register("gap_stats", _GAPS + """
SELECT count(*) AS n, round(avg(gap_minutes), 6) AS mean_gap, round(median(gap_minutes), 6) AS median_gap
FROM short""")
def q_gap_stats(spark, sf):
    """A30."""
    return C.gap_stats(C.gap_minutes(enriched(spark, sf)))


# --- ordered lists ------------------------------------------------------------------

@register("recent", f"""
SELECT id, {O.TS_TEXT.format(c='"timestamp"')} AS ts, activity_type, round(confidence, 6) AS confidence
FROM activities ORDER BY "timestamp" DESC, id DESC LIMIT 100""")
def q_recent(spark, sf):
    """L1."""
    df = SM.recent(acts(spark, sf), 100)
    return df.select("id", X.ts_text("timestamp").alias("ts"), "activity_type", "confidence")


@register("timeline", f"""
SELECT {O.ISO_TEXT.format(c='"timestamp"')} AS "timestamp", activity_type, round(confidence, 6) AS confidence,
       description
FROM described WHERE "timestamp" >= TIMESTAMP '2024-01-30 00:00:00'
ORDER BY "timestamp", id LIMIT 1000""")
def q_timeline(spark, sf):
    """L2/P16."""
    return SM.timeline(acts(spark, sf), A.AS_OF, hours=24, cap=1000)


@register("alerts", f"""
, top AS (SELECT * FROM activities WHERE activity_type IN ({O.ALERTABLE})
          AND "timestamp" >= TIMESTAMP '2024-01-30 23:00:00' ORDER BY "timestamp" DESC, id DESC LIMIT 10)
SELECT id, {O.ISO_TEXT.format(c='"timestamp"')} AS "timestamp", activity_type, round(confidence, 6) AS confidence,
       session_id, count(*) OVER () AS count
FROM top""")
def q_alerts(spark, sf):
    """L3/F3/F2."""
    return SM.alerts(acts(spark, sf), A.AS_OF, hours=1, cap=10)


@register("bounded_sample", """
SELECT id, activity_type FROM activities ORDER BY md5('42' || id) LIMIT 1000""")
def q_bounded_sample(spark, sf):
    """L8."""
    return SM.bounded_sample(acts(spark, sf), 1000, 42).select("id", "activity_type")


# --- labels ---------------------------------------------------------------------------

@register("recent_labels", f"""
SELECT id, {O.TS_TEXT.format(c='"timestamp"')} AS ts, len(labels) AS n_labels, annotator_id
FROM labeling ORDER BY "timestamp" DESC, id LIMIT 50""")
def q_recent_labels(spark, sf):
    """S3/L4."""
    df = R.read_labels(A.load_labeling(spark, sf), 50)
    return df.select("id", X.ts_text("timestamp").alias("ts"), X.label_count("labels").alias("n_labels"),
                     "annotator_id")


@register("label_stats", """
SELECT id, len(labels) AS n_labels, len(labels) > 0 AS has_label,
       list_contains(labels, 'toxic') AS has_toxic, coalesce(labels[1], '') AS first_label
FROM labeling""")
def q_label_stats(spark, sf):
    """P19."""
    lab = A.load_labeling(spark, sf)
    return lab.select("id", X.label_count("labels").alias("n_labels"), X.has_label("labels").alias("has_label"),
                      X.has_label("labels", "toxic").alias("has_toxic"),
                      F.coalesce(F.try_element_at("labels", F.lit(1))["activity"], F.lit("")).alias("first_label"))


@register("first_label_records", f"""
SELECT id, {O.TS_TEXT.format(c='"timestamp"')} AS ts, len(labels) AS n_labels
FROM labeling ORDER BY "timestamp" DESC, id LIMIT 8""")
def q_first_label_records(spark, sf):
    """The newest eight label records with all their labels counted."""
    df = SM.first_label_records(A.load_labeling(spark, sf), 8)
    return df.select("id", X.ts_text("timestamp").alias("ts"), "n_labels")


# --- metrics ------------------------------------------------------------------------

def metrics(spark, sf):
    return A.load_metrics(spark, sf)


def _metric_alert_sql() -> str:
    parts = []
    for kind, sev, col, thr, fmt in S.METRIC_ALERT_RULES:
        prefix, suffix = fmt.split("%.1f")
        suffix = suffix.replace("%%", "%")
        parts.append(f"""SELECT {O.TS_TEXT.format(c='"timestamp"')} AS "timestamp", host, '{kind}' AS type,
       '{sev}' AS severity, '{prefix}' || {O.fixed(col, 1)} || '{suffix}' AS message, round({col}, 6) AS value
FROM metrics WHERE {col} > {thr}""")
    return "\n" + "\nUNION ALL\n".join(parts)


@register("metric_alerts", _metric_alert_sql())
def q_metric_alerts(spark, sf):
    """F9/P21/T5 batch form."""
    from obslytics.operators import metrics as MT
    return MT.metric_alerts(metrics(spark, sf))


@register("alert_details", """
, a AS (""" + _metric_alert_sql() + """)
SELECT "timestamp", host, type,
       'type: ' || type || chr(10) || 'severity: ' || severity || chr(10) || 'message: ' || message || chr(10) ||
       'value: ' || cast(value AS VARCHAR) AS details
FROM a""")
def q_alert_details(spark, sf):
    """Alert details text from key/value pairs."""
    from obslytics.operators import metrics as MT
    return MT.alert_details(MT.metric_alerts(metrics(spark, sf))).select("timestamp", "host", "type", "details")


@register("metrics_summary", """
, m AS (SELECT * FROM metrics WHERE "timestamp" >= TIMESTAMP '2024-01-30 00:00:00')
SELECT cast(24 AS BIGINT) AS period_hours, count(*) AS sample_count,
       round(avg(cpu_percent), 6) AS cpu_avg, round(max(cpu_percent), 6) AS cpu_max, round(min(cpu_percent), 6) AS cpu_min,
       round(avg(memory_percent), 6) AS memory_avg, round(max(memory_percent), 6) AS memory_max,
       round(min(memory_percent), 6) AS memory_min,
       round(arg_max(disk_usage_percent, "timestamp"), 6) AS disk_current,
       round(avg(process_count), 6) AS process_avg,
       cast(arg_max(process_count, "timestamp") AS BIGINT) AS process_current
FROM m""")
def q_metrics_summary(spark, sf):
    """A24/W7."""
    from obslytics.operators import metrics as MT
    return MT.metrics_summary(metrics(spark, sf), A.AS_OF, 24)


@register("latest_metrics", f"""
SELECT {O.TS_TEXT.format(c='"timestamp"')} AS "timestamp", host, round(cpu_percent, 6) AS cpu_percent
FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY "timestamp" DESC) AS rn FROM metrics)
WHERE rn <= 1000""")
def q_latest_metrics(spark, sf):
    """W8/T7 batch form."""
    from obslytics.operators import metrics as MT
    return MT.keep_latest(metrics(spark, sf), 1000).select("timestamp", "host", "cpu_percent")


@register("metric_health", """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, "timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS window_start,
       strftime(time_bucket(INTERVAL 1 HOUR, "timestamp") + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS window_end,
       host, count(*) AS samples, round(avg(cpu_percent), 6) AS cpu_avg, round(max(cpu_percent), 6) AS cpu_max,
       round(avg(memory_percent), 6) AS memory_avg, count(*) FILTER (WHERE cpu_percent > 80) AS cpu_alerts
FROM metrics GROUP BY 1, 2, 3""")
def q_metric_health(spark, sf):
    """T6 batch form: hourly health per host."""
    from obslytics.operators import metrics as MT
    return MT.health_windows(metrics(spark, sf), "1 hour")


# --- jobs ---------------------------------------------------------------------------

@register("table_counts", """
SELECT (SELECT count(*) FROM activities) AS total_activities, (SELECT count(*) FROM labeling) AS total_labeling_data""")
def q_table_counts(spark, sf):
    """A25."""
    return SM.table_counts(activities=acts(spark, sf), labeling_data=A.load_labeling(spark, sf))


@register("retention_stats", """
SELECT (SELECT count(*) FROM activities WHERE "timestamp" < TIMESTAMP '2024-01-17 00:00:00') AS activities_deleted,
       (SELECT count(*) FROM labeling WHERE "timestamp" < TIMESTAMP '2024-01-17 00:00:00') AS labeling_deleted,
       '2024-01-17T00:00:00' AS cutoff_date""")
def q_retention_stats(spark, sf):
    """S11/F11/A36 with days_to_keep = 14."""
    from obslytics.operators import jobs as J
    return J.retention_stats({"activities": acts(spark, sf), "labeling": A.load_labeling(spark, sf)}, A.AS_OF, 14)


# --- frames, detections, sequences ------------------------------------------------------------

_BOX_RULE = """CASE WHEN width * height > 10000 THEN 'standing' WHEN width * height > 5000 THEN 'sitting'
            ELSE 'focused_activity' END AS activity_type,
       CASE WHEN width * height > 10000 THEN 0.75::DOUBLE WHEN width * height > 5000 THEN 0.70::DOUBLE
            ELSE 0.65::DOUBLE END AS confidence"""


@register("box_activity", f"""
, d AS (SELECT upload_id, frame_index, {_BOX_RULE} FROM frames)
SELECT upload_id, frame_index, activity_type, round(confidence, 6) AS confidence,
       'Detected ' || activity_type || ' with ' || {O.fixed('confidence', 2)} || ' confidence' AS description
FROM d WHERE confidence > 0.6""")
def q_box_activity(spark, sf):
    """Live path, every frame."""
    from obslytics.operators import sequences as SQ
    d = FL.significant_detections(SQ.detections(A.load_frames(spark, sf)))
    return d.select("upload_id", "frame_index", "activity_type", "confidence", "description")


@register("sampled_frames", """
SELECT upload_id, frame_index FROM frames
WHERE frame_index % 2 = 1 AND (frame_index // 2) % 10 = 0 AND frame_index // 2 < 100""")
def q_sampled_frames(spark, sf):
    """F8."""
    return FL.sample_frames(A.load_frames(spark, sf)).select("upload_id", "frame_index")


@register("upload_detections", f"""
, d AS (SELECT upload_id, frame_index, {_BOX_RULE} FROM frames
        WHERE frame_index % 2 = 1 AND (frame_index // 2) % 10 = 0 AND frame_index // 2 < 100)
SELECT upload_id, frame_index, activity_type, round(confidence, 6) AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY frame_index) AS rn FROM d WHERE confidence > 0.6)
WHERE rn <= 10""")
def q_upload_detections(spark, sf):
    """Upload path."""
    from obslytics.operators import sequences as SQ
    d = SQ.upload_detections(A.load_frames(spark, sf), 10)
    return d.select("upload_id", "frame_index", "activity_type", "confidence")


_SEQ_ROWS = """, seqrows AS (
  SELECT session_id, row_number() OVER w AS rn, activity_type AS label, confidence,
         cast(hour("timestamp") AS DOUBLE) AS hour, cast(k AS DOUBLE) AS k, cast(isodow("timestamp") - 1 AS DOUBLE) AS weekday,
         coalesce((epoch_us("timestamp") - epoch_us(lag("timestamp") OVER w)) / 60000000.0::DOUBLE, 0.0) AS gap_minutes
  FROM activities WINDOW w AS (PARTITION BY session_id ORDER BY "timestamp", id))"""


@register("sequences", _SEQ_ROWS + """
SELECT session_id, (rn - 1) // 10 AS seq_index, (rn - 1) % 10 AS step_index, label, round(confidence, 6) AS confidence,
       hour, k, weekday, gap_minutes
FROM (SELECT *, count(*) OVER (PARTITION BY session_id, (rn - 1) // 10) AS n FROM seqrows) WHERE n = 10""",
          exact=("gap_minutes",))
def q_sequences(spark, sf):
    """Complete 10-step sequences per session, long form."""
    from obslytics.operators import sequences as SQ
    return SQ.sequences(acts_with_k(spark, sf), 10)


def acts_with_k(spark, sf):
    return A.activities_from_events(A.table(spark, sf, "events"), keep_k=True)


@register("statistical_features", """
SELECT session_id, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std,
       round(min(confidence), 6) AS min, round(max(confidence), 6) AS max,
       round(quantile_cont(confidence, 0.5), 6) AS median, round(quantile_cont(confidence, 0.25), 6) AS p25,
       round(quantile_cont(confidence, 0.75), 6) AS p75, round(var_pop(confidence), 6) AS var,
       round(max(confidence) - min(confidence), 6) AS ptp, count(confidence) AS length
FROM activities GROUP BY 1""")
def q_statistical_features(spark, sf):
    """M15."""
    from obslytics.operators import sequences as SQ
    return SQ.statistical_features(acts(spark, sf), "session_id", "confidence")


@register("temporal_features", """
, g AS (SELECT session_id, "timestamp",
               (epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY session_id ORDER BY "timestamp", id)))
                 / 1000000.0::DOUBLE AS gap
        FROM activities)
SELECT session_id, round(avg(hour("timestamp")), 6) AS hour_mean, round(stddev_samp(hour("timestamp")), 6) AS hour_std,
       round(avg(isodow("timestamp") - 1), 6) AS weekday_mean, count(DISTINCT cast("timestamp" AS DATE)) AS distinct_days,
       coalesce((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / (count(*) - 1) / 1000000.0::DOUBLE, 0.0)
         AS gap_mean,
       round(coalesce(stddev_samp(gap), 0), 6) AS gap_std
FROM g GROUP BY 1""", exact=("gap_mean",))
def q_temporal_features(spark, sf):
    """M16/W3."""
    from obslytics.operators import sequences as SQ
    return SQ.temporal_features(acts(spark, sf), "session_id")


# --- ML evaluation (SQL-checkable parts) ------------------------------------------------------

def embeddings(spark, sf):
    return A.table(spark, sf, "embeddings")


def rule_predictions(spark, sf):
    """Fixed-rule predictions on ``embeddings`` for metric checks: two
    'models' whose predictions derive from the row key."""
    e = embeddings(spark, sf).select("vec_id", "label")
    a = e.select(F.lit("mod10").alias("model_name"), "vec_id", "label", (F.col("vec_id") % 10).cast("int").alias("prediction"))
    b = e.select(F.lit("mixed").alias("model_name"), "vec_id", "label",
                 F.when(F.col("vec_id") % 3 == 0, F.col("label")).otherwise((F.col("vec_id") * 7) % 10).cast("int")
                 .alias("prediction"))
    return a.unionByName(b)


_PRED_SQL = """, preds AS (
  SELECT 'mod10' AS model_name, vec_id, label, cast(vec_id % 10 AS INTEGER) AS prediction FROM embeddings
  UNION ALL
  SELECT 'mixed', vec_id, label, cast(CASE WHEN vec_id % 3 = 0 THEN label ELSE (vec_id * 7) % 10 END AS INTEGER)
  FROM embeddings),
cls AS (SELECT model_name, label AS c FROM preds UNION SELECT model_name, prediction FROM preds),
per AS (
  SELECT cls.model_name, cls.c,
         (SELECT count(*) FROM preds p WHERE p.model_name = cls.model_name AND p.label = cls.c AND p.prediction = cls.c) AS tp,
         (SELECT count(*) FROM preds p WHERE p.model_name = cls.model_name AND p.label = cls.c) AS support,
         (SELECT count(*) FROM preds p WHERE p.model_name = cls.model_name AND p.prediction = cls.c) AS predicted
  FROM cls),
per2 AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
                   CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM per),
per3 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
         FROM per2)"""


@register("classification_report", _PRED_SQL + """
SELECT model_name, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro,
       round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
       round(sum(precision * support) / sum(support), 6) AS precision_weighted,
       round(sum(recall * support) / sum(support), 6) AS recall_weighted,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted, cast(sum(support) AS BIGINT) AS support
FROM per3 GROUP BY model_name""")
def q_classification_report(spark, sf):
    """M12."""
    from obslytics.operators import ml as ML
    return ML.classification_report(rule_predictions(spark, sf), by=["model_name"])


@register("compare_models", _PRED_SQL + """
SELECT model_name, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro,
       round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted
FROM per3 GROUP BY model_name""")
def q_compare_models(spark, sf):
    """M14."""
    from obslytics.operators import ml as ML
    return ML.compare_models(rule_predictions(spark, sf))


@register("confusion_matrix", f"""
SELECT cast(label AS BIGINT) AS label, {', '.join(f'count(*) FILTER (WHERE vec_id % 10 = {c}) AS p_{c}' for c in range(10))}
FROM embeddings GROUP BY label""")
def q_confusion_matrix(spark, sf):
    """M13."""
    from obslytics.operators import ml as ML
    p = rule_predictions(spark, sf).filter(F.col("model_name") == "mod10")
    return ML.confusion_matrix(p, list(range(10)))


@register("stratified_split", """
SELECT vec_id, cast(label AS BIGINT) AS label,
       CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42' || cast(vec_id AS VARCHAR)), vec_id)
                 <= round(count(*) OVER (PARTITION BY label) * 0.2) THEN 'test' ELSE 'train' END AS split
FROM embeddings""")
def q_stratified_split(spark, sf):
    """M11."""
    from obslytics.operators import ml as ML
    return ML.stratified_split(embeddings(spark, sf).select("vec_id", "label"), "label", "vec_id", 0.2, 42)


@register("cluster_features", """
SELECT activity_type, round(avg(confidence), 6) AS confidence_mean, round(coalesce(stddev_samp(confidence), 0), 6) AS confidence_std,
       round(avg(hour), 6) AS hour_mean, round(coalesce(stddev_samp(hour), 0), 6) AS hour_std, count(*) AS timestamp_count
FROM enriched GROUP BY 1""")
def q_cluster_features(spark, sf):
    """A4."""
    from obslytics.operators import ml as ML
    return ML.cluster_features(enriched(spark, sf))


@register("scaled_features", """
, f AS (SELECT activity_type, avg(confidence) AS confidence_mean, count(*) AS timestamp_count FROM enriched GROUP BY 1)
SELECT activity_type,
       round((confidence_mean - avg(confidence_mean) OVER ()) / coalesce(nullif(stddev_pop(confidence_mean) OVER (), 0), 1), 6)
         AS confidence_mean_scaled,
       round((timestamp_count - avg(timestamp_count) OVER ()) / coalesce(nullif(stddev_pop(timestamp_count) OVER (), 0), 1), 6)
         AS timestamp_count_scaled
FROM f""")
def q_scaled_features(spark, sf):
    """M1 (population std, constant columns divided by 1)."""
    from obslytics.operators import ml as ML
    f = ML.cluster_features(enriched(spark, sf))
    s = ML.standardize(f, ["confidence_mean", "timestamp_count"])
    return s.select("activity_type", "confidence_mean_scaled", "timestamp_count_scaled")


@register("label_codes", """
SELECT activity_type, cast(dense_rank() OVER (ORDER BY activity_type) - 1 AS DOUBLE) AS code
FROM (SELECT DISTINCT activity_type FROM enriched)""")
def q_label_codes(spark, sf):
    """Alphabetical label codes."""
    from obslytics.operators import ml as ML
    d = enriched(spark, sf).select("activity_type").distinct()
    out, _ = ML.encode_labels(d, "activity_type", "code")
    return out


# --- fluent chain and SQL functions ------------------------------------------------------

_PIPE_TYPES = ["sitting", "standing", "walking", "running", "jumping", "focused_activity"]


@register("fluent_by_date", f"""
, f AS (SELECT * FROM enriched WHERE confidence >= 0.7 AND activity_type IN ({', '.join(repr(t) for t in _PIPE_TYPES)}))
SELECT cast(date AS VARCHAR) AS date, count(activity_type) AS activity_type, round(avg(confidence), 6) AS confidence,
       (SELECT behavioral_category FROM f f2 WHERE f2.date = f.date AND behavioral_category IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS behavioral_category
FROM f GROUP BY date""")
def q_pipeline(spark, sf):
    """Fluent filter -> filter -> features -> aggregate."""
    from obslytics.plans import fluent as PL
    return PL.fluent_by_date(enriched(spark, sf), 0.7, _PIPE_TYPES)


@register("sql_functions", """
, p AS (SELECT behavioral_category AS category, sum(frequency) AS n, avg(avg_confidence) AS c
        FROM patterns GROUP BY 1)
SELECT e.time_period, e.confidence_category AS confidence_band, e.behavioral_category, count(*) AS n,
       min(CASE WHEN p.category = 'Concerning' THEN CASE WHEN p.n > 5 AND p.c > 0.8 THEN 'High'
                                                        WHEN p.n > 2 AND p.c > 0.7 THEN 'Medium' ELSE 'Low' END
                WHEN p.category = 'Stimming' THEN CASE WHEN p.n > 10 THEN 'Medium' ELSE 'Low' END
                ELSE 'Low' END) AS risk_level
FROM enriched e LEFT JOIN p ON p.category = e.behavioral_category
GROUP BY 1, 2, 3""")
def q_sql_functions(spark, sf):
    """The rules called from Spark SQL."""
    from obslytics.plans import fluent as PL
    PL.register_sql_functions(spark)
    acts(spark, sf).createOrReplaceTempView("obs_activities")
    return spark.sql("""
      WITH e AS (SELECT *, time_period(hour(timestamp)) AS time_period, confidence_band(confidence) AS confidence_band,
                        behavioral_category(activity_type) AS behavioral_category
                 FROM obs_activities WHERE timestamp >= TIMESTAMP '2024-01-01 00:00:00'),
           p AS (SELECT behavioral_category AS category, sum(frequency) AS n, avg(avg_confidence) AS c
                 FROM (SELECT activity_type, first(behavioral_category) AS behavioral_category, count(*) AS frequency,
                              avg(confidence) AS avg_confidence FROM e GROUP BY activity_type) GROUP BY 1),
           g AS (SELECT time_period, confidence_band, behavioral_category, count(*) AS n FROM e GROUP BY 1, 2, 3)
      SELECT g.time_period, g.confidence_band, g.behavioral_category, g.n, risk_level(p.category, p.n, p.c) AS risk_level
      FROM g LEFT JOIN p ON p.category = g.behavioral_category""")


@register("rejected_rows", """
SELECT cast(event_id AS VARCHAR) AS id, 'range:confidence' AS reasons FROM events WHERE value / 100.0 > 1.0""")
def q_rejected_rows(spark, sf):
    """Validation of raw detection records built from every event with the
    confidence unclamped (``value / 100``) and the time as text; records whose
    confidence falls outside [0, 1] are rejected with all their reasons."""
    from obslytics.sources import readers as RD
    ev = A.table(spark, sf, "events")
    raw = ev.select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("string").alias("timestamp"),
                    F.col("event_type").alias("activity_type"), (F.col("value") / 100.0).alias("confidence"),
                    F.lit("raw").alias("description"), F.lit("live").alias("video_source"),
                    F.concat(F.lit("session_"), F.col("user_id").cast("string")).alias("session_id"))
    _, rejected = RD.split_valid(raw, S.ACTIVITIES, ranges={"confidence": (0.0, 1.0)})
    return rejected.select("id", F.array_join("reasons", ",").alias("reasons"))


# --- streaming (batch-equal results) ------------------------------------------------------

def _stream_dirs(spark, name):
    import uuid
    from obslytics.session import checkpoint_dir
    base = f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/chk"


@register("stream_summary", """
SELECT activity_type, hour("timestamp") AS hour, count(*) AS n, round(sum(confidence), 6) AS conf_sum
FROM activities GROUP BY 1, 2""")
def q_stream_summary(spark, sf):
    """Streaming (type, hour) counts, complete mode, availableNow."""
    from obslytics.streaming import streams as ST
    out, chk = _stream_dirs(spark, "summary")
    return ST.run_to_table(ST.stream_summary(ST.activities_stream(spark, f"{sf}/events.parquet")), out, chk, "complete")


@register("stream_alert_rows", f"""
SELECT id, {O.TS_TEXT.format(c='"timestamp"')} AS "timestamp", activity_type, round(confidence, 6) AS confidence, session_id
FROM activities WHERE activity_type IN ({O.ALERTABLE})""")
def q_stream_alert_rows(spark, sf):
    """T2 rows: appended alert stream."""
    from obslytics.streaming import streams as ST
    out, chk = _stream_dirs(spark, "alerts")
    return ST.run_to_table(ST.stream_alerts(ST.activities_stream(spark, f"{sf}/events.parquet")), out, chk, "append")


@register("stream_metric_alerts", _metric_alert_sql())
def q_stream_metric_alerts(spark, sf):
    """T5: stateless metric alerts over the metric stream."""
    from obslytics.streaming import streams as ST
    out, chk = _stream_dirs(spark, "metric_alerts")
    s = ST.stream_metric_alerts(ST.metrics_stream(spark, f"{sf}/events.parquet"))
    return ST.run_to_table(s, out, chk, "append")


@register("stream_health", """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, "timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS window_start,
       strftime(time_bucket(INTERVAL 1 HOUR, "timestamp") + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS window_end,
       host, count(*) AS samples, round(avg(cpu_percent), 6) AS cpu_avg, round(max(cpu_percent), 6) AS cpu_max,
       round(avg(memory_percent), 6) AS memory_avg, count(*) FILTER (WHERE cpu_percent > 80) AS cpu_alerts
FROM metrics GROUP BY time_bucket(INTERVAL 1 HOUR, "timestamp"), host
HAVING time_bucket(INTERVAL 1 HOUR, "timestamp") + INTERVAL 1 HOUR <= (SELECT max("timestamp") FROM metrics) - INTERVAL 10 MINUTE""")
def q_stream_health(spark, sf):
    """Hourly tumbling health windows per host that the watermark closed (append mode)."""
    from obslytics.streaming import streams as ST
    out, chk = _stream_dirs(spark, "health")
    s = ST.stream_health(ST.metrics_stream(spark, f"{sf}/events.parquet"), "1 hour")
    return ST.run_to_table(s, out, chk, "append")


@register("stream_concerning", f"""
, c AS (SELECT "timestamp", activity_type FROM enriched WHERE behavioral_category = 'Concerning'),
w AS (SELECT time_bucket(INTERVAL 30 MINUTE, "timestamp") - i * INTERVAL 30 MINUTE AS ws, activity_type
      FROM c, range(48) r(i))
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
       strftime(ws + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S.%f') AS window_end,
       count(DISTINCT activity_type) AS concerning_types, count(*) AS events,
       'Detected ' || cast(count(DISTINCT activity_type) AS VARCHAR) || ' concerning behavioral patterns' AS message
FROM w GROUP BY ws HAVING count(DISTINCT activity_type) > 1 AND ws + INTERVAL 1 DAY <= (SELECT max("timestamp") FROM c) - INTERVAL 10 MINUTE""")
def q_stream_concerning(spark, sf):
    """T4: sliding-day Concerning-type alerts of the windows that the watermark closed (append mode)."""
    from obslytics.streaming import streams as ST
    out, chk = _stream_dirs(spark, "concerning")
    s = ST.stream_concerning(ST.activities_stream(spark, f"{sf}/events.parquet"), "1 day", "30 minutes", 1)
    return ST.run_to_table(s, out, chk, "append")


@register("stream_detections", f"""
, d AS (SELECT cast(user_id AS VARCHAR) AS upload_id, {_BOX_RULE.replace('width * height', '(20 + event_id % 120) * (20 + event_id % 90)')}
        FROM events)
SELECT upload_id, activity_type, count(*) AS n FROM d WHERE confidence > 0.6 GROUP BY 1, 2""")
def q_stream_detections(spark, sf):
    """Live detections from a frame stream (per-upload counts of stored rows)."""
    from obslytics.streaming import streams as ST
    out, chk = _stream_dirs(spark, "detections")
    ev = ST.events_stream(spark, f"{sf}/events.parquet")
    eid = F.col("event_id")
    frames = ev.select(F.col("user_id").cast("string").alias("upload_id"), eid.alias("frame_index"),
                       F.array(F.create_map(F.lit("width"), (F.lit(20) + eid % 120).cast("double"),
                                            F.lit("height"), (F.lit(20) + eid % 90).cast("double"))).alias("detections"))
    rows = ST.run_to_table(ST.stream_detections(frames), out, chk, "append")
    return rows.groupBy("upload_id", "activity_type").agg(F.count(F.lit(1)).alias("n"))


# --- models (rows-only checks: results depend on the fitted model) -------------------------

_TYPE_COLS = ["confidence_mean", "confidence_std", "hour_mean", "hour_std", "timestamp_count"]
_scaled_sql = lambda c: f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}_scaled"
_TYPE_POINTS = f""", type_features AS (
  SELECT activity_type, avg(confidence) AS confidence_mean, coalesce(stddev_samp(confidence), 0) AS confidence_std, avg(hour) AS hour_mean,
         coalesce(stddev_samp(hour), 0) AS hour_std, count(*)::DOUBLE AS timestamp_count FROM enriched GROUP BY 1),
type_points AS MATERIALIZED (SELECT activity_type, {', '.join(map(_scaled_sql, _TYPE_COLS))} FROM type_features),
""" + MQ.kmeans("type_points", "activity_type", [c + "_scaled" for c in _TYPE_COLS], 3, 10)
_ROW_COLS = ["confidence", "hour", "activity_encoded", "behavior_encoded"]
_ROW_POINTS = f""", row_features AS MATERIALIZED (
  SELECT id, confidence, hour::DOUBLE AS hour, (dense_rank() OVER (ORDER BY activity_type) - 1)::DOUBLE AS activity_encoded,
         (dense_rank() OVER (ORDER BY behavioral_category) - 1)::DOUBLE AS behavior_encoded FROM enriched WHERE behavioral_category IS NOT NULL),
row_points AS MATERIALIZED (SELECT id, {', '.join(map(_scaled_sql, _ROW_COLS))} FROM row_features),
"""
_ROW_CLUSTERS = _ROW_POINTS + MQ.kmeans("row_points", "id", [c + "_scaled" for c in _ROW_COLS], 5, 10)
_centres_sql = lambda cols: f"""
SELECT z.cluster, (SELECT count(*) FROM km_rows r WHERE r.cluster = z.cluster) AS n, {', '.join(f'round(z.{c}_scaled, 6) AS {c}' for c in cols)},
       round((SELECT sum(distance) FROM km_rows), 6) AS inertia FROM km_centres z"""  # noqa: E731


@register("cluster_activities", _TYPE_POINTS + """
SELECT activity_type, cluster, round(distance, 6) AS distance FROM km_rows""")
def q_cluster_activities(spark, sf):
    """M2: type-to-cluster map of the per-type features (k=3)."""
    from obslytics.operators import ml as ML
    out, _, _ = ML.cluster_activities(enriched(spark, sf), 3)
    return out


@register("cluster_centres", _TYPE_POINTS + _centres_sql(_TYPE_COLS))
def q_cluster_centres(spark, sf):
    """M2: centres (scaled), sizes and inertia."""
    from obslytics.operators import ml as ML
    return ML.centre_rows(ML.activity_clusters(enriched(spark, sf), 3), ML.CLUSTER_COLS, spark)


@register("cluster_rows", _ROW_CLUSTERS + """
SELECT id, cluster FROM km_rows""")
def q_cluster_rows(spark, sf):
    """M3: row-level k-means."""
    from obslytics.operators import ml as ML
    return ML.cluster_rows(enriched(spark, sf))


@register("row_cluster_centres", _ROW_CLUSTERS + _centres_sql(_ROW_COLS))
def q_row_cluster_centres(spark, sf):
    """M3: centres (scaled), sizes and inertia."""
    from obslytics.operators import ml as ML
    return ML.centre_rows(ML.row_clusters(enriched(spark, sf)), ML.ROW_FEATURES, spark)


_SPACE = _ROW_CLUSTERS + ",\n" + MQ.components("row_points", [c + "_scaled" for c in _ROW_COLS], 8) + f""",
axes AS (SELECT feature, mean, max(loading) FILTER (component = 1) AS l1, max(loading) FILTER (component = 2) AS l2 FROM pc_components GROUP BY 1, 2),
axis AS MATERIALIZED (SELECT {', '.join(f"max({v}) FILTER (feature = '{c}_scaled') AS {v}_{c}" for c in _ROW_COLS for v in ('mean', 'l1', 'l2'))} FROM axes)"""
_place_sql = lambda j: "round(" + " + ".join(f"(p.{c}_scaled - mean_{c}) * l{j}_{c}" for c in _ROW_COLS) + f", 6) AS pc{j}"


@register("pca_projection", _SPACE + f"""
SELECT p.id, p.cluster, {_place_sql(1)}, {_place_sql(2)} FROM km_rows p, axis""")
def q_pca_projection(spark, sf):
    """M4/M6: clusters in PCA space (consistently scaled)."""
    from obslytics.operators import ml as ML
    return ML.cluster_projection(enriched(spark, sf))


@register("pca_centres", _SPACE + f"""
SELECT p.cluster, (SELECT count(*) FROM km_rows r WHERE r.cluster = p.cluster) AS n, {_place_sql(1)}, {_place_sql(2)} FROM km_centres p, axis""")
def q_pca_centres(spark, sf):
    """M6: the clusters' centres in PCA space."""
    from obslytics.operators import ml as ML
    return ML.projected_clusters(enriched(spark, sf))[1]


_RAW_COMPONENTS = _ROW_POINTS + MQ.components("row_features", _ROW_COLS, 8)


@register("pca_components", _RAW_COMPONENTS + """
SELECT component, feature, round(loading, 6) AS loading, round(ratio, 6) AS explained_variance_ratio,
       round(avg(abs(loading)) OVER (PARTITION BY feature), 6) AS weight
FROM pc_components WHERE component <= 2""")
def q_pca_components(spark, sf):
    """M4/M5: loadings and explained-variance ratios of the row features."""
    from obslytics.operators import clustering as CL
    from obslytics.operators import ml as ML
    return ML.component_rows(CL.components(ML.row_features(enriched(spark, sf)), ML.ROW_FEATURES), spark)


@register("loading_weights", _RAW_COMPONENTS + """
SELECT feature, round(avg(abs(loading)), 6) AS weight FROM pc_components WHERE component <= 2 GROUP BY 1""")
def q_loading_weights(spark, sf):
    """M5: mean absolute PCA loading per feature."""
    from obslytics.operators import ml as ML
    base = ML.row_features(enriched(spark, sf))
    _, _, load = ML.pca(base, ML.ROW_FEATURES, 2)
    return ML.loading_weights(load, ML.ROW_FEATURES, spark)


def _seq_vectors(spark, sf):
    from obslytics.operators import sequences as SQ
    return SQ.flatten_sequences(SQ.sequences(acts_with_k(spark, sf), 10))


def _split_sequences(seq):
    """The sequences, written once, in an 80/20 split: the split and the training read their rows several times."""
    from obslytics.operators import ml as ML
    from obslytics.session import stored
    seq = stored(seq.withColumn("seq_key", F.concat_ws(":", "session_id", "seq_index")), "sequences")
    return ML.stratified_split(seq, "label", "seq_key", 0.2, 42)


@register("forest_importances")
def q_forest_importances(spark, sf):
    """Forest on per-session statistical features, first 5
    importances by index."""
    from obslytics.operators import ml as ML
    from obslytics.operators import sequences as SQ
    feats = SQ.statistical_features(acts(spark, sf), "session_id", "confidence")
    label = acts(spark, sf).groupBy("session_id").agg(F.mode("activity_type", True).alias("label"))
    data = feats.join(label, "session_id")
    cols = ["mean", "std", "min", "max", "median", "p25", "p75", "var", "ptp", "length"]
    data = data.select("session_id", "label", *[F.col(c).cast("double").alias(c) for c in cols])
    model = ML.train_forest(data, "label", cols, trees=50, depth=10, seed=42)
    return ML.importances(model, spark, cols, 5, "index")


@register("svm_predictions")
def q_svm_predictions(spark, sf):
    """M9: RBF-kernel SVM (landmark features) of the embeddings, with the calibrated probability of the predicted class."""
    from obslytics.operators import ml as ML
    from pyspark.ml.functions import array_to_vector
    e = embeddings(spark, sf).select("vec_id", F.col("label").cast("string").alias("label"),
                                     array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    split = ML.stratified_split(e, "label", "vec_id", 0.2, 42)
    model, labels = ML.train_svm(split.filter("split = 'train'"), "label", "features", dim=64, n_features=128,
                                 max_iter=20)
    pred = ML.svm_predictions(model, labels, split.filter("split = 'test'"), "features", 64, 128)
    return pred.select("vec_id", "label", "prediction", F.array_max("probability").alias("probability"))


@register("confidence_regression")
def q_confidence_regression(spark, sf):
    """Forest regression of confidence, MSE and R^2."""
    from obslytics.operators import ml as ML
    return ML.confidence_regression(enriched(spark, sf), 50, 42)


@register("mlp_predictions")
def q_mlp_predictions(spark, sf):
    """Multilayer perceptron on flattened 10x5 sequences and their order features."""
    from obslytics.operators import ml as ML
    from obslytics.operators import sequences as SQ
    split = _split_sequences(SQ.sequence_vectors(SQ.sequences(acts_with_k(spark, sf), 10)))
    model = ML.train_mlp(split.filter("split = 'train'"), "label", "features", (64, 32), 50, 42)
    return model.transform(split.filter("split = 'test'")).select("session_id", "seq_index", "label", "prediction")


@register("stream_history", f"""
SELECT host, count(*) AS retained, {O.TS_TEXT.format(c='min("timestamp")')} AS oldest,
       {O.TS_TEXT.format(c='max("timestamp")')} AS newest, round(avg(cpu_percent), 6) AS cpu_avg
FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY "timestamp" DESC) AS rn FROM metrics)
WHERE rn <= 1000 GROUP BY host""")
def q_stream_history(spark, sf):
    """Per-host bounded history (1000 samples), trimmed by host and bucket in each micro-batch."""
    from obslytics.streaming import streams as ST
    out, chk = _stream_dirs(spark, "history")
    ST.history_sink(ST.metrics_stream(spark, f"{sf}/events.parquet"), out, chk, 1000).awaitTermination()
    return ST.history_summary(spark, out)


# --- variants that exercise optional parameters --------------------------------------------

@register("session_summary", """
, s1 AS (SELECT * FROM activities WHERE "timestamp" >= TIMESTAMP '2024-01-24 00:00:00' AND session_id = 'session_7')
SELECT (SELECT count(*) FROM s1) AS total_activities,
       round(coalesce((SELECT avg(coalesce(confidence, 0)) FROM s1), 0), 6) AS average_confidence,
       (SELECT activity_type FROM (SELECT activity_type, count(*) AS n FROM s1 GROUP BY 1)
        ORDER BY n DESC, activity_type LIMIT 1) AS most_common_activity""")
def q_session_summary(spark, sf):
    """A1 + F1: summary of one session over 7 days."""
    s = SM.summary(acts(spark, sf), A.AS_OF, session_id="session_7", days=7)
    return s.select("total_activities", "average_confidence", "most_common_activity")


@register("time_features_midnight", """
SELECT id, hour, CASE WHEN hour >= 0 AND hour <= 6 THEN 'Night' ELSE time_period END AS time_period, is_weekend, week, month
FROM enriched""")
def q_time_features_midnight(spark, sf):
    """P2-P8 with ``include_midnight=True`` (hour 0 in Night)."""
    df = R.read_activities(spark, acts(spark, sf), A.AS_OF, 30, include_midnight=True)
    return df.select("id", "hour", "time_period", "is_weekend", "week", "month")


@register("stream_alert_windows", f"""
, a AS (SELECT "timestamp", session_id FROM activities WHERE activity_type IN ({O.ALERTABLE})),
w AS (SELECT time_bucket(INTERVAL 5 MINUTE, "timestamp") - i * INTERVAL 5 MINUTE AS ws, session_id
      FROM a, range(12) r(i))
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
       strftime(ws + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS window_end, session_id, count(*) AS alerts
FROM w GROUP BY ws, session_id HAVING ws + INTERVAL 1 HOUR <= (SELECT max("timestamp") FROM a) - INTERVAL 10 MINUTE""")
def q_stream_alert_windows(spark, sf):
    """T2 windows: alerts per session over a 1-hour window sliding by 5 minutes, once the watermark closed it (append mode)."""
    from obslytics.streaming import streams as ST
    out, chk = _stream_dirs(spark, "alert_windows")
    s = ST.stream_alert_windows(ST.activities_stream(spark, f"{sf}/events.parquet"), "1 hour", "5 minutes")
    return ST.run_to_table(s, out, chk, "append")


@register("time_features", """
SELECT id, hour, day_of_week, cast(date AS VARCHAR) AS date, week, month, is_weekend, time_period FROM enriched""")
def q_time_features(spark, sf):
    """P2-P8."""
    df = enriched(spark, sf)
    return df.select("id", "hour", "day_of_week", "date", "week", "month", "is_weekend", "time_period")


@register("stream_daily_health", """
SELECT strftime(time_bucket(INTERVAL 1 DAY, "timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS window_start,
       strftime(time_bucket(INTERVAL 1 DAY, "timestamp") + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S.%f') AS window_end,
       host, count(*) AS samples, round(avg(cpu_percent), 6) AS cpu_avg, round(max(cpu_percent), 6) AS cpu_max,
       round(avg(memory_percent), 6) AS memory_avg, count(*) FILTER (WHERE cpu_percent > 80) AS cpu_alerts
FROM metrics GROUP BY time_bucket(INTERVAL 1 DAY, "timestamp"), host
HAVING time_bucket(INTERVAL 1 DAY, "timestamp") + INTERVAL 1 DAY <= (SELECT max("timestamp") FROM metrics) - INTERVAL 10 MINUTE""")
def q_stream_daily_health(spark, sf):
    """Midnight 24-hour summary per host (tumbling 1-day window) of the days that the watermark closed (append mode)."""
    from obslytics.streaming import streams as ST
    out, chk = _stream_dirs(spark, "daily_health")
    s = ST.stream_health(ST.metrics_stream(spark, f"{sf}/events.parquet"), "1 day")
    return ST.run_to_table(s, out, chk, "append")


# --- jobs that write (under the checkpoint folder) and report what they wrote ------------

@register("backup_manifest", """
SELECT 'activities' AS "table", (SELECT count(*) FROM activities) AS rows, '20240131_000000' AS "timestamp"
UNION ALL
SELECT 'labeling_data', (SELECT count(*) FROM labeling), '20240131_000000'""")
def q_backup_manifest(spark, sf):
    """Snapshot both tables, read the snapshot back, report counts."""
    import uuid
    from obslytics.operators import jobs as J
    from obslytics.session import checkpoint_dir
    root = f"{checkpoint_dir(spark)}/backups/{uuid.uuid4().hex}"
    m = J.backup({"activities": acts(spark, sf), "labeling_data": A.load_labeling(spark, sf)}, root, A.AS_OF)
    return m.select("table", "rows", "timestamp")


@register("retention_kept", """
SELECT count(*) AS kept_rows, count(DISTINCT cast("timestamp" AS DATE)) AS kept_days,
       min(cast("timestamp" AS DATE))::VARCHAR AS first_day
FROM activities WHERE "timestamp" >= TIMESTAMP '2024-01-17 00:00:00'""")
def q_retention_kept(spark, sf):
    """Write the rows newer than the cutoff (14 days before as_of) as a
    new date-partitioned snapshot and summarise what it holds."""
    import uuid
    from obslytics.operators import jobs as J
    from obslytics.session import checkpoint_dir
    base = f"{checkpoint_dir(spark)}/retention/{uuid.uuid4().hex}"
    stored = acts(spark, sf).withColumn("date", X.to_date("timestamp"))
    kept = J.apply_retention(stored, base, A.AS_OF, 14)
    return kept.agg(F.count(F.lit(1)).alias("kept_rows"), F.count_distinct("date").alias("kept_days"),
                    F.min("date").cast("string").alias("first_day"))


_RETENTION_SQL = """SELECT '{name}' AS "table", count(*) FILTER (cast("timestamp" AS DATE) = DATE '2024-01-17') AS rows_read,
       count(*) FILTER ("timestamp" < TIMESTAMP '2024-01-17 12:30:00') AS rows_deleted,
       count(*) FILTER ("timestamp" >= TIMESTAMP '2024-01-17 12:30:00') AS rows_kept,
       count(DISTINCT cast("timestamp" AS DATE)) FILTER (cast("timestamp" AS DATE) < DATE '2024-01-17') AS days_dropped,
       '2024-01-17T12:30:00' AS cutoff, count(*) FILTER ("timestamp" >= TIMESTAMP '2024-01-17 12:30:00') AS rows_left
FROM {source}"""


@register("retention_run", " UNION ALL ".join(_RETENTION_SQL.format(name=n, source=s) for n, s in
                                              (("activities", "activities"), ("labeling_data", "labeling"))))
def q_retention_run(spark, sf):
    """Both tables stored by day, then one retention run at a cutoff within a day; rows read are those of
    that day alone, ``rows_left`` is counted from the tables as the new snapshot names them."""
    from obslytics.operators import retention as RT
    root = _scratch(spark, "store")
    RT.store_tables({"activities": acts(spark, sf), "labeling_data": A.load_labeling(spark, sf)}, root)
    stats = RT.retain(spark, root, A.AS_OF + _dt.timedelta(hours=12, minutes=30), 14)
    left = [RT.read_stored(spark, root, t).agg(F.count(F.lit(1)).alias("rows_left")).withColumn("table", F.lit(t)) for t in ("activities", "labeling_data")]
    return stats.join(F.broadcast(left[0].unionByName(left[1])), "table").select(*stats.columns, "rows_left")


def _scratch(spark, name):
    import uuid
    from obslytics.session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/{name}/{uuid.uuid4().hex}"


@register("appended_activities", f"""
SELECT id, {O.TS_TEXT.format(c='"timestamp"')} AS ts, activity_type, confidence,
       CASE WHEN activity_type IN ({O.ALERTABLE}) THEN '{S.AI_UNAVAILABLE}' ELSE NULL END AS ai_analysis
FROM activities""")
def q_appended_activities(spark, sf):
    """Detections appended in two batches to a stored table, read back."""
    path = _scratch(spark, "appended-activities")
    raw = acts(spark, sf).drop("ai_analysis")
    for half in (F.col("video_source") == "live", F.col("video_source") != "live"):
        R.append_activities(raw.filter(half), path)
    return spark.read.parquet(path).select("id", X.ts_text("timestamp").alias("ts"), "activity_type", "confidence", "ai_analysis")


@register("appended_labels", f"""
SELECT id, {O.TS_TEXT.format(c='"timestamp"')} AS ts, len(labels) AS n_labels FROM labeling""")
def q_appended_labels(spark, sf):
    """Label records appended to a stored table, read back."""
    path = _scratch(spark, "appended-labels")
    R.append_labels(A.load_labeling(spark, sf), path)
    return spark.read.parquet(path).select("id", X.ts_text("timestamp").alias("ts"), X.label_count("labels").alias("n_labels"))


@register("stored_detections", f"""
, d AS (SELECT upload_id, frame_index, {_BOX_RULE} FROM frames)
SELECT 'upload_' || upload_id AS session_id, activity_type, count(*) AS n, round(sum(confidence), 6) AS conf_sum
FROM d WHERE confidence > 0.6 GROUP BY 1, 2""")
def q_stored_detections(spark, sf):
    """Detections above 0.6 shaped as activity rows, stored and read back; ids are distinct."""
    from obslytics.operators import sequences as SQ
    path = _scratch(spark, "stored-detections")
    R.append_activities(SQ.ingest_detections(A.load_frames(spark, sf), "uploaded"), path)
    return (spark.read.parquet(path).groupBy("session_id", "activity_type")
            .agg(F.count_distinct("id").alias("n"), F.sum("confidence").alias("conf_sum")))


@register("payload_round_trip", """
SELECT doc_id, strlen(text) AS n_bytes, md5(text) AS digest FROM documents""")
def q_payload_round_trip(spark, sf):
    """Payloads as base64 text, every other one as a data URL, decoded to the same bytes."""
    docs = A.table(spark, sf, "documents")
    coded = F.base64(F.encode("text", "UTF-8"))
    sent = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:text/plain;base64,"), coded)).otherwise(coded).alias("video_frame"))
    raw = X.decode_payload("video_frame")
    return sent.select("doc_id", F.octet_length(raw).alias("n_bytes"), F.md5(raw).alias("digest"))


@register("delivered_alerts", f"""
SELECT id, activity_type, session_id, count(*) AS n FROM activities WHERE activity_type IN ({O.ALERTABLE}) GROUP BY 1, 2, 3""")
def q_delivered_alerts(spark, sf):
    """Alerts delivered to a table by batch, each once."""
    from obslytics.streaming import streams as ST
    out, chk = _stream_dirs(spark, "delivered")
    ST.alerts_sink(ST.stream_alerts(ST.activities_stream(spark, f"{sf}/events.parquet")), out, chk).awaitTermination()
    return spark.read.parquet(out).groupBy("id", "activity_type", "session_id").agg(F.count(F.lit(1)).alias("n"))


@register("model_comparison")
def q_model_comparison(spark, sf):
    """M7/M12/M14/M17/M21 end to end: 10-step sequences -> flattened vectors ->
    stratified 80/20 split -> random forest and multilayer perceptron -> the
    comparison table on the held-out sequences."""
    from obslytics.operators import ml as ML
    from obslytics.session import checkpoint_dir
    checkpoint_dir(spark)
    split = ML.few_parts(_split_sequences(_seq_vectors(spark, sf)).checkpoint(eager=True))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    forest = ML.train_forest(train, "label", ["features"], trees=100, depth=10, seed=42)
    mlp = ML.train_mlp(train, "label", "features", (64, 32), 50, 42)
    preds = (forest.transform(test).select(F.lit("RandomForest").alias("model_name"), "label", "prediction")
             .unionByName(mlp.transform(test).select(F.lit("MLP").alias("model_name"), "label", "prediction")))
    return ML.compare_models(preds)


# --- fitted models held against their tables, saved models, sequences as vectors ---------------------------------

_STAT_COLS = ["mean", "std", "min", "max", "median", "p25", "p75", "var", "ptp", "length"]


def _session_rows(spark, sf):
    from obslytics.operators import sequences as SQ
    from obslytics.session import stored
    feats = SQ.statistical_features(acts(spark, sf), "session_id", "confidence")
    label = acts(spark, sf).groupBy("session_id").agg(F.mode("activity_type", True).alias("label"))
    data = feats.join(label, "session_id")
    return stored(data.select("session_id", "label", *[F.col(c).cast("double").alias(c) for c in _STAT_COLS]), "sessions")


@register("forest_table_check", """
SELECT count(DISTINCT session_id) AS scored, count(DISTINCT session_id) AS equal, 20::BIGINT AS trees, 10::BIGINT AS features, 10::BIGINT AS equal_importances, 1.0::DOUBLE AS importance_sum
FROM activities""")
def q_forest_table_check(spark, sf):
    """A forest's node table scores every session as MLlib does, and gives its importances (to 1e-12)."""
    from obslytics.operators import ml as ML
    from obslytics.operators import models as MO
    data = _session_rows(spark, sf)
    model = ML.train_forest(data, "label", _STAT_COLS, trees=20, depth=8, seed=42)
    nodes = MO.node_table(model, spark)
    both = MO.score_forest(model.transform(data), nodes, _STAT_COLS)
    counts = both.agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("score") == F.col("_pred")).alias("equal"))
    own = MO.forest_importances(nodes, _STAT_COLS).withColumnRenamed("importance", "own")
    theirs = ML.importances(model, spark, _STAT_COLS, None)
    pairs = own.join(F.broadcast(theirs), "feature_index").agg(
        F.count(F.lit(1)).alias("features"), F.count_if(F.abs(F.col("own") - F.col("importance")) < 1e-12).alias("equal_importances"),
        F.sum("own").alias("importance_sum"))
    trees = nodes.agg(F.count_distinct("tree").alias("trees"))
    return SM.combine_rows(counts, trees, pairs).select("scored", "equal", "trees", "features", "equal_importances", "importance_sum")


@register("regression_table_check", """
SELECT count(*) AS scored, count(*) AS equal, 10::BIGINT AS trees, true AS finite FROM enriched WHERE behavioral_category IS NOT NULL""")
def q_regression_table_check(spark, sf):
    """The node table of the confidence forest predicts every row as MLlib does (to 1e-12)."""
    from obslytics.operators import ml as ML
    from obslytics.operators import models as MO
    from obslytics.session import stored
    rows = ML.regression_rows(enriched(spark, sf))
    model = ML.train_regression(rows, 10, 42)
    nodes = MO.node_table(model, spark)
    both = MO.score_forest(stored(model.transform(rows).select("_p", *ML.REGRESSION_FEATURES), "regression"), nodes, ML.REGRESSION_FEATURES, classifier=False)
    counts = both.agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.abs(F.col("score") - F.col("_p")) < 1e-12).alias("equal"),
                      F.bool_and(~F.isnan("score")).alias("finite"))
    return SM.combine_rows(counts, nodes.agg(F.count_distinct("tree").alias("trees"))).select("scored", "equal", "trees", "finite")


@register("saved_model_check", """
SELECT count(DISTINCT session_id) AS scored, count(DISTINCT session_id) AS equal, 2::BIGINT AS versions, 42::BIGINT AS seed,
       (SELECT count(DISTINCT label) FROM (SELECT session_id, first(activity_type ORDER BY n DESC, activity_type) AS label
        FROM (SELECT session_id, activity_type, count(*) AS n FROM activities GROUP BY 1, 2) GROUP BY 1)) AS labels, 'refused' AS other_columns
FROM activities""")
def q_saved_model_check(spark, sf):
    """A forest with its encoder saved as the second version of a model folder, loaded and scored again; columns of
    another kind are refused."""
    from obslytics.operators import ml as ML
    from obslytics.operators import models as MO
    data, path = _session_rows(spark, sf), _scratch(spark, "model")
    model = ML.train_forest(data, "label", _STAT_COLS, trees=5, depth=5, seed=42)
    schema = data.select(*_STAT_COLS).schema
    labels = model.stages[-1].getLabels()
    for _ in range(2):
        MO.save_model(model, path, schema, labels, 42)
    again = MO.load_model(path, schema)
    both = model.transform(data).select("session_id", "prediction").join(again.transform(data).select("session_id", F.col("prediction").alias("p")), "session_id")
    counts = both.agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("prediction") == F.col("p")).alias("equal"))
    try:
        MO.load_model(path, data.select("label").schema)
        other = "loaded"
    except MO.ModelMismatch:
        other = "refused"
    about = MO.manifest(path).agg(F.count(F.lit(1)).alias("versions"), F.max("seed").alias("seed"), F.max(F.size("labels")).alias("labels"))
    return SM.combine_rows(counts, about).select("scored", "equal", "versions", "seed", "labels", F.lit(other).alias("other_columns"))


_SEQ_FULL = _SEQ_ROWS + """,
steps AS MATERIALIZED (SELECT *, (rn - 1) // 10 AS seq_index, (rn - 1) % 10 AS step_index FROM seqrows
  QUALIFY count(*) OVER (PARTITION BY session_id, (rn - 1) // 10) = 10)"""
_SEQ_COLS = ["confidence", "hour", "k", "weekday", "gap_minutes"]


@register("flat_sequences", _SEQ_FULL + f"""
SELECT session_id, seq_index, max(label) FILTER (step_index = 9) AS label,
       {', '.join((f"max({c}) FILTER (step_index = {i})" if j == 4 else f"round(max({c}) FILTER (step_index = {i}), 6)") + f" AS f{5 * i + j}"
            for i in range(10) for j, c in enumerate(_SEQ_COLS))}
FROM steps GROUP BY 1, 2""", exact=tuple(f"f{5 * i + 4}" for i in range(10)))
def q_flat_sequences(spark, sf):
    """Each 10-step sequence as one row of 50 columns."""
    from obslytics.operators import sequences as SQ
    return SQ.flat_columns(SQ.sequences(acts_with_k(spark, sf), 10))


@register("order_features", _SEQ_FULL + f"""
SELECT session_id, seq_index, max(label) FILTER (step_index = 9) AS label,
       {', '.join(f"round(sum({c} * pow({d}, 9 - step_index)) / ((1 - pow({d}, 10)) / (1 - {d})), 6) AS d{i}_{c}" for i, d in enumerate((0.5, 0.9)) for c in _SEQ_COLS)}
FROM steps GROUP BY 1, 2""")
def q_order_features(spark, sf):
    """Decayed states of each sequence's features."""
    from obslytics.operators import sequences as SQ
    return SQ.order_features(SQ.sequences(acts_with_k(spark, sf), 10))


@register("confidence_lists", """
, placed AS (SELECT hour("timestamp") AS hour, confidence, row_number() OVER (PARTITION BY hour("timestamp") ORDER BY "timestamp", id) AS rn FROM activities)
SELECT hour, (rn - 1) // 100 AS chunk, count(*) AS n,
       array_to_string(list(cast(round(cast(confidence AS DECIMAL(24,10)), 6) AS VARCHAR) ORDER BY rn), ',') AS confidences
FROM placed GROUP BY 1, 2""")
def q_confidence_lists(spark, sf):
    """Confidences by hour as lists in the order of time, in chunks of 100."""
    lists = SM.confidence_lists(acts(spark, sf), 100)
    text = F.array_join(F.transform("confidences", lambda c: F.round(c.cast("decimal(24,10)"), 6).cast("string")), ",")
    return lists.select("hour", "chunk", "n", text.alias("confidences"))


@register("video_uploads", """
, u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
named AS (SELECT 'upload_' || cast(user_id AS VARCHAR) || ['.mp4', '.MOV', '.txt', '.webm', '.mp4.part'][user_id % 5 + 1] AS name, user_id % 5 AS kind, n FROM u)
SELECT name, CASE kind WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'video/quicktime' ELSE 'video/webm' END AS content_type, n AS length
FROM named WHERE kind IN (0, 1, 3)""")
def q_video_uploads(spark, sf):
    """Uploads stored as files (one byte a frame), then the video files among them by name and type, contents unread."""
    frames = A.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    ext = F.element_at(F.array(*(F.lit(x) for x in (".mp4", ".MOV", ".txt", ".webm", ".mp4.part"))), (F.col("user_id") % 5 + 1).cast("int"))
    files = frames.select(F.concat(F.lit("upload_"), F.col("user_id").cast("string"), ext).alias("name"), F.expr("cast(repeat('x', cast(n as int)) as binary)").alias("content"))
    path = _scratch(spark, "uploads")
    R.write_uploads(files, path).write.format("noop").mode("overwrite").save()
    return R.read_videos(spark, path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content_type", "length")


@register("row_guards", """
, c AS (SELECT (SELECT count(*) FROM (SELECT * FROM enriched LIMIT 10)) AS rows, (SELECT least(count(DISTINCT activity_type), 2) FROM enriched WHERE activity_type = 'sitting') AS types)
SELECT 'rows' AS what, 10::BIGINT AS needed, rows AS found, rows >= 10 AS enough,
       CASE WHEN rows >= 10 THEN NULL ELSE 'need at least 10 rows, found ' || rows END AS error FROM c
UNION ALL
SELECT 'activity types', 2, types, types >= 2, CASE WHEN types >= 2 THEN NULL ELSE 'need at least 2 activity types, found ' || types END FROM c""")
def q_row_guards(spark, sf):
    """the guards of the chart sets (10 rows) and of clustering (two types), the latter on one type."""
    df = enriched(spark, sf)
    one = df.filter(F.col("activity_type") == "sitting").select("activity_type").distinct()
    return FL.guard(df, 10).unionByName(FL.guard(one, 2, "activity types"))


@register("report_rows", _TYPE_POINTS + f""",
counts AS (SELECT count(*) FILTER (behavioral_category = 'Concerning') AS con, count(*) FILTER (behavioral_category = 'Stimming') AS sti,
           count(*) FILTER (behavioral_category = 'Therapeutic') AS the, count(*) FILTER (behavioral_category = 'Active') AS act,
           count(*) FILTER (behavioral_category = 'Calm') AS cal FROM patterns),
texts AS (SELECT list_filter([{', '.join(f"CASE WHEN {c} THEN '{t}' END" for c, t in zip(('con > 2', 'con > 0', 'sti > 0', 'sti > 0', 'the > 0', 'act > 0 AND cal > 0'), (x.replace("'", "''") for x in S.RECOMMENDATIONS)))}],
  lambda x: x IS NOT NULL) AS t FROM counts)
SELECT 'activity_patterns' AS section, row_number() OVER (ORDER BY frequency DESC, activity_type) - 1 AS place, activity_type AS name, frequency::VARCHAR AS value FROM patterns
UNION ALL SELECT 'clustering_analysis', 0, activity_type, cluster::VARCHAR FROM km_rows
UNION ALL SELECT 'recommendations', unnest(range(len(t))), NULL, unnest(t) FROM texts
UNION ALL SELECT 'summary', 0, 'total_patterns', count(*)::VARCHAR FROM patterns
UNION ALL SELECT 'summary', 1, 'most_frequent_activity', (SELECT activity_type FROM patterns ORDER BY frequency DESC, activity_type LIMIT 1)
UNION ALL SELECT 'summary', 2, 'behavioral_diversity', count(DISTINCT coalesce(behavioral_category, chr(0)))::VARCHAR FROM patterns
UNION ALL SELECT 'summary', 3, 'concerning_behaviors', (SELECT con FROM counts)::VARCHAR""")
def q_report_rows(spark, sf):
    """The nested analysis report written as JSON and read back, a row for each of its entries."""
    from obslytics.operators import jobs as J
    path = _scratch(spark, "report")
    J.write_report(P.analysis_report(enriched(spark, sf)), path)
    return P.report_rows(spark, path)


#: chart panels and the registered queries that give the same tables
_PANELS = {"timeline/daily_counts": "daily_counts", "timeline/daily_category": "daily_category", "timeline/daily_confidence": "daily_confidence",
           "heatmaps/hour_by_weekday": "hour_by_weekday", "heatmaps/activity_correlation": "activity_correlation", "heatmaps/category_by_period": "category_by_period",
           "heatmaps/confidence_matrix": "confidence_matrix", "statistics/activity_frequency": "activity_frequency", "statistics/confidence_density": "confidence_density",
           "statistics/gap_histogram": "gap_histogram", "dashboard/daily_activity": "daily_activity", "dashboard/category_counts": "category_counts",
           "dashboard/hour_by_activity": "hour_by_activity", "dashboard/weekday_by_hour": "weekday_by_hour"}


def _panel_rows_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{panel}' AS panel, (SELECT count(*) FROM ({SQL[name]})) AS rows, 4::BIGINT AS sets" for panel, name in _PANELS.items())


@register("chart_report_rows")
def q_chart_report_rows(spark, sf):
    """The chart report written as a whole (without the model panels); the panels' rows read back, and the number of
    panel sets in its summary."""
    from obslytics.plans import reports
    path = _scratch(spark, "charts")
    sets = reports.chart_report(enriched(spark, sf), path, advanced=False).first()["visualizations_generated"]
    counts = [spark.read.parquet(f"{path}/{panel}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(panel).alias("panel"), "rows", F.lit(sets).alias("sets"))
              for panel in _PANELS]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


SQL["chart_report_rows"] = _panel_rows_sql()  # the panels' own twins hold the adapter's tables already


@register("svm_probabilities", """
SELECT vec_id, cast(label AS VARCHAR) AS label, 1.0::DOUBLE AS total, true AS of_known_label
FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42' || cast(vec_id AS VARCHAR)), vec_id) AS k,
             round(count(*) OVER (PARTITION BY label) * 0.2) AS n FROM embeddings) WHERE k <= n""")
def q_svm_probabilities(spark, sf):
    """Probabilities of all classes for the held-out fifth; each row's sum to one, its prediction is the class of a label seen."""
    from obslytics.operators import ml as ML
    from pyspark.ml.functions import array_to_vector
    e = embeddings(spark, sf).select("vec_id", F.col("label").cast("string").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    split = ML.stratified_split(e, "label", "vec_id", 0.2, 42)
    model, labels = ML.train_svm(split.filter("split = 'train'"), n_features=32, max_iter=5)
    pred = ML.svm_predictions(model, labels, split.filter("split = 'test'"))
    return pred.select("vec_id", "label", F.aggregate("probability", F.lit(0.0), lambda s, x: s + x).alias("total"), F.col("prediction").isin(labels).alias("of_known_label"))


@register("mlp_scored", _SEQ_FULL + """,
seqs AS (SELECT session_id, seq_index, max(label) FILTER (step_index = 9) AS label FROM steps GROUP BY 1, 2)
SELECT session_id, seq_index, label, true AS of_known_label
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42' || session_id || ':' || cast(seq_index AS VARCHAR)), session_id || ':' || cast(seq_index AS VARCHAR)) AS k,
             round(count(*) OVER (PARTITION BY label) * 0.2) AS n FROM seqs) WHERE k <= n""")
def q_mlp_scored(spark, sf):
    """The held-out fifth of the sequences, each with a prediction among the labels seen (a small network)."""
    from obslytics.operators import ml as ML
    from obslytics.operators import sequences as SQ
    split = _split_sequences(SQ.sequence_vectors(SQ.sequences(acts_with_k(spark, sf), 10)))
    model = ML.train_mlp(split.filter("split = 'train'"), "label", "features", (4,), 3, 42)
    labels = model.stages[-1].getLabels()
    return model.transform(split.filter("split = 'test'")).select("session_id", "seq_index", "label", F.col("prediction").isin(labels).alias("of_known_label"))
