"""Column expressions for derived fields.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation and are pushed / pruned by Catalyst like any projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslytics import schemas as S


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time features (P2-P8) --------------------------------------------------

def hour(ts="timestamp") -> Column:
    """P2."""
    return F.hour(_c(ts))


def day_name(ts="timestamp") -> Column:
    """English day name."""
    return F.date_format(_c(ts), "EEEE")


def to_date(ts="timestamp") -> Column:
    """P4."""
    return F.to_date(_c(ts))


def iso_week(ts="timestamp") -> Column:
    """P5: ISO week number."""
    return F.weekofyear(_c(ts))


def month(ts="timestamp") -> Column:
    """P6."""
    return F.month(_c(ts))


def is_weekend(ts="timestamp") -> Column:
    """Saturday or Sunday (``weekday``: Monday = 0 ... Sunday = 6)."""
    return F.weekday(_c(ts)) >= 5


def _period_of(h: int, include_midnight: bool) -> str | None:
    if h == 0:
        return "Night" if include_midnight else None
    return S.TIME_PERIODS[(h - 1) // 6]


def time_period(h="hour", include_midnight: bool = False) -> Column:
    """Right-closed bins (0,6] (6,12] (12,18] (18,24]; hour 0 has no period.

    A lookup in a 25-slot array, so the hour expression is evaluated once
    even when Catalyst inlines it into a pushed-down filter.
    """
    slots = F.array(*[F.lit(_period_of(h, include_midnight)).cast("string") for h in range(25)])
    return F.try_element_at(slots, _c(h).cast("int") + 1)


def confidence_band(c="confidence") -> Column:
    """Right-closed bins (0,.7] (.7,.85] (.85,1]; 0 and values above 1 -> NULL."""
    c = _c(c)
    return (F.when((c > 0) & (c <= 0.7), "Low")
            .when((c > 0.7) & (c <= 0.85), "Medium")
            .when((c > 0.85) & (c <= 1.0), "High"))


def add_time_features(df: DataFrame, ts: str = "timestamp", include_midnight: bool = False) -> DataFrame:
    """P2-P8 as columns."""
    return (df.withColumn("hour", hour(ts))
              .withColumn("day_of_week", day_name(ts))
              .withColumn("date", to_date(ts))
              .withColumn("week", iso_week(ts))
              .withColumn("month", month(ts))
              .withColumn("is_weekend", is_weekend(ts))
              .withColumn("time_period", time_period("hour", include_midnight)))


def add_confidence_band(df: DataFrame, col: str = "confidence") -> DataFrame:
    """P9 as a column."""
    return df.withColumn("confidence_category", confidence_band(col))


# --- lookups (P10, P11, P20) -------------------------------------------------

def _lookup(pairs, key: Column) -> Column:
    """Map-literal lookup: one reference to ``key`` (cheap to inline), NULL
    for keys not in the map."""
    m = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return F.try_element_at(m, key)


def category_of(activity="activity_type") -> Column:
    """P10: category from the fixed taxonomy (no join); unmapped types give NULL."""
    return _lookup([(name, cat) for _, name, cat, _, _ in S.TAXONOMY], _c(activity))


def add_category(df: DataFrame, taxonomy: DataFrame | None = None, on: str = "activity_type") -> DataFrame:
    """Left lookup of the behavioural category.

    With a taxonomy DataFrame it is a broadcast hash join: the dimension has
    one row per activity class (15 fixed classes), so its size is bounded by
    construction.  Without one the same mapping is a CASE expression.
    """
    if taxonomy is None:
        return df.withColumn("behavioral_category", category_of(on))
    dim = taxonomy.select(F.col("activity_type").alias(on), "behavioral_category")
    return df.join(F.broadcast(dim), on, "left")


def activity_color(activity="activity_type") -> Column:
    """Display colour of an activity, default grey."""
    pairs = [(name, color) for _, name, _, _, color in S.TAXONOMY]
    return F.coalesce(_lookup(pairs, _c(activity)), F.lit(S.DEFAULT_COLOR))


def category_color(category="behavioral_category") -> Column:
    """Display colour of a category, default grey."""
    return F.coalesce(_lookup(S.CATEGORY_COLORS, _c(category)), F.lit(S.DEFAULT_COLOR))


def is_alertable(activity="activity_type") -> Column:
    """P20."""
    return _c(activity).isin(*S.ALERTABLE)


# --- text (P14-P18, P21, P22) ------------------------------------------------

def fixed(c, places: int) -> Column:
    """Fixed-decimal text of a double, rounded half-up on its decimal form
    (NULL for NaN, infinities or magnitudes beyond 1e14 instead of an error)."""
    return F.round(_c(c).try_cast("decimal(24,10)"), places).cast("string")


def fixed2(c) -> Column:
    return fixed(c, 2)


def description(activity="activity_type", conf="confidence") -> Column:
    """``Detected <type> with <c:.2f> confidence``."""
    return F.format_string(S.DESCRIPTION_FORMAT, _c(activity), fixed2(conf))


def analysis_prompt(activity="activity_type", conf="confidence", desc="description",
                    ts="timestamp") -> Column:
    """Analysis request text."""
    return F.format_string("\n".join(S.ANALYSIS_PROMPT_LINES), _c(activity),
                           fixed(conf, 4), _c(desc), iso_time(ts))


def iso_time(ts="timestamp") -> Column:
    """ISO-8601 like Python's ``isoformat``: the fraction is dropped when zero."""
    t = _c(ts)
    return F.when(F.unix_micros(t) % 1000000 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")) \
            .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def ts_text(ts="timestamp") -> Column:
    """Stable text form used in results: ``yyyy-MM-dd HH:mm:ss.SSSSSS``."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def percent_text(c="confidence") -> Column:
    """``(c*100).toFixed(1) + '%'``."""
    return F.concat(fixed(_c(c) * 100, 1), F.lit("%"))


def display_name(c="activity_type") -> Column:
    """Replace only the first underscore with a space."""
    return F.regexp_replace(_c(c), "^([^_]*)_", "$1 ")


def date_range_text(lo, hi) -> Column:
    """``<lo> to <hi>``."""
    return F.concat_ws(" to ", _c(lo).cast("string"), _c(hi).cast("string"))


def round3(c) -> Column:
    """P23."""
    return F.round(_c(c), 3)


def scaled(c="confidence", factor: float = 1.2) -> Column:
    """Score scaled by a factor."""
    return _c(c) * F.lit(factor)


# --- labels (P19) --------------------------------------------------------------

def label_count(labels="labels") -> Column:
    """Labels per item."""
    return F.size(_c(labels))


def has_label(labels="labels", name: str | None = None) -> Column:
    """Item has any label / a given label."""
    if name is None:
        return F.size(_c(labels)) > 0
    return F.exists(_c(labels), lambda x: x["activity"] == F.lit(name))


# --- binary payloads (S13) ---------------------------------------------------

def decode_payload(c="video_frame") -> Column:
    """base64 text (optionally a ``data:`` URL) to bytes."""
    return F.unbase64(F.regexp_replace(_c(c), "^data:[^,]*,", ""))
