"""Fluent chain (U1/U2) and SQL-callable rules.

The reference's method-chained analysis becomes plain ``DataFrame -> DataFrame``
functions composed with ``DataFrame.transform``; every step returns a new
immutable plan, and the whole chain is optimised by Catalyst as one query.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from obslytics import schemas as S
from obslytics.functions import features as X
from obslytics.operators import charts as C
from obslytics.operators import filters as FL


def filter_by_confidence(min_confidence: float = 0.7):
    return partial(FL.min_confidence, threshold=min_confidence)


def filter_by_activity_type(types):
    return partial(FL.activity_types, types=types)


def add_time_features(df: DataFrame) -> DataFrame:
    """Weekend flag and time period (hour is already present)."""
    return df.withColumn("is_weekend", X.is_weekend("timestamp")).withColumn("time_period", X.time_period("hour"))


def aggregate_by_date(df: DataFrame) -> DataFrame:
    """Per-date count, mean, and the modal category via built-in ``mode``
    (no Python aggregate)."""
    return C.by_date(df)


def fluent_by_date(df: DataFrame, min_confidence: float = 0.7, types=None) -> DataFrame:
    """filter_by_confidence -> filter_by_activity_type -> add_time_features
    -> aggregate_by_date."""
    out = df.transform(filter_by_confidence(min_confidence))
    if types is not None:
        out = out.transform(filter_by_activity_type(types))
    return out.transform(add_time_features).transform(aggregate_by_date)


def _case(col: str, pairs, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in pairs)
    return f"CASE {whens} ELSE {default} END"


def register_sql_functions(spark: SparkSession) -> list[str]:
    """The categorisation rules as session SQL functions (SQL bodies, no
    Python at run time): time_period, confidence_band, behavioral_category,
    risk_level."""
    cat = _case("activity", [(a, c) for _, a, c, _, _ in S.TAXONOMY])
    stmts = {
        "time_period": """CREATE OR REPLACE TEMPORARY FUNCTION time_period(h INT) RETURNS STRING
            RETURN CASE WHEN h > 0 AND h <= 6 THEN 'Night' WHEN h > 6 AND h <= 12 THEN 'Morning'
                        WHEN h > 12 AND h <= 18 THEN 'Afternoon' WHEN h > 18 AND h <= 24 THEN 'Evening' END""",
        "confidence_band": """CREATE OR REPLACE TEMPORARY FUNCTION confidence_band(c DOUBLE) RETURNS STRING
            RETURN CASE WHEN c > 0 AND c <= 0.7 THEN 'Low' WHEN c > 0.7 AND c <= 0.85 THEN 'Medium'
                        WHEN c > 0.85 AND c <= 1.0 THEN 'High' END""",
        "behavioral_category": f"""CREATE OR REPLACE TEMPORARY FUNCTION behavioral_category(activity STRING)
            RETURNS STRING RETURN {cat}""",
        "risk_level": """CREATE OR REPLACE TEMPORARY FUNCTION risk_level(category STRING, n BIGINT, c DOUBLE)
            RETURNS STRING RETURN CASE
              WHEN category = 'Concerning' THEN CASE WHEN n > 5 AND c > 0.8 THEN 'High'
                                                     WHEN n > 2 AND c > 0.7 THEN 'Medium' ELSE 'Low' END
              WHEN category = 'Stimming' THEN CASE WHEN n > 10 THEN 'Medium' ELSE 'Low' END
              ELSE 'Low' END""",
    }
    for sql in stmts.values():
        spark.sql(sql)
    return list(stmts)

