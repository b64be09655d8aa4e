"""Report jobs that write many tables from one analysis frame.

``chart_report`` writes the table behind every chart panel (timeline,
heatmaps, statistics, dashboard, advanced analytics) and a one-row summary
JSON.  Each panel scans only the columns it uses (pushed-down time bound,
pruned columns); copying the whole frame to a checkpoint first would cost a
full extra write at scale, more than the narrow re-scans it saves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslytics.operators import charts as C
from obslytics.operators import jobs as J
from obslytics.operators import summary as SM
from obslytics.session import checkpoint_dir


def chart_panels(df: DataFrame, advanced: bool = True) -> dict[str, DataFrame]:
    """Name -> table for the five chart sets (A9-A22, A27-A30, M4-M6,
    M10, M18-M19); the last set, which fits models, only if ``advanced``."""
    gaps = C.gap_minutes(df)
    return {
        "timeline/daily_counts": C.daily_counts(df),
        "timeline/daily_trend": C.daily_trend(df),
        "timeline/daily_category": C.daily_category(df),
        "timeline/daily_confidence": C.daily_confidence(df),
        "heatmaps/hour_by_weekday": C.hour_by_weekday(df),
        "heatmaps/activity_correlation": C.activity_correlation(df),
        "heatmaps/category_by_period": C.category_by_period(df),
        "heatmaps/confidence_matrix": C.confidence_matrix(df),
        "statistics/confidence_density": C.confidence_density(df),
        "statistics/activity_frequency": C.activity_frequency(df),
        "statistics/hourly_distribution": C.hourly_distribution(df),
        "statistics/confidence_trend": C.confidence_trend(df),
        "statistics/box_by_weekday": C.box_stats(df, "day_of_week"),
        "statistics/gap_histogram": C.gap_histogram(gaps),
        "statistics/gap_stats": C.gap_stats(gaps),
        "dashboard/daily_activity": C.daily_activity(df),
        "dashboard/category_counts": C.category_counts(df),
        "dashboard/box_by_category": C.box_stats(df.filter(F.col("behavioral_category").isNotNull()),
                                                 "behavioral_category"),
        "dashboard/hour_by_activity": C.hour_by_activity(df),
        "dashboard/weekday_by_hour": C.weekday_by_hour(df),
        **(advanced_panels(df) if advanced and _has_rows(df, 10) else {}),
    }


def _has_rows(df: DataFrame, n: int) -> bool:
    """the advanced set needs at least ``n`` rows (as in the reference)."""
    return len(df.limit(n).take(n)) >= n


def advanced_panels(df: DataFrame) -> dict[str, DataFrame]:
    """The advanced-analytics set (M4-M6, M10): PCA loading weights, row
    clusters in PCA space and the confidence regression metrics."""
    from obslytics.operators import ml as ML
    from obslytics.operators import clustering as CL
    rows, centres = ML.projected_clusters(df)
    return {
        "advanced/components": ML.component_rows(CL.components(ML.row_features(df), ML.ROW_FEATURES), df.sparkSession),
        "advanced/cluster_projection": rows,
        "advanced/cluster_centres": centres,
        "advanced/confidence_regression": ML.confidence_regression(df),
    }


def chart_report(df: DataFrame, out_dir: str, advanced: bool = True) -> DataFrame:
    """Write every panel table under ``out_dir`` and the summary JSON
    (A23 plus the number of panel sets written); returns the summary."""
    checkpoint_dir(df.sparkSession)
    base = df
    panels = chart_panels(base, advanced)
    for name, table in panels.items():
        table.write.mode("overwrite").parquet(f"{out_dir}/{name}")
    sets = len({n.split("/")[0] for n in panels})  # 4 when too few rows for the advanced set
    summary = SM.chart_summary(base).withColumn("visualizations_generated", F.lit(sets))
    J.write_report(summary, f"{out_dir}/summary")
    return df.sparkSession.read.json(f"{out_dir}/summary")
