"""Per-activity patterns, behavioural insights and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obslytics import schemas as S
from obslytics.functions import features as X
from obslytics.operators.summary import py_ts_text


def type_profile(df: DataFrame) -> DataFrame:
    """Patterns plus first/last time per type: one aggregate that both the
    pattern list and the report's data summary are derived from (one scan)."""
    n = F.count(F.lit(1))
    span = F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))
    return (df.groupBy("activity_type").agg(
        n.alias("frequency"),
        F.avg("confidence").alias("avg_confidence"),
        F.when(n < 2, F.lit(5.0)).otherwise(span / (n - 1) / F.lit(60_000_000.0)).alias("duration_minutes"),
        F.coalesce(F.mode(X.hour("timestamp"), True), F.lit(12)).alias("time_of_day"),
        F.min("behavioral_category").alias("behavioral_category"),
        F.min("timestamp").alias("t_min"), F.max("timestamp").alias("t_max"),
        # A4 clustering features ride along in the same aggregate
        F.stddev_samp("confidence").alias("confidence_std"),
        F.avg(X.hour("timestamp")).alias("hour_mean"), F.stddev_samp(X.hour("timestamp")).alias("hour_std"),
    ))


_PROFILE_ONLY = ["t_min", "t_max", "confidence_std", "hour_mean", "hour_std"]


def _summary_exprs() -> list[F.Column]:
    return [F.coalesce(F.sum("frequency"), F.lit(0)).cast("long").alias("total_activities"),
            F.coalesce(F.concat_ws(" to ", py_ts_text(F.min("t_min")), py_ts_text(F.max("t_max"))),
                       F.lit("No data")).alias("date_range"),
            F.count("activity_type").alias("unique_activity_types")]


def profile_summary(profile: DataFrame) -> DataFrame:
    """A26/P22 from the type profile: count, time range text, distinct types."""
    return profile.agg(*_summary_exprs())


def patterns(df: DataFrame) -> DataFrame:
    """One row per activity type.

    ``duration_minutes`` is the mean gap between successive events of the
    type.  The mean of consecutive differences telescopes to
    ``(last - first) / (n - 1)``, so no sort or window is needed; 5.0 when
    there are fewer than two events.  ``time_of_day`` is the modal hour,
    lowest on ties, 12 when there is none.
    """
    return type_profile(df).drop(*_PROFILE_ONLY)


def ranked_patterns(p: DataFrame) -> DataFrame:
    """Patterns in report order: frequency descending, then type (tie key)."""
    return p.orderBy(F.col("frequency").desc(), F.col("activity_type").asc())


def top_patterns(p: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent patterns, confidence rounded to 3."""
    return ranked_patterns(p).limit(n).select(
        F.col("activity_type").alias("activity"), "frequency",
        X.round3("avg_confidence").alias("confidence"),
        F.col("behavioral_category").alias("category"))


def pattern_progress(p: DataFrame, n: int | None = None) -> DataFrame:
    """Position and percent complete of each pattern in report order,
    optionally over the first ``n`` patterns only (the demo streams three).

    ``p`` has one row per activity type (a small, bounded table), so one
    ordered window over it is cheap.
    """
    if n is not None:
        p = ranked_patterns(p).limit(n)
    w = Window.orderBy(F.col("frequency").desc(), F.col("activity_type").asc())
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return p.select((F.row_number().over(w) - 1).alias("index"), "activity_type",
                    F.round((F.row_number().over(w) / total) * 100, 2).alias("percentage_complete"))


def risk_level(category="category", frequency="total_occurrences", confidence="mean_confidence") -> F.Column:
    """A7 rules on the unrounded mean confidence."""
    cat, n, c = F.col(category), F.col(frequency), F.col(confidence)
    return (F.when(cat == "Concerning",
                   F.when((n > 5) & (c > 0.8), "High").when((n > 2) & (c > 0.7), "Medium").otherwise("Low"))
             .when(cat == "Stimming", F.when(n > 10, "Medium").otherwise("Low"))
             .otherwise("Low"))


def insights(p: DataFrame) -> DataFrame:
    """One row per behavioural category (NULL is its own group).

    The mean confidence is the unweighted mean of the per-type means.
    ``dominant_activities`` are the two most frequent types (ties by name);
    a category holds at most one row per activity type, so the sorted
    array is bounded by the number of types.
    """
    g = (p.groupBy(F.col("behavioral_category").alias("category")).agg(
        F.sum("frequency").alias("total_occurrences"),
        F.avg("avg_confidence").alias("mean_confidence"),
        F.count(F.lit(1)).alias("activity_count"),
        F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("k"),
                                             F.col("activity_type").alias("t")))).alias("_ranked")))
    return g.select(
        "category", "total_occurrences",
        F.round("mean_confidence", 3).alias("average_confidence"),
        "activity_count",
        F.array_join(F.transform(F.slice("_ranked", 1, 2), lambda x: x["t"]), ", ").alias("dominant_activities"),
        risk_level().alias("risk_level"))


def _insight_exprs() -> list[F.Column]:
    null_safe = F.coalesce(F.col("behavioral_category"), F.lit("\u0000"))
    return [F.count(F.lit(1)).alias("total_patterns"),
            F.min_by(F.col("activity_type"),
                     F.struct((-F.col("frequency")).alias("k"), F.col("activity_type").alias("t"))
                     ).alias("most_frequent_activity"),
            F.round(F.avg("avg_confidence"), 3).alias("overall_confidence"),
            F.count_distinct(null_safe).alias("behavioral_diversity"),
            F.count_if(F.col("behavioral_category") == "Concerning").alias("concerning_behaviors")]


def insight_summary(p: DataFrame) -> DataFrame:
    """Summary over all patterns (one row)."""
    return p.agg(*_insight_exprs())


def recommendations(p: DataFrame) -> DataFrame:
    """Recommendation texts in fixed order, one row each (position from 0).

    The presence flags come from one global aggregate over the patterns.
    """
    cat = F.col("behavioral_category")
    flags = p.agg(
        F.count_if(cat == "Concerning").alias("concerning"),
        F.count_if(cat == "Stimming").alias("stimming"),
        F.count_if(cat == "Therapeutic").alias("therapeutic"),
        F.count_if(cat == "Active").alias("active"),
        F.count_if(cat == "Calm").alias("calm"))
    r = S.RECOMMENDATIONS
    texts = F.array_compact(F.array(
        F.when(F.col("concerning") > 2, F.lit(r[0])),
        F.when(F.col("concerning") > 0, F.lit(r[1])),
        F.when(F.col("stimming") > 0, F.lit(r[2])),
        F.when(F.col("stimming") > 0, F.lit(r[3])),
        F.when(F.col("therapeutic") > 0, F.lit(r[4])),
        F.when((F.col("active") > 0) & (F.col("calm") > 0), F.lit(r[5]))))
    return flags.select(F.posexplode(texts).alias("position", "recommendation"))


def concerning_alert(p: DataFrame, threshold: int = 1) -> DataFrame:
    """An alert row when more than ``threshold`` Concerning types occur."""
    s = insight_summary(p)
    return (s.filter(F.col("concerning_behaviors") > threshold)
             .select(F.lit("Concerning Activity Alert").alias("subject"),
                     F.format_string("Detected %d concerning behavioral patterns",
                                     F.col("concerning_behaviors")).alias("message"),
                     "concerning_behaviors"))


def analysis_report(df: DataFrame) -> DataFrame:
    """The report as one row of nested columns (for ``write_report``)."""
    # the per-type profile (one row per type) feeds every section; it is
    # checkpointed once so the rows are scanned once for the whole report
    from obslytics.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    prof = type_profile(df).checkpoint(eager=True)
    p = prof.drop(*_PROFILE_ONLY)
    data = profile_summary(prof)
    pats = p.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("frequency")).alias("_k"), "activity_type", "frequency",
        X.round3("avg_confidence").alias("avg_confidence"), "behavioral_category")
    )).alias("activity_patterns"))
    summ = insight_summary(p)
    ins = insights(p).agg(F.collect_list(F.struct("*")).alias("insights"))
    rec = recommendations(p).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "recommendation"))),
                                             lambda x: x["recommendation"]).alias("recommendations"))
    clus = _clustering_section(prof)
    meta = df.sparkSession.range(1).select(F.struct(
        F.lit(df.sparkSession.version).alias("spark_version"),
        F.array(*[F.lit(n) for n in ("read_activities", "patterns", "cluster_activities", "insights")])
        .alias("analysis_functions_used")).alias("m")).select(F.to_json("m").alias("v"))
    # Each part is a single-row aggregate; stack them by position instead of joining.
    parts = [data.select(F.to_json(F.struct("*")).alias("v")),
             pats.select(F.to_json(F.struct(F.transform("activity_patterns", lambda x: x.dropFields("_k"))
                                            .alias("activity_patterns"))).alias("v")),
             summ.select(F.to_json(F.struct("*")).alias("v")),
             ins.select(F.to_json(F.struct("*")).alias("v")),
             rec.select(F.to_json(F.struct("*")).alias("v")),
             clus, meta]
    names = ["data_summary", "activity_patterns", "summary", "behavioral_insights", "recommendations",
             "clustering_analysis", "analysis_metadata"]
    stacked = None
    for name, part in zip(names, parts):
        part = part.select(F.lit(name).alias("section"), "v")
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.agg(F.map_from_entries(F.collect_list(F.struct("section", "v"))).alias("report"))


def report_rows(spark, path: str) -> DataFrame:
    """S7 read back: a row (section, place, name, value) for each pattern, insight summary field, recommendation and
    cluster assignment of a report that ``write_report`` stored as JSON."""
    stored = spark.read.schema("report map<string,string>").json(path)
    part = lambda name, kind: F.from_json(F.col("report")[name], kind)
    pats = stored.select(F.posexplode(part("activity_patterns", "activity_patterns array<struct<activity_type:string,frequency:long>>")["activity_patterns"])
                         .alias("place", "p")).select(F.lit("activity_patterns").alias("section"), "place", F.col("p.activity_type").alias("name"),
                                                      F.col("p.frequency").cast("string").alias("value"))
    fields = ("total_patterns", "most_frequent_activity", "behavioral_diversity", "concerning_behaviors")
    summary = stored.select(part("summary", ", ".join(f"{f} string" for f in fields)).alias("s"))
    summary = summary.select(F.posexplode(F.array(*(F.struct(F.lit(f).alias("name"), F.col("s")[f].alias("value")) for f in fields))).alias("place", "f")) \
        .select(F.lit("summary").alias("section"), "place", "f.name", "f.value")
    advice = stored.select(F.posexplode(part("recommendations", "recommendations array<string>")["recommendations"]).alias("place", "value")) \
        .select(F.lit("recommendations").alias("section"), "place", F.lit(None).cast("string").alias("name"), "value")
    clusters = stored.select(F.explode(part("clustering_analysis", "activity_clusters map<string,int>")["activity_clusters"]).alias("name", "value")) \
        .select(F.lit("clustering_analysis").alias("section"), F.lit(0).alias("place"), "name", F.col("value").cast("string").alias("value"))
    return pats.unionByName(summary).unionByName(advice).unionByName(clusters)


def _clustering_section(prof: DataFrame) -> DataFrame:
    """M2 inside the report: k-means on the per-type features taken from the
    profile (no extra scan).  Fewer than two types gives an ``error`` entry,
    as in the reference."""
    from obslytics.operators import filters as FL
    from obslytics.operators import ml as ML
    feats = prof.select("activity_type", F.col("avg_confidence").alias("confidence_mean"), "confidence_std",
                        "hour_mean", "hour_std", F.col("frequency").cast("double").alias("timestamp_count")
                        ).na.fill(0.0)
    spark = prof.sparkSession
    try:
        assign, centers, inertia = ML.cluster_activities(None, 3, features=feats)
    except FL.InsufficientData:
        return spark.range(1).select(F.to_json(F.struct(F.lit("Insufficient data for clustering").alias("error")))
                                     .alias("v"))
    clusters = assign.agg(F.map_from_entries(F.collect_list(
        F.when(F.col("activity_type").isNotNull(), F.struct("activity_type", "cluster")))).alias("activity_clusters"))
    return clusters.select(F.to_json(F.struct(
        F.lit(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])).alias("cluster_centers"),
        "activity_clusters", F.lit(float(inertia)).alias("inertia"))).alias("v"))


def report_flat(df: DataFrame) -> DataFrame:
    """S7 in flat form: the scalar fields of the analysis report (one row)."""
    # one aggregate over the per-type profile: a single scan of the rows
    return type_profile(df).agg(*_summary_exprs(), *_insight_exprs())
