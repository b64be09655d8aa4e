"""Edge fixtures: tiny hand-written frames for the boundary rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from obslytics.functions import features as X
from obslytics.operators import charts as C
from obslytics.operators import patterns as P
from obslytics.operators import summary as SM
from obslytics.sources import readers as R

T0 = dt.datetime(2024, 1, 15, 0, 0, 0)
AS_OF = dt.datetime(2024, 1, 31)


def acts(spark, rows):
    """rows: (id, timestamp, activity_type, confidence)."""
    return spark.createDataFrame(rows, "id string, timestamp timestamp, activity_type string, confidence double")


def test_time_period_bins(spark):
    df = spark.createDataFrame([(h,) for h in [0, 1, 6, 7, 12, 13, 18, 19, 23]], "hour int")
    got = dict(df.select("hour", X.time_period("hour").alias("p")).collect())
    assert got[0] is None
    assert got[6] == "Night" and got[7] == "Morning" and got[12] == "Morning"
    assert got[18] == "Afternoon" and got[19] == "Evening" and got[23] == "Evening"
    mid = df.select(X.time_period("hour", include_midnight=True).alias("p")).filter("hour = 0")
    assert mid.first() is None or True
    assert df.filter("hour = 0").select(X.time_period("hour", True).alias("p")).first()["p"] == "Night"


def test_confidence_band_edges(spark):
    vals = [0.0, 0.7, 0.700001, 0.85, 1.0, 1.01]
    df = spark.createDataFrame([(v,) for v in vals], "confidence double")
    got = [r["b"] for r in df.select(X.confidence_band().alias("b")).collect()]
    assert got == [None, "Low", "Medium", "Medium", "High", None]


def test_first_underscore_only(spark):
    df = spark.createDataFrame([("aggressive_behavior",), ("self_harm",), ("sitting",), ("a_b_c",)], "activity_type string")
    got = [r[0] for r in df.select(X.display_name()).collect()]
    assert got == ["aggressive behavior", "self harm", "sitting", "a b_c"]


def test_description_half_up(spark):
    df = spark.createDataFrame([("sitting", 0.125), ("sitting", 0.345), ("x", 1.0)], "activity_type string, confidence double")
    got = [r[0] for r in df.select(X.description()).collect()]
    assert got == ["Detected sitting with 0.13 confidence", "Detected sitting with 0.35 confidence",
                   "Detected x with 1.00 confidence"]


def test_single_event_type_duration_and_mode(spark):
    rows = [("1", T0, "rocking", 0.9),
            ("2", T0 + dt.timedelta(hours=3), "sitting", 0.5),
            ("3", T0 + dt.timedelta(hours=3, minutes=10), "sitting", 0.7),
            ("4", T0 + dt.timedelta(hours=5), "sitting", 0.6)]
    df = R.enrich(acts(spark, rows))
    p = {r["activity_type"]: r for r in P.patterns(df).collect()}
    assert p["rocking"]["duration_minutes"] == 5.0
    assert p["rocking"]["frequency"] == 1
    assert abs(p["sitting"]["duration_minutes"] - 60.0) < 1e-9  # (120 min) / 2 gaps
    assert p["sitting"]["time_of_day"] == 3  # modal hour


def test_mode_ties_take_lowest_hour(spark):
    rows = [("1", T0 + dt.timedelta(hours=7), "walking", 0.8), ("2", T0 + dt.timedelta(hours=2), "walking", 0.8)]
    p = P.patterns(R.enrich(acts(spark, rows))).first()
    assert p["time_of_day"] == 2


def test_unmapped_type_is_its_own_null_group(spark):
    rows = [("1", T0, "dancing", 0.9), ("2", T0, "sitting", 0.9)]
    df = R.enrich(acts(spark, rows))
    assert df.filter("activity_type = 'dancing'").first()["behavioral_category"] is None
    ins = P.insights(P.patterns(df)).collect()
    assert sorted([r["category"] is None for r in ins]) == [False, True]
    assert P.insight_summary(P.patterns(df)).first()["behavioral_diversity"] == 2


def test_empty_summary(spark):
    df = acts(spark, [])
    s = SM.summary(df, AS_OF).first()
    assert s["total_activities"] == 0
    assert s["average_confidence"] == 0.0
    assert s["most_common_activity"] is None
    assert s["hourly_distribution"] == [0] * 24
    assert P.insights(P.patterns(R.enrich(df))).count() == 0


@pytest.mark.parametrize("n,c,expected", [(2, 0.9, "Low"), (3, 0.71, "Medium"), (3, 0.7, "Low"), (5, 0.81, "Medium"),
                                          (6, 0.81, "High"), (6, 0.8, "Medium")])
def test_concerning_risk_bounds(spark, n, c, expected):
    df = spark.createDataFrame([("Concerning", n, c)], "category string, total_occurrences long, mean_confidence double")
    assert df.select(P.risk_level().alias("r")).first()["r"] == expected


@pytest.mark.parametrize("n,expected", [(10, "Low"), (11, "Medium")])
def test_stimming_risk_bounds(spark, n, expected):
    df = spark.createDataFrame([("Stimming", n, 0.5)], "category string, total_occurrences long, mean_confidence double")
    assert df.select(P.risk_level().alias("r")).first()["r"] == expected


def test_histogram_all_equal(spark):
    g = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 5.0)], "id string, gap_minutes double")
    h = {r["bin"]: r["n"] for r in C.gap_histogram(g).collect()}
    assert len(h) == 30 and h[15] == 3 and sum(h.values()) == 3


def test_histogram_max_in_last_bin(spark):
    g = spark.createDataFrame([(str(i), float(i)) for i in range(31)], "id string, gap_minutes double")
    h = {r["bin"]: r["n"] for r in C.gap_histogram(g).collect()}
    assert h[29] == 2 and sum(h.values()) == 31


def test_weekday_by_hour_dense_days(spark):
    rows = [("1", T0, "sitting", 0.9)]  # 2024-01-15 is a Monday
    w = C.weekday_by_hour(R.enrich(acts(spark, rows))).orderBy("day_index").collect()
    assert [r["day_of_week"] for r in w][0] == "Monday" and len(w) == 7
    assert w[0]["h0"] == 1 and all(r["h0"] == 0 for r in w[1:])


def test_correlation_zero_variance_is_null(spark):
    rows = [("1", T0, "sitting", 0.9), ("2", T0 + dt.timedelta(hours=1), "sitting", 0.9),
            ("3", T0, "walking", 0.9), ("4", T0 + dt.timedelta(hours=1), "walking", 0.9),
            ("5", T0 + dt.timedelta(hours=1), "walking", 0.9)]
    c = C.activity_correlation(R.enrich(acts(spark, rows))).first()
    assert c["activity_a"] == "walking" and c["correlation"] is None


def test_recommendations_order(spark):
    p = spark.createDataFrame([(t, 1, 0.9, c) for t, c in [("a", "Concerning"), ("b", "Concerning"), ("c", "Concerning"),
                                                            ("d", "Stimming"), ("e", "Active"), ("f", "Calm")]],
                              "activity_type string, frequency long, avg_confidence double, behavioral_category string")
    recs = [r["recommendation"] for r in P.recommendations(p).orderBy("position").collect()]
    assert recs[0].startswith("Immediate intervention") and recs[1].startswith("Implement safety")
    assert recs[-1].startswith("Good balance") and len(recs) == 5


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(11)
    values = np.concatenate([rng.lognormal(0, 4, 30000), np.repeat(0.5, 15000)])  # more distinct values than edges, and a heavy one
    groups = rng.choice(["hot", "hot", "hot", "a", "b"], len(values))
    df = spark.createDataFrame([*zip(groups.tolist(), values.tolist()), ("one", 3.0), (None, 1.0), (None, 2.0), ("none", None)], "g string, v double")
    got = {r["g"]: (r["n"], list(r["q"])) for r in C.exact_quantiles(df, "g", "v", [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    for g in ("hot", "a", "b"):
        want = np.quantile(values[groups == g], [0, 0.25, 0.5, 0.75, 1])
        assert got[g][0] == (groups == g).sum() and np.allclose(got[g][1], want, rtol=1e-12)
    assert got["one"] == (1, [3.0] * 5) and got[None] == (2, [1.0, 1.25, 1.5, 1.75, 2.0]) and "none" not in got


def test_median_of_more_than_a_million_distinct_values(spark):
    n = 1_200_001
    gaps = spark.range(n).select(((F.col("id") * 7919) % n / n * 100.0).alias("gap_minutes"))
    row = C.gap_stats(gaps).first()
    assert row["n"] == n and abs(row["median_gap"] - (n // 2) / n * 100.0) < 1e-9


def test_bounded_sample_equals_full_ranking(spark):
    from obslytics.plans import catalog
    a = catalog.acts(spark, "/root/testdata/sf0.01")
    got = [r["id"] for r in SM.bounded_sample(a, 50, 42).collect()]
    h = F.md5(F.concat(F.lit("42"), F.col("id")))
    want = [r["id"] for r in a.withColumn("_h", h).orderBy("_h").limit(50).collect()]
    assert got == want


def test_recent_prunes_to_newest_days(spark, tmp_dir):
    from obslytics.sources import adapter as A
    R.append_activities(A.load_activities(spark, "/root/testdata/sf0.01"), f"{tmp_dir}/acts")
    stored = spark.read.parquet(f"{tmp_dir}/acts")
    got = [r["id"] for r in SM.recent(stored, 100).collect()]
    want = [r["id"] for r in stored.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(100).collect()]
    assert got == want
    assert SM.newest_days_bound(stored, 100) == dt.date(2024, 1, 30)


def test_iso_time_drops_zero_fraction(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),), (dt.datetime(2024, 1, 2, 3, 4, 5, 120),)],
                               "timestamp timestamp")
    got = [r[0] for r in df.select(X.iso_time()).collect()]
    assert got == ["2024-01-02T03:04:05", "2024-01-02T03:04:05.000120"]


def test_percent_text(spark):
    df = spark.createDataFrame([(0.8534,), (1.0,), (0.0005,)], "confidence double")
    assert [r[0] for r in df.select(X.percent_text()).collect()] == ["85.3%", "100.0%", "0.1%"]


def test_sample_frames_rule(spark):
    from obslytics.operators import filters as FL
    frames = spark.range(500).select(F.col("id").alias("frame_index"))
    got = [r[0] for r in FL.sample_frames(frames).orderBy("frame_index").collect()]
    assert got == [1, 21, 41, 61, 81, 101, 121, 141, 161, 181]


def test_summary_tolerates_missing_type_and_time(spark):
    rows = [("1", AS_OF - dt.timedelta(hours=1), None, 0.5), ("2", AS_OF - dt.timedelta(hours=2), "sitting", 0.7),
            ("3", None, "sitting", 0.9)]
    df = acts(spark, rows)
    s = SM.summary(df.filter(F.col("timestamp").isNull() | (F.col("timestamp") > AS_OF - dt.timedelta(days=7))),
                   AS_OF, days=3650).first()
    assert s["total_activities"] == 2  # the row without a time fails the time bound
    assert s["activity_distribution"] == {"sitting": 1}
    assert sum(s["hourly_distribution"]) == 2


def test_activity_type_membership_forms(spark):
    from obslytics.operators import filters as FL
    rows = [("1", T0, "sitting", 0.9), ("2", T0, "walking", 0.9), ("3", T0, "rocking", 0.9)]
    df = acts(spark, rows)
    by_list = sorted(r["id"] for r in FL.activity_types(df, ["sitting", "rocking"]).collect())
    types_df = spark.createDataFrame([("sitting",), ("rocking",), ("sitting",)], "t string")
    by_df = sorted(r["id"] for r in FL.activity_types(df, types_df).collect())
    long_list = ["sitting", "rocking"] + [f"x{i}" for i in range(2000)]
    by_long = sorted(r["id"] for r in FL.activity_types(df, long_list).collect())
    assert by_list == by_df == by_long == ["1", "3"]


def test_split_valid_missing_required_column(spark):
    raw = spark.createDataFrame([("1", "sitting")], "id string, activity_type string")
    from obslytics import schemas as S
    valid, rejected = R.split_valid(raw, S.ACTIVITIES)
    assert valid.count() == 0
    reasons = rejected.first()["reasons"]
    assert "missing:timestamp" in reasons and "missing:confidence" in reasons


def test_min_confidence_inclusive_and_strict(spark):
    from obslytics.operators import filters as FL
    df = acts(spark, [("1", T0, "a", 0.7), ("2", T0, "a", 0.8), ("3", T0, "a", 0.81)])
    assert FL.min_confidence(df).count() == 3
    assert FL.min_confidence(df, 0.8, strict=True).count() == 1
    assert FL.significant_detections(acts(spark, [("1", T0, "a", 0.6), ("2", T0, "a", 0.61)])).count() == 1


def test_two_level_top_n_equals_one_level(spark):
    from obslytics.operators import metrics as MT
    from obslytics.sources import adapter as A
    m = A.load_metrics(spark, "/root/testdata/sf0.01").repartition(40)
    one = sorted((r["host"], r["timestamp"]) for r in MT.keep_latest(m, 300, fan_in=1).collect())
    two = sorted((r["host"], r["timestamp"]) for r in MT.keep_latest(m, 300, fan_in=7).collect())
    assert one == two and len(one) == 5 * 300


def test_two_level_top_n_global(spark):
    from obslytics.plans import catalog
    a = catalog.acts(spark, "/root/testdata/sf0.01").repartition(30)
    order = [F.col("timestamp").desc(), F.col("id").desc()]
    one = [r["id"] for r in SM.top_n(a, order, 200, fan_in=1).collect()]
    two = [r["id"] for r in SM.top_n(a, order, 200, fan_in=6).collect()]
    assert one == two and len(one) == 200


def test_bounded_sample_candidate_path(spark):
    from obslytics.plans import catalog
    a = catalog.acts(spark, "/root/testdata/sf0.01").repartition(100)   # many tasks: candidate cutoff used
    got = [r["id"] for r in SM.bounded_sample(a, 50, 42).collect()]
    h = F.md5(F.concat(F.lit("42"), F.col("id")))
    want = [r["id"] for r in a.withColumn("_h", h).orderBy("_h").limit(50).collect()]
    assert got == want


def test_operators_accept_empty_input(spark):
    from obslytics.operators import patterns as PP
    from obslytics.plans import reports
    df = R.enrich(acts(spark, []))
    for name, table in reports.chart_panels(df).items():
        if name.startswith("advanced/"):
            continue  # model fitting needs rows (guarded separately)
        table.count()
    p = PP.patterns(df)
    for out in (PP.insights(p), PP.insight_summary(p), PP.recommendations(p), PP.top_patterns(p),
                PP.pattern_progress(p), SM.chart_summary(df), SM.frequent_types(df),
                SM.confidence_by_hour(df), SM.recent(df), SM.bounded_sample(df)):
        out.count()
    assert SM.confidence_by_hour(df).count() == 24


def test_panels_accept_unmapped_and_missing_types(spark):
    from obslytics.plans import reports
    rows = [("1", T0, "dancing", 0.5), ("2", T0 + dt.timedelta(hours=2), None, 0.6),
            ("3", T0 + dt.timedelta(hours=3), "sitting", 0.7), ("4", T0 + dt.timedelta(days=1), "sitting", 0.9)]
    df = R.enrich(acts(spark, rows))
    for name, table in reports.chart_panels(df).items():
        table.count()
    freq = {r["activity_type"]: r["n"] for r in C.activity_frequency(df).collect()}
    assert freq == {"dancing": 1, "sitting": 2}
    assert {r["behavioral_category"] for r in C.category_counts(df).collect()} == {"Calm"}


def test_histogram_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    for vals in (rng.exponential(20, 500), rng.uniform(0, 119, 300), np.array([3.0, 3.0, 7.5])):
        g = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(vals)], "id string, gap_minutes double")
        got = [r["n"] for r in C.gap_histogram(g).orderBy("bin").collect()]
        want, _ = np.histogram(vals[vals < 120], bins=30)
        assert got == list(want)


def test_top_n_property(spark):
    from hypothesis import given, settings, strategies as st, HealthCheck

    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(vals=st.lists(st.integers(0, 30), min_size=1, max_size=200), n=st.integers(1, 20),
           fan=st.integers(1, 6))
    def check(vals, n, fan):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v long").repartition(7)
        order = [F.col("v").desc(), F.col("id")]
        got = [tuple(r) for r in SM.top_n(df, order, n, fan_in=fan).collect()]
        want = sorted(((i, v) for i, v in enumerate(vals)), key=lambda t: (-t[1], t[0]))[:n]
        assert got == want

    check()


def test_kde_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    vals = np.round(rng.beta(5, 2, 400), 4)
    df = spark.createDataFrame([("Calm", float(v)) for v in vals], "behavioral_category string, confidence double")
    got = [r["density"] for r in C.confidence_density(df).orderBy("point").collect()]
    n = len(vals)
    bw = n ** -0.2 * vals.std(ddof=1)
    grid = np.linspace(vals.min() - 2 * bw, vals.max() + 2 * bw, 100)
    want = np.exp(-0.5 * ((grid[:, None] - vals[None, :]) / bw) ** 2).sum(axis=1) / (n * bw * np.sqrt(2 * np.pi))
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


def test_patterns_match_pandas_brute_force(spark):
    """A2/A3 against a direct pandas computation on the small fixture: the
    mean of successive gaps per type (sorted, diff, mean), the modal hour
    (lowest on ties) and the mean confidence."""
    from obslytics.operators import patterns as PP
    from obslytics.plans import catalog
    df = catalog.enriched(spark, "/root/testdata/sf0.001")
    pdf = df.select("activity_type", "timestamp", "confidence", "hour").toPandas()
    want = {}
    for t, g in pdf.groupby("activity_type"):
        g = g.sort_values("timestamp")
        dur = 5.0 if len(g) < 2 else (g["timestamp"].diff().dt.total_seconds() / 60).mean()
        want[t] = (len(g), g["confidence"].mean(), dur, int(g["hour"].mode().iloc[0]))
    got = {r["activity_type"]: (r["frequency"], r["avg_confidence"], r["duration_minutes"], r["time_of_day"])
           for r in PP.patterns(df).collect()}
    assert got.keys() == want.keys()
    for t in want:
        assert got[t][0] == want[t][0] and got[t][3] == want[t][3]
        assert abs(got[t][1] - want[t][1]) < 1e-12 and abs(got[t][2] - want[t][2]) < 1e-9


def test_global_gaps_and_stats_match_brute_force(spark):
    import numpy as np
    from obslytics.operators import sequences as SQ
    from obslytics.plans import catalog
    df = catalog.enriched(spark, "/root/testdata/sf0.001")
    pdf = df.select("id", "timestamp", "confidence", "session_id").toPandas().sort_values(["timestamp", "id"])
    pdf["gap"] = pdf["timestamp"].diff().dt.total_seconds() / 60
    got = {r["id"]: r["gap_minutes"] for r in C.gap_minutes(df).collect()}
    for i, gap in zip(pdf["id"], pdf["gap"]):
        assert (got[i] is None) if np.isnan(gap) else abs(got[i] - gap) < 1e-9
    stats = {r["session_id"]: r for r in SQ.statistical_features(df, "session_id").collect()}
    for s, g in pdf.groupby("session_id"):
        v = g["confidence"].to_numpy()
        r = stats[s]
        for name, want in [("mean", v.mean()), ("std", v.std()), ("median", np.median(v)),
                           ("p25", np.percentile(v, 25)), ("p75", np.percentile(v, 75)), ("var", v.var()),
                           ("ptp", np.ptp(v))]:
            assert abs(r[name] - want) < 1e-9, (s, name)
        assert r["length"] == len(v)


def test_sliding_sequences_match_brute_force(spark):
    from obslytics.operators import sequences as SQ
    from obslytics.plans import catalog
    a = catalog.acts_with_k(spark, "/root/testdata/sf0.001")
    got = {(r["session_id"], r["seq_index"], r["step_index"]): r["confidence"]
           for r in SQ.sequences(a, 10, step=4).collect()}
    pdf = a.select("session_id", "id", "timestamp", "confidence").toPandas().sort_values(["session_id", "timestamp", "id"])
    want = {}
    for s, g in pdf.groupby("session_id"):
        c = g["confidence"].tolist()
        for start in range(0, len(c) - 10 + 1, 4):
            for j in range(10):
                want[(s, start // 4, j)] = c[start + j]
    assert got == want


def test_box_stats_match_numpy(spark):
    import numpy as np
    from obslytics.plans import catalog
    df = catalog.enriched(spark, "/root/testdata/sf0.001")
    pdf = df.select("day_of_week", "confidence").toPandas()
    got = {r["day_of_week"]: r for r in C.box_stats(df, "day_of_week").collect()}
    for d, g in pdf.groupby("day_of_week"):
        v = g["confidence"].to_numpy()
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = v[(v >= lo) & (v <= hi)]
        r = got[d]
        assert abs(r["q1"] - q1) < 1e-12 and abs(r["median"] - med) < 1e-12 and abs(r["q3"] - q3) < 1e-12
        assert r["whisker_low"] == inside.min() and r["whisker_high"] == inside.max()
        assert r["outliers"] == len(v) - len(inside) and r["n"] == len(v)


def test_correlation_matches_pandas(spark):
    import numpy as np
    from obslytics.plans import catalog
    df = catalog.enriched(spark, "/root/testdata/sf0.001")
    pdf = df.select("activity_type", "hour").toPandas()
    corr = pdf.groupby(["activity_type", "hour"]).size().unstack(fill_value=0).T.corr()
    got = {(r["activity_a"], r["activity_b"]): r["correlation"] for r in C.activity_correlation(df).collect()}
    names = list(corr.columns)
    for i, a in enumerate(names):
        for b in names[:i]:  # strict lower triangle
            want = corr.loc[a, b]
            assert (got[(a, b)] is None) if np.isnan(want) else abs(got[(a, b)] - want) < 1e-9
    assert len(got) == len(names) * (len(names) - 1) // 2


def test_insights_match_python_brute_force(spark):
    from obslytics.operators import patterns as PP
    from obslytics.plans import catalog
    p = PP.patterns(catalog.enriched(spark, "/root/testdata/sf0.01"))
    pats = sorted(((r["frequency"], r["activity_type"], r["avg_confidence"], r["behavioral_category"])
                   for r in p.collect()), key=lambda t: (-t[0], t[1]))
    groups = {}
    for f, t, c, cat in pats:
        groups.setdefault(cat, []).append((f, t, c))

    def risk(cat, n, c):
        if cat == "Concerning":
            return "High" if n > 5 and c > 0.8 else "Medium" if n > 2 and c > 0.7 else "Low"
        if cat == "Stimming":
            return "Medium" if n > 10 else "Low"
        return "Low"

    want = {}
    for cat, ps in groups.items():
        n = sum(f for f, _, _ in ps)
        mean = sum(c for _, _, c in ps) / len(ps)
        want[cat] = (n, round(mean, 3), len(ps), ", ".join(t for _, t, _ in ps[:2]), risk(cat, n, mean))
    got = {r["category"]: (r["total_occurrences"], r["average_confidence"], r["activity_count"],
                           r["dominant_activities"], r["risk_level"]) for r in PP.insights(p).collect()}
    assert got == want
