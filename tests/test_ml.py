"""Model jobs: invariants, not exact models (fixed seeds)."""

import pytest
from pyspark.sql import functions as F

from obslytics.operators import filters as FL
from obslytics.operators import ml as ML
from obslytics.operators import sequences as SQ
from obslytics.plans import catalog
from obslytics.sources import adapter as A
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def enriched(spark):
    return catalog.enriched(spark, SF_SMALL).cache()


def test_standardize_mean0_std1(spark, enriched):
    f = ML.standardize(ML.cluster_features(enriched), ["confidence_mean", "timestamp_count"])
    r = f.agg(F.avg("confidence_mean_scaled").alias("m"), F.stddev_pop("confidence_mean_scaled").alias("s")).first()
    assert abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9


def test_cluster_activities(spark, enriched):
    out, centers, inertia = ML.cluster_activities(enriched, 3)
    assert out.count() == enriched.select("activity_type").distinct().count()
    assert len(centers) <= 3 and inertia >= 0


def test_cluster_needs_two_types(spark, enriched):
    with pytest.raises(FL.InsufficientData):
        ML.cluster_activities(enriched.filter("activity_type = 'sitting'"))


def test_pca_sign_and_variance(spark, enriched):
    base = ML.row_features(enriched)
    proj, ratio, load = ML.pca(base, ML.ROW_FEATURES, 2)
    assert len(ratio) == 2 and 0 < sum(ratio) <= 1 + 1e-9
    for comp in load:
        assert max(comp, key=abs) > 0
    means = proj.agg(F.avg("pc1"), F.avg("pc2")).first()
    assert abs(means[0]) < 1e-6 and abs(means[1]) < 1e-6


def test_forest_save_load_roundtrip(spark, tmp_dir):
    feats = SQ.statistical_features(A.load_activities(spark, SF_SMALL), "session_id")
    label = A.load_activities(spark, SF_SMALL).groupBy("session_id").agg(F.mode("activity_type", True).alias("label"))
    cols = ["mean", "std", "min", "max", "median", "p25", "p75", "var", "ptp", "length"]
    data = feats.join(label, "session_id").select("session_id", "label", *[F.col(c).cast("double") for c in cols])
    model = ML.train_forest(data, "label", cols, trees=10, depth=5)
    imp = ML.importances(model, spark, cols, None)
    assert abs(sum(r["importance"] for r in imp.collect()) - 1) < 1e-6
    ML.save_model(model, f"{tmp_dir}/m")
    again = ML.load_model(f"{tmp_dir}/m")
    a = model.transform(data).select("session_id", "prediction").collect()
    b = again.transform(data).select("session_id", "prediction").collect()
    assert sorted(a) == sorted(b)


def test_confusion_and_report_consistent(spark):
    p = catalog.rule_predictions(spark, SF_SMALL).filter("model_name = 'mod10'")
    cm = ML.confusion_matrix(p, list(range(10)))
    total = cm.select(sum(F.col(f"p_{c}") for c in range(10)).alias("s")).agg(F.sum("s")).first()[0]
    assert total == p.count()
    diag = sum(r[f"p_{r['label']}"] for r in cm.collect())
    rep = ML.classification_report(p).first()
    assert abs(rep["accuracy"] - diag / total) < 1e-12


def test_stratified_split_fraction(spark):
    e = catalog.embeddings(spark, SF_SMALL).select("vec_id", "label")
    s = ML.stratified_split(e, "label", "vec_id", 0.2, 42)
    per = s.groupBy("label").agg(F.count_if(F.col("split") == "test").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    for r in per:
        assert r["t"] == int(r["n"] * 0.2 + 0.5)
    assert s.count() == e.count()


def test_sequences_complete_and_flat(spark):
    seq = SQ.sequences(catalog.acts_with_k(spark, SF_SMALL), 10)
    sizes = seq.groupBy("session_id", "seq_index").count().select("count").distinct().collect()
    assert [r[0] for r in sizes] == [10]
    flat = SQ.flatten_sequences(seq)
    assert len(flat.first()["features"]) == 50


def test_sliding_sequences(spark):
    seq = SQ.sequences(catalog.acts_with_k(spark, SF_SMALL), 10, step=5)
    sizes = seq.groupBy("session_id", "seq_index").count().select("count").distinct().collect()
    assert [r[0] for r in sizes] == [10]


def test_mlp_runs(spark):
    flat = SQ.flatten_sequences(SQ.sequences(catalog.acts_with_k(spark, SF_SMALL), 10))
    model = ML.train_mlp(flat, "label", "features", (16,), 10, 42)
    assert model.transform(flat).select("prediction").count() == flat.count()


def test_svm_and_mlp_learn_separable_classes_of_unequal_scale(spark):
    """Rings no plane separates, in a feature a thousand times smaller than a noisy one: both beat the majority."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(5)
    radius = np.repeat([1.0, 3.0], [200, 160])
    angle = rng.uniform(0, 2 * np.pi, 360)
    x = np.stack([radius * np.cos(angle), 0.001 * radius * np.sin(angle)], 1) + rng.normal(0, 1e-4, (360, 2))
    rows = [(i, "inner" if r < 2 else "outer", [float(a) for a in p]) for i, (r, p) in enumerate(zip(radius, x))]
    df = spark.createDataFrame(rows, "id long, label string, f array<double>").select("id", "label", array_to_vector("f").alias("features"))
    train, test = df.filter("id % 4 != 0").cache(), df.filter("id % 4 = 0")
    model, labels = ML.train_svm(train, n_features=64, max_iter=20)
    svm = ML.svm_predictions(model, labels, test, n_features=64)
    mlp = ML.train_mlp(train, hidden=(8,), max_iter=100).transform(test)
    for got in (svm, mlp):
        right = [r["label"] == r["prediction"] for r in got.select("label", "prediction").collect()]
        assert len(right) == 90 and np.mean(right) > 0.9
