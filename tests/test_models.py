"""Models as tables and folders, kernel SVM probabilities, sequence features, bounded history, uploads."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from obslytics.operators import ml as ML
from obslytics.operators import models as MO
from obslytics.operators import sequences as SQ
from obslytics.operators import summary as SM
from obslytics.plans import catalog
from obslytics.sources import readers as R
from obslytics.streaming import streams as ST
from conftest import SF_SMALL


def rings(spark, n=600):
    rng = np.random.default_rng(5)
    kind = rng.integers(0, 3, n)
    radius, angle = 1.0 + kind, rng.uniform(0, 2 * np.pi, n)
    x = np.stack([radius * np.cos(angle), 0.01 * radius * np.sin(angle)], 1) + rng.normal(0, [0.25, 0.0025], (n, 2))
    rows = [(i, f"ring{k}", [float(a) for a in p]) for i, (k, p) in enumerate(zip(kind, x, strict=True))]
    return spark.createDataFrame(rows, "id long, label string, f array<double>").select("id", "label", array_to_vector("f").alias("features"))


def test_svm_probabilities(spark, tmp_dir):
    """On rings that no plane separates the probabilities sum to one and beat the class shares (Brier score); saved and loaded they stay."""
    df = rings(spark).cache()
    train, test = df.where("id % 3 != 0"), df.where("id % 3 = 0")
    model, labels = ML.train_svm(train, n_features=60, max_iter=20)
    got = ML.svm_predictions(model, labels, test).select("id", "label", "prediction", "probability").orderBy("id").collect()
    p = np.array([r.probability for r in got])
    truth = np.array([[r.label == k for k in labels] for r in got], float)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    share = np.array([[r.label == k for k in labels] for r in train.collect()], float).mean(axis=0)
    brier, prior = ((p - truth) ** 2).sum(axis=1).mean(), ((share - truth) ** 2).sum(axis=1).mean()
    assert brier < 0.5 * prior
    assert np.mean([r.label == r.prediction for r in got]) > 0.8
    schema = train.select("features").schema
    MO.save_model(model, f"{tmp_dir}/svm", schema, labels, 42)
    again = MO.load_model(f"{tmp_dir}/svm", schema, loader=ML.KernelSvm.load)
    assert [r.probability for r in ML.svm_predictions(again, labels, test).select("id", "probability").orderBy("id").collect()] == [r.probability for r in got]


def test_svm_fits_a_bounded_number_of_rows(spark):
    df = rings(spark)
    model, _ = ML.train_svm(df, n_features=20, max_iter=5, max_rows=100)
    assert model.landmarks.shape == (20, 2)


def test_forest_with_categories_as_a_table(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), float(rng.normal()), str(rng.choice(list("abcde")))) for i in range(400)]
    df = spark.createDataFrame([(i, x, c, "yes" if (x > 0) != (c in "ab") else "no") for i, x, c in rows], "id long, x double, c string, label string")
    df, _ = ML.encode_labels(df, "c", "code")
    model = ML.train_forest(df, "label", ["x", "code"], trees=7, depth=6)
    nodes = MO.node_table(model, spark)
    assert nodes.where("lefts is not null").count() > 0
    both = MO.score_forest(model.transform(df), nodes, ["x", "code"])
    assert both.where("score != _pred").count() == 0
    own = [r.importance for r in MO.forest_importances(nodes, ["x", "code"]).orderBy("feature_index").collect()]
    theirs = [r.importance for r in ML.importances(model, spark, ["x", "code"], None).orderBy("feature_index").collect()]
    assert np.allclose(own, theirs, atol=1e-12)


def test_saved_models_are_refused_on_mismatch(spark, tmp_dir, monkeypatch):
    df = spark.createDataFrame([(float(i), "a" if i % 2 else "b") for i in range(20)], "x double, label string")
    path = f"{tmp_dir}/m"
    with pytest.raises(MO.ModelMismatch):
        MO.load_model(path)
    model = ML.train_forest(df, "label", ["x"], trees=2, depth=2)
    assert MO.save_model(model, path, df.select("x").schema, ["a", "b"], 1) == 0
    assert MO.save_model(model, path, df.select("x").schema) == 1
    with pytest.raises(MO.ModelMismatch):
        MO.load_model(path, df.select("label").schema)
    with pytest.raises(MO.ModelMismatch):
        MO.load_model(path, version=5)
    assert [r.version for r in MO.manifest(path).orderBy("version").collect()] == [0, 1]

    class Broken:
        def save_to(self, folder):
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        MO.save_model(Broken(), path)
    assert MO.load_model(path, df.select("x").schema).transform(df).count() == 20  # the broken save is not seen
    monkeypatch.setattr(MO, "FORMAT", 2)
    with pytest.raises(MO.ModelMismatch):
        MO.load_model(path)


def test_order_features_are_a_decayed_fold(spark):
    seq = SQ.sequences(catalog.acts_with_k(spark, SF_SMALL), 10)
    got = {(r.session_id, r.seq_index): r for r in SQ.order_features(seq).collect()}
    steps = {}
    for r in seq.collect():
        steps.setdefault((r.session_id, r.seq_index), []).append((r.step_index, r.confidence))
    for key, values in steps.items():
        state, weight = 0.0, 0.0
        for _, x in sorted(values):
            state, weight = 0.9 * state + x, 0.9 * weight + 1
        assert abs(got[key]["d1_confidence"] - state / weight) < 1e-12
    assert len(SQ.sequence_vectors(seq).first()["features"]) == 60


def test_sequence_model_learns_order(spark):
    """Sequences whose label is whether the confidence rises: beyond the majority class on held-out sequences."""
    rng = np.random.default_rng(7)
    rows = []
    for s in range(240):
        up = bool(rng.integers(2))
        level = np.sort(rng.uniform(0, 1, 10))[:: 1 if up else -1]
        rows += [(f"s{s}", 0, i, "up" if up else "down", float(level[i]), 1.0, 0.0, 0.0, float(rng.uniform(0, 5))) for i in range(10)]
    seq = spark.createDataFrame(rows, "session_id string, seq_index long, step_index long, label string, confidence double, hour double, k double, weekday double, gap_minutes double")
    v = SQ.sequence_vectors(seq).cache()
    test = F.pmod(F.xxhash64("session_id"), F.lit(4)) == 0
    model = ML.train_mlp(v.where(~test), "label", "features", (8,), 60)
    got = model.transform(v.where(test)).select("label", "prediction").collect()
    assert np.mean([r.label == r.prediction for r in got]) > 0.9


def test_history_by_buckets(spark, tmp_dir):
    """The newest samples of every host over several micro-batches; hosts that fell silent leave."""
    schema = "host string, timestamp timestamp, cpu_percent double"
    rows = [("a", f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", float(i)) for i in range(600)] + [("b", "2023-12-01 00:00:00", 1.0)]
    for k, part in enumerate((rows[:250], rows[250:])):
        spark.createDataFrame(part, "host string, t string, cpu_percent double").selectExpr("host", "cast(t as timestamp) as timestamp", "cpu_percent") \
            .coalesce(1).write.parquet(f"{tmp_dir}/in/{k}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/in/*")
    ST.history_sink(stream(), f"{tmp_dir}/out", f"{tmp_dir}/chk", n=40, buckets=4).awaitTermination()
    got = {r.host: r for r in ST.history_summary(spark, f"{tmp_dir}/out").collect()}
    assert got["a"].retained == 40 and got["a"].cpu_avg == np.mean(range(560, 600)) and got["b"].retained == 1
    ST.history_sink(stream(), f"{tmp_dir}/out2", f"{tmp_dir}/chk2", n=40, buckets=4, expire="7 days").awaitTermination()
    assert [r.host for r in ST.history_summary(spark, f"{tmp_dir}/out2").collect()] == ["a"]


def test_confidence_lists_in_chunks(spark):
    rows = [(str(i), f"2024-01-01 0{i % 2}:{i % 60:02d}:00", None if i == 4 else i / 100) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, t string, confidence double").selectExpr("id", "cast(t as timestamp) as timestamp", "confidence")
    got = {(r.hour, r.chunk): r.confidences for r in SM.confidence_lists(df, 10).collect()}
    assert got[0, 0] == [None if i == 4 else i / 100 for i in range(0, 20, 2)] and len(got) == 6 and len(got[1, 2]) == 5


def test_uploads_are_listed_without_their_contents(spark, tmp_dir):
    files = spark.createDataFrame([("a.mp4", b"12345"), ("b.MoV", b"1"), ("c.txt", b"1"), ("d.mp4.tmp", b"1")], "name string, content binary")
    assert R.write_uploads(files, f"{tmp_dir}/up").agg(F.sum("length")).first()[0] == 8
    listed = R.read_videos(spark, f"{tmp_dir}/up")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert sorted((r.path.split("/")[-1], r.length, r.content_type) for r in listed.collect()) == [("a.mp4", 5, "video/mp4"), ("b.MoV", 1, "video/quicktime")]
    assert bytes(R.read_videos(spark, f"{tmp_dir}/up", content=True).where("length = 5").first().content) == b"12345"


def test_sequences_are_grouped_once(spark):
    """The flat vector and the order features come out of one grouping, equal to both apart; a null key has no vector."""
    rows = [(s, q, i, "ab"[i % 2], i / 7, float(q), float(i * q), 2.0, i / 3) for s in ("u", "v", None) for q in range(2) for i in range(10)]
    seq = spark.createDataFrame(rows, "session_id string, seq_index long, step_index long, label string, confidence double, hour double, k double, weekday double, gap_minutes double")
    got = SQ.sequence_vectors(seq)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    flat = {(r.session_id, r.seq_index): list(r.features) for r in SQ.flatten_sequences(seq).collect()}
    folds = {(r.session_id, r.seq_index): list(r)[2:] for r in SQ.order_features(seq, label=None).collect()}
    assert {(r.session_id, r.seq_index): list(r.features) for r in got.collect()} == {k: flat[k] + folds[k] for k in flat if k[0]}


def test_split_sequences_read_written_rows(spark):
    """The split, and with it the training, no longer rests on the events: its plan reads the written sequences alone."""
    split = catalog._split_sequences(catalog._seq_vectors(spark, SF_SMALL))
    assert all("events.parquet" not in f for f in split.inputFiles()) and split.inputFiles()
    assert split.count() == catalog._seq_vectors(spark, SF_SMALL).count()


def test_training_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x)

    rows = spark.range(60).withColumn("x", counted("id")).repartition(4, "x")
    data = rows.select(F.when(F.col("x") % 2 == 0, "a").otherwise("b").alias("label"), array_to_vector(F.array("x", -F.col("x"))).alias("features"))
    ML.train_mlp(data, "label", "features", (2,), 2, 42)
    assert seen.value == 60


def plain_events(spark, folder, users=12, each=30):
    rows = [(u * each + i, f"2024-01-{1 + i % 9:02d} 0{u % 9}:{i:02d}:00", u, ("view", "error", "signup")[(u + i) % 3], float((7 * u + i) % 100), f'{{"k": {(u * i) % 50}}}')
            for u in range(users) for i in range(each)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t").write.parquet(f"{folder}/events.parquet")


def test_models_are_trained_on_few_parts(spark, tmp_dir, monkeypatch):
    """The parts of the training rows follow the task slots, not the partitions that the shuffles leave."""
    plain_events(spark, tmp_dir)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffles, parts, seen = spark.conf.get("spark.sql.shuffle.partitions"), {}, []
    slots = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(5 * slots))
    forest, mlp = ML.train_forest, ML.train_mlp

    def small_forest(df, label, features, **_):
        parts["forest"] = df.rdd.getNumPartitions()
        seen.append(df.count())
        return forest(df, label, features, 3, 3)

    def small_mlp(df, label, features, *_):
        parts["mlp"] = df.rdd.getNumPartitions()
        return mlp(df, label, features, (4,), 2)

    monkeypatch.setattr(ML, "train_forest", small_forest)
    monkeypatch.setattr(ML, "train_mlp", small_mlp)
    try:
        got = catalog.QUERIES["model_comparison"](spark, tmp_dir).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert sorted(r.model_name for r in got) == ["MLP", "RandomForest"]
    assert parts == {"forest": slots, "mlp": slots}
    assert 0.7 * 36 < seen[0] < 36  # 12 users with 3 sequences each, less the held-out ones


def test_few_parts_grow_with_the_rows(spark):
    df = spark.range(0, 100, 1, 4 * spark.sparkContext.defaultParallelism).checkpoint(eager=True)
    slots = spark.sparkContext.defaultParallelism
    few = ML.few_parts(df, "id")
    assert few.rdd.getNumPartitions() == slots and sorted(r.id for r in few.collect()) == list(range(100))
    assert ML.few_parts(df, "id", 1) is df
    assert ML.few_parts(few, "id") is few


def test_forest_of_a_vector_is_that_of_its_columns(spark):
    df = rings(spark).withColumn("_a", vector_to_array("features")).select("*", F.col("_a")[0].alias("f0"), F.col("_a")[1].alias("f1")).checkpoint()
    trees = [ML.train_forest(df, "label", cols, 5, 4).stages[2].toDebugString.split("\n", 1)[1] for cols in (["f0", "f1"], ["features"])]
    assert trees[0] == trees[1]


def test_rows_of_plain_keys_are_ordered_in_one_bucket(spark, monkeypatch):
    """Only the rows of hot keys are dealt by the minute; the order is the same, without a key or a time too."""
    rows = [(str(i), ("a", "b", None)[i % 3], None if i % 7 == 0 else f"2024-01-01 00:{(i * 11) % 60:02d}:00", 0.5, i, "x") for i in range(90)]
    df = spark.createDataFrame(rows, "id string, session_id string, t string, confidence double, k int, activity_type string").withColumn("timestamp", F.col("t").cast("timestamp"))
    indexed, buckets = SQ.ordered_index, []

    def spy(rows, keys, order, tie, **more):
        by = more.get("bucket", SQ.time_bucket)
        buckets.append(rows.where(F.col(order).isNotNull()).select(*keys, by(order).alias("b")).distinct().count())
        return indexed(rows, keys, order, tie, **more)

    monkeypatch.setattr(SQ, "ordered_index", spy)
    got = sorted(map(str, SQ.sequence_rows(df).collect()))
    monkeypatch.setattr(SQ, "HOT_ROWS", 5)
    assert got == sorted(map(str, SQ.sequence_rows(df).collect()))
    assert buckets[0] == 3 and buckets[1] > 20
    for key in ("a", "b", None):
        mine = [r for r in SQ.sequence_rows(df).collect() if r.session_id == key]
        timed = [r for r in sorted(mine, key=lambda r: r.rn) if r.timestamp is not None]
        assert sorted(r.rn for r in mine) == list(range(1, 31))
        assert [r.rn for r in timed] == list(range(31 - len(timed), 31))
        assert [(r.timestamp, r.id) for r in timed] == sorted((r.timestamp, r.id) for r in timed)
