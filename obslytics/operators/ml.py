"""Feature scaling, clustering, projection, classifiers and evaluation on
MLlib (M1-M14, M20-M21, S10).

Evaluation metrics are computed from the (label, prediction) count table,
which has at most classes x classes rows, so they are exact SQL aggregates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LinearSVC, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obslytics.operators import clustering as CL
from obslytics.operators import filters as FL
from obslytics.operators.models import load_model, save_model  # noqa: F401  S10 by the names of the reference
from obslytics.operators.ordered import hash_bucket, ordered_index
from obslytics.session import default_parallelism


# --- M1 scaling ------------------------------------------------------------------

def standardize(df: DataFrame, cols: list[str], suffix: str = "_scaled") -> DataFrame:
    """M1: (x - mean) / population std; a constant column is divided by 1.

    All means and stds come from one global aggregate (one pass, partial
    aggregation); only those 2 x len(cols) numbers reach the driver and
    return as literals.
    """
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    out = df
    for c in cols:
        m = float(stats[f"m_{c}"] or 0.0)
        s = float(stats[f"s_{c}"] or 0.0)
        out = out.withColumn(c + suffix, (F.col(c) - F.lit(m)) / F.lit(s if s != 0 else 1.0))
    return out


# --- A4 / M2 / M3 clustering ------------------------------------------------------------

def cluster_features(df: DataFrame) -> DataFrame:
    """A4: per type mean/std confidence, mean/std hour, count (NaN -> 0)."""
    h = F.hour("timestamp")
    return (df.groupBy("activity_type").agg(
        F.avg("confidence").alias("confidence_mean"), F.stddev_samp("confidence").alias("confidence_std"),
        F.avg(h).alias("hour_mean"), F.stddev_samp(h).alias("hour_std"),
        F.count(F.lit(1)).alias("timestamp_count")).na.fill(0.0))


CLUSTER_COLS = ["confidence_mean", "confidence_std", "hour_mean", "hour_std", "timestamp_count"]


def cluster_activities(df: DataFrame | None, k: int = 3, features: DataFrame | None = None):
    """M2: deterministic k-means of the per-type features after M1 scaling.

    Returns (assignments DataFrame [activity_type, cluster, distance], centres, inertia).
    ``features`` may be given precomputed (A4 columns); fewer than two types
    is an error, as in the reference.
    """
    found = activity_clusters(df, k, features)
    return found.rows.select("activity_type", "cluster", "distance"), found.centres, found.inertia


def activity_clusters(df: DataFrame | None, k: int = 3, features: DataFrame | None = None) -> CL.Clusters:
    feats = features if features is not None else cluster_features(df)
    FL.require_rows(feats, 2, "activity types")
    return CL.kmeans(standardize(feats, CLUSTER_COLS), "activity_type", [c + "_scaled" for c in CLUSTER_COLS], k)


def centre_rows(found: CL.Clusters, cols: list[str], spark) -> DataFrame:
    """M2/M3: a row for each cluster: rows, centre, inertia of all clusters."""
    rows = [(i, n, *centre, found.inertia) for i, (n, centre) in enumerate(zip(found.sizes, found.centres, strict=True))]
    return spark.createDataFrame(rows, ", ".join(["cluster int", "n long", *(f"{c} double" for c in cols), "inertia double"]))


def encode_labels(df: DataFrame, col: str, out: str | None = None):
    """Codes in alphabetical order (like a label encoder); returns the
    fitted indexer model too so codes can be decoded with ``IndexToString``."""
    out = out or f"{col}_encoded"
    model = StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(df)
    return model.transform(df), model


def decode_labels(df: DataFrame, col: str, labels: list[str], out: str | None = None) -> DataFrame:
    """P12 inverse."""
    return IndexToString(inputCol=col, outputCol=out or f"{col}_label", labels=labels).transform(df)


ROW_FEATURES = ["confidence", "hour", "activity_encoded", "behavior_encoded"]
SCALED_FEATURES = [c + "_scaled" for c in ROW_FEATURES]


def row_features(df: DataFrame) -> DataFrame:
    """Row-level numeric features: confidence, hour, encoded type and category."""
    base = df.filter(F.col("behavioral_category").isNotNull()).withColumn("hour", F.hour("timestamp").cast("double"))
    base, _ = encode_labels(base, "activity_type", "activity_encoded")
    base, _ = encode_labels(base, "behavioral_category", "behavior_encoded")
    return base


def row_clusters(df: DataFrame, k: int | None = None) -> CL.Clusters:
    """M3: deterministic k-means of the scaled row features, k = min(5, categories)."""
    base = row_features(df)
    if k is None:
        k = min(5, base.agg(F.count_distinct("behavioral_category")).first()[0])
    scaled = standardize(base, ROW_FEATURES).select("id", *SCALED_FEATURES)
    return CL.kmeans(scaled, "id", SCALED_FEATURES, k)


def cluster_rows(df: DataFrame, k: int | None = None) -> DataFrame:
    """M3: (id, cluster)."""
    return row_clusters(df, k).rows.select("id", "cluster")


# --- M4-M6 projection ---------------------------------------------------------------------

def pca(df: DataFrame, cols: list[str], k: int = 2):
    """M4: (rows with ``pc1..pck``, explained-variance ratios, loadings by component); centred, with a fixed sign
    (largest absolute loading positive)."""
    found = CL.components(df, cols, k)
    return found.project(df), found.ratios, found.loadings


def component_rows(found: CL.Components, spark) -> DataFrame:
    """M4/M5: a row for each component and feature: loading, the component's share of variance, and the feature's
    weight (mean absolute loading over the components)."""
    weight = [sum(abs(load[i]) for load in found.loadings) / len(found.loadings) for i in range(len(found.cols))]
    rows = [(j + 1, c, load[i], found.ratios[j], weight[i]) for j, load in enumerate(found.loadings) for i, c in enumerate(found.cols)]
    return spark.createDataFrame(rows, "component int, feature string, loading double, explained_variance_ratio double, weight double")


def loading_weights(loadings: list[list[float]], cols: list[str], spark) -> DataFrame:
    """M5: mean absolute loading per feature."""
    w = np.abs(np.array(loadings)).mean(axis=0)
    return spark.createDataFrame([(c, float(v)) for c, v in zip(cols, w)], "feature string, weight double")


def cluster_projection(df: DataFrame, k: int | None = None) -> DataFrame:
    """M6: row clusters shown in PCA space, PCA fitted on the same scaled
    features the clusters were found in (one consistent space)."""
    return projected_clusters(df, k)[0]


def projected_clusters(df: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M6: rows (id, cluster, pc1, pc2) and centres (cluster, n, pc1, pc2) in one space."""
    found = row_clusters(df, k)
    space = CL.components(found.rows, SCALED_FEATURES)
    centres = [(i, n, *space.place(c)) for i, (n, c) in enumerate(zip(found.sizes, found.centres, strict=True))]
    return (space.project(found.rows).select("id", "cluster", "pc1", "pc2"),
            df.sparkSession.createDataFrame(centres, "cluster int, n long, pc1 double, pc2 double"))


# --- M11 split ------------------------------------------------------------------------------

def stratified_split(df: DataFrame, label: str, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Exact, repeatable stratified split.  Within each label the rows
    are ordered by ``md5(seed || key)``; the first ``round(fraction * n)`` go
    to ``test``.  Ordering uses the skew-safe index, so a dominant label is
    still spread over many tasks."""
    h = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    with_h = df.withColumn("_h", h)
    out = ordered_index(with_h, [label], "_h", key, rn_col="_rn", prev_col=None, size_col="_n", bucket=hash_bucket)
    return out.withColumn("split", F.when(F.col("_rn") <= F.round(F.col("_n") * fraction), "test")
                          .otherwise("train")).drop("_h", "_rn", "_n")


# --- M7-M10 models ---------------------------------------------------------------------------

def few_parts(df: DataFrame, label: str = "label", rows: int = 250_000) -> DataFrame:
    """A checkpointed table in at most as many parts as the cluster has task slots, or as parts of ``rows`` rows: a
    forest's pass sends the statistics of every node from every part, however few rows that has.  Fewer parts stay as
    they are; in new ones the rows of a label stand together, since they mostly reach the same nodes."""
    most = max(default_parallelism(df.sparkSession), -(-df.count() // rows))
    if df.rdd.getNumPartitions() <= most:
        return df
    return df.repartition(most).sortWithinPartitions(label).checkpoint(eager=True)


def train_forest(df: DataFrame, label: str, features: list[str], trees: int = 100, depth: int = 10,
                 seed: int = 42) -> PipelineModel:
    """M7: label-indexed random forest (MLlib Pipeline) with label decoding.

    ``features`` are numeric or vector columns.  The node that each row has reached in each tree is kept beside the
    row, so that a pass does not walk the trees from their roots; the trees are the same either way."""
    idx = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
    fitted_idx = idx.fit(df)
    pipe = Pipeline(stages=[
        fitted_idx,
        VectorAssembler(inputCols=features, outputCol="_features"),
        RandomForestClassifier(labelCol="_label", featuresCol="_features", numTrees=trees, maxDepth=depth,
                               seed=seed, predictionCol="_pred", cacheNodeIds=True, checkpointInterval=-1),
        IndexToString(inputCol="_pred", outputCol="prediction", labels=fitted_idx.labels)])
    return pipe.fit(df)


def importances(model: PipelineModel, spark, names: list[str] | None = None, n: int | None = 5,
                by: str = "index") -> DataFrame:
    """Feature importances; first ``n`` by index (as the reference
    shows them) or by value."""
    forest = [s for s in model.stages if hasattr(s, "featureImportances")][0]
    imp = forest.featureImportances.toArray()
    names = names or [f"feature_{i}" for i in range(len(imp))]
    df = spark.createDataFrame([(i, names[i], float(v)) for i, v in enumerate(imp)],
                               "feature_index int, feature string, importance double")
    df = df.orderBy("feature_index") if by == "index" else df.orderBy(F.col("importance").desc(), "feature_index")
    return df.limit(n) if n else df


@dataclass
class KernelSvm:
    """M9: one-vs-rest SVMs on landmark features of an RBF kernel, with calibrated class probabilities, as plain arrays:
    mean and deviation of the features, landmarks, for each class the weights of the landmarks' kernel values and a bias,
    and the sigmoid that turns its decision into a chance."""

    mean: np.ndarray
    deviation: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    gamma: float
    sigmoids: np.ndarray

    def decisions(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """Adds an array of the classes' decision values; only these leave the Arrow batch."""
        kernel = landmark_kernel(self.landmarks, self.gamma)
        mean, deviation, weights, bias = self.mean, self.deviation, self.weights, self.bias

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def decide(x: pd.Series) -> pd.Series:
            m = np.vstack(x.to_numpy()) if len(x) else np.zeros((0, len(mean)))
            return pd.Series(list(kernel((m - mean) / deviation) @ weights + bias))

        return df.withColumn(out, decide(vector_to_array(features)))

    def save_to(self, folder: str) -> None:
        kinds = [(f.name, "double" if np.ndim(v) == 0 else "array<" * np.ndim(v) + "double" + ">" * np.ndim(v)) for f in fields(self) for v in [getattr(self, f.name)]]
        row = tuple(np.asarray(getattr(self, name)).tolist() for name, _ in kinds)
        (SparkSession.active().createDataFrame([row], ", ".join(f"{n} {k}" for n, k in kinds)).coalesce(1).write.mode("overwrite").parquet(folder))

    @classmethod
    def load(cls, folder: str) -> KernelSvm:
        row = SparkSession.active().read.parquet(folder).first()
        return cls(*(row[f.name] if f.name == "gamma" else np.array(row[f.name]) for f in fields(cls)))


def landmark_kernel(landmarks: np.ndarray, gamma: float):
    """Kernel values exp(-gamma |x - y|^2) of rows with every landmark."""
    norms = (landmarks * landmarks).sum(axis=1)
    return lambda m: np.exp(-gamma * np.maximum(0, (m * m).sum(axis=1)[:, None] - 2 * m @ landmarks.T + norms))


def _scaler(features: str) -> StandardScaler:
    return StandardScaler(inputCol=features, outputCol="_scaled", withMean=True, withStd=True)


def sigmoid(decision: np.ndarray, positive: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Platt scaling: (a, b) of the chance 1 / (1 + exp(a * decision + b)), by Newton steps on smoothed targets."""
    n, m = int(positive.sum()), int((~positive).sum())
    target = np.where(positive, (n + 1) / (n + 2), 1 / (m + 2))
    a, b = 0.0, math.log((m + 1) / (n + 1))

    def loss(a, b):
        z = a * decision + b
        return float(np.sum(np.logaddexp(0, z) - (1 - target) * z))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(a * decision + b, -500, 500)))
        g = np.array([np.sum(decision * (target - p)), np.sum(target - p)])
        w = p * (1 - p)
        h = np.array([[np.sum(w * decision * decision) + 1e-9, np.sum(w * decision)], [np.sum(w * decision), np.sum(w) + 1e-9]])
        step, size, now = np.linalg.solve(h, g), 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(g).max() < 1e-6:
            break
    return float(a), float(b)


def train_svm(df: DataFrame, label: str = "label", features: str = "features", dim: int | None = None,
              n_features: int = 256, C: float = 1.0, max_iter: int = 50, seed: int = 42, gamma: float | None = None, max_rows: int = 20_000):
    """M9: RBF-kernel SVMs with class probabilities, one against the rest.

    Fitted on at most ``max_rows`` labelled rows, chosen by hash: ``n_features`` of them are the kernel's landmarks, a
    fifth (by hash) is held out from the fit and calibrates the probabilities.  ``regParam = 1 / (C n)``; features are
    standardised first.  Returns (model, labels)."""
    scaler = _scaler(features).fit(df)
    idx = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(df)
    hashed = F.xxhash64(F.lit(seed), vector_to_array(features), label)
    chosen = idx.transform(df.select(label, features)).select("_label", features, hashed.alias("_hash")).orderBy("_hash").limit(max_rows)
    mean, deviation = scaler.mean.toArray(), np.where(scaler.std.toArray() > 0, scaler.std.toArray(), 1.0)
    some = chosen.limit(n_features).toPandas()[features]
    landmarks = (np.array([v.toArray() for v in some]) - mean) / deviation
    gamma = gamma if gamma is not None else 1.0 / (dim or landmarks.shape[1])
    values, vectors = np.linalg.eigh(landmark_kernel(landmarks, gamma)(landmarks))
    # Nystroem map: kernel values, whitened, so that inner products of mapped rows approximate the kernel
    whiten = vectors / np.sqrt(np.maximum(values, 1e-8))
    mapped = KernelSvm(mean, deviation, landmarks, whiten, np.zeros(whiten.shape[1]), gamma, np.zeros((0, 2)))
    z = mapped.decisions(chosen, features, "_kernel").select("_label", features, array_to_vector("_kernel").alias("_kernel"),
                                                            (F.pmod(F.xxhash64("_hash"), F.lit(5)) == 0).alias("_held")).persist()
    try:  # the solver makes many passes over these bounded rows
        n = z.count()
        ovr = OneVsRest(classifier=LinearSVC(regParam=1.0 / (C * max(n, 1)), maxIter=max_iter), labelCol="_label", featuresCol="_kernel", parallelism=4)
        parts = ovr.fit(z.where("not _held")).models
        weights = whiten @ np.array([m.coefficients.toArray() for m in parts]).T
        model = KernelSvm(mean, deviation, landmarks, weights, np.array([m.intercept for m in parts]), gamma, np.zeros((0, 2)))
        held = model.decisions(z.where("_held"), features, "_decision").select("_label", "_decision").toPandas()
    finally:
        z.unpersist()
    decision = np.array(held["_decision"].tolist()).reshape(len(held), len(parts))
    truth = held["_label"].to_numpy()
    model.sigmoids = np.array([sigmoid(decision[:, k], truth == k) for k in range(len(parts))])
    return model, idx.labels


def svm_predictions(model: KernelSvm, labels: list[str], df: DataFrame, features: str = "features", dim: int | None = None,
                    n_features: int | None = None) -> DataFrame:
    """``df`` with ``prediction`` and ``probability``, an array by the order of ``labels`` that sums to one."""
    pred = model.decisions(df, features, "_decision")
    pred = pred.withColumn("_chance", F.array(*(1 / (1 + F.exp(F.lit(float(a)) * F.col("_decision")[k] + F.lit(float(b)))) for k, (a, b) in enumerate(model.sigmoids))))
    pred = pred.withColumn("_total", F.aggregate("_chance", F.lit(0.0), lambda s, x: s + x))
    pred = pred.withColumn("probability", F.transform("_chance", lambda x: x / F.col("_total")))
    best = F.array_position("_decision", F.array_max("_decision")).cast("int")
    return pred.withColumn("prediction", F.element_at(F.array(*(F.lit(x) for x in labels)), best)).drop("_decision", "_chance", "_total")


REGRESSION_FEATURES = ["hour", "activity_encoded", "behavior_encoded"]


def regression_rows(df: DataFrame, seed: int = 42, test_fraction: float = 0.3) -> DataFrame:
    """Row features with ``_f`` and ``_test``, a 70/30 split by hash of the id."""
    base = row_features(df)
    base = base.withColumn("_test", (F.abs(F.xxhash64(F.lit(seed), F.col("id"))) % 1000) < test_fraction * 1000)
    return VectorAssembler(inputCols=REGRESSION_FEATURES, outputCol="_f").transform(base)


def train_regression(rows: DataFrame, trees: int = 50, seed: int = 42):
    """Forest regression of confidence on the training rows."""
    return RandomForestRegressor(featuresCol="_f", labelCol="confidence", numTrees=trees, seed=seed, predictionCol="_p").fit(rows.filter(~F.col("_test")))


def confidence_regression(df: DataFrame, trees: int = 50, seed: int = 42, test_fraction: float = 0.3) -> DataFrame:
    """Forest regression of confidence on hour and encoded type and
    category, hash-split 70/30, MSE and R^2 as aggregates (one row)."""
    vec = regression_rows(df, seed, test_fraction)
    pred = train_regression(vec, trees, seed).transform(vec.filter(F.col("_test")))
    y = F.col("confidence")
    err = y - F.col("_p")
    # one pass: SST = sum(y^2) - (sum y)^2 / n
    sst = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(F.lit(1))
    return pred.agg(F.count(F.lit(1)).alias("n_test"), F.avg(err * err).alias("mse"),
                    (F.lit(1.0) - F.try_divide(F.sum(err * err), sst)).alias("r2"))


def train_mlp(seq: DataFrame, label: str = "label", features: str = "features", hidden=(64, 32),
              max_iter: int = 100, seed: int = 42) -> PipelineModel:
    """Multilayer perceptron on flattened sequences (replaces the
    recurrent network, which MLlib does not provide)."""
    # L-BFGS makes one pass per iteration: keep the training rows
    data = seq.select(label, features).persist()
    try:
        n_in = len(data.select(features).first()[0])
        idx = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(data)
        n_out = len(idx.labels)
        pipe = Pipeline(stages=[
            idx,
            _scaler(features),
            MultilayerPerceptronClassifier(labelCol="_label", featuresCol="_scaled", predictionCol="_pred",
                                           layers=[n_in, *hidden, n_out], maxIter=max_iter, seed=seed),
            IndexToString(inputCol="_pred", outputCol="prediction", labels=idx.labels)])
        return pipe.fit(data)
    finally:
        data.unpersist()


# --- M12-M14 evaluation --------------------------------------------------------------------------

def _class_counts(pred: DataFrame, label: str, prediction: str, by: list[str]) -> DataFrame:
    """Per (group, class): tp, support, predicted.  Built from the small
    (label, prediction) count table with a union, no join."""
    c = pred.groupBy(*by, F.col(label).alias("_y"), F.col(prediction).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # each (label, prediction) count feeds its true class and its predicted
    # class: two struct rows per count row, one pass, no join
    zero = F.lit(0).cast("long")
    as_true = F.struct(F.col("_y").alias("cls"), F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(zero)
                       .alias("tp"), F.col("_n").alias("support"), zero.alias("predicted"))
    as_pred = F.struct(F.col("_p").alias("cls"), zero.alias("tp"), zero.alias("support"), F.col("_n").alias("predicted"))
    e = c.select(*by, F.explode(F.array(as_true, as_pred)).alias("r")).select(*by, "r.*")
    per = e.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                    F.sum("predicted").alias("predicted"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    per = per.withColumn("precision", prec).withColumn("recall", rec)
    return per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                        F.col("precision") + F.col("recall")), F.lit(0.0)))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          by: list[str] | None = None) -> DataFrame:
    """Accuracy and macro / support-weighted precision, recall and
    F1 (0 where a denominator is 0), one row per group in ``by``."""
    by = by or []
    per = _class_counts(pred, label, prediction, by)
    n = F.sum("support")
    return per.groupBy(*by).agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("recall_weighted"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
        n.alias("support"))


def compare_models(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                   model_col: str = "model_name") -> DataFrame:
    """The report per model."""
    r = classification_report(pred, label, prediction, [model_col])
    return r.select(model_col, "accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted")


def confusion_matrix(pred: DataFrame, classes: list, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Dense matrix, one row per true class and one column ``p_<class>``
    per predicted class; classes absent from the data give zero rows."""
    spine = pred.sparkSession.createDataFrame([(c,) for c in classes], T.StructType(
        [T.StructField(label, pred.schema[label].dataType)]))
    rows = pred.select(label, prediction).unionByName(spine, allowMissingColumns=True)
    wide = rows.groupBy(label).pivot(prediction, classes).count().na.fill(0)
    return wide.select(label, *[F.col(f"`{c}`").alias(f"p_{c}") for c in classes])
