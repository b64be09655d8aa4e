"""Fitted models as tables and as versioned folders.

A forest's trees become a node table (tree, node, feature, cut, children, class shares or value).  ``score_forest``
walks it with Spark expressions alone, so a forest can score without MLlib; importances are recomputed from the table.
The table is as large as the model (at most trees x 2 ** (depth + 1) nodes) and is passed to the tasks as one constant.

A saved model is a folder with one folder per version; a manifest row (format, stages, schema hash, labels, seed) is
written last, and readers follow the newest manifest, so a broken save is never read.  Loading with another schema,
an unknown format or without a manifest is refused.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obslytics.session import checkpoint_dir

NODE = "struct<feature:int,cut:double,lefts:array<double>,left:int,right:int,value:array<double>>"


# ---- forests ------------------------------------------------------------------------------------------------

def _forest(model):
    return next((s for s in model.stages if hasattr(s, "trees")), None) if isinstance(model, PipelineModel) else model


def node_table(model, spark: SparkSession) -> DataFrame:
    """Rows (tree, node, feature, cut, lefts, left, right, value, rows, gain) of a fitted forest; children of leaves are -1.

    A row goes left where its feature is at most ``cut`` or, for a split by category, among ``lefts``.  ``value`` holds the class shares of a classifier's node, or the one value of a regressor's; ``rows`` the weight of
    the training rows that reached it."""
    import uuid
    forest = _forest(model)
    path = f"{checkpoint_dir(spark).rstrip('/')}/forests/{uuid.uuid4().hex}"
    forest.write().overwrite().save(path)
    n = F.col("nodeData")
    classes = hasattr(forest, "numClasses")
    stats = n["impurityStats"]
    total = F.aggregate(stats, F.lit(0.0), lambda s, x: s + x) if classes else stats[0]
    value = F.transform(stats, lambda x: x / F.aggregate(stats, F.lit(0.0), lambda s, y: s + y)) if classes else F.array(n["prediction"])
    nodes, side = spark.read.parquet(f"{path}/data"), n["split"]["leftCategoriesOrThreshold"]
    by_category = n["split"]["numCategories"] >= 0
    return nodes.select(F.col("treeID").alias("tree"), n["id"].alias("node"), n["split"]["featureIndex"].alias("feature"),
                        F.when(~by_category, F.get(side, F.lit(0))).alias("cut"), F.when(by_category, side).alias("lefts"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
                        value.alias("value"), total.alias("rows"), n["gain"].alias("gain"))


def _constant(nodes: DataFrame) -> tuple[Column, int, int]:
    """The trees as one constant (array by tree of arrays by node), the depth, and the length of a value."""
    trees: dict[int, list] = {}
    for r in nodes.orderBy("tree", "node").toLocalIterator():
        trees.setdefault(r.tree, []).append(r)
    depth, width = 0, 0
    for rows in trees.values():
        level = {0: 0}
        for i, r in enumerate(rows):
            if r.node != i:
                raise ValueError("nodes are not numbered from 0")
            width = len(r.value)
            if r.left >= 0:
                level[r.left] = level[r.right] = level[i] + 1
        depth = max(depth, *level.values())
    text = json.dumps([[{"feature": r.feature, "cut": r.cut, "lefts": r.lefts, "left": r.left, "right": r.right, "value": r.value} for r in rows] for _, rows in sorted(trees.items())])
    return F.from_json(F.lit(text), f"array<array<{NODE}>>"), depth, width


def score_forest(df: DataFrame, nodes: DataFrame, features: list[str], classifier: bool = True, out: str = "score") -> DataFrame:
    """Adds ``out``: the class number with the largest sum of shares over the trees, or the mean value of a regressor."""
    trees, depth, width = _constant(nodes)
    x = F.array(*(F.col(f"`{c}`").cast("double") for c in features))

    def leaf(tree, row):
        def step(at, _):
            node = tree[at]
            x = F.get(row, node["feature"])
            left = F.coalesce(F.array_contains(node["lefts"], x), x <= node["cut"])
            return F.when(node["left"] < 0, at).when(left, node["left"]).otherwise(node["right"])
        return tree[F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), F.lit(0), step)]["value"]

    def total(row):
        zero = F.array(*(F.lit(0.0) for _ in range(width)))
        return F.aggregate(F.transform(trees, lambda t: leaf(t, row)), zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))

    sums = F.transform(F.array(x), total)[0]
    if classifier:
        best = F.transform(F.array(sums), lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("double"))[0]
        return df.withColumn(out, best)
    return df.withColumn(out, sums[0] / F.size(trees))


def forest_importances(nodes: DataFrame, names: list[str]) -> DataFrame:
    """M8: importance of every feature from the node table: gains weighted by rows, each tree to one, then all trees to one."""
    inner = nodes.where("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("gain"))
    trees = inner.groupBy("tree").agg(F.sum("gain").alias("total")).where("total > 0")
    share = inner.join(trees, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("total")).alias("share"))
    spine = nodes.sparkSession.createDataFrame(list(enumerate(names)), "feature_index int, feature_name string")
    whole = spine.join(share, spine["feature_index"] == share["feature"], "left").select("feature_index", "feature_name", F.coalesce("share", F.lit(0.0)).alias("share"))
    total = whole.agg(F.sum("share")).first()[0] or 1.0
    return whole.select("feature_index", F.col("feature_name").alias("feature"), (F.col("share") / F.lit(total)).alias("importance"))


# ---- saved models -------------------------------------------------------------------------------------------

FORMAT = 1
MANIFEST = "version int, format int, kind string, schema_hash string, labels array<string>, seed long, stages array<string>"


class ModelMismatch(ValueError):
    """A saved model that does not fit what it is loaded for."""


def schema_hash(schema: T.StructType | None) -> str | None:
    """Names and types in order; whether nulls are allowed does not matter."""
    return None if schema is None else hashlib.sha256(json.dumps([(f.name, f.dataType.simpleString()) for f in schema.fields]).encode()).hexdigest()


def _manifests(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest").orderBy("version").collect()
    except Exception as e:  # noqa: BLE001 - Spark reports a missing folder only through its error class
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def save_model(model, path: str, schema: T.StructType | None = None, labels: list[str] | None = None, seed: int | None = None) -> int:
    """The next version of the model in ``path`` (anything with ``write()``, or with ``save_to(folder)``); returns its number.

    ``schema`` is that of the columns the model reads."""
    spark = SparkSession.active()
    version = max((r.version for r in _manifests(spark, path)), default=-1) + 1
    folder = f"{path}/version={version}"
    if hasattr(model, "save_to"):
        model.save_to(folder)
    else:
        model.write().overwrite().save(folder)
    stages = [type(s).__name__ for s in getattr(model, "stages", [])]
    row = (version, FORMAT, f"{type(model).__module__}.{type(model).__name__}", schema_hash(schema), labels, seed, stages)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def load_model(path: str, schema: T.StructType | None = None, version: int | None = None, loader=PipelineModel.load):
    """The newest (or the given) version; refused where ``schema`` differs from the one it was saved with."""
    found = [r for r in _manifests(SparkSession.active(), path) if version is None or r.version == version]
    if not found:
        raise ModelMismatch(f"no model in {path}" + ("" if version is None else f" of version {version}"))
    row = found[-1]
    if row.format != FORMAT:
        raise ModelMismatch(f"format {row.format} of {path} is not {FORMAT}")
    if schema is not None and row.schema_hash is not None and schema_hash(schema) != row.schema_hash:
        raise ModelMismatch(f"{path} was fitted on other columns")
    return loader(f"{path}/version={row.version}")


def manifest(path: str) -> DataFrame:
    """The manifest rows of all versions."""
    return SparkSession.active().read.schema(MANIFEST).json(f"{path}/manifest")
