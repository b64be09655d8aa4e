"""Helpers shared by the training-data operators: stored intermediates and connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obslytics.session import checkpoint_dir, default_parallelism


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"


FILE_ROWS = 250_000  # of narrow tables whose size is known beforehand


def stored(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends, any executor can reread it.

    ``rows``, a bound of its rows where one is known, keeps a narrow table from being written as many small files."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    if rows is not None:
        df = df.coalesce(max(default_parallelism(spark), -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HOT_KEYS = 10_000    # a key that holds more than this share of all rows is joined apart: there are at most so many


def hot_keys(counts: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """Keys with more than ``total / HOT_KEYS`` rows, of ``counts`` (one row a key) that sum up to ``total``: at most ``HOT_KEYS``."""
    return counts.where(F.col(rows) * HOT_KEYS > total).select(*keys)


def join_apart(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join (inner or left) by ``keys`` that leaves the rows of hot keys where they are: their few rows of ``right`` are broadcast."""
    hot = F.broadcast(hot)
    few = F.broadcast(right.join(hot, keys, "left_semi"))
    return left.join(hot, keys, "left_semi").join(few, keys, how).unionByName(left.join(hot, keys, "left_anti").join(right, keys, how))


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links ``a - b`` and, for each, the smallest node that it reaches by them."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        np.minimum.at(root, before, root.copy())  # a root that moved takes its tree along
        root = root[root]
        if np.array_equal(root, before):
            return nodes, nodes[root]


def _forest(batches):
    """Replaces each batch of links by (node, smallest reachable node): at most one row per node."""
    for pdf in batches:
        if len(pdf):
            nodes, root = union_find(pdf["a"].to_numpy(), pdf["b"].to_numpy())
            moved = nodes != root
            yield pd.DataFrame({"a": nodes[moved], "b": root[moved]})


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)`` (longs): rows (node, component), component = smallest node.

    Alternating large-star / small-star rounds; each round is a pair of shuffles of at most one row per link,
    with the minimum taken map-side, and is written to the shared folder.  A node of any degree is a sum of
    partial minima; the join back to its neighbours is left to AQE's skew handling.
    Null ends and self links are ignored; no links give no rows.
    """
    edges = (links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
             .select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
             .mapInPandas(_forest, "a long, b long").distinct())
    edges = stored(edges, "links")
    state, n = None, edges.count()
    while True:
        # large star: strictly larger neighbours move to the smallest node of the neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: each node keeps its smallest neighbour, the others are tied to that one
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = stored(large.join(small, "a")
                       .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                 F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                       .select("e.*").where("a != b").distinct(), "stars", 2 * n)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, n = now, now[0]
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.union(roots)
