"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Each tree splits recursively by a random direction at a random point near the middle; vectors within a margin of the
split go to both sides.  Vectors are compared with all others of their leaves in double precision, so a link is never
wrong, and a link is missed only if every tree separates the pair.  The margin and the number of trees set that
chance; ``tests/llm`` and the README hold measured recall.

The trees are fitted on a sample of at most ``SAMPLE`` vectors; every vector is routed.  Equal vectors are one class
with a count, so a group of copies costs one row.  A cluster so tight that every split would leave most of it on both
sides is not split further: the spill of a tree has a budget, and what is left is one leaf.  A leaf with more than
``BLOCK`` vectors is compared in pairs of blocks by several tasks.  A pair that meets in many leaves counts in the first.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of
another length than most link with nothing but their equals in length; repeated rows link with each other; an empty
table gives no rows; columns other than the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslytics.llm.common import components, stored, union_find

SAMPLE = 20_000     # vectors that the trees are fitted on
TREES = 6
LEAF = 250          # vectors aimed at in a leaf
BLOCK = 1024        # vectors of one side of a comparison
TRIES = 3           # random splits of which the one with the least spill is taken
SPILL = 1.5         # how often a tree may hold a vector, times SPILL_LEVEL for each level
SPILL_LEVEL = 1.1
MARGIN = 0.35       # of the spread that a pair at the threshold has along a random direction


class Tree:
    """Splits in arrays: direction, threshold, children; a negative child is the leaf ``-1 - child``."""

    def __init__(self, sample: np.ndarray, weight: float, margin: float, leaf: int, rng: np.random.Generator):
        self.directions, self.thresholds, self.children, self.leaves = [], [], [], 0
        self.margin = margin
        self.root = self._grow(sample, weight, leaf, rng, 0, 1.0)
        self.directions = np.array(self.directions, np.float32).reshape(-1, sample.shape[1])

    def _split(self, part: np.ndarray, rng: np.random.Generator) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
        """Of some random splits that with the least spill: (share of vectors on both sides added, direction, threshold, sides)."""
        best = None
        for _ in range(TRIES):
            direction = rng.standard_normal(part.shape[1])
            direction /= np.linalg.norm(direction)
            along = part @ direction
            threshold = float(np.quantile(along, rng.uniform(0.4, 0.6)))
            left, right = part[along <= threshold + self.margin], part[along > threshold - self.margin]
            share = (len(left) + len(right)) / len(part)
            if best is None or share < best[0]:
                best = (share, direction, threshold, left, right)
        return best

    def _grow(self, part: np.ndarray, weight: float, leaf: int, rng: np.random.Generator, depth: int, copies: float) -> int:
        """``copies``: how often the spill of the splits above has multiplied a vector.  Where a part is too dense to be
        split within that budget, it stays one leaf, which is compared in blocks."""
        if len(part) * weight > leaf and len(part) >= 8 and depth < 60:
            share, direction, threshold, left, right = self._split(part, rng)
            if copies * share <= SPILL * SPILL_LEVEL ** (depth + 1) and max(len(left), len(right)) < 0.95 * len(part):
                number = len(self.thresholds)
                self.directions.append(direction)
                self.thresholds.append(threshold)
                self.children.append(None)
                self.children[number] = tuple(self._grow(side, weight, leaf, rng, depth + 1, copies * share) for side in (left, right))
                return number
        self.leaves += 1
        return -self.leaves

    def route(self, unit: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows) for every leaf that rows reach."""
        out, todo = [], [(self.root, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out.append((-1 - node, rows))
                continue
            along = unit[rows] @ self.directions[node]
            left, right = self.children[node]
            todo.append((left, rows[along <= self.thresholds[node] + self.margin]))
            todo.append((right, rows[along > self.thresholds[node] - self.margin]))
        return [(leaf, rows) for leaf, rows in out if len(rows)]


def fit_forest(classes: DataFrame, threshold: float, dim: int, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 11) -> list[Tree]:
    """Trees over a sample chosen by hash; their depth follows the number of all vectors."""
    total = classes.count()
    taken = classes.orderBy(F.xxhash64(F.lit(seed), "cls")).limit(sample).select("vector").toPandas()["vector"]
    unit = np.array([np.asarray(v, np.float64) for v in taken]).reshape(-1, dim)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    spread = np.sqrt(max(0.0, 2 - 2 * threshold) / dim)
    rng = np.random.default_rng(seed)
    return [Tree(unit, total / max(1, len(unit)), MARGIN * spread, leaf, rng) for _ in range(trees)]


def routed(classes: DataFrame, forest: list[Tree]) -> DataFrame:
    """Rows (leaf, cls, n, vector, leaves) for every leaf of every class; ``leaves`` lists all leaves of the class."""
    first = np.cumsum([0, *(t.leaves for t in forest)]).tolist()

    def route(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            vectors = np.stack([np.asarray(v, np.float64) for v in pdf["vector"]])
            unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
            at = [(start + leaf, rows) for start, tree in zip(first, forest, strict=False) for leaf, rows in tree.route(unit)]
            leaf = np.concatenate([np.full(len(rows), number, np.int32) for number, rows in at])
            row = np.concatenate([rows for _, rows in at])
            order = np.lexsort((leaf, row))
            leaf, row = leaf[order], row[order]
            lists = [x.tobytes() for x in np.split(leaf, np.searchsorted(row, np.arange(1, len(pdf))))]
            raw = [v.tobytes() for v in vectors]
            yield pd.DataFrame({"leaf": leaf, "cls": pdf["cls"].to_numpy()[row], "n": pdf["n"].to_numpy()[row],
                                "vector": [raw[i] for i in row], "leaves": [lists[i] for i in row]})

    return classes.select("cls", "n", "vector").mapInPandas(route, "leaf int, cls long, n long, vector binary, leaves binary")


def _first_common(left: list[np.ndarray], right: list[np.ndarray], leaf: int) -> np.ndarray:
    """Matrix of whether a pair already meets in an earlier leaf."""
    names = np.unique(np.concatenate([*left, *right]))
    names = names[names < leaf]

    def mark(lists):
        out = np.zeros((len(lists), len(names)), np.float32)
        for i, x in enumerate(lists):
            out[i, np.searchsorted(names, x[x < leaf])] = 1
        return out

    return mark(left) @ mark(right).T > 0


def leaf_links(rows: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Rows (cls, n_links, other): weighted counts of links, and in other rows links that connect what a leaf links."""
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("size"))
    parts = rows.join(sizes, "leaf").withColumn("blocks", F.expr(f"cast((size - 1) div {block} + 1 as int)"))
    own = F.pmod(F.xxhash64(F.lit(5), "cls"), F.col("blocks")).cast("int")
    parts = parts.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.select("leaf", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own", "cls", "n", "vector", "leaves")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, x, y = int(pdf["leaf"].iloc[0]), int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])

        def side(part):
            v = np.frombuffer(b"".join(part["vector"]), np.float64).reshape(len(part), -1)
            return v / np.linalg.norm(v, axis=1, keepdims=True), part["cls"].to_numpy(), part["n"].to_numpy(), [np.frombuffer(b, np.int32) for b in part["leaves"]]

        a, a_cls, a_n, a_in = side(pdf[pdf["own"] == x])
        b, b_cls, b_n, b_in = (a, a_cls, a_n, a_in) if x == y else side(pdf[pdf["own"] == y])
        empty = pd.DataFrame({"cls": pd.Series([], dtype="int64"), "n_links": pd.Series([], dtype="int64"), "other": pd.Series([], dtype="int64")})
        if not len(a) or not len(b):
            return empty
        close = a @ b.T >= threshold
        if x == y:
            np.fill_diagonal(close, False)
        if not close.any():
            return empty
        i, j = np.nonzero(close)
        nodes, root = union_find(a_cls[i], b_cls[j])
        touched = np.unique(i), np.unique(j)
        fresh = close[np.ix_(*touched)] & ~_first_common([a_in[k] for k in touched[0]], [b_in[k] for k in touched[1]], leaf)
        counts = [pd.DataFrame({"cls": a_cls[touched[0]], "n_links": fresh @ b_n[touched[1]], "other": 0})]
        if x != y:
            counts.append(pd.DataFrame({"cls": b_cls[touched[1]], "n_links": fresh.T @ a_n[touched[0]], "other": 0}))
        edges = pd.DataFrame({"cls": nodes, "n_links": -1, "other": root})
        return pd.concat([*counts, edges[nodes != root]], ignore_index=True)

    return parts.groupBy("leaf", "x", "y").applyInPandas(compare, "cls long, n_links long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES,
                    leaf: int = LEAF, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Rows (id, n_links, component_id, kept) for every row of ``vectors``."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))
    rows = rows.withColumn("cls", F.when(F.col("vector").isNotNull() & ~bad & (norm > 0) & (norm < float("inf")), F.xxhash64("vector")))
    classes = stored(rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.first("vector").alias("vector")), "classes")
    links = None
    for (dim,) in classes.select(F.size("vector")).distinct().collect():  # vectors of one table have one length as a rule
        own = classes.where(F.size("vector") == dim)
        found = stored(leaf_links(routed(own, fit_forest(own, threshold, dim, trees, leaf, sample)), threshold, block), "leaf-links")
        links = found if links is None else links.union(found)
    if links is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    group = components(links.where("n_links < 0").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    counts = links.where("n_links >= 0").groupBy("cls").agg(F.sum("n_links").alias("others"))
    grouped = classes.select("cls", "n", "first").join(group.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    known = (grouped.join(smallest, "component").join(counts, "cls", "left")
             .select("cls", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    out = rows.select("id", "cls").join(known, "cls", "left")
    whole = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), whole.alias("component_id"),
                      F.col("id").eqNullSafe(whole).alias("kept"))
