"""Deterministic k-means (M2, M3) and principal components (M4-M6) by plain aggregates.

K-means: the first centre is the row whose key has the smallest hash, each further one the row farthest from the centres
so far (ties by that hash); then a fixed number of rounds, each of which is one aggregate of sums by nearest centre.
Distances are compared after rounding to 9 places and ties go to the lower centre, so every engine finds the same
clusters.  Only the k centres reach the driver; the rows are stored once and scanned by each round.

Principal components: the covariances of all features come from one aggregate; the d x d matrix is turned diagonal by
a fixed number of Jacobi sweeps.  The sign of a component makes its largest loading positive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslytics.operators import filters as FL
from obslytics.session import stored

ROUNDS = 10
SWEEPS = 8


@dataclass
class Clusters:
    """``rows``: the input with ``cluster`` and ``distance`` (squared, to its centre); ``centres`` and ``sizes`` by cluster."""

    rows: DataFrame
    centres: list[list[float]]
    sizes: list[int]
    inertia: float


def _distance(cols: list[str], centre: list[float]) -> str:
    return " + ".join(f"(`{c}` - {x!r}d) * (`{c}` - {x!r}d)" for c, x in zip(cols, centre, strict=True))


def _nearest(cols: list[str], centres: list[list[float]]) -> str:
    """SQL of a struct (rounded distance, cluster, distance) of the nearest centre."""
    return "array_min(array(" + ", ".join(
        f"struct(round({_distance(cols, x)}, 9) as near, {i} as cluster, {_distance(cols, x)} as distance)" for i, x in enumerate(centres)) + "))"


def kmeans(df: DataFrame, key: str, cols: list[str], k: int, rounds: int = ROUNDS) -> Clusters:
    """Clusters of the rows of ``df`` by ``cols`` (doubles without nulls); ``key`` orders them by hash."""
    rows = stored(df, "kmeans")
    point = F.array(*(F.col(c).cast("double") for c in cols))
    hashed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    first = rows.agg(F.min_by(point, hashed)).first()[0]
    if first is None:
        raise FL.InsufficientData("k-means needs at least one row")
    centres = [list(first)]
    while len(centres) < k:
        far = -F.expr(_nearest(cols, centres) + ".near")
        centres.append(list(rows.agg(F.min_by(point, F.struct(far, hashed))).first()[0]))
    for _ in range(rounds):
        means = rows.groupBy(F.expr(_nearest(cols, centres) + ".cluster as cluster")).agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols))).collect()
        for r in means:
            centres[r["cluster"]] = [r[f"m{i}"] for i in range(len(cols))]
    out = rows.withColumn("_near", F.expr(_nearest(cols, centres))).select("*", "_near.cluster", "_near.distance").drop("_near")
    sizes = [0] * k
    inertia = 0.0
    for r in out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("d")).orderBy("cluster").collect():
        sizes[r["cluster"]], inertia = r["n"], inertia + r["d"]
    return Clusters(out, centres, sizes, inertia)


# ---- principal components -----------------------------------------------------------------------------------

def jacobi(matrix: list[list[float]], sweeps: int = SWEEPS) -> tuple[list[float], list[list[float]]]:
    """Eigenvalues, falling, and for each its unit vector, of a small symmetric matrix."""
    a = [row[:] for row in matrix]
    n = len(a)
    v = [[float(i == j) for j in range(n)] for i in range(n)]
    for _ in range(sweeps):
        for p in range(n):
            for q in range(p + 1, n):
                c, s = rotation(a[p][p], a[q][q], a[p][q])
                for m in (a, v):
                    for row in m:
                        row[p], row[q] = c * row[p] - s * row[q], s * row[p] + c * row[q]
                a[p], a[q] = [c * x - s * y for x, y in zip(a[p], a[q], strict=True)], [s * x + c * y for x, y in zip(a[p], a[q], strict=True)]
    order = sorted(range(n), key=lambda i: (-a[i][i], i))
    return [a[i][i] for i in order], [[row[i] for row in v] for i in order]


def rotation(pp: float, qq: float, pq: float) -> tuple[float, float]:
    """Cosine and sine of the rotation that makes the entry (p, q) vanish."""
    if abs(pq) < 1e-300:
        return 1.0, 0.0
    theta = (qq - pp) / (2 * pq)
    t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + math.sqrt(theta * theta + 1))
    c = 1 / math.sqrt(t * t + 1)
    return c, t * c


@dataclass
class Components:
    """Principal components: ``loadings`` by component and feature, the share of variance of each, the features' means."""

    cols: list[str]
    loadings: list[list[float]]
    ratios: list[float]
    means: list[float]

    def project(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """Adds the coordinates ``pc1``, ``pc2`` and so on."""
        out = [" + ".join(f"(`{c}` - {m!r}d) * {x!r}d" for c, m, x in zip(self.cols, self.means, load, strict=True)) for load in self.loadings]
        return df.selectExpr("*", *(f"{e} as {prefix}{i}" for i, e in enumerate(out, 1)))

    def place(self, point: list[float]) -> list[float]:
        """Coordinates of one point, e.g. a cluster's centre."""
        return [sum((x - m) * w for x, m, w in zip(point, self.means, load, strict=True)) for load in self.loadings]


def components(df: DataFrame, cols: list[str], k: int = 2) -> Components:
    """The first ``k`` principal components of ``cols``; one aggregate over the rows."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    got = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)),
                 *(F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    if any(got[f"m{i}"] is None for i in range(len(cols))):
        raise FL.InsufficientData("PCA needs at least one row")
    matrix = [[float(got[f"c{min(i, j)}_{max(i, j)}"] or 0.0) for j in range(len(cols))] for i in range(len(cols))]
    values, vectors = jacobi(matrix)
    total = sum(values)
    loadings = []
    for vector in vectors[:k]:
        top = max(range(len(cols)), key=lambda i: (round(abs(vector[i]), 9), -i))
        loadings.append([x if vector[top] >= 0 else -x for x in vector])
    return Components(cols, loadings, [x / total if total else 0.0 for x in values[:k]], [float(got[f"m{i}"]) for i in range(len(cols))])
