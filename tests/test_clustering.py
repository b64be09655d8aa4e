import hashlib

import numpy as np
import pytest

from obslytics.operators import clustering as CL
from obslytics.operators import filters as FL


def lloyd(keys, x, k, rounds):
    hashes = [hashlib.md5(str(i).encode()).hexdigest() for i in keys]
    centres = [x[min(range(len(x)), key=lambda i: hashes[i])]]
    near = lambda p: min((round(float(((p - c) ** 2).sum()), 9), j) for j, c in enumerate(centres))
    while len(centres) < k:
        centres.append(x[min(range(len(x)), key=lambda i: (-near(x[i])[0], hashes[i]))])
    for _ in range(rounds):
        label = np.array([near(p)[1] for p in x])
        centres = [x[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(k)]
    return np.array(centres), np.array([near(p)[1] for p in x])


def test_kmeans_against_plain_python(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.6, (60, 3)) for c in ([0, 0, 0], [4, 0, 1], [0, 5, 2])])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, a double, b double, c double").repartition(5)
    found = CL.kmeans(df, "id", ["a", "b", "c"], 4, 6)
    centres, label = lloyd(range(len(x)), x, 4, 6)
    assert np.allclose(found.centres, centres)
    assert {r["id"]: r["cluster"] for r in found.rows.collect()} == dict(enumerate(label.tolist()))
    assert found.sizes == np.bincount(label, minlength=4).tolist()
    assert abs(found.inertia - sum(((x[label == j] - centres[j]) ** 2).sum() for j in range(4))) < 1e-9


def test_kmeans_of_few_and_equal_rows(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(4)], "id int, a double")
    found = CL.kmeans(df, "id", ["a"], 3)
    assert found.sizes == [4, 0, 0] and found.inertia == 0 and found.centres == [[1.0]] * 3
    with pytest.raises(FL.InsufficientData):
        CL.kmeans(df.limit(0), "id", ["a"], 2)


def test_components_against_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + [3, 0, -2, 100]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([list(map(float, p)) for p in x], ", ".join(f"{n} double" for n in names))
    found = CL.components(df, names, 4)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(found.ratios, values[::-1] / values.sum())
    for load, vector in zip(found.loadings, vectors.T[::-1], strict=True):
        assert np.allclose(np.abs(load), np.abs(vector)) and max(load, key=abs) > 0
    got = np.array([[r[f"pc{j}"] for j in range(1, 5)] for r in found.project(df).collect()])
    assert np.allclose(np.cov(got.T), np.diag(values[::-1]), atol=1e-8)
    assert np.allclose(found.place(x[0].tolist()), got[[np.allclose(p[:1], x[0, :1]) for p in np.array(df.collect())]][0])


def test_components_of_constant_and_no_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 3, "a double, b double")
    found = CL.components(df, ["a", "b"], 2)
    assert found.ratios == [0.0, 0.0] and found.loadings == [[1.0, 0.0], [0.0, 1.0]]
    with pytest.raises(FL.InsufficientData):
        CL.components(df.limit(0), ["a", "b"])
