import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obslytics.llm import hard_negatives as H
from obslytics.llm import queries
from tests.conftest import SF_ORACLE

DDL = "vec_id long, embedding array<double>, label int, row int, code string"


def by_force(rows):
    """All results straight from the definition; ``rows`` in table order: (id, vector, label)."""
    good = []
    for place, (name, vector, label) in enumerate(rows):
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            good.append((place, name, label, [max(-H.LIMIT, min(H.LIMIT, math.floor(256 * x))) for x in vector]))
    key = lambda r: (-r[1], r[0][1] is None, r[0][1] or 0, r[0][0])
    out = []
    for anchor in good:
        if anchor[1] is None or anchor[1] % 50:
            continue
        score = lambda r: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(anchor[3], r[3], strict=True))))  # noqa: E731, B023
        others = [(r, score(r)) for r in good if r[0] != anchor[0] and len(r[3]) == len(anchor[3])]
        for p, ps in sorted((x for x in others if x[0][2] == anchor[2]), key=key)[:5]:
            fits = [x for x in others if x[0][2] != anchor[2] and 50 * ps <= 100 * x[1] <= 95 * ps]
            out += [(anchor[1], p[1], k, n[1], ps, ns) for k, (n, ns) in enumerate(sorted(fits, key=key)[:3], 1)]
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, c, 1, "x") for i, v, c in rows], DDL).coalesce(1)
    return [tuple(r) for r in H.mined(df, F.col("id") % 50 == 0, **more).collect()]


def vectors(n, dim, labels, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) / dim**0.5
    x[: n // 3] += rng.standard_normal(dim) / dim**0.5  # many rows alike
    rows = [(i * 10, x[i].tolist(), int(rng.integers(labels))) for i in range(n)]
    return rows + [(5 + i, x[0].tolist(), i % labels) for i in range(copies)]


@pytest.mark.parametrize("dim, labels, blocks", [(64, 3, {}), (16, 2, {"row_block": 40, "anchor_block": 7}), (70, 60, {"row_block": 100, "anchor_block": 50}), (1, 2, {})])
def test_equals_brute_force(spark, monkeypatch, dim, labels, blocks):
    monkeypatch.setattr(H, "TILE", 1 << 10)
    rows = vectors(300, dim, labels, dim, copies=60)
    assert sorted(mined(spark, rows, **blocks)) == sorted(by_force(rows))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    some = lambda k: rng.standard_normal(k).tolist()
    rows = [(0, some(4), 1), (0, some(4), 1), (50, some(3), 1), (100, None, 1), (150, some(4), None), (200, [1.0, None, 2.0, 1.0], 1), (250, [float("nan")] * 4, 1),
            (300, [0.0] * 4, 2), (350, [], 1), (400, [], 1), (401, [], 2), (450, [1e9, -1e300, 1e12, 5.0], 1), (451, [1e9, -1e300, 1e12, 5.0], 1),
            (452, [9e6, 0.0, 0.0, 7.0], 2), (None, some(4), 1), (None, some(4), 2), (500, [1.0] * 4, 3), (501, [1.0] * 4, 3), (502, [0.8] * 4, 1), (502, [0.8] * 4, 1),
            (503, [0.9] * 4, 2), (-50, some(4), 2)] + [(i, some(4), i % 3) for i in range(600, 640)]
    own = mined(spark, rows)
    assert sorted(own, key=str) == sorted(by_force(rows), key=str)
    assert any(r[0] == 350 for r in own) and any(r[0] == 450 or r[0] == 500 for r in own)
    assert mined(spark, []) == []
    assert mined(spark, [(1, some(4), 1)]) == []


def test_intervals_hold_the_scores():
    rng = np.random.default_rng(5)
    for dim in (1, 3, 64, 100):
        x = np.floor(256 * rng.standard_normal((200, dim)) * rng.choice([1e-3, 1, 50], (200, 1)))
        x[:5] = x[5]
        pdf = pd.DataFrame({"row": range(200), "id": range(200), "label": 1, "vector": [v.tobytes() for v in x.astype("<i4")]})
        turned = x @ H.rotation(dim)
        bits = np.packbits(turned >= 0, axis=1, bitorder="little")
        pdf["code"] = [b.tobytes() for b in np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))]
        pdf["along"] = np.abs(turned).sum(axis=1) / dim**0.5
        pdf["rest"] = np.sqrt(np.maximum(0, (x * x).sum(axis=1) - pdf["along"] ** 2))
        side = H.Side(pdf, dim)
        estimate, width = H.Queries(side).intervals(np.arange(200), side, slice(0, 200))
        assert (np.abs(x @ x.T - estimate) <= width).all()
        if dim == 64:  # not so wide that nothing is left out
            lengths = np.outer(side.length, side.length)
            assert (width / np.maximum(lengths, 1)).mean() < 0.7


def test_query_and_sql(spark):
    rows = sorted(tuple(r) for r in queries.QUERIES["op13_hard_negatives"](spark, SF_ORACLE).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_ORACLE}/embeddings.parquet')")
    assert rows == sorted(con.execute(queries.SQL["op13_hard_negatives"]).fetchall()) and len(rows) > 50
