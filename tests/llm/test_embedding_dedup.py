import numpy as np
import pytest

from obslytics.llm import embedding_dedup as E


def brute(rows, threshold=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    unit = np.array([np.array(rows[i][1], np.float64) / np.linalg.norm(rows[i][1]) for i in good])
    close = unit @ unit.T >= threshold
    np.fill_diagonal(close, False)
    root = list(range(len(good)))
    while True:
        new = [min([root[i], *(root[j] for j in np.flatnonzero(close[i]))]) for i in range(len(good))]
        if new == root:
            break
        root = new
    out = {i: (r[0], 0, r[0]) for i, r in enumerate(rows)}
    low = {}
    for i, r in zip(good, root):
        low[r] = min(low.get(r, rows[i][0]), rows[i][0])
    for i, r, c in zip(good, root, close.sum(1)):
        out[i] = (rows[i][0], int(c), low[r])
    return sorted((d, n, c, d == c) for d, n, c in out.values())


def corpus(seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, 32))
    rows = [rng.standard_normal(32) for _ in range(500)]
    for c in centres:
        rows += [c + 0.12 * rng.standard_normal(32) for _ in range(rng.integers(1, 20))]
    rows += [centres[0]] * 80 + [centres[1] * 3]
    rows += [centres[2] + 0.02 * rng.standard_normal(32) for _ in range(150)]
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] + [0.0] * 31]
    return rows + [(10_000 + i, v) for i, v in enumerate(odd)]


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 37)])
def test_against_brute_force(spark, seed, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cls int").repartition(3)
    got = sorted(tuple(r) for r in E.near_duplicates(df, leaf=60, block=block).collect())
    want = brute(rows)
    found = sum(g[1] for g in got)
    links = sum(w[1] for w in want)
    assert found <= links and found >= 0.99 * links
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) > 0.98


def test_ties_nulls_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [2.0, 0.0]), (3, None), (2, [0.0, 1.0]), (4, [1.0])], "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in E.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (3, 0, 3, True), (2, 0, 2, True), (4, 0, 4, True)], key=str)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_tight_clusters_stay_within_the_budget():
    """Thousands of near copies of one vector among others: no vector reaches more leaves than the budget allows."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((10_000, 64))
    x[:3000] = x[0] + 0.1 * rng.standard_normal((3000, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    spread = np.sqrt(0.1 / 64)
    for seed in range(3):
        tree = E.Tree(unit, 1.0, E.MARGIN * spread, E.LEAF, np.random.default_rng(seed))
        routed = tree.route(unit.astype(np.float32))
        assert sum(len(rows) for _, rows in routed) < 6 * len(x)


def test_near_copies_keep_all_links(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    rows = [(i, (centre + 0.1 * rng.standard_normal(64)).tolist()) for i in range(3000)] + [(5000 + i, rng.standard_normal(64).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in E.near_duplicates(df).collect())
    x = np.array([np.float32(v) for _, v in rows], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert links.sum() > 8_000_000
    found = sum(g[1] for g in got)
    assert 0.999 * links.sum() <= found <= links.sum()
    assert all(g[2] == (0 if g[0] < 3000 else g[0]) for g in got if links[g[0] if g[0] < 3000 else g[0] - 2000])


def test_recall_of_the_query(spark):
    """The registered query over all of sf0.1 against all pairs."""
    from obslytics.llm import queries
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = sorted(tuple(r) for r in queries.QUERIES["op5_embedding_dedup"](spark, sf).collect())
    links = sum(w[1] for w in want)
    assert len(got) == len(want) and sum(g[1] for g in got) >= 0.99 * links
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
