import numpy as np
import pyarrow as pa

from obslytics.llm import quality as Q
from obslytics.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = QUERIES["op1_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out and quality is not null").toPandas()
    assert len(rows) > 500
    right = (rows["predicted"] == rows["quality"]).mean()
    good, bad = rows[rows["quality"] == 1]["score"], rows[rows["quality"] == 0]["score"]
    assert right > 0.98 and (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.98
    assert right > max(rows["quality"].mean(), 1 - rows["quality"].mean()) + 0.05


def test_features_of_known_texts():
    x = Q.features(pa.array(["Ab a a. c\nc c", None, "", " \n ", "##|9é " * 3]))
    f = dict(zip(Q.FEATURES, x[0], strict=True))
    assert f["log_words"] == np.log1p(6) and f["repeated_neighbours"] == 2 / 6 or f["repeated_neighbours"] == 1 / 6 + 1 / 6
    assert f["upper"] == 1 / 13 and f["stop"] == 1 / 13 and f["commonest_word"] == 0.5
    assert not x[1:4].any()
    g = dict(zip(Q.FEATURES, x[4], strict=True))
    assert abs(g["symbol"] - 6 / 21) < 1e-9 and abs(g["bar"] - 3 / 21) < 1e-9 and g["distinct_words"] == 1 / 3


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit(x[:3000], y[:3000])
    assert model.pairs[0] == (0, 1)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    logit = np.full(1000, model.base)
    bins = model.bins(x[3000:])
    for i in range(1000):
        logit[i] += sum(t[bins[i, f]] for f, t in enumerate(model.tables)) + sum(t[bins[i, a], bins[i, b]] for (a, b), t in zip(model.pairs, model.pair_tables))
    assert np.allclose(model.logit(bins), logit)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, text int")
    x, y = Q.labelled_features(docs, labels)
    assert len(x) == len(y) and set(y) <= {1.0}
    for lab in (labels, labels.limit(0)):
        rows = Q.scored(docs, Q.learnt(docs, lab), keep=("doc_id",)).collect()
        assert len(rows) == 4 and all(0 <= r.quality_score <= 1 for r in rows)
    assert Q.scored(docs.limit(0), Q.fit(x, y), keep=("doc_id",)).count() == 0
