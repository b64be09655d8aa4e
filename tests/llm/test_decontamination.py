import hashlib
import random
import re

import pytest

from obslytics.llm import decontamination as D

SCHEMA = "doc_id long, text string, id string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, bench):
    wins = []
    for item, text in bench:
        w = words(text)
        n = min(13, len(w))
        wins += [(item, w[i:i + n]) for i in range(len(w) - n + 1 if n else 0)]
    out = []
    for doc, text in docs:
        w = words(text)
        hit, items = set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    items.add(str(item))
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT_BYTES", 2000)
    rng = random.Random(5)
    vocab = ["The", "of", "and", "Ärger", "x1", "9", "alpha", "beta", "gamma"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ".", "!"]) for _ in range(n))
    bench = [(i, text(rng.choice([0, 1, 2, 5, 13, 14, 30]))) for i in range(25)] + [(90, None), (91, "  "), (92, text(20))]
    docs = []
    for i in range(120):
        base = text(rng.choice([0, 1, 3, 20, 300]))
        if rng.random() < 0.5:
            base += " " + (rng.choice(bench)[1] or "") + "; " + text(4)
        docs.append((i, base))
    docs += [(500, None), (501, ""), (502, (bench[20][1] or "") + " end"), (502, (bench[20][1] or "") + " end"), (None, text(40)),
             (503, text(30000) + " " + bench[-1][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA)
    b = spark.createDataFrame([(i, t, "y") for i, t in bench], "item_id long, text string, doc_id string")
    got = sorted([tuple(r)[:6] for r in D.contamination(df, b).collect()], key=str)
    assert got == brute(docs, bench)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x")], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in D.contamination(df, none).collect()] == [(1, 2, 0, 0)]
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert D.contamination(df.limit(0), bench).count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(7, "red green blue")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "blue x green y red z"), (2, "red a b c d e f g blue green"), (3, "red green"),
                                  (4, "red green blue"), (5, None)], "doc_id long, text string")
    tests = D.phrases(bench)
    index = D.build_index(docs)
    assert {(r.id, r.item) for r in D.proximity(index, tests, 2).collect()} == {(1, "7"), (4, "7")}
    assert {r.id for r in D.search(index, tests).where("n_hit > 0").collect()} == {4}


def test_refuses_oversized_query_set(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_QUERY_WORDS", 2)
    with pytest.raises(ValueError):
        D.phrases(spark.createDataFrame([(7, "red green blue")], "item_id long, text string"))
