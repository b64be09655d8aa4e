import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from obslytics.llm import suffix_dedup as S


def brute(docs, length):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(docs, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, length):
    rng = random.Random(seed)
    text = lambda n, abc="abcdeé \n": "".join(rng.choice(abc) for _ in range(n))
    common = [text(n) for n in (length - 1, length, length + 3, 3 * length)]
    docs = []
    for i in range(90):
        parts = [text(rng.randrange(0, 2 * length))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(common)
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice("xyz") + p[k + 1:]
            parts += [p, text(rng.randrange(0, 2 * length))]
        docs.append("".join(parts))
    docs += [docs[3], docs[3], docs[4][:-1], "a" * (2 * length), "ab" * length + "q", "", None, "\0" * (length + 1), text(length - 1)]
    docs += [common[3][:length + k] + text(9) for k in range(12)] + [text(9) + common[3][k:] for k in range(12)]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,length,cap", [(1, 40, 8192), (2, 64, 4), (3, 400, 3)])
def test_against_brute_force(spark, seed, length, cap):
    docs = corpus(seed, length)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, k1 int").repartition(4)
    got = sorted((tuple(r) for r in S.remove_repeats(df, length, cap=cap).collect()), key=str)
    assert got == brute(docs, length)


def test_column_wise_ranges():
    rng = np.random.default_rng(0)
    contexts = [bytes(rng.integers(97, 99, rng.integers(20, 40)).astype(np.uint8)) for _ in range(300)]
    before = np.array([min(10, len(c) - 8) for c in contexts])
    after = np.array([len(c) for c in contexts]) - before
    windows = Counter((i - b, c[i:i + 10]) for c, b in zip(contexts, before) for i in range(len(c) - 9))
    for c, b, got in zip(contexts, before, S.column_wise(contexts, before, after, 10)):
        covered = {x for i in range(len(c) - 9) if windows[(i - b, c[i:i + 10])] > 1 for x in range(i - b, i - b + 10)}
        assert {x for lo, hi in got for x in range(lo, hi)} == covered


def test_kept_bytes_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "x" * 50 + "end"), (1, "y" * 50)], "doc_id long, text string")
    got = {r.n_bytes: bytes(r.kept) for r in S.remove_repeats(df, 40, keep=True).collect()}
    assert got == {53: b"end", 50: b""}
    assert S.remove_repeats(df.limit(0), 40).count() == 0
    cut = spark.createDataFrame([(1, "é" * 30 + "a"), (2, "é" * 30 + "b")], "doc_id long, text string")  # 41 bytes would cut a character
    assert {r.doc_id: r.kept_text for r in S.remove_repeats(cut, 60, keep_text=True).collect()} == {1: "a", 2: "b"}


def test_query_against_brute_force(spark):
    """The registered query over all of sf0.01, by the bytes themselves, and the text that it returns."""
    from obslytics.llm import queries
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.QUERIES["op4_suffix_dedup"](spark, sf).collect()
    raw = {d: (t or "").encode() for d, t in docs}
    seen = Counter(hash(b[i:i + 400]) for b in raw.values() for i in range(len(b) - 399))
    for r in rows:
        b, covered, at = raw[r.doc_id], [], 0
        for i in range(len(b) - 399):
            if seen[hash(b[i:i + 400])] > 1:
                if covered and i <= covered[-1][1]:
                    covered[-1][1] = i + 400
                else:
                    covered.append([i, i + 400])
        kept = b""
        for lo, hi in covered:
            kept, at = kept + b[at:lo], hi
        kept += b[at:]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), len(b) - len(kept), len(covered))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and r.kept_text == kept.decode("utf-8", "replace")
    assert len(rows) == len(docs)


def test_hot_keys_stay_where_they_are(spark):
    """An anchor that most rows share: its rows are joined by broadcast, the results stay."""
    rows = [(1, i) for i in range(400)] + [(k, k) for k in range(2, 60)] * 2
    left = spark.createDataFrame(rows, "h long, x long")
    counts = left.groupBy("h").count().withColumnRenamed("count", "times")
    hot = S.hot_keys(counts, ["h"], "times", left.count())
    assert hot.count() <= 10_000 and hot.where("h = 1").count() == 1
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 60, 3)] + [(1, 7), (1, 8)], "h long, y long")
    got = S.join_apart(left, right, ["h"], hot)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "h").select("h", "x", "y").collect()))
