import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from obslytics.llm import periodic_runs as R
from obslytics.llm import queries
from tests.conftest import SF_SMALL


def smallest_period(x):
    return next(q for q in range(1, len(x) + 1) if all(x[i] == x[i + q] for i in range(len(x) - q)))


def by_force(x):
    """All runs straight from the definition: for each period the longest stretches, kept where the period is smallest."""
    out = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and smallest_period(x[i: j + q]) == q:
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc, words):
    runs = by_force(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    text = " ".join(w.decode() for i, w in enumerate(words) if i not in dropped)
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest())


def runs_of(texts):
    numbers = [np.unique(np.array(list(t), dtype="U9"), return_inverse=True)[1] + 1 if len(t) else np.zeros(0, np.int64) for t in texts]
    base = np.cumsum([0, *(int(x.max(initial=0)) for x in numbers)])
    offsets = np.cumsum([0, *map(len, texts)])
    parts = [x + b for x, b in zip(numbers, base, strict=False)]
    found = R.find_runs(np.concatenate(parts), np.concatenate(numbers).astype(np.uint64), offsets)
    return [[(s - a, e - s, q) for s, e, q in found.tolist() if a <= s < b] for a, b in zip(offsets, offsets[1:], strict=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=60) | st.text("abcd", max_size=90), min_size=1, max_size=4))
def test_runs_of_small_alphabets(texts):
    assert runs_of(texts) == [by_force(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 12), st.text("abx", max_size=3)), min_size=1, max_size=6))
def test_runs_of_repeats(parts):
    text = "".join(root * times + rest for root, times, rest in parts)
    assert runs_of([text, text, "a" * 7, text[::-1]]) == [by_force(t) for t in (text, text, "a" * 7, text[::-1])]


@pytest.mark.parametrize("period", [1, 2, 3, 7, 8, 63, 64, 65, 1000])
def test_long_periods(period):
    rng = random.Random(period)
    root = [str(rng.randrange(40)) for _ in range(period)]
    while smallest_period(root) != period:
        root = [str(rng.randrange(40)) for _ in range(period)]
    text = ["<"] * 3 + (root * 7)[: 4 * period + 2] + [">", "?"]
    found = runs_of([text])[0]
    length = 4 * period + 2
    while 3 + length < len(text) and text[3 + length] == text[3 + length - period]:
        length += 1
    assert (3, length, period) in found if length >= 6 else not found


def test_one_word_many_times_is_one_run():
    assert runs_of([["a"] * 300_000]) == [[(0, 300_000, 1)]]


def test_transforms():
    for prime, root in R.PRIMES:
        for size in (2, 16, 256):
            x = np.random.default_rng(size).integers(0, prime, (3, size)).astype(np.uint64)
            assert (R.backward(R.forward(x.copy(), prime, root), prime, root) == x).all()


def test_more_primes_for_larger_numbers():
    rng = np.random.default_rng(1)
    for high in (5, 1 << 14, 1 << 30):
        blocks = rng.integers(0, high, (20, 16)).astype(np.uint64)
        windows = rng.integers(0, high, (20, 32)).astype(np.uint64)
        for i in range(20):
            windows[i, i % 16: i % 16 + 16] = blocks[i]
        want = np.array([[(blocks[i] == windows[i, d: d + 16]).all() for d in range(16)] for i in range(20)])
        assert (R.no_mismatch(blocks, windows) == want).all()


def test_equal_hashes_do_not_make_runs(monkeypatch):
    monkeypatch.setattr(R.W, "mix", lambda h: h * 0)
    text = "abcabcabcabcabcaxx" + "ba" * 9 + "y"
    assert runs_of([text]) == [by_force(text)]


def test_rows(spark):
    texts = [None, "", " \t\n", "a", "b " * 6, "b\n" * 5, "x " + "to be " * 4 + "or", "a b " * 30 + "c " * 40, "é\xa0é " * 7, "w " * 20_000, "a b c " * 2]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "q " * 9), (3, "same " * 8), (3, "same " * 8)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, start int, runs string").repartition(2)
    rows = R.periodic_runs(df, keep=True).collect()
    small = [(d, t) for d, t in docs if t is None or len(t) < 1000]
    own = [tuple(r)[:8] for r in rows if r.start is None or r.length < 1000]
    assert sorted(own, key=str) == sorted((expected(d, (t or "").encode().split()) for d, t in small), key=str)
    long = next(r for r in rows if r.length == 20_000)
    assert (long.collapsed, long.runs[0].period, long.exponent_milli) == ("w", 1, 20_000_000)
    assert next(r for r in rows if r.doc_id == 6).collapsed == "x to be or"
    assert R.periodic_runs(df.limit(0)).collect() == []


def test_planted_rule():
    words = [str(i).encode() for i in range(50)]
    for doc in range(60):
        h = zlib.crc32(str(doc).encode())
        g, want = h // 10, list(words)
        if h % 10 == 0:
            a = g % 50
            p = 1 + (50 - a) // (3 + g % 8)
            want = [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
        assert queries.with_planted_repeats(doc, list(words)) == want
    assert queries.with_planted_repeats(None, words) == words
    assert queries.with_planted_repeats(57, []) == []


def test_query_against_brute_force(spark):
    rows = queries.QUERIES["op11_periodic_runs"](spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in docs)
    own = {r.doc_id: tuple(r) for r in rows}
    for d in docs:
        words = queries.with_planted_repeats(d.doc_id, (d.text or "").encode().split())
        if len(words) <= 3000:
            assert own[d.doc_id] == expected(d.doc_id, words)
    assert sum(r.n_runs > 0 for r in rows) >= 5
