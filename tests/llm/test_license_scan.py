import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from obslytics.llm import license_scan as L


def brute(docs, templates):
    out = {}
    for doc, text in docs:
        words = L.words_of(text)
        for name, template in templates:
            mine = L.words_of(template)
            if not mine:
                continue
            n, size, want = len(mine), min(5, len(mine)), L.shingles_of(mine)
            for first in range(0, len(words), n):
                w = words[first:first + 2 * n]
                have = {" ".join(w[i:i + size]) for i in range(len(w) - size + 1)}
                if 100 * len(have & want) >= 80 * len(want):
                    out.setdefault((doc, name), {})[first] = max(out.get((doc, name), {}).get(first, 0), len(have & want) / len(want))
    return sorted(((d, t, len(x), min(x), max(x.values())) for (d, t), x in out.items()), key=str)


def corpus():
    rng = random.Random(6)
    plain = lambda n: " ".join(rng.choice(["the", "of", "License", "é", "word", "permission", "reserved", f"w{rng.randrange(99)}"]) for _ in range(n))
    docs = []
    for i in range(150):
        parts = [plain(rng.randrange(60))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            t = rng.choice(list(L.TEMPLATES.values())).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice(["changed", "LICENSE,"])
            parts += [" ".join(t).upper() if rng.random() < 0.2 else "\n".join(t), plain(rng.randrange(60))]
        docs.append((i, " ".join(parts)))
    return docs + [(900, ""), (901, None), (902, "All rights reserved."), (902, "All rights reserved."), (None, "MIT. Released under the MIT License"), (903, "x " * 20000 + "all rights  reserved")]


def test_against_brute_force_and_sql(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, words string").repartition(3)
    got = sorted((tuple(r) for r in L.scan(df, L.templates_frame(spark)).collect()), key=str)
    assert got == brute(docs, sorted(L.TEMPLATES.items()))
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert sorted(duck.execute(L.sql()).fetchall(), key=str) == got


def test_required_words_lose_nothing():
    rng = random.Random(1)
    for text in L.TEMPLATES.values():
        want = L.shingles_of(L.words_of(text))
        for num in (80, 100):
            chosen = L.required_words(want, num, 100)
            left = [s for s in want if not chosen & set(s.split())]
            assert 100 * len(left) < num * len(want)
    assert rng


def test_common_notices_are_registered(spark):
    names = ["BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0 notice", "LGPL-3.0 notice", "AGPL-3.0 notice", "CC-BY-SA-4.0", "SPDX GPL-3.0-or-later"]
    docs = [(n, f"so it is {L.TEMPLATES[n]} and more") for n in names]
    mine = {n: L.TEMPLATES[n] for n in names}
    got = L.scan(spark.createDataFrame(docs, "doc_id string, text string"), L.templates_frame(spark, mine)).collect()
    assert sorted(tuple(r) for r in got) == brute(docs, sorted(mine.items()))
    assert set(names) <= {r.license_id for r in got if r.doc_id == r.license_id}


def test_least_words_lose_nothing():
    rng = random.Random(7)
    for text in L.TEMPLATES.values():
        words = L.words_of(text)
        want = L.shingles_of(words)
        chosen, least = L.least_words(want, 80, 100)
        for _ in range(100):
            gone = set(rng.sample(sorted(set(words)), min(len(set(words)), rng.randrange(6))))
            left = {s for s in want if not gone & set(s.split())}
            if 100 * len(left) >= 80 * len(want):
                assert len(set(chosen) - gone) >= least


@pytest.mark.parametrize("length,rows", [(3, 300_000), (5, 200_000), (8, 100_000)])
def test_bands_miss_as_seldom_as_claimed(spark, length, rows):
    size = min(L.SHINGLE, length)
    want = length - size + 1
    both = -(-want * 80 // 100)
    bands = L.bands_for(length, want, 80, 100)
    shingles = lambda first, n: F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda k: F.xxhash64("id", k))
    template, window = shingles(0, want), shingles(want - both, 2 * length - size + 1)  # they have ``both`` shingles in common
    missed = spark.range(rows).where(~F.arrays_overlap(L._bands(template, bands), L._bands(window, bands))).count()
    assert missed <= 3  # of 100,000 to 300,000 at a chance of 1e-6


def test_native_plan_and_edges(spark):
    df = spark.createDataFrame([(1, "all rights reserved")], "doc_id long, text string")
    out = L.scan(df, L.templates_frame(spark))
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    assert [tuple(r)[:4] for r in out.collect()] == [(1, "all rights reserved", 1, 0)]
    assert L.scan(df.limit(0), L.templates_frame(spark)).count() == 0
    assert L.scan(df, L.templates_frame(spark, {"a": "...", "b": ""})).count() == 0
    assert L.scan(df, L.templates_frame(spark).limit(0)).count() == 0
    double = L.scan(df, L.templates_frame(spark, {"a": "all rights", "b": "All rights"}))
    assert sorted(r.license_id for r in double.collect()) == ["a", "b"]


def test_documents_are_scanned_once(spark, tmp_dir):
    spark.createDataFrame([(1, "all rights reserved"), (2, "none")], "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    plan = L.scan(spark.read.parquet(f"{tmp_dir}/documents.parquet"), L.templates_frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert len({len(L.words_of(t)) for t in L.TEMPLATES.values()}) > 20  # of so many lengths


def test_more_templates_than_are_held_at_a_time(spark, monkeypatch):
    """Beyond the bound templates are searched in parts; equal ids in several parts are one template id."""
    monkeypatch.setattr(L, "MOST_TEMPLATES", 3)
    docs = corpus()[:150]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    some = [("a", "All rights reserved."), ("b", "Released under the MIT License."), ("c", "..."), ("a", "Licensed under CC BY-NC 4.0."), ("d", L.TEMPLATES["MIT notice"]),
            ("e", L.TEMPLATES["BSD-2-Clause"]), ("f", L.TEMPLATES["GPL-3.0 line"])]
    got = L.scan(df, spark.createDataFrame(some, "license_id string, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, some) and len(got) > 5
