import itertools
import math
import random
import re

import numpy as np
import pytest

from obslytics.llm import jaccard_join as J


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "Of", "é", "a"]) if rng.random() < 0.3 else f"w{rng.randrange(4000)}"
    text = lambda n: [word() for _ in range(n)]
    passage = text(80)
    docs = []
    for size in [3, 5, 8, 9, 11, 13, 16, 20, 24, 40, 60, 120, 500]:
        for _ in range(6):
            base = text(size)
            if rng.random() < 0.3:
                base = passage + base
            docs.append(base)
            for _ in range(rng.choice([0, 1, 2, 14])):
                copy = list(base)
                for _ in range(rng.choice([0, 1, 1, 2, max(1, size // 45), max(1, size // 40)])):
                    at = rng.randrange(len(copy))
                    kind = rng.random()
                    if kind < 0.4:
                        copy[at] = word()
                    elif kind < 0.7 and len(copy) > 1:
                        del copy[at]
                    else:
                        copy.insert(at, word())
                docs.append(copy)
    rng.shuffle(docs)
    return [(i * 3, rng.choice([" ", "\n", "  "]).join(d)) for i, d in enumerate(docs)] + [(5000, ""), (5001, None), (5002, " \t")]


@pytest.mark.parametrize("seed,run_limit", [(1, 8), (2, 2), (3, 3)])
def test_against_brute_force(spark, seed, run_limit):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, set int").repartition(3)
    got = sorted(tuple(r) for r in J.near_duplicates(df, run_limit=run_limit).collect())
    assert got == brute(docs)


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    sim = J.Similarity()
    for size in [1, 2, 4, 5, 7, 8, 9, 10, 12, 14, 16, 17, 20, 31, 33, 50, 64, 100, 130, 400, 1000, 9000]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            gone = rng.integers(0, size // 5 + 1)
            new = rng.integers(0, size // 4 + 1)
            b = np.unique(np.concatenate([a[gone:] if rng.random() < 0.5 else rng.permutation(a)[gone:],
                                          rng.integers(0, 2**63, new, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both * 100 >= 80 * (len(a) + len(b) - both):
                assert len(np.intersect1d(J.signatures(a, sim), J.signatures(b, sim)))


def test_small_linked_sets_meet_wherever_their_shingles_lie():
    sim = J.Similarity()
    for size in range(1, 11):
        segments = J.allocate(sim, J.band_of(size)).segments
        for placement in itertools.combinations_with_replacement(range(segments), size):
            larger = np.array([(k * segments + s) << 7 for k, s in enumerate(placement)], np.uint64)
            mine = J.signatures(np.sort(larger), sim)
            for gone in range(size - -(-size * sim.num // sim.den) + 1):
                for left in itertools.combinations(larger, size - gone):
                    assert len(left) > 8 or len(np.intersect1d(mine, J.signatures(np.sort(np.array(left)), sim))), (placement, left)


def test_enough_segments_for_every_size_of_a_band():
    sim = J.Similarity()
    for number in range(9):
        band = J.allocate(sim, number)
        for size in range(-(-band.low * sim.num // sim.den), band.high + 1):
            few = sim.indexed(size) - 1
            if band.threshold == 0 and few:
                assert math.log(math.comb(band.segments, few)) + size * math.log(few / band.segments) < math.log(1e-15), (band, size)


def test_ties_nulls_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "A  b"), (3, "b a"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in J.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, 1, 1), (2, 1, 1), (3, 1, 3), (None, 0, None)], key=str)
    assert J.near_duplicates(df.limit(0)).count() == 0


def test_sets_below_frequent_signatures_meet_their_centre(spark):
    """One join of as many rows as there are sets, whatever their signatures' shares, and no place with most of a hot signature's."""
    placed = [(1, s) for s in range(5000, 8000)] + [(k, 10 * k + i) for k in range(2, 40) for i in range(9)] + [(50, 7777), (50, 3)]
    times = {1: 3100, 50: 2}  # a set may be left out of a frequent signature that it has
    df = spark.createDataFrame([(g, times.get(g, 9), s) for g, s in placed], "signature long, times long, set long")
    low = {g: min(s for h, s in placed if h == g) for g, _ in placed}
    got = J.stars(df)
    assert sorted(map(tuple, got.collect())) == sorted({(low[g], s) for g, s in placed if s != low[g]})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "LeftAnti" not in plan
    assert "deal" in plan


def test_frequent_signatures_bring_their_times(spark):
    df = spark.createDataFrame([(i, "a b c d e f g h " + "xyz"[i % 3] * (i // 3 + 1)) for i in range(60)], "doc_id long, text string").repartition(3)
    sim = J.Similarity()
    rows = J.proposals(J.packed_signatures(df, "text", sim, 4, 2), sim, 2).where("signature is not null").collect()
    assert rows and max(r.times for r in rows) == 60
    for r in rows:
        assert r.times == sum(len(x.members) // 8 for x in rows if x.signature == r.signature)


def test_sets_far_apart_are_not_compared(spark):
    """Only sets that can link stay in one family, whatever lines they share; so a large family is not compared as a whole."""
    rng = random.Random(8)
    common = " ".join(f"c{i}" for i in range(30))
    texts = {k: common + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for k in range(400)}
    for k in range(0, 400, 40):  # each of these has a partner
        texts[1000 + k] = texts[k] + " more"
    names = {k: J.fingerprint(next(J.shingle_sets(J.pa.array([t])))) for k, t in texts.items()}
    df = spark.createDataFrame([(names[k], t) for k, t in texts.items()], "set long, text string").repartition(3)
    sets = J.compressed(df.selectExpr("0L as id", "set as text_key", "text")).selectExpr("text_key as set", "packed")
    met = J.meetings(df.select("set"), sets, J.Similarity(), 5).collect()
    nodes, root = J.union_find(np.array([r.a for r in met]), np.array([r.b for r in met]))
    family = dict(zip(nodes.tolist(), root.tolist()))
    for k in range(0, 400, 40):
        assert family[names[k]] == family[names[1000 + k]]
    assert sorted(np.unique(root, return_counts=True)[1].tolist()) == [2] * 10


def test_meetings_connect_all_linked_sets(spark):
    sim = J.Similarity()
    sets = {t: s for _, t in corpus(5) if t and len(s := next(J.shingle_sets(J.pa.array([t]))))}
    names = {t: J.fingerprint(s) for t, s in sets.items()}
    df = spark.createDataFrame([(n, t) for t, n in names.items()], "set long, text string").repartition(3).dropDuplicates(["set"])
    packed = J.compressed(df.selectExpr("0L as id", "set as text_key", "text")).selectExpr("text_key as set", "packed")
    met = J.meetings(df.select("set"), packed, sim, 3).collect()
    nodes, root = J.union_find(np.array([r.a for r in met]), np.array([r.b for r in met]))
    family, linked = dict(zip(nodes.tolist(), root.tolist())), 0
    for (_, a), (_, b) in itertools.combinations([(t, sets[t]) for t in sets], 2):
        both = len(np.intersect1d(a, b))
        if both * sim.den >= (len(a) + len(b) - both) * sim.num and J.fingerprint(a) != J.fingerprint(b):
            linked += 1
            assert family[J.fingerprint(a)] == family[J.fingerprint(b)]
    assert linked > 50


def test_each_part_gets_its_own_signatures(spark):
    """However many parts there are, a batch of texts gives the same signatures, one row for each part that has some."""
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(50)], "doc_id long, text string").coalesce(1)
    sim = J.Similarity()
    few, many = (J.packed_signatures(df, "text", sim, parts, 8).collect() for parts in (1, 500))
    found = np.sort(J._from_six(few[0].signatures))
    assert len(few) == 1 and len({r.part for r in many}) == len(many) > 300
    assert np.array_equal(found, np.sort(np.concatenate([J._from_six(r.signatures) for r in many])))
    for r in many:
        assert set((J._from_six(r.signatures) % 2**48).tolist()) <= set(found.tolist())
        owner = np.frombuffer(r.owners, np.int64)[np.frombuffer(r.owner_of, "<u2")]
        assert len(owner) == len(J._from_six(r.signatures)) and len(r.owners) == 2 * len(r.sizes)
