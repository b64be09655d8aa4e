import hashlib
import random
import re

from obslytics.llm import pii as P

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return sorted(found)


def line(found):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)


def corpus():
    rng = random.Random(9)
    bits = ["a.b@c.de", "x_y@z.w", "@", "a@b", "a@b.c@d.e", "a@b.c_x@d.ef", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.0.0.1", "4111 1111-1111 1111", "4111111111111111", "4111  1111",
            "4111111111111112", "+1 (555) 555-1234", "+4 9", "+12345678901234567", "(555) 555-1234", "555-555-1234", "me (at) host (dot) org", "é", "𝒳", " ", ", ", ".", "-", "+", "7", "99", "word", "\n", "tel: "]
    docs = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 30))) for _ in range(400)]
    return docs + ["", None, "1" * 30_000, "a" * 50_000, "1." * 5000, "+" + "1 " * 4000, "a@" * 3000, "4111111111111111 " * 300]


def test_base_against_brute_force(spark):
    docs = list(enumerate(corpus())) + [(3, "x@y.zz"), (None, "x@y.zz")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, candidates int")
    rows = P.report(df).collect()
    want = sorted(((d, *(sum(f[3] == k for f in brute(t)) for k in BASE), hashlib.sha256(line(brute(t)).encode()).hexdigest()) for d, t in docs), key=str)
    assert sorted((tuple(r)[:6] for r in rows), key=str) == want
    texts = {d: t for d, t in docs if d is not None}
    for r in rows:
        if r.doc_id not in (None, 3):
            assert set(line(brute(texts[r.doc_id])).split(",")) - {""} <= set(r.spans.split(","))


def test_adds_national_phones_and_redacts(spark):
    rng = random.Random(1)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    docs = [(i, f"tel: +1 ({num(3)}) {num(3)}-{num(4)} and card 9{num(15)} or +{num(1)} {num(3)} ok") for i in range(300)]
    docs += [(1000, "tel: (212) 555-0123 so é a@b.cd."), (1001, "nothing 12 here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in P.report(df).where("doc_id >= 1000").collect()}
    assert rows[1000].spans == "phone:5:19,email:25:31" and rows[1000].n_phone == 0
    assert rows[1001].spans == ""
    found = P.detected(df).where("doc_id >= 1000").select("doc_id", P.redacted(P.F.col("pii_text"), P.F.col("all")).alias("t"))
    assert dict(found.collect()) == {1000: "tel: <PHONE> so é <EMAIL>.", 1001: "nothing 12 here"}


def test_short_numbers_are_counted_beside_valid_cards(spark):
    rng = random.Random(2)

    def card():
        start = "".join(rng.choice("0123456789") for _ in range(15))
        return next(start + d for d in "0123456789" if luhn(start + d))

    docs = [(i, f"so {card()} and 34 or 2020-21 from x 999.{rng.randrange(300, 999)}.7.7 to 1.2.3.4 so") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = P.candidates(P.matches(df, "text", ()), ())
    assert P.learnt(found).thresholds[2] < float("inf")
    texts = dict(docs)
    for r in P.report(df).collect():
        assert r.spans == line(brute(texts[r.doc_id]))


def test_plain_sentences_stay(spark):
    """Sentences with "(at)" or "@" are no addresses, beside documents that teach all kinds."""
    rng = random.Random(3)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    teach = [(i, f"write to ann{i}.lee@mail{i % 7}.org or @ann or bob@home, call +1 {num(3)} {num(3)} {num(4)} or +{num(2)} {num(1)}") for i in range(400)]
    plain = ["We met (at) noon. Then we left.", "it was (at) 5.30 sharp", "see you (at) the gate", "decorated with user@override here", "a @ b", "mail bob@home now"]
    hidden = "write to ann (at) mail (dot) org now"
    df = spark.createDataFrame([*teach, *((1000 + i, t) for i, t in enumerate([*plain, hidden]))], "doc_id long, text string")
    found = P.detected(df).where("doc_id >= 1000").select("doc_id", P.redacted(P.F.col("pii_text"), P.F.col("all")).alias("t"))
    after = dict(found.collect())
    assert [after[1000 + i] for i in range(len(plain))] == plain
    assert after[1000 + len(plain)] == "write to <EMAIL> now"


def test_precision_on_planted_spans(spark):
    """Of the spans that are added beside the base ones at least nine in ten are planted numbers."""
    rng = random.Random(8)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    docs, planted = [], set()
    for i in range(600):
        text = f"call +1 ({num(3)}) {num(3)}-{num(4)} or +{num(2)} {num(2)} x, "
        if i % 3 == 0:
            at = len(text) + len("tel: ")
            text += f"tel: ({num(3)}) {num(3)}-{num(4)} "
            planted.add((i, at))
        docs.append((i, text + f"room {num(2)}-{num(2)} and {num(1)}.{num(2)}"))
    added = set()
    for r in P.report(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        base = line(brute(dict(docs)[r.doc_id])).split(",")
        added |= {(r.doc_id, int(x.split(":")[1])) for x in r.spans.split(",") if x and x not in base}
    assert len(added & planted) >= 0.9 * max(1, len(added)) and len(added & planted) >= 0.9 * len(planted)


def test_many_matches_in_one_text(spark):
    """One text of more than a megabyte full of matches, against brute force, within seconds."""
    import time
    text = "".join(f"call +1 212 555 {i % 10000:04d} or a{i}@b{i % 7}.org; é𝒳 10.0.{i % 256}.1, " for i in range(20_000))
    assert len(text.encode()) > 1_000_000
    df = spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string").coalesce(1)
    started = time.time()
    row = next(r for r in P.report(df).collect() if r.doc_id == 1)
    assert time.time() - started < 40
    assert row.base_sha256 == hashlib.sha256(line(brute(text)).encode()).hexdigest()
    started = time.time()
    found = P.detected(df).where("doc_id = 1").select("base", "all", P.redacted(P.F.col("pii_text"), P.F.col("all")).alias("t")).first()
    assert time.time() - started < 40
    at, out = 0, []
    for s in found["all"]:
        if s.start >= at:
            out.append(text[at: s.start] + f"<{P.KINDS[s.kind].upper()}>")
        at = max(at, s.end)
    assert found.t == "".join(out) + text[at:]


def test_no_python_in_the_plan_and_empty(spark):
    df = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    out = P.report(df)
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    assert out.first().spans == "email:0:6"
    assert P.report(df.limit(0)).count() == 0


def test_trees_as_expressions(spark):
    rng = random.Random(4)
    cells = [(tuple(rng.randrange(n) for n in P.FEATURES.values()), rng.randrange(5), rng.randrange(5)) for _ in range(80)]
    model = P.fit(cells, rounds=6)
    df = spark.createDataFrame([(list(c[0]),) for c in cells], "x array<int>")
    got = [r[0] for r in df.select(model.expression(P.F.col("x"))).collect()]
    want = model.score(P.np.array([c[0] for c in cells]))
    assert len(model.trees) == 6 and P.np.allclose(got, want)
