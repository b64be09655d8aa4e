import re

import corpus_pipeline as C
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import test_decontamination, test_jaccard_join, test_pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, text_key int"


def docs_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, tmp_dir):
    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    all_ = {r.doc_id: r.text for r in source.collect()}
    stages = dict(C.STAGES)

    one = stages["quality"](spark, source, sf).cache()
    left = docs_of(one)
    assert one.columns == source.columns and 0 < len(left) < len(all_)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(quality.get(d) == 1 for d, _ in left) >= 0.98 * sum(q == 1 for q in quality.values())

    two = stages["near_duplicates"](spark, one, sf).cache()
    assert docs_of(two) == sorted(((d, all_[d]) for d, n, c in test_jaccard_join.brute(left) if d == c), key=str)

    three = stages["decontamination"](spark, two, sf).cache()
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert docs_of(three) == sorted(((r[0], all_[r[0]]) for r in test_decontamination.brute(docs_of(two), bench) if not r[5]), key=str)

    four = stages["pii"](spark, three, sf).cache()
    after = dict(docs_of(four))
    assert set(after) == {d for d, _ in docs_of(three)}
    for d, text in after.items():
        base = test_pii.brute(all_[d])
        assert (text == all_[d]) == (not base) or re.search("<(EMAIL|IP|CARD|PHONE)>", text)
        assert not any(all_[d][s:e] in text for s, _, e, _ in base)

    five = stages["packing"](spark, four, sf).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in after.items()}
    for d, n in tokens.items():
        assert sum(r.length for r in five if r.doc_id == d) == n


def test_extra_columns_with_the_names_of_operators(spark):
    """Every stage but the last returns every column as it came, whatever its name."""
    names = ["quality_score", "text_to_score", "pii_text", "candidates", "valid", "base", "all", "id_key", "text_key", "class", "component_id", "row",
             "doc id.x", "h", "id", "n_shingles", "contaminated", "set"]
    texts = ["one two three four five six seven", "one two three four five six seven", "write to me@x.yy or 1.2.3.4 about some other thing", None, "", "lone"]
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in [("doc_id", "long"), ("text", "string"), *((n, "string") for n in names)]))
    sf = "/root/testdata/sf0.001"
    all_ = {r[0]: tuple(r) for r in rows}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns, name
        got = {r[0]: tuple(r) for r in out.collect()}
        for i, row in got.items():
            assert row[2:] == all_[i][2:] and (name == "pii" or row[1] == all_[i][1]), name
        if name == "near_duplicates":
            assert set(got) == {0, 2, 3, 4, 5}
        if name == "pii":
            assert len(got) == 6 and got[2][1] == "write to <EMAIL> or <IP> about some other thing"
    assert C.packed(spark, df, sf).count() == 6


def test_near_duplicates_of_one_id(spark):
    same = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    df = spark.createDataFrame([(7, same), (7, same + " and"), (7, "other words here"), (None, "no id at all here"), (None, "no id at all here")], "doc_id long, text string")
    left = docs_of(C.one_of_each(spark, df, "/root/testdata/sf0.001"))
    assert len(left) == 3 and (None, "no id at all here") in left and (7, "other words here") in left


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 11, 0)] * 3 + [(None, "a b c d e f", None, None, None, 0), (None, None, None, None, None, 0), (2, "", "en", "s", 0, 0),
            (2, "", "en", "s", 0, 0), (3, "g h i j k l me@x.yy", "en", "s", 99, 0), (None, "own words of this text", "en", "s", 5, 0)]
    df = spark.createDataFrame(rows, COLUMNS)
    sf = "/root/testdata/sf0.001"
    two = C.one_of_each(spark, df, sf)
    assert docs_of(two) == sorted([(1, "a b c d e f"), (None, None), (2, ""), (2, ""), (3, "g h i j k l me@x.yy"), (None, "own words of this text")], key=str)
    assert C.uncontaminated(spark, df, sf).count() == len(rows)
    three = C.redacted(spark, df, sf)
    assert three.columns == df.columns
    assert three.where("doc_id = 3").select("text", "n_chars").collect() == [("g h i j k l <EMAIL>", 19)]
    assert three.where(F.col("text").isNull()).count() == 1
    for _, stage in C.STAGES:
        assert stage(spark, df.limit(0), sf).count() == 0
