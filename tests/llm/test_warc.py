import base64
import gzip
import hashlib
import random

import pytest

from obslytics.llm import warc as A

SCHEMA = "page_id long, url string, html string, key int"


def pages():
    rng = random.Random(2)
    same = ["", "<p>é</p>", "x" * 3000]
    rows = [(i, rng.choice([f"http://www.a{i % 7}.example.com/p/{i}?q=1", f"https://u@B.org:80/{i % 3}", "http://b.org", "not a url", None, "http://x/\nevil: 1"]),
             rng.choice([*same, f"page {i}\r\n\r\n" * rng.randrange(40)])) for i in range(300)]
    return rows + [(400, None, None), (401, "http://b.org", "y" * 200_000)]


def brute(rows, least=0):
    text = lambda h: (h or "").encode()
    last = {}
    for i, _, h in rows:
        last[text(h)] = max(last.get(text(h), i), i)
    out = []
    for i, _, h in rows:
        b = text(h)
        revisit = last[b] != i and len(b) >= least
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last[b] if revisit else None))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(A, "BLOCK_LINES", 7)
    monkeypatch.setattr(A, "ARCHIVE_BYTES", 4000)
    rows = pages()
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    got = A.archive_and_read(df, least, keep_payload=True).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute(rows, least)
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response")


def test_key_lookup_and_plain_gzip(spark, tmp_dir):
    rows = [(i, "http://Www.Example.org/a", f"t{i}") for i in range(50)] + [(99, "http://example.org/b", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    captures = A.write_archives(df, f"file://{tmp_dir}/w")
    index = A.build_index(captures, f"file://{tmp_dir}/w")
    assert index.count() >= 1
    reader = A.Index(f"file://{tmp_dir}/w")
    assert sorted(x["page_id"] for x in reader.captures("org,example,www)/a")) == list(range(50))
    assert [x["payload"] for x in reader.captures("org,example)/b")] == [b"z"]
    assert list(reader.captures("org,example)/c")) == []
    name = captures.first().file
    assert gzip.open(f"{tmp_dir}/w/{name}").read().startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_many_index_files(spark, monkeypatch, tmp_dir):
    """More index files than a block of their list holds, and keys that several files share."""
    monkeypatch.setattr(A, "BLOCK_LINES", 2)
    folder = f"file://{tmp_dir}/w"
    rows = [(i, f"http://h{i % 9}.org/{'a' if i % 2 else i}", f"t{i}") for i in range(120)]
    captures = A.write_archives(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), folder)
    previous = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert A.build_index(captures, folder).count() > 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", previous)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    reader = A.Index(folder)
    keys = {}
    for r in captures.collect():
        keys.setdefault(r.key, []).append(r.page_id)
    for key, ids in keys.items():
        assert sorted(x["page_id"] for x in reader.captures(key)) == sorted(ids)
    assert list(reader.captures("a")) == [] and list(reader.captures("zz")) == []


def test_repeats_nulls_empty(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, None, None), (2, "u", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in A.archive_and_read(df).collect())
    assert got == sorted([(1, "response", 0), (1, "response", 0), (0, "revisit", 1), (0, "response", 0), (2, "response", 0)])
    assert A.archive_and_read(df.limit(0)).count() == 0
