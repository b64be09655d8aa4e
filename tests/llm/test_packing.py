import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from obslytics.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(3)
    odd = ["It's 'a' ''s we'll <|endoftext|>", "İx ǅ ñ n\u0303 Σς ßÀ", "\ta\x1cb\x0bc\xa0d\u2003e", "中文字 ９² ½ ª", "", None, " ", "a" * 9000,
           "\u0301x", "e\u0301 E\u0301", "x" + "1" * 50, "##'re--", "<|endoftext|>", "a<|startoftext|>B <|endoftext|> c\nd<|endoftext", "<|ENDOFTEXT|> e"]
    word = lambda: "".join(rng.choice("abcdeéÜ.,!'3") for _ in range(rng.randrange(1, 9)))
    return odd + [" ".join(word() for _ in range(rng.choice([1, 5, 60, 300, 900]))) for _ in range(150)]


def test_ids_equal_the_library(monkeypatch):
    monkeypatch.setattr(P, "WORDS_HELD", 50)
    monkeypatch.setattr(P, "PARTS_HELD", 50)
    library = Tokenizer.from_file(PATH)
    own = P.WordTokenizer(PATH)
    for text in texts():
        assert np.frombuffer(own.encode(text or ""), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def check(rows, docs, sequence):
    library = Tokenizer.from_file(PATH)
    want = []
    for doc, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), sequence)):
            part = ids[at:at + sequence]
            want.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= sequence
    return len(by)


@pytest.mark.parametrize("group", [50_000, 40])
def test_round_trip(spark, monkeypatch, group):
    docs = list(enumerate(texts())) + [(5, "same"), (5, "same"), (None, "none")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, piece int").repartition(3)
    cut = P.stored(P.pieces(df, PATH, 256), "t")
    rows = P.pack(cut, 256, group).withColumnRenamed("id", "doc_id").collect()
    used = check(rows, docs, 256)
    total = sum(r.length for r in rows)
    assert used <= -(-total // 256) * 1.05 + 3 * (1 + len(rows) // group)


def test_kept_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = P.packed_documents(df, PATH, keep_ids=True).first()
    assert zlib.crc32(bytes(row.ids)) == row.ids_crc32
    assert P.packed_documents(df.limit(0), PATH).count() == 0


def test_sum_of_squares_is_greedy_by_definition():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 21, 200)
    number, offset = P.sum_of_squares(lengths, 20)
    gaps = {}
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])

        def total(changed):
            counts = np.bincount([g for g in changed.values() if 0 < g < 20], minlength=21)
            return int((counts ** 2).sum())

        choices = [total(gaps | {b: g - size}) for b, g in gaps.items() if g >= size] + [total(gaps | {"new": 20 - size})]
        place = int(number[i])
        assert offset[i] == 20 - gaps.get(place, 20)
        gaps[place] = gaps.get(place, 20) - size
        assert total(gaps) == min(choices)
