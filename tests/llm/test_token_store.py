import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from obslytics.llm import queries
from obslytics.llm import token_store as T
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["It's 'a' ''s we'll <|endoftext|> x", "<|endoftext|>", "a<|endoftext|>  b", "a  b", "a   b", " a", "a ", "a\n b", "a \nb", "a\n \nb", "\n", "\n\na\n\nb",
       "\ta\x1cb\x0bc\xa0d e", "x\x85 y", "中文字 ９² ½ ª", "", None, " ", "  ", "a" * 9000, "́x", "é É\U0001f600", "1" * 50, "a\r\nb", "a  b"]


def documents(n=150):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéÜ.,!'3") for _ in range(rng.randrange(1, 9)))
    texts = ["".join(word() + rng.choice([" ", " ", " ", "\n", "  ", ", "]) for _ in range(rng.choice([1, 5, 60, 300]))) for _ in range(n)]
    return list(enumerate(ODD + texts, start=-7)) + [(5, "same"), (5, "same"), (None, "none"), (None, None), (2**62, "far"), (-(2**62), "near")]


def expected(docs):
    library, out, at = Tokenizer.from_file(PATH), [], 0
    for doc, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_ids_equal_the_library(monkeypatch):
    monkeypatch.setattr(T, "WORDS_HELD", 60)
    monkeypatch.setattr(T, "PARTS_HELD", 60)
    library, own = Tokenizer.from_file(PATH), T.ByteTokenizer(PATH)
    for _, text in documents():
        assert np.frombuffer(own.encode(text or ""), own.kind).tolist() == library.encode(text or "", add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t'\xa0é1<"), max_size=30))
def test_ids_of_any_white_space(text):
    assert np.frombuffer(T.byte_tokenizer(PATH).encode(text), "<u2").tolist() == T.byte_tokenizer(PATH).tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50), max_size=700), st.data())
def test_elias_fano(values, data):
    values = np.sort(np.array(values, np.uint64))
    raw, n, bits, upper = T.EliasFano.encode(values)
    ef = T.EliasFano(raw, n, bits, upper)
    assert ef.slice(0, n).tolist() == values.tolist()
    if n:
        i, j = sorted((data.draw(st.integers(0, n - 1)), data.draw(st.integers(0, n))))
        assert ef.slice(i, j).tolist() == values[i:j].tolist()
        assert ef[i] == int(values[i])


def test_elias_fano_is_small():
    rng = np.random.default_rng(1)
    ends = np.cumsum(rng.integers(1, 4000, 100_000))
    raw, *_ = T.EliasFano.encode(ends)
    assert 8 * len(raw) < len(ends) * (2 + np.log2(ends[-1] / len(ends)) + 1)  # 64 bits a document in a plain table


def test_random_access():
    out = io.BytesIO()
    out.close = lambda: None
    writer = T.Writer(out, 2)
    rng = np.random.default_rng(2)
    docs = [(None, rng.integers(0, 60000, 3)), *((int(i), rng.integers(0, 60000, rng.integers(1, 50))) for i in np.sort(rng.integers(-50, 900, 600)))]
    for name, ids in docs:
        writer.add(name, ids.astype("<u2").tobytes())
    writer.close()
    store = pafs._MockFileSystem()
    with store.open_output_stream("f") as f:
        f.write(out.getvalue())
    file = T.TokenFile(store, "f")
    for i, (name, ids) in enumerate(docs):
        assert file.name(i) == name and file.document(i).tolist() == ids.tolist()
    for name in range(-60, 910, 7):
        assert [docs[i][0] for i in file.find(name)] == [x for x, _ in docs if x == name]
    whole = list(file.rows(tokens=20))
    assert [(r[0], r[2], r[3]) for r in whole] == [(x, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for x, ids in docs]


@pytest.mark.parametrize("task_bytes, file_tokens", [(T.TASK_BYTES, T.FILE_TOKENS), (2000, 500)])
def test_round_trip(spark, tmp_dir, task_bytes, file_tokens):
    docs = documents()
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, start int, file string").coalesce(1)
    files = T.write_tokens(df, PATH, tmp_dir, task_bytes=task_bytes, file_tokens=file_tokens)
    assert file_tokens > 500 or files.count() > 10
    rows = T.read_tokens(files, tmp_dir).orderBy("start").collect()
    own = [tuple(r) for r in rows]
    assert own == expected(docs)  # rows of one id stay in the order of the input
    assert all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:], strict=False))


def test_empty_table(spark, tmp_dir):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.written_and_read(df, PATH).collect() == []


def test_query_against_the_library(spark):
    rows = queries.QUERIES["op12_token_store"](spark, SF_SMALL).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in rows) == sorted(expected(docs))


def test_words_of_one_pretoken_need_no_cutting():
    """Words of letters or digits, with a mark or without, are one or two pre-tokens: equal to the library, not cut by the pattern."""
    tokenizer = T.ByteTokenizer(PATH)
    words = ["hello", "Été,", "ordinaire.", "ªº", "ÿ?", "12345", "7;", "ǅa", "x)", "don't", "a1", "1a.", "...", ".", "a..", "it's,", "²", "½.", "a\u0301", "<|x", "é!"]
    for word in words:
        for text in (f"q {word} r", f"q\n{word} r", word, f"{word} {word}"):
            assert tokenizer.encode(text) == tokenizer.ids(text), text

    class Never:
        def findall(self, text):
            raise AssertionError(text)

    plain = T.ByteTokenizer(PATH)
    plain._pieces = Never()
    text = "we hello Été, ordinaire. 12345 7; fin!\nNext, line"
    assert plain.encode(text) == tokenizer.ids(text)
