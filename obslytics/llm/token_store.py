"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

``write_tokens`` sorts whole texts by document id, tokenises them and appends their ids to files in a shared folder.  A
file holds the id array (2 or 4 bytes an id) and, behind it, two Elias-Fano lists: the end of every document in the
array, and the document ids.  A list of n values up to u takes n * (2 + log2(u / n)) bits and a sampled select, so an
offset is found without a table of 64-bit numbers.  ``read_tokens`` returns every document from the files;
``TokenFile`` gives random access by place or by document id, with range reads only.

Texts are shuffled once, by range of (id, place in the input); a document longer than others is still one row, and a
repeated id may spread over many files.  A task that is run again writes new files; files of lost attempts are named
by no row of the file list.  Folders can be in any store that ``pyarrow.fs`` opens by URI.

Defined results: null text is empty and gives the end id alone; null ids come first; rows of one id keep the order of
the input; an empty table gives no files and no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obslytics.llm import words as W
from obslytics.llm.common import new_folder, stored
from obslytics.llm.packing import _byte_letters
from obslytics.llm.warc import open_folder
from obslytics.session import default_parallelism

END = 0                    # id that ends every document
TASK_BYTES = 256 << 20     # of text that one task sorts and writes
FILE_TOKENS = 1 << 28      # a file is closed once it holds so many
READ_TOKENS = 1 << 20      # of ids read at a time
#: distinct words of a generation, and pre-tokens, whose ids a worker keeps (about 200 bytes each)
WORDS_HELD = 200_000
PARTS_HELD = 400_000
CHUNK_BYTES = 8 << 20     # of text whose words are looked up together (a longer text by itself)


# ---- tokens -------------------------------------------------------------------------------------------------

class ByteTokenizer:
    """Ids of the byte-level vocabulary ``path``, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    A pre-token never reaches beyond a single space or line feed between two characters that are not white space, so
    texts are split into words, and each distinct word of a batch is looked up once.  Unknown words are cut into
    pre-tokens and encoded by the library's model; words with characters beyond Latin and texts with other white space
    at a word's edge go through the library's whole pipeline.  Words are held in two generations: the older one is
    dropped when the newer one is full, and words that are used move to the newer one.
    """

    _plain = re.compile("\n?[\x21-\x7e\xa1-\u024f]+")
    _marks = frozenset(".,;:!?)")
    _pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")  # fixed: the vocabulary's own pattern

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.space = " ".translate(self.letters)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.line = self.ids("\n")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Ids by the library alone."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if part.isascii() and part[1:].isalnum() and part[0] == " ":
                spelled = self.space + part[1:]
            else:
                spelled = part.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(spelled)])
            if len(self.parts) >= PARTS_HELD:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def _learnt(self, word: str) -> bytes | None:
        """Ids of a word that followed a space, or that begins with the line feed that it followed."""
        ids = self.older.get(word)
        if ids is None:
            text = word[1:] if word[:1] == "\n" else " " + word
            body = text[:-1] if text[-1:] in self._marks else text
            core = body.removeprefix(" ")
            if core.isalpha() and self._plain.fullmatch(core) or core.isascii() and core.isdigit():  # most words: one pre-token, or a mark more
                ids = self._part(body)
                if len(body) < len(text):
                    ids += self._part(text[-1])
            elif self._plain.fullmatch(word) and "<|" not in word:
                ids = b"".join(map(self._part, self._pieces.findall(text)))
            elif not (body := word.removeprefix("\n")) or body[0].isspace() or body[-1].isspace():
                return None  # cannot be looked up by itself
            else:
                ids = self.ids(text)
            if word[0] == "\n":
                ids = self.line + ids
        self.words[word] = ids
        return ids

    def _chunk(self, texts: pa.Array) -> list[bytes]:
        if len(self.words) >= WORDS_HELD:
            self.words, self.older = {}, self.words
        some = lambda x: pa.scalar(x, pa.large_string())
        marked = pc.replace_substring(pc.binary_join_element_wise(some("\n"), texts, some("")), "\n", " \n")
        lists = pc.split_pattern(marked, " ")  # a word after a line feed keeps it, the others had a space; the first is empty
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes, get = coded.indices.to_numpy(), self.words.get
        ids = [get(w) or self._learnt(w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        unknown = [i for i, x in enumerate(ids) if x is None]
        alone = np.ones(len(ids), bool)
        alone[unknown] = False
        for i in unknown:
            ids[i] = b""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        start = np.cumsum(size) - size
        each = size[codes]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
        flat = np.frombuffer(b"".join(ids), self.kind)
        tokens = flat[np.repeat(start[codes] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        wrong = ~alone[codes]
        wrong[offsets[:-1]] = False
        wrong = set((np.searchsorted(offsets, np.flatnonzero(wrong), "right") - 1).tolist())
        cut = (ends[offsets] * self.width).tolist()
        return [self.ids(texts[i].as_py()) if i in wrong else tokens[a + self.width: b]
                for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian ids of ``width`` bytes of each text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets = W.text_bytes(texts)
        for first, last in W.chunks(offsets, CHUNK_BYTES):
            yield from self._chunk(texts.slice(first, last - first))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text])))


_loaded: dict[str, ByteTokenizer] = {}


def byte_tokenizer(path: str) -> ByteTokenizer:
    if path not in _loaded:
        _loaded[path] = ByteTokenizer(path)
    return _loaded[path]


# ---- Elias-Fano lists ---------------------------------------------------------------------------------------

SAMPLE = 256   # every so many values the place of the upper bit is kept
STRIPE = 8192  # values packed at a time; a multiple of eight


class EliasFano:
    """A list of values that never fall, each below 2**64, in a buffer: lower bits, upper bits in unary, select samples."""

    def __init__(self, raw: bytes, n: int, bits: int, upper_bytes: int):
        self.n, self.bits = n, bits
        lower = (n * bits + 7) // 8
        self.lower = np.frombuffer(raw, np.uint8, lower)
        self.upper = np.frombuffer(raw, np.uint8, upper_bytes, lower)
        self.samples = np.frombuffer(raw, "<u4", -(-n // SAMPLE), lower + upper_bytes)

    @staticmethod
    def encode(values: np.ndarray) -> tuple[bytes, int, int, int]:
        """The buffer and the numbers that the constructor takes."""
        values = values.astype(np.uint64)
        n = len(values)
        if not n:
            return b"", 0, 0, 0
        bits = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1)
        lower = []
        for at in range(0, n, STRIPE) if bits else ():
            part = values[at: at + STRIPE, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)
            lower.append(np.packbits(part.astype(np.uint8).reshape(-1), bitorder="little").tobytes())
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(places[-1]) + 1, np.uint8)
        upper[places] = 1
        upper = np.packbits(upper, bitorder="little").tobytes()
        return b"".join(lower) + upper + places[::SAMPLE].astype("<u4").tobytes(), n, bits, len(upper)

    def select(self, first: int, last: int) -> np.ndarray:
        """Places of the upper bits number ``first`` to ``last`` (exclusive), from the sample before the first one."""
        sample = first // SAMPLE
        byte = int(self.samples[sample]) // 8
        end = len(self.upper) if -(-last // SAMPLE) >= len(self.samples) else int(self.samples[-(-last // SAMPLE)]) // 8 + 1
        ones = np.flatnonzero(np.unpackbits(self.upper[byte:end], bitorder="little")) + 8 * byte
        ones = ones[np.searchsorted(ones, int(self.samples[sample])):]
        return ones[first - sample * SAMPLE: last - sample * SAMPLE]

    def slice(self, first: int, last: int) -> np.ndarray:
        """Values number ``first`` to ``last`` (exclusive)."""
        out = np.zeros(max(0, last - first), np.uint64)
        if last <= first:
            return out
        out[:] = (self.select(first, last) - np.arange(first, last)).astype(np.uint64) << np.uint64(self.bits)
        for at in range(first, last, STRIPE) if self.bits else ():
            end = min(at + STRIPE, last)
            start = at * self.bits
            packed = np.unpackbits(self.lower[start // 8: (end * self.bits + 7) // 8], bitorder="little")
            packed = packed[start % 8: start % 8 + (end - at) * self.bits].reshape(-1, self.bits).astype(np.uint64)
            out[at - first: end - first] |= np.bitwise_or.reduce(packed << np.arange(self.bits, dtype=np.uint64), axis=1)
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


# ---- files --------------------------------------------------------------------------------------------------

MAGIC = b"IDSEF001"
#: width of an id, documents, documents without an id, smallest document id, tokens, then (values, lower bits, upper bytes,
#: place, bytes) of the list of ends and of the list of document ids
FOOTER = struct.Struct("<IQQqQ" + "QIQQQ" * 2 + "8s")


class Writer:
    """Appends documents to one file; only their lengths and document ids are held until it is closed."""

    def __init__(self, out, width: int):
        self.out, self.width, self.lengths, self.names, self.tokens = out, width, [], [], 0

    def add(self, name: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.lengths.append(len(ids) // self.width)
        self.names.append(name)
        self.tokens += len(ids) // self.width

    def close(self) -> None:
        known = [x for x in self.names if x is not None]
        low = known[0] if known else 0
        at, parts = self.tokens * self.width, []
        for values in (np.cumsum(self.lengths, dtype=np.uint64), np.array([x - low for x in known], np.uint64)):
            raw, n, bits, upper = EliasFano.encode(values)
            self.out.write(raw)
            parts += [n, bits, upper, at, len(raw)]
            at += len(raw)
        self.out.write(FOOTER.pack(self.width, len(self.names), len(self.names) - len(known), low, self.tokens, *parts, MAGIC))
        self.out.close()


class TokenFile:
    """Reader of one file: footer and lists at first, ids by range."""

    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)
        self.file.seek(self.file.size() - FOOTER.size)
        self.width, self.n, self.nulls, self.low, self.tokens, *parts, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.ends, self.names = self._list(parts[:5]), self._list(parts[5:])

    def _list(self, part: list[int]) -> EliasFano:
        n, bits, upper, at, size = part
        return EliasFano(self._read(at, size), n, bits, upper)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def offsets(self, first: int, last: int) -> np.ndarray:
        """Where documents ``first`` to ``last`` start, and where document ``last - 1`` ends."""
        ends = self.ends.slice(max(0, first - 1), last).astype(np.int64)
        return ends if first else np.concatenate([np.zeros(1, np.int64), ends])

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self._read(start * self.width, (end - start) * self.width), f"<u{self.width}")

    def name(self, i: int) -> int | None:
        return None if i < self.nulls else self.names[i - self.nulls] + self.low

    def find(self, name: int) -> range:
        """Places of the documents with id ``name``, by binary search in the list of ids."""
        def first(least: int) -> int:
            low, high = 0, self.n - self.nulls
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if self.names[middle] + self.low < least else (low, middle)
            return low + self.nulls
        return range(first(name), first(name + 1))

    def document(self, i: int) -> np.ndarray:
        """Ids of document ``i``, its end id included."""
        return self.ids(*self.offsets(i, i + 1).tolist())

    def rows(self, tokens: int = READ_TOKENS) -> Iterator[tuple[int | None, int, int, int]]:
        """(document id, start, tokens, crc32) of every document; ids are read ``tokens`` at a time."""
        for at in range(0, self.n, STRIPE):
            last = min(at + STRIPE, self.n)
            offsets = self.offsets(at, last)
            nulls = max(0, min(last, self.nulls) - at)
            names = [None] * nulls + [int(x) + self.low for x in self.names.slice(max(0, at - self.nulls), max(0, last - self.nulls))]
            i = 0
            while i < last - at:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + tokens, "right")) - 1)
                if j == i + 1:  # a long document, piece by piece
                    crc = 0
                    for start in range(offsets[i], offsets[j], tokens):
                        crc = zlib.crc32(self.ids(start, min(start + tokens, offsets[j])).astype("<u4"), crc)
                    yield names[i], int(offsets[i]), int(offsets[j] - offsets[i]), crc
                else:
                    block = memoryview(self.ids(offsets[i], offsets[j]).astype("<u4")).cast("B")
                    for k in range(i, j):
                        a, b = offsets[k] - offsets[i], offsets[k + 1] - offsets[i]
                        yield names[k], int(offsets[k]), int(b - a), zlib.crc32(block[4 * a: 4 * b])
                i = j


# ---- Spark --------------------------------------------------------------------------------------------------

FILE = pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("first_row", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())])
FILE_DDL = "file string, first_id long, first_row long, documents long, tokens long"
ROW = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
ROW_DDL = "id long, start long, n_tokens long, ids_crc32 long"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
                 task_bytes: int = TASK_BYTES, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the files of all documents; returns their list (file, first_id, first_row, documents, tokens, start).

    ``start`` counts the ids of all files before, a running sum over one row a file."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, -(-size // task_bytes), min(4 * default_parallelism(docs.sparkSession), -(-size // (1 << 20))))

    def write(batches):
        store, path = open_folder(folder)
        store.create_dir(path, recursive=True)
        tokenizer = byte_tokenizer(vocabulary)
        end = np.array([END], tokenizer.kind).tobytes()
        writer, about = None, None

        def closed() -> pa.RecordBatch:
            writer.close()
            return _table([(*about, len(writer.names), writer.tokens)], FILE)

        for batch in batches:
            for name, row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), tokenizer.encode_all(batch.column(2)), strict=True):
                if writer is None:
                    about = f"tokens-{uuid.uuid4().hex}", name, row
                    writer = Writer(store.open_output_stream(f"{path}/{about[0]}", compression=None), tokenizer.width)
                writer.add(name, ids + end)
                if writer.tokens >= file_tokens:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    ordered = rows.repartitionByRange(tasks, "id", "row").sortWithinPartitions("id", "row")
    files = stored(ordered.mapInArrow(write, FILE_DDL), "token-files")
    before = Window.orderBy("first_id", "first_row").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tokens(files: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32) of every document, read back from the files."""

    def read(batches):
        store, path = open_folder(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = []
                for row in TokenFile(store, f"{path}/{name}").rows():
                    out.append((row[0], base + row[1], *row[2:]))
                    if len(out) == STRIPE:
                        yield _table(out, ROW)
                        out = []
                yield _table(out, ROW)

    each = files.select("file", "start").repartitionByRange(max(1, files.count()), "start")
    return each.mapInArrow(read, ROW_DDL).withColumnRenamed("id", id_col)


def written_and_read(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` to files in a fresh folder of the shared one and return every document from them."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(stored(write_tokens(docs, vocabulary, folder, id_col, text_col), "token-index"), folder, id_col)
