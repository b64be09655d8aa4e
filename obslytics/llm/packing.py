"""Packing of tokenised documents into fixed-length sequences by the sum-of-squares rule.

``pieces`` tokenises whole texts, ends each with an end id and cuts only those longer than a sequence.
``pack`` deals the pieces evenly to groups of bounded size; each group places its pieces, longest first, where the
sum over all gaps of (number of open sequences with that gap) squared becomes smallest: in an open sequence or a new
one.  A group leaves some sequences open, so the loss against one large group is in the order of ten in ``GROUP``.

Defined results: null text is empty and gives the end id alone; repeated rows and repeated or null ids are packed
row by row; an empty table gives no rows; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslytics.llm.common import stored

SEQUENCE = 2048
#: pieces that one task packs together
GROUP = 50_000
#: distinct words, and parts of words, of a generation whose ids a worker keeps (about 200 bytes each)
WORDS_HELD = 200_000
PARTS_HELD = 200_000


# ---- tokens -------------------------------------------------------------------------------------------------

def _byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte: printable bytes themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    letters.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)})
    return "".join(letters[b] for b in range(256))


class WordTokenizer:
    """Ids of the word-level vocabulary ``path``, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Its pre-tokens never cross white space, so ids are looked up word by word; unknown words are split and encoded
    by the library's model, and words with characters beyond Latin, and texts that hold the string of a special token,
    by the library's whole pipeline.
    """

    _plain = re.compile("[\x21-\x7e\xa1-ɏ]+")
    _pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")  # fixed: the vocabulary's own pattern

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        # two generations: the older one is dropped when the newer one is full, what is used moves to the newer one
        self.words, self.older_words = {"": b""}, {}
        self.parts, self.older_parts = {}, {}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.older_parts.get(part)
            if ids is None:
                spelled = part.encode().decode("latin-1").translate(self.letters)
                ids = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
            if len(self.parts) >= PARTS_HELD:
                self.parts, self.older_parts = {}, self.parts
            self.parts[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if self._plain.fullmatch(word):
            return b"".join(map(self._part, self._pieces.findall(word.lower())))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.replace("\n", " ").split(" ")
        if len(self.words) >= WORDS_HELD:
            self.words, self.older_words = {"": b""}, self.words
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            older = self.older_words
            self.words.update({w: older[w] if w in older else self._word(w) for w in set(words).difference(self.words)})
        return b"".join(map(self.words.__getitem__, words))


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


PIECE = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                   ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PIECE_DDL = "id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, ids) of every document; ``ids`` are null unless kept."""

    def cut(batches):
        encode = word_tokenizer(vocabulary).encode
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * sequence)):
                    part = ids[at: at + 4 * sequence]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * len(PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECE, strict=True)], schema=PIECE)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, PIECE_DDL)


# ---- packing ------------------------------------------------------------------------------------------------

def sum_of_squares(lengths: np.ndarray, sequence: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed longest first."""
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(sequence + 1, np.int64)             # open sequences by gap
    open_: list[list[int]] = [[] for _ in range(sequence + 1)]
    far, used = np.iinfo(np.int64).max, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        # change of the sum: the sequence leaves its gap, and comes to a smaller one unless it is filled
        change = np.where(count[size:] > 0, 2 * (count[: sequence + 1 - size] - count[size:] + 1), far)
        if count[size]:
            change[0] = 1 - 2 * count[size]              # an exact fit only leaves
        best = int(change.argmin())
        fresh = 2 * count[sequence - size] + 1 if size < sequence else 0
        if change[best] <= fresh:
            gap = best + size
            place = open_[gap].pop()
            count[gap] -= 1
        else:
            gap, place, used = sequence, used, used + 1
        number[i], offset[i] = place, sequence - gap
        if gap > size:
            open_[gap - size].append(place)
            count[gap - size] += 1
    return number, offset


def pack(cut: DataFrame, sequence: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """``cut`` (stored pieces) with (sequence_id, offset); offsets are gapless from 0 in every sequence."""
    groups = max(1, -(-cut.count() // group))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        number, offset = sum_of_squares(pdf["length"].to_numpy(), sequence)
        return pdf.assign(sequence_id=number + (int(pdf["pack_group"].iloc[0]) << 32), offset=offset).drop(columns="pack_group")

    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(place, PIECE_DDL + ", sequence_id long, offset long")


def packed_documents(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset), and the ids where ``keep_ids``."""
    cut = stored(pieces(docs, vocabulary, sequence, id_col, text_col, keep_ids), "pieces")
    out = pack(cut, sequence).withColumnRenamed("id", id_col)
    return out if keep_ids else out.drop("ids")
