"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the training corpus as index segments, one Parquet row for some thousand whole documents:
the sorted terms, and for each term the increasing positions of its postings.  Documents are numbered through
inside a segment, so a posting is one integer and a phrase may not run over a document's end.  ``search`` takes
each test phrase, picks its rarest term in the segment (the shortest list), and intersects the lists of the other
terms, shifted by their offsets, in order of length.  Exact phrases come out of the intersection itself.
``proximity`` finds phrases whose words stand close together in any order.

Segments are independent: no shuffle, no hot term or document, memory bounded by the segment's size.  The index
may be restricted to the words of a query set, which keeps the other postings off the disk.

Defined results: null text has no words, an empty table gives an empty index; repeated rows and repeated or null
ids are judged row by row; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslytics.llm import words as W
from obslytics.llm.common import stored

SEGMENT_BYTES = 8 << 20
#: words in all test phrases that one search may hold on each executor (8 bytes each)
MAX_QUERY_WORDS = 5_000_000

SEGMENT = pa.schema([("ids", pa.list_(pa.int64())), ("first_word", pa.binary()), ("terms", pa.binary()),
                     ("list_starts", pa.binary()), ("postings", pa.binary())])
SEGMENT_DDL = "ids array<bigint>, first_word binary, terms binary, list_starts binary, postings binary"


@dataclass
class Phrases:
    """Distinct test phrases: a matrix of word hashes for each phrase length, and the items that hold each."""

    by_length: dict[int, np.ndarray]
    items: dict[int, list[list]]

    @property
    def vocabulary(self) -> np.ndarray:
        parts = [m.ravel() for m in self.by_length.values()]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def phrases(benchmark: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text") -> Phrases:
    """Windows of ``window`` consecutive words of every item; a shorter item is one phrase, one without words none.
    A null item id is named by the empty text.

    The test set is the query set and is held whole; more than ``MAX_QUERY_WORDS`` words are refused.
    """
    rows, total = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        data, offsets = W.text_bytes(pa.array([row[1]], pa.string()))
        hashes, _ = W.words(data, offsets, W.ALNUM_WORDS)
        total += len(hashes)
        if total > MAX_QUERY_WORDS:
            raise ValueError(f"more than {MAX_QUERY_WORDS} words in the test set: search it in parts")
        rows.append(("" if row[0] is None else str(row[0]), hashes))
    found: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
    for item, hashes in rows:
        size = min(window, len(hashes))
        for at in range(len(hashes) - size + 1 if size else 0):
            found[size][hashes[at: at + size].tobytes()].add(item)
    return Phrases({n: np.frombuffer(b"".join(m), np.uint64).reshape(-1, n) for n, m in found.items()},
                   {n: [sorted(x) for x in m.values()] for n, m in found.items()})


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                vocabulary: np.ndarray | None = None) -> DataFrame:
    """Index segments of ``docs``, stored in the shared folder.  ``vocabulary``: postings of these terms only."""

    def segments(batches):
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            for first, last in W.chunks(offsets, SEGMENT_BYTES):
                parts, counts, at = [], [np.zeros(1, np.int64)], 0
                for lo, hi in W.chunks(offsets[first: last + 1]):  # hashing works on smaller pieces than a segment
                    hashes, starts = W.words(data, offsets[first + lo: first + hi + 1], W.ALNUM_WORDS)
                    parts.append(hashes)
                    counts.append(starts[1:] + at)
                    at += len(hashes)
                hashes = np.concatenate(parts)
                positions = np.arange(len(hashes), dtype=np.int32)
                if vocabulary is not None:
                    known = np.zeros(len(hashes), bool)
                    if len(vocabulary):
                        near = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                        known = vocabulary[near] == hashes
                    hashes, positions = hashes[known], positions[known]
                order = np.argsort(hashes, kind="stable")
                terms, starts = np.unique(hashes[order], return_index=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0).slice(first, last - first).to_pylist()], pa.list_(pa.int64())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (
                        np.concatenate(counts), terms, np.append(starts, len(order)).astype(np.int64),
                        positions[order]))], schema=SEGMENT)

    return stored(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(segments, SEGMENT_DDL), "postings")


class Segment:
    """One row of the index, with its lists."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.first_word = np.frombuffer(row["first_word"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.starts = np.frombuffer(row["list_starts"], np.int64)
        self.postings = np.frombuffer(row["postings"], np.int32)

    def list_of(self, term: int) -> np.ndarray:
        return self.postings[self.starts[term]: self.starts[term + 1]]

    def lookup(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of which every word occurs here, and their words as numbers of terms."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros((0, matrix.shape[1]), np.int64)
        at = np.minimum(np.searchsorted(self.terms, matrix), len(self.terms) - 1)
        whole = np.flatnonzero((self.terms[at] == matrix).all(axis=1))
        return whole, at[whole]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first_word, positions, "right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions where the phrase starts: lists intersected from the rarest term, shifted by their offsets."""
        order = np.argsort(self.starts[terms + 1] - self.starts[terms], kind="stable")
        found = self.list_of(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                return found
            postings, wanted = self.list_of(terms[k]), found + k
            near = np.minimum(np.searchsorted(postings, wanted), len(postings) - 1)
            found = found[postings[near] == wanted]
        found = found[found >= 0]
        return found[self.doc_of(found) == self.doc_of(found + len(terms) - 1)]

    def close(self, terms: np.ndarray, reach: int) -> np.ndarray:
        """Positions from which ``reach`` words of one document hold all the terms."""
        lists = [self.list_of(t) for t in np.unique(terms)]
        rarest = min(lists, key=len)
        starts = np.unique(np.concatenate([x[np.isin(x // reach, np.concatenate([rarest // reach, rarest // reach - 1]))]
                                           for x in lists]))
        end = starts.copy()
        for postings in lists:
            after = np.searchsorted(postings, starts)
            fits = after < len(postings)
            starts, end, after = starts[fits], end[fits], after[fits]
            end = np.maximum(end, postings[after])
        fits = end - starts < reach
        starts, end = starts[fits], end[fits]
        return starts[self.doc_of(starts) == self.doc_of(end)]


RESULT_DDL = "id bigint, n_words bigint, n_hit bigint, items array<string>"
RESULT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])


def search(index: DataFrame, tests: Phrases) -> DataFrame:
    """For each indexed document: words, words inside any occurrence of a phrase, and the items that occur."""

    def hits(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                n_docs, total = len(seg.ids), int(seg.first_word[-1])
                change, items = np.zeros(total + 1, np.int32), [set() for _ in range(n_docs)]
                for length, matrix in tests.by_length.items():
                    whole, terms = seg.lookup(matrix)
                    for number, phrase in zip(whole.tolist(), terms, strict=True):
                        at = seg.phrase(phrase)
                        if len(at):
                            np.add.at(change, at, 1)
                            np.add.at(change, at + length, -1)
                            for doc in set(seg.doc_of(at).tolist()):
                                items[doc].update(tests.items[length][number])
                covered = np.append(0, np.cumsum(np.cumsum(change[:total]) > 0))
                n_hit = np.diff(covered[seg.first_word])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg.ids, pa.int64()), pa.array(np.diff(seg.first_word)), pa.array(n_hit, pa.int64()),
                     pa.array([sorted(x) for x in items], pa.list_(pa.string()))], schema=RESULT)

    return index.mapInArrow(hits, RESULT_DDL)


def proximity(index: DataFrame, tests: Phrases, slop: int) -> DataFrame:
    """Rows (id, item, matches): stretches of at most ``slop`` more words than a phrase that hold all its words."""

    def near(batches):
        for batch in batches:
            out = defaultdict(set)
            for row in batch.to_pylist():
                seg = Segment(row)
                for length, matrix in tests.by_length.items():
                    whole, terms = seg.lookup(matrix)
                    for number, phrase in zip(whole.tolist(), terms, strict=True):
                        at = seg.close(phrase, length + slop)
                        for doc, start in zip(seg.doc_of(at).tolist(), at.tolist(), strict=True):
                            for item in tests.items[length][number]:
                                out[(seg.ids[doc], item)].add(start)
            keys = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()),
                                              pa.array([k[1] for k in keys], pa.string()),
                                              pa.array([len(out[k]) for k in keys], pa.int64())],
                                             names=["id", "item", "matches"])

    return index.mapInArrow(near, "id bigint, item string, matches bigint")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, min_share: tuple[int, int] = (1, 20),
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (any hit, and hits / words >= min_share)."""
    tests = phrases(benchmark, window)
    found = search(build_index(docs, id_col, text_col, tests.vocabulary), tests)
    num, den = min_share
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * den >= F.col("n_words") * num)).alias("contaminated"), "items")


