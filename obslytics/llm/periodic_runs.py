"""Periodic runs of words, found by block convolution at dyadic scales.

A run is a longest stretch of words with smallest period q that is repeated at least ``POWER`` times.  For periods from
B to 2B - 1, B a power of two, it holds an aligned block of B words whose copy starts q words later.  The sum of squared
differences between a block and every place of the window behind it comes from one exact number-theoretic transform; a
sum of zero is an occurrence without mismatch, and its distance seeds an extension to both sides.

The sums are integers below B times the largest squared difference; as many primes are used as their product needs to
exceed that, so a sum that vanishes for all of them is zero.  Two necessary conditions spare transforms and lose
nothing: every word of a block that recurs at a distance below 2B does so itself, and what lies inside a run of a smaller
period has no other smallest period (Fine and Wilf; scales go upwards).  Extensions are found by hashes of prefixes and
confirmed word by word.

Texts are independent: no shuffle, and a task holds some texts of about ``CHUNK`` words, or one longer text.

Defined results: null and empty texts have no words and no runs; repeated rows and repeated or null ids are judged row
by row; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslytics.llm import words as W

POWER = 4       # repeats of the period
SHORTEST = 6    # words of a run
CHUNK = 1 << 18
#: (prime, primitive root): primes below 2**32 for transforms of up to 2**27 words
PRIMES = [(2013265921, 31), (2281701377, 3), (3221225473, 5)]
CELLS = 1 << 20  # of a batch of transforms


# ---- transforms ---------------------------------------------------------------------------------------------

def _modulo(x: np.ndarray, prime: int) -> np.ndarray:
    """Residues of ``x`` in place; a division by a constant is faster than a remainder."""
    x -= x // np.uint64(prime) * np.uint64(prime)
    return x


_roots: dict[tuple[int, int, int], list[np.ndarray]] = {}


def _twiddles(size: int, prime: int, root: int) -> list[np.ndarray]:
    """Powers of the roots of unity, for halves of 1, 2, 4 and so on."""
    if (size, prime, root) not in _roots:
        out, half = [], 1
        while half < size:
            step, row = pow(root, (prime - 1) // (2 * half), prime), np.ones(1, np.uint64)
            while len(row) < half:
                row = np.concatenate([row, _modulo(row * np.uint64(pow(step, len(row), prime)), prime)])
            out.append(row)
            half *= 2
        _roots[size, prime, root] = out
    return _roots[size, prime, root]


def forward(x: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Transform of every row, in bit-reversed order."""
    rows, size = x.shape
    for twiddle in reversed(_twiddles(size, prime, root)):
        pairs = x.reshape(rows, -1, 2, len(twiddle))
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        out = np.empty_like(pairs)
        out[:, :, 0] = _modulo(a + b, prime)
        out[:, :, 1] = _modulo((a + np.uint64(prime) - b) % np.uint64(prime) * twiddle, prime)
        x = out.reshape(rows, size)
    return x


def backward(x: np.ndarray, prime: int, root: int) -> np.ndarray:
    """The rows whose transforms are ``x`` (in bit-reversed order)."""
    rows, size = x.shape
    for twiddle in _twiddles(size, prime, pow(root, -1, prime)):
        pairs = x.reshape(rows, -1, 2, len(twiddle))
        a, b = pairs[:, :, 0], _modulo(pairs[:, :, 1] * twiddle, prime)
        out = np.empty_like(pairs)
        out[:, :, 0] = _modulo(a + b, prime)
        out[:, :, 1] = _modulo(a + np.uint64(prime) - b, prime)
        x = out.reshape(rows, size)
    return _modulo(x * np.uint64(pow(size, -1, prime)), prime)


def no_mismatch(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each row, whether its block (B numbers) equals its window (2B numbers) from place 0, 1, .. B - 1 on."""
    rows, length = blocks.shape
    widest = int(max(blocks.max(), windows.max()) - min(blocks.min(), windows.min()))
    zero, product = np.ones((rows, length), bool), 1
    for prime, root in PRIMES:
        x, y = blocks % np.uint64(prime), windows % np.uint64(prime)
        turned = np.zeros((rows, 2 * length), np.uint64)
        turned[:, 0], turned[:, length + 1:] = x[:, 0], x[:, :0:-1]
        cross = backward(_modulo(forward(turned, prime, root) * forward(y.copy(), prime, root), prime), prime, root)[:, :length]
        squares = np.zeros((rows, 2 * length + 1), np.uint64)
        squares[:, 1:] = np.cumsum(_modulo(y * y, prime), axis=1, dtype=np.uint64)
        own = _modulo(x * x, prime).sum(axis=1, dtype=np.uint64)[:, None]
        both = own + squares[:, length: 2 * length] - squares[:, :length]
        zero &= _modulo(both, prime) == _modulo(2 * cross, prime)
        product *= prime
        if product > length * widest * widest:
            return zero
    raise ValueError("texts of so many different words need another prime")


# ---- runs ---------------------------------------------------------------------------------------------------

def next_same(symbols: np.ndarray) -> np.ndarray:
    """Distance to the next equal symbol; a very large number for the last one."""
    out = np.full(len(symbols), np.iinfo(np.int64).max)
    order = np.argsort(symbols, kind="stable")
    here, there = order[:-1], order[1:]
    same = symbols[here] == symbols[there]
    out[here[same]] = (there - here)[same]
    return out


class Extender:
    """How far two places ``distance`` apart agree, to the right and to the left."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        self.powers, _ = W._tables(len(symbols) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(symbols) + 1, np.uint64)
            self.sums[1:] = np.cumsum(W.mix(symbols.astype(np.uint64) + np.uint64(1)) * self.powers[: len(symbols)], dtype=np.uint64)

    def _same(self, a: np.ndarray, distance: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            left = (self.sums[a + size] - self.sums[a]) * self.powers[distance]
            return left == self.sums[a + distance + size] - self.sums[a + distance]

    def _longest(self, limit: np.ndarray, same: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = np.zeros_like(limit), limit.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = same(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def stretches(self, at: np.ndarray, distance: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch with period ``distance`` round a block at ``at``, within first .. last."""
        right = self._longest(last - at - distance, lambda m: self._same(at, distance, m))
        left = self._longest(at - first, lambda m: self._same(at - m, distance, m))
        return at - left, at + right + distance

    def confirmed(self, at: int, distance: int, start: int, end: int, first: int, last: int) -> tuple[int, int]:
        """The stretch word by word; differs from ``start``, ``end`` only where hashes of different words are equal."""
        x = self.symbols
        if np.array_equal(x[start: end - distance], x[start + distance: end]):
            return start, end
        wrong = np.flatnonzero(x[first: last - distance] != x[first + distance: last]) + first
        k = int(np.searchsorted(wrong, at))
        return (int(wrong[k - 1]) + 1 if k else first), (int(wrong[k]) if k < len(wrong) else last - distance) + distance


def find_runs(symbols: np.ndarray, numbers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), by start and period, of all runs of the texts ``symbols[offsets[i]: offsets[i + 1]]``.

    Equal symbols are equal words of one text; ``numbers`` are small numbers of the words of each text."""
    found = np.zeros((0, 3), np.int64)
    n, longest = len(symbols), int(np.diff(offsets).max(initial=0))
    if longest < SHORTEST:
        return found
    gap, block, extender = next_same(symbols), 1, None
    while POWER * block <= longest:
        # blocks within one text, all of whose words recur near enough
        at = np.flatnonzero(gap < 2 * block) * block
        text = np.searchsorted(offsets, at, "right") - 1
        first, last = offsets[text], offsets[text + 1]
        keep = at + 2 * block <= last
        at, first, last = at[keep], first[keep], last[keep]
        # where the run known so far that holds the block's start ends
        order = np.argsort(found[:, 0], kind="stable")
        known, ends = found[order, 0], np.maximum.accumulate(found[order, 1])
        k = np.searchsorted(known, at, "right") - 1
        reach = np.where(k >= 0, ends[k], 0) if len(known) else np.zeros_like(at)
        keep = reach < np.minimum(at + 3 * block - 1, last)
        at, first, last, reach = at[keep], first[keep], last[keep], reach[keep]
        seeds = []
        for low in range(0, len(at), max(1, CELLS // block)):
            part = at[low: low + max(1, CELLS // block), None]
            windows = numbers[np.minimum(part + np.arange(block, 3 * block), n - 1)]
            row, lag = np.nonzero(no_mismatch(numbers[part + np.arange(block)], windows))
            row, distance = row + low, lag + block
            keep = (at[row] + block + distance <= last[row]) & (at[row] + block + distance > reach[row])
            seeds.append(np.stack([at[row], distance, first[row], last[row]], axis=1)[keep])
        if seeds and sum(map(len, seeds)):
            extender = extender or Extender(symbols)
            at, distance, first, last = np.concatenate(seeds).T
            start, end = extender.stretches(at, distance, first, last)
            keep = np.flatnonzero(end - start >= np.maximum(SHORTEST, POWER * distance))
            _, one = np.unique(np.stack([start, end, distance], axis=1)[keep], axis=0, return_index=True)
            new = []
            for i in keep[one].tolist():
                s, e = extender.confirmed(*(int(x[i]) for x in (at, distance, start, end, first, last)))
                if e - s >= max(SHORTEST, POWER * distance[i]):
                    new.append((s, e, int(distance[i])))
            if new:
                found = np.concatenate([found, np.unique(np.array(new, np.int64), axis=0)])
        whole = len(gap) // 2
        gap, block = np.maximum(gap[0: 2 * whole: 2], gap[1: 2 * whole: 2]), 2 * block
    return found[np.lexsort((found[:, 2], found[:, 0]))]


# ---- texts --------------------------------------------------------------------------------------------------

OUT = pa.schema([("id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
                 ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
                 ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
OUT_DDL = ("id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
           "runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _judged(doc: int | None, words: list[bytes], runs: list[tuple[int, int, int]], keep: bool) -> tuple:
    best = (None, None, None, None)
    if runs:
        top = runs[0]
        for run in runs:
            if run[1] * top[2] > top[1] * run[2]:
                top = run
        best = (*top, 1000 * top[1] // top[2])
        inside = np.zeros(len(words) + 1, np.int64)
        table = np.array(runs)
        np.add.at(inside, table[:, 0] + table[:, 2], 1)
        np.add.at(inside, table[:, 0] + table[:, 1], -1)
        words = compress(words, (np.cumsum(inside[:-1]) == 0).tolist())
    text = b" ".join(words)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (doc, len(runs), *best, hashlib.sha256(lines).hexdigest(), hashlib.sha256(text).hexdigest(),
            [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] if keep else None, text.decode() if keep else None)


def judged(texts: Iterator[tuple[int | None, list[bytes]]], keep: bool) -> Iterator[tuple]:
    """Result rows of ``texts`` (id, words), some texts at a time."""
    docs, parts, numbers, size, base = [], [], [], 0, 0

    def flush():
        nonlocal docs, parts, numbers, size, base
        offsets = np.cumsum([0, *map(len, numbers)])
        none = [np.zeros(0, np.int64)]
        runs = find_runs(np.concatenate(parts or none), np.concatenate(numbers or none).astype(np.uint64), offsets)
        cut = np.searchsorted(runs[:, 0], offsets)
        for i, (doc, words) in enumerate(docs):
            own = runs[cut[i]: cut[i + 1]]
            yield _judged(doc, words, [(s - int(offsets[i]), e - s, q) for s, e, q in own.tolist()], keep)
        docs, parts, numbers, size, base = [], [], [], 0, 0

    for doc, words in texts:
        number = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
        own = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        docs.append((doc, words))
        numbers.append(own)
        parts.append(own + base)
        base, size = base + len(number), size + len(words)
        if size >= CHUNK:
            yield from flush()
    yield from flush()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False,
                  changed: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Rows (id, n_runs, the run with the greatest exponent, digests); with ``keep`` also all runs and the collapsed text.

    In the collapsed text a run leaves its first period; words are joined by single spaces.  ``changed`` may replace the
    words of a text before the search."""

    def search(batches):
        for batch in batches:
            split = ((doc, (text or "").encode().split()) for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            rows = list(judged(((doc, changed(doc, words) if changed else words) for doc, words in split), keep))
            cols = list(zip(*rows, strict=True)) or [()] * len(OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, OUT, strict=True)], schema=OUT)

    out = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(search, OUT_DDL).withColumnRenamed("id", id_col)
    return out if keep else out.drop("runs", "collapsed")
