"""Removal of every byte covered by a long string that also starts elsewhere, over whole texts.

The repeats are found by a column-wise, multi-document suffix construction: in each round every string of a
collection is lengthened by one symbol to the left.  The symbols, read in the order of the suffixes so far, are that
column of the collection's Burrows-Wheeler transform; a stable partition by symbol orders the new suffixes, and the
common prefixes of neighbours follow from the smallest old value between them.  Neighbours with ``length`` common
bytes are repeats.  Each round reads the former order and prefixes once, in sequence, and writes the next.

So that this runs on Spark, the collection is made of short contexts instead of whole documents (whose longest
would set the number of rounds):

1. Every window of ``length`` bytes owns its smallest ``gram``-byte string by hash, its anchor.  Equal windows own
   equal anchors at the same place, so only contexts of one anchor string, aligned at it, need to be compared.
2. An anchor string that occurs once is dropped.  Equal contexts fall into one class, which enters the construction as
   two strings if it occurs more than once.  The classes of an anchor string form its collection.
3. A collection beyond ``cap`` contexts is split by the window's offset to the anchor: windows of half the offsets
   share a longer core, by whose content they are dealt anew.  At a single offset the core is the window itself,
   so every collection gets small without a limit on repeats, and a hot passage never meets in one task.

Every repeat comes out of a construction; contexts of one class and equal texts are known by hash.

Defined results: null text is empty; texts shorter than ``length`` keep all bytes; equal rows are repeats of each
other; an empty table gives no rows; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslytics.llm import words as W
from obslytics.llm.common import hot_keys, join_apart, stored

CAP = 8192          # contexts of one collection
TOGETHER = 2048     # contexts of small collections that one construction takes at once


# ---- anchors ------------------------------------------------------------------------------------------------

def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1: n])


def gram_of(length: int) -> int:
    """Bytes of an anchor: long ones repeat only in long repeats (not in lines that many texts share), short ones
    leave more room in the window, so that there are fewer anchors."""
    return 128 if length >= 320 else 16 if length >= 64 else 8


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of one text: every gram that is smallest in a window of ``length`` bytes."""
    gram = gram_of(length)
    text = np.ascontiguousarray(text)
    eights = np.ndarray((len(text) - 7,), "<u8", text.data, strides=(1,))
    n = len(text) - gram + 1
    hashes = eights[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(8, gram, 8):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + eights[k: k + n]
    hashes = W.mix(hashes)
    width = length - gram + 1
    smallest = _sliding_min(hashes, width)
    edge = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
    largest = ~_sliding_min(np.concatenate([edge, ~smallest, edge]), width)
    at = np.flatnonzero(hashes == largest)
    return at, hashes[at].view(np.int64)


def anchor_table(texts: DataFrame, length: int) -> DataFrame:
    """Rows (h, c, k1, k2, at, before, after) for ``texts(k1, k2, text)``: anchor hash, hash of the context,
    the text's key, place, and the bytes of context on either side of the place."""
    reach = length - gram_of(length)

    def rows(batches):
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(2))
            keys = [np.asarray(batch.column(i)) for i in (0, 1)]
            out = []
            for i in np.flatnonzero(np.diff(offsets) >= length).tolist():
                text = data[offsets[i]: offsets[i + 1]]
                at, h = anchors(text, length)
                before, after = np.minimum(at, reach), np.minimum(len(text) - at, length)
                raw = text.data
                c = [xxhash.xxh3_64_intdigest(raw[p - b: p + a], b << 16 | a)
                     for p, b, a in zip(at.tolist(), before.tolist(), after.tolist(), strict=True)]
                out.append((h, np.array(c, np.uint64).view(np.int64), np.full(len(at), keys[0][i]),
                            np.full(len(at), keys[1][i]), at.astype(np.int32), before.astype(np.int32), after.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)],
                                                 names=["h", "c", "k1", "k2", "at", "before", "after"])

    return texts.mapInArrow(rows, "h long, c long, k1 long, k2 long, at int, before int, after int")


# ---- column-wise construction -------------------------------------------------------------------------------

def column_wise(contexts: list[bytes], before: np.ndarray, after: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each context, aligned at its anchor, the byte ranges (relative to the anchor) that are covered by
    windows which occur at the same place of another context."""
    m, centre = len(contexts), int(before.max())
    width = centre + int(after.max())
    # the end of each string is a symbol of its own, as in any transform of a collection
    columns = np.repeat((256 + np.arange(m, dtype=np.uint16))[None, :], width, axis=0)
    for i, raw in enumerate(contexts):
        columns[centre - before[i]: centre + after[i], i] = np.frombuffer(raw, np.uint8)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    repeated = np.zeros((max(0, width - length + 1), m), bool)
    for x in range(width - 1, -1, -1):
        symbols = columns[x, order]                      # this column of the transform
        moved = np.argsort(symbols, kind="stable")
        symbols, order = symbols[moved], order[moved]
        same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
        fresh = np.zeros(m + 1, np.int32)
        if len(same):
            between = np.empty(2 * len(same), np.int64)
            between[0::2], between[1::2] = moved[same - 1] + 1, moved[same] + 1
            fresh[same] = np.minimum.reduceat(common, between)[0::2] + 1
        common = fresh
        if x < len(repeated):
            long = common >= length
            repeated[x, order] = long[:-1] | long[1:]
    return [_ranges(np.flatnonzero(repeated[:, i]) - centre, length) for i in range(m)]


def _ranges(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


RANGES_DDL = "g long, c long, ranges array<struct<lo:int,hi:int>>"


def collections(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated ranges of contexts(g, c, n, low, high, before, after, bytes), whose collections are bounded; ``n``: how often
    a context occurs.

    A task takes whole collections, in order, and joins small ones of equal offsets into one construction."""

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby(["low", "high"], sort=False):
            # a context that occurs more than once is two strings of the collection
            row = np.repeat(np.arange(len(part)), 1 + (part["n"].to_numpy() > 1))
            found = column_wise([part["bytes"].iloc[i] for i in row], part["before"].to_numpy()[row], part["after"].to_numpy()[row], length)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            out.append(pd.DataFrame({"g": part["g"].to_numpy(), "c": part["c"].to_numpy(),
                                     "ranges": [[{"lo": a, "hi": b} for a, b in found[i]] for i in first]}))
        out = pd.concat(out)
        return out[out["ranges"].map(len) > 0]

    def run(batches):
        held, n = [], 0
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            n += len(pdf)
            if n >= TOGETHER:
                rows = pd.concat(held, ignore_index=True)
                whole = (rows["g"] != rows["g"].iloc[-1]).to_numpy()
                cut = int(np.flatnonzero(whole)[-1]) + 1 if whole.any() else 0
                for first, last in _groups(rows["g"].to_numpy()[:cut]):
                    yield take(rows.iloc[first:last])
                held = [rows.iloc[cut:]]
                n = len(rows) - cut
        if n:
            rows = pd.concat(held, ignore_index=True)
            for first, last in _groups(rows["g"].to_numpy()):
                yield take(rows.iloc[first:last])

    return (contexts.select("g", "c", "n", "low", "high", "before", "after", "bytes").repartition("g").sortWithinPartitions("g")
            .mapInPandas(run, RANGES_DDL))


def _groups(g: np.ndarray):
    """Neighbouring whole collections of about ``TOGETHER`` contexts."""
    first = 0
    while first < len(g):
        last = min(first + TOGETHER, len(g))
        while last < len(g) and g[last] == g[last - 1]:
            last += 1
        yield first, last
        first = last


# ---- the operator -------------------------------------------------------------------------------------------

def distinct_texts(texts: DataFrame) -> DataFrame:
    """(k1, k2, packed): each distinct text once, compressed for the shuffle."""

    def pack(batches):
        packer = zstandard.ZstdCompressor(1)
        for batch in batches:
            packed = [packer.compress(x.encode()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["k1", "k2", "packed"])

    return texts.mapInArrow(pack, "k1 long, k2 long, packed binary").groupBy("k1", "k2").agg(F.first("packed").alias("packed"))


def _cut(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Contexts (h, c, n, before, after, bytes) of ``wanted`` classes out of the distinct texts."""
    by_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "n", "at", "before", "after")).alias("classes"))

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = {k: [] for k in ("h", "c", "n", "before", "after", "bytes")}
            for i, (packed, classes) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                raw = unpack(packed.as_py())
                for x in classes.as_py():
                    for k in ("h", "c", "n", "before", "after"):
                        out[k].append(x[k])
                    out["bytes"].append(raw[x["at"] - x["before"]: x["at"] + x["after"]])
                if len(out["h"]) >= 2048 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(pa.array(out[k], pa.int64()) for k in ("h", "c", "n")),
                                                      *(pa.array(out[k], pa.int32()) for k in ("before", "after")),
                                                      pa.array(out["bytes"], pa.binary())], names=list(out))
                    out = {k: [] for k in out}

    return (distinct_texts(texts).join(by_text, ["k1", "k2"]).select("packed", "classes")
            .mapInArrow(cut, "h long, c long, n long, before int, after int, bytes binary"))


def repeated_ranges(texts: DataFrame, length: int = 400, cap: int = CAP) -> DataFrame:
    """Rows (k1, k2, ranges): byte ranges of each distinct text that repeated windows cover.

    ``texts(k1, k2, text)`` has a row for each row of the corpus; the key is 128 bits of the text's hash."""
    reach = length - gram_of(length)
    all_anchors = stored(anchor_table(texts, length), "anchors")
    total = all_anchors.count()
    often = stored(all_anchors.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"), "often", total)
    found = stored(join_apart(all_anchors, often.select("h"), ["h"], hot_keys(often, ["h"], "times", total)), "repeated-anchors", total)
    classes = stored(found.groupBy("h", "c").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("after").alias("after"),
                                                 F.min(F.struct("k1", "k2", "at")).alias("where")), "classes", total)
    sizes = stored(classes.groupBy("h").agg(F.count("*").alias("contexts")), "sizes", total)
    wanted = join_apart(classes, sizes, ["h"], hot_keys(sizes, ["h"], "contexts", classes.count()))
    wanted = stored(wanted.select("h", "c", "n", "before", "after", "where.*", "contexts"), "wanted", total)

    # level 0: a collection is an anchor string; each level halves the offsets of collections beyond the cap
    anchored = [F.col("h").alias("g"), F.lit(0).alias("low"), F.lit(reach).alias("high")]
    small = _cut(texts, wanted.where(F.col("contexts") <= cap)).select(*anchored, "c", "n", "before", "after", "bytes")
    results = [stored(collections(small, length).withColumnRenamed("g", "h"), "ranges")]
    large = wanted.where(F.col("contexts") > cap)
    rows = None if large.isEmpty() else _cut(texts, large).select(*anchored, "h", "c", "n", "before", "after", "bytes")
    while rows is not None:
        level = stored(_halved(rows, length), "halves")
        members = level.groupBy("g", "d").agg(F.sum("n").alias("n"), *(F.first(x).alias(x) for x in ("low", "high", "before", "after", "bytes")))
        members = stored(members, "members")
        names = level.select("h", "c", "g", "d")
        sizes = stored(members.groupBy("g").agg(F.count("*").alias("size"), F.max("n").alias("most")).where("size > 1 or most > 1"), "sizes")
        small = (members.join(sizes.where(F.col("size") <= cap).select("g"), "g")
                 .select("g", F.col("d").alias("c"), "n", "low", "high", "before", "after", "bytes"))
        part = stored(collections(small, length).withColumnRenamed("c", "d"), "ranges")
        results.append(names.join(part.select("g", "d", "ranges"), ["g", "d"]).select("h", "c", "ranges"))
        large = sizes.where(F.col("size") > cap).select("g")
        rows = None if large.isEmpty() else level.join(large, "g")
    ranges = results[0]
    for more in results[1:]:
        ranges = ranges.union(more)
    ranges = stored(ranges.select("h", "c", F.explode("ranges").alias("r")).select("h", "c", "r.*"), "class-ranges", total)
    common = hot_keys(classes, ["h", "c"], "n", found.count())
    return (join_apart(found, ranges, ["h", "c"], common).select("k1", "k2", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
            .groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))


def _halved(rows: DataFrame, length: int) -> DataFrame:
    """Both halves of the offsets [low, high] of every row, dealt by the core that all windows of a half contain.

    A window at offset ``o`` begins ``o`` bytes before the anchor.  Rows too short for a half have no such window."""
    middle = ((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
    rows = rows.select("h", "c", "n", "before", "after", "bytes", F.explode(halves).alias("half"))
    low, high = F.col("half.low"), F.col("half.high")
    rows = rows.where((F.col("before") >= low) & (F.col("after") >= F.lit(length) - high))
    left, right = F.least("before", high), F.least("after", F.lit(length) - low)
    core = F.substring("bytes", F.col("before") - low + 1, F.lit(length) - high + low)
    trimmed = F.substring("bytes", F.col("before") - left + 1, left + right)
    return rows.select("h", "c", F.xxhash64(F.lit(1), "h", low, core).alias("g"), F.xxhash64(F.lit(2), left, right, trimmed).alias("d"),
                       low.alias("low"), high.alias("high"), "n", left.alias("before"), right.alias("after"), trimmed.alias("bytes"))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP,
                   keep: bool = False, keep_text: bool = False) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256), where ``keep`` the kept bytes as ``kept`` and where ``keep_text``
    the same as ``kept_text``, with U+FFFD for a character whose bytes were cut."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), text.alias("text"))
    texts = keyed.select("k1", "k2", "text")
    ranges = repeated_ranges(texts, length, cap)
    names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep, *["kept_text"] * keep_text]

    def removed(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for packed, found in zip(batch.column(2), batch.column(3), strict=True):
                raw, spans, found = unpack(packed.as_py()), [], found.as_py()
                for lo, hi in sorted((x["lo"], x["hi"]) for x in found or ()):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                at, kept = 0, []
                for lo, hi in spans:
                    kept.append(raw[at:lo])
                    at = hi
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                             *[kept] * keep, *[kept.decode("utf-8", "replace")] * keep_text))
            cols = list(zip(*rows, strict=True)) or [()] * (4 + keep + keep_text)
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * keep + [pa.string()] * keep_text
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], names=names)

    ddl = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep + ", kept_text string" * keep_text
    result = distinct_texts(texts).join(ranges, ["k1", "k2"], "left").select("k1", "k2", "packed", "ranges").mapInArrow(removed, ddl)
    return keyed.select("id", "k1", "k2").join(result, ["k1", "k2"]).select(F.col("id").alias(id_col), *names[2:])
