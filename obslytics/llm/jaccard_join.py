"""Exact n-gram Jaccard self-join by universe partition and the pigeonhole principle.

A document is the set of its distinct five-word shingles; two link when ``|A and B| / |A or B| >= num / den``.
Sets whose sizes allow a link differ in at most ``H`` shingles.  For a size band the shingle universe is hashed
into segments, so that few segments of a linked pair can differ:

* Threshold 0: a set of size ``s`` differs from any partner in at most ``floor(s * (den/num - 1))`` shingles.  It
  indexes the subset of its first non-empty segments, one more than that (and some to spare); of these at least one
  is identical in, and indexed by, the partner.
* Threshold 1: with ``2 * segments > H`` one segment differs in one shingle at most; each set indexes its segments
  and their one-deletion neighbourhoods.

``allocate`` picks for each band the cheaper of the two that is safe.  Signatures are shuffled in packed form;
equal ones propose candidates, which are verified exactly on the texts.

A frequent signature (more than ``run_limit`` sets) proposes no pairs.  That loses nothing as long as a set has no
more frequent signatures than it has to spare.  The other sets below a frequent signature are compared with one of
them; of families of such sets that this leaves in several components, the sets that share a rare enough shingle
(prefixes, see ``meetings``) are then compared block by block, so the classes are exact.  A pair is verified only if it shares enough signatures.  Signatures and set fingerprints have 64 bits.

Defined results: null and empty texts and texts without words have the empty set, which links with nothing; equal
sets are one class, whose copies are never paired; repeated rows are copies; an empty table gives no rows; columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obslytics.llm import words as W
from obslytics.llm.common import components, stored, union_find

SHINGLE = 5
RUN_LIMIT = 8
SIGNATURES_PER_PART = 1_000_000
MEMBERS_PER_ROW = 4096
SHINGLES_AT_ONCE = 1 << 20
STAR_ROWS = 256             # of a frequent signature, about so many sets meet its centre in one place


# ---- sets ---------------------------------------------------------------------------------------------------

def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words has one shingle, none without words."""
    data, offsets = W.text_bytes(column)
    for first, last in W.chunks(offsets):
        hashes, starts = W.words(data, offsets[first: last + 1], W.SPACE_WORDS)
        shingles = W.runs(hashes, size)
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if hi - lo >= size:
                yield np.unique(shingles[lo: hi - size + 1])
            else:
                yield W.runs(hashes[lo:hi], hi - lo) if hi > lo else hashes[:0]


def fingerprint(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = W.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(W.mix(np.array([total]))[0].astype(np.int64))


# ---- allocation ---------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Band:
    """How sets are indexed for pairs whose larger set has ``low`` to ``high`` shingles."""

    number: int
    low: int
    high: int
    threshold: int
    segments: int


@dataclass(frozen=True)
class Similarity:
    num: int = 80
    den: int = 100

    def differs(self, size: int) -> int:
        """Most shingles in which a set of this size can differ from a partner."""
        return size * (self.den - self.num) // self.num

    def largest_partner(self, size: int) -> int:
        return size * self.den // self.num

    def indexed(self, size: int) -> int:
        return self.differs(size) + 1 + self.spare(size)

    @staticmethod
    def spare(size: int) -> int:
        return size // 16


def _log_chance_of_fewer(need: int, size: int, segments: int) -> float:
    """Logarithm of a bound of the chance that ``size`` shingles lie in fewer than ``need`` of the segments."""
    few = need - 1
    if few == 0:
        return float("-inf")
    if few >= segments:
        return 0.0
    return lgamma(segments + 1) - lgamma(few + 1) - lgamma(segments - few + 1) + size * log(few / segments)


@lru_cache(maxsize=4096)
def allocate(sim: Similarity, number: int) -> Band:
    """Bands double in size.  Threshold 0 costs one row a segment, but needs enough non-empty segments for every size
    of the band, except for a chance below 1e-15, and threshold 1 costs a row for each shingle as well."""
    high = 8 << number
    low = 1 if number == 0 else high // 2 + 1
    smallest = -(-low * sim.num // sim.den)
    for segments in (int(0.36 * high) + 8, high // 2 + 8, high, 2 * high, 4 * high, 8 * high):
        if all(_log_chance_of_fewer(sim.indexed(size), size, segments) < log(1e-15) for size in range(smallest, high + 1)):
            return Band(number, low, high, 0, segments)
    most = 2 * high * (sim.den - sim.num) // (sim.den + sim.num)
    return Band(number, low, high, 1, most // 2 + 1)


def band_of(size: int) -> int:
    return max(0, (size - 1).bit_length() - 3)


def signatures(shingles: np.ndarray, sim: Similarity) -> np.ndarray:
    """Signatures of one set, for its own band and, where a larger partner may lie there, for those above."""
    size, out = len(shingles), []
    top = band_of(sim.largest_partner(size))
    with np.errstate(over="ignore"):
        for number in range(band_of(size), top + 1):
            band = allocate(sim, number)
            salt = np.uint64(number + 1) * np.uint64(0xD1342543DE82EF95)
            segment = (shingles >> np.uint64(7)) % np.uint64(band.segments)
            order = np.argsort(segment, kind="stable")
            segment, token = segment[order], W.mix(shingles[order] ^ salt)
            starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            sums = np.add.reduceat(token, starts)
            if band.threshold == 0:
                keep = slice(0, sim.indexed(size))
                out.append(W.mix(sums[keep] + W.mix(segment[starts][keep] + salt)))
                continue
            full = np.zeros(band.segments, np.uint64)
            full[segment[starts]] = sums
            names = W.mix(np.arange(band.segments, dtype=np.uint64) + salt)
            out.append(W.mix(full + names))
            if sim.differs(size):  # others link with equal sets only
                out.append(W.mix(full[segment] - token + names[segment]))  # each set less one of its shingles
    return np.unique(np.concatenate(out))


# ---- candidates ---------------------------------------------------------------------------------------------

PACKED = pa.schema([("part", pa.int32()), ("signatures", pa.binary()), ("owner_of", pa.binary()), ("owners", pa.binary()),
                    ("sizes", pa.binary()), ("beside", pa.binary())])
PACKED_DDL = "part int, signatures binary, owner_of binary, owners binary, sizes binary, beside binary"
_SIX = np.dtype([("low", "<u4"), ("high", "<u2")])


def _six_bytes(x: np.ndarray) -> bytes:
    out = np.empty(len(x), _SIX)
    out["low"], out["high"] = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) & np.uint64(0xFFFF)
    return out.tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, _SIX)
    return x["low"].astype(np.uint64) | x["high"].astype(np.uint64) << np.uint64(32)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal sorted keys."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def packed_signatures(docs: DataFrame, text_col: str, sim: Similarity, parts: int, run_limit: int) -> DataFrame:
    """Signatures of every text, dealt to ``parts`` and packed: one row for each part and Arrow batch.

    Of a signature that more than ``run_limit`` sets of a batch have, one set more than the limit goes on, which
    marks it as frequent; the other sets' memberships travel beside, so a hot signature meets in no task.
    """

    def pack(batches):
        for batch in batches:
            owners, sizes, found = [], [], []
            seen = set()
            for shingles in shingle_sets(batch.column(0)):
                if len(shingles) and (owner := fingerprint(shingles)) not in seen:
                    seen.add(owner)
                    owners.append(owner)
                    sizes.append(len(shingles))
                    found.append(signatures(shingles, sim))
            if not owners:
                continue
            owners, sizes = np.array(owners, np.int64), np.array(sizes, np.int32)
            by_owner = np.argsort(owners, kind="stable")
            owners, sizes, found = owners[by_owner], sizes[by_owner], [found[i] for i in by_owner]
            owner_of = np.repeat(np.arange(len(owners)), [len(x) for x in found])
            found = np.concatenate(found)
            order = np.argsort(found, kind="stable")
            found, owner_of = found[order], owner_of[order]
            starts, lengths = _runs(found)
            nth = np.arange(len(found)) - np.repeat(starts, lengths)
            beside = nth > run_limit
            part = ((found >> np.uint64(48)) % np.uint64(parts)).astype(np.uint16)
            order = np.argsort(part, kind="stable")  # one pass, however many parts there are
            part, found, owner_of, beside = part[order], found[order], owner_of[order], beside[order]
            rows = []
            for first, n in zip(*(x.tolist() for x in _runs(part)), strict=True):
                rest = beside[first: first + n]
                signature, owner = found[first: first + n], owner_of[first: first + n]
                used, index = np.unique(owner[~rest], return_inverse=True)
                more = np.stack([(signature[rest] & np.uint64((1 << 48) - 1)).astype(np.int64), owners[owner[rest]]], 1)
                rows.append((int(part[first]), _six_bytes(signature[~rest]), index.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes(),
                             owners[used].tobytes(), sizes[used].tobytes(), more.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(zip(*rows), PACKED, strict=True)], schema=PACKED)

    return docs.select(F.col(text_col)).mapInArrow(pack, PACKED_DDL)


FOUND_DDL = "a long, b long, shared long, least long, signature long, times long, members binary"


def _fits(a: np.ndarray, b: np.ndarray, sim: Similarity) -> np.ndarray:
    a, b = a.astype(np.int64), b.astype(np.int64)
    return np.minimum(a, b) * sim.den >= np.maximum(a, b) * sim.num


def proposals(packed: DataFrame, sim: Similarity, run_limit: int) -> DataFrame:
    """Rows (a, b, shared, least) of candidate pairs, how many signatures they share here and the smaller size, and
    rows (signature, times, members) for frequent signatures; ``times``: members of the signature in all of its rows."""

    def propose(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        index = [np.frombuffer(i, "<u2" if len(o) <= 8 << 16 else "<u4") for i, o in zip(pdf["owner_of"], pdf["owners"], strict=True)]
        owner = np.concatenate([np.frombuffer(o, np.int64)[i] for o, i in zip(pdf["owners"], index, strict=True)])
        size = np.concatenate([np.frombuffer(s, np.int32)[i] for s, i in zip(pdf["sizes"], index, strict=True)])
        sig = np.concatenate([_from_six(x) for x in pdf["signatures"]])
        beside = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in pdf["beside"]])
        order = np.lexsort((owner, sig))
        sig, owner, size = sig[order], owner[order], size[order]
        fresh = np.append(True, (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1]))
        sig, owner, size = sig[fresh], owner[fresh], size[fresh]
        starts, lengths = _runs(sig)
        pairs = [np.zeros((0, 3), np.int64)]
        for n in range(2, run_limit + 1):
            at = starts[lengths == n]
            for i in range(n):
                for j in range(i + 1, n):
                    fits = _fits(size[at + i], size[at + j], sim)
                    x, y = (at + i)[fits], (at + j)[fits]
                    pairs.append(np.stack([owner[x], owner[y], np.minimum(size[x], size[y])], 1))
        pairs, shared = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        inside = np.repeat(lengths > run_limit, lengths)
        members = np.concatenate([np.stack([sig[inside].astype(np.int64), owner[inside]], 1), beside])
        members = members[np.argsort(members[:, 0], kind="stable")]
        at, lengths = _runs(members[:, 0])
        rows = [(members[s, 0] | part << 48, n, members[i: min(i + MEMBERS_PER_ROW, s + n), 1].tobytes())
                for s, n in zip(at.tolist(), lengths.tolist(), strict=True) for i in range(s, s + n, MEMBERS_PER_ROW)]
        out = pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "shared": shared, "least": pairs[:, 2]}, dtype="Int64")
        more = pd.DataFrame({"signature": pd.Series([r[0] for r in rows], dtype="Int64"), "times": pd.Series([r[1] for r in rows], dtype="Int64"),
                             "members": [r[2] for r in rows]})
        return pd.concat([out, more], ignore_index=True)[["a", "b", "shared", "least", "signature", "times", "members"]]

    return packed.groupBy("part").applyInPandas(propose, FOUND_DDL)


# ---- verification -------------------------------------------------------------------------------------------

def compressed(rows: DataFrame) -> DataFrame:
    """``rows(id, text_key, text)`` with ``packed`` in place of the text, for shuffles."""

    def pack(batches):
        packer = zstandard.ZstdCompressor(1)
        for batch in batches:
            texts = [packer.compress((x or "").encode()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["id", "text_key", "packed"])

    return rows.mapInArrow(pack, "id long, text_key long, packed binary")


def _unpacked(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x) for x in column.to_pylist()], pa.binary()).cast(pa.string())


def verified(pairs: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs (a, b) that link, by the sets of their whole texts; ``texts``: (set, packed)."""

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(_unpacked(batch.column(2))), shingle_sets(_unpacked(batch.column(3))), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * sim.den >= (len(x) + len(y) - both) * sim.num)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    left = texts.select(F.col("set").alias("a"), F.col("packed").alias("text_a"))
    right = texts.select(F.col("set").alias("b"), F.col("packed").alias("text_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(check, "a long, b long")


def _members(batches):
    for pdf in batches:
        for signature, times, raw in zip(pdf["signature"], pdf["times"], pdf["members"], strict=True):
            yield pd.DataFrame({"signature": signature, "times": times, "set": np.frombuffer(raw, np.int64)})


def stars(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of every set of placed(signature, times, set) with the smallest one that is placed below its signature.

    The sets of a signature are dealt by hash, the more of them the more often, and its centre goes to each deal."""
    deals = F.expr(f"times div {STAR_ROWS}")
    centre = (placed.groupBy("signature").agg(F.min("set").alias("a"), F.max("times").alias("times"))
              .select("signature", "a", F.explode(F.sequence(F.lit(0).cast("long"), deals)).alias("deal")))
    dealt = placed.select("signature", F.pmod(F.xxhash64("set"), deals + 1).alias("deal"), F.col("set").alias("b"))
    return dealt.join(centre, ["signature", "deal"]).where("a != b").select("a", "b").distinct()


# ---- the join -----------------------------------------------------------------------------------------------

def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text_key, n_shingles, set) of all documents; ``set`` is the fingerprint, null for the empty set."""

    def sets(batches):
        for batch in batches:
            found = list(shingle_sets(batch.column(2)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64()),
                pa.array([fingerprint(x) if len(x) else None for x in found], pa.int64())],
                names=["id", "text_key", "n_shingles", "set"])

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(sets, "id long, text_key long, n_shingles long, set long")


def links(docs: DataFrame, described: DataFrame, sim: Similarity, id_col: str, text_col: str,
          run_limit: int = RUN_LIMIT) -> DataFrame:
    """Verified links between set fingerprints that connect every class of linked sets."""
    total, docs_n = described.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    parts = max(64, total // 2 // SIGNATURES_PER_PART + 1)
    found = stored(proposals(packed_signatures(docs, text_col, sim, parts, run_limit), sim, run_limit), "proposals")
    member = found.where("signature is not null").select("signature", "times", "members").mapInPandas(_members, "signature long, times long, set long")
    frequent = stored(member.groupBy("set").agg(F.count("*").alias("frequent")), "frequent", docs_n)
    spare = lambda size: F.floor(size / 16)

    # a linked pair shares more signatures than the smaller set has to spare; frequent ones were not counted
    pairs = found.where("a is not null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("least").alias("least"))
    for end in ("a", "b"):
        pairs = pairs.join(frequent.select(F.col("set").alias(end), F.col("frequent").alias(f"frequent_{end}")), end, "left")
    uncounted = F.least(F.coalesce("frequent_a", F.lit(0)), F.coalesce("frequent_b", F.lit(0)))
    pairs = stored(pairs.where(F.col("shared") + uncounted > spare(F.col("least"))).select("a", "b"), "pairs")

    # a pair that shares frequent signatures only: both sets have more of them than the smaller one has to spare
    sizes = described.where("set is not null").select("set", "n_shingles").distinct()
    short = stored(sizes.join(frequent, "set").where(F.col("frequent") > spare(F.floor(F.col("n_shingles") * sim.num / sim.den)))
                   .select("set", "n_shingles", "frequent"), "short", docs_n)
    # ... and share so many that they meet below one of the rarer ones of each
    rarest = Window.partitionBy("set").orderBy("times", "signature")
    placed = (member.join(short, "set").withColumn("nth", F.row_number().over(rarest))
              .where(F.col("nth") <= F.col("frequent") - spare(F.floor(F.col("n_shingles") * sim.num / sim.den)))
              .select("signature", "times", "set"))
    starred = stored(stars(stored(placed, "placed", total)), "stars", total)
    n_pairs = pairs.count() + starred.count()
    pairs = stored(pairs.union(starred).distinct(), "pairs", n_pairs)

    # one row stands for each set that a pair names
    named = pairs.select(F.explode(F.array("a", "b")).alias("set")).union(short.select("set")).distinct()
    no_id = F.coalesce("id", F.lit(-(1 << 63)))
    standing = (described.where("set is not null").groupBy("set")
                .agg(F.min(F.struct("id", "text_key")).alias("row")).join(named, "set", "left_semi")
                .select("set", "row.*").select("set", "text_key", no_id.alias("id")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    texts = (compressed(rows).withColumn("id", no_id).join(standing, ["text_key", "id"])
             .dropDuplicates(["text_key", "id"]).select("set", "packed"))
    texts = stored(texts, "texts")
    linked = stored(verified(pairs, texts, sim), "verified")

    # families that the stars left apart
    family = components(starred)
    state = (short.join(family.select(F.col("node").alias("set"), F.col("component").alias("family")), "set")
             .join(components(linked).withColumnRenamed("node", "set"), "set", "left")
             .select("set", "n_shingles", "family", F.coalesce("component", "set").alias("component")))
    apart = stored(in_several(stored(state, "families", docs_n)), "apart")
    shingles = apart.agg(F.sum("n_shingles")).first()[0]
    if not shingles:
        return linked
    # a family may hold many sets that are far from each other: only those that can link stay together
    met = components(meetings(apart, texts, sim, max(64, shingles // SIGNATURES_PER_PART + 1)))
    apart = in_several(apart.drop("family").join(met.select(F.col("node").alias("set"), F.col("component").alias("family")), "set"))
    return linked.union(stored(compared(stored(apart, "met"), texts, sim), "compared"))


def _dealt(part: np.ndarray, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """One row for each part, with the bytes of its rows of each column."""
    order = np.argsort(part, kind="stable")
    starts, lengths = _runs(part[order])
    columns = {name: x[order] for name, x in columns.items()}
    return pd.DataFrame({"part": part[order][starts].astype(np.int32)} | {
        name: [x[first: first + n].tobytes() for first, n in zip(starts.tolist(), lengths.tolist(), strict=True)] for name, x in columns.items()})


def _gathered(pdf: pd.DataFrame, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[name]), kind)


def size_band(sizes: np.ndarray, sim: Similarity) -> np.ndarray:
    """Bands of sizes; those of a linked pair are equal or neighbours."""
    return np.floor(np.log(sizes) / np.log(sim.den / sim.num) + 1e-9).astype(np.int32)


def meetings(members: DataFrame, texts: DataFrame, sim: Similarity, parts: int) -> DataFrame:
    """Pairs (a, b) that connect all linked ones among members(set), by prefixes.

    Shingles are ordered by the number of members that have them, rare ones first.  Of a linked pair the first common
    shingle stands in each set among the first ``size - least overlap + 1``, so the sets that have a shingle there, and
    sizes of neighbouring bands, are connected.  All is dealt by hash, of shingles or of sets, to ``parts`` in packed form."""

    def shingles(batches):
        for pdf in batches:
            names, held, n = pdf["set"].tolist(), [], 0
            for last, found in enumerate(shingle_sets(_unpacked(pa.array(pdf["packed"], pa.binary()))), 1):
                held.append(found)
                n += len(found)
                if n < SHINGLES_AT_ONCE and last < len(names):
                    continue
                token, size = np.concatenate(held), np.array([len(x) for x in held], np.int32)
                name = np.array(names[last - len(held): last], np.int64)
                yield _dealt(token % np.uint64(parts), {"token": token, "name": np.repeat(name, size), "size": np.repeat(size, size)})
                held, n = [], 0

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        token, name, size = _gathered(pdf, "token", "<u8"), _gathered(pdf, "name", "<i8"), _gathered(pdf, "size", "<i4")
        order = np.argsort(token, kind="stable")
        lengths = _runs(token[order])[1]
        times = np.repeat(lengths, lengths).astype(np.int32)
        order, times = order[times > 1], times[times > 1]  # what no other member has connects none
        token, name, size = token[order], name[order], size[order]
        return _dealt(name.view(np.uint64) % np.uint64(parts), {"token": token, "name": name, "size": size, "times": times})

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        token, name, size, times = (_gathered(pdf, x, kind) for x, kind in (("token", "<u8"), ("name", "<i8"), ("size", "<i4"), ("times", "<i4")))
        order = np.lexsort((token, times, name))
        token, name, size = token[order], name[order], size[order].astype(np.int64)
        starts, lengths = _runs(name)
        nth = np.arange(len(name)) - np.repeat(starts, lengths) + size - np.repeat(lengths, lengths)  # those of no other member come first
        keep = nth <= size - -(-size * sim.num // sim.den)
        token, name, band = token[keep], name[keep], size_band(size[keep], sim)
        return _dealt(token % np.uint64(parts), {"token": token, "name": name, "band": band})

    def connected(pdf: pd.DataFrame) -> pd.DataFrame:
        token, name, band = (np.tile(_gathered(pdf, x, kind), 2) for x, kind in (("token", "<u8"), ("name", "<i8"), ("band", "<i4")))
        band[len(band) // 2:] += 1
        order = np.lexsort((band, token))
        token, name, band = token[order], name[order], band[order]
        starts = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (band[1:] != band[:-1])))
        nodes, root = union_find(np.repeat(name[starts], np.diff(np.append(starts, len(name)))), name)
        moved = nodes != root
        return pd.DataFrame({"a": nodes[moved], "b": root[moved]})

    ddl = "part int, token binary, name binary"
    return (members.select("set").join(texts, "set").mapInPandas(shingles, f"{ddl}, size binary")
            .groupBy("part").applyInPandas(counted, f"{ddl}, size binary, times binary")
            .groupBy("part").applyInPandas(first, f"{ddl}, band binary")
            .groupBy("part").applyInPandas(connected, "a long, b long"))


def in_several(state: DataFrame) -> DataFrame:
    """The rows of state(family, component, ...) whose family lies in several components."""
    several = state.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("family")
    return state.join(several, "family")


def compared(members: DataFrame, texts: DataFrame, sim: Similarity, block: int = 512) -> DataFrame:
    """Links within each family of members(set, n_shingles, family, component), found by comparing blocks of sets.

    A set is compared in the size band of its own and, with the sets of that band, the one above; blocks of one large
    component are not compared with each other.  Each task holds two blocks and returns a forest of their links."""
    ratio = sim.den / sim.num
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(np.log(ratio)).cast("double"))
    dealt = members.select("*", F.inline(F.array(F.struct(band.alias("band"), F.lit(False).alias("low")),
                                                 F.struct((band + 1).alias("band"), F.lit(True).alias("low")))))
    keys = ["family", "band"]
    large = dealt.groupBy(*keys, "component").agg(F.count("*").alias("n")).where(F.col("n") > block)
    dealt = dealt.join(large, [*keys, "component"], "left")
    mixed = dealt.where("n is null").groupBy(*keys).agg(F.count("*").alias("rest"))
    dealt = dealt.join(mixed, keys, "left")
    deal = lambda n: F.pmod(F.xxhash64("set"), F.expr(f"cast(({n} - 1) div {block} + 1 as bigint)"))
    dealt = dealt.select(*keys, "low", "set", F.when(F.col("n").isNotNull(), F.col("component")).alias("of"),
                         F.when(F.col("n").isNotNull(), deal("n")).otherwise(deal("rest")).alias("block"))
    dealt = stored(dealt, "dealt")
    at = F.struct("of", "low", "block").alias("at")
    blocks = dealt.select(*keys, at).distinct()
    couples = (blocks.withColumnRenamed("at", "x").join(blocks.withColumnRenamed("at", "y"), keys)
               .where((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("x.of") == F.col("y.of"), F.lit(False)))
               .where(~(F.col("x.low") & F.col("y.low")))  # those meet in their own band
               .withColumn("at", F.explode(F.array_distinct(F.array("x", "y")))))
    rows = (dealt.select(*keys, "set", at).join(couples, [*keys, "at"]).join(texts, "set")
            .select(*keys, "x", "y", "set", "packed"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = list(shingle_sets(_unpacked(pa.array(pdf["packed"], pa.binary()))))
        names, size = pdf["set"].to_numpy(), np.array([len(x) for x in sets])
        tokens, index, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        shared = times > 1  # the others are in no two sets
        owner, index, tokens = owner[shared[index]], (np.cumsum(shared) - 1)[index[shared[index]]], tokens[shared]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for first in range(0, len(tokens), 4096):  # counts of shared shingles, some thousand shingles at a time
            here = (index >= first) & (index < first + 4096)
            part = np.zeros((len(sets), 4096), np.float32)
            part[owner[here], index[here] - first] = 1
            both += part @ part.T
        both = both.astype(np.int64)
        i, j = np.nonzero(np.triu(both * sim.den >= (size[:, None] + size[None, :] - both) * sim.num, 1))
        nodes, root = union_find(names[i], names[j])
        moved = nodes != root
        return pd.DataFrame({"a": nodes[moved], "b": root[moved]})

    return rows.groupBy(*keys, "x", "y").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, sim: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text",
                    run_limit: int = RUN_LIMIT, keep_key: bool = False) -> DataFrame:
    """Rows (id, n_shingles, component_id) for every row of ``docs``: the smallest id reachable by links.

    ``keep_key`` adds ``text_key``, the hash of the row's text, which tells rows of one id apart, and ``class``, the same
    for all rows that links connect and null for rows without words."""
    described = stored(describe(docs, id_col, text_col), "sets")
    group = components(links(docs, described, sim, id_col, text_col, run_limit))
    keyed = (described.where("set is not null").join(group.withColumnRenamed("node", "set"), "set", "left")
             .select("id", "text_key", "n_shingles", F.coalesce("component", "set").alias("class")))
    more = ["text_key", "class"] * keep_key
    smallest = keyed.groupBy("class").agg(F.min("id").alias("component_id"))
    return (keyed.join(smallest, "class").select(F.col("id").alias(id_col), "n_shingles", "component_id", *more)
            .union(described.where("set is null").withColumn("class", F.lit(None).cast("long")).select("id", "n_shingles", "id", *more)))
