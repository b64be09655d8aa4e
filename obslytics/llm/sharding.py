"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every key (a distinct row) has a place on the ring and a rank, both hashes of its content.  Keys come in order of
rank; each goes clockwise from its place to the first virtual node whose shard is not full.  With ``slack`` 0 the
capacities add up to the number of rows and are at most one apart, so the shards' row counts are as well.

The walk is not replayed key by key.  Between two moments at which a shard gets full, the target of every arc of the
ring is fixed, so only these moments (at most one for each shard) need to be found: by sums of rows over buckets of
rank, refined in the bucket where a shard first reaches its capacity.  The driver sees such sums, and the few keys of
the last bucket, never the rows.  A key with many equal rows is split between shards where one gets full.

Defined results: null text has no bytes; equal rows are interchangeable; null ids hash like any value; an empty
table gives no rows; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obslytics.llm.common import stored

SHARDS = 8
NODES = 128            # virtual nodes of a shard
BUCKETS = 1024         # of rank in one pass
EXACT_KEYS = 4096      # keys of a bucket that the driver takes to find the moment
RANK_BITS = 62
SLOT_ROWS = 2000       # rows of a bucket in which slots are numbered
COPIES = 4096          # equal rows written from one row


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of the virtual nodes and their shards.  A shard's nodes do not depend on the other shards."""
    at = [(int.from_bytes(hashlib.blake2b(f"{s}/{k}".encode(), digest_size=8).digest(), "big") >> 2, s) for s in range(shards) for k in range(nodes)]
    at.sort()
    return np.array([a for a, _ in at], np.int64), np.array([s for _, s in at], np.int64)


def targets(owners: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each node the shard of the next node, itself included, whose shard has room."""
    out, nearest = np.full(len(owners), -1), -1
    for i in [*range(len(owners) - 1, -1, -1)] * 2:
        if left[owners[i]] > 0:
            nearest = owners[i]
        out[i] = nearest
    return out


def capacities(rows: int, shards: int, slack: float) -> np.ndarray:
    if slack > 0:
        return np.full(shards, int(np.ceil(rows / shards * (1 + slack))), np.int64)
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def _keys(docs: DataFrame, id_col: str, text_col: str, places: np.ndarray) -> DataFrame:
    """Distinct rows (id, size, crc, n, arc, rank); ``arc`` is the first node at or after the key's place."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"))
    keys = rows.groupBy("id", "size", "crc").agg(F.count("*").alias("n"))
    keys = keys.withColumns({"place": F.shiftrightunsigned(F.xxhash64(F.lit(1), "id", "size", "crc"), 64 - RANK_BITS),
                             "rank": F.shiftrightunsigned(F.xxhash64(F.lit(2), "id", "size", "crc"), 64 - RANK_BITS)})

    def arcs(batches):
        for pdf in batches:
            arc = np.searchsorted(places, pdf["place"].to_numpy()) % len(places)
            yield pdf.assign(arc=arc).astype({"id": "Int64"})[["id", "size", "crc", "n", "arc", "rank"]]

    return keys.mapInPandas(arcs, "id long, size long, crc long, n long, arc int, rank long")


class Walk:
    """Moments at which shards get full, found by sums over the keys."""

    def __init__(self, keys: DataFrame, owners: np.ndarray, room: np.ndarray):
        self.keys, self.owners, self.left = keys, owners, room.copy()
        self.until: list[int] = []               # last rank of each phase
        self.target: list[np.ndarray] = []       # shard of each arc in that phase
        self.single: dict[tuple, list] = {}      # keys placed one by one: the parts (shard, rows)
        low = 0
        while True:
            target = targets(owners, self.left)
            self.target.append(target)
            end = self._full(low, target)
            if end is None:
                self.until.append(1 << RANK_BITS)
                return
            self.until.append(end)
            low = end + 1
            if not (self.left > 0).any():
                return

    def _sums(self, low: int, high: int, width: int, target: np.ndarray) -> np.ndarray:
        shard = F.element_at(F.array(*(F.lit(int(x)) for x in target)), F.col("arc") + 1)
        out = np.zeros((BUCKETS, len(self.left) + 1), np.int64)
        for r in (self.keys.where(F.col("rank").between(low, high))
                  .groupBy(F.expr(f"(rank - {low}L) div {width}L").alias("b"), shard.alias("shard"))
                  .agg(F.sum("n").alias("n"), F.count("*").alias("keys")).collect()):
            out[r.b, r.shard] += r.n
            out[r.b, -1] += r["keys"]
        return out

    def _full(self, low: int, target: np.ndarray) -> int | None:
        """Rank at which the first shard gets full; takes the rows up to it off the room that is left."""
        high = (1 << RANK_BITS) - 1
        while True:
            width = -(-(high - low + 1) // BUCKETS)
            sums = self._sums(low, high, width, target)
            total = np.cumsum(sums[:, :-1], axis=0)
            over = np.flatnonzero(((total >= self.left) & (self.left > 0)).any(axis=1))
            if not len(over):
                self.left -= total[-1]
                return None
            b = int(over[0])
            if b:
                self.left -= total[b - 1]
            low, high = low + b * width, min(high, low + (b + 1) * width - 1)
            if sums[b, -1] <= EXACT_KEYS or width == 1:
                return self._exact(low, high, target)

    def _exact(self, low: int, high: int, target: np.ndarray) -> int:
        rows = self.keys.where(F.col("rank").between(low, high)).toPandas().sort_values(["rank", "id", "size", "crc"])
        for rank, tied in rows.groupby("rank", sort=True):
            need = np.bincount(target[tied["arc"].to_numpy()], tied["n"].to_numpy(), len(self.left)).astype(np.int64)
            if ((need < self.left) | (need == 0)).all():
                self.left -= need
                continue
            for key in tied.itertuples():
                parts, n = [], int(key.n)
                while n:
                    shard = int(targets(self.owners, self.left)[key.arc])
                    take = min(n, int(self.left[shard]))
                    self.left[shard] -= take
                    n -= take
                    parts.append((shard, take))
                self.single[(None if pd.isna(key.id) else int(key.id), int(key.size), int(key.crc))] = parts
            return int(rank)
        raise AssertionError("no shard got full")


def shard_rows(docs: DataFrame, shards: int = SHARDS, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text",
               nodes: int = NODES) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot) for every row; slots are gapless from 0 in each shard."""
    places, owners = ring(shards, nodes)
    keys = stored(_keys(docs, id_col, text_col, places), "keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    walk = Walk(keys, owners, capacities(total, shards, slack)) if total else None
    until, target, single = (walk.until, np.stack(walk.target), walk.single) if walk else ([0], np.zeros((1, len(owners)), np.int64), {})

    def place(batches):
        ends = np.array(until, np.int64)
        ranks = set(until)  # the keys at a moment were placed one by one
        for pdf in batches:
            phase = np.minimum(np.searchsorted(ends, pdf["rank"].to_numpy()), len(ends) - 1)
            pdf["shard"] = target[phase, pdf["arc"].to_numpy()]
            pdf = pdf.astype({"id": "Int64"})[["id", "size", "crc", "n", "rank", "shard"]]
            alone = pdf["rank"].isin(ranks).to_numpy()
            yield pdf[~alone]
            for row in pdf[alone].itertuples(index=False):
                key = (None if pd.isna(row.id) else int(row.id), int(row.size), int(row.crc))
                parts = single[key]
                yield pd.DataFrame([(*row[:3], n, row.rank, shard) for shard, n in parts], columns=pdf.columns).astype({"id": "Int64"})

    placed = stored(keys.mapInPandas(place, "id long, size long, crc long, n long, rank long, shard int"), "placed")
    bits = max(0, min(20, (max(1, total) // SLOT_ROWS).bit_length()))
    placed = placed.withColumn("bucket", F.shiftright("rank", RANK_BITS - bits))
    sums = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "bucket", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("shard", "bucket").orderBy("rank", "id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (placed.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, ["shard", "bucket"])
                .withColumn("slot", F.col("ahead") + F.col("before")))
    # equal rows are written out again, many of them by several tasks
    few = numbered.where(F.col("n") <= COPIES)
    many = (numbered.where(F.col("n") > COPIES).withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}"))))
            .withColumns({"slot": F.col("slot") + F.col("part") * COPIES, "n": F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES)})
            .drop("part").repartition("slot"))
    rows = few.unionByName(many).withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("slot") + F.col("copy")).alias("slot"))
