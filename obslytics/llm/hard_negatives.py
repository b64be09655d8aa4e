"""Hard negatives by rotated one-bit codes with deterministic score intervals.

Components become integers ``floor(scale * x)``; a row's score is its integer inner product with the anchor.  Every
vector is rotated by one random orthogonal matrix and keeps the signs as a code, together with its length along the
code's own direction (the alignment) and the length of the rest.  For an anchor, quantised to 8 bits a component, its
length along a row's code direction comes from popcounts over bit planes.  The product of both lengths is the estimate;
by Cauchy-Schwarz the score is no further from it than the product of the two rests, plus what the quantisation left
out.  Rows whose interval cannot reach the wanted range are left out; the others are scored in integers, so results are
exact whatever the codes are worth.

Rows and anchors are dealt to blocks by hash and compared block by block: every row meets every anchor once, no group
grows with a label, and a task holds one block of either side.  Each block forwards the best few of an anchor.

Defined results: rows with a null label or vector, or with a null or non-finite component, take no part; rows score
against vectors of their own length only; components beyond 2**31 in size count as that; scores beyond 64 bits count as
the largest of their sign; null ids are never anchors and come last among equal scores; repeated rows are rows of
their own, told apart by their place; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obslytics.llm.common import stored
from obslytics.session import default_parallelism

ROW_BLOCK = 8192      # rows of one side of a comparison
ANCHOR_BLOCK = 2048   # anchors of the other
TILE = 1 << 19        # pairs whose intervals are held at a time
SEEDS = 12            # rows scored first, to bound what the others must reach
PLANES = 8            # bits of a quantised anchor component
LIMIT = 2**31 - 1
SLACK = 1e-9          # of the product of two lengths: rounding of the intervals themselves

_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    if dim not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
        _rotations[dim] = q * np.where(np.diag(r) < 0, -1.0, 1.0)
    return _rotations[dim]


# ---- codes --------------------------------------------------------------------------------------------------

CODED_DDL = "row long, id long, label long, dim int, vector binary, code binary, along double, rest double"


def coded(vectors: DataFrame, scale: float) -> DataFrame:
    """``vectors`` (row, id, label, vector) with integers and codes."""

    def encode(batches):
        for pdf in batches:
            dims = pdf["vector"].map(len).to_numpy() if len(pdf) else np.zeros(0, int)
            for dim in np.unique(dims).tolist():
                part = pdf[dims == dim]
                x = np.array([np.asarray(v, np.float64) for v in part["vector"]]).reshape(len(part), dim)
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(scale * x), -LIMIT, LIMIT)
                turned = x @ rotation(dim)
                along = np.abs(turned).sum(axis=1) / max(1, dim) ** 0.5
                bits = np.packbits(turned >= 0, axis=1, bitorder="little")
                bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))
                yield pd.DataFrame({"row": part["row"].to_numpy(), "id": part["id"].astype("Int64").to_numpy(), "label": part["label"].to_numpy(),
                                    "dim": dim, "vector": [v.tobytes() for v in x.astype("<i4")], "code": [b.tobytes() for b in bits],
                                    "along": along, "rest": np.sqrt(np.maximum(0, (x * x).sum(axis=1) - along * along))})

    return vectors.select("row", "id", "label", "vector").mapInPandas(encode, CODED_DDL)


class Side:
    """Vectors of one length in arrays."""

    def __init__(self, pdf: pd.DataFrame, dim: int):
        self.dim, self.pdf = dim, pdf
        self.row, self.label = pdf["row"].to_numpy(), pdf["label"].to_numpy()
        ids = pdf["id"].astype("Int64")
        self.known, self.id = ids.notna().to_numpy(), ids.fillna(0).to_numpy(np.int64)
        self.vector = np.frombuffer(b"".join(pdf["vector"]), "<i4").reshape(len(pdf), dim).astype(np.float64)
        self.code = np.frombuffer(b"".join(pdf["code"]), "<u8").reshape(len(pdf), -1)
        self.along, self.rest = pdf["along"].to_numpy(), pdf["rest"].to_numpy()
        self.length = np.hypot(self.along, self.rest)


class Queries:
    """Rotated anchors, quantised, as bit planes."""

    def __init__(self, side: Side):
        turned = side.vector @ rotation(side.dim)
        n = len(turned)
        self.low = turned.min(axis=1) if side.dim else np.zeros(n)
        self.step = ((turned.max(axis=1) if side.dim else self.low) - self.low) / (2**PLANES - 1)
        safe = np.where(self.step > 0, self.step, 1)[:, None]
        units = np.clip(np.rint((turned - self.low[:, None]) / safe), 0, 2**PLANES - 1)
        near = self.low[:, None] + self.step[:, None] * units
        self.total, self.left_out = near.sum(axis=1), np.linalg.norm(turned - near, axis=1)
        self.square, self.length, self.dim = (near * near).sum(axis=1), side.length, side.dim
        bits = units.astype(np.uint8)[:, :, None] >> np.arange(PLANES, dtype=np.uint8) & 1
        packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
        self.planes = np.pad(packed, ((0, 0), (0, 0), (0, -packed.shape[2] % 8))).reshape(-1).view("<u8").reshape(PLANES, n, -1)

    def intervals(self, some: np.ndarray, rows: Side, cut: slice) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the scores of anchors ``some`` with ``rows[cut]``, and how far the scores may be from them."""
        code = rows.code[cut]
        ones = np.zeros((len(some), len(code)))
        for word in range(code.shape[1]):
            own = code[None, :, word]
            weighted = np.zeros(ones.shape, np.uint32)
            for plane in range(PLANES):
                weighted += np.bitwise_count(own & self.planes[plane, some, word][:, None]).astype(np.uint32) << np.uint32(plane)
            ones += self.low[some, None] * np.bitwise_count(own) + self.step[some, None] * weighted
        along = (2 * ones - self.total[some, None]) / max(1, self.dim) ** 0.5
        rest = np.sqrt(np.maximum(0, self.square[some, None] - along * along))
        width = rest * rows.rest[cut] + (self.left_out[some, None] + SLACK * self.length[some, None]) * rows.length[cut] + 0.5
        return along * rows.along[cut], width


def scores(anchors: Side, i: np.ndarray, rows: Side, j: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs."""
    largest = lambda x: np.abs(x).max(initial=0)
    if largest(anchors.vector) * largest(rows.vector) * max(1, anchors.dim) < 2**53:
        out = np.zeros(len(i), np.int64)
        for at in range(0, len(i), 1 << 15):
            cut = slice(at, at + (1 << 15))
            out[cut] = np.einsum("ij,ij->i", anchors.vector[i[cut]], rows.vector[j[cut]]).astype(np.int64)
        return out
    whole = [sum(int(x) * int(y) for x, y in zip(anchors.vector[a], rows.vector[b], strict=True)) for a, b in zip(i, j, strict=True)]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in whole], np.int64)


# ---- blocks -------------------------------------------------------------------------------------------------

def _tiles(anchors: int, rows: int) -> Iterator[tuple[np.ndarray, slice]]:
    height = max(1, min(anchors, TILE // max(1, min(rows, 4096))))
    for a in range(0, anchors, height):
        yield from ((np.arange(a, min(a + height, anchors)), slice(r, min(r + 4096, rows))) for r in range(0, rows, 4096))


def _nearest(estimate: np.ndarray, goal: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor up to ``SEEDS`` allowed rows whose estimates are nearest to ``goal`` (infinite: the highest)."""
    apart = np.where(np.isinf(goal)[:, None], -estimate, np.abs(estimate - np.where(np.isinf(goal), 0, goal)[:, None]))
    apart = np.where(allowed, apart, np.inf)
    count = min(SEEDS, apart.shape[1])
    j = np.argpartition(apart, count - 1, axis=1)[:, :count]
    i = np.repeat(np.arange(len(goal)), count)
    j = j.reshape(-1)
    keep = np.isfinite(apart[i, j])
    return i[keep], j[keep]


def _ordered(rows: Side, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs by anchor, falling score, id (unknown last) and place."""
    order = np.lexsort((rows.row[j], rows.id[j], ~rows.known[j], -s, i))
    return i[order], j[order], s[order]


def _first(i: np.ndarray, count: int) -> np.ndarray:
    """Mask of the first ``count`` entries of each value of the sorted ``i``."""
    begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
    return np.arange(len(i)) - np.repeat(begin, np.diff(np.r_[begin, len(i)])) < count


def _at_least(i: np.ndarray, s: np.ndarray, anchors: int, count: int, otherwise: np.ndarray) -> np.ndarray:
    """The ``count``-th largest score of each anchor among pairs, where there are so many."""
    out, order = otherwise.copy(), np.lexsort((-s, i))
    i, s = i[order], s[order]
    last = _first(i, count) & ~_first(i, count - 1)
    out[i[last]] = np.maximum(out[i[last]], s[last])
    return out


def best_positives(anchors: Side, rows: Side, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row, score) of the ``count`` best other rows of the anchor's label."""
    queries, out = Queries(anchors), []
    for label in np.intersect1d(anchors.label, rows.label):
        a, b = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
        part = Side(rows.pdf.iloc[b], rows.dim)
        least = np.full(len(a), -np.inf)
        for some, cut in _tiles(len(a), len(b)):
            estimate, width = queries.intervals(a[some], part, cut)
            allowed = anchors.row[a[some], None] != part.row[None, cut]
            i, j = _nearest(estimate, np.full(len(some), np.inf), allowed)
            s = scores(anchors, a[some][i], part, j + cut.start)
            least[some] = _at_least(i, s, len(some), count, least[some])
            i, j = np.nonzero(allowed & (estimate + width >= least[some, None]))
            s = scores(anchors, a[some][i], part, j + cut.start)
            reached = s >= least[some[i]]
            i, j, s = _ordered(part, some[i[reached]], j[reached] + cut.start, s[reached])
            keep = _first(i, count)
            out.append((a[i[keep]], b[j[keep]], s[keep]))
    return _best_of(rows, out, count)


def _best_of(rows: Side, parts: list[tuple[np.ndarray, ...]], count: int) -> tuple[np.ndarray, ...]:
    """The ``count`` best of each anchor over the tiles."""
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    i, j, s = _ordered(rows, *(np.concatenate(x) for x in zip(*parts, strict=True)))
    keep = _first(i, count)
    return i[keep], j[keep], s[keep]


def best_negatives(anchors: Side, rows: Side, low: np.ndarray, high: np.ndarray, count: int) -> tuple[np.ndarray, ...]:
    """(anchor, range, row, score): the ``count`` best rows of other labels with scores in range ``k``, low[:, k] to high[:, k]."""
    queries, ranges = Queries(anchors), low.shape[1]
    least, found = low.astype(np.float64), [[] for _ in range(ranges)]
    for some, cut in _tiles(len(anchors.row), len(rows.row)):
        estimate, width = queries.intervals(some, rows, cut)
        allowed = anchors.label[some, None] != rows.label[None, cut]
        with np.errstate(divide="ignore", invalid="ignore"):  # the estimate is short by the share of the alignment
            likely = np.nan_to_num(estimate * (rows.length[cut] / rows.along[cut]) ** 2)
        top = high[some].astype(np.float64)
        for k in range(ranges):
            i, j = _nearest(likely, top[:, k], allowed & (top[:, k] >= low[some, k])[:, None])
            s = scores(anchors, some[i], rows, j + cut.start)
            fits = (s >= low[some[i], k]) & (s <= high[some[i], k])
            least[some, k] = _at_least(i[fits], s[fits], len(some), count, least[some, k])
        real = top >= low[some]
        bottom = np.where(real, least[some], np.inf).min(axis=1)
        top = np.where(real, top, -np.inf).max(axis=1)
        i, j = np.nonzero(allowed & (estimate + width >= bottom[:, None]) & (estimate - width <= top[:, None]))
        s = scores(anchors, some[i], rows, j + cut.start)
        reached = (s >= bottom[i]) & (s <= top[i])
        i, j, s = _ordered(rows, some[i[reached]], j[reached] + cut.start, s[reached])
        for k in range(ranges):
            fits = (s >= low[i, k]) & (s <= high[i, k])
            x, y, z = i[fits], j[fits], s[fits]
            keep = _first(x, count)
            found[k].append((x[keep], y[keep], z[keep]))
    merged = [_best_of(rows, parts, count) for parts in found]
    which = np.repeat(np.arange(ranges), [len(x[0]) for x in merged])
    i, j, s = (np.concatenate([x[c] for x in merged]) if merged else np.zeros(0, np.int64) for c in range(3))
    return i, which, j, s


def _sides(rows: pd.DataFrame, anchors: pd.DataFrame) -> Iterator[tuple[Side, Side]]:
    if not len(rows) or not len(anchors):  # a block that one side does not reach
        return
    for dim in np.intersect1d(rows["dim"], anchors["dim"]).tolist():
        yield Side(anchors[anchors["dim"] == dim].reset_index(drop=True), dim), Side(rows[rows["dim"] == dim].reset_index(drop=True), dim)


def _ids(side: Side, at: np.ndarray) -> pd.array:
    return pd.arrays.IntegerArray(side.id[at], ~side.known[at])


# ---- Spark --------------------------------------------------------------------------------------------------

def _in_blocks(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, compare, ddl: str) -> DataFrame:
    """``compare(rows, anchors)`` for every pair of blocks."""
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("x", deal(row_blocks)).withColumn("y", every(anchor_blocks))
    right = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))  # both sides may come from one table: fresh columns
    right = right.withColumn("y", deal(anchor_blocks)).withColumn("x", every(row_blocks))
    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(compare, ddl)


POSITIVE_DDL = "anchor long, anchor_id long, positive_id long, positive_row long, positive_score long"
NEGATIVE_DDL = "anchor long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_row long, negative_score long"


def mined(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100),
          high: tuple[int, int] = (95, 100), scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label",
          vector_col: str = "embedding", row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``.  A negative's score lies between ``low`` and ``high`` (numerator,
    denominator) of the positive's."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                          F.col(label_col).cast("long").alias("label"), vector.alias("vector"))
    good = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = stored(coded(rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & good), scale), "codes")
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False)))
    n, m = rows.count(), anchors.count()
    row_blocks = max(1, -(-n // row_block), min(2 * default_parallelism(vectors.sparkSession), n // 1024))
    anchor_blocks = max(1, -(-m // anchor_block))

    def near(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor": a.row[i], "anchor_id": a.id[i], "positive_id": _ids(b, j), "positive_row": b.row[j], "positive_score": s})
               for a, b in _sides(rows, anchors) for i, j, s in [best_positives(a, b, positives)]]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["anchor", "anchor_id", "positive_id", "positive_row", "positive_score"])

    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.col("positive_id").asc_nulls_last(), "positive_row")
    first = _in_blocks(rows, anchors, row_blocks, anchor_blocks, near, POSITIVE_DDL).withColumn("place", F.row_number().over(best))
    first = first.where(F.col("place") <= positives).groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("list"))
    asked = stored(anchors.join(first.select(F.col("anchor").alias("row"), F.col("list.positive_id").alias("positive_ids"),
                                             F.col("list.positive_score").alias("positive_scores")), "row"), "positives")

    def far(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, b in _sides(rows, anchors):
            own = a.pdf["positive_scores"].map(list).tolist()
            width = max(map(len, own))
            bound = lambda f, empty: np.array([[f(int(s)) for s in x] + [empty] * (width - len(x)) for x in own], np.int64)
            lows = bound(lambda s: -(-s * low[0] // low[1]), 1)  # noqa: B023
            highs = bound(lambda s: s * high[0] // high[1], 0)   # noqa: B023
            i, k, j, s = best_negatives(a, b, lows, highs, negatives)
            names = [list(x) for x in a.pdf["positive_ids"]]
            out.append(pd.DataFrame({"anchor": a.row[i], "anchor_id": a.id[i], "place": k,
                                     "positive_id": pd.array([names[x][y] for x, y in zip(i, k, strict=True)], "Int64"),
                                     "positive_score": np.array([own[x][y] for x, y in zip(i, k, strict=True)], np.int64),
                                     "negative_id": _ids(b, j), "negative_row": b.row[j], "negative_score": s}))
        names = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_row", "negative_score"]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    ranked = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last(), "negative_row")
    last = _in_blocks(rows, asked, row_blocks, anchor_blocks, far, NEGATIVE_DDL).withColumn("rank", F.row_number().over(ranked))
    return last.where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def sql() -> str:
    """The query over ``embeddings`` in SQL: every anchor against every row."""
    return """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS place
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 100 * n.score BETWEEN 50 * p.score AND 95 * p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS "rank", negative_id, positive_score, negative_score
FROM negatives WHERE place <= 3"""
