"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a few numbers (``FEATURES``), each cut into bins.  Boosting goes through the features in a cycle; in
each step a shallow tree over one feature's bins, fitted to the gradient, is added to that feature's lookup table.
Then the pairs of features with the largest remaining gain get tables of their own in the same way.  A score is the
sum of table entries, passed through the logistic function: vectorised bin additions, no tree is kept.

The model is fitted on at most ``SAMPLE`` labelled rows, chosen by hash; every whole text is scored, in one pass
without a shuffle.

Defined results: null and empty texts have all features 0 and get a score as any other; rows without a label and
null labels are not learnt from; a doc with several labels counts with each; without labels of both kinds every score
is the share of label 1 (0.5 without any); an empty table gives no rows; columns other than the id and the text are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from obslytics.llm import words as W

#: labelled rows that the model is fitted on at most
SAMPLE = 20_000
FEATURES = ("log_words", "mean_word_bytes", "upper", "digit", "stop", "symbol", "bar", "beyond_ascii", "distinct_words", "repeated_neighbours",
            "commonest_word", "log_lines", "words_in_line", "repeated_lines", "words_in_sentence")

_CLASSES = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 stop and comma, 4 symbol, 5 bar, 6 beyond ASCII
_CLASSES[65:91], _CLASSES[48:58], _CLASSES[128:] = 1, 2, 6
_CLASSES[[i for i in range(33, 127) if not chr(i).isalnum()]] = 4
_CLASSES[[ord(c) for c in ".,;:?'\"()-"]], _CLASSES[ord("|")] = 3, 5
_LINES = W.byte_table(b"\n")


def _share(hashes: np.ndarray) -> tuple[float, float]:
    """Distinct ones and the commonest one, as shares."""
    _, counts = np.unique(hashes, return_counts=True)
    return len(counts) / len(hashes), counts.max() / len(hashes)


def features(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    data, offsets = W.text_bytes(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for first, last in W.chunks(offsets):
        at = offsets[first: last + 1]
        hashes, word_at = W.words(data, at, W.SPACE_WORDS)
        lines, line_at = W.words(data, at, _LINES)
        kinds = _CLASSES[data[at[0]: at[-1]]]
        equal = np.append(False, hashes[1:] == hashes[:-1]) if len(hashes) else np.zeros(0, bool)
        sums = [np.diff(np.append(0, np.cumsum(kinds == k))[at - at[0]]) for k in range(1, 7)]
        full = np.diff(np.append(0, np.cumsum(data[at[0]: at[-1]] == ord(".")))[at - at[0]])
        for i in range(last - first):
            n_bytes, n_words, n_lines = int(at[i + 1] - at[i]), int(word_at[i + 1] - word_at[i]), int(line_at[i + 1] - line_at[i])
            if not n_words:
                continue
            own = hashes[word_at[i]: word_at[i + 1]]
            distinct, commonest = _share(own)
            repeated = int(equal[word_at[i] + 1: word_at[i + 1]].sum())
            out[first + i] = (np.log1p(n_words), n_bytes / n_words, *(s[i] / n_bytes for s in sums), distinct, repeated / n_words, commonest,
                              np.log1p(n_lines), n_words / max(1, n_lines), 1 - _share(lines[line_at[i]: line_at[i + 1]])[0] if n_lines else 0,
                              n_words / (1 + int(full[i])))
    return out


# ---- the model ----------------------------------------------------------------------------------------------

@dataclass
class Additive:
    """Lookup tables of an additive model; ``score`` adds the entries that the bins of a row name."""

    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for f, table in enumerate(self.tables):
            out += table[bins[:, f]]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[bins[:, f], bins[:, g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(x)), -35, 35)))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """Newton steps of a tree over ordered bins with the sums of gradient ``g`` and curvature ``h``."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h, ridge) + _gain(g.sum() - left_g, h.sum() - left_h, ridge) - _gain(g.sum(), h.sum(), ridge)
        gain[(left_h < least) | (h.sum() - left_h < least)] = 0
        cut = int(gain.argmax())
        if gain[cut] > 1e-9:
            return np.concatenate([shallow_tree(g[:cut + 1], h[:cut + 1], depth - 1, ridge, least), shallow_tree(g[cut + 1:], h[cut + 1:], depth - 1, ridge, least)])
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, float]:
    """The best cut on one axis with a cut on the other axis on either side, and its gain."""
    best, found = np.zeros_like(g), 0.0
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(a)):
            step, gain = np.empty_like(a), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                pg, ph = a[part].sum(0), b[part].sum(0)
                tree = shallow_tree(pg, ph, 1, ridge, least)
                step[part] = tree
                gain += float((2 * tree * pg - tree * tree * (ph + ridge / len(ph))).sum())
            if gain > found:
                best, found = (step.T if flip else step).copy(), gain
    return best, found


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.15, depth: int = 2, n_pairs: int = 4,
        pair_rounds: int = 30, ridge: float = 1.0, least: float = 1.0) -> Additive:
    """Cyclic boosting of one-feature tables, then of the pairs with the largest gain on what is left."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    model = Additive(edges, tables=[np.zeros(len(e) + 1) for e in edges])
    share = float(y.mean()) if len(y) else 0.5
    if not 0 < share < 1:
        model.base = 35.0 * (2 * share - 1) if len(y) else 0.0
        return model
    model.base = float(np.log(share / (1 - share)))
    at = model.bins(x)
    logit = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(at[:, f], g, len(table)), np.bincount(at[:, f], h, len(table)), depth, ridge, least)
            table += step
            logit += step[at[:, f]]

    def squares(f, g_, h_):
        a, b = f
        shape = len(model.tables[a]), len(model.tables[b])
        index = at[:, a] * shape[1] + at[:, b]
        return np.bincount(index, g_, shape[0] * shape[1]).reshape(shape), np.bincount(index, h_, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda f: -pair_tree(*squares(f, g, h), ridge, least)[1])
    model.pairs = ranked[:n_pairs]
    model.pair_tables = [np.zeros((len(model.tables[a]), len(model.tables[b]))) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for f, table in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * pair_tree(*squares(f, *slopes()), ridge, least)[0]
            table += step
            logit += step[at[:, f[0]], at[:, f[1]]]
    return model


# ---- on Spark -----------------------------------------------------------------------------------------------

def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def labelled_features(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
                      label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` rows whose remainder is not 2, in the order of ids."""
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
              .where(remainder(F.col("id")) != 2).orderBy(F.xxhash64(F.lit(3), "id"), "id", "label").limit(sample))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")

    def measure(batches):
        for batch in batches:
            found = features(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(list(found), pa.list_(pa.float64()))],
                                             names=["id", "label", "x"])

    got = rows.mapInArrow(measure, "id long, label int, x array<double>").orderBy("id", "label", "x").limit(4 * sample).toPandas()
    x = np.array([np.asarray(v) for v in got["x"]]).reshape(-1, len(FEATURES))
    return x, got["label"].to_numpy(np.float64)


def scored(docs: DataFrame, model: Additive, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of every row, and ``score``."""
    kinds = StructType([*(docs.schema[c] for c in keep), StructField("quality_score", DoubleType())])

    def add(batches):
        for batch in batches:
            score = model.score(features(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(score)], names=[*keep, "quality_score"])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias("text_to_score")).mapInArrow(add, kinds)


def learnt(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    return fit(*labelled_features(docs, labels, sample))
