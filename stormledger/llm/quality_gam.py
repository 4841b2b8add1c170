"""Quality classifier: a generalised additive model with pairwise interactions (lookup tables from cyclic boosted trees).

Each text gives the features in FEATURES. Every feature is cut into bins at quantiles of the training rows; round after
round, each feature in turn gets a tree of depth two on the gradient sums of its bins, whose leaves are added to the
feature's lookup table at a small rate. The strongest pairs of features then get tables of their own in the same way. A
score is the sum of a text's bins, taken by vectorised additions, through the logistic function.

Learned from at most SAMPLE labelled rows outside the held-out fold, in a fixed pseudo-random order. Nulls: a null text
is an empty one; null labels are not learned from; without labels every score is 0.5. Repeated rows are scored each, and
repeated labels count once. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, held_out, rank_in_crc, with_fields, written
from .host_rules import text_counts

FEATURES = ("words", "word_length", "symbols", "upper", "distinct", "repeated", "dup_lines", "ended_lines", "line_words", "digits", "other_chars", "longest", "top_word", "bars", "stops")
OUTPUTS = ("held_out", "score", "predicted")
SAMPLE, BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 20_000, 32, 8, 8, 120, 40, 0.15, 1.0


def text_features(text: str | None) -> list[float]:
    """FEATURES of one text: ratios and logarithms, so that long and short texts compare."""
    n, chars, symbols, dup_lines, repeated = text_counts(text)
    if not n:
        return [0.0] * len(FEATURES)
    words = text.split()
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    ascii_ = text.encode("utf-8", "surrogatepass")
    upper = len(ascii_) - len(ascii_.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(ascii_) - len(ascii_.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    digits = len(ascii_) - len(ascii_.translate(None, b"0123456789"))
    marks = len(ascii_) - len(ascii_.translate(None, b"!?;:=+_~^@/\\[]{}()-\"'`"))
    lines = [x for x in text.split("\n") if x.strip()]
    ended = sum(x.rstrip()[-1] in ".!?\"" for x in lines)
    stops = text.count(".") + text.count(",")
    k = len(words) or 1
    return [np.log1p(n), chars / n, symbols / n, upper / (upper + lower + 1), len(counts) / k, repeated / n, dup_lines / len(lines), ended / len(lines), np.log1p(n / len(lines)), digits / chars, marks / n, np.log1p(max(map(len, counts), default=0)), max(counts.values(), default=0) / k, text.count("|") / n, stops / n]


def with_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and `features` of each row of docs (text); a kept column of that name gives way to it."""
    keep = [c for c in keep if c != "features"]
    own = "text" in keep  # then it goes to the worker once
    chosen = docs.select(*keep) if own else docs.select(*keep, F.col("text").alias("__text"))
    fields = with_fields(chosen.schema.fields[: len(keep)], "features array<double>")
    at = keep.index("text") if own else len(keep)

    def run(batches):
        for batch in batches:
            got = [text_features(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(got, pa.list_(pa.float64()))], names=[*keep, "features"])
        give_back()

    return chosen.mapInArrow(run, fields)


def tree_1d(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a regression tree on gradient sums g and curvature sums h of ordered bins."""
    total = (g.sum(), h.sum())
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a**2 / (b + RIDGE) + (total[0] - a) ** 2 / (total[1] - b + RIDGE)
        k = int(np.argmax(gain)) + 1
        if gain[k - 1] > total[0] ** 2 / (total[1] + RIDGE) + 1e-9:
            return np.concatenate([tree_1d(g[:k], h[:k], depth - 1), tree_1d(g[k:], h[k:], depth - 1)])
    return np.full(len(g), -total[0] / (total[1] + RIDGE))


def tree_2d(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The same on a square of bins: a cut along one axis, then one along the other in each part; also its gain."""
    best, gain_of = np.zeros_like(g), -1.0
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(a)):
            rows = []
            for part in (slice(0, cut), slice(cut, None)):
                rows.append(tree_1d(a[part].sum(0), b[part].sum(0), 1))
            leaf = np.concatenate([np.repeat(rows[0][None], cut, 0), np.repeat(rows[1][None], len(a) - cut, 0)])
            gain = float(-(2 * leaf * a + leaf**2 * (b + 1e-12)).sum())
            if gain > gain_of:
                best, gain_of = leaf.T if flip else leaf, gain
    return best, gain_of


class Gam:
    """Lookup tables: per feature `cuts` and `tables`, per pair (i, j) `pair_cuts` of the features and `pair_tables`."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n = len(y)
        self.base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else 0.0
        x = x.reshape(n, -1) if n else np.zeros((0, 0))
        features = x.shape[1] if n else 0
        quantiles = lambda k: [np.unique(np.quantile(x[:, f], np.linspace(0, 1, k + 1)[1:-1])) for f in range(features)]
        self.cuts, self.pair_cuts = quantiles(BINS), quantiles(PAIR_BINS)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs, self.pair_tables = [], []
        if n < 10 or y.min() == y.max():
            return
        bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]
        score = np.full(n, self.base)

        def slopes():
            p = 1 / (1 + np.exp(-score))
            return p - y, p * (1 - p)

        for _ in range(ROUNDS):
            for f, at in enumerate(bins):
                g, h = slopes()
                m = len(self.tables[f])
                step = RATE * tree_1d(np.bincount(at, g, m), np.bincount(at, h, m))
                self.tables[f] += step
                score += step[at]
        coarse = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.pair_cuts)]

        def square(i, j, values):
            return np.bincount(coarse[i] * PAIR_BINS + coarse[j], values, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

        g, h = slopes()
        gains = {(i, j): tree_2d(square(i, j, g), square(i, j, h))[1] for i, j in combinations(range(features), 2)}
        self.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
        self.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for k, (i, j) in enumerate(self.pairs):
                g, h = slopes()
                step = RATE * tree_2d(square(i, j, g), square(i, j, h))[0]
                self.pair_tables[k] += step
                score += step[coarse[i], coarse[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of x."""
        total = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, f], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most rows (id, y) of labels outside the held-out fold: the first in a fixed pseudo-random order."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
    return chosen.orderBy(rank_in_crc("id"), "id", "y").limit(rows)


def fit(features: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE) -> Gam:
    """features (doc_id, features) and labels (doc_id, label): at most `rows` labels and their features reach the driver.

    Of different texts under one doc_id the one with the least features is learned from, once for each of its labels.
    """
    sample = F.broadcast(labelled_sample(labels, label, rows))  # `rows` rows of two numbers
    got = features.select("doc_id", "features").join(sample, F.col("doc_id") == F.col("id")).groupBy("doc_id", "y").agg(F.min("features").alias("features")).collect()
    got.sort()
    return Gam(np.array([r.features for r in got], float), np.array([r.y for r in got], float))


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, held_out, score and predicted of each row of docs (doc_id, text); kept columns named like these or `features` give way."""
    keep = [c for c in dict.fromkeys(keep) if c not in ("features", *OUTPUTS)]
    features = written(with_features(docs, tuple(dict.fromkeys(("doc_id", *keep)))), "features")
    model = docs.sparkSession.sparkContext.broadcast(fit(features, labels))  # a few tables of BINS numbers
    kept = features.select(*keep, held_out().alias("held_out"), "features")
    fields = with_fields(kept.schema.fields[:-1], "score double, predicted int")

    def run(batches):
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, len(FEATURES))
            score = model.value.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    return kept.mapInArrow(run, fields)
