"""Toxicity: a convolutional text classifier with hashed word embeddings, trained in numpy.

Words are lower-cased and stripped of punctuation; a word and its beginnings of PREFIXES letters are hashed into
BUCKETS, and the sum of their vectors is the word's embedding, so that inflected forms are alike and a chance collision
of one hash counts little. Filters of WIDTHS words slide over a text's embeddings, the maximum of each filter over the
whole text goes through a rectifier into a logistic unit. Filters and embeddings are learned by Adam steps on at most SAMPLE labelled rows outside the held-out fold; the first coordinate of
an embedding starts as how much more often its bucket occurs in toxic rows. A part of the sample is left out of the
steps: there the score is shifted so that 0.7 separates best, and each language gets its own
threshold, shrunk to the common one by how few rows speak for it.
The score itself knows no language. To score, each filter's answer to each bucket is a table, summed once for each distinct
word of a batch; then a text is a few look-ups and additions a word.

Nulls: a null text is empty; a null language has the common threshold; null labels are not learned from; without labels
of both kinds every score is 0. Repeated rows are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, held_out, rank_in_crc, with_fields, written
from .quality_gam import labelled_sample
from .tokens import slices

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
OUTPUTS = ("held_out", "score", "predicted", "threshold", "flagged")
SAMPLE, STEPS, BATCH, RATE, CUT = 6000, 500, 64, 0.02, 0.7
#: Longer texts are scored whole like all others, but not learned from (bounds what reaches the driver with SAMPLE).
LEARN_CHARS = 200_000
#: Characters of all texts that are learned from together, so that what reaches the driver is bounded however long they are.
FIT_CHARS = 48_000_000
#: Rows of the rarer kind at which a language's own threshold weighs as much as the common one, and the range of its own.
LANGUAGE_ROWS, LANGUAGE_RANGE = 30, (0.5, 0.9)
#: Stripped from the ends of words.
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_/\\"
PREFIXES = (3, 4, 5, 7)
#: The bucket of nothing: its vector is zero.
PAD = 0


def word_buckets(word: str) -> list[int]:
    """The buckets of a word and of its beginnings; PAD where it has none."""
    if not word:
        return [PAD] * (1 + len(PREFIXES))
    parts = [word, *(f"{k}{word[:k]}" if len(word) >= k else "" for k in PREFIXES)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1 if x else PAD for x in parts]


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of the distinct words (the first row is PAD), for each word of all texts its row there, and where each text starts.

    Each text is followed by as many pads as a filter can reach over.
    """
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    for blank in "\n\t\r\v\f":
        texts = pc.replace_substring(texts, blank, " ")
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    words = pc.utf8_trim(coded.dictionary, characters=EDGES).to_pylist()
    buckets = np.array([word_buckets(""), *map(word_buckets, words)], np.uint16)
    codes = coded.indices.to_numpy().astype(np.int32) + 1
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends[1:] - ends[0]
    pads = max(WIDTHS)
    codes = np.insert(codes, np.repeat(ends, pads), 0)
    return buckets, codes, np.concatenate([[0], ends[:-1] + pads * np.arange(1, len(ends))])


def last_pads(starts: np.ndarray, n: int) -> np.ndarray:
    """Places from which a filter would reach into the next text: each text's pads but the first."""
    ends = np.append(starts[1:], n)
    return (ends[:, None] - np.arange(1, max(WIDTHS))).ravel()


class Cnn:
    def __init__(self, texts: list[np.ndarray], y: np.ndarray, lang: list[str | None], seed: int = 7, start: bool = True):
        """texts: the buckets (a row a word, pads included) of each text; start: the first coordinate starts as a ratio of counts, else at random."""
        self.thresholds, self.shift, self.trained = {}, 0.0, False
        if not len(y) or y.min() == y.max():
            return
        rng = np.random.default_rng(seed)
        self.trained = True
        order = rng.permutation(len(y))
        out = order[: len(y) // 5]
        fit = order[len(y) // 5 :]
        if not len(out) or not 0 < y[fit].sum() < len(fit):
            out, fit = order, order
        rate = y[fit].mean()
        seen, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for i in fit.tolist():
            u = np.unique(texts[i])
            seen[u] += 1
            bad[u] += y[i]
        self.e = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        if start:
            self.e[:, 0] = np.clip((bad - rate * seen) / np.sqrt(rate * (1 - rate) * seen + 1), -4, 12) / 10
        self.e[PAD] = 0
        self.w = [rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        for w in self.w if start else ():
            w[:, 0, : FILTERS // 2] = np.abs(w[:, 0, : FILTERS // 2]) + 0.5
        self.b = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.v = np.full((len(WIDTHS), FILTERS), 0.1, np.float32)
        self.c = np.float32(np.log(rate / (1 - rate)))
        params = [self.e, *self.w, self.b, self.v]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        toxic, clean = fit[y[fit] > 0], fit[y[fit] == 0]
        bias = [0.0, 0.0]
        for step in range(1, STEPS + 1):
            half = BATCH // 4  # a quarter of a batch is toxic
            rows = np.concatenate([rng.choice(toxic, half), rng.choice(clean, BATCH - half)])
            ids = np.concatenate([texts[i] for i in rows])
            starts = np.cumsum([0] + [len(texts[i]) for i in rows[:-1]])
            top, at = self._pool(ids, starts)
            act = np.maximum(top + self.b, 0)
            logit = np.clip((act * self.v).sum((1, 2)) + self.c, -30, 30)
            weight = np.where(y[rows] > 0, rate / 0.25, (1 - rate) / 0.75) ** 0.5
            d = ((1 / (1 + np.exp(-logit)) - y[rows]) * weight / len(rows)).astype(np.float32)
            grads = [None, *[np.zeros_like(w) for w in self.w], None, (d[:, None, None] * act).sum(0)]
            da = d[:, None, None] * self.v * (act > 0)
            grads[-2] = da.sum(0)
            touched, ge = [], []
            for j, k in enumerate(WIDTHS):
                for q in range(k):
                    words = ids[np.minimum(at[:, j] + q, len(ids) - 1)]  # (rows, FILTERS, buckets of a word)
                    grads[1 + j][q] = np.einsum("rf,rfd->df", da[:, j], self.e[words].sum(2))
                    touched.append(words.ravel())
                    ge.append(np.repeat(np.einsum("rf,df->rfd", da[:, j], self.w[j][q]).reshape(-1, DIM), words.shape[2], 0))
            touched, ge = np.concatenate(touched), np.concatenate(ge)
            rows_of, back = np.unique(touched, return_inverse=True)
            sums = np.zeros((len(rows_of), DIM), np.float32)
            np.add.at(sums, back, ge)
            lr = RATE * (1 - step / (STEPS + 1))
            for p, g, (m, s) in zip(params[1:], grads[1:], moments[1:], strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6) + lr * 1e-3 * p
            m, s = moments[0]
            m[rows_of] += 0.1 * (sums - m[rows_of])
            s[rows_of] += 0.01 * (sums * sums - s[rows_of])
            self.e[rows_of] -= 0.3 * lr * m[rows_of] / (np.sqrt(s[rows_of]) + 1e-5)
            self.e[PAD] = 0
            bias[0] += 0.1 * (d.sum() - bias[0])
            bias[1] += 0.01 * (d.sum() ** 2 - bias[1])
            self.c -= np.float32(lr * bias[0] / (bias[1] ** 0.5 + 1e-6))
        self.tables = self._tables()
        self._calibrate([texts[i] for i in out], y[out], [lang[i] for i in out])
        self.e = self.w = None  # the tables are enough

    def _tables(self):
        return [[(self.e @ w[q]).astype(np.float32) for q in range(len(w))] for w in self.w]

    def _pool(self, ids, starts):
        """The maximum of each filter over each text, and where it is."""
        tops, ats, e = [], [], self.e[ids].sum(1)
        for w in self.w:
            r = e @ w[0]
            for q in range(1, len(w)):
                r[:-q] += e[q:] @ w[q]
            r[last_pads(starts, len(r))] = -np.inf
            top = np.maximum.reduceat(r, starts, axis=0)
            sizes = np.diff(np.append(starts, len(ids)))
            is_top = r == np.repeat(top, sizes, axis=0)
            at = np.empty(top.shape, np.int64)
            for f in range(r.shape[1]):  # the first place of the maximum in each text
                k = np.flatnonzero(is_top[:, f])
                at[:, f] = k[np.searchsorted(k, starts)]
            tops.append(top)
            ats.append(at)
        return np.stack(tops, 1), np.stack(ats, 1)

    def logits(self, buckets: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        tops = []
        for tables in self.tables:
            answers = [sum(table[buckets[:, k]] for k in range(buckets.shape[1])) for table in tables]
            r = answers[0][codes]
            for q in range(1, len(answers)):
                r[:-q] += answers[q][codes[q:]]
            r[last_pads(starts, len(r))] = -np.inf
            tops.append(np.maximum.reduceat(r, starts, axis=0))
        act = np.maximum(np.stack(tops, 1) + self.b, 0)
        return (act * self.v).sum((1, 2)).astype(float) + float(self.c) + self.shift

    def score(self, buckets: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not self.trained or not len(starts):
            return np.zeros(len(starts))
        return 1 / (1 + np.exp(-np.clip(self.logits(buckets, codes, starts), -40, 40)))

    def _calibrate(self, texts, y, lang):
        rows = np.concatenate(texts)
        z = self.logits(rows, np.arange(len(rows)), np.cumsum([0] + [len(t) for t in texts[:-1]]))
        edge = np.log(CUT / (1 - CUT))
        self.shift = edge - best_cut(z, y)
        p = 1 / (1 + np.exp(-(z + self.shift)))
        for name in {x for x in lang if x}:
            own = np.array([x == name for x in lang])
            rarer = min(y[own].sum(), own.sum() - y[own].sum())
            mine = float(np.clip(best_cut(p[own], y[own]), *LANGUAGE_RANGE)) if rarer else CUT
            self.thresholds[name] = (rarer * mine + LANGUAGE_ROWS * CUT) / (rarer + LANGUAGE_ROWS)


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap between scores among those where a cut makes the fewest errors; a missed row counts as one kept wrongly."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    ends = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gaps = np.diff(ends)
    good = np.flatnonzero((errors == errors[gaps > 0].min()) & (gaps > 0))
    k = good[np.argmax(gaps[good])]
    return float((ends[k] + ends[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE, chars: int = FIT_CHARS) -> Cnn:
    """At most `rows` labels, and the buckets of their texts of up to LEARN_CHARS characters, FIT_CHARS together, reach the driver: by a hash of doc_id, as many as fit.

    Of different texts under one doc_id the one with the least hash is learned from, once for each of its labels.
    """
    sample = F.broadcast(labelled_sample(labels, label, rows))  # `rows` rows of two numbers
    mine = docs.select("doc_id", F.col("lang").cast("string").alias("l"), "text").where(F.length(F.coalesce("text", F.lit(""))) <= LEARN_CHARS)
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "l", "text")).alias("m")
    chosen = mine.join(sample, F.col("doc_id") == F.col("id")).groupBy("doc_id", "y").agg(least).select("doc_id", "y", "m.l", "m.text")
    chosen = written(chosen, "toxic-sample")
    # sums over `rows` rows of numbers, not of texts
    so_far = F.sum("n").over(Window.orderBy(rank_in_crc("doc_id"), "doc_id", "y").rowsBetween(Window.unboundedPreceding, 0))
    fits = chosen.select("doc_id", "y", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).select("doc_id", "y", so_far.alias("sum")).where(F.col("sum") <= chars).select("doc_id", "y")
    chosen = chosen.join(F.broadcast(fits), ["doc_id", "y"]).select("doc_id", "y", "l", "text")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                buckets, codes, starts = coded_words(batch.column(3))
                data = [buckets[x].astype("<u2").tobytes() for x in np.split(codes, starts[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], names=["doc_id", "y", "l", "ids"])

    got = chosen.mapInArrow(run, "doc_id long, y int, l string, ids binary").toArrow()
    got = got.take(pc.sort_indices(got, sort_keys=[("doc_id", "ascending"), ("y", "ascending"), ("ids", "ascending")]))
    texts = [np.frombuffer(x.as_buffer(), "<u2").reshape(-1, 1 + len(PREFIXES)) for x in got.column("ids")]
    return Cnn(texts, got.column("y").to_numpy().astype(float), got.column("l").to_pylist())


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, held_out, score, predicted (score >= 0.7), threshold (its language's) and flagged (score >= threshold) of each row of docs (doc_id, text, lang); kept columns named like these give way."""
    keep = [c for c in dict.fromkeys(keep) if c not in OUTPUTS]
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # the tables: BUCKETS x FILTERS x 6 numbers, whatever the corpus
    own = "text" in keep  # then it goes to the worker once
    chosen = docs.select(*keep, held_out().alias("held_out"), F.col("lang").cast("string").alias("__lang"), *([] if own else [F.col("text").alias("__text")]))
    kept = [*keep, "held_out"]
    fields = with_fields(chosen.schema.fields[: len(kept)], "score double, predicted int, threshold double, flagged boolean")
    at, lang, text = (keep.index("text") if own else len(kept) + 1), len(kept), "text" if own else "__text"

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, 2 << 20):
                score = model.value.score(*coded_words(batch.column(at)))
                limit = np.array([model.value.thresholds.get(x, CUT) for x in batch.column(lang).to_pylist()])
                cells = [pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(limit), pa.array(score >= limit)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *cells], names=[*kept, "score", "predicted", "threshold", "flagged"])
        give_back()

    return chosen.mapInArrow(run, fields)
