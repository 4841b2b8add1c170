"""Periodic run detection: repeated stretches of words, and texts with one period of each left.

A run is a stretch of words with smallest period q and at least MIN_TIMES * q and MIN_WORDS words that no neighbouring word extends.
Texts are taken in blocks of some BLOCK words, each text whole. A block has one suffix array over its texts (suffixes of one
text stand together, since the text is the first key of the order), the lengths of common beginnings of neighbours in it, and
a table of minima over them (RMQ), and all of these once more for the reversed texts. For each period p the words jp and
(j + 1)p of a text are compared: where they are equal, the longest common extension (LCE) forward and backward bounds the
stretch of period p around them. Every run of period p has such a pair, so none is missed; a text of n words
has about n ln(n / MIN_TIMES) of them. Stretches found for several pairs, or for multiples of a period, are one run of the
smallest.

Nulls and texts without words have no runs and an empty text. Repeated rows count each; a run never passes from one text to
the next. A text is never cut: a task holds some 8 * log2(n) bytes for each of the n words of a block, and a block is longer than BLOCK words only if
one text is. An empty table gives an empty result. Columns of docs that `keep` names are carried; ones named as a result column give way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, with_fields

MIN_WORDS, MIN_TIMES = 6, 4
BLOCK = 1 << 17
#: Pairs of grid points that are compared at once.
PAIRS = 1 << 20
RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Extensions:
    """LCE of two places of one text, for texts laid end to end: codes are words, ends[i] is the end of the text of place i."""

    def __init__(self, codes: np.ndarray, text: np.ndarray, ends: np.ndarray):
        n = len(codes)
        # ranks[k]: classes of places by text and their first 2^k words, an end being less than any word
        key = text * (int(codes.max()) + 1) + codes
        order = np.argsort(key)
        ranks = [self.classes(order, key[order])]
        open_ = self.shared(ranks[0], order)
        while len(open_):
            k = 1 << (len(ranks) - 1)
            old = ranks[-1]
            # the first 2^k words are equal in these places, so none of them reaches beyond its text's end
            follow = np.where(open_ + k < ends[open_], old[np.minimum(open_ + k, n - 1)], -1)
            by = np.argsort(old[open_].astype(np.int64) * (n + 1) + follow)
            place, follow = open_[by], follow[by]
            head = old[place]
            first = np.r_[True, head[1:] != head[:-1]]
            fresh = first | np.r_[True, follow[1:] != follow[:-1]]
            at = np.arange(len(place))
            start = np.maximum.accumulate(np.where(first, at, 0))
            new = old.copy()
            new[place] = head + (np.maximum.accumulate(np.where(fresh, at, 0)) - start).astype(np.int32)
            ranks.append(new)
            same = ~fresh
            open_ = place[same | np.r_[same[1:], False]]
        self.rank = ranks[-1]
        suffixes = np.empty(n, np.int32)
        suffixes[self.rank] = np.arange(n, dtype=np.int32)
        self.table = self.minima(self.neighbours(ranks, suffixes, text, ends))

    @staticmethod
    def classes(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The place in the order at which each element's class begins, by the keys in order."""
        fresh = np.r_[True, keys[1:] != keys[:-1]]
        out = np.empty(len(order), np.int32)
        out[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        return out

    @staticmethod
    def shared(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The places whose class has another member, in order."""
        r = rank[order]
        same = r[1:] == r[:-1]
        return order[np.r_[False, same] | np.r_[same, False]]

    @staticmethod
    def neighbours(ranks: list[np.ndarray], suffixes: np.ndarray, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Common beginning of each suffix with the one before it in order; 0 at a text's first."""
        n = len(suffixes)
        out = np.zeros(n, np.int32)
        at = np.arange(1, n)
        at = at[text[suffixes[1:]] == text[suffixes[:-1]]]
        a, b = suffixes[at - 1], suffixes[at]
        for k in range(len(ranks) - 1, -1, -1):
            inside = (a < ends[suffixes[at]]) & (b < ends[suffixes[at]])
            equal = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
            step = equal.astype(np.int32) << k
            out[at] += step
            a, b = a + step, b + step
        return out

    @staticmethod
    def minima(lcp: np.ndarray) -> list[np.ndarray]:
        """table[k][i]: the least of lcp[i : i + 2^k], as far as any common beginning asks (a range never leaves a text)."""
        table = [lcp]
        while len(table[-1]) > 1 << (len(table) - 1) and table[-1].any():
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on are equal; a and b differ and are of one text."""
        left, right = self.rank[a], self.rank[b]
        left, right = np.minimum(left, right) + 1, np.maximum(left, right) + 1
        level = np.log2(right - left).astype(np.int64)
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            if k < len(self.table):  # a wider range than any in the table has a 0 in it
                here = level == k
                out[here] = np.minimum(self.table[k][left[here]], self.table[k][right[here] - (1 << k)])
        return out


def grid(starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray):
    """Arrays (text, period, a) of places a = jp of texts whose word equals that at a + p, for all periods that a run can have, PAIRS at a time."""
    most = sizes // MIN_TIMES
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (sizes[text] - 1) // period
    part = np.cumsum(points) // PAIRS
    for k in np.unique(part):
        t, p, m = text[part == k], period[part == k], points[part == k]
        p_all = np.repeat(p, m)
        j = np.arange(len(p_all)) - np.repeat(np.cumsum(m) - m, m)
        a = np.repeat(starts[t], m) + j * p_all
        same = np.flatnonzero(codes[a] == codes[a + p_all])
        yield np.repeat(t, m)[same], p_all[same], a[same]


def runs_of(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start in the text, length, period) of the runs of texts with these sizes, laid end to end, in order."""
    n, starts = len(codes), np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(starts + sizes, sizes)
    found, forward, backward = [np.zeros((4, 0), np.int64)], None, None
    for t, p, a in grid(starts, sizes, codes):
        if not len(a):
            continue
        if forward is None:
            forward = Extensions(codes, text, ends)
            mirror = np.cumsum(sizes[::-1]) - sizes[::-1]
            backward = Extensions(codes[::-1].copy(), text[::-1].max() - text[::-1], np.repeat(mirror + sizes[::-1], sizes[::-1]))
        after = forward.lce(a, a + p)
        before = backward.lce(n - 1 - a, n - 1 - a - p) - 1  # the pair itself is counted on both sides
        length = before + after + p
        long = length >= np.maximum(MIN_WORDS, MIN_TIMES * p)
        found.append(np.stack([t[long], (a - before)[long] - starts[t[long]], length[long], p[long]]))
    rows = np.unique(np.concatenate(found, 1).T, axis=0)  # in order of text, start, length and period
    # one stretch has one smallest period, the first of its rows
    return rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)][: len(rows)]]


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Which of a text's words stay: those that no run holds after its first period."""
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, runs[:, 1] + runs[:, 3], 1)
    np.add.at(depth, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(depth[:-1]) == 0


def block_results(texts: list[list[bytes]]) -> list[tuple[int, list, str]]:
    """n_words, runs and the collapsed text of each of these lists of words."""
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for words in texts for w in words], np.int32)
    sizes = np.array([len(words) for words in texts], np.int64)
    rows = runs_of(codes, sizes) if len(codes) else np.zeros((0, 4), np.int64)
    bounds = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    out = []
    for words, low, high in zip(texts, bounds, bounds[1:]):
        runs = rows[low:high]
        # by start, then period: of two runs that start together the shorter one has the smaller period
        runs = runs[np.lexsort((runs[:, 3], runs[:, 1]))]
        left = words if low == high else [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
        out.append((len(words), [{"start": s, "length": n, "period": p} for _, s, n, p in runs.tolist()], b" ".join(left).decode()))
    return out


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), edit: Callable[[object, list[bytes]], list[bytes]] | None = None, edit_by: str = "doc_id") -> DataFrame:
    """keep, n_words, runs (start, length and period in words, by start and period) and collapsed of each row of docs (text).

    `edit`, if any, gives the words of a text in place of its own, from its column edit_by and its words.
    """
    keep = tuple(c for c in keep if c not in ("n_words", "runs", "collapsed"))
    extra = [F.col(edit_by).alias("__by")] if edit else []
    chosen = docs.select(*keep, *extra, F.col("text").alias("__text"))
    fields = with_fields(chosen.schema.fields[: len(keep)], RESULT)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            by = batch.column(len(keep)) if edit else texts
            words, size, done = [], 0, 0
            for k in range(len(texts)):
                one = (texts[k].as_py() or b"").split()  # bytes split at the six blanks only
                words.append(edit(by[k].as_py(), one) if edit else one)
                size += len(one)
                if size >= BLOCK or k == len(texts) - 1:
                    n, runs, left = zip(*block_results(words))
                    kept = [c.slice(done, len(words)) for c in batch.columns[: len(keep)]]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(runs, RUN), pa.array(left, pa.string())], names=[*keep, "n_words", "runs", "collapsed"])
                    words, size, done = [], 0, k + 1
        give_back()

    return chosen.mapInArrow(run, fields)


def longest() -> Column:
    """The longest of `runs`; of equally long ones the first, then the one of the smaller period. Null if there is none."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["n"].alias("length"), (-best["p"]).alias("period")))


def runs_digest() -> Column:
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return F.sha2(F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n")))), 256)
