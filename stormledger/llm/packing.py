"""Best-fit packing of token pieces into sequences of one capacity by repeated length patterns.

The plan needs only the histogram of piece lengths (at most `capacity` numbers). Patterns of two, three and four lengths
that fill a sequence exactly are enumerated, repeat counts are fitted to the histogram by non-negative least squares and
rounded down, and what is left of the histogram is packed best-fit decreasing, a whole class of equal sequences at a
time. So the plan's size follows the capacity, not the corpus. Each piece then finds its place by its rank among pieces
of its length; ranks are counted in buckets of doc_id, so that a length with a third of all rows is no single group.

Nulls: a null text is empty and gives one piece with the end id; a null doc_id is a row like any other. Repeated rows
are packed each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_u32, give_back, written
from .tokens import encoder_of, slices

CAPACITY = 2048
#: Patterns that are tried for each first length, steps of a least-squares fit, and fits at most, each of what the last one left.
PER_LENGTH, STEPS, REFITS = 6, 300, 6
#: Parts of the fitted counts that are tried.
SCALES = (1.0, 0.75, 0.5, 0.25)
#: Buckets of doc_id in which ranks are counted, at least.
BUCKETS = 64
#: Bytes of text that are encoded at a time, and distinct chunks that a worker remembers: what a worker needs beyond its batch follows both.
SLICE, KNOWN = 4 << 20, 300_000
#: The same where other stages share the executor: less memory for more CPU time.
SMALL = {"slice_bytes": 1 << 20, "known": 150_000}
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False, slice_bytes: int = SLICE, known: int = KNOWN) -> DataFrame:
    """docs (doc_id, text) as token pieces of at most capacity ids (blank-free tokenizer); with_ids keeps the ids."""

    def cut(encoder, batch):
        ids, n = encoder.encode(batch.column(1), end)
        per = -(-n // capacity)
        doc = np.repeat(np.arange(len(n)), per)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = piece * capacity
        length = np.minimum(capacity, n[doc] - start)
        ends = np.cumsum(length)
        parts = [ids[a:b] for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
        cells = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([crc32_u32(x) for x in parts], pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            cells, names = [*cells, pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(cells, names=names)

    def run(batches):
        encoder = encoder_of(tokenizer, False, known)
        for whole in batches:
            for batch in slices(whole, "text", slice_bytes):
                yield cut(encoder, batch)
            whole = batch = None  # not held while the next one is read, nor when memory is given back
        encoder.drop_pieces()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE + ", ids array<long>" * with_ids)


def patterns(hist: np.ndarray, per_length: int = PER_LENGTH) -> list[tuple[int, ...]]:
    """Exact fills of a sequence by two, three or four of the lengths that occur; hist[l] counts length l.

    For each length the most frequent partners are tried, and for two of them the third and fourth that complete the sum.
    """
    capacity = len(hist) - 1
    used = np.flatnonzero(hist)
    if len(used) == 0:
        return []
    common = used[np.argsort(-hist[used], kind="stable")][: 8 * per_length]
    found = {(capacity,)} if hist[capacity] else set()
    for a in used[used < capacity].tolist():
        if hist[capacity - a]:
            found.add(tuple(sorted((a, capacity - a))))
        # a third length from every range of lengths, so that small ones get used too
        step = np.linspace(1, max(capacity - a - 1, 1), 4 * per_length).astype(int)
        tried = np.unique(np.concatenate([common, step]))
        tried = tried[(tried < capacity - a) & (hist[tried] > 0)]
        third = capacity - a - tried
        good = hist[third] > 0
        score = np.minimum(hist[tried], hist[third])[good]
        for k in np.argsort(-score, kind="stable")[:per_length].tolist():
            found.add(tuple(sorted((a, int(tried[good][k]), int(third[good][k])))))
        for b in common[:per_length].tolist():
            for c in common[:2].tolist():
                d = capacity - a - b - c
                if d > 0 and hist[d]:
                    found.add(tuple(sorted((a, b, c, d))))
    return sorted(found)


def fit(pats: list[tuple[int, ...]], hist: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that makes |A x - hist| small, where A[l, p] is how often pattern p has length l: accelerated projected gradient."""
    width = max(map(len, pats))
    at = np.array([[*p, *[0] * (width - len(p))] for p in pats])  # row 0 takes the padding
    target = hist.astype(float)
    target[0] = 0

    def times(x):
        out = np.bincount(at.ravel(), np.repeat(x, width), minlength=len(hist))
        out[0] = 0
        return out

    degree = np.bincount(at.ravel(), minlength=len(hist)).astype(float)
    degree[0] = 0
    rate = 1 / np.maximum(degree[at].sum(1), 1)  # a step that is safe for each pattern on its own scale
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(steps):
        off = times(y) - target
        off[0] = 0
        new = np.maximum(0, y - rate * off[at].sum(1))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
    return x


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: sequences with equal contents are one class, split when a length runs out."""
    capacity = len(left) - 1
    by_room: list[list[list]] = [[] for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                k = capacity // length
                whole, rest = divmod(n, k)
                new = [((length,) * k, whole)] * bool(whole) + [((length,) * rest, 1)] * bool(rest)
                for content, m in new:
                    by_room[capacity - length * len(content)].append([content, m])
                    rooms[capacity - length * len(content)] = True
                break
            room = length + int(fits[0])
            content, m = by_room[room][-1]
            used = min(m, n)
            if used == m:
                by_room[room].pop()
                rooms[room] = bool(by_room[room])
            else:
                by_room[room][-1][1] = m - used
            by_room[room - length].append([(*content, length), used])
            rooms[room - length] = True
            n -= used
    return [(tuple(c), m) for classes in by_room for c, m in classes]


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Contents of sequences and how many have them; together they hold exactly hist.

    Fitted counts are rounded down at each of SCALES in turn, until a plan has no more sequences than the tokens need; of
    plans that all have more the smallest stays.
    """
    capacity = len(hist) - 1
    least, best = -(-int((hist * np.arange(capacity + 1)).sum()) // capacity), None
    for scale in SCALES:
        found = planned(hist, scale)
        if best is None or sum(m for _, m in found) < sum(m for _, m in best):
            best = found
        if sum(m for _, m in best) <= least:
            break
    return best


def planned(hist: np.ndarray, scale: float) -> list[tuple[tuple[int, ...], int]]:
    """Patterns by their fitted counts times scale, rounded down; what is left is fitted again, and at the end packed best-fit decreasing."""
    left, out = hist.copy(), []
    for _ in range(REFITS):
        pats = patterns(left)
        if not pats:
            break
        x, found = fit(pats, left) * scale, False
        for k in np.argsort(-x, kind="stable").tolist():
            lengths, times = np.unique(pats[k], return_counts=True)
            r = min(int(x[k]), int((left[lengths] // times).min()))
            if r > 0:
                left[lengths] -= r * times
                out.append((pats[k], r))
                found = True
        if not found:
            break
    return out + best_fit(left)


def segments(planned: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys length << 44 | first rank, and of each the first sequence and the offset."""
    keys, sequences, offsets, ranks, base = [], [], [], np.zeros(capacity + 1, np.int64), 0
    for content, m in planned:
        offset = 0
        for length in content:
            keys.append(length << 44 | int(ranks[length]))
            sequences.append(base)
            offsets.append(offset)
            ranks[length] += m
            offset += length
        base += m
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, sequences, offsets))


def ranked(pieces: DataFrame, buckets: int | None = None) -> DataFrame:
    """pieces with `rank` from 0 among those of their length: a rank in (length, bucket) after the counts of earlier buckets."""
    buckets = buckets or max(BUCKETS, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))  # buckets x capacity rows at most
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    inner = dealt.withColumn("own", F.row_number().over(own))
    return inner.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("bucket", "before", "own")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a written table) with sequence_id and offset."""
    rows = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # capacity rows at most
    hist = np.zeros(capacity + 1, np.int64)
    for r in rows:
        hist[r.length] = r.n
    shared = pieces.sparkSession.sparkContext.broadcast(segments(plan(hist), capacity))  # bounded by the capacity and PER_LENGTH

    def run(batches):
        keys, sequences, offsets = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            key = length << 44 | rank
            at = np.searchsorted(keys, key, side="right") - 1
            kept = [c for c in batch.schema.names if c != "rank"]
            cells = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])], names=[*kept, "sequence_id", "offset"])

    found = ranked(pieces)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "rank")
    return found.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, **bounds: int) -> DataFrame:
    """The pieces of docs and their places, as few sequences as the plan finds."""
    return pack(written(pieces_of(docs, tokenizer, capacity, with_ids=with_ids, **bounds), "pieces"), capacity)
