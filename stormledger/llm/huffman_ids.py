"""Token-ID / binary output: canonical length-limited Huffman coding of ids from global counts.

Files: a Parquet table of independent blocks. A block holds whole documents (a longer document is a block of its own):
its payload is the ids' codes as big-endian bits, `checkpoints` has the bit offset of every EVERY-th id, and doc_ids and
sizes list its documents in order. The code book is the code length of each id; the codes follow from it (canonical).

Nulls: a null text is empty (one end id). A null doc_id sorts first. Repeated rows are written each. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_u32, written
from .tokens import token_column

#: Longest code in bits; ids in a block, unless a document alone has more; ids between two checkpoints.
MAX_BITS, BLOCK, EVERY = 17, 1 << 18, 512
BLOCK_SCHEMA = "shard int, first long, doc_ids array<long>, sizes array<long>, n_ids long, checkpoints array<long>, payload binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError("max_bits is too small for so many symbols")
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    packages, is_leaf = np.zeros(0, np.int64), []
    for _ in range(max_bits):
        merged = np.concatenate([leaves, packages])
        at = np.argsort(merged, kind="stable")
        is_leaf.append(at < n)
        merged = merged[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, out = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(is_leaf):
        chosen = int(leaf[:take].sum())
        out[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[order] = out
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), as canonical Huffman codes are."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each window of as many bits as the longest code: id << 5 | length."""
    bits = int(lengths.max(initial=1))
    out = np.zeros(1 << bits, np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (bits - lengths[order].astype(np.int64))
    filled = np.repeat(order << 5 | lengths[order], spans)
    out[: len(filled)] = filled
    return out, bits


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
    """The bits of ids in big-endian 64-bit words, and the bit offset of every every-th id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    words = np.zeros((int(ends[-1]) if len(ids) else 0) // 64 + 2, np.uint64)
    room = 64 - (at & 63) - n  # bits left in the word after the code; negative: the code goes on in the next word
    code, over = codes[ids], room < 0
    first = np.where(over, code >> np.maximum(-room, 0).astype(np.uint64), code << np.maximum(room, 0).astype(np.uint64))
    word = at >> 6
    if len(ids):
        begins = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[begins]] = np.bitwise_or.reduceat(first, begins)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes(), at[::every]


def decode_blocks(payloads: list[bytes], n_ids: list[int], checkpoints: list[np.ndarray], table: np.ndarray, bits: int, every: int = EVERY) -> list[np.ndarray]:
    """The ids of each block: all stretches between checkpoints advance together, one id a step."""
    words = np.frombuffer(b"".join(payloads), ">u8").astype(np.uint64)
    base = np.cumsum([0, *map(len, payloads)])[:-1] * 8
    at = np.concatenate([np.asarray(c, np.int64) + b for c, b in zip(checkpoints, base, strict=True)] or [np.zeros(0, np.int64)])
    left = np.concatenate([np.minimum(every, n - every * np.arange(len(c))) for n, c in zip(n_ids, checkpoints, strict=True)] or [np.zeros(0, np.int64)])
    order = np.argsort(-left, kind="stable")
    at, alive = at[order], np.searchsorted(-left[order], -np.arange(every), side="left")  # how many stretches have a step-th id
    halves = np.empty(2 * len(words) + 2, np.uint64)
    halves[0:-2:2], halves[1:-2:2], halves[-2:] = words >> np.uint64(32), words & np.uint64(0xFFFFFFFF), 0
    windows = halves[:-1] << np.uint64(32) | halves[1:]
    out = np.empty((every, len(at)), np.uint32)
    mask, top = np.uint64((1 << bits) - 1), 64 - bits
    for step in range(every):
        if not (k := int(alive[step])):
            break
        p = at[:k]
        got = table[((windows[p >> 5] >> (top - (p & 31)).view(np.uint64)) & mask).view(np.int64)]
        out[step, :k] = got >> 5
        p += got & 31
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    out, parts, k = out.T[back], [], 0
    for n, c in zip(n_ids, checkpoints, strict=True):
        parts.append(out[k : k + len(c)].reshape(-1)[:n])
        k += len(c)
    return parts


def id_counts(tokens: DataFrame, vocab: int) -> np.ndarray:
    """How often each id occurs: summed in each task, then over the tasks; `vocab` numbers reach the driver."""

    def run(batches):
        counts = np.zeros(vocab, np.int64)
        for batch in batches:
            col = batch.column(0)
            ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
            if len(col):
                counts += np.bincount(np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u2"), minlength=vocab)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocab, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write_blocks(docs: DataFrame, tokenizer: str, end: int = 0, vocab: int = 1 << 16, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """docs (doc_id, text) as a table of coded blocks in ascending doc_id order, and the code lengths of its ids.

    The texts are tokenised once, where they are read; the ids are kept in the shared folder for both the count and the
    coding, and only they are dealt by ranges of doc_id. vocab is at most 65,536 here: ids are kept as 16-bit integers
    until they are coded.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = written(token_column(docs, tokenizer, end=end), "ids", compression="zstd")
    lengths = code_lengths(id_counts(tokens, vocab))
    book = spark.sparkContext.broadcast(lengths)  # vocab bytes

    def run(batches):
        lengths = book.value
        codes = canonical_codes(lengths)
        first, held, ids, names, sizes = 0, 0, [], [], []
        shard = TaskContext.get().partitionId()

        def flush():
            all_ids = np.frombuffer(b"".join(ids), "<u2")
            payload, marks = encode_block(all_ids, codes, lengths)
            cells = [[shard], [first], [list(names)], [list(sizes)], [len(all_ids)], [marks], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, BLOCK_TYPES, strict=True)], names=BLOCK_NAMES)

        for batch in batches:
            for name, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held + n > block:
                    yield flush()
                    first, held, ids, names, sizes = first + held, 0, [], [], []
                held += n
                ids.append(data)
                names.append(name)
                sizes.append(n)
        if names:
            yield flush()

    ordered = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.crc32("ids"), "n_tokens")
    return written(ordered.mapInArrow(run, BLOCK_SCHEMA), "huffman-blocks", compression="none"), lengths


BLOCK_TYPES = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary()]
BLOCK_NAMES = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]


def read_blocks(blocks: DataFrame, lengths: np.ndarray, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids of each document, as decoded from its block; digest: their crc32 instead."""
    spark = blocks.sparkSession
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one number for each range of doc_id
    starts, total = {}, 0
    for r in totals:
        starts[r.shard], total = total, total + r.n
    shared = spark.sparkContext.broadcast((lengths, starts))

    def run(batches):
        lengths, starts = shared.value
        table, bits = decode_table(lengths)
        for whole in batches:
            for k in range(0, whole.num_rows, 32):
                rows = whole.slice(k, 32).to_pydict()
                names, first, sizes, out = [], [], [], []
                ids = decode_blocks(rows["payload"], rows["n_ids"], [np.array(c) for c in rows["checkpoints"]], table, bits)
                for shard, at, docs, counts, got in zip(rows["shard"], rows["first"], rows["doc_ids"], rows["sizes"], ids, strict=True):
                    ends = np.cumsum(counts)
                    names += docs
                    sizes += counts
                    first.append(starts[shard] + at + ends - counts)
                    parts = np.split(got, ends[:-1])
                    out += [crc32_u32(p) for p in parts] if digest else [p.astype(np.int64) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate(first)), pa.array(sizes, pa.int64()), pa.array(out, pa.int64() if digest else pa.list_(pa.int64()))], names=["doc_id", "start", "n_tokens", "ids"])

    out = blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, ids {'long' if digest else 'array<long>'}")
    return out.withColumnRenamed("ids", "ids_crc32") if digest else out
