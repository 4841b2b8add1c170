import os
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import ODD, none_of, odd_documents
from stormledger.llm import huffman_ids, packing
from stormledger.llm.queries import op3_huffman_ids, op10_pattern_packing
from stormledger.llm.tokens import ChunkEncoder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ENCODERS = {p: (ChunkEncoder(p, blanks), Tokenizer.from_file(p)) for p, blanks in ((BYTE, True), (WORD, False))}


def ids_of(path, text):
    return ENCODERS[path][1].encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sI ll  \n\t 　.,<|>endoftxé漢🙂Σ\x1c0")), max_size=30), max_size=4))
def test_chunks_are_whole_encodes(texts):
    for path, (own, whole) in ENCODERS.items():
        ids, n = own.encode(texts)
        assert ids.tolist() == [i for t in texts for i in whole.encode(t, add_special_tokens=False).ids + [0]]
        assert n.sum() == len(ids)


def test_blanks_after_a_line_end():
    texts = ["\n\xa0", "a\n\xa0", "a\n\xa0\xa0b", "\xa0\n b", "a\xa0\nb", "a\t\nb", "\n\tb", "a \xa0\xa0b", "a\x0b\nb\n\x0b"]
    ids, _ = ENCODERS[BYTE][0].encode(texts)
    assert ids.tolist() == [i for t in texts for i in ids_of(BYTE, t)]


def test_dropped_blanks_case_and_marks_leave_few_chunks():
    own = ChunkEncoder(WORD, False)
    texts = ["Alpha beta.\nalpha, Beta!", "ALPHA\tbeta.\r\n\nbeta", "", "beta."]
    ids, n = own.encode(texts)
    assert ids.tolist() == [i for t in texts for i in ids_of(WORD, t)] and n.tolist() == [len(ids_of(WORD, t)) for t in texts]
    assert sorted(own.known.to_pylist()) == sorted(["alpha", "beta", ".", ",", "!"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["W", "w", "I", "K", "s", "'", "'S", ".", "-", "=", "\u030a", "\u0307", "\u0338", " ", "\n", "\x1c", "\x85", "É", "Σ", "7", "<|", "|>", "<|endoftext|>", "<|ENDofText|>"]), max_size=12).map("".join), max_size=4))
def test_case_and_marks_are_cut_as_the_library_does(texts):
    own = ENCODERS[WORD][0]
    column = pa.array(["before.", *texts, "<|EndOfText|>"])
    for part, part_texts in ((column, ["before.", *texts, "<|EndOfText|>"]), (column.slice(1, len(texts)), texts)):
        ids, n = own.encode(part)
        assert ids.tolist() == [i for t in part_texts for i in ids_of(WORD, t)]
        assert n.tolist() == [len(ids_of(WORD, t)) for t in part_texts]


def test_only_the_known_normalizer_is_shortened():
    with pytest.raises(ValueError):
        ChunkEncoder(BYTE, False)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_huffman_query(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    start, want = 0, []
    for r in rows:
        ids = ids_of(BYTE, r.text)
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, op3_huffman_ids(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_huffman_odd_rows(spark):
    blocks, lengths = huffman_ids.write_blocks(odd_documents(spark), BYTE, block=50)
    got = huffman_ids.read_blocks(blocks, lengths).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(ids_of(BYTE, t))) for i, t in ODD)
    ordered = sorted(got, key=lambda r: r.start)
    assert ordered[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
    assert ordered[0].doc_id is None and [r.doc_id for r in ordered[1:]] == sorted(r.doc_id for r in ordered[1:])
    blocks, lengths = huffman_ids.write_blocks(none_of(odd_documents(spark)), BYTE)
    assert huffman_ids.read_blocks(blocks, lengths).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=3000), st.sampled_from([1, 7, 512]))
def test_codes_round_trip(ids, every):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids, minlength=401) ** 4
    lengths = huffman_ids.code_lengths(counts, 11)
    assert lengths.max(initial=0) <= 11 and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    payload, marks = huffman_ids.encode_block(ids, huffman_ids.canonical_codes(lengths), lengths, every)
    table, bits = huffman_ids.decode_table(lengths)
    assert huffman_ids.decode_blocks([payload], [len(ids)], [marks], table, bits, every)[0].tolist() == ids.tolist()


def test_packing_query(spark, sf):
    rows = op10_pattern_packing(spark, sf).collect()
    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = ids_of(WORD, r.text)
        for k in range(0, len(ids), 2048):
            want[r.doc_id, k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_places(rows)
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 2


def check_places(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_odd_rows(spark):
    rows = packing.packed(odd_documents(spark), WORD, with_ids=True).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, {})[r.piece] = r.ids
    assert {i: [x for k in sorted(p) for x in p[k]] for i, p in got.items()} == {i: ids_of(WORD, t) for i, t in ODD}
    check_places(rows)
    assert packing.packed(none_of(odd_documents(spark)), WORD).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=400))
def test_plan_holds_the_histogram(lengths):
    hist = np.bincount(lengths, minlength=65)
    planned = packing.plan(hist)
    back = Counter()
    for content, m in planned:
        assert sum(content) <= 64
        for x in content:
            back[x] += m
    assert back == Counter(lengths)
    assert sum(m for _, m in planned) <= sum(m for _, m in packing.best_fit(hist))


#: A worker's part of the packing stage, run on batches of many distinct words; prints by how many MB they raise the peak.
WORKER = """
import random, re, sys
from unittest.mock import MagicMock
import pyarrow as pa
from stormledger.llm import packing

packing.F = MagicMock()  # columns want a session

class Docs:  # hands out the function that workers run
    select = lambda self, *columns: self
    mapInArrow = lambda self, run, schema: run

def mb(what):
    return int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

random.seed(1)
words = ["".join(random.choices("abcdefghij", k=8)) for _ in range(400_000)]
def batches():
    for _ in range(2):
        texts = [" ".join(random.choices(words[:2000], k=450) + random.choices(words, k=50)) for _ in range(5000)]
        yield pa.record_batch({"doc_id": pa.array(range(5000), pa.int64()), "text": pa.array(texts, pa.string())})
given = list(batches())
run = packing.pieces_of(Docs(), sys.argv[1], **getattr(packing, "SMALL", {}))
list(run(iter([given[0].slice(0, 1)])))
del words
packing.give_back()
open("/proc/self/clear_refs", "w").write("5")  # the peak counts from here
before = mb("VmRSS")
assert sum(x.num_rows for x in run(iter(given))) >= 10_000
print(mb("VmHWM") - before)
"""


def test_packing_workers_memory_is_bounded():
    got = subprocess.run([sys.executable, "-c", WORKER, WORD], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ROOT}, timeout=120)
    assert float(got.stdout.split()[-1]) < 100, got.stdout
