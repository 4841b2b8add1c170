import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import LONG, ODD, none_of, odd_documents
from stormledger.llm import periodic_runs
from stormledger.llm.queries import QUERIES


def plain_runs(words):
    """By the definition: for each period the maximal stretches, those with a smaller period left out."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)  # periods rise, so the first is the smallest
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_kept(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_words(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(60))]
    if kind == 1:
        return [rng.choice("abcdefgh") for _ in range(rng.randrange(90))]
    words = []
    for _ in range(rng.randrange(5)):
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
        words += (unit * 9)[: rng.randrange(1, 8 * len(unit))] + [rng.choice("abcxyz") for _ in range(rng.randrange(4))]
    return words


def test_blocks_of_texts_against_the_definition():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[w.encode() for w in random_words(rng)] for _ in range(rng.randrange(1, 25))]
        for words, (n, runs, left) in zip(texts, periodic_runs.block_results(texts)):
            want = plain_runs(words)
            assert n == len(words) and [tuple(r.values()) for r in runs] == want
            assert left == b" ".join(plain_kept(words, want)).decode()


def test_extensions_against_a_scan():
    rng = np.random.default_rng(1)
    sizes = np.array([40, 0, 1, 25, 60])
    codes = rng.integers(0, 2, sizes.sum()).astype(np.int32)
    text, starts = np.repeat(np.arange(5), sizes), np.cumsum(sizes) - sizes
    ends = np.repeat(starts + sizes, sizes)
    lce = periodic_runs.Extensions(codes, text, ends)
    pairs = [(a, b) for a in range(len(codes)) for b in range(len(codes)) if a != b and text[a] == text[b]]
    a, b = np.array(pairs).T
    want = []
    for i, j in pairs:
        k = 0
        while max(i, j) + k < ends[i] and codes[i + k] == codes[j + k]:
            k += 1
        want.append(k)
    assert lce.lce(a, b).tolist() == want


def test_query_against_the_definition(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    tried = 0
    for d in docs:
        words = (d.text or "").encode().split()
        h = zlib.crc32(str(d.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue  # the plain way takes the square of n
        tried += 1
        runs, r = plain_runs(words), got[d.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(plain_kept(words, runs))).hexdigest()
    assert tried > 150 and sum(r.n_runs for r in got.values()) > 10


@pytest.mark.parametrize("block", [1, 10**9])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(periodic_runs, "BLOCK", block)
    df = odd_documents(spark)
    got = periodic_runs.periodic_runs(df, keep=("doc_id", "lang", "n", "length", "n_words"))
    assert got.columns == ["doc_id", "lang", "n", "length", "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r.doc_id == 4:
            assert [tuple(x) for x in r.runs] == [(0, 12000, 3)] and r.collapsed == "word other thing" and len(LONG.split()) == 12000
        else:
            assert r.runs == [] and (r.doc_id not in (2, 3, 7) or r.collapsed == "")
    assert periodic_runs.periodic_runs(none_of(df)).count() == 0
    assert got.select(periodic_runs.longest().alias("x"), F.size("runs").alias("k")).where("(x is null) <> (k = 0)").count() == 0
