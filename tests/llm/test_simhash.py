import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from helpers import none_of, odd_documents
from stormledger.llm import simhash
from stormledger.llm.components import components
from stormledger.llm.queries import op9_simhash_near_dedup


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=2):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {r.doc_id: brute_fp(r.text) for r in rows}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash_near_dedup(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_planted_neighbours_and_large_groups(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(x) for x in base]
    for x in base[:10].tolist():  # chains of one and two flips, and a dense group
        for k in range(30):
            x ^= 1 << int(rng.integers(64)) | (1 << int(rng.integers(64)) if k % 2 else 0)
            fps.append(int(x))
    fps = list(dict.fromkeys(fps))
    want = brute_components({i: f for i, f in enumerate(fps)})
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    for tile in (2048, 3):
        found = simhash.links(spark.createDataFrame(signed, "fp long"), tile=tile).collect()
        root = {f: i for i, (f,) in enumerate(signed)}
        link = {frozenset((root[r.a], root[r.b])) for r in found}
        assert all((fps[min(p)] ^ fps[max(p)]).bit_count() <= 64 for p in link)
        near = {r.node: r.root for r in components(spark.createDataFrame(found, "a long, b long")).collect()}
        groups = Counter()
        by = {}
        for i, (f,) in enumerate(signed):
            by.setdefault(near.get(f, f), set()).add(i)
        mine = {i: min(g) for g in by.values() for i in g}
        assert mine == want, groups


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, k) for k in range(1001, 1300)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{k: 1000 for k in range(1000, 1300)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_rows(spark):
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_groups(odd_documents(spark)).collect()]
    assert len(got) == 9
    by = {i: (f, c) for i, f, c in got}
    assert by[2] == by[3] == by[7] == (0, 2)
    assert by[1] == by[5] and by[1][1] == 1
    assert simhash.near_groups(none_of(odd_documents(spark))).collect() == []


def sets_of(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def jaccard(a, b):
    a, b = sets_of(a), sets_of(b)
    return len(a & b) / len(a | b)


def test_planted_copies_from_0_8_on(spark):
    rng = np.random.default_rng(3)
    texts = []
    for n in range(40):  # a text, and copies that are more and more changed
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        texts.append(" ".join(words))
        for changed in (1, 2, 3, 4, 8, 12):
            copy = list(words)
            for at in np.linspace(10, 190, changed).astype(int):
                copy[at] = f"new{n}-{changed}"
            texts.append(" ".join(copy))
    near = [(i, k) for i in range(len(texts)) for k in range(i) if i // 7 == k // 7 and jaccard(texts[i], texts[k]) >= 0.8]
    want = brute_links(len(texts), near)
    assert sum(0.8 <= jaccard(texts[7 * n], texts[7 * n + 4]) < 0.95 for n in range(40)) == 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()}
    assert kept == set(want.values())
    assert corpus_pipeline.near_copies(spark, none_of(df), "").collect() == []


def mixed_bucket(seed=11, n=300):
    """Texts that each differ from one base in three words, under 0.8 similar, and a near twin of each."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts = []
    for k in range(n):
        words = list(base)
        for at in rng.choice(200, 3, replace=False):
            words[at] = f"v{k}-{at}"
        texts.append(" ".join(words))
        words[rng.integers(200)] = f"twin{k}"
        texts.append(" ".join(words))
    return texts


def links_of(texts):
    sets = [sets_of(t) for t in texts]
    return [(i, k) for i in range(len(texts)) for k in range(i) if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])]


@pytest.mark.parametrize("tile", [simhash.TILE_SHINGLES, 5000])
def test_all_links_of_texts_that_share_buckets(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_SHINGLES", tile)
    monkeypatch.setattr(simhash.across, "__defaults__", (tile,))
    texts = mixed_bucket()
    pairs = links_of(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    h, g = simhash.text_keys()
    node = {r.doc_id: (r.h, r.g) for r in df.select("doc_id", h, g).collect()}
    root = {tuple(r.node): tuple(r.root) for r in simhash.similar_texts(df).collect()}
    together = sum(root.get(node[a], 0) == root.get(node[b], 1) for a, b in pairs)
    assert len(pairs) > 500 and together == len(pairs)
    want = brute_links(len(texts), pairs)
    assert len(set(want.values())) == len({root.get(x, x) for x in node.values()})  # and nothing else is linked


def test_similar_pairs_against_sets():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 60)
    sets = [(k, np.unique(np.concatenate([rng.choice(base, 50, replace=False), rng.integers(0, 1 << 60, rng.integers(0, 8))]))) for k in range(40)]
    for n in (1, 12, 40):
        got = simhash.similar_pairs(sets[:n], sets, 0.8)
        near = [(i, k) for i in range(n) for k in range(40) if len(set(sets[i][1]) & set(sets[k][1])) >= 0.8 * len(set(sets[i][1]) | set(sets[k][1]))]
        assert set(got) <= set(near) and set(brute_links(40, got).items()) == set(brute_links(40, near).items())
    assert simhash.similar_pairs([], sets, 0.8) == simhash.similar_pairs(sets, [], 0.8) == []


def brute_links(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    return dict(enumerate(root))


def test_rows_with_one_id_or_none_stay_unless_they_are_copies(spark):
    own = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcdef"]
    rows = [(1, own[0]), (1, own[1]), (1, own[1]), (None, own[2]), (None, own[3]), (None, own[3]), (None, own[0] + " more"), (2, own[4]), (3, own[4] + " more"), (None, own[5] + " more"), (None, own[5])]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    fixed = [(1, own[0]), (1, own[1]), (None, own[2]), (None, own[3]), (2, own[4])]
    assert len(got) == 6 and set(fixed) < set(got) and (set(got) - set(fixed)).pop() in rows[-2:]
