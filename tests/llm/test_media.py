import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import ODD, none_of, odd_documents
from stormledger.llm import progressive_jpeg as pj
from stormledger.llm.queries import op4_progressive_jpeg


def back(payloads):
    coefs, images = pj.decode_coefficients(pj.store(payloads))
    return pj.payloads(coefs, images, list(map(len, payloads)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32), st.sampled_from([2, 3, 5, 40, 256]), st.integers(0, 3000)), min_size=1, max_size=5), st.sampled_from([2, 4095]))
def test_round_trip(parts, side):
    payloads = []
    for seed, levels, n in parts:
        rng = np.random.default_rng(seed)
        values = np.clip(128 + np.arange(levels) - levels // 2, 0, 255) if seed % 2 else rng.integers(0, 256, levels)
        weights = rng.random(levels) ** 6 + 1e-9
        payloads.append(pj.payload_of(bytes(rng.choice(values, n, p=weights / weights.sum()).astype(np.uint8))))
    before, pj.MAX_SIDE = pj.MAX_SIDE, side
    try:
        assert back(payloads) == payloads
    finally:
        pj.MAX_SIDE = before


def test_pixels_against_the_definition():
    rng = np.random.default_rng(3)
    payload = bytes(rng.integers(118, 139, pj.UNIT * 2, dtype=np.uint8))
    coefs, images = pj.decode_coefficients(pj.store([payload]))
    rgb = pj.rgb_tensors(coefs, images)[0]
    blocks = np.frombuffer(payload, np.uint8).astype(float).reshape(2, 9, 64) - 128

    def pixels(zz):
        square = np.zeros((8, 8))
        for value, at in zip(zz, pj.ZIGZAG):
            square[at // 8, at % 8] = value
        c = [0.5**0.5] + [1] * 7
        out = np.zeros((8, 8))
        for x in range(8):
            for y in range(8):
                out[x, y] = sum(c[u] * c[v] / 4 * square[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
        return np.clip(np.floor(out + 128.5), 0, 255)

    def plane(first):
        return np.concatenate([np.block([[pixels(b[first]), pixels(b[first + 1])], [pixels(b[first + 2]), pixels(b[first + 3])]]) for b in blocks])

    y, cb, cr = plane(0), plane(4), np.concatenate([np.kron(pixels(b[8]), np.ones((2, 2))) for b in blocks])
    want = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], -1)
    assert rgb.shape == (32, 16, 3) and np.abs(rgb - np.clip(want, 0, 255)).max() <= 1.01
    assert list(pj.ZIGZAG[:10]) == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def expected(text):
    data = (text or "").encode()
    full = pj.payload_of(data)
    assert len(full) % 576 == 0 and full.startswith(data)
    return len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])


def test_query(spark, sf):
    rows = {r.doc_id: r for r in op4_progressive_jpeg(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    same = {}
    for d in docs:
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(d.text)
        assert same.setdefault(d.text, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_odd_rows(spark):
    got = pj.features(pj.media(odd_documents(spark)), tensors=True).collect()
    by = dict(ODD)
    assert len(got) == len(ODD)
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(by[r.doc_id])
        assert len(r.rgb) == r.height * r.width * 3
    assert pj.features(pj.media(none_of(odd_documents(spark)))).collect() == []
