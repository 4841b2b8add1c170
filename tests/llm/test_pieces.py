import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from helpers import ODD, none_of, odd_documents
from stormledger.llm import piece_samples as ps

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = ps.model_of(PATH)


def segmentations(chunk):
    """All ways to cut a chunk into pieces, with their log-probabilities before normalising."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    logp = dict(zip(MODEL.ids.tolist(), MODEL.logp.tolist()))

    def cut(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            i = sp.piece_to_id(rest[:k])
            if i in logp:
                for tail, p in cut(rest[k:]):
                    yield (i, *tail), logp[i] + p

    return dict(cut(chunk))


def draws(text, n, k, lost=ps.LOST):
    keys = ps.mix(np.arange(n).astype(np.uint64))
    out = {}
    for d, member, logprob, score, inclusion, ids in ps.sample_texts(MODEL, pa.array([text] * n), keys, k, lost):
        out.setdefault(d, []).append((member, logprob, score, inclusion, tuple(ids.tolist())))
    return out


@pytest.mark.parametrize("lost, gap", [(ps.LOST, " "), (-0.5, " "), (-2.0, " "), (ps.LOST, "  ")])
def test_first_draws_follow_the_lattice_and_no_sample_repeats(lost, gap):
    """Also with parts kept as one set from early on, and with pieces that are runs of spaces."""
    text = f"ab{gap}abc"
    one, two = segmentations(ps.SPACE + "ab"), segmentations(gap.replace(" ", ps.SPACE) + "abc")
    both = {a + b: p + q for a, p in one.items() for b, q in two.items()}
    total = math.log(sum(math.exp(p) for p in both.values()))
    got = draws(text, 4000, 4, lost)
    first, second = Counter(), Counter()
    for rows in got.values():
        assert [r[0] for r in rows] == [0, 1, 2, 3] and len({r[4] for r in rows}) == 4
        assert all(a[2] >= b[2] for a, b in zip(rows, rows[1:]))
        for r in rows:
            assert abs(r[1] - (both[r[4]] - total)) < 1e-9 and r[3] <= 1e-12
        first[rows[0][4]] += 1
        second[rows[1][4]] += 1
    p = {s: math.exp(q - total) for s, q in both.items()}
    for s, q in p.items():
        assert abs(first[s] / 4000 - q) < 4 * math.sqrt(q * (1 - q) / 4000) + 1e-3
        later = sum(p[r] * q / (1 - p[r]) for r in p if r != s)  # drawn second, without replacement
        assert abs(second[s] / 4000 - later) < 4 * math.sqrt(later / 4000) + 2e-3
    # inclusion scores estimate sums: the mean over draws of sum(1 / q) is the number of segmentations' share that k - 1 of them leave
    weights = [sum(math.exp(r[1] - r[3]) for r in rows) for rows in got.values()]
    assert abs(np.mean(weights) - 1) < 0.05


def test_few_segmentations_and_empty():
    every = segmentations(ps.SPACE + "a")
    rows = draws("a", 5, 10)[0]
    assert len(rows) == len(every) and all(r[3] == 0 for r in rows)
    assert [(r[0], r[1], r[4]) for r in draws("", 1, 3)[0]] == [(0, 0.0, ())]


def test_decoding_and_odd_rows(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = odd_documents(spark)
    rows = ps.samples(df, PATH, with_ids=True).collect()
    texts = Counter(i for i, _ in ODD)
    by = dict(ODD)
    for r in rows:
        text = by[r.doc_id] or ""
        assert r.decoded_crc32 == zlib.crc32(text.encode()) and sp.decode(r.ids) == text
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    per = Counter(r.doc_id for r in rows)
    every = {None: 1, "": 1, " \t\n": 2}  # the two spaces at its start may be one piece
    assert all(per[i] == n * every.get(by[i], ps.K) for i, n in texts.items())
    assert ps.samples(none_of(df), PATH).collect() == []
    again = ps.samples(df.repartition(3), PATH, with_ids=True).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_runs_of_spaces_are_pieces():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ("   a", "a     b  c ", "  ", "a  "):
        rows = draws(text, 300, 3)
        ids = [i for r in rows.values() for x in r for i in x[4]]
        assert any(set(sp.id_to_piece(i)) == {ps.SPACE} and len(sp.id_to_piece(i)) > 1 for i in ids), text
        assert all(ps.decode(MODEL, list(x[4])).decode() == text for r in rows.values() for x in r)
        assert abs(np.mean([sum(math.exp(r[1] - r[3]) for r in x) for x in rows.values()]) - 1) < 0.15
