"""SentencePiece encoding by sampling: Gumbel top-k segmentations without replacement, found by perturbed A-star search.

A text's lattice has an edge for each piece of the model at each place; a piece's probability follows Zipf's law by its
rank in the model (the file has ranks only, and nothing is trained), a character without a piece becomes its bytes. No
piece goes from a character into a space, so the lattice is a chain of the lattices of chunks (a run of spaces with what
follows), which are built once for each distinct chunk of a batch: edges by rolling hashes of substrings, then backward sums, so that every
edge has its probability given where it starts.

The search is over sets of segmentations. The first set holds all, with a Gumbel number as the perturbed maximum; its
best member is drawn edge by edge. What is left of a set after a member is taken is split by the first edge that differs,
and each part draws its own perturbed maximum below its set's. The part with the largest is next, until k members are
out. Parts whose share of their member's set is below exp(LOST) stay one set, split in the same way if it is ever the
largest. All draws are hashes of the row key, the member's number and the place, whatever batch a row is in.
log_inclusion is the logarithm of the chance that a segmentation's perturbed score is over the first one not emitted.

The model writes a space as U+2581, so a text that has that character is decoded with a space for it, as by the library.

Nulls: a null or empty text has the empty segmentation alone. A null doc_id is a key like any other. Repeated rows give
repeated samples. A text with fewer than k segmentations has fewer rows. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

K, SEED, LOST = 3, 20, -37.0
SPACE = "▁"
#: An odd multiplier of rolling hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixed hash of 64-bit integers (the finaliser of splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def uniform(*parts) -> np.ndarray:
    """Numbers in (0, 1) from integers."""
    h = U(SEED)
    for x in parts:
        h = mix(np.asarray(h ^ np.asarray(x).astype(U)) if isinstance(x, np.ndarray) or isinstance(h, np.ndarray) else np.array([h ^ U(x)], U))
    return ((h >> U(11)).astype(float) + 0.5) * 2.0**-53


def slot(h: np.ndarray) -> np.ndarray:
    """A place of 2**20 for each hash; the product spreads hashes of single characters, which differ in low bits only."""
    return ((h * U(0xBF58476D1CE4E5B9)) >> U(44)).view(np.int64)


class Model:
    """Pieces of a model file: hashes of the ordinary ones, log-probabilities, and the bytes that each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = [b""] * n
        self.byte_id = {}
        pieces, ids = [], []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes[i] = piece.replace(SPACE, " ").encode()
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} goes across a space")
                pieces.append(piece)
                ids.append(i)
        self.longest = max(map(len, pieces))
        order = np.argsort(ids)
        rank = np.empty(len(ids))
        rank[order] = np.arange(1, len(ids) + 1)
        total = np.log((1 / np.arange(1, len(ids) + 258)).sum())
        self.byte_logp = float(-np.log(len(ids) + 257) - total)
        hashes = np.array([sum(ord(c) * pow(BASE, k, 1 << 64) for k, c in enumerate(p)) + len(p) * 0xD1B54A32D192ED03 & (1 << 64) - 1 for p in pieces], U)
        by = np.argsort(hashes)
        self.hashes, self.ids, self.logp = hashes[by], np.array(ids, np.int64)[by], (-np.log(rank) - total)[by]
        assert (np.diff(self.hashes) > 0).all()
        slots = slot(self.hashes)  # the first piece of each slot, and the next one of the same
        self.head, self.next = np.full(1 << 20, -1, np.int32), np.full(len(slots), -1, np.int32)
        for k in reversed(range(len(slots))):
            self.next[k], self.head[slots[k]] = self.head[slots[k]], k


@cache
def model_of(path: str) -> Model:
    return Model(path)


class Lattice:
    """The lattices of distinct chunks, one after another: `first` node of each chunk; edges of node v are ptr[v] to ptr[v + 1], likelier first."""

    def __init__(self, model: Model, chunks: list[str]):
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        cp = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(cp)
        starts = np.cumsum(lens) - lens
        chunk = np.repeat(np.arange(len(chunks), dtype=np.int32), lens)
        left = (np.repeat(starts + lens, lens) - np.arange(n)).astype(np.int32)  # characters to the end of the chunk
        power, inverse = (np.concatenate([np.ones(1, U), np.multiply.accumulate(np.full(n, b, U))]) for b in (BASE, INVERSE))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(cp * power[:n], dtype=U)])
        found = []
        single = np.zeros(n, bool)
        long_left = np.arange(n, dtype=np.int32)
        for length in range(1, min(model.longest, int(lens.max(initial=0))) + 1):
            salt = U(length * 0xD1B54A32D192ED03 & (1 << 64) - 1)
            if length < 5:
                h = (sums[length:] - sums[:-length]) * inverse[: n + 1 - length] + salt
                k = model.head[slot(h)]
                at = np.flatnonzero((k >= 0) & (left[: n + 1 - length] >= length))
                h, k = h[at], k[at]
            else:
                at = long_left = long_left[left[long_left] >= length]
                h = (sums[at + length] - sums[at]) * inverse[at] + salt
                k = model.head[slot(h)]
                some = np.flatnonzero(k >= 0)
                at, h, k = at[some], h[some], k[some]
            hit = model.hashes[k] == h
            while len(again := np.flatnonzero(~hit & (model.next[k] >= 0))):
                k[again] = model.next[k[again]]
                hit[again] = model.hashes[k[again]] == h[again]
            at, k = at[hit], k[hit]
            found.append((at, length, model.logp[k], model.ids[k]))
            if length == 1:
                single[at] = True
        rest = np.flatnonzero(~single)  # characters that become bytes
        bytes_ = np.where(cp[rest] < 0x80, 1, np.where(cp[rest] < 0x800, 2, np.where(cp[rest] < 0x10000, 3, 4)))
        found.append((rest, 1, model.byte_logp * bytes_, -1 - cp[rest].astype(np.int64)))  # a piece's id, or -1 - code point
        self.first = starts + np.arange(len(chunks))
        self.nodes = n + len(chunks)
        degree = np.zeros(self.nodes + 1, np.int64)
        for at, *_ in found:
            degree[at + chunk[at]] += 1
        self.ptr = np.concatenate([[0], np.cumsum(degree[:-1])])
        m = int(self.ptr[-1])
        self.end, self.what, self.p = np.empty(m, np.int32), np.empty(m, np.int32), np.empty(m)
        fill = self.ptr[:-1].copy()
        for at, length, logp, what in reversed(found):  # long pieces first
            v = at + chunk[at]
            e = fill[v]
            fill[v] += 1
            self.end[e], self.what[e], self.p[e] = v + length, what, logp
        del found, fill, sums, power, inverse
        beta = np.zeros(self.nodes)
        by_length = np.argsort(-lens, kind="stable")
        ends, have = (self.first + lens)[by_length], -lens[by_length]
        for d in range(1, int(lens.max(initial=0)) + 1):
            v = np.sort(ends[: np.searchsorted(have, -d, side="right")] - d)
            deg = degree[v]
            cuts = np.cumsum(deg) - deg
            e = np.repeat(self.ptr[v] - cuts, deg) + np.arange(int(deg.sum()))
            value = self.p[e] + beta[self.end[e]]
            top = np.maximum.reduceat(value, cuts)
            value = np.exp(value - np.repeat(top, deg))
            total = np.add.reduceat(value, cuts)
            beta[v] = top + np.log(total)
            self.p[e] = value / np.repeat(total, deg)
        self.p[self.p >= 1] = 1 - 2.0**-53
        self.cum = self.p.copy()
        some = np.flatnonzero(degree[:-1])
        more, j = some, 1
        while len(more := more[degree[more] > j]):
            e = self.ptr[more] + j
            self.cum[e] += self.cum[e - 1]
            j += 1
        self.cum[self.ptr[some + 1] - 1] = 2.0
        self.p[self.ptr[some][degree[some] == 1]] = 1.0
        self.logp = np.log(self.p)
        self.last = np.zeros(self.nodes, bool)
        self.last[self.first + lens] = True

    def draw(self, at: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An edge path from each node of `at` to its chunk's end: all edges one after another, and how many each has. keys: row, member, place."""
        n, rounds, alive, at = np.zeros(len(at), np.int64), [], np.arange(len(at)), at.copy()
        key = mix(keys[0] + keys[1].astype(U) * U(0xD6E8FEB86659FD93) + keys[2].astype(U) * U(0xA0761D6478BD642F)) if len(at) else at
        while True:
            go = ~self.last[at]
            alive, at = alive[go], at[go]
            if not len(at):
                break
            u = ((mix(key[alive] + U(len(rounds))) >> U(11)).astype(float) + 0.5) * 2.0**-53
            e = self.ptr[at]
            more = np.flatnonzero(u >= self.cum[e])
            while len(more):
                e[more] += 1
                more = more[u[more] >= self.cum[e[more]]]
            rounds.append((alive, e))
            n[alive] += 1
            at = self.end[e]
        begins = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int64)
        for k, (who, e) in enumerate(rounds):
            out[begins[who] + k] = e
        return out, n


def below(phi: np.ndarray, u: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Gumbel numbers of location phi, given that they are at most top."""
    with np.errstate(over="ignore"):
        return np.where(np.isneginf(phi), -np.inf, -np.logaddexp(-top, -phi + np.log(-np.log(u))))


def top_k(lattice: Lattice, words: np.ndarray, counts: np.ndarray, keys: np.ndarray, k: int, lost: float = LOST):
    """Per member that is emitted: document, number, log-probability, perturbed score, log inclusion, and its edges.

    words: chunk numbers of all documents one after another, counts of them by document.
    """
    docs, firsts = len(counts), np.cumsum(counts) - counts
    doc_of = np.repeat(np.arange(docs), counts)
    place = np.arange(len(words)) - firsts[doc_of]
    edges, n = lattice.draw(lattice.first[words], keys[doc_of], np.zeros(len(words)), place)
    word_of = np.repeat(np.arange(len(words)), n)
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc_of, n, docs).astype(np.int64))])
    paths = [{d: (edges[a:b], word_of[a:b]) for d, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()))}]
    top = -np.log(-np.log(uniform(keys, 1)))
    x_none = np.zeros(0)
    out, cand = [], {"doc": [], "g": [], "member": [], "at": [], "phi": [], "tail": []}

    def add(which, g, member, at, phi, tail):
        for name, x in (("doc", which), ("g", g), ("member", np.full(len(which), member)), ("at", at), ("phi", phi), ("tail", np.full(len(which), tail))):
            cand[name].append(x)

    def emit(member, which, edges, sizes, score, skip):
        """Add members and the parts of their sets, from step skip on."""
        lp = lattice.logp[edges]
        begins = (np.cumsum(sizes) - sizes).tolist()
        totals, heads_, tails = np.zeros(len(which)), [], []
        for j, (a, n) in enumerate(zip(begins, sizes.tolist())):  # each on its own: the same in every batch
            if n:
                x = np.cumsum(lp[a : a + n])
                totals[j] = x[-1]
                heads_.append(np.append(0.0, x[:-1])[: int(np.searchsorted(-x, -lost)) + 1])
                t = max(len(heads_[-1]), int(skip[j]))
                if t < n and x[-1] < x[t - 1]:
                    tails.append((j, t, x[t - 1], x[t - 1] + np.log1p(-np.exp(x[-1] - x[t - 1]))))
            else:
                heads_.append(x_none)
        doc = np.repeat(np.arange(len(which)), lengths := np.fromiter(map(len, heads_), np.int64, len(heads_)))
        step = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        prefix, at = np.concatenate([x_none, *heads_]), np.array(begins, np.int64)[doc] + step
        some = np.flatnonzero((lp[at] < 0) & (step >= skip[doc]))
        phi = prefix[some] + np.log1p(-lattice.p[edges[at[some]]])
        g = below(phi, uniform(keys[which][doc[some]], np.full(len(some), 7 + member), step[some]), score[doc[some]])
        add(which[doc[some]], g, member, step[some], prefix[some], False)
        if tails:
            j, t, before, phi = (np.array(x) for x in zip(*tails))
            add(which[j], below(phi, uniform(keys[which][j], np.full(len(j), 11 + member), t), score[j]), member, t, before, True)
        out.append((which, np.full(len(which), member), totals, score))

    def split_tail(c, d, m, t, before, top):
        """The parts of a late set by the step of the first edge that differs, as below its member; one of them has the set's maximum."""
        path = paths[m][d][0][t:]
        x = before + np.cumsum(lattice.logp[path])
        parts = max(int(np.searchsorted(before - x, -lost)), 1)
        prefix = np.append(before, x[:-1])[:parts]
        steps = np.flatnonzero(lattice.logp[path[:parts]] < 0)
        late = bool(parts < len(path) and x[-1] < x[parts - 1])
        phi = prefix[steps] + np.log1p(-lattice.p[path[steps]])
        if late:
            phi = np.append(phi, x[parts - 1] + np.log1p(-np.exp(x[-1] - x[parts - 1])))
        share = np.cumsum(np.exp(phi - phi.max()))
        u = uniform(keys[d : d + 1].repeat(len(phi)), np.full(len(phi), 13 + m), t + np.append(steps, [parts] * late))
        new = below(phi, u, np.full(len(phi), top))
        new[np.searchsorted(share, uniform(keys[d : d + 1], 17 + m, t)[0] * share[-1])] = top
        add(np.full(len(steps), d), new[: len(steps)], m, t + steps, prefix[steps], False)
        if late:
            add(np.array([d]), new[-1:], m, np.array([t + parts]), x[parts - 1 : parts], True)

    emit(0, np.arange(docs), edges, np.diff(ends), top, np.zeros(docs, np.int64))
    taken: dict = {}
    for member in range(1, k + 1):
        while True:
            doc, g, of, at, phi, tail = (np.concatenate(x) for x in cand.values())
            cand.update((name, [x]) for name, x in zip(cand, (doc, g, of, at, phi, tail)))
            largest = np.full(docs, -np.inf)
            np.maximum.at(largest, doc, g)
            some = np.flatnonzero((g == largest[doc]) & (g > -np.inf))[::-1]
            place_of = np.full(docs, -1)
            place_of[doc[some]] = some
            best = place_of[place_of >= 0]
            if member == k or not tail[best].any():
                break
            for c in best[tail[best]].tolist():
                split_tail(c, int(doc[c]), int(of[c]), int(at[c]), float(phi[c]), float(g[c]))
            cand["g"] = [np.where(np.isin(np.arange(len(g)), best[tail[best]]), -np.inf, g), *cand["g"][1:]]
        if member == k:
            break
        starts, who, heads, new_words, rests = [], [], [], [], []
        u = uniform(keys[doc[best]], 3, member, at[best]).tolist()
        for c, d, m, t, score, u_ in zip(best.tolist(), doc[best].tolist(), of[best].tolist(), at[best].tolist(), g[best].tolist(), u):
            path, path_words = paths[m][d]
            old = int(path[t])
            v = int(np.searchsorted(lattice.ptr, old, side="right")) - 1
            gone = taken.setdefault((d, m, t), [old])
            lo, hi = int(lattice.ptr[v]), int(lattice.ptr[v + 1])
            p = lattice.p[lo:hi].tolist()
            choice = [e for e in range(lo, hi) if e not in gone]
            u_ *= sum(p[e - lo] for e in choice)
            for e in choice:
                u_ -= p[e - lo]
                if u_ < 0:
                    break
            gone.append(e)
            rests.append(sum(p[x - lo] for x in choice if x != e))
            w = int(path_words[t])
            heads.append((d, np.append(path[:t], e), path_words[: t + 1], t, score))
            after = words[w + 1 : firsts[d] + counts[d]]
            starts.append(np.append(lattice.end[e], lattice.first[after]))
            new_words.append(np.arange(w, w + 1 + len(after)))
            who.append(d)
        if who:  # of what is left of the parts; the members drawn from them have their maxima
            with np.errstate(divide="ignore"):
                left = phi[best] + np.log(np.array(rests))
            g[best] = below(left, uniform(keys[who], 5, member, at[best]), g[best])
        if not who:
            paths.append({})
            continue
        sizes = np.array([len(x) for x in starts])
        flat, word = np.concatenate(starts), np.concatenate(new_words)
        who = np.array(who)
        drawn, n = lattice.draw(flat, np.repeat(keys[who], sizes), np.full(len(flat), member), word - firsts[np.repeat(who, sizes)])
        drawn_words = np.repeat(word, n)
        cuts = np.concatenate([[0], np.cumsum(np.add.reduceat(n, np.cumsum(sizes) - sizes))])
        own = {}
        for (d, head, head_words, *_), a, b in zip(heads, cuts[:-1].tolist(), cuts[1:].tolist()):
            own[d] = (np.concatenate([head, drawn[a:b]]), np.concatenate([head_words, drawn_words[a:b]]))
        paths.append(own)
        emit(member, who, np.concatenate([own[d][0] for d in who.tolist()]), np.array([len(own[d][0]) for d in who.tolist()]), np.array([h[4] for h in heads]), np.array([h[3] + 1 for h in heads]))
    limit = np.full(docs, -np.inf)
    if len(doc):
        limit[doc[best]] = g[best]
    for which, member, logprob, score in out:
        x = logprob - limit[which]
        with np.errstate(over="ignore", divide="ignore"):
            log_inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 50)))))
        for j, d in enumerate(which.tolist()):
            yield d, int(member[j]), float(logprob[j]), float(score[j]), float(log_inclusion[j]), paths[int(member[j])][d][0]


def ids_of_edges(model: Model, what: np.ndarray) -> np.ndarray:
    """Piece ids of edges; an edge of bytes has one for each byte."""
    odd = np.flatnonzero(what < 0)
    if not len(odd):
        return what
    parts, at = [], 0
    for k in odd.tolist():
        parts.append(what[at:k])
        parts.append(np.array([model.byte_id[b] for b in chr(-1 - int(what[k])).encode("utf-8", "surrogatepass")], np.int64))
        at = k + 1
    return np.concatenate([*parts, what[at:]])


def decode(model: Model, ids) -> bytes:
    """The text of ids in UTF-8: pieces joined, without the space that encoding puts before a text."""
    return b"".join(itemgetter(*ids)(model.bytes) if len(ids) > 1 else [model.bytes[i] for i in ids])[1:]


def with_runs(chunks: list[str], codes: np.ndarray, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The same chunks, but empty words (further spaces) belong to the chunk of the word that follows in their text."""
    if not (empty := codes == (chunks.index("") if "" in chunks else -1)).any():
        return [SPACE + w for w in chunks], codes, counts
    last = np.zeros(len(codes), bool)
    last[(np.cumsum(counts) - 1)[counts > 0]] = True
    stays = np.flatnonzero(~empty | last)
    runs = np.diff(stays, prepend=-1)  # a run of one is the word's own space
    keys = runs * len(chunks) + codes[stays]
    distinct, new = np.unique(keys, return_inverse=True)
    per = np.bincount(np.repeat(np.arange(len(counts)), counts)[stays], minlength=len(counts))
    return [SPACE * (x // len(chunks)) + chunks[x % len(chunks)] for x in distinct.tolist()], new, per


def sample_texts(model: Model, texts: pa.Array, keys: np.ndarray, k: int, lost: float = LOST):
    """top_k of each text; edges are given as ids."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    words, counts = coded.indices.to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    words, counts = words[np.repeat(~empty, counts)], np.where(empty, 0, counts)
    chunks, words, counts = with_runs(coded.dictionary.to_pylist(), words, counts)
    lattice = Lattice(model, chunks)
    for d, member, logprob, score, inclusion, path in top_k(lattice, words, counts, keys, k, lost):
        yield d, member, logprob, score, inclusion, ids_of_edges(model, lattice.what[path])


def samples(docs: DataFrame, path: str, k: int = K, with_ids: bool = False) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, sample (from 0, best first), n_tokens, logprob, perturbed, log_inclusion, ids_crc32, decoded_crc32 (of the ids decoded again); with_ids: ids too."""
    fields = "doc_id long, sample int, n_tokens long, logprob double, perturbed double, log_inclusion double, ids_crc32 long, decoded_crc32 long" + ", ids array<int>" * with_ids
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("sample")).alias("key"), "text")
    names = [f.split()[0] for f in fields.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def run(batches):
        model = model_of(path)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                names_of = batch.column(0).to_pylist()
                cells = [[] for _ in names]
                for d, member, logprob, score, inclusion, ids in sample_texts(model, batch.column(2), batch.column(1).to_numpy().view(U), k):
                    row = (names_of[d], member, len(ids), logprob, score, inclusion, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(decode(model, ids.tolist())), ids)
                    for c, x in zip(cells, row):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=names)

    return chosen.mapInArrow(run, fields)
