"""Media columns: progressive JPEG, decoded for a whole batch of images at once in numpy.

Scans (spectral selection and successive approximation) add to the coefficient arrays of all images; restart intervals
are independent, so the streams of all images and scans of one kind advance together, one symbol or one block a step.
Then the coefficients are inverse-transformed, chroma is upsampled and the full-resolution RGB tensors come out.

A payload is stored without loss in the format's own unit, the quantised coefficient: byte - 128, in zigzag order. Nine
blocks of 64 are one unit of 16 x 16 pixels (Y and Cb with 2 x 2 blocks, Cr with one, so Cr is subsampled), and a
restart interval is a row of units. The Huffman codes are fixed, so equal payloads have equal files.

Nulls: a null text is empty, which is one unit of bytes 255. A null doc_id stays null. Repeated rows are stored each. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .huffman_ids import code_lengths
from .tokens import slices

UNIT, SHIFT, MAX_SIDE = 576, 128, 4095
#: Sampling factors of Y, Cb and Cr in stored payloads.
SAMPLING = ((2, 2), (2, 2), (1, 1))
#: First and last coefficient, then the bits that earlier scans had left out and that this one leaves out.
SCANS = [((0, 1, 2), 0, 0, 0, 1), *[((c,), a, b, 0, 1) for c in range(3) for a, b in ((1, 5), (6, 63))], ((0, 1, 2), 0, 0, 1, 0), *[((c,), 1, 63, 1, 0) for c in range(3)]]
U = np.uint64
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def bit_sizes(v: np.ndarray) -> np.ndarray:
    """Bits of magnitudes."""
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


@cache
def fixed_codes(kind: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length of each of 256 symbols, and the table as a file has it: weights fall with the run and follow a fixed guess of sizes."""
    weights = np.zeros(257, np.int64)
    if kind == "dc":
        weights[:12] = [8, 8, 8, 16, 32, 64, 64, 16, 4, 2, 1, 1]
    elif kind == "ac":
        sizes = [0, 200, 400, 1200, 3000, 200, 2500, 100, 20, 4, 1]
        for run in range(16):
            for size in range(11):
                weights[run << 4 | size] = max(1, sizes[size] * 64 >> 3 * run)
            weights[run << 4] = 16 if run in (0, 15) else 1
    else:
        for run in range(16):
            weights[run << 4 | 1] = max(1, 256 >> run)
            weights[run << 4] = 4096 if run == 0 else 8 if run == 15 else 1
    weights = weights * 1000
    weights[256] = 1  # takes the code of ones only, which files must not use
    lengths = code_lengths(weights, 16)
    order = np.lexsort((np.arange(257), lengths))
    order = order[lengths[order] > 0]
    codes, code, before = np.zeros(257, np.int64), 0, 0
    for s in order.tolist():
        code <<= int(lengths[s]) - before
        before = int(lengths[s])
        codes[s] = code
        code += 1
    symbols = order[order < 256]
    assert lengths[256] == lengths.max() and order[-1] == 256
    counts = np.bincount(lengths[symbols], minlength=17)[1:17]
    return codes[:256], lengths[:256].astype(np.int64), bytes(counts.tolist()) + bytes(symbols.tolist())


@cache
def decode_lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: length << 8 | symbol."""
    out, at, n = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[at : at + (1 << 16 - length)] = length << 8 | table[n]
            at += 1 << 16 - length
            n += 1
    return out


def segment(marker: int, data: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(data) + 2).to_bytes(2, "big") + data


def pack(values: np.ndarray, lens: np.ndarray, interval: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of all items, each interval filled up with ones to whole bytes: the bytes, and how many each interval has."""
    bits = np.bincount(interval, lens, n).astype(np.int64)
    pad = -bits % 8
    sizes = (bits + pad) // 8
    begins = (np.cumsum(sizes) - sizes) * 8
    at = np.cumsum(lens) - lens
    at += (begins - np.cumsum(bits) + bits)[interval]
    if n:
        values, lens, at = np.concatenate([values, (1 << pad) - 1]), np.concatenate([lens, pad]), np.concatenate([at, begins + bits])
    words = np.zeros(int(sizes.sum()) // 8 + 2, U)
    room = 64 - (at & 63) - lens
    over = room < 0
    code = values.astype(U)
    first = np.where(over, code >> np.maximum(-room, 0).astype(U), code << np.maximum(room, 0).astype(U))
    word = at >> 6
    for part in (slice(0, len(word) - n), slice(len(word) - n, None)):  # both in order of place
        if len(w := word[part]):
            cuts = np.flatnonzero(np.diff(w, prepend=-1))
            words[w[cuts]] |= np.bitwise_or.reduceat(first[part], cuts)
    words[word[over] + 1] |= code[over] << (64 + room[over]).astype(U)  # no two items go on into one word
    return words.astype(">u8").view(np.uint8)[: int(sizes.sum())], sizes


def ac_first_items(t: np.ndarray, codes, lengths):
    """Items (value, length, block) of blocks of transformed coefficients t (blocks, band)."""
    block, k = np.nonzero(t)
    prev = np.where(np.diff(block, prepend=-1) == 0, np.concatenate([[-1], k[:-1]]) if len(k) else k, -1)
    run, v = k - prev - 1, t[block, k]
    size = bit_sizes(v)
    symbol = (run & 15) << 4 | size
    value = codes[symbol] << size | (np.where(v < 0, v - 1, v) & ((1 << size) - 1))
    zrl = run >> 4
    last = np.full(len(t), -1)
    last[block] = k
    eob = np.flatnonzero(last < t.shape[1] - 1)
    items = [(value, lengths[symbol] + size, block, 2 * k + 1), (np.full(len(eob), codes[0]), np.full(len(eob), lengths[0]), eob, np.full(len(eob), 1000))]
    if zrl.any():
        w = np.repeat(np.arange(len(k)), zrl)
        items.append((np.full(len(w), codes[0xF0]), np.full(len(w), lengths[0xF0]), block[w], 2 * k[w]))
    value, length, block, place = (np.concatenate([x[j] for x in items]) for j in range(4))
    order = np.argsort(block * 1024 + place, kind="stable")
    return value[order], length[order], block[order]


def ac_refine_items(v: np.ndarray, al: int, codes, lengths):
    """The same for a refinement: a symbol comes before the correction bits of the coefficients that it passes."""
    now = np.abs(v) >> al
    old, new = now > 1, now == 1
    corr_block, corr_k = np.nonzero(old)
    items = [(now[corr_block, corr_k] & 1, np.ones(len(corr_k), np.int64), corr_block, 4 * corr_k + 1)]
    block, k = np.nonzero(new)
    prev = np.where(np.diff(block, prepend=-1) == 0, np.concatenate([[-1], k[:-1]]) if len(k) else k, -1)
    zeros = np.cumsum(~old, axis=1)  # coefficients that were zero, up to here
    run = zeros[block, k] - 1 - np.where(prev >= 0, zeros[block, np.maximum(prev, 0)], 0)
    symbol = (run & 15) << 4 | 1
    zrl = run >> 4
    start = prev.copy()  # a symbol stands right after the place where the one before it ended
    if zrl.any():
        w = np.repeat(np.arange(len(k)), zrl)
        j = np.arange(len(w)) - np.repeat(np.cumsum(zrl) - zrl, zrl)
        base = np.where(prev >= 0, zeros[block, np.maximum(prev, 0)], 0)

        def place_of(count, rows):  # where the count-th coefficient that was zero is
            return np.array([int(np.searchsorted(zeros[b], c)) for b, c in zip(rows.tolist(), count.tolist())], np.int64)

        begin = np.where(j == 0, prev[w], place_of(base[w] + 16 * j, block[w]))
        items.append((np.full(len(w), codes[0xF0]), np.full(len(w), lengths[0xF0]), block[w], 4 * begin + 2))
        some = np.flatnonzero(zrl)
        start[some] = place_of(base[some] + 16 * zrl[some], block[some])
    items.append((codes[symbol] << 1 | (v[block, k] > 0), lengths[symbol] + 1, block, 4 * start + 3))
    last = np.full(len(v), -1)
    last[block] = k
    eob = np.flatnonzero(last < v.shape[1] - 1)
    items.append((np.full(len(eob), codes[0]), np.full(len(eob), lengths[0]), eob, 4 * last[eob] + 3))
    value, length, block, place = (np.concatenate([x[j] for x in items]) for j in range(4))
    order = np.argsort(block * 1024 + place + 8, kind="stable")
    return value[order], length[order], block[order]


def shifted(v: np.ndarray, al: int) -> np.ndarray:
    """AC coefficients without their al low bits, towards zero."""
    return np.sign(v) * (np.abs(v) >> al)


def encode_images(units: np.ndarray, heights: list[int], width: int) -> list[bytes]:
    """Files of images of `width` x heights[i] units; units: (units of all images, 9, 64) coefficients."""
    rows = units.reshape(-1, width, 9, 64)
    by_component = [rows[:, :, 4 * c : 4 * c + 4].reshape(-1, width, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(len(rows), -1, 64) for c in (0, 1)] + [rows[:, :, 8]]
    dc, ac, refine = map(fixed_codes, ("dc", "ac", "refine"))
    bounds = np.concatenate([[0], np.cumsum(heights)])
    n = len(rows)
    per_scan = []
    for comps, ss, se, ah, al in SCANS:
        if ss == 0:
            v = rows[..., 0].reshape(n, -1)  # in the order of units, which is the order of an interleaved scan
            if ah:
                data, sizes = pack((v.ravel() >> al) & 1, np.ones(v.size, np.int64), np.repeat(np.arange(n), v.shape[1]), n)
            else:
                t = (v >> al).reshape(n, width, 9)
                d = np.empty_like(t)
                for a, b in ((0, 4), (4, 8), (8, 9)):  # differences within a component
                    x = t[:, :, a:b].reshape(n, -1)
                    d[:, :, a:b] = np.diff(x, axis=1, prepend=0).reshape(n, width, b - a)
                d = d.ravel()
                size = bit_sizes(d)
                value = dc[0][size] << size | (np.where(d < 0, d - 1, d) & ((1 << size) - 1))
                data, sizes = pack(value, dc[1][size] + size, np.repeat(np.arange(n), v.shape[1]), n)
        else:
            x = by_component[comps[0]]
            band = x[..., ss : se + 1].reshape(-1, se + 1 - ss)
            items = ac_refine_items(band, al, *refine[:2]) if ah else ac_first_items(shifted(band, al), *ac[:2])
            data, sizes = pack(items[0], items[1], items[2] // x.shape[1], n)
        # 0xFF is followed by 0, and an interval by its marker unless it is an image's last
        is_ff = data == 255
        stuffed = np.repeat(data, 1 + is_ff)
        stuffed[np.cumsum(1 + is_ff)[is_ff] - 1] = 0
        interval = np.repeat(np.arange(n), sizes)
        sizes = sizes + np.bincount(interval[is_ff], minlength=n)
        last = np.zeros(n, bool)
        last[bounds[1:] - 1] = True
        number = np.arange(n) - np.repeat(bounds[:-1], heights)
        ends = np.cumsum(sizes)[~last]
        marked = np.insert(stuffed, np.repeat(ends, 2), np.stack([np.full(len(ends), 255), 0xD0 + number[~last] % 8], 1).ravel().astype(np.uint8))
        cuts = np.concatenate([[0], np.cumsum(sizes + np.where(last, 0, 2))])[bounds]
        blocks = width if ss == 0 else by_component[comps[0]].shape[1]
        head = segment(0xDD, blocks.to_bytes(2, "big"))
        tables = {c: 0x00 if ss == 0 else 0x00 if not ah else 0x01 for c in comps}
        head += segment(0xDA, bytes([len(comps), *[x for c in comps for x in (c + 1, tables[c])], ss, se, ah << 4 | al]))
        data = marked.tobytes()
        per_scan.append([head + data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
    start = b"\xff\xd8" + segment(0xDB, bytes([0] + [1] * 64))
    tables = b"".join(segment(0xC4, bytes([k]) + t[2]) for k, t in ((0x00, dc), (0x10, ac), (0x11, refine)))
    out = []
    for i, height in enumerate(heights):
        frame = segment(0xC2, bytes([8]) + (16 * height).to_bytes(2, "big") + (16 * width).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x22, 0, 3, 0x11, 0]))
        out.append(start + frame + tables + b"".join(s[i] for s in per_scan) + b"\xff\xd9")
    return out


def payload_of(text: bytes) -> bytes:
    """The text filled up with bytes 255 to a positive multiple of UNIT."""
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEG files of payloads; a very long one is an image of several columns, its last row filled with zeros."""
    out: list = [None] * len(payloads)
    by_width: dict[int, list[int]] = {}
    for i, p in enumerate(payloads):
        by_width.setdefault(-(-len(p) // UNIT // MAX_SIDE), []).append(i)
    for width, which in by_width.items():
        heights = [-(-len(payloads[i]) // UNIT // width) for i in which]
        data = b"".join(payloads[i] + bytes([SHIFT]) * (h * width * UNIT - len(payloads[i])) for i, h in zip(which, heights))
        units = np.frombuffer(data, np.uint8).astype(np.int64).reshape(-1, 9, 64) - SHIFT
        for i, f in zip(which, encode_images(units, heights, width)):
            out[i] = f
    return out


class Component:
    __slots__ = ("h", "v", "q", "base", "wide", "high", "own_wide", "own_high")


def parse(data: bytes) -> tuple[int, int, list[Component], list]:
    """Width, height, components and scans (components, first, last, high, low, tables, interval, data) of a file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, quant, tables, comps, scans, interval, size = 2, {}, {}, {}, [], 0, (0, 0)
    while at < len(data) and data[at + 1] != 0xD9:
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xC2:
            size = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"))
            for k in range(body[5]):
                c = Component()
                c.h, c.v, c.q = body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]
                comps[body[6 + 3 * k]] = c
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xD0)):
            raise ValueError("only progressive files are read here")
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            names = list(comps)
            chosen = [(names.index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
            ss, se, bits = body[1 + 2 * body[0] :][:3]
            found = MARKER.search(data, at)
            end = found.start() if found else len(data)
            use = [tables.get((0x00 | t >> 4) if ss == 0 else (0x10 | t & 15), bytes(16)) for _, t in chosen]
            scans.append(([c for c, _ in chosen], ss, se, bits >> 4, bits & 15, use, interval, data[at:end]))
            at = end
    out = list(comps.values())
    for c in out:
        c.q = quant[c.q]
    return *size, out, scans


@lru_cache(4096)
def scan_order(shape: tuple, which: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """The blocks of a scan in its order, from the image's first block, the number of each one's component in the scan, and blocks to a unit."""
    if len(which) == 1:
        h, v, wide, high, own_wide, own_high, base = shape[which[0]]
        order = base + (np.arange(own_high)[:, None] * wide + np.arange(own_wide)).ravel()
        return order, np.zeros(len(order), np.int64), 1
    parts, comp = [], []
    for k in which:
        h, v, wide, high, _, _, base = shape[k]
        mx, my = wide // h, high // v
        grid = base + np.arange(wide * high).reshape(my, v, mx, h).transpose(0, 2, 1, 3).reshape(mx * my, -1)
        parts.append(grid)
        comp += [len(parts) - 1] * grid.shape[1]
    return np.concatenate(parts, 1).ravel(), np.tile(comp, mx * my), len(comp)


def decode_coefficients(files: list[bytes]):
    """The coefficient blocks (in zigzag order) of all files, and per file width, height and components with their first block."""
    images, total, jobs = [], 0, []
    for data in files:
        width, height, comps, scans = parse(data)
        hmax, vmax = max(c.h for c in comps), max(c.v for c in comps)
        mx, my = -(-width // (8 * hmax)), -(-height // (8 * vmax))
        for c in comps:
            c.base, c.wide, c.high = total, mx * c.h, my * c.v
            c.own_wide, c.own_high = -(-(-(-width * c.h // hmax)) // 8), -(-(-(-height * c.v // vmax)) // 8)
            total += c.wide * c.high
        images.append((width, height, comps))
        for which, ss, se, ah, al, use, interval, body in scans:
            shape = tuple((c.h, c.v, c.wide, c.high, c.own_wide, c.own_high, c.base - comps[0].base) for c in comps)
            order, comp, per = scan_order(shape, tuple(which))
            order = order + comps[0].base
            jobs.append((ss, se, ah, al, use, (interval or len(order) // per) * per, body, order, comp))
    coefs = np.zeros((total, 64), np.int32)
    # the low bit that a scan leaves out orders the passes; a pass takes all images together
    for key in sorted({(-j[3], j[0] > 0, j[2] > 0) for j in jobs}):
        run_pass(coefs, [j for j in jobs if (-j[3], j[0] > 0, j[2] > 0) == key], *key)
    return coefs, images


def run_pass(coefs: np.ndarray, jobs: list, low: int, is_ac: bool, refine: bool) -> None:
    """Adds one kind of scan of all images to coefs."""
    al = -low
    data = np.frombuffer(b"".join(j[6] + b"\xff\xd0" for j in jobs), np.uint8)
    ff = np.flatnonzero(data[:-1] == 255)
    after = data[ff + 1]
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(data), bool)
    keep[ff[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    place = np.cumsum(keep) - keep
    ends = place[marks]
    data = np.concatenate([data[keep], np.full(16, 255, np.uint8)])
    starts = np.concatenate([[0], ends[:-1]])
    counts, orders, comps, tables, lookup = [], [], [], [], []
    for k, (ss, se, ah, al_, use, interval, body, order, comp) in enumerate(jobs):
        n = -(-len(order) // interval)
        counts += [interval] * (n - 1) + [len(order) - interval * (n - 1)]
        orders.append(order)
        comps.append(comp)
        tables += [k] * n
        lookup.append(use)
    counts, tables = np.array(counts), np.array(tables)
    if len(counts) != len(starts):
        raise ValueError("a scan has other restart intervals than its header says")
    order, comp = np.concatenate(orders), np.concatenate(comps)
    begins = np.cumsum(counts) - counts
    p = starts * 8
    if not is_ac and refine:
        bits = np.unpackbits(data)
        seq = np.arange(len(order)) - np.repeat(begins, counts)
        coefs[order, 0] |= bits[np.repeat(p, counts) + seq].astype(np.int32) << al
        return
    names = list(dict.fromkeys(t for use in lookup for t in use))
    stack = np.concatenate([decode_lookup(t) for t in names])
    windows = np.zeros(len(data) - 8, U)
    for k in range(8):
        windows |= data[k : len(data) - 8 + k].astype(U) << U(56 - 8 * k)
    top = len(windows) - 1

    def symbols(p, table):
        x = windows[np.minimum(p >> 3, top)] << (p & 7).astype(U)
        got = stack[table << 16 | (x >> U(48)).view(np.int64)]
        return got & 255, got >> 8, x

    def extra(x, length, size):
        v = ((x << length.astype(U)) >> U(1) >> (63 - size).astype(U)).view(np.int64)
        return np.where(v < (1 << size) >> 1, v - (1 << size) + 1, v)

    if not is_ac:
        pred = np.zeros((len(counts), int(comp.max()) + 1), np.int64)
        table_of = np.array([[names.index(use[min(c, len(use) - 1)]) for c in range(pred.shape[1])] for use in lookup])
        alive, step = np.arange(len(counts)), 0
        while len(alive := alive[counts[alive] > step]):
            at = begins[alive] + step
            c = comp[at]
            size, length, x = symbols(p[alive], table_of[tables[alive], c])
            pred[alive, c] += extra(x, length, size)
            coefs[order[at], 0] = pred[alive, c] << al
            p[alive] += length + size
            step += 1
        return
    table_of = np.array([names.index(use[0]) for use in lookup])[tables]
    first, last = (np.array([j[k] for j in jobs])[tables] for k in (0, 1))
    flat = coefs.reshape(-1)
    if not refine:
        # one symbol of each stream a step; a stream's state: its bit, block, coefficient, end and table
        p, b, e, k, f, s, t = p.copy(), begins.copy(), begins + counts, first.copy(), first, last, table_of
        while len(p):
            symbol, length, x = symbols(p, t)
            run, size = symbol >> 4, symbol & 15
            p += length + size
            k += run
            put = size > 0
            value = extra(x, length, size)
            if put.all():
                flat[(order[b] << 6) + k] = value << al if al == 0 else np.sign(value) * (np.abs(value) << al)
                k += 1
                done = k > s
            else:
                at = np.flatnonzero(put)
                v = value[at]
                flat[(order[b[at]] << 6) + k[at]] = np.sign(v) * (np.abs(v) << al)
                k += 1
                end = ~put & (run < 15)
                done = (k > s) | end
                if end.any():  # the end of this block, and of more for a longer run of ends
                    q = np.flatnonzero(end)
                    r = run[q]
                    more = ((x[q] << length[q].astype(U)) >> U(1) >> (63 - r).astype(U)).view(np.int64)
                    p[q] += r
                    b[q] += (1 << r) + more - 1
            b += done
            k = np.where(done, f, k)
            alive = b < e
            if not alive.all():
                p, b, e, k, f, s, t = (y[alive] for y in (p, b, e, k, f, s, t))
        return
    bits = np.unpackbits(data)
    ends_left = np.zeros(len(counts), np.int64)
    alive, step, band = np.arange(len(counts)), 0, np.arange(64)
    while len(alive := alive[counts[alive] > step]):
        rows = order[begins[alive] + step]
        v = coefs[rows]
        inside = (band >= first[alive, None]) & (band <= last[alive, None])
        old = (v != 0) & inside
        zero_rank = np.cumsum(inside & ~old, axis=1)
        fix_rank = np.cumsum(old, axis=1) - old
        base = p[alive].copy()  # the bit of the correction with rank 0, if it followed at once
        fix_base = np.zeros(v.shape, np.int64)
        k, used = first[alive].copy(), np.zeros(len(alive), np.int64)
        todo = np.flatnonzero(ends_left[alive] == 0)
        fix_base[:] = base[:, None]
        pos = base
        while len(todo):
            symbol, length, x = symbols(pos[todo], table_of[alive[todo]])
            run, size = symbol >> 4, symbol & 15
            end = (size == 0) & (run < 15)
            pos[todo] += length + np.where(end, run, size)
            sign = (x << length.astype(U)) >> U(63)
            more = ((x << length.astype(U)) >> U(1) >> (63 - run).astype(U)).view(np.int64)
            ends_left[alive[todo[end]]] = (1 << run[end]) + more[end]
            # from here on corrections count from the new place
            fix_base[todo] = np.where(band >= k[todo, None], (pos[todo] - used[todo])[:, None], fix_base[todo])
            go = np.flatnonzero(~end)
            todo, run, size, sign = todo[go], run[go], size[go], sign[go]
            if not len(todo):
                break
            before = np.where(k[todo] > 0, zero_rank[todo, np.maximum(k[todo] - 1, 0)], 0)
            at = np.argmax(zero_rank[todo] == (before + run + 1)[:, None], axis=1)
            passed = fix_rank[todo, at] - used[todo]
            pos[todo] += passed
            used[todo] += passed
            put = size > 0
            v[todo[put], at[put]] = np.where(sign[put] > 0, 1 << al, -(1 << al))
            k[todo] = at + 1
            todo = todo[k[todo] <= last[alive[todo]]]
        p[alive] = pos + old.sum(1) - used
        ends_left[alive] = np.maximum(ends_left[alive] - 1, 0)
        r, c = np.nonzero(old)
        bit = bits[fix_base[r, c] + fix_rank[r, c]].astype(np.int32) << al
        v[r, c] += np.where(v[r, c] > 0, bit, -bit)
        coefs[rows] = v
        step += 1


@cache
def inverse_transform() -> np.ndarray:
    """The matrix that takes 64 coefficients in zigzag order to 64 pixels."""
    x, u = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, 0.5**0.5, 1) / 2
    return np.einsum("xu,yv->uvxy", one, one).reshape(64, 64)[ZIGZAG]


def rgb_tensors(coefs: np.ndarray, images: list) -> list[np.ndarray]:
    """Full-resolution RGB (height, width, 3) of each image; images of one column or row of units are transformed together."""
    scale = np.ones(coefs.shape, np.int32)
    uniform = all((c.q == 1).all() for _, _, comps in images for c in comps)
    if not uniform:
        for _, _, comps in images:
            for c in comps:
                scale[c.base : c.base + c.wide * c.high] = c.q
    pixels = np.empty(coefs.shape, np.uint8)
    for a in range(0, len(coefs), 1 << 14):
        part = coefs[a : a + (1 << 14)]
        # far more than the rounding of a sum, far less than a level: exact halves round alike in any batch
        pixels[a : a + (1 << 14)] = np.clip(np.floor((part if uniform else part * scale[a : a + (1 << 14)]) @ inverse_transform() + 128.5 + 1e-7), 0, 255)
    out = []
    for width, height, comps in images:
        hmax, vmax = max(c.h for c in comps), max(c.v for c in comps)
        planes = []
        for c in comps:
            plane = pixels[c.base : c.base + c.wide * c.high].reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.high, 8 * c.wide)
            if c.v < vmax:
                plane = np.repeat(plane, vmax // c.v, 0)
            if c.h < hmax:
                plane = np.repeat(plane, hmax // c.h, 1)
            planes.append(plane[:height, :width])
        if len(planes) == 1:
            out.append(np.repeat(planes[0][..., None], 3, 2))
            continue
        y, cb, cr = (x.astype(np.int32) for x in planes)
        cb -= 128
        cr -= 128
        rgb = np.empty((height, width, 3), np.uint8)  # 16-bit fixed point
        rgb[..., 0] = np.clip(y + ((91881 * cr + 32768) >> 16), 0, 255)
        rgb[..., 1] = np.clip(y - ((22554 * cb + 46802 * cr + 32768) >> 16), 0, 255)
        rgb[..., 2] = np.clip(y + ((116130 * cb + 32768) >> 16), 0, 255)
        out.append(rgb)
    return out


def payloads(coefs: np.ndarray, images: list, sizes: list[int]) -> list[bytes]:
    """The payloads of stored files of these sizes in bytes."""
    data = (coefs + SHIFT).astype(np.uint8)
    out = []
    for (_, _, comps), n in zip(images, sizes, strict=True):
        width = comps[2].wide
        parts = []
        for c in comps:
            x = data[c.base : c.base + c.wide * c.high].reshape(-1, c.v, width, c.h, 64).transpose(0, 2, 1, 3, 4)
            parts.append(x.reshape(-1, c.v * c.h, 64))
        out.append(np.concatenate(parts, 1).tobytes()[:n])
    return out


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes and media (a progressive JPEG file) of each row of docs (doc_id, text)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
                filled = [payload_of(x) for x in texts]
                cells = [batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(len, filled)), pa.int64()), pa.array(store(filled), pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "n_bytes", "payload_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, media binary")


def features(stored: DataFrame, tensors: bool = False) -> DataFrame:
    """What the stored bytes hold, decoded: digests of the payload and the file, and `feature`, the size, mean colour and checksum of the RGB tensor; tensors: height, width and rgb too."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", height int, width int, rgb binary" * tensors
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "media", 1 << 19):
                ids, n_bytes, sizes, files = (c.to_pylist() for c in batch.columns)
                coefs, images = decode_coefficients(files)
                rgb = rgb_tensors(coefs, images)
                back = payloads(coefs, images, sizes)
                cells = [ids, n_bytes, sizes, [hashlib.sha256(x).hexdigest() for x in back], [zlib.crc32(x[-32:]) for x in back], list(map(len, files)), [hashlib.sha256(x).hexdigest() for x in files]]
                cells.append([f"{x.shape[1]}x{x.shape[0]} {' '.join(f'{m:.3f}' for m in x.reshape(-1, 3).mean(0, dtype=np.float64))} {zlib.crc32(x.tobytes()):08x}" for x in rgb])
                if tensors:
                    cells += [[x.shape[0] for x in rgb], [x.shape[1] for x in rgb], [x.tobytes() for x in rgb]]
                types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=names)

    return stored.select("doc_id", "n_bytes", "payload_bytes", "media").mapInArrow(run, fields)
