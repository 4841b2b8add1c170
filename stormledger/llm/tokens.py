"""Token ids by the tokenizers library, for whole columns.

Both pre-tokenizers used here never join characters across a run of blanks, so a text's ids are the ids of its
chunks (a space with what follows up to the next one) one after another. Arrow cuts a batch of texts at spaces and finds
its distinct chunks; each of them goes through the library's normalizer and each distinct pre-token through its BPE
model once per worker. A line's end is a chunk of its own. A text with two blanks in a row, or one at its end, is cut by CHUNK
instead (blanks of a run stay together there). Where blanks are dropped, texts are also cut at line ends and between a letter
and a mark after it, and ASCII letters are made small, so that fewer chunks are distinct; chunks of letters alone skip the
normalizer and go to the model at once. Tests hold the result against encoding whole texts.
"""

from __future__ import annotations

import gc
import json
import os
import re
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: What the pre-tokenizers take as white space (a fixed value).
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
#: Stands for a line's end between two chunks while Arrow cuts at spaces.
NEWLINE = "\ue001"
#: How byte-level BPE cuts a text where its file names no pattern (a fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Of each byte: 1 for a blank, 2 for a letter, 3 for a mark, none of which follows a letter in a special token (ASCII alone).
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(9, 14), 32]], KINDS[[*range(65, 91), *range(97, 123)]], KINDS[list(b".,;:!?'\"()[]{}-/")] = 1, 2, 3
#: Each byte with A-Z made small.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: What cutting at marks and making letters small relies on: the pattern and the normalizers of word_bpe_49k.json.
FOLDED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", ["NFC", "Replace", "Lowercase"]
#: Distinct chunks that a worker remembers (some 200 bytes each); past it only the first half stays, where the frequent ones are.
CACHE = 600_000
#: Pre-tokens that it remembers where it drops blanks.
PIECES = 100_000


def byte_letters() -> list[str]:
    """The letter by which byte-level BPE writes each byte: itself if it prints, else one from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class ChunkEncoder:
    """ids of texts; blanks=False for a tokenizer that drops white space and case as word_bpe_49k.json does."""

    def __init__(self, path: str, blanks: bool = True, limit: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.blanks, self.limit = Tokenizer.from_file(path), blanks, limit
        spec = json.loads(self.tokenizer.to_str())
        steps = (pre := spec["pre_tokenizer"]).get("pretokenizers", [pre])
        own = next((x["pattern"]["Regex"] for x in steps if x["type"] == "Split"), None)
        if not blanks and (own, [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]) != FOLDED:
            raise ValueError(f"{path} does not drop blanks and case as word_bpe_49k.json does")
        self.split = regex.compile(own or BYTE_LEVEL).findall
        self.letters = dict(enumerate(byte_letters()))
        self.odd = re.compile(f"[{BLANK}<\ue000]").search
        special = "|".join(re.escape(x["content"]) for x in spec["added_tokens"])
        self.special = re.compile(special.encode(), re.IGNORECASE).search if special else lambda data: None
        self.known = pa.array([], pa.string())  # instead of index where blanks are dropped: a few bytes a chunk
        self.index, self.starts, self.sizes, self.flat = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.drop_pieces()

    def drop_pieces(self):
        """Forget pre-tokens; the chunks made of them stay known."""
        self.pieces, self.piece_ids = {}, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _forget(self):
        half = self.limit // 2
        self.index = dict(islice(self.index.items(), half))
        self.known = pa.concat_arrays([self.known.slice(0, half)])
        starts, sizes = self.starts[:half], self.sizes[:half]
        self.flat = self.flat[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
        self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes
        self.drop_pieces()

    def _plain(self, chunk: str) -> bool:
        """Whether the chunk can be cut together with others: no blank but a leading space, no part of a special token."""
        return not self.odd(chunk, chunk[:1] == " ") and chunk not in ("", " ")

    def _ids(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def _cut(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each plain chunk has, and the ids; all are normalised and cut in one go, with a mark between them."""
        mark = "\n" if self.blanks else "\ue000"
        joined = (mark if self.blanks else f" {mark} ").join(chunks)
        if self.tokenizer.normalizer:
            joined = self.tokenizer.normalizer.normalize_str(joined)
        found = self.split(joined)
        at = list(map(self.pieces.get, found))
        if None in at:
            new = list(dict.fromkeys(p for p, x in zip(found, at, strict=True) if x is None and p != mark))
            tokenize, letters = self.tokenizer.model.tokenize, self.letters
            got = [[t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))] for p in new]
            self.pieces.update(zip(new, range(len(self.pieces), len(self.pieces) + len(new)), strict=True))
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
            starts = len(self.piece_ids[2]) + np.cumsum(sizes) - sizes
            self.piece_ids = tuple(np.concatenate(x) for x in zip(self.piece_ids, (starts, sizes, flat), strict=True))
            at = [self.pieces.get(p, -1) if x is None else x for p, x in zip(found, at, strict=True)]
        at = np.array(at, np.int64)
        starts, sizes, flat = self.piece_ids
        whose = np.cumsum(at < 0)[at >= 0]
        at = at[at >= 0]
        n = sizes[at]
        ids = flat[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        return np.bincount(whose, n, len(chunks)).astype(np.int64), ids

    def _learn(self, chunks: list[str]) -> None:
        """Keep the ids of new chunks."""
        if self.blanks:
            self.index.update(zip(chunks, range(len(self.index), len(self.index) + len(chunks)), strict=True))
        else:
            self.known = pa.concat_arrays([self.known, pa.array(chunks, pa.string())])
        plain = np.fromiter(map(self._plain, chunks), bool, len(chunks))
        sizes = np.zeros(len(chunks), np.int64)
        parts, cut = np.zeros(0, np.uint32), [c for c, ok in zip(chunks, plain, strict=True) if ok]
        if cut:
            sizes[plain], parts = self._cut(cut)
        rest = np.flatnonzero(~plain)
        got = [self._ids(chunks[k]) for k in rest]
        sizes[rest] = list(map(len, got))
        starts = np.zeros(len(chunks), np.int64)  # the ids of plain chunks come first
        starts[plain] = np.cumsum(sizes[plain]) - sizes[plain]
        starts[rest] = len(parts) + np.cumsum(sizes[rest]) - sizes[rest]
        self.starts = np.concatenate([self.starts, len(self.flat) + starts])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, parts, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes[rest].sum()))])

    def _places(self, chunks: list[str]) -> np.ndarray:
        """Where the ids of each chunk are kept; new chunks are encoded."""
        index = self.index
        at = list(map(index.get, chunks))
        if None in at:
            new = list(dict.fromkeys(c for c, x in zip(chunks, at, strict=True) if x is None))
            self._learn(new)
            at = [index[c] if x is None else x for c, x in zip(chunks, at, strict=True)]
        return np.array(at, np.int64)

    def _learn_letters(self, words: pa.Array) -> None:
        """Keep the ids of new chunks of ASCII letters alone: each is one pre-token, and its letters stand for themselves."""
        self.known = pa.concat_arrays([self.known, words])
        tokenize = self.tokenizer.model.tokenize
        got = [[t.id for t in tokenize(w)] for w in pc.ascii_lower(words).to_pylist()]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))])

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks of texts without their ASCII blanks, and the number of the first chunk of each text (and of all).

        They end at blanks and between a letter and a mark. A letter before a byte beyond ASCII keeps its case, as the
        normalizer composes first; all do where making them small could make a special token.
        """
        if not len(texts):
            return pa.array([], pa.string()), np.zeros(1, np.int64)
        _, at, data = texts.buffers()
        offsets = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kinds = KINDS[data]
        solid = kinds != 1
        first = solid.copy()
        first[1:] &= (kinds[:-1] == 1) | ((kinds[:-1] == 2) & (kinds[1:] == 3))
        begins = offsets[:-1][offsets[:-1] < len(data)]
        first[begins] |= solid[begins]
        if self.special(data) is None:
            low = np.append(data[1:] < 128, True)[: len(data)]
            data = np.where(low, LOWER[data], data)
        first_at = np.flatnonzero(first)
        ends = np.append(np.cumsum(solid, dtype=np.int32)[first_at] - 1, solid.sum()).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(first_at), [None, pa.py_buffer(ends), pa.py_buffer(data[solid])])
        return words, np.searchsorted(first_at, offsets)

    def _places_of(self, words: pa.Array) -> np.ndarray:
        """The same for distinct words of an Arrow array, without a Python string for those that are known."""
        at = pc.index_in(words, value_set=self.known)
        if at.null_count:
            gone = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
            new = words.take(pa.array(gone))
            letters = pc.ascii_is_alpha(new)
            others = np.flatnonzero(~letters.to_numpy(zero_copy_only=False))
            at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at[np.delete(gone, others)] = np.arange(len(self.known), len(self.known) + len(gone) - len(others))
            self._learn_letters(new.filter(letters))
            at[gone[others]] = np.arange(len(self.known), len(self.known) + len(others))
            self._learn(new.take(pa.array(others)).to_pylist())
            if len(self.pieces) > PIECES:
                self.drop_pieces()
            return at
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has; end is appended to each text unless None."""
        if max(len(self.index), len(self.known)) > self.limit:
            self._forget()
        gc.disable()  # nothing here makes cycles, and the memory of chunks is long to walk
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        if self.blanks:
            odd = pc.or_(pc.match_substring_regex(texts, f"[ \n] |[ \n]\n|\n[{BLANK}]|{NEWLINE}"), pc.match_substring_regex(texts, "[ \n]$"))
            odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            texts_left = pc.replace_substring(pc.if_else(odd, "", texts) if len(odd_at) else texts, "\n", f" {NEWLINE} ")
        else:
            odd_at, texts_left = [], texts
        if self.blanks:
            lists = pc.split_pattern(texts_left, " ")
            words, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            bounds -= bounds[0]
            del lists
        else:
            words, bounds = self._chunks(texts_left)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        if self.blanks:
            found = coded.dictionary.to_pylist()
            at = self._places([" " + w for w in found])[codes]
        else:
            found, at = None, self._places_of(coded.dictionary)[codes]
        if self.blanks and len(texts):  # the first chunk of a text or line has no space before it
            firsts = bounds[:-1]
            if NEWLINE in found:
                newlines = np.flatnonzero(codes == found.index(NEWLINE))
                at[newlines] = self._places(["\n"])
                firsts = np.concatenate([firsts, newlines + 1])
            at[firsts] = self._places(words.take(pa.array(firsts)).to_pylist())
        del words, coded, found, codes
        for k in reversed(list(odd_at)):
            own = self._places(CHUNK.findall(texts[k].as_py()))
            at = np.concatenate([at[: bounds[k]], own, at[bounds[k + 1] :]])
            bounds[k + 1 :] += len(own) - (bounds[k + 1] - bounds[k])
        sizes = self.sizes[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat((self.starts[at] - total[:-1]).astype(np.int32), sizes)  # a batch and the memory are far below 2**31 ids
        place += np.arange(len(place), dtype=np.int32)
        ids = self.flat[place]
        bounds = total[bounds]
        n = np.diff(bounds)
        if end is not None:
            ids, n = np.insert(ids, bounds[1:], np.uint32(end)), n + 1
        gc.enable()
        return ids, n


@cache
def encoder_of(path: str, blanks: bool, limit: int = CACHE) -> ChunkEncoder:
    """One encoder for all tasks of a Python worker."""
    return ChunkEncoder(path, blanks, limit)


def slices(batch: pa.RecordBatch, column: str, limit: int = 16 << 20):
    """The batch in parts whose texts have about limit bytes, so that what is derived from them stays bounded."""
    sizes = np.zeros(batch.num_rows, np.int64)
    col = batch.column(batch.schema.get_field_index(column))
    if batch.num_rows:
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def binary_array(data: bytes, bounds: np.ndarray) -> pa.Array:
    """Slices of data as one Arrow column of binaries (32-bit offsets: under 2 GiB a batch)."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def token_column(docs, path: str, blanks: bool = True, end: int = 0, width: int = 2):
    """doc_id, n_tokens and ids (little-endian unsigned integers of `width` bytes) of every row; null text is empty."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches):
        encoder = encoder_of(path, blanks)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, n = encoder.encode(batch.column(1), end)
                bounds = np.concatenate([[0], np.cumsum(n)]) * width
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), binary_array(ids.astype(kind).tobytes(), bounds)], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")
