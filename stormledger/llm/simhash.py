"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked exactly within a radius by tiled comparison.

Fingerprints are made where the texts are read. Equal ones are one class. Of `radius + 1` bands of the 64 bits, two
fingerprints within the radius have at least one in common, so classes are grouped by band value; the groups hold tiles
of at most TILE classes, and each pair of a group's tiles is compared by numpy exclusive-or and bit counts, unless their
population counts differ beyond the radius. A group larger than a tile is dealt over the tasks by its pairs of tiles, so
no task holds more than two tiles of it. A task returns a forest of the links that it finds, not all of them.

At a shingle Jaccard of 0.8 two fingerprints differ in about ten bits, for which exact bands would be too narrow. So
similar_texts() adds keys of BANDS bands of ROWS minima of the hashed shingles (a pair at 0.8 shares one with probability
0.9996, at 0.9 all but surely). First each text meets the two ends of its bucket in one of ORDERS orders, two pairs a text, and
every pair is checked on its shingles. Then, in the buckets that still hold several groups, all texts outside a bucket's largest
group meet all of its texts, in tiles of some TILE_SHINGLES shingles, by products of their incidence matrices: no link between
texts with a common key is lost. That costs the square of what a bucket holds outside its largest group.

Nulls: a null or blank text has fingerprint zero, a class like any other. A null doc_id is ignored when the smallest
doc_id of a component is taken. Repeated rows are members each. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, written
from .components import components

WORDS, SEED, RADIUS, TILE = 3, 42, 2, 2048
SIMILAR_WORDS, SIMILARITY, BANDS, ROWS, ORDERS = 5, 0.8, 20, 5, 4
TILE_SHINGLES = 1 << 18
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of the text, A-Z in lower case; a shorter text is one shingle, a blank one has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = list(accumulate(len(p) + 1 for p in parts))
    if len(parts) <= words:
        return [digest(joined, seed)]
    return [digest(joined[a:b], seed) for a, b in zip([0, *ends], [e - 1 for e in ends[words - 1 :]])]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of `counts` hashes: a bit is set if over half of the run has it."""
    out = np.zeros(len(counts), np.uint64)
    if not len(hashes):
        return out
    some = np.flatnonzero(counts)
    first = (np.cumsum(counts) - counts)[some]
    half = counts[some]
    for k in range(64):
        ones = np.add.reduceat(((hashes >> np.uint64(k)) & np.uint64(1)).astype(np.int32), first)
        out[some] |= (2 * ones > half).astype(np.uint64) << np.uint64(k)
    return out


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words: int = WORDS, seed: int = SEED) -> DataFrame:
    """keep and `fp`, the fingerprint as a signed 64-bit integer, of each row of docs (text)."""
    chosen = docs.select(*keep, F.col("text").alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            got, counts = [], []
            fps = []

            def flush():
                fps.append(majority(np.fromiter(got, np.uint64, len(got)), np.array(counts, np.int64)))
                got.clear()
                counts.clear()

            for x in batch.column(batch.num_columns - 1):
                hashes = shingle_hashes(x.as_py(), words, seed)
                got += hashes
                counts.append(len(hashes))
                if len(got) > 1 << 18:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(fps).view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return chosen.mapInArrow(run, f"{fields}fp long")


def bands(radius: int = RADIUS) -> list[tuple[int, int]]:
    """First bit and width of radius + 1 bands of the 64 bits."""
    n = radius + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return list(zip(cuts[:-1], [b - a for a, b in zip(cuts[:-1], cuts[1:])]))


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Where of two tiles the fingerprints differ in at most radius bits."""
    return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least reachable index of each of n nodes, by links a[i], b[i]."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def tile_links(fps: np.ndarray, groups: np.ndarray, tiles: np.ndarray, pair: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (later, earlier) of the rows of a task, which are sorted by group and pair of tiles; all of one such block are compared.

    pair is -1 in a group of one tile, else first tile << 32 | second tile; then only rows of different tiles are compared
    unless both tiles are the same.
    """
    out_a, out_b = [], []
    change = np.flatnonzero(np.diff(groups) | np.diff(pair)) + 1 if len(fps) > 1 else np.zeros(0, np.int64)
    cuts = np.concatenate([[0], change, [len(fps)]])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if hi - lo < 2:
            continue
        part = fps[lo:hi]
        if pair[lo] >= 0 and pair[lo] >> 32 != pair[lo] & 0xFFFFFFFF:
            first = tiles[lo:hi] == pair[lo] >> 32
            sides = [part[first], part[~first]]
        else:
            sides = [part, part]
        sides = [s[np.argsort(np.bitwise_count(s), kind="stable")] for s in sides]
        pops = [np.bitwise_count(s).astype(int) for s in sides]
        base = [0, 0 if sides[0] is sides[1] else len(sides[0])]
        nodes = sides[0] if len(sides[0]) == hi - lo else np.concatenate(sides)
        same, step, pairs = len(sides[0]) == hi - lo, 256, []
        if same:
            base = [0, 0]
        for i in range(0, len(sides[0]), step):
            a, pa_ = sides[0][i : i + step], pops[0][i : i + step]
            j0, j1 = np.searchsorted(pops[1], [pa_[0] - radius, pa_[-1] + radius + 1])  # the rest differs in population count
            j0 = max(j0, i) if same else j0
            for j in range(int(j0), int(j1), TILE):
                x, y = close_pairs(a, sides[1][j : min(j + TILE, int(j1))], radius)
                x, y = x + i + base[0], y + j + base[1]
                pairs.append((x[x != y], y[x != y]))
        if pairs:
            root = forest(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), len(nodes))
            at = np.flatnonzero(root != np.arange(len(nodes)))
            out_a.append(nodes[at])
            out_b.append(nodes[root[at]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between different fingerprints of classes (fp, distinct) that connect what is within the radius."""
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for k, (at, width) in enumerate(bands(radius))])
    keyed = classes.select("fp", F.explode(keys).alias("key")).select("fp", F.col("key.band").alias("band"), F.col("key.value").alias("value"))
    sizes = keyed.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    tiles_of = F.ceil(F.col("n") / tile).cast("int")
    placed = keyed.join(sizes, ["band", "value"]).withColumn("tiles", tiles_of).withColumn("tile", F.pmod(F.xxhash64("fp", "band"), F.col("tiles")).cast("int"))
    # pairs of tiles with this row's one: (t, tile) for t <= tile and (tile, t) for t > tile
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.shiftleft(F.least(t, F.col("tile")).cast("long"), 32).bitwiseOR(F.greatest(t, F.col("tile")).cast("long")))
    spread = placed.select("fp", "band", "value", "tile", F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(-1).cast("long"))).otherwise(pair)).alias("pair"))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.select("fp", F.shiftleft(F.col("band").cast("long"), 60).bitwiseOR(F.col("value")).alias("group"), "tile", "pair").repartition(parts, "group", "pair").sortWithinPartitions("group", "pair")

    def run(batches):
        held = None

        def found(t):
            fps, groups, tiles, pair = (t.column(c).to_numpy() for c in ("fp", "group", "tile", "pair"))
            a, b = tile_links(fps.view(np.uint64), groups, tiles, pair, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = held.slice(held.num_rows - 1)
            groups, pair = held.column("group").to_numpy(), held.column("pair").to_numpy()
            ended = int(np.flatnonzero((groups == last.column("group")[0].as_py()) & (pair == last.column("pair")[0].as_py()))[0]) if held.num_rows else 0
            if ended:  # the last block may go on in the next batch
                yield found(held.slice(0, ended).combine_chunks())
                held = held.slice(ended)
        if held is not None and held.num_rows:
            yield found(held.combine_chunks())

    return dealt.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), radius: int = RADIUS, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """keep, fp and component_id (the smallest doc_id reachable, itself included) of each row of docs (doc_id, text)."""
    rows = written(fingerprints(docs, tuple(dict.fromkeys(("doc_id", *keep))), words, seed), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    roots = components(links(classes.select("fp"), radius))
    joined = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.select("fp", "root").join(firsts, "root").select("fp", "component_id")
    # AQE splits a hot class
    return rows.join(named, "fp").select(*keep, "fp", "component_id")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band from the least products of the hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * FACTORS).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * FACTORS[0]
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def text_keys():
    """A 128-bit key of a text as columns h and g; a null text has one too."""
    return [F.xxhash64("text", F.lit(k)).alias(name) for k, name in ((3, "h"), (4, "g"))]


def similar_texts(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(node, root) of each distinct text of docs (text) with a similar one: keys (h, g), root being the least of its group.

    Texts are linked if the Jaccard similarity of their sets of shingles is at least `similarity`; blank texts are all alike.
    """
    chosen = docs.select(*text_keys(), "text")

    def sketch(batches):
        for batch in batches:
            fps, sizes, keys, got, counts = [], [], [], [], []

            def flush():
                if counts:
                    fps.append(majority(np.concatenate(got), np.array(counts, np.int64)))
                got.clear()
                counts.clear()

            held = 0
            for x in batch.column(2):
                hashes = np.array(shingle_hashes(x.as_py(), words, seed), np.uint64)
                got.append(hashes)
                counts.append(len(hashes))
                sizes.append(len(np.unique(hashes)))
                keys.append(band_keys(hashes))
                held += len(hashes)
                if held > 1 << 18:
                    flush()
                    held = 0
            flush()
            none = np.zeros(0, np.int64)
            bands_ = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([none, *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([none.view(np.uint64), *fps]).view(np.int64)), pa.array(sizes, pa.int32()), bands_], names=["h", "g", "fp", "size", "bands"])
        give_back()

    rows = chosen.mapInArrow(sketch, "h long, g long, fp long, size int, bands array<long>")
    nodes = written(rows.groupBy("h", "g").agg(*(F.any_value(c).alias(c) for c in ("fp", "size", "bands"))).select(F.struct("h", "g").alias("node"), "fp", "size", "bands"), "texts")
    me = F.struct("node", "size").alias("x")
    keyed = nodes.select(me, F.posexplode("bands").alias("band", "key"))
    keyed = keyed.withColumn("y", F.struct(F.xxhash64("x.node", F.col("band") % ORDERS).alias("order"), "x"))
    buckets = keyed.groupBy("key").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count("*").alias("n")).where("n > 1").select("key", F.explode(F.array("low.x", "high.x")).alias("z"))
    pairs = keyed.join(buckets, "key").select("x", "z")
    classes = written(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("z"), F.count("*").alias("n")), "classes")
    pairs = pairs.unionByName(nodes.select("fp", me).join(classes.where("n > 1").select("fp", "z"), "fp").select("x", "z"))
    linked = links(classes.select("fp"), radius).join(classes.select(F.col("fp").alias("a"), F.col("z").alias("x")), "a").join(classes.select(F.col("fp").alias("b"), "z"), "b")
    pairs = pairs.unionByName(linked.select("x", "z")).where((F.col("x.node") != F.col("z.node")) & (F.least("x.size", "z.size") >= F.greatest("x.size", "z.size") * similarity))
    pairs = written(pairs.select(F.greatest("x.node", "z.node").alias("a"), F.least("x.node", "z.node").alias("b")).distinct(), "candidates")

    def shingles(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(np.array(shingle_hashes(x.as_py(), words, seed), np.uint64)).view(np.int64) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["h", "g", "shingles"])
        give_back()

    wanted = keyed.join(buckets.select("key").distinct(), "key", "left_semi").select("x.node.h", "x.node.g").unionByName(pairs.select(F.col("a.h").alias("h"), F.col("a.g").alias("g"))).unionByName(pairs.select("b.h", "b.g")).distinct()
    sets = chosen.join(wanted, ["h", "g"], "left_semi").select("h", "g", "text").mapInArrow(shingles, "h long, g long, shingles array<long>")
    sets = written(sets.groupBy("h", "g").agg(F.any_value("shingles").alias("shingles")).select(F.struct("h", "g").alias("node"), "shingles"), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("common"), (F.size("s") + F.size("t")).alias("total"))
    found = written(both.where(F.col("common") >= (F.col("total") - F.col("common")) * similarity).select("a", "b"), "similar")
    first = components(found)
    in_buckets = keyed.join(buckets.select("key").distinct(), "key", "left_semi").select("key", "x.node", "x.size")
    return components(found.unionByName(across(in_buckets, first, sets, similarity)))


def across(in_buckets: DataFrame, groups: DataFrame, sets: DataFrame, similarity: float, tile: int = TILE_SHINGLES) -> DataFrame:
    """Links (a, b) of similar texts of a bucket that are not yet in one group, as a forest a pair of tiles.

    in_buckets: (key, node, size); groups: (node, root), a node without a row being its own; sets: (node, shingles).
    """
    placed = in_buckets.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("groups"), F.sum("shingles").alias("all"), F.max_by("shingles", F.struct("n", "root")).alias("most")).where("groups > 1")
    parts = lambda total: F.greatest(F.lit(1), F.ceil(total / tile)).cast("long")
    mixed = mixed.select("key", F.col("top.root").alias("top"), parts(F.col("all") - F.col("most")).alias("rows"), parts(F.col("all")).alias("columns"))
    dealt = placed.join(mixed, "key").withColumn("hash", F.xxhash64("node", F.lit("tile")))
    at = lambda n: F.pmod("hash", n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    one = dealt.where("root <> top").select("key", at(F.col("rows")).alias("i"), every(F.col("columns")).alias("j"), F.lit(0).alias("side"), "node")
    two = dealt.select("key", at(F.col("columns")).alias("j"), every(F.col("rows")).alias("i"), F.lit(1).alias("side"), "node")
    tiles = one.unionByName(two).join(sets, "node").select("key", "i", "j", "side", F.col("node.h").alias("h"), F.col("node.g").alias("g"), "shingles")

    def run(batches):
        now, held = None, ([], [])
        for batch in batches:
            keys, sides = list(zip(*(batch.column(k).to_pylist() for k in range(3)))), batch.column(3).to_pylist()
            nodes = list(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()))
            values, ends = batch.column(6).flatten().to_numpy(), np.cumsum(batch.column(6).value_lengths().to_numpy())
            start = 0
            for key, side, node, end in zip(keys, sides, nodes, ends.tolist()):
                if key != now:
                    yield from as_links(similar_pairs(*held, similarity))
                    now, held = key, ([], [])
                held[side].append((node, values[start:end].copy()))
                start = end
        yield from as_links(similar_pairs(*held, similarity))
        give_back()

    # a tile pair is in one task, one after the other
    rows = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "ah long, ag long, bh long, bg long")
    return written(rows.select(F.struct(F.col("ah").alias("h"), F.col("ag").alias("g")).alias("a"), F.struct(F.col("bh").alias("h"), F.col("bg").alias("g")).alias("b")).distinct(), "across")


def as_links(pairs: list) -> list[pa.RecordBatch]:
    columns = zip(*[(*a, *b) for a, b in pairs]) if pairs else []
    return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["ah", "ag", "bh", "bg"])] if pairs else []


def similar_pairs(rows: list, columns: list, similarity: float) -> list:
    """A forest of the pairs of a row and a column (node, its different shingles) that are similar."""
    if not rows or not columns:
        return []
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    sizes = np.array([len(s) for _, s in columns])
    # shingles that rows and columns have in common, numbered; only they count, and some at a time
    known = np.intersect1d(np.unique(np.concatenate([s for _, s in rows])), np.unique(np.concatenate([s for _, s in columns])))
    width = max(1, (1 << 22) // (len(rows) + len(columns)))
    common = np.zeros((len(rows), len(columns)), np.float32)  # exact up to 2^24 shingles
    for low in range(0, len(known), width):
        part = known[low : low + width]
        common += incidence([s for _, s in rows], part) @ incidence([s for _, s in columns], part).T
    for k, (node, mine) in enumerate(rows):
        for j in np.flatnonzero(common[k] >= (len(mine) + sizes - common[k]) * similarity).tolist():
            a, b = root(node), root(columns[j][0])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((node, columns[j][0]))
    return out


def incidence(sets: list, part: np.ndarray) -> np.ndarray:
    """Which of the sorted shingles `part` each set has."""
    out = np.zeros((len(sets), len(part)), np.float32)
    for k, s in enumerate(sets):
        at = np.searchsorted(part, s)
        hit = at[at < len(part)][part[at[at < len(part)]] == s[at < len(part)]]
        out[k, hit] = 1
    return out
