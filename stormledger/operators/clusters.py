"""Complete-link blocks of places, holdouts of whole blocks, and embargoes that relax until enough is left."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormledger.functions.columns import haversine_km
from stormledger.operators.components import checkpointed, written
from stormledger.operators.joins import around, near_pairs, places
from stormledger.sources.storage import shared_folder


def complete_link(points: DataFrame, key: str, max_km: float, by: Column | None = None, tie: str = "hash") -> DataFrame:
    """key and block of each row of points (key, lat, lon): the least key of its cluster, in which no two are more than max_km apart; by: what keeps clusters apart.

    Agglomeration in rounds: each cluster's nearest other one is a partial minimum, and clusters that are each other's
    nearest join. Of complete link that gives the clusters of joining one pair at a time, since a cluster that grows comes nearer to none. The
    distance of two that have grown is the greatest of those between their parts, and is lost if one of those was beyond max_km. Equal
    distances (to nine digits) go by a digest of the two clusters' names, or by the names (tie="id"). Points of one place join
    first. Pairs follow local density; the rounds are as many as a chain of ever nearer clusters is long, mostly some log n. A
    row without a place is a block of its own.
    """
    rows = points.select(F.col(key).alias("id"), (F.lit("") if by is None else by.cast("string")).alias("type"), "lat", "lon")
    whole = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    spots = checkpointed(rows.where(whole).groupBy("type", "lat", "lon").agg(F.min("id").alias("event_id")))
    near = near_pairs(spots.withColumn("ts", F.timestamp_micros(F.lit(0))), max_km + 1e-6, 1.0).where(F.col("km") <= max_km + 1e-9)
    one = F.lit(1).cast("long")
    folder, k = f"{shared_folder(points.sparkSession)}/links-{uuid.uuid4().hex}", 0
    d = written(near.select(F.col("event_id_a").alias("a"), F.col("event_id_b").alias("b"), "km", one.alias("n"), one.alias("size_a"), one.alias("size_b")), f"{folder}/0")
    joined = None
    while not d.isEmpty():
        name = F.concat_ws("|", "a", "b")
        rank = F.struct(F.round("km", 9).alias("km"), (F.sha2(name, 256) if tie == "hash" else name).alias("tie"))
        both = d.select(F.col("a").alias("x"), F.col("b").alias("y"), rank.alias("rank"), (F.col("size_a") + F.col("size_b")).alias("size"))
        best = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"), "rank", "size")).groupBy("x").agg(F.min(F.struct("rank", "y", "size")).alias("best"))
        chosen = best.select("x", F.col("best.y").alias("y"), F.col("best.size").alias("size"))
        pair = chosen.alias("p").join(chosen.alias("q"), (F.col("p.x") == F.col("q.y")) & (F.col("p.y") == F.col("q.x")) & (F.col("p.x") < F.col("p.y")))
        pair = checkpointed(pair.select(F.col("p.x").alias("a"), F.col("p.y").alias("b"), F.col("p.size").alias("size")))
        joined = pair.select("a", "b") if joined is None else joined.unionByName(pair.select("a", "b"))
        renamed = pair.select(F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"), "size")
        for c in ("a", "b"):
            d = d.join(renamed.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}"), F.col("size").alias(f"grown_{c}")), c, "left")
        ends = [F.coalesce(f"new_{c}", c) for c in ("a", "b")]
        sizes = [F.coalesce(f"grown_{c}", f"size_{c}") for c in ("a", "b")]
        turned = ends[0] > ends[1]
        d = d.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"), "km", "n", F.when(turned, sizes[1]).otherwise(sizes[0]).alias("size_a"), F.when(turned, sizes[0]).otherwise(sizes[1]).alias("size_b")).where("a <> b")
        d = d.groupBy("a", "b").agg(F.max("km").alias("km"), F.sum("n").alias("n"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
        d, k = written(d.where("n = size_a * size_b"), f"{folder}/{k + 1}", over=f"{folder}/{k}"), k + 1
    heads = spots.select(F.col("event_id").alias("spot"), F.col("event_id").alias("block"))
    if joined is not None:
        heads = heads_of(heads, checkpointed(joined))
    named = spots.join(heads, F.col("event_id") == F.col("spot")).select("type", "lat", "lon", "block")
    return rows.join(named, ["type", "lat", "lon"], "left").select(F.col("id").alias(key), F.coalesce("block", "id").alias("block"))


def heads_of(heads: DataFrame, joined: DataFrame) -> DataFrame:
    """heads (spot, block) with the block at the end of each chain of joins (b went into a), by doubling the steps."""
    up = joined.select(F.col("b").alias("low"), F.col("a").alias("high"))
    while True:
        higher = up.select(F.col("low").alias("high"), F.col("high").alias("top"))
        longer = checkpointed(up.join(higher, "high", "left").select("low", F.coalesce("top", "high").alias("high"), F.col("top").isNotNull().alias("more")))
        up = longer.select("low", "high")
        if longer.where("more").isEmpty():
            return heads.join(up, F.col("block") == F.col("low"), "left").select("spot", F.coalesce("high", "block").alias("block"))


def holdout(events: DataFrame, block: str, least: int = 2, keep: int = 2, salt: str = "holdout-v1") -> DataFrame:
    """block and events of the whole blocks whose events are closest to a third of all: ties to fewer blocks, then by digest of their names.

    A round a block: the reachable sums are rows (events, blocks), of each one subset, the one of the least digest; a block
    is added to all of them or not. So there are no more rows than sums times blocks. No rows if no subset leaves `keep` blocks and takes `least`.
    """
    sizes = events.where(F.col(block).isNotNull()).groupBy(F.col(block).alias("block")).agg(F.count("*").alias("n"))
    blocks = sizes.orderBy(F.desc("n"), "block").collect()  # a row a block: what a person splits a benchmark by
    spark, total = events.sparkSession, sum(r.n for r in blocks)
    digest = lambda names: F.sha2(F.concat(F.lit(f"{salt}|"), F.array_join(names, "|")), 256)
    states = spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(0).alias("k"), F.array().cast("array<string>").alias("names"))
    for r in blocks:
        more = states.select((F.col("n") + r.n).alias("n"), (F.col("k") + 1).alias("k"), F.array_sort(F.array_append("names", F.lit(r.block).cast("string"))).alias("names"))
        states = checkpointed(states.unionByName(more).groupBy("n", "k").agg(F.min_by("names", digest(F.col("names"))).alias("names")))
    target = max(1, round(total / 3))
    good = states.where((F.col("k") >= least) & (len(blocks) - F.col("k") >= keep) & (F.col("n") > 0) & (F.col("n") < total))
    best = good.orderBy(F.abs(F.col("n") - target), "k", digest(F.col("names"))).limit(1)
    return best.select(F.explode("names").alias(block), F.col("n").alias("events"))


#: Embargoes from the strongest on: kilometres and hours (fixed values), and how many events are to be left.
RUNGS, ENOUGH = ((500.0, 72.0), (350.0, 48.0), (250.0, 24.0), (0.0, 0.0)), 20


def relaxed_embargo(train: DataFrame, held: DataFrame, rungs: tuple = RUNGS, enough: int = ENOUGH) -> DataFrame:
    """train without the events that a held one is near in time and space, by the strongest rung that leaves `enough`, or the last one; `rung` says which (from 0).

    rungs narrow from one to the next, a rung of no distance or no time keeps all. One join by the widest rung gives each event the last rung that still
    bars it; how many are left on each rung are counts of that. An event without a place or time stays.
    """
    far, long = max(r for r, _ in rungs), max(h for _, h in rungs)
    gap = int(long * 3_600_000_000)
    at = lambda df: places(df.withColumn("us", F.unix_micros("ts")), far, gap)
    h = around(at(held.where("lat is not null and lon is not null and ts is not null").select("lat", "lon", "ts")), far, [(d, b) for d in (-1, 0, 1) for b in (-1, 0, 1)])
    h = h.select("band", "slot", "cell", *[F.col(c).alias(f"h{c}") for c in ("lat", "lon", "us")])
    rows = checkpointed(train.withColumn("__id", F.monotonically_increasing_id()))
    met = at(rows.select("__id", "lat", "lon", "ts")).join(h, ["band", "slot", "cell"])
    km, hours = haversine_km(F.col("lat"), F.col("lon"), F.col("hlat"), F.col("hlon")), F.abs(F.col("us") - F.col("hus")) / 3_600_000_000
    barred = [(km <= r) & (hours <= t) if r > 0 and t > 0 else F.lit(False) for r, t in rungs]
    last = F.greatest(F.lit(-1), *[F.when(b, k).otherwise(-1) for k, b in enumerate(barred)])
    bars = met.groupBy("__id").agg(F.max(last).alias("bar"))
    marked = checkpointed(rows.join(bars, "__id", "left").withColumn("bar", F.coalesce("bar", F.lit(-1))))
    counts = {r.bar: r.n for r in marked.groupBy("bar").agg(F.count("*").alias("n")).collect()}  # a row a rung
    left = [sum(n for bar, n in counts.items() if bar < k) for k in range(len(rungs))]
    rung = next((k for k, n in enumerate(left) if n >= enough), len(rungs) - 1)
    return marked.where(F.col("bar") < rung).drop("__id", "bar").withColumn("rung", F.lit(rung))
