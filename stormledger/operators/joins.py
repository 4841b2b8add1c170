"""Spatial, temporal and incremental joins, all by equal keys first so that they shuffle on those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormledger.functions.columns import haversine_km


def places(df: DataFrame, max_km: float, max_us: int) -> DataFrame:
    """df (lat, lon, us) with `band`, `slot` and `cell`: a latitude band of the distance, a time slot of the gap, and the place on the band's circle."""
    band = F.floor(F.col("lat") / (max_km / 111.0))
    return df.withColumn("band", band).withColumn("slot", F.floor(F.col("us") / max_us)).withColumn("cell", circle_cell(F.col("lon"), F.col("band"), max_km))


def circle_cells(band: Column, max_km: float) -> Column:
    """How many cells a band's circle has, each at least max_km wide anywhere in the band and the two beside it."""
    width = max_km / 111.0
    highest = F.greatest(F.abs(band - 1), F.abs(band + 2)) * width
    return F.when(highest >= 89.0, 1).otherwise(F.greatest(F.lit(1), F.floor(360 * 111.0 * F.cos(F.radians(highest)) / (1.05 * max_km)))).cast("long")


def circle_cell(lon: Column, band: Column, max_km: float) -> Column:
    return F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * circle_cells(band, max_km))


def around(placed: DataFrame, max_km: float, steps: list[tuple[int, int]]) -> DataFrame:
    """Each row of placed once for each cell that a near row may be in; steps: (slot, band) from its own. `step` is 0 for its own slot and band.

    On a band's circle the three cells about its longitude count, across the date line too.
    """
    moved = placed.withColumn("__s", F.explode(F.array(*[F.struct(F.lit(d).alias("slot"), F.lit(b).alias("band")) for d, b in steps])))
    moved = moved.withColumn("step", F.abs(F.col("__s.slot")) + F.abs(F.col("__s.band"))).withColumn("slot", F.col("slot") + F.col("__s.slot")).withColumn("band", F.col("band") + F.col("__s.band")).drop("__s")
    at = circle_cell(F.col("lon"), F.col("band"), max_km)
    beside = F.array_distinct(F.array(*[F.pmod(at + k, circle_cells(F.col("band"), max_km)) for k in (-1, 0, 1)]))
    return moved.withColumn("cell", F.explode(beside))


def near_pairs(events: DataFrame, max_km: float = 80.0, max_days: float = 5.0, times: bool = False) -> DataFrame:
    """Pairs (id_a < id_b) of events of one type within max_km and max_days; with times, us_a and us_b are when, in microseconds.

    Events are dealt by type, latitude band, time slot and longitude cell. One side looks into its own and the four
    (slot, band) neighbours that come after it, so each pair meets exactly once, and candidates grow with local density.
    Events without a place or time have no pair. Spark reckons both sides by their files, which know nothing of the cells that one
    side is repeated for: neither may be broadcast, so the join is told to sort and merge.
    """
    gap = int(max_days * 86_400_000_000)
    e = places(events.select("event_id", "type", "lat", "lon", F.unix_micros("ts").alias("us")).where("lat is not null and lon is not null"), max_km, gap)
    there = around(e, max_km, [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)])
    keys = ["type", "slot", "band", "cell"]
    a, b = (df.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in ("event_id", "lat", "lon", "us", *(("step",) if x == "b" else ()))]) for df, x in ((e, "a"), (there, "b")))
    km = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    once = (F.col("step_b") > 0) | (F.col("event_id_a") < F.col("event_id_b"))
    pairs = a.hint("merge").join(b, keys).where(once & (F.abs(F.col("us_a") - F.col("us_b")) <= gap)).withColumn("km", km).where(F.col("km") < max_km)
    turned = F.col("event_id_a") > F.col("event_id_b")
    when = [F.when(turned, F.col(f"us_{y}")).otherwise(F.col(f"us_{x}")).alias(f"us_{x}") for x, y in ("ab", "ba")] if times else []
    return pairs.select(F.least("event_id_a", "event_id_b").alias("event_id_a"), F.greatest("event_id_a", "event_id_b").alias("event_id_b"), "type", "km", *when)


def embargoed(train: DataFrame, held: DataFrame, max_km: float, max_hours: float) -> DataFrame:
    """train without the events that a held one is near in both time and space; an event without a place or time stays."""
    gap = int(max_hours * 3_600_000_000)
    at = lambda df: places(df.withColumn("us", F.unix_micros("ts")), max_km, gap)
    h = around(at(held.select("lat", "lon", "ts")), max_km, [(d, b) for d in (-1, 0, 1) for b in (-1, 0, 1)])
    h = h.select(*[F.col(c).alias(f"h{c}") for c in ("lat", "lon", "us", "band", "slot", "cell")])
    near = (F.col("band") == F.col("hband")) & (F.col("slot") == F.col("hslot")) & (F.col("cell") == F.col("hcell"))
    near = near & (F.abs(F.col("us") - F.col("hus")) <= gap) & (haversine_km(F.col("lat"), F.col("lon"), F.col("hlat"), F.col("hlon")) <= max_km)
    return at(train).join(h, near, "left_anti").drop("us", "band", "slot", "cell")


def around_the_date_line(lon: Column, west: Column, east: Column) -> Column:
    """array of a longitude and, where a reach to the west or east of it leaves -180 to 180, the same place a turn away."""
    others = F.filter(F.array(lon - 360, lon + 360), lambda x: (x + east >= -180) & (x - west <= 180))
    return F.concat(F.array(lon.cast("double")), others)


def cells_within(events: DataFrame, grid: DataFrame, half: float, step: float = 0.5) -> DataFrame:
    """(event, cell) where a cell's centre lies in the square of `half` degrees around the event: candidates by tile, then the test.

    Tiles are as wide as the square, so an event looks into the nine around its own; one near the date line also looks beyond it.
    """
    tile = 2 * half
    events = events.withColumn("__lon", F.explode(around_the_date_line(F.col("lon"), F.lit(half), F.lit(half))))
    g = grid.withColumn("ty", F.floor(F.col("lat_c") / tile)).withColumn("tx", F.floor(F.col("lon_c") / tile))
    e = events.withColumn("ty", F.explode(F.array(*[F.floor(F.col("lat") / tile) + k for k in (-1, 0, 1)]))).withColumn("tx", F.explode(F.array(*[F.floor(F.col("__lon") / tile) + k for k in (-1, 0, 1)])))
    inside = (F.abs(F.col("lat_c") - F.col("lat")) <= half) & (F.abs(F.col("lon_c") - F.col("__lon")) <= half)
    return e.join(g, ["ty", "tx"]).where(inside).drop("ty", "tx", "__lon")


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and change (added, removed, changed) of the rows that differ, nulls being equal."""
    row = F.struct(*columns)
    old, new = (df.select(F.struct(key).alias("__key"), row.alias(n)) for df, n in ((before, "old"), (after, "new")))  # a struct, so null keys meet
    both = old.join(new, "__key", "full_outer").withColumn(key, F.col(f"__key.{key}"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def reuse(before: DataFrame, after: DataFrame, key: str, same: list[str], kept: list[str]) -> DataFrame:
    """after, with the `kept` columns of before where the `same` columns did not change; `reused` says where."""
    old = before.select(F.col(key).alias("__key"), F.struct(*same).alias("__same"), *[F.col(c).alias(f"__{c}") for c in kept])
    unchanged = F.coalesce(F.col("__same").eqNullSafe(F.struct(*same)), F.lit(False)) & F.col("__key").isNotNull()
    joined = after.join(old, F.col(key) == F.col("__key"), "left").withColumn("reused", unchanged)
    for c in kept:
        joined = joined.withColumn(c, F.when(F.col("reused"), F.col(f"__{c}")).otherwise(F.col(c)))
    return joined.select(*after.columns, "reused")


def beside_in_time(left: DataFrame, right: DataFrame, by: str, width_us: int) -> DataFrame:
    """left (by, us, ...) with `before` and `after`, structs (us, rid) of the rows of right (by, us, rid) next to it in time, at most width_us away or null.

    right has one row a (by, us). Both sides go into one table, dealt by key and time slot and read in order of time: the
    cost follows the rows, not the pairs in a slot. The last and first row of a slot are carried over to its neighbours.
    """
    slot = F.floor(F.col("us") / width_us).alias("slot")
    found = F.struct("us", "rid")
    r = right.select(by, "us", slot, "rid")
    both = left.withColumn("slot", slot).withColumn("rid", F.lit(None).cast(right.schema["rid"].dataType)).withColumn("__left", F.lit(True)).unionByName(r.withColumn("__left", F.lit(False)), allowMissingColumns=True)
    here = F.when(~F.col("__left"), found)
    # both frames reach back in their own order: one that reaches ahead is read anew for every row
    near_row = lambda order: F.last(here, True).over(Window.partitionBy(by, "slot").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("before", near_row("us")).withColumn("after", near_row(F.desc("us"))).where("__left")
    ends = r.groupBy(by, "slot").agg(F.max(found).alias("hi"), F.min(found).alias("lo"))  # a row a slot
    shifted = lambda k, c, name: ends.select(by, (F.col("slot") + k).alias("slot"), F.col(c).alias(name))
    both = both.join(shifted(1, "hi", "__b"), [by, "slot"], "left").join(shifted(-1, "lo", "__a"), [by, "slot"], "left")
    before, after = F.coalesce("before", "__b"), F.coalesce("after", "__a")
    near = lambda x: F.when(F.abs(x["us"] - F.col("us")) <= width_us, x)
    return both.select(*left.columns, near(before).alias("before"), near(after).alias("after"))


def nearest_in_time(left: DataFrame, right: DataFrame, by: str, window_hours: float) -> DataFrame:
    """Each row of left (id, by, ts) with the row of right (rid, by, rts) nearest in time within the window; ties go to the smaller rid.

    Rows without a key or time have no match.
    """
    width = int(window_hours * 3_600_000_000)
    r = right.where(F.col("rts").isNotNull() & F.col(by).isNotNull()).groupBy(by, F.unix_micros("rts").alias("us")).agg(F.min("rid").alias("rid"))
    found = beside_in_time(left.withColumn("us", F.unix_micros("ts")), r, by, width)
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("us") - F.col(f"{c}.us")).alias("gap_us"), F.col(f"{c}.rid").alias("rid")))
    best = found.withColumn("best", F.least(gap("before"), gap("after")))
    return best.select(*left.columns, F.col("best.rid").alias("rid"), (F.col("best.gap_us") / 1e6).alias("gap_s"))
