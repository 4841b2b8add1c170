"""Joins of polygons with grid cells and points, and the choice among a source's polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormledger.functions import geometry as G
from stormledger.operators.components import spread
from stormledger.operators.joins import around_the_date_line

#: Words of a feature's properties that speak for it, and for mere context (fixed values); how far a polygon may be from its event, and from where it is very large.
PREFERRED, CONTEXT = "flood|affected|event polygon|eventpolygon|analysis|aoi", "admin|administrative|country boundary|boundary|context|basin"
FAR_KM, LARGE_KM2 = 75.0, 300_000.0


def cells_in(footprints: DataFrame, grid: DataFrame, rings: str = "rings", tile: float = 2.0, reach_km: float = 0.0) -> DataFrame:
    """(footprint, cell) for the cells whose centre a footprint covers, or is within reach_km of, across the date line too.

    A footprint is dealt to the tiles that its box touches and meets their cells only, so a large one is many tasks' work.
    """
    b = G.box(F.col(rings))
    pad = reach_km / 111.0
    wide = pad / F.greatest(F.lit(0.05), F.cos(F.radians(F.greatest(F.abs(b["y0"]), F.abs(b["y1"])) + pad)))
    span = lambda lo, hi, p: F.explode(F.sequence(F.floor((lo - p) / tile), F.floor((hi + p) / tile)))
    # cells are met where the footprint is and, where it reaches beyond the date line, a turn away from there
    turns = F.explode(F.transform(around_the_date_line(b["x0"], wide, b["x1"] - b["x0"] + wide), lambda x: x - b["x0"]))
    dealt = footprints.where(F.col(rings).isNotNull()).withColumn("__turn", turns)
    dealt = dealt.withColumn("ty", span(b["y0"], b["y1"], pad)).withColumn("tx", span(b["x0"] + F.col("__turn"), b["x1"] + F.col("__turn"), wide))
    g = grid.withColumn("ty", F.floor(F.col("lat_c") / tile)).withColumn("tx", F.floor(F.col("lon_c") / tile))
    x, y = F.col("lon_c") - F.col("__turn"), F.col("lat_c")
    near = G.covers(F.col(rings), x, y)
    if reach_km:
        near = G.distance_km(F.col(rings), x, y) <= reach_km
    in_box = x.between(b["x0"] - wide, b["x1"] + wide) & y.between(b["y0"] - pad, b["y1"] + pad)  # cheaper than the sides
    return dealt.join(g, ["ty", "tx"]).where(in_box & near).drop("ty", "tx", "__turn")


def cells_along(legs: DataFrame, grid: DataFrame, reach_km: float, tile: float = 2.0) -> DataFrame:
    """(leg, cell) with `km` for the cells whose centre is within reach_km of a straight leg (ax, ay, bx, by), across the date line too.

    A leg is followed in steps of a tile at most and meets the cells of the tiles that its steps' boxes reach, each tile once: candidates
    grow with its length, not with its box. Legs are few bytes and much work, so they are spread first.
    """
    pad = reach_km / 111.0
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / tile)).cast("int")

    def tiles(k: Column) -> Column:
        of = lambda start, d: (start + k / n * d, start + (k + 1) / n * d)
        (x0, x1), (y0, y1) = ((F.least(a, b), F.greatest(a, b)) for a, b in (of(F.col("ax"), dx), of(F.col("ay"), dy)))
        wide = pad / F.greatest(F.lit(0.05), F.cos(F.radians(F.greatest(F.abs(y0), F.abs(y1)) + pad)))
        rows = F.sequence(F.floor((y0 - pad) / tile), F.floor((y1 + pad) / tile))
        columns = F.flatten(F.transform(around_the_date_line(x0, wide, x1 - x0 + wide), lambda x: F.sequence(F.floor((x - wide) / tile), F.floor((x + x1 - x0 + wide) / tile))))
        return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: tile_of(r, c))))

    met = spread(legs).withColumn("__tile", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), tiles)))))
    g = grid.withColumn("__tile", tile_of(F.floor(F.col("lat_c") / tile), F.floor(F.col("lon_c") / tile)))
    km = G.leg_km(*map(F.col, ("ax", "ay", "bx", "by", "lon_c", "lat_c")))
    return met.join(g, "__tile").drop("__tile").withColumn("km", km).where(F.col("km") <= reach_km)


def tile_of(row: Column, column: Column) -> Column:
    """One number for a tile."""
    return row * 1_000_000 + column


def valid_sum(value: Column, most: float | None = None) -> Column:
    """The sum of values that are finite, not negative and below most."""
    ok = value.isNotNull() & ~F.isnan(value.cast("double")) & (value >= 0)
    if most is not None:
        ok = ok & (value < most)
    return F.sum(F.when(ok, value))


def best_polygon(features: DataFrame, key: str) -> DataFrame:
    """Of each event's polygon features (index, rings, properties, lon, lat) the best one, and its fitness.

    First by how near the polygon is (inside, 10, 30, 75 km, beyond), then by its words, distance, area and index. One
    farther than FAR_KM is refused, one over LARGE_KM2 has a warning. An event without a polygon has no row.
    """
    km = G.distance_km(F.col("rings"), F.col("lon"), F.col("lat"))
    text = F.lower(F.coalesce("properties", F.lit("")))
    f = features.where(F.col("rings").isNotNull()).select(key, "index", km.alias("km"), G.area_km2(F.col("rings")).alias("area_km2"), text.rlike(PREFERRED).alias("preferred"), text.rlike(CONTEXT).alias("context"))
    tier = F.when(F.col("km") == 0, 0).when(F.col("km") <= 10, 1).when(F.col("km") <= 30, 2).when(F.col("km") <= FAR_KM, 3).otherwise(4)
    rank = F.struct(tier.alias("tier"), (~F.col("preferred")).alias("p"), F.col("context").alias("c"), F.col("km"), F.col("area_km2"), F.col("index"))
    best = f.groupBy(key).agg(F.min(rank).alias("b"), F.count("*").alias("candidates"))
    fits = F.col("b.km") <= FAR_KM
    reason = F.when(~fits, "no_center_aligned_polygon").when(F.col("b.tier") == 0, "center_aligned_source_feature").otherwise("nearest_source_feature")
    return best.select(
        key, "candidates", F.when(fits, "pass").otherwise("failed").alias("status"), reason.alias("reason"), F.when(fits, F.col("b.index")).alias("index"), F.round("b.km", 2).alias("km"),
        F.when(fits, F.round("b.area_km2", 2)).alias("area_km2"), F.when(fits & (F.col("b.area_km2") > LARGE_KM2), "very_large_reported_event_area_context").alias("warning"),
    )
