"""Tracks, rings, projections and forecast matching of the research track."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormledger.functions.columns import EARTH_KM, haversine_km
from stormledger.operators.components import checkpointed
from stormledger.operators.joins import beside_in_time, cells_within


def previous_cycle(left: DataFrame, right: DataFrame, by: str, least_hours: int, most_hours: int) -> DataFrame:
    """Each row of left (id, by, ts) with the latest row of right (rid, by, rts) that is least_hours to most_hours before it; ties go to the greater rid. Rows without a key or time have no match."""
    width = (most_hours - least_hours) * 3_600_000_000
    r = right.where(F.col("rts").isNotNull() & F.col(by).isNotNull()).groupBy(by, F.unix_micros("rts").alias("us")).agg(F.max("rid").alias("rid"))
    found = beside_in_time(left.withColumn("us", F.unix_micros("ts") - least_hours * 3_600_000_000), r, by, width)
    return found.select(*left.columns, F.col("before.rid").alias("rid"), F.timestamp_micros("before.us").alias("rts"))


def nearest_cell(points: DataFrame, key: str, grid: DataFrame, half: float, max_km: float) -> DataFrame:
    """key, row, col and km of the nearest cell of grid for each point: the square around it holds all cells within max_km, ties go to the lesser cell."""
    near = cells_within(points, grid, half).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat_c"), F.col("lon_c"))).where(F.col("km") <= max_km)
    best = near.groupBy(key).agg(F.min(F.struct(F.round("km", 6).alias("km"), "row", "col")).alias("x"))
    return points.join(best, key, "left").select(key, "x.row", "x.col", "x.km")


def ring_cells(points: DataFrame, key: str, grid: DataFrame, step: float, south: float, west: float, max_km: float = 500.0, rings: int = 12) -> DataFrame:
    """key, row, col, km and ring of the nearest valid cell of each point: its own cell if that is valid, else by square rings around it.

    A ring ends the search if the nearest cell found so far is within max_km; a point with none of that kind in `rings` rings has
    nulls. grid: the valid cells (row, col, lat_c, lon_c), row and col counted from the centre (south, west) in steps; columns wrap around the circle. In a
    round only the points go on that are still open, to the 8r cells of ring r, joined by equal cell. Ties go to the lesser cell.
    """
    around = int(round(360 / step))
    cells = grid.select(F.pmod("col", F.lit(around)).alias("c"), F.col("row").alias("r"), "row", "col", "lat_c", "lon_c")
    whole = points.where("lat is not null and lon is not null")
    at = lambda v, first: F.floor((F.col(v) - first) / step + 0.5).cast("int")
    open_ = checkpointed(whole.select(key, "lat", "lon", at("lat", south).alias("y"), at("lon", west).alias("x"), F.lit(None).cast("struct<km double, row int, col int>").alias("best")))
    done = None
    for ring in range(rings + 1):
        steps = [(dy, dx) for dy in range(-ring, ring + 1) for dx in range(-ring, ring + 1) if max(abs(dy), abs(dx)) == ring]
        offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])
        looked = open_.withColumn("o", F.explode(offsets)).withColumn("r", F.col("y") + F.col("o.dy")).withColumn("c", F.pmod(F.col("x") + F.col("o.dx"), F.lit(around)))
        km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("lat_c"), F.col("lon_c")), 6)
        found = looked.join(cells, ["r", "c"]).groupBy(key).agg(F.min(F.struct(km.alias("km"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))).alias("found"))
        new = checkpointed(open_.join(found, key, "left").withColumn("best", F.least("best", "found")).drop("found"))
        over = F.col("best").isNotNull() & ((F.col("best.km") <= max_km) | F.lit(ring == 0))
        ended = new.where(over).select(key, "best", F.lit(ring).alias("ring"))
        done = ended if done is None else done.unionByName(ended)
        open_ = new.where(~over)
        if open_.isEmpty():
            break
    return points.select(key).join(done, key, "left").select(key, "best.row", "best.col", "best.km", "ring")


def step_of(lat: Column, lon: Column, u: Column, v: Column, seconds: float) -> tuple[Column, Column]:
    """Where a wind of u and v m/s takes a point: the cosine of the latitude is 0.05 at least, longitudes wrap at 180, latitudes end at 89.9.

    Degrees are radians times 180, then over pi: a wind there and back may end on a cell's border or a bit beside it, as the order of steps says.
    """
    cos = F.greatest(F.lit(0.05), F.abs(F.cos(F.radians(lat))))
    degrees = lambda arc: arc * 180.0 / F.lit(math.pi)
    x = lon + degrees(u * seconds / (EARTH_KM * 1000 * cos))
    wrapped = F.when(x > 180, x - 360).when(x < -180, x + 360).otherwise(x)
    return F.greatest(F.lit(-89.9), F.least(F.lit(89.9), lat + degrees(v * seconds / (EARTH_KM * 1000)))), wrapped


def advected(seeds: DataFrame, wind: DataFrame, leads: int, hours: float, step: float = 0.5, south: float = -22.0, west: float = -1.0) -> DataFrame:
    """seeds (lat, lon and others) moved for `leads` steps by the wind (lead, row, col, u, v in m/s) of the cell that they are in.

    A step depends on the one before, so each lead is an equi-join on the cell; without a wind a seed holds its position.
    """
    at = seeds
    for lead in range(leads):
        here = at.withColumn("row", F.floor((F.col("lat") - south) / step).cast("int")).withColumn("col", F.floor((F.col("lon") - west) / step).cast("int"))
        moved = here.join(wind.where(F.col("lead") == lead).drop("lead"), ["row", "col"], "left")
        lat, lon = step_of(F.col("lat"), F.col("lon"), F.coalesce("u", F.lit(0.0)), F.coalesce("v", F.lit(0.0)), hours * 3600)
        at = moved.select(*[c for c in seeds.columns if c not in ("lat", "lon")], lat.alias("lat"), lon.alias("lon"))
    return at


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Kilometres east and north of a centre in a spherical azimuthal equidistant projection."""
    p, p0, d = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    c = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(d))))
    k = F.when(F.sin(c) == 0, 1.0).otherwise(c / F.sin(c)) * EARTH_KM
    return k * F.cos(p) * F.sin(d), k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(d))


def turned(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    """A point turned counter-clockwise about the origin."""
    a = F.radians(F.lit(degrees))
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def ring_area(ring: str) -> Column:
    """Planar area of a ring, an array of (x, y) structs that need not be closed."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(F.col(ring), following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def spherical_centroid(points: DataFrame, by: str) -> DataFrame:
    """by, lat and lon of the mean direction of each group's points: partial means of three coordinates."""
    p, q = F.radians("lat"), F.radians("lon")
    m = points.groupBy(by).agg(F.avg(F.cos(p) * F.cos(q)).alias("x"), F.avg(F.cos(p) * F.sin(q)).alias("y"), F.avg(F.sin(p)).alias("z"))
    return m.select(by, F.degrees(F.atan2("z", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))).alias("lat"), F.degrees(F.atan2("y", "x")).alias("lon"))


def leave_one_out(rows: DataFrame, block: str, value: str) -> DataFrame:
    """Of each fold (one block held out): rows and mean of what is held and of the rest, by totals less the block's, so no fold reads all rows again."""
    b = rows.groupBy(block).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    total = b.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))  # one row
    rest = F.col("all_n") - F.col("n")
    return b.crossJoin(F.broadcast(total)).select(block, F.col("n").alias("held"), rest.alias("train"), (F.col("s") / F.col("n")).alias("held_mean"), F.when(rest > 0, (F.col("all_s") - F.col("s")) / rest).alias("train_mean"))


def parsimonious(configs: DataFrame, key: str, area: str, skill: str, share: float = 0.95, support: str | None = None, least: float = 0.9) -> DataFrame:
    """The smallest configuration with at least `share` of the best skill; ties to the greater skill, then the lesser key.

    support: a column of how many events a configuration has; only those with at least `least` of the greatest such number count. Nulls never do.
    """
    fit = configs.where(F.col(area).isNotNull() & F.col(skill).isNotNull())
    if support:
        most = configs.agg(F.max(support).alias("__most"))  # one row
        fit = fit.crossJoin(F.broadcast(most)).where(F.col(support) >= F.greatest(F.lit(1), F.ceil(F.col("__most") * least))).drop("__most")
    best = fit.agg(F.max(skill).alias("__best"))  # one row
    good = fit.crossJoin(F.broadcast(best)).where(F.col(skill) + 1e-12 >= share * F.col("__best"))
    return good.orderBy(area, F.desc(skill), key).limit(1).drop("__best")
