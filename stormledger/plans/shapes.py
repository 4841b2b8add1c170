"""Queries of polygons, and the same in DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.functions import geometry as G
from stormledger.operators import overlay, rings, shapes
from stormledger.plans.catalogue import KM, query
from stormledger.sources.hazard import GRID, HAZARD, hazard_events, population_grid, table

#: A footprint about an event: five corners, and a square hole in every second one. As (dx, dy) of each ring.
OUTER = ((-0.713, -0.527), (0.651, -0.619), (0.907, 0.133), (0.117, 0.803), (-0.859, 0.371))
HOLE = ((-0.211, -0.173), (-0.211, 0.229), (0.241, 0.229), (0.241, -0.173))


def ring_sql(ring: tuple, x: str = "lon", y: str = "lat", size: str = "size") -> str:
    return "[" + ", ".join(f"{{'x': {x} + {dx} * {size}, 'y': {y} + {dy} * {size}}}" for dx, dy in ring) + "]"


RINGS = f"CASE WHEN event_id % 2 = 0 THEN [{ring_sql(OUTER)}, {ring_sql(HOLE)}] ELSE [{ring_sql(OUTER)}] END"
SIDES = "flatten(list_transform(rings, lambda r: list_transform(range(1, len(r) + 1), lambda i: {'a': r[i], 'b': r[i % len(r) + 1]})))"
#: Footprints with their sides in DuckDB; {p} picks the events.
FOOT = HAZARD + ", " + GRID + f", foot AS (SELECT *, {SIDES} AS sides FROM (SELECT *, {RINGS} AS rings FROM (SELECT *, 0.5 + (event_id % 5) * 0.3 AS size FROM hazard WHERE {{p}}))) "


def foot(p: str) -> str:
    return FOOT.replace("{p}", p)


COVERS = "len(list_filter(sides, lambda e: (e.a.y > {y}) <> (e.b.y > {y}) AND {x} < (e.b.x - e.a.x) * ({y} - e.a.y) / (e.b.y - e.a.y) + e.a.x)) % 2 = 1"
AREA = "abs(list_sum(list_transform(sides, lambda e: radians(e.b.x - e.a.x) * (sin(radians(e.a.y)) + sin(radians(e.b.y))) / 2))) * 6371.0071809 * 6371.0071809"
# the nearest point of a side in the plane about the point (x, y), longitudes by the cosine of y
COS2 = "pow(cos(radians({y})), 2)"
STEP = "greatest(0.0, least(1.0, (({x} - e.a.x) * (e.b.x - e.a.x) * " + COS2 + " + ({y} - e.a.y) * (e.b.y - e.a.y)) / (pow(e.b.x - e.a.x, 2) * " + COS2 + " + pow(e.b.y - e.a.y, 2))))"
NEAREST = "list_min(list_transform(list_transform(sides, lambda e: {{'px': e.a.x + " + STEP + " * (e.b.x - e.a.x), 'py': e.a.y + " + STEP + " * (e.b.y - e.a.y)}}), lambda p: {{'d2': pow(p.px - {x}, 2) * " + COS2 + " + pow(p.py - {y}, 2), 'px': p.px, 'py': p.py}}))"
HAVERSINE = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(n.py - {y}) / 2), 2) + cos(radians({y})) * cos(radians(n.py)) * pow(sin(radians(n.px - {x}) / 2), 2))))"


def ring(points: tuple, x: Column, y: Column, size: Column) -> list:
    return [(x + dx * size, y + dy * size) for dx, dy in points]


def footprints(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    h = hazard_events(spark, sf_dir).where(where).withColumn("size", (0.5 + (F.col("event_id") % 5) * 0.3).cast("double"))
    at = F.col("lon"), F.col("lat"), F.col("size")
    both, one = G.polygon(ring(OUTER, *at), ring(HOLE, *at)), G.polygon(ring(OUTER, *at))
    return h.withColumn("rings", F.when(F.col("event_id") % 2 == 0, both).otherwise(one))


RED = "alert = 'Red'"
IN_BOX = "abs(lat_c - lat) <= 2 AND abs(lon_c - lon) <= 2"


@query(foot("true") + f"SELECT event_id, round({AREA}, 4) AS area_km2, round(abs(list_sum(list_transform(sides, lambda e: e.a.x * e.b.y - e.b.x * e.a.y))) / 2, 5) AS planar, {COVERS.format(x='(lon + 0.3)', y='(lat + 0.2)')} AS inside, len(sides) AS sides FROM foot")
def polygon_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of polygons with holes and whether they cover a point."""
    f, r = footprints(spark, sf_dir, "true"), F.col("rings")
    return f.select("event_id", F.round(G.area_km2(r), 4).alias("area_km2"), F.round(G.planar_area(r), 5).alias("planar"), G.covers(r, F.col("lon") + 0.3, F.col("lat") + 0.2).alias("inside"), F.size(G.sides(r)).cast("long").alias("sides"))


@query(foot(RED) + f", t AS (SELECT DISTINCT type, row, col, people FROM foot, grid WHERE {IN_BOX} AND {COVERS.format(x='lon_c', y='lat_c')}) SELECT type, count(*) AS cells, sum(people)::BIGINT AS people FROM t GROUP BY type UNION ALL SELECT 'all', count(*), sum(people)::BIGINT FROM (SELECT DISTINCT row, col, people FROM t)")
def zonal_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People inside the union of each hazard's polygons and of all: cells by tile, box and ray, each counted once."""
    f = footprints(spark, sf_dir, RED).select("type", "rings")
    cells = shapes.cells_in(f, population_grid(spark)).groupBy("type", "row", "col").agg(F.any_value("people").alias("people"))
    every = cells.groupBy("row", "col").agg(F.any_value("people").alias("people")).withColumn("type", F.lit("all"))
    return cells.unionByName(every).groupBy("type").agg(F.count("*").alias("cells"), shapes.valid_sum(F.col("people")).alias("people"))


@query(foot("alert = 'Red' AND type = 'Drought'") + f", u AS (SELECT DISTINCT row, col, people, lat_c FROM foot, grid WHERE {IN_BOX} AND {COVERS.format(x='lon_c', y='lat_c')}) SELECT count(*) AS cells, sum(CASE WHEN people * 40 < 3000 THEN people * 40 END)::BIGINT AS crop_ha, round(sum(pow(radians(0.5), 2) * cos(radians(lat_c)) * 6371.0071809 * 6371.0071809), 4) AS union_km2 FROM u")
def drought_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop area inside the union of drought polygons, invalid cells left out, and the union's own area by cells."""
    f = footprints(spark, sf_dir, "alert = 'Red' and type = 'Drought'").select("rings")
    u = shapes.cells_in(f, population_grid(spark)).groupBy("row", "col").agg(F.any_value("people").alias("people"), F.any_value("lat_c").alias("lat_c"))
    cell = F.radians(F.lit(0.5)) ** 2 * F.cos(F.radians("lat_c")) * G.AUTHALIC_KM**2
    return u.agg(F.count("*").alias("cells"), shapes.valid_sum(F.col("people") * 40, 3000).cast("long").alias("crop_ha"), F.round(F.sum(cell), 4).alias("union_km2"))


@query(foot("alert = 'Red' AND type = 'Wildfire'") + f", c AS (SELECT event_id, row, col, people, lat_c, lon_c, {COVERS.format(x='lon_c', y='lat_c')} AS inside, {NEAREST.format(x='lon_c', y='lat_c')} AS n FROM foot, grid WHERE abs(lat_c - lat) <= 3 AND abs(lon_c - lon) <= 3), d AS (SELECT *, CASE WHEN inside THEN 0 ELSE {HAVERSINE.format(x='lon_c', y='lat_c')} END AS km FROM c) SELECT event_id, count(*) AS cells, sum(people)::BIGINT AS people FROM d WHERE km <= 25 GROUP BY event_id")
def zonal_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People within 25 km of each fire's polygon."""
    f = footprints(spark, sf_dir, "alert = 'Red' and type = 'Wildfire'").select("event_id", "rings")
    near = shapes.cells_in(f, population_grid(spark), reach_km=25.0)
    return near.groupBy("event_id").agg(F.count("*").alias("cells"), shapes.valid_sum(F.col("people")).alias("people"))


#: Areas of what is covered, by slabs between the heights of corners and crossings, in bands of heights; of s (grp, member, layer, rings).
SLABS = """, q AS (SELECT grp, member, layer, unnest(list_transform({sides}, lambda e: {'x1': radians(CASE WHEN e.a.y < e.b.y THEN e.a.x ELSE e.b.x END), 'y1': sin(radians(least(e.a.y, e.b.y))), 'x2': radians(CASE WHEN e.a.y < e.b.y THEN e.b.x ELSE e.a.x END), 'y2': sin(radians(greatest(e.a.y, e.b.y)))})) AS e FROM s),
z AS (SELECT grp, member, layer, e.x1, e.y1, e.x2, e.y2, (e.x2 - e.x1) / (e.y2 - e.y1) AS m, row_number() OVER () AS k FROM q WHERE e.y1 < e.y2),
bands AS (SELECT *, unnest(range(CAST(floor(y1 * 400) AS BIGINT), CAST(floor(y2 * 400) AS BIGINT) + 1)) AS band FROM z),
crossing AS (SELECT a.grp, a.band, a.y1 + (b.x1 + (a.y1 - b.y1) * b.m - a.x1) / (a.m - b.m) AS y, greatest(a.y1, b.y1) AS lo, least(a.y2, b.y2) AS hi FROM bands a JOIN bands b ON a.grp = b.grp AND a.band = b.band AND a.k < b.k AND a.m <> b.m AND a.y1 < b.y2 AND b.y1 < a.y2
  AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2)),
heights AS (SELECT DISTINCT grp, band, y FROM (SELECT grp, band, unnest([y1, y2, band / 400, (band + 1) / 400]) AS y FROM bands UNION ALL SELECT grp, band, y FROM crossing WHERE y > lo AND y < hi) WHERE y >= band / 400 AND y <= (band + 1) / 400),
strips AS (SELECT grp, band, y AS low, lead(y) OVER (PARTITION BY grp, band ORDER BY y) AS high FROM heights),
met AS (SELECT b.grp, b.band, low, high, member, layer, k, x1 + ((low + high) / 2 - y1) * m AS x FROM bands b JOIN strips t ON b.grp = t.grp AND b.band = t.band AND (low + high) / 2 > y1 AND (low + high) / 2 < y2),
turned AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY grp, band, low, layer, member ORDER BY x, k) % 2 = 1 THEN 1 ELSE -1 END AS turn FROM met),
spans AS (SELECT grp, high - low AS height, lead(x) OVER o - x AS width, sum(CASE WHEN layer = 0 THEN turn ELSE 0 END) OVER o AS d0, sum(CASE WHEN layer = 1 THEN turn ELSE 0 END) OVER o AS d1 FROM turned WINDOW o AS (PARTITION BY grp, band, low ORDER BY x, k ROWS UNBOUNDED PRECEDING)),
covered AS (SELECT grp, sum(height * width) * 6371.0071809 * 6371.0071809 AS area FROM spans WHERE {covered} GROUP BY grp) """.replace("{sides}", SIDES)


@query(foot("alert = 'Red'") + ", s AS (SELECT type AS grp, event_id AS member, 0 AS layer, rings FROM foot)" + SLABS.replace("{covered}", "d0 > 0") + f"SELECT type, count(*) AS footprints, round(sum({AREA}), 2) AS sum_km2, round(any_value(area), 2) AS union_km2 FROM foot JOIN covered ON grp = type GROUP BY type")
def union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact area of the union of each hazard's polygons, beside the sum of their areas."""
    f = footprints(spark, sf_dir, RED).select("type", "rings")
    sums = f.groupBy("type").agg(F.count("*").alias("footprints"), F.round(F.sum(G.area_km2(F.col("rings"))), 2).alias("sum_km2"))
    return sums.join(overlay.union_area(f, "type"), "type").select("type", "footprints", "sum_km2", F.round("area", 2).alias("union_km2"))


#: Countries in five rows of five, their borders slanted: corners of country k as (dx, dy) from its south-west one.
LAND = ((0.0, 0.0), (13.0, 0.7), (13.0, 10.3), (0.0, 9.6))
LAND_SQL = "[[" + ", ".join(f"{{'x': -3.0 + 13.0 * (n_nationkey % 5) + {dx}, 'y': -24.0 + 9.6 * (n_nationkey // 5) + 0.7 * (n_nationkey % 5) + {dy}}}" for dx, dy in LAND) + "]]"


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    west, south = -3.0 + 13.0 * (k % 5), -24.0 + 9.6 * F.floor(k / 5) + 0.7 * (k % 5)
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("country"), G.polygon([(west + dx, south + dy) for dx, dy in LAND]).alias("rings"))


@query(foot("alert = 'Red' AND type = 'Flood'") + f""", land AS (SELECT n_name AS country, {LAND_SQL} AS rings FROM nation), pair AS (SELECT event_id, country, f.rings AS f, l.rings AS l FROM foot f JOIN land l ON list_max(list_transform(l.rings[1], lambda p: p.x)) >= lon - 2 AND list_min(list_transform(l.rings[1], lambda p: p.x)) <= lon + 2 AND list_max(list_transform(l.rings[1], lambda p: p.y)) >= lat - 2 AND list_min(list_transform(l.rings[1], lambda p: p.y)) <= lat + 2),
s AS (SELECT event_id || '/' || country AS grp, 0 AS member, 0 AS layer, f AS rings FROM pair UNION ALL SELECT event_id || '/' || country, 0, 1, l FROM pair)""" + SLABS.replace("{covered}", "d0 > 0 AND d1 > 0") + f"SELECT event_id, country, round(area, 3) AS area_km2, round(area / whole, 5) AS share FROM covered JOIN pair ON grp = event_id || '/' || country JOIN (SELECT event_id, {AREA} AS whole FROM foot) USING (event_id) WHERE area > 0")
def country_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each flood's footprint that lies in each country."""
    f = footprints(spark, sf_dir, "alert = 'Red' and type = 'Flood'").select("event_id", "rings")
    shares = overlay.shared_areas(f, countries(spark, sf_dir), "event_id", "country")
    whole = f.select("event_id", G.area_km2(F.col("rings")).alias("whole"))
    return shares.join(whole, "event_id").select("event_id", "country", F.round("area", 3).alias("area_km2"), F.round(F.col("area") / F.col("whole"), 5).alias("share"))


#: A wavy outline of 60 points about an event, and a star whose sides cross.
WAVE = "(1 + 0.06 * sin(9 * pi() * k / 30) + 0.004 * sin(44 * pi() * k / 30))"
WAVY_SQL = f"list_transform(range(60), lambda k: {{'x': lon + size * {WAVE} * cos(pi() * k / 30), 'y': lat + size * {WAVE} * sin(pi() * k / 30)}})"
STAR = tuple(OUTER[k] for k in (0, 2, 4, 1, 3))


def wavy(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    f, turn = footprints(spark, sf_dir, where), lambda k: F.lit(math.pi) * k / 30
    r = lambda k: F.col("size") * (1 + 0.06 * F.sin(9 * turn(k)) + 0.004 * F.sin(44 * turn(k)))
    point = lambda k: F.struct((F.col("lon") + r(k) * F.cos(turn(k))).alias("x"), (F.col("lat") + r(k) * F.sin(turn(k))).alias("y"))
    return f.withColumn("rings", F.array(F.transform(F.sequence(F.lit(0), F.lit(59)), point)))


@query((foot("alert = 'Red' AND type = 'Flood'") + f""", ring AS (SELECT event_id, list_append(r, r[1]) AS r, least(0.05, greatest(0.0002, greatest(list_max(list_transform(r, lambda p: p.x)) - list_min(list_transform(r, lambda p: p.x)), list_max(list_transform(r, lambda p: p.y)) - list_min(list_transform(r, lambda p: p.y))) / 600)) AS tol FROM (SELECT event_id, {WAVY_SQL} AS r FROM foot)),
pt AS (SELECT event_id, tol, k, r[k + 1].x AS x, r[k + 1].y AS y FROM (SELECT event_id, tol, r, unnest(range(61)) AS k FROM ring)),
seg(event_id, low, high, mid_k) AS (SELECT event_id, CAST(0 AS BIGINT), CAST(60 AS BIGINT), CAST(NULL AS BIGINT) FROM ring UNION ALL
  SELECT event_id, CASE h WHEN 0 THEN low ELSE mid_k END, CASE h WHEN 0 THEN mid_k ELSE high END, mid_k FROM (SELECT event_id, low, high, arg_max(k, struct_pack(o := off, k := -k)) AS mid_k, max(off) AS far, any_value(tol) AS tol FROM (
    SELECT p.event_id, s.low, s.high, p.k, p.tol, sqrt(pow(p.x - a.x - t * (b.x - a.x), 2) + pow(p.y - a.y - t * (b.y - a.y), 2)) AS off FROM (SELECT s.*, 1 AS one FROM seg s) s JOIN pt p ON p.event_id = s.event_id AND p.k > s.low AND p.k < s.high JOIN pt a ON a.event_id = s.event_id AND a.k = s.low JOIN pt b ON b.event_id = s.event_id AND b.k = s.high,
    LATERAL (SELECT coalesce(greatest(0.0, least(1.0, ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / nullif(pow(b.x - a.x, 2) + pow(b.y - a.y, 2), 0))), 0) AS t)) GROUP BY ALL) CROSS JOIN (VALUES (0), (1)) v(h) WHERE far > tol),
kept AS (SELECT DISTINCT event_id, k FROM (SELECT event_id, unnest([low, high]) AS k FROM seg)) SELECT event_id, round(any_value(tol), 6) AS tolerance, count(*) - 1 AS points, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y FROM kept JOIN pt USING (event_id, k) WHERE k < 60 GROUP BY event_id""").replace("count(*) - 1 AS points", "count(*) AS points").replace("WITH", "WITH RECURSIVE", 1))
def simplified_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of floods with the points left out that a display does not show (L3)."""
    f = wavy(spark, sf_dir, "alert = 'Red' and type = 'Flood'").select("event_id", "rings")
    line = F.get("rings", F.lit(0))
    of = lambda c: F.round(G.total(F.transform(line, lambda p: p[c])), 4).alias(f"sum_{c}")
    return rings.simplified(f, "event_id").select("event_id", F.round("tolerance", 6).alias("tolerance"), F.size(line).cast("long").alias("points"), of("x"), of("y"))


@query(foot("alert = 'Red' AND type = 'Storm'") + f", star AS (SELECT event_id, [{ring_sql(STAR)}] AS rings FROM foot), s AS (SELECT event_id AS grp, 0 AS member, 0 AS layer, rings FROM star)" + SLABS.replace("{covered}", "d0 > 0").replace("radians(CASE", "(CASE").replace("sin(radians(least(e.a.y, e.b.y)))", "least(e.a.y, e.b.y)").replace("sin(radians(greatest(e.a.y, e.b.y)))", "greatest(e.a.y, e.b.y)").replace(" * 6371.0071809 * 6371.0071809", "") + "SELECT grp AS event_id, 5 AS parts, 15 AS corners, round(area, 6) AS area FROM covered")
def repaired_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars whose sides cross as valid polygons: their five points."""
    h = footprints(spark, sf_dir, "alert = 'Red' and type = 'Storm'")
    f = h.select("event_id", G.polygon(ring(STAR, F.col("lon"), F.col("lat"), F.col("size"))).alias("rings"))
    corners = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r))
    return rings.repaired(f, "event_id").groupBy("event_id").agg(F.count("*").cast("int").alias("parts"), F.sum(corners).cast("int").alias("corners"), F.round(F.sum(G.planar_area(F.col("rings"))), 6).alias("area"))


#: Three candidate polygons of each flood: where they are beside its event, how large, and what their properties say.
OFFERS = ((0.0, 0.4, "flood affected area"), (0.9, 1.0, "context boundary"), (0.35, 0.3, "other"))
OFFER_SQL = " UNION ALL ".join(f"SELECT event_id, lon, lat, {k} AS index, lon + {dx} * (event_id % 7) AS cx, lat AS cy, CAST({s} * (1 + (event_id % 40 = 7)::INT * 30) AS DOUBLE) AS size, '{{\"kind\": \"{t}\"}}' AS props FROM hazard WHERE type = 'Flood' AND event_id % 9 <> 4" for k, (dx, s, t) in enumerate(OFFERS))


@query(HAZARD + f", o AS ({OFFER_SQL}), r AS (SELECT *, {SIDES} AS sides FROM (SELECT *, [{ring_sql(OUTER, 'cx', 'cy')}] AS rings FROM o)), f AS (SELECT *, {COVERS.format(x='lon', y='lat')} AS inside, {NEAREST.format(x='lon', y='lat')} AS n, {AREA} AS area FROM r)," + f"""
k AS (SELECT *, CASE WHEN inside THEN 0.0 ELSE {HAVERSINE.format(x='lon', y='lat')} END AS km, NOT regexp_matches(props, 'flood|affected|event polygon|eventpolygon|analysis|aoi') AS p, regexp_matches(props, 'admin|administrative|country boundary|boundary|context|basin') AS c FROM f),
b AS (SELECT event_id, count(*) AS candidates, min(struct_pack(tier := CASE WHEN km = 0 THEN 0 WHEN km <= 10 THEN 1 WHEN km <= 30 THEN 2 WHEN km <= 75 THEN 3 ELSE 4 END, p := p, c := c, km := km, area := area, index := index)) AS b FROM k GROUP BY event_id)
SELECT event_id, candidates, CASE WHEN b.km <= 75 THEN 'pass' ELSE 'failed' END AS status, CASE WHEN b.km > 75 THEN 'no_center_aligned_polygon' WHEN b.tier = 0 THEN 'center_aligned_source_feature' ELSE 'nearest_source_feature' END AS reason, CASE WHEN b.km <= 75 THEN b.index END AS index, round(b.km, 2) AS km,
  CASE WHEN b.km <= 75 THEN round(b.area, 2) END AS area_km2, CASE WHEN b.km <= 75 AND b.area > 300000 THEN 'very_large_reported_event_area_context' END AS warning FROM b""")
def flood_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygon of each flood that is nearest to it and says most, or none."""
    h, n = hazard_events(spark, sf_dir).where("type = 'Flood' and event_id % 9 <> 4"), F.col("event_id")
    offer = F.array(*[F.struct(F.lit(k).alias("index"), F.lit(dx).alias("dx"), F.lit(s).alias("s"), F.lit(f'{{"kind": "{t}"}}').alias("properties")) for k, (dx, s, t) in enumerate(OFFERS)])
    o = h.select("event_id", "lon", "lat", F.explode(offer).alias("o")).select("event_id", "lon", "lat", "o.*")
    size = (F.col("s") * (1 + (n % 40 == 7).cast("int") * 30)).cast("double")
    o = o.withColumn("rings", G.polygon(ring(OUTER, F.col("lon") + F.col("dx") * (n % 7), F.col("lat"), size)))
    return shapes.best_polygon(o, "event_id")


@query(foot("type = 'Wildfire'") + f"""SELECT event_id, round(mapped, 2) AS mapped_ha, CASE WHEN event_id % 5 > 0 AND event_id % 3 > 0 AND mapped / burned BETWEEN 0.5 AND 2.0 THEN 'pass' ELSE 'failed' END AS status, round(mapped / burned, 4) AS ratio FROM (SELECT event_id, {AREA} * 100 AS mapped, {AREA} * (30 + event_id % 300) AS burned FROM foot)""")
def wildfire_perimeters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of fire perimeters held against the reported ones."""
    from stormledger.operators.policy import fire_qc

    n = F.col("event_id")
    f = footprints(spark, sf_dir, "type = 'Wildfire'").select("event_id", G.area_km2(F.col("rings")).alias("a"))
    qc = fire_qc(F.col("a") * 100, F.col("a") * (30 + n % 300), F.lit(16), F.when(n % 5 > 0, "GDACS/GWIS"), F.lit("source_reported_current_episode"), F.when(n % 3 > 0, 16))
    return f.select("event_id", F.round(F.col("a") * 100, 2).alias("mapped_ha"), qc["status"].alias("status"), F.round(F.col("a") * 100 / (F.col("a") * (30 + n % 300)), 4).alias("ratio"))


GEOJSON = """CASE event_id % 4 WHEN 0 THEN '{"type":"Polygon","coordinates":[[[0,0],[' || (event_id % 50 + 1) || ',0],[0,2],[0,0]]]}' WHEN 1 THEN '{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[0,2]]],[[[5,5],[6,5],[5,6]]]]}'
  WHEN 2 THEN '{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":[[0,0],[1,1]]},{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}]}' ELSE '{"type":"LineString","coordinates":[[0,0],[1,1]]}' END"""


@query(HAZARD + "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS parts, CASE event_id % 4 WHEN 0 THEN event_id % 50 + 1.0 WHEN 1 THEN 2.5 WHEN 2 THEN 1.0 ELSE 0.0 END AS area FROM hazard")
def polygon_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons of mixed geometries, lines left out, and their areas (L1)."""
    h = hazard_events(spark, sf_dir).select("event_id", G.polygon_parts(F.expr(GEOJSON)).alias("parts"))
    return h.select("event_id", F.size("parts").cast("long").alias("parts"), F.aggregate("parts", F.lit(0.0), lambda s, p: s + G.planar_area(p)).alias("area"))


@query(HAZARD + f", d AS (SELECT event_id, lat, lon FROM hazard WHERE alert = 'Red' AND type = 'Storm'), x AS (SELECT a.event_id, count(*) AS seeds FROM d a JOIN hazard b ON {KM.format(a='a', b='b')} <= 60 AND b.type = 'Wildfire' GROUP BY a.event_id), y AS (SELECT a.event_id, count(*) AS rivals FROM d a JOIN hazard b ON {KM.format(a='a', b='b')} > 60 AND {KM.format(a='a', b='b')} <= 150 AND b.type = 'Wildfire' GROUP BY a.event_id) SELECT event_id, coalesce(seeds, 0) AS seeds, coalesce(rivals, 0) AS rivals FROM d LEFT JOIN x USING (event_id) LEFT JOIN y USING (event_id)")
def seeds_and_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires near each storm, and those farther out that compete with them."""
    from stormledger.functions.columns import haversine_km
    from stormledger.operators.joins import around, places

    h = hazard_events(spark, sf_dir)
    at = lambda df: places(df.withColumn("us", F.lit(0).cast("long")), 150.0, 1)
    centres = around(at(h.where("alert = 'Red' and type = 'Storm'").select("event_id", "lat", "lon")), 150.0, [(0, b) for b in (-1, 0, 1)])
    fires = at(h.where("type = 'Wildfire'").select("lat", "lon")).select(F.col("lat").alias("y"), F.col("lon").alias("x"), "band", "cell")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))
    counts = centres.join(fires, ["band", "cell"]).withColumn("km", km).where("km <= 150").groupBy("event_id").agg(F.count_if(F.col("km") <= 60).alias("seeds"), F.count_if(F.col("km") > 60).alias("rivals"))
    return h.where("alert = 'Red' and type = 'Storm'").select("event_id").join(counts, "event_id", "left").fillna(0, ["seeds", "rivals"])
