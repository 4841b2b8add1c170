"""Queries of the research track and of periods, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.operators import episodes, tracks
from stormledger.plans.catalogue import CONFIGS, KM, query, texts
from stormledger.sources import rasters
from stormledger.sources.hazard import GRID, HAZARD, hazard_events, population_grid, table
from stormledger.sources.storage import shared_folder


@query(HAZARD + """, p AS (SELECT h.id, h.ts, h.type, g.event_id AS rid, g.ts AS rts FROM hazard h LEFT JOIN hazard g ON g.type = h.type AND g.origin = 'gdacs' AND epoch_us(h.ts) - epoch_us(g.ts) BETWEEN 7200000000 AND 64800000000 WHERE h.origin = 'cems')
SELECT id, type, arg_max(rid, struct_pack(t := epoch_us(rts), r := rid)) AS rid FROM p GROUP BY id, type""")
def asof_previous_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each activation's latest alert 2 to 18 hours before it."""
    h = hazard_events(spark, sf_dir)
    left, right = h.where("origin = 'cems'").select("id", "type", "ts"), h.where("origin = 'gdacs'").select("type", F.col("event_id").alias("rid"), F.col("ts").alias("rts"))
    return tracks.previous_cycle(left, right, "type", 2, 18).select("id", "type", "rid")


@query(HAZARD + ", " + GRID + f""", a AS (SELECT event_id, lat, lon FROM hazard WHERE alert = 'Red' AND type = 'Drought'), b AS (SELECT row, col, lat_c AS lat, lon_c AS lon FROM grid WHERE people >= 80),
n AS (SELECT event_id, arg_min(struct_pack(row := row, col := col, km := km), struct_pack(km := km, row := row, col := col)) AS x FROM (SELECT event_id, row, col, round({KM.format(a='a', b='b')}, 6) AS km FROM a, b WHERE abs(a.lat - b.lat) <= 5 AND abs(a.lon - b.lon) <= 5) WHERE km <= 500 GROUP BY event_id)
SELECT event_id, x.row AS row, x.col AS col, x.km AS km FROM a LEFT JOIN n USING (event_id)""")
def nearest_valid_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest populated cell of each drought within 500 km."""
    points = hazard_events(spark, sf_dir).where("alert = 'Red' and type = 'Drought'").select("event_id", "lat", "lon")
    return tracks.nearest_cell(points, "event_id", population_grid(spark).where("people >= 80"), 5.0, 500.0)


@query(HAZARD + ", " + GRID + f""", a AS (SELECT event_id, lat, lon, CAST(floor((lat + 21.75) / 0.5 + 0.5) AS INT) AS y, CAST(floor((lon + 0.75) / 0.5 + 0.5) AS INT) AS x FROM hazard WHERE type = 'Drought'), b AS (SELECT row, col, lat_c AS lat, lon_c AS lon FROM grid WHERE people >= 92),
c AS (SELECT event_id, row, col, greatest(abs(row - y), abs(col - x)) AS ring, round({KM.format(a='a', b='b')}, 6) AS km FROM a JOIN b ON row BETWEEN y - 12 AND y + 12 AND col BETWEEN x - 12 AND x + 12), e AS (SELECT event_id, min(ring) FILTER (WHERE km <= 500 OR ring = 0) AS ring FROM c GROUP BY event_id),
n AS (SELECT event_id, e.ring, arg_min(struct_pack(row := row, col := col, km := km), struct_pack(km := km, row := row, col := col)) AS x FROM c JOIN e USING (event_id) WHERE c.ring <= e.ring GROUP BY event_id, e.ring) SELECT event_id, n.x.row AS row, n.x.col AS col, n.x.km AS km, ring FROM a LEFT JOIN n USING (event_id)""")
def nearest_cell_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid cell of each drought: its own, else the nearest one of rings that widen until one is within 500 km."""
    points = hazard_events(spark, sf_dir).where("type = 'Drought'").select("event_id", "lat", "lon")
    return tracks.ring_cells(points, "event_id", population_grid(spark).where("people >= 92"), 0.5, -21.75, -0.75)


DEG = "180.0 / pi()"
STEP = f"""SELECT event_id, greatest(-89.9, least(89.9, lat + coalesce(v, 0) * 10800 / 6371000.0 * {DEG})) AS lat, CASE WHEN x > 180 THEN x - 360 WHEN x < -180 THEN x + 360 ELSE x END AS lon
  FROM (SELECT *, lon + coalesce(u, 0) * 10800 / (6371000.0 * greatest(0.05, abs(cos(radians(lat))))) * {DEG} AS x FROM {{t}} LEFT JOIN wind w ON w.lead = {{k}} AND w.row = CAST(floor((lat + 22.0) / 0.5) AS INT) AND w.col = CAST(floor((lon + 1.0) / 0.5) AS INT))"""


@query(HAZARD + ", " + GRID + ", wind AS (SELECT lead, row, col, ((row * 7 + col * 3 + lead) % 11 - 5) * 4.0 AS u, ((row * 5 + col * 2 + lead) % 9 - 4) * 4.0 AS v FROM grid, range(4) t(lead) WHERE people % 10 <> 0), s0 AS (SELECT event_id, lat, CASE WHEN event_id % 50 = 0 THEN 179.99 ELSE lon END AS lon FROM hazard WHERE type = 'Wildfire'), " + ", ".join(f"s{k} AS ({STEP.format(t=f's{k - 1}', k=k - 1)})" for k in range(1, 5)) + " SELECT event_id, round(lat, 5) AS lat, round(lon, 5) AS lon FROM s4")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each lead's wind takes each fire in four steps of three hours; without a wind it stays."""
    row, col, lead = F.col("row"), F.col("col"), F.col("lead")
    grid = population_grid(spark).where("people % 10 <> 0").withColumn("lead", F.explode(F.array(*map(F.lit, range(4)))))
    wind = grid.select("lead", "row", "col", (((row * 7 + col * 3 + lead) % 11 - 5) * 4.0).alias("u"), (((row * 5 + col * 2 + lead) % 9 - 4) * 4.0).alias("v"))
    seeds = hazard_events(spark, sf_dir).where("type = 'Wildfire'").select("event_id", "lat", F.when(F.col("event_id") % 50 == 0, 179.99).otherwise(F.col("lon")).alias("lon"))
    return tracks.advected(seeds, wind, 4, 3.0).select("event_id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query(HAZARD + """, r AS (SELECT event_id, radians(lat) AS p, radians(lon - 30.0) AS d, radians(10.0) AS p0 FROM hazard), c AS (SELECT *, acos(least(1.0, greatest(-1.0, sin(p0) * sin(p) + cos(p0) * cos(p) * cos(d)))) AS c FROM r),
k AS (SELECT *, CASE WHEN sin(c) = 0 THEN 1.0 ELSE c / sin(c) END * 6371.0 AS k FROM c), xy AS (SELECT event_id, k * cos(p) * sin(d) AS x, k * (cos(p0) * sin(p) - sin(p0) * cos(p) * cos(d)) AS y FROM k)
SELECT event_id, round(x, 4) AS x, round(y, 4) AS y, round(x * cos(radians(90.0)) - y * sin(radians(90.0)), 4) + 0.0 AS left_x, round(x * sin(radians(90.0)) + y * cos(radians(90.0)), 4) + 0.0 AS left_y,
  round(x * cos(radians(-90.0)) - y * sin(radians(-90.0)), 4) + 0.0 AS right_x, round(x * sin(radians(-90.0)) + y * cos(radians(-90.0)), 4) + 0.0 AS right_y, round(x * cos(radians(180.0)) - y * sin(radians(180.0)), 4) + 0.0 AS back_x, round(x * sin(radians(180.0)) + y * cos(radians(180.0)), 4) + 0.0 AS back_y FROM xy""")
def local_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in kilometres around a centre, and turned to its sides and back as controls."""
    x, y = tracks.local_xy(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(30.0))
    at = hazard_events(spark, sf_dir).select("event_id", x.alias("x"), y.alias("y"))
    turns = [(F.round(c, 4) + 0.0).alias(f"{name}_{axis}") for name, degrees in (("left", 90.0), ("right", -90.0), ("back", 180.0)) for axis, c in zip("xy", tracks.turned(F.col("x"), F.col("y"), degrees))]
    return at.select("event_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), *turns)


@query("""SELECT p_partkey, round(abs(x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y4 - x4 * y3 + x4 * y1 - x1 * y4) / 2, 6) AS area FROM (SELECT p_partkey, -p_size * 1.0 AS x1, -1.0 AS y1, p_size * 2.0 AS x2, -p_size * 0.5 AS y2, p_size * 1.5 AS x3, p_partkey % 7 + 1.0 AS y3, -0.5 AS x4, p_size * 1.0 AS y4 FROM part)""")
def planar_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of rings in a plane."""
    s, at = F.col("p_size"), lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(at(-s * 1.0, F.lit(-1.0)), at(s * 2.0, -s * 0.5), at(s * 1.5, F.col("p_partkey") % 7 + F.lit(1.0)), at(F.lit(-0.5), s * 1.0))
    return table(spark, sf_dir, "part").withColumn("ring", ring).select("p_partkey", F.round(tracks.ring_area("ring"), 6).alias("area"))


@query(HAZARD + ", m AS (SELECT type, avg(cos(radians(lat)) * cos(radians(lon))) AS x, avg(cos(radians(lat)) * sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z FROM hazard GROUP BY type) SELECT type, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM m")
def spherical_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean directions of each hazard's events."""
    return tracks.spherical_centroid(hazard_events(spark, sf_dir), "type").select("type", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(HAZARD + """, b AS (SELECT DISTINCT CAST(floor(lat / 5) AS BIGINT) AS block FROM hazard WHERE value IS NOT NULL)
SELECT block, count(*) FILTER (WHERE floor(lat / 5) = block) AS held, count(*) FILTER (WHERE floor(lat / 5) <> block) AS train, round(avg(value) FILTER (WHERE floor(lat / 5) = block), 6) AS held_mean, round(avg(value) FILTER (WHERE floor(lat / 5) <> block), 6) AS train_mean FROM b, hazard WHERE value IS NOT NULL GROUP BY block""")
def leave_one_block_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds that hold one latitude block out each."""
    rows = hazard_events(spark, sf_dir).where("value is not null").select(F.floor(F.col("lat") / 5).alias("block"), "value")
    return tracks.leave_one_out(rows, "block", "value").withColumns({c: F.round(c, 6) for c in ("held_mean", "train_mean")})


@query(CONFIGS + "SELECT config, area, csi FROM c WHERE csi >= 0.95 * (SELECT max(csi) FROM c) ORDER BY area, csi DESC, config LIMIT 1")
def parsimonious_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest configuration with 95 % of the best skill."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("config")).agg(F.round(F.avg("l_extendedprice"), 2).alias("area"), F.round(F.avg("l_quantity"), 4).alias("csi"))
    return tracks.parsimonious(c, "config", "area", "csi")


@query(HAZARD + """SELECT CAST(day AS VARCHAR) AS day, CAST((day - INTERVAL 6 DAY)::DATE AS VARCHAR) AS rolling_start, CAST(date_trunc('month', day)::DATE AS VARCHAR) AS month_start, CAST((date_trunc('week', day) - INTERVAL 7 DAY)::DATE AS VARCHAR) AS week_start,
  CAST((date_trunc('week', day) - INTERVAL 1 DAY)::DATE AS VARCHAR) AS week_end, CAST((date_trunc('month', day) - INTERVAL 1 MONTH)::DATE AS VARCHAR) AS previous_month FROM (SELECT DISTINCT day FROM hazard)""")
def period_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periods that a report of each day covers: seven days, month to date, the ISO week and the month before (H1)."""
    week = F.to_date(F.date_trunc("week", "day"))
    d = hazard_events(spark, sf_dir).select("day").distinct()
    d = d.select("day", F.date_sub("day", 6).alias("rolling_start"), F.trunc("day", "MM").alias("month_start"), F.date_sub(week, 7).alias("week_start"), F.date_sub(week, 1).alias("week_end"), F.add_months(F.trunc("day", "MM"), -1).alias("previous_month"))
    return texts(d, *d.columns)


@query(HAZARD + "SELECT type, CAST(floor(floor(lat * 20) / 2) AS BIGINT) AS row, CAST(floor(floor(lon * 20) / 2) AS BIGINT) AS col, CAST(sum(user_id) AS BIGINT) AS people FROM hazard GROUP BY ALL")
def resample_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of fine cells summed to cells of a tenth of a degree, none lost."""
    h = hazard_events(spark, sf_dir)
    fine = h.groupBy("type", F.floor(F.col("lat") * 20).alias("row"), F.floor(F.col("lon") * 20).alias("col")).agg(F.sum("user_id").alias("people"))
    return episodes.coarser(fine, 2, "people", "type")


@query(HAZARD + "SELECT type, count(*) AS contributing, round(sum(top), 4) AS total FROM (SELECT type, user_id, max(value) AS top FROM hazard WHERE value IS NOT NULL GROUP BY ALL) GROUP BY type")
def source_metric_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest metric of each source summed by hazard, with how many contribute."""
    tops = hazard_events(spark, sf_dir).where("value is not null").groupBy("type", "user_id").agg(F.max("value").alias("top"))
    return tops.groupBy("type").agg(F.count("*").alias("contributing"), F.round(F.sum("top"), 4).alias("total"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each source, closed after six quiet hours (M8)."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("a").alias("first_us"), F.unix_micros("b").alias("last_us"), "n")


BOXED = "lat >= -5 and lat <= 9.5 and lon > 10 and lon < 41"


@query(HAZARD + """, c AS (SELECT CAST(floor((lat + 22) / 0.5) AS INT) AS row, CAST(floor((lon + 1) / 0.5) AS INT) AS col, max(value) AS value FROM hazard GROUP BY ALL)
SELECT row // 16 AS band, count(*) AS cells, round(sum(value), 4) AS total, min(row) AS first_row, max(col) AS last_col FROM c WHERE row * 0.5 - 21.75 BETWEEN -5 AND 9.5 AND col * 0.5 - 0.75 > 10 AND col * 0.5 - 0.75 < 41 GROUP BY row // 16""")
def grid_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a raster written by tiles, and the sums of its cells in a box, of which only the windows that it meets are read."""
    h = hazard_events(spark, sf_dir)
    cells = h.select(F.floor((F.col("lat") + 22) / 0.5).cast("int").alias("row"), F.floor((F.col("lon") + 1) / 0.5).cast("int").alias("col"), "value")
    folder = f"{shared_folder(spark)}/grid-{uuid.uuid4().hex}"
    layout = rasters.Layout(rows=88, cols=124, step=0.5, south=-21.75, west=-0.75, tile=16, flipped=True, transposed=True, roll=31)
    rasters.write_grid(cells, folder, layout)
    box = rasters.read_grid(spark, folder).where(BOXED)
    return box.groupBy(F.floor(F.col("row") / 16).alias("band")).agg(F.count("*").alias("cells"), F.round(F.sum("value"), 4).alias("total"), F.min("row").alias("first_row"), F.max("col").alias("last_col"))
