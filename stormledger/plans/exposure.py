"""Queries of exposure, policy over the ledger, the refresh gate and selections, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.functions import geometry as G
from stormledger.functions.columns import haversine_km
from stormledger.operators import documents, episodes, experiments, exposure, joins, policy, refresh, tracks
from stormledger.plans.catalogue import KM, query
from stormledger.plans.feeds import WALK
from stormledger.plans.policies import METHOD
from stormledger.plans.shapes import AREA, COVERS, HAVERSINE, IN_BOX, LAND_SQL, NEAREST, OUTER, SIDES, SLABS, countries, foot, footprints
from stormledger.sources.hazard import GRID, HAZARD, hazard_events, population_grid, table


@query(foot("alert = 'Red' AND type = 'Wildfire'") + f""", c AS (SELECT event_id, people, lat_c, lon_c, {COVERS.format(x='lon_c', y='lat_c')} AS inside, {NEAREST.format(x='lon_c', y='lat_c')} AS n FROM foot, grid WHERE abs(lat_c - lat) <= 3 AND abs(lon_c - lon) <= 3 AND event_id % 11 <> 0), d AS (SELECT *, CASE WHEN inside THEN 0 ELSE {HAVERSINE.format(x='lon_c', y='lat_c')} END AS km FROM c),
s AS (SELECT event_id, CAST(coalesce(sum(people) FILTER (WHERE inside), 0) AS BIGINT) AS direct, CAST(coalesce(sum(people) FILTER (WHERE km <= 5), 0) AS BIGINT) AS within FROM d GROUP BY event_id)
SELECT event_id, direct AS population_direct, within AS population_within_5km, CASE WHEN within IS NOT NULL THEN greatest(0, within - direct) END AS population_5km_ring FROM foot LEFT JOIN s USING (event_id)""")
def fire_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People inside each fire's footprint, within 5 km and in the ring; every eleventh has no shape."""
    f = footprints(spark, sf_dir, "alert = 'Red' and type = 'Wildfire'").withColumn("rings", F.when(F.col("event_id") % 11 != 0, F.col("rings")))
    return exposure.fire_people(f, "event_id", population_grid(spark))


PEOPLE_SQL = foot("alert = 'Red' AND type = 'Wildfire'") + f""", c AS (SELECT event_id, people, lat_c, lon_c, {COVERS.format(x='lon_c', y='lat_c')} AS inside, {NEAREST.format(x='lon_c', y='lat_c')} AS n FROM foot, grid WHERE abs(lat_c - lat) <= 3 AND abs(lon_c - lon) <= 3 AND event_id % 11 <> 0), d AS (SELECT *, CASE WHEN inside THEN 0 ELSE {HAVERSINE.format(x='lon_c', y='lat_c')} END AS km FROM c),
s AS (SELECT event_id, CAST(coalesce(sum(people) FILTER (WHERE inside), 0) AS DOUBLE) AS direct, CAST(coalesce(sum(people) FILTER (WHERE km <= 5), 0) AS DOUBLE) AS within FROM d GROUP BY event_id),
x AS (SELECT event_id, direct, within, CAST(CASE event_id % 6 WHEN 0 THEN 1100 + event_id % 800 WHEN 3 THEN 2 END AS DOUBLE) AS told, CAST(CASE event_id % 6 WHEN 0 THEN event_id END AS DOUBLE) AS told5 FROM foot LEFT JOIN s USING (event_id)) """


@query(PEOPLE_SQL + """SELECT event_id, coalesce(told, direct) AS population_direct, coalesce(told5, within) AS population_within_5km, CASE WHEN told IS NOT NULL THEN 'GDACS/GWIS:source_reported_current_episode' WHEN direct IS NOT NULL THEN 'footprint:spatial_fallback' END AS direct_from, CASE WHEN told5 IS NOT NULL THEN 'GDACS/GWIS:source_reported_current_episode' WHEN within IS NOT NULL THEN 'footprint:spatial_fallback' END AS within_from FROM x""")
def source_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People near fires as the source's payload tells them, else as their footprints hold them, each with where it is from (K3, K6, K7)."""
    f = footprints(spark, sf_dir, "alert = 'Red' and type = 'Wildfire'").withColumn("rings", F.when(F.col("event_id") % 11 != 0, F.col("rings")))
    derived = exposure.fire_people(f, "event_id", population_grid(spark)).select("event_id", F.col("population_direct").alias("people_inside"), F.col("population_within_5km").alias("people_within_5km"))
    told = documents.payload_facts(f.select("event_id", F.expr(WALK).alias("payload")), "event_id").select("event_id", "latest_episode", "population_burned_area", "population_within_5km")
    both = episodes.source_first(derived.join(told, "event_id"), {"population_direct": ("population_burned_area", "people_inside"), "population_within_5km": ("population_within_5km", "people_within_5km")}, "GDACS/GWIS", "latest_episode")
    of = lambda n: F.when(F.col("provenance")[n].isNotNull(), F.concat_ws(":", F.col("provenance")[n]["source"], F.col("provenance")[n]["method"]))
    names = ("population_direct", "population_within_5km")
    return both.select("event_id", *[F.col("metrics")[n].alias(n) for n in names], of(names[0]).alias("direct_from"), of(names[1]).alias("within_from"))


ASSETS = foot("alert = 'Red'") + f""", land AS (SELECT n_name AS country, n_nationkey AS k, {SIDES} AS sides FROM (SELECT *, {LAND_SQL} AS rings FROM nation)), of AS (SELECT country, k, row, col FROM land, grid WHERE {COVERS.format(x='lon_c', y='lat_c')}),
met AS (SELECT event_id, type, row, col, people FROM foot, grid WHERE event_id % 13 <> 0 AND {IN_BOX} AND {COVERS.format(x='lon_c', y='lat_c')}),
sums AS (SELECT event_id, sum(people * 30) / 100.0 AS land, sum((row * 7 + col * 5) % 50 * 40) / 100.0 AS forest, sum(people * 40) / 100.0 AS crop, CAST(sum(people) AS BIGINT) AS people FROM met GROUP BY event_id),
part AS (SELECT event_id, country, k, CAST(sum(people) AS BIGINT) AS people, CASE WHEN k % 6 > 0 THEN 1000.0 + 37 * k END AS rate FROM met JOIN of USING (row, col) WHERE people > 0 AND type IN ('Flood', 'Storm') GROUP BY ALL),
gdp AS (SELECT event_id, sum(people * rate) AS value, round(sum(people) FILTER (WHERE rate IS NOT NULL) / sum(people) * 100, 1) AS coverage, string_agg(country || ':' || people, ',' ORDER BY people * rate DESC, country) FILTER (WHERE rate IS NOT NULL) AS components FROM part GROUP BY event_id HAVING sum(people) FILTER (WHERE rate IS NOT NULL) > 0) """


@query(ASSETS + f"""SELECT event_id, type, CASE WHEN type = 'Heat' THEN 'no_assets' WHEN event_id % 13 = 0 THEN 'unmapped' ELSE 'ready' END AS status, CASE WHEN type = 'Drought' AND event_id % 13 <> 0 THEN round({AREA}, 2) END AS mapped_km2, CASE WHEN type = 'Drought' THEN land END AS land_km2, CASE WHEN type IN ('Drought', 'Wildfire') THEN forest END AS forest_km2,
  CASE WHEN type = 'Drought' THEN crop END AS crop_km2, CASE WHEN type = 'Flood' THEN s.people END AS people, round(gdp.value, 2) AS gdp_usd, coverage AS coverage_pct, components FROM foot LEFT JOIN sums s USING (event_id) LEFT JOIN gdp USING (event_id)""")
def asset_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each hazard's footprint holds: land, forests and crops, people, and the economy by country."""
    n, k = F.col("event_id"), F.col("n_nationkey")
    f = footprints(spark, sf_dir, "alert = 'Red'").withColumn("rings", F.when(n % 13 != 0, F.col("rings")))
    grid = population_grid(spark).withColumns({"land_ha": F.col("people") * 30, "forest_ha": (F.col("row") * 7 + F.col("col") * 5) % 50 * 40, "crop_ha": F.col("people") * 40})
    rates = table(spark, sf_dir, "nation").where(k % 6 > 0).select(F.col("n_name").alias("country"), (1000.0 + 37 * k).cast("double").alias("rate"))
    got = exposure.by_hazard(f, "event_id", grid, countries(spark, sf_dir), rates)
    listed = F.when(F.col("components").isNotNull(), F.array_join(F.transform("components", lambda x: F.concat_ws(":", x["country"], x["people"].cast("string"))), ","))
    return got.select("event_id", "type", "status", F.round("mapped_km2", 2).alias("mapped_km2"), "land_km2", "forest_km2", "crop_km2", "people", F.round("gdp_usd", 2).alias("gdp_usd"), "coverage_pct", listed.alias("components"))


FIRE_METHOD = f"CASE event_id % 4 WHEN 0 THEN '{exposure.ADMITTED}' WHEN 1 THEN NULL ELSE 'fire polygon' END"


@query(HAZARD + f""", l AS (SELECT day, type, event_id, event_id % 13 <> 0 AS mapped, CASE WHEN type = 'Wildfire' THEN {FIRE_METHOD} ELSE {METHOD} END AS method, event_id % 5 > 0 AND event_id % 11 <> 3 AND event_id % 7 > 0 AND coalesce(value > 0 AND (50 + event_id % 200) / 100.0 BETWEEN 0.5 AND 2.0, false) AS ok FROM hazard),
c AS (SELECT *, mapped AND (event_id % 3 = 0 OR (type = 'Wildfire' AND (event_id % 2 = 1 OR (ok AND method IS DISTINCT FROM '{exposure.ADMITTED}') OR (NOT ok AND method IS NULL)))) AS changed FROM l)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS records, count(*) FILTER (WHERE mapped) AS mapped, count(*) FILTER (WHERE changed) AS changed, count(*) FILTER (WHERE mapped AND type = 'Wildfire' AND ok) AS admitted FROM c GROUP BY day""")
def policy_over_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy of today over the ledger of all days: mapped records, those that it changes and fires that it admits."""
    n, fire = F.col("event_id"), F.col("type") == "Wildfire"
    h = hazard_events(spark, sf_dir).withColumns({
        "mapped": n % 13 != 0, "method": F.when(fire, F.expr(FIRE_METHOD)).otherwise(F.expr(METHOD)), "mapped_ha": F.col("value") * (50 + n % 200), "burned_ha": F.col("value") * 100,
        "episode": F.lit(16), "source": F.when(n % 5 > 0, "GDACS/GWIS"), "source_episode": F.when((n % 7 > 0) & (n % 11 != 3), 16),
    })
    stored = policy.fire_qc(F.col("mapped_ha"), F.col("burned_ha"), F.col("episode"), F.col("source"), F.lit("source_reported_current_episode"), F.col("source_episode"))
    h = h.withColumn("qc", F.when(fire & (n % 2 == 0), stored))
    g = policy.geometry_grade(F.col("type"), F.col("method"), F.col("qc"))
    ledger = h.withColumn("g", g).withColumns({"grade": F.when(n % 3 == 0, "older_grade").otherwise(F.col("g.grade")), "role": F.col("g.role")}).drop("g")
    counts = [F.count("*").alias("records"), F.count_if("mapped").alias("mapped"), F.count_if("changed").alias("changed"), F.count_if(F.col("mapped") & fire & (F.col("grade") == "exposure_grade")).alias("admitted")]
    return exposure.enforced(ledger).groupBy(F.col("day").cast("string").alias("day")).agg(*counts)


SUMMARY = "CASE event_id % 4 WHEN 0 THEN 'Burned area: ' || (1000 + event_id) || ' ha, before 1,5' || (event_id % 10) || '0 hectares.' WHEN 1 THEN NULL WHEN 2 THEN 'No area, 12 has 7 km' ELSE 'About 12 345 HA' END"
REGION = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' Land ' ELSE 'Land ' || event_id % 20 END"


@query(HAZARD + f"""SELECT event_id, CASE WHEN alert = 'Red' THEN 'High' WHEN alert = 'Orange' AND p IS DISTINCT FROM 'High' THEN 'Medium' ELSE p END AS priority, regexp_replace(coalesce(s, ''), '(?i)\\b[0-9][0-9,.\\s]*\\s*(?:ha|hectares?)\\b', format('{{:,}}', CAST(round_even(value * 100, 0) AS BIGINT)) || ' ha', 'g') AS summary,
  coalesce(nullif(trim(r), ''), 'UNKNOWN') AS region FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Standard' END AS p, {SUMMARY} AS s, {REGION} AS r FROM hazard)""")
def alert_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities raised by alerts, summaries with the area of the headline, and region keys."""
    n = F.col("event_id")
    own = F.when(n % 3 == 0, "High").when(n % 3 == 1, "Standard")
    h = hazard_events(spark, sf_dir)
    return h.select("event_id", exposure.promoted(own, F.col("alert")).alias("priority"), exposure.area_replaced(F.expr(SUMMARY), F.col("value") * 100).alias("summary"), exposure.region_key(F.expr(REGION)).alias("region"))


@query(HAZARD + """, s AS (SELECT day, count(*) AS n, sum(CAST(alert IS NOT NULL AS INT)) AS a, count(DISTINCT (event_id % 9)) AS steps FROM hazard GROUP BY day), c AS (SELECT a.day, a.n <> b.n AS content, a.a <> b.a AS semantic, (SELECT max(day) FROM s x WHERE x.day <= a.day AND x.day >= a.day - 10 AND x.steps = 9) AS latest, (SELECT max(day) FROM s x WHERE x.day <= b.day AND x.day >= b.day - 10 AND x.steps = 9) AS prior, a.n % 7 = 0 AS forced FROM s a JOIN s b ON b.day = a.day - 1),
g AS (SELECT *, forced OR semantic AS "full", NOT (forced OR semantic) AND (latest IS NULL OR prior IS DISTINCT FROM latest) AS ifs FROM c)
SELECT CAST(day AS VARCHAR) AS day, "full" AS full_refresh, "full" OR ifs AS climate_refresh, true AS maintenance_refresh, true AS any_refresh, array_to_string(list_filter([CASE WHEN forced THEN 'manual_dispatch' END, CASE WHEN semantic THEN 'source_semantics_changed' WHEN content THEN 'source_metadata_churn_suppressed' END, 'new_utc_day', CASE WHEN ifs THEN 'ifs_cycle_changed_or_unverified' END], lambda x: x IS NOT NULL), ',') AS reason FROM g""")
def refresh_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day refreshes against the day before: all, climate, maintenance, and why; the cycle is the latest one with all its steps."""
    h = hazard_events(spark, sf_dir)
    s = h.groupBy("day").agg(F.count("*").alias("n"), F.count("alert").alias("a"), F.countDistinct(F.col("event_id") % 9).alias("steps"))
    latest = refresh.latest_cycle(s, "day", F.col("steps") == 9, days=10)
    both = s.join(latest, "day")
    before = both.select(F.date_add("day", 1).alias("day"), *[F.col(c).alias(f"old_{c}") for c in ("n", "a", "cycle")])
    d = both.join(before, "day").withColumns({"forced": F.col("n") % 7 == 0, "event_changed": F.col("a") != F.col("old_a"), "content_changed": F.col("n") != F.col("old_n"), "previous_at": F.date_add("day", -1), "current_at": F.col("day")})
    gate = refresh.gate(d.withColumnRenamed("old_cycle", "prior_cycle").withColumnRenamed("cycle", "latest_cycle"))
    return gate.select(F.col("day").cast("string").alias("day"), "full_refresh", "climate_refresh", "maintenance_refresh", "any_refresh", "reason")


@query(foot("alert = 'Red' AND type = 'Wildfire' AND day BETWEEN DATE '2024-01-08' AND DATE '2024-01-28'") + ", d AS (SELECT *, user_id % 12 AS grp0, min(day) OVER (PARTITION BY user_id % 12) AS first FROM foot), s AS (SELECT grp0 * 2 AS grp, event_id AS member, 0 AS layer, rings FROM d UNION ALL SELECT grp0 * 2 + 1, event_id, 0, rings FROM d WHERE day = first)" + SLABS.replace("{covered}", "d0 > 0") + """
SELECT CAST(a.grp // 2 AS BIGINT) AS complex, round(a.area, 2) AS union_km2, round(b.area, 2) AS first_km2, round(greatest(0, a.area - b.area), 2) AS added_km2 FROM covered a JOIN covered b ON a.grp % 2 = 0 AND b.grp = a.grp + 1""")
def period_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of a period's footprints by fire complex, that of the first day, and what was added."""
    f = footprints(spark, sf_dir, "alert = 'Red' and type = 'Wildfire' and day between date'2024-01-08' and date'2024-01-28'").withColumn("complex", F.col("user_id") % 12)
    got = exposure.growth(f.select("complex", "day", "rings"), ["complex"], "day")
    return got.select("complex", *[F.round(c, 2).alias(c) for c in ("union_km2", "first_km2", "added_km2")])


CONFIG = "SELECT l_linenumber * 10 + CAST(l_tax * 100 AS INT) AS config, count(DISTINCT l_suppkey) AS events, CAST(avg(l_quantity) AS DOUBLE) AS csi, CAST(avg(l_extendedprice) AS DOUBLE) AS area FROM lineitem GROUP BY ALL"


@query(f"WITH c AS ({CONFIG}), s AS (SELECT * FROM c WHERE events >= greatest(1, ceil((SELECT max(events) FROM c) * 0.9))) SELECT config, round(area, 4) AS area, round(csi, 6) AS csi, events FROM s WHERE csi + 1e-12 >= 0.95 * (SELECT max(csi) FROM s) ORDER BY area, csi DESC, config LIMIT 1")
def supported_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the configurations that nine tenths of the events support, the smallest that keeps 95 % of the best skill."""
    config = (F.col("l_linenumber") * 10 + (F.col("l_tax") * 100).cast("int")).alias("config")
    c = table(spark, sf_dir, "lineitem").groupBy(config).agg(F.countDistinct("l_suppkey").alias("events"), F.avg("l_quantity").cast("double").alias("csi"), F.avg("l_extendedprice").cast("double").alias("area"))
    return tracks.parsimonious(c, "config", "area", "csi", support="events").select("config", F.round("area", 4).alias("area"), F.round("csi", 6).alias("csi"), "events")


@query(HAZARD + """SELECT id, burned_area_ha FROM hazard WHERE type = 'Wildfire' AND burned_area_ha >= 5000 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 240 HOUR AND ts <= TIMESTAMP '2024-01-20' ORDER BY burned_area_ha DESC, id DESC LIMIT 30""")
def prospective_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest fit fires that were detected lately: ready footprint, QC passed, by area and id."""
    n = F.col("event_id")
    h = hazard_events(spark, sf_dir).where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp")).withColumns({"footprint": F.when(n % 3 > 0, "ready").otherwise("pending"), "qc": F.when(n % 5 > 0, "pass").otherwise("failed"), "last_detection": F.col("ts")})
    return experiments.prospective(h, F.lit("2024-01-20").cast("timestamp"), least_ha=5000.0, fresh_hours=240.0, limit=30).select("id", "burned_area_ha")


@query(HAZARD + ", a AS (SELECT DISTINCT type || '/' || user_id AS id FROM hazard WHERE day <= DATE '2024-01-04'), b AS (SELECT DISTINCT type || '/' || user_id AS id FROM hazard WHERE day BETWEEN DATE '2024-01-02' AND DATE '2024-01-05') SELECT id, CASE WHEN b.id IS NULL THEN 'missing' ELSE 'unlisted' END AS fault FROM a FULL JOIN b USING (id) WHERE a.id IS NULL OR b.id IS NULL")
def universe_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the events of a benchmark differ from the ones that were frozen."""
    h, i = hazard_events(spark, sf_dir), F.concat_ws("/", "type", "user_id").alias("id")
    return experiments.universe_faults(h.where("day <= date'2024-01-04'").select(i), h.where("day between date'2024-01-02' and date'2024-01-05'").select(i), "id")


RING_KM2 = "pow(radians(0.5), 2) * cos(radians(lat_c)) * 6371.0071809 * 6371.0071809"


@query(HAZARD + ", " + GRID + f""", e AS (SELECT event_id, lat, lon, 20000.0 * (1 + event_id % 7) AS target FROM hazard WHERE type = 'Storm' AND alert = 'Red'), c AS (SELECT event_id, target, {KM.format(a='e', b='g')} AS km, {RING_KM2} AS km2 FROM e, (SELECT *, lat_c AS lat, lon_c AS lon FROM grid) g WHERE abs(lat_c - e.lat) <= 6 AND abs(lon_c - e.lon) <= 6),
s AS (SELECT *, sum(km2) OVER (PARTITION BY event_id ORDER BY km RANGE UNBOUNDED PRECEDING) AS s FROM c WHERE km <= 600) SELECT event_id, round(min(km) FILTER (WHERE s >= target), 2) AS radius_km, round(min(s) FILTER (WHERE s >= target), 3) AS area_km2 FROM s GROUP BY event_id""")
def matched_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius about each storm whose cells have the area of its corridor, by halving."""
    e = hazard_events(spark, sf_dir).where("type = 'Storm' and alert = 'Red'").select("event_id", "lat", "lon", (20000.0 * (1 + F.col("event_id") % 7)).alias("target"))
    near = joins.cells_within(e, population_grid(spark), 6.0)
    cells = near.select("event_id", "target", haversine_km(F.col("lat"), F.col("lon"), F.col("lat_c"), F.col("lon_c")).alias("km"), (F.pow(F.radians(F.lit(0.5)), 2) * F.cos(F.radians("lat_c")) * G.AUTHALIC_KM**2).alias("km2"))
    got = exposure.matched_radius(cells, "event_id", "target", most_km=600.0)
    return got.select("event_id", F.round("radius_km", 2).alias("radius_km"), F.round("area_km2", 3).alias("area_km2"))


@query(HAZARD + "SELECT event_id, 500.0 + event_id % 900 AS target, round(500.0 + event_id % 900, 3) AS area_km2 FROM hazard WHERE type = 'Wildfire'")
def scaled_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines in local kilometres stretched until their area on the sphere is the one wanted."""
    h = hazard_events(spark, sf_dir).where("type = 'Wildfire'").withColumn("target", (500.0 + F.col("event_id") % 900).cast("double"))
    ring = F.array(*[F.struct(F.lit(dx * 30.0).alias("x"), F.lit(dy * 30.0).alias("y")) for dx, dy in OUTER])
    h = h.withColumn("f", exposure.scaled_to(ring, F.col("lat"), F.col("lon"), F.col("target")))

    def point(p):
        lat, lon = exposure.from_local(p["x"] * F.col("f"), p["y"] * F.col("f"), F.col("lat"), F.col("lon"))
        return F.struct(lon.alias("x"), lat.alias("y"))

    return h.select("event_id", "target", F.round(G.area_km2(F.array(F.transform(ring, point))), 3).alias("area_km2"))
