"""Queries of records, documents and maps of the reporting and research tracks, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormledger.functions import geometry as G
from stormledger.functions.columns import alert_rank
from stormledger.operators import documents, episodes, experiments, tracks
from stormledger.operators.identity import ordered_distinct
from stormledger.plans.catalogue import KM, query
from stormledger.plans.experiments import SKILL, skill_of
from stormledger.plans.shapes import foot, footprints
from stormledger.sources.hazard import GRID, HAZARD, hazard_events, population_grid, table

EPISODES = """CASE event_id % 5 WHEN 0 THEN NULL ELSE '{"episodes":[{"episodeid":1,"ha":"' || (100 + event_id % 50) || '","fromdate":"2024-01-01","todate":"2024-01-03"},{"episodeid":"2","ha":' || (event_id % 70) || ',"fromdate":"2024-01-02"' || CASE WHEN event_id % 3 = 0 THEN ',"days":"5"' ELSE '' END || '}]}' END"""


@query(HAZARD + """, h AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN 1 + event_id % 3 END AS headline, burned_area_ha AS own, event_id % 5 > 0 AS told FROM hazard WHERE type = 'Wildfire')
SELECT event_id, headline, round(coalesce(CASE WHEN told AND headline = 1 THEN 100 + event_id % 50 WHEN told AND headline = 2 THEN event_id % 70 END, own), 4) AS burned_area_ha, CASE WHEN told AND headline = 1 THEN '2024-01-01' WHEN told AND headline = 2 THEN '2024-01-02' END AS start_date, CASE WHEN told AND headline = 1 THEN '2024-01-03' END AS last_detection,
  CASE WHEN told AND headline = 1 THEN 2 WHEN told AND headline = 2 AND event_id % 3 = 0 THEN 5 END AS duration_days, CASE WHEN headline IS NULL THEN 'no_episode' WHEN NOT told OR headline = 3 THEN 'episode_unknown' WHEN headline = 1 THEN 'newer_episode_pending' ELSE 'current' END AS note FROM h""")
def episode_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline facts of fires taken from the payload of the episode that each headline is about, and whether a newer one is pending (K4, K8)."""
    n = F.col("event_id")
    fires = hazard_events(spark, sf_dir).where("type = 'Wildfire'")
    asked = fires.select("event_id", F.expr(EPISODES).alias("payload")).where("payload is not null").withColumn("episode", F.explode(F.array(F.lit(1), F.lit(2))))
    asked = asked.withColumn("key", F.struct("event_id", "episode"))
    told = documents.payload_episodes(asked, "key", "episode").select("key.event_id", "key.episode", *episodes.ALIGNED)
    heads = fires.select("event_id", F.when(n % 7 > 0, 1 + n % 3).alias("headline"), "burned_area_ha", *[F.lit(None).cast(t).alias(c) for c, t in (("start_date", "string"), ("last_detection", "string"), ("duration_days", "long"))])
    return episodes.aligned(heads, "event_id", told).withColumn("burned_area_ha", F.round("burned_area_ha", 4))


SAYS = "CASE event_id % 5 WHEN 0 THEN 'Medium impact for agricultural drought in 1,' || (100 + event_id % 900) || ' km2. Alert level: Orange.' WHEN 1 THEN 'A red alert over ' || event_id || ' km2' WHEN 2 THEN NULL ELSE 'Nothing of note' END"


@query(HAZARD + f""", e AS (SELECT *, {SAYS} AS s, CASE event_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Standard' END AS p FROM hazard), c AS (SELECT *, coalesce(CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN 'Red' ELSE 'Orange' END WHEN 1 THEN 'Red' ELSE CASE WHEN event_id % 3 = 0 THEN 'Red' END END, NULL) AS level FROM e),
v AS (SELECT *, event_id % 2 = 0 AS known FROM c), d AS (SELECT event_id, CASE WHEN known THEN level END AS l, CASE WHEN type = 'Drought' AND event_id % 5 = 0 THEN 1000.0 + 100 + event_id % 900 END AS km2, p, known FROM v)
SELECT event_id, CASE WHEN l = 'Red' THEN 'High' WHEN l = 'Orange' AND p IS DISTINCT FROM 'High' THEN 'Medium' ELSE p END AS priority, l AS alert_level, CASE WHEN known THEN km2 END AS km2, CASE WHEN known AND km2 IS NOT NULL THEN 'source_published_event_severity_text' END AS method FROM d""")
def source_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A display view with the alerts and drought areas that the canonical events' texts tell."""
    n = F.col("event_id")
    h = hazard_events(spark, sf_dir).select("event_id", "type", F.expr(SAYS).alias("summary"), F.when(n % 4 == 0, "High").when(n % 4 == 1, "Standard").alias("priority"), F.when(n % 3 == 0, "Red").alias("alert_level"), F.lit("feed").alias("source"))
    shown = h.withColumns({"summary": F.lit(None).cast("string"), "alert_level": F.lit(None).cast("string")})  # the display view has no text of its own
    got = episodes.patched_views(episodes.source_semantics(h.where(n % 2 == 0)), episodes.source_semantics(shown), "event_id")
    key = episodes.DROUGHT_KM2
    return got.select("event_id", "priority", "alert_level", F.col("metrics")[key].alias("km2"), F.col("provenance")[key]["method"].alias("method"))


@query(HAZARD + ", " + GRID + """, e AS (SELECT event_id, type, lat, lon, CAST(floor((lat + 21.75) / 0.5 + 0.5) AS INT) AS y, CAST(floor((lon + 0.75) / 0.5 + 0.5) AS INT) AS x FROM hazard WHERE alert = 'Red' AND type IN ('Drought', 'Wildfire')), p AS (SELECT e.*, g.row, g.col, round(""" + KM.format(a="e", b="g") + """, 1) AS km FROM e LEFT JOIN (SELECT *, lat_c AS lat, lon_c AS lon FROM grid WHERE people >= 40) g ON g.row = y AND g.col = x),
m AS (SELECT type, CAST(floor(avg(value) FILTER (WHERE day < DATE '2024-01-10')) AS BIGINT) AS early, CAST(floor(avg(value) FILTER (WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20')) AS BIGINT) AS modern FROM hazard GROUP BY type)
SELECT event_id, CASE WHEN row IS NULL THEN 'unavailable' WHEN event_id % 3 = 0 THEN 'partial' ELSE 'complete' END AS status, row, CASE WHEN row IS NOT NULL THEN km END AS km, CASE WHEN row IS NOT NULL THEN 3 END AS periods, CASE WHEN row IS NOT NULL THEN CAST(early AS DOUBLE) END AS early, CASE WHEN row IS NOT NULL THEN CAST(modern AS DOUBLE) END AS modern, CASE WHEN row IS NOT NULL THEN CASE WHEN event_id % 3 = 0 THEN 'unavailable' ELSE 'ready' END END AS recent FROM p JOIN m USING (type)""")
def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Climate documents of events: the cell that stands for each and a record a period, where there is one; read back from their JSON."""
    h, n = hazard_events(spark, sf_dir), F.col("event_id")
    e = h.where("alert = 'Red' and type in ('Drought', 'Wildfire')").select("event_id", "type", "lat", "lon")
    cell = tracks.ring_cells(e.select("event_id", "lat", "lon"), "event_id", population_grid(spark).where("people >= 40"), 0.5, -21.75, -0.75, rings=0)
    mean = lambda where: F.floor(F.avg(F.when(F.expr(where), F.col("value")))).cast("double")
    by_type = h.groupBy("type").agg(mean("day < date'2024-01-10'").alias("1_early"), mean("day between date'2024-01-10' and date'2024-01-20'").alias("2_modern"))
    rows = e.join(by_type, "type").withColumn("3_recent", F.when(n % 3 != 0, 1.0))
    periods = rows.select("event_id", F.explode(F.array(*[F.struct(F.lit(c).alias("period"), F.lit("tmp").alias("variable"), F.col(c).alias("value")) for c in ("1_early", "2_modern", "3_recent")])).alias("x")).select("event_id", "x.*")
    docs = episodes.climate_documents(e.join(cell.drop("ring"), "event_id"), "event_id", periods)
    read = F.from_json("doc", "comparison_location struct<row int, col int, km double>, periods array<struct<period string, status string, values map<string,double>>>").alias("d")
    at = lambda k, f: F.get("d.periods", F.lit(k))[f]
    d = docs.select("event_id", "status", read)
    return d.select("event_id", "status", F.col("d.comparison_location.row").alias("row"), F.col("d.comparison_location.km").alias("km"), F.when(F.col("d.periods").isNotNull(), F.size("d.periods")).alias("periods"), at(0, "values")["tmp"].alias("early"), at(1, "values")["tmp"].alias("modern"), at(2, "status").alias("recent"))


@query(SKILL + """, f AS (SELECT event % 10 AS fold, config, quantile_cont(csi, 0.5) AS m FROM k GROUP BY ALL), b AS (SELECT event, first(config ORDER BY coalesce(csi, '-inf'::DOUBLE) DESC, config) AS config FROM k GROUP BY event), c AS (SELECT event % 10 AS fold, config, count(*) AS n FROM b GROUP BY ALL)
SELECT CAST(fold AS BIGINT) AS fold, CAST(sum(n) AS BIGINT) AS n, string_agg(config || '=' || n, ',' ORDER BY config) AS frequencies FROM c GROUP BY fold""")
def frequency_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each configuration was the best of an event, by fold."""
    best = experiments.best_configs(skill_of(spark, sf_dir), "event", "config", "csi").withColumn("fold", (F.col("event") % 10).cast("long"))
    m = episodes.frequencies(best, "fold", "config")
    return m.select("fold", "n", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("frequencies"))


TIMES = """CASE event_id % 4 WHEN 0 THEN NULL ELSE '{"fromdate":"' || CAST(day AS STRING) || '","todate":"' || CASE WHEN event_id % 5 = 1 THEN 'soon' ELSE CAST(day AS STRING) END || '","ha":1}' END"""


@query(HAZARD + """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN d END AS source_updated_at, CASE WHEN event_id % 4 = 1 THEN d WHEN type = 'Wildfire' AND event_id % 4 > 0 THEN d END AS event_start, CASE WHEN event_id % 9 = 2 THEN d END AS event_end, CASE WHEN event_id % 6 = 5 THEN d WHEN type = 'Wildfire' AND event_id % 4 > 0 AND event_id % 5 <> 1 THEN d END AS last_detection, d AS operational_event_date FROM (SELECT *, CAST(day AS VARCHAR) AS d FROM hazard)""")
def temporal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of an event; a fire without its own start or last detection has those that its payload tells."""
    n, day, none = F.col("event_id"), F.col("day").cast("string"), F.lit(None).cast("string")
    h = hazard_events(spark, sf_dir)
    own = F.struct(F.when(n % 3 > 0, day).alias("source_updated_at"), F.when(n % 4 == 1, day).otherwise("").alias("event_start"), F.when(n % 9 == 2, day).alias("event_end"), F.when(n % 6 == 5, day).alias("last_detection"), day.alias("event_date"))
    told = documents.payload_episodes(h.where("type = 'Wildfire'").select("event_id", F.expr(TIMES).alias("payload"), F.lit(None).cast("long").alias("n")), "event_id", "n").select("event_id", F.struct("start_date", "last_detection").alias("fire"))
    return h.select("event_id", own.alias("event")).join(told, "event_id", "left").select("event_id", episodes.event_times("event", "fire").alias("x")).select("event_id", "x.*")


@query(foot("alert = 'Red'") + "SELECT event_id, len(flatten(rings)) AS points, round(list_sum(list_transform(flatten(rings), lambda p: round(p.x, 1))), 4) AS sum_x, round(list_sum(list_transform(flatten(rings), lambda p: round(p.y, 1))), 4) AS sum_y FROM foot")
def rounded_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons with coordinates rounded for publication."""
    p = F.flatten(G.rounded(F.col("rings"), 1))
    return footprints(spark, sf_dir, "alert = 'Red'").select("event_id", F.size(p).cast("long").alias("points"), *[F.round(G.total(F.transform(p, get)), 4).alias(name) for name, get in (("sum_x", lambda q: q["x"]), ("sum_y", lambda q: q["y"]))])


@query("WITH n AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL) SELECT x.a || '_' || y.b AS config, x.a AS status, y.b AS priority, coalesce(n, 0) AS n FROM (SELECT DISTINCT a FROM n) x CROSS JOIN (SELECT DISTINCT b FROM n) y LEFT JOIN n ON n.a = x.a AND n.b = y.b")
def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All configurations of a search by the values that its axes take, with their ids, and how many trials each has."""
    return episodes.config_grid(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")), ["status", "priority"])


@query(HAZARD + "SELECT id, type, rank FROM (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY ts DESC, event_id) AS rank FROM hazard) WHERE rank <= 12")
def display_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twelve events of each hazard, one record each."""
    w = Window.partitionBy("type").orderBy(F.desc("ts"), "event_id")
    return hazard_events(spark, sf_dir).select("id", "type", F.row_number().over(w).alias("rank")).where("rank <= 12")


@query(HAZARD + ", c AS (SELECT type, CAST(floor(lat * 4) AS BIGINT) AS y, CAST(floor(lon * 4) AS BIGINT) AS x, max(CASE alert WHEN 'Red' THEN 3 WHEN 'Orange' THEN 2 WHEN 'Green' THEN 1 ELSE 0 END) AS confidence, round(max(value), 6) AS frp, epoch_us(max(ts)) AS last FROM hazard GROUP BY ALL) SELECT * FROM c WHERE confidence >= 1")
def fire_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest confidence, power and time of each pixel over a window."""
    h = hazard_events(spark, sf_dir)
    c = h.groupBy("type", F.floor(F.col("lat") * 4).alias("y"), F.floor(F.col("lon") * 4).alias("x")).agg(F.max(alert_rank(F.col("alert"))).alias("confidence"), F.round(F.max("value"), 6).alias("frp"), F.unix_micros(F.max("ts")).alias("last"))
    return c.where("confidence >= 1")


@query("SELECT p_brand AS listing, first(p_name ORDER BY upper(p_name) LIKE '%A%' DESC, length(p_name), p_name) AS name FROM part GROUP BY p_brand")
def file_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each listing the file with the wanted word in its name, else the shortest name."""
    return episodes.best_file(table(spark, sf_dir, "part").select(F.col("p_brand").alias("listing"), F.col("p_name").alias("name")), "listing", "name", "a")


@query(HAZARD + ", o AS (SELECT user_id, type, min(event_id) AS i FROM hazard GROUP BY ALL), l AS (SELECT user_id, string_agg(type, ',' ORDER BY i) AS types FROM o GROUP BY user_id) SELECT user_id, types FROM l")
def ordered_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct hazards of each source in order of first sight (I4)."""
    return ordered_distinct(hazard_events(spark, sf_dir), "user_id", "type", "event_id").select("user_id", F.array_join("types", ",").alias("types"))


@query(HAZARD + ", t AS (SELECT DISTINCT user_id FROM hazard WHERE event_id % 50 = 1), s AS (SELECT DISTINCT user_id FROM hazard WHERE event_id % 50 = 2) SELECT count(*) AS leaked, coalesce(min(user_id), -1) AS first FROM (SELECT * FROM t INTERSECT SELECT * FROM s)")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources on both sides of a split: none if it is clean."""
    h = hazard_events(spark, sf_dir)
    both = h.where("event_id % 50 = 1").select("user_id").intersect(h.where("event_id % 50 = 2").select("user_id"))
    return both.agg(F.count("*").alias("leaked"), F.coalesce(F.min("user_id"), F.lit(-1).cast("long")).alias("first"))
