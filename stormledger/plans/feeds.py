"""Queries over landed feed payloads and source texts, and the same in DuckDB SQL.

The payloads are written by one SQL text for both engines (event columns put into JSON), with nulls, other shapes and bad
places among them. The oracles read that JSON with DuckDB's own functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.functions import parsing as P
from stormledger.operators import documents
from stormledger.plans.catalogue import query
from stormledger.sources import feeds
from stormledger.sources.hazard import HAZARD, hazard_events

WHEN = "CAST(day AS STRING) || 'T0' || (event_id % 10) || ':30:00Z'"
POLYGON = "'\"type\":\"Polygon\",\"coordinates\":[[[' || lon || ',' || lat || '],[' || (lon + 1) || ',' || lat || '],[' || lon || ',' || (lat + 0.8) || '],[' || lon || ',' || lat || ']]]'"
PLACE = f"CASE WHEN event_id % 4 = 0 THEN {POLYGON} WHEN event_id % 13 = 5 THEN '\"type\":\"Point\",\"coordinates\":[200,10]' ELSE '\"type\":\"Point\",\"coordinates\":[' || lon || ',' || lat || ']' END"
EONET = f"""CASE WHEN event_id % 17 = 3 THEN '{{"events":[{{"id":' ELSE '{{"events":[{{"id":"E' || event_id || '","title":' || CASE WHEN event_id % 6 = 0 THEN 'null' ELSE '"Event ' || event_id || '"' END || ',"description":' || CASE WHEN event_id % 5 = 0 THEN '""' ELSE '"  Some   words of ' || event_id || ' "' END
  || ',"link":"http://l/' || event_id || '","categories":[{{"id":"' || CASE type WHEN 'Storm' THEN 'severeStorms' WHEN 'Flood' THEN 'floods' WHEN 'Drought' THEN 'drought' WHEN 'Heat' THEN 'tempExtremes' ELSE 'wildfires' END || '"}},{{"id":"floods"}}],"sources":[{{"url":null}}'
  || CASE WHEN event_id % 3 = 1 THEN ',{{"url":"http://s/' || event_id || '"}}' ELSE '' END || '],"geometry":[{{"date":"2024-01-01T00:00:00Z","type":"Point","coordinates":[0,0]}},{{"date":"' || {WHEN} || '",' || {PLACE} || '}}]}}]}}' END"""
#: The centre of a geometry object g in DuckDB: a point's numbers, else the mean of the numbers at even and odd places.
CENTRE = """CASE WHEN g->>'$.type' = 'Point' THEN CAST(g->>'$.coordinates[{k}]' AS DOUBLE) ELSE list_avg(list_transform(regexp_extract_all(g->>'$.coordinates', '\\[([-+0-9.eE]+),([-+0-9.eE]+)', {n}), lambda x: CAST(x AS DOUBLE))) END"""
LON, LAT = CENTRE.format(k=0, n=1), CENTRE.format(k=1, n=2)


def raw(spark: SparkSession, sf_dir: str, payload: str, where: str = "true") -> DataFrame:
    return hazard_events(spark, sf_dir).where(where).select("event_id", F.expr(payload).alias("payload"))


@query(HAZARD + f""", raw AS (SELECT {EONET} AS payload FROM hazard), e AS (SELECT payload->'$.events[0]' AS e FROM raw WHERE json_valid(payload)),
c AS (SELECT e, e->'$.geometry[#-1]' AS g, lower(e->>'$.categories[0].id') AS cat FROM e),
p AS (SELECT *, {LON} AS lon, {LAT} AS lat, CASE WHEN cat LIKE '%severestorm%' THEN 'Storm' WHEN cat LIKE '%flood%' THEN 'Flood' WHEN cat LIKE '%drought%' THEN 'Drought' WHEN cat LIKE '%tempextreme%' THEN 'Heat' END AS type FROM c)
SELECT 'eonet-' || (e->>'$.id') AS id, type, coalesce(nullif(e->>'$.title', ''), type || ' event') AS title, round(lat, 6) AS lat, round(lon, 6) AS lon,
  coalesce(nullif(trim(regexp_replace(coalesce(e->>'$.description', ''), '\\s+', ' ', 'g')), ''), type || ' event tracked by the feed.') AS summary, coalesce(e->>'$.sources[1].url', e->>'$.link') AS source_url,
  g->>'$.date' AS event_date, e->>'$.geometry[0].date' AS event_start FROM p WHERE type IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180""")
def feed_eonet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of landed EONET payloads."""
    got = feeds.eonet(raw(spark, sf_dir, EONET))
    return got.select("id", "type", "title", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "summary", "source_url", "event_date", "event_start")


CEMS = f"""'{{"results":[{{"code":' || CASE WHEN event_id % 6 = 0 THEN 'null' ELSE '"EMSR' || event_id || '"' END || ',"name":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '"Name ' || event_id || '"' END || ',"closed":' || CASE WHEN event_id % 4 = 1 THEN 'true' ELSE 'false' END
  || ',"category":{{"slug":"' || CASE type WHEN 'Storm' THEN 'tropical-cyclone' WHEN 'Flood' THEN 'Flood' WHEN 'Drought' THEN 'mass movement' WHEN 'Heat' THEN 'other' ELSE 'forest fire' END || '"}},"centroid":"' || CASE WHEN event_id % 9 = 2 THEN 'nowhere' ELSE 'POINT (' || lon || ' ' || lat || ')' END
  || '","countries":[' || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '"Chad"' ELSE '{{"short_name":"Peru"}},{{"name":""}},"Togo"' END || '],"lastUpdate":' || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE '"' || {WHEN} || '"' END || ',"eventTime":"' || CAST(day AS STRING) || '","gdacsId":' || CASE WHEN event_id % 8 = 0 THEN '"' || (1000000 + event_id) || '"' ELSE 'null' END || '}}]}}'"""


@query(HAZARD + f""", raw AS (SELECT {CEMS} AS payload FROM hazard), e AS (SELECT payload->'$.results[0]' AS e FROM raw),
c AS (SELECT e, lower(e->>'$.category.slug') AS cat, CAST(nullif(regexp_extract(e->>'$.centroid', 'POINT \\(([-0-9.]+) ([-0-9.]+)\\)', 1), '') AS DOUBLE) AS lon, CAST(nullif(regexp_extract(e->>'$.centroid', 'POINT \\(([-0-9.]+) ([-0-9.]+)\\)', 2), '') AS DOUBLE) AS lat FROM e WHERE NOT CAST(e->>'$.closed' AS BOOLEAN)),
p AS (SELECT *, CASE WHEN cat LIKE '%fire%' THEN 'Wildfire' WHEN cat LIKE '%flood%' THEN 'Flood' WHEN cat LIKE '%cyclone%' THEN 'Storm' WHEN cat LIKE '%mass movement%' THEN 'Landslide' END AS type FROM c)
SELECT 'cems-' || coalesce(e->>'$.code', printf('%.2f-%.2f', lat, lon)) AS id, coalesce(e->>'$.code', 'unknown') AS source_id, type, coalesce(e->>'$.name', type || ' activation') AS title,
  CASE WHEN json_array_length(e->'$.countries') = 0 THEN printf('%.2f°, %.2f°', lat, lon) WHEN json_array_length(e->'$.countries') = 1 THEN 'Chad' ELSE 'Peru · Togo' END AS region, lat, lon,
  'Rapid mapping activation' || coalesce(' ' || (e->>'$.code'), '') || '.' || coalesce(' Linked GDACS ID: ' || (e->>'$.gdacsId') || '.', '') AS summary,
  coalesce(e->>'$.lastUpdate', e->>'$.eventTime') AS event_date, e->>'$.lastUpdate' AS last_detection, e->>'$.gdacsId' AS gdacs_id FROM p WHERE type IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180""")
def feed_cems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activations of landed CEMS payloads."""
    return feeds.cems(raw(spark, sf_dir, CEMS)).select("id", "source_id", "type", "title", "region", "lat", "lon", "summary", "event_date", "last_detection", "gdacs_id")


GDACS = f"""'{{"features":[{{"geometry":{{' || {PLACE} || '}},"properties":{{"eventtype":"' || CASE type WHEN 'Storm' THEN 'TC' WHEN 'Flood' THEN 'fl' WHEN 'Drought' THEN 'DR' WHEN 'Heat' THEN 'EQ' ELSE 'WF' END || '","eventid":' || event_id || ',"name":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"Name ' || event_id || '"' END
  || ',"country":' || CASE WHEN event_id % 5 = 0 THEN '""' ELSE '"Land ' || (event_id % 20) || '"' END || ',"iso3":null,"fromdate":"' || CAST(day AS STRING) || '","todate":"' || {WHEN} || '","lastupdate":' || CASE WHEN event_id % 4 = 1 THEN '"2024-02-01"' ELSE 'null' END
  || ',"alertlevel":' || CASE WHEN alert IS NULL THEN 'null' ELSE '"' || alert || '"' END || ',"ha":' || CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN '"900"' WHEN 2 THEN 'null,"burnedArea":' || (6000 + event_id % 9000) WHEN 3 THEN 'null,"BurnedArea":90000,"burnedAreaHa":"' || (7000 + event_id % 9000) || ' ha"' ELSE '"' || (5000 + event_id % 9000) || '"' END || ',"severitydata":{{"severitytext":"' || CASE WHEN event_id % 2 = 0 THEN 'Area of 12,' || (100 + event_id % 800) || ' ha burned' ELSE 'Severity text' END || '"' || CASE event_id % 7 WHEN 0 THEN ',"burnedArea":' || (8000 + event_id % 9000) WHEN 1 THEN ',"note":["about",{{"of":"11,' || (100 + event_id % 800) || ' hectares"}}]' ELSE '' END || '}}}}}}]}}'"""
def hectares_sql(x: str) -> str:
    unit = "(?i)([0-9][0-9.,\\s]*)\\s*(?:ha|hectares?)"
    bare = f"TRY_CAST(replace({x}, ',', '') AS DOUBLE)"
    return f"CASE WHEN regexp_matches({x}, '{unit}') THEN TRY_CAST(regexp_replace(regexp_extract({x}, '{unit}', 1), '[\\s,]', '', 'g') AS DOUBLE) WHEN {bare} >= 1000 THEN {bare} END"


AREA_SQL = "coalesce(" + ", ".join(hectares_sql(f"(q->>'$.{c}')") for c in (*feeds.AREA_FIELDS, *(f"severitydata.{c}" for c in feeds.SEVERITY_FIELDS), "severitydata")) + ")"
GDACS_SQL = f""", raw AS (SELECT {GDACS} AS payload FROM hazard), e AS (SELECT payload->'$.features[0].geometry' AS g, payload->'$.features[0].properties' AS q FROM raw),
p AS (SELECT *, {LON} AS lon, {LAT} AS lat, CASE upper(q->>'$.eventtype') WHEN 'FL' THEN 'Flood' WHEN 'TC' THEN 'Storm' WHEN 'WF' THEN 'Wildfire' WHEN 'DR' THEN 'Drought' END AS type FROM e),
a AS (SELECT *, CASE WHEN type = 'Wildfire' THEN {AREA_SQL} END AS area FROM p WHERE type IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180),
r AS (SELECT *, coalesce(nullif(q->>'$.country', ''), printf('%.2f°, %.2f°', lat, lon)) AS region, q->>'$.alertlevel' AS level FROM a) """


@query(HAZARD + GDACS_SQL + """SELECT 'gdacs-' || (q->>'$.eventtype') || '-' || (q->>'$.eventid') AS id, type, coalesce(q->>'$.name', type || ' in ' || region) AS title, region, CASE level WHEN 'Red' THEN 'High' WHEN 'Orange' THEN 'Medium' ELSE 'Standard' END AS priority,
  coalesce('Burned area: ' || format('{:,}', CAST(area AS BIGINT)) || ' ha. ', '') || (q->>'$.severitydata.severitytext') || coalesce(' Alert level: ' || level || '.', '') AS summary, 'GDACS' || coalesce(' · ' || level, '') AS source,
  coalesce(q->>'$.lastupdate', CASE WHEN type = 'Wildfire' THEN q->>'$.todate' END, q->>'$.fromdate') AS event_date, q->>'$.lastupdate' AS source_updated_at, q->>'$.fromdate' AS event_start, CASE WHEN type = 'Wildfire' THEN q->>'$.todate' END AS last_detection, area AS burned_area_ha
  FROM r WHERE type <> 'Wildfire' OR area >= 10000""")
def feed_gdacs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of landed GDACS payloads, large fires only."""
    return feeds.gdacs(raw(spark, sf_dir, GDACS)).select("id", "type", "title", "region", "priority", "summary", "source", "event_date", "source_updated_at", "event_start", "last_detection", "burned_area_ha")


@query(HAZARD + GDACS_SQL + "SELECT type, level, count(*) AS n, count(area) AS with_area, count(*) FILTER (WHERE type = 'Wildfire' AND area IS NULL) AS area_unknown FROM r WHERE type <> 'Wildfire' OR coalesce(area >= 10000, false) OR coalesce(level IN ('Orange', 'Red'), false) GROUP BY ALL")
def feed_gdacs_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of features where only small green fires go."""
    g = feeds.gdacs(raw(spark, sf_dir, GDACS), green_only=True).withColumn("level", F.nullif(F.regexp_extract("source", "· (.*)$", 1), F.lit("")))
    return g.groupBy("type", "level").agg(F.count("*").alias("n"), F.count("burned_area_ha").alias("with_area"), F.count_if((F.col("type") == "Wildfire") & F.col("burned_area_ha").isNull()).alias("area_unknown"))


@query(HAZARD + "SELECT id, origin, origin = 'cems' AS stale FROM hazard WHERE (origin = 'cems' AND day = DATE '2024-01-10') OR (origin <> 'cems' AND day = DATE '2024-01-11')")
def source_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot in which the poll of one origin failed, so its rows of the day before stand for it (A10, M6)."""
    h = hazard_events(spark, sf_dir).select("id", "origin", "day")
    polls = spark.createDataFrame([("gdacs", True), ("eonet", True), ("cems", False)], "origin string, ok boolean")
    got = feeds.carry_forward(h.where("day = date'2024-01-11'"), h.where("day = date'2024-01-10'"), polls)
    return got.select("id", "origin", "stale")


@query(HAZARD + ", s AS (SELECT user_id, type, min(ts) AS a, max(ts) AS b FROM hazard WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY ALL) SELECT user_id, type, date_diff('day', a::DATE, DATE '2024-01-20') AS age FROM s WHERE date_diff('day', a::DATE, DATE '2024-01-20') BETWEEN 8 AND 21 AND b >= TIMESTAMP '2024-01-13'")
def late_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that began 8 to 21 days ago and were detected in the last 7 days."""
    now = F.lit("2024-01-20").cast("timestamp")
    s = hazard_events(spark, sf_dir).where(F.col("ts") <= now).groupBy("user_id", "type").agg(F.min("ts").alias("event_start"), F.max("ts").alias("last_detection"))
    return feeds.late_starts(s, now).select("user_id", "type", F.datediff(now, F.col("event_start")).cast("long").alias("age"))


NOTE = """CASE event_id % 16 WHEN 0 THEN 'Burned 1,' || (100 + event_id % 800) || ',250.5 ha near town' WHEN 1 THEN ' 12 345 people' WHEN 2 THEN 'N/A' WHEN 3 THEN '-' || event_id WHEN 4 THEN (event_id % 100) || '.5' WHEN 5 THEN 'Drought impact over 1,412,468 km2' WHEN 6 THEN 'drought only 55 km2'
  WHEN 7 THEN 'level RED and orange' WHEN 8 THEN 'green fields, bored' WHEN 9 THEN NULL WHEN 10 THEN '' WHEN 11 THEN 'Yes' WHEN 12 THEN 'gdacs_observed-wind  34kt_polygon' WHEN 13 THEN '12 hectares' WHEN 14 THEN '999' ELSE '5000' END"""
NUM = "regexp_replace(regexp_replace(regexp_replace(trim(t), '(\\d)[,\\s](\\d{3})(\\D|$)', '\\1\\2\\3', 'g'), '(\\d)[,\\s](\\d{3})(\\D|$)', '\\1\\2\\3', 'g'), '(\\d)[,\\s](\\d{3})(\\D|$)', '\\1\\2\\3', 'g')"
FIRST = "TRY_CAST(nullif(regexp_extract({x}, '(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE)"


@query(HAZARD + f""", n AS (SELECT event_id, alert, {NOTE} AS t FROM hazard), x AS (SELECT *, {FIRST.format(x=NUM)} AS f FROM n)
SELECT event_id, f AS number, CASE WHEN f >= 0 AND lower(trim(t)) NOT IN ('n/a', 'na', 'null', 'none', '-') THEN CAST(round_even(f, 0) AS BIGINT) END AS people,
  CASE WHEN regexp_matches(t, '[0-9][0-9.,\\s]*\\s*(?:ha|hectares)') THEN TRY_CAST(regexp_replace(regexp_extract(t, '([0-9][0-9.,\\s]*)\\s*(?:ha|hectares)', 1), '[\\s,]', '', 'g') AS DOUBLE) WHEN TRY_CAST(replace(t, ',', '') AS DOUBLE) >= 1000 THEN TRY_CAST(replace(t, ',', '') AS DOUBLE) END AS hectares,
  CASE WHEN regexp_matches(t, '[0-9][0-9,.\\s]*\\s*(?:ha|hectares?)\\b') THEN f END AS area_ha, CASE WHEN lower(t) LIKE '%drought%' AND (lower(t) LIKE '%impact%' OR lower(t) LIKE '%risk%') THEN f END AS drought_km2,
  coalesce(lower(trim(t)) IN ('1', 'true', 'yes', 'y'), false) AS yes, regexp_replace(upper(coalesce(t, '')), '[^A-Z0-9.]', '', 'g') AS key, trim(regexp_replace(lower(coalesce(t, '')), '[\\s_-]+', ' ', 'g')) AS method,
  CASE WHEN event_id % 3 = 0 AND alert IS NOT NULL THEN alert WHEN regexp_matches(lower(t), '\\bred\\b') THEN 'Red' WHEN regexp_matches(lower(t), '\\borange\\b') THEN 'Orange' WHEN regexp_matches(lower(t), '\\bgreen\\b') THEN 'Green' ELSE '' END AS level,
  TRY_CAST(trim(t) AS DOUBLE) AS finite FROM x""")
def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, areas, flags, keys, methods and levels of source texts."""
    n = hazard_events(spark, sf_dir).select("event_id", "alert", F.expr(NOTE).alias("t"))
    t = F.col("t")
    return n.select(
        "event_id", P.as_float(t).alias("number"), P.as_count(t).alias("people"), P.hectares(t).alias("hectares"), P.area_text(t).alias("area_ha"), P.drought_area_km2(t).alias("drought_km2"), P.truthy(t).alias("yes"),
        P.normal_key(t).alias("key"), P.method_words(t).alias("method"), P.alert_level(F.when(F.col("event_id") % 3 == 0, F.initcap(F.lower("alert"))), t).alias("level"), P.finite(t).alias("finite"),
    )


@query(HAZARD + """, d AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) END AS s FROM hazard),
x AS (SELECT *, greatest(0, CAST(round_even(s / 3600, 0) AS BIGINT)) AS h, CAST(round_even(greatest(0, round_even(s / 3600, 0)) / 24, 0) AS BIGINT) AS dd FROM d)
SELECT event_id, CASE WHEN s IS NULL OR s < -300 THEN 'Update time unavailable' WHEN h < 1 THEN 'Updated <1 hour ago' WHEN h < 24 THEN 'Updated ' || h || ' h ago' ELSE 'Updated ' || dd || ' day' || CASE WHEN dd = 1 THEN '' ELSE 's' END || ' ago' END AS label FROM x""")
def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago each event was updated (H4)."""
    at = F.when(F.col("event_id") % 11 != 0, F.col("ts"))
    return hazard_events(spark, sf_dir).select("event_id", P.age_label(at, F.lit("2024-01-20").cast("timestamp")).alias("label"))


WALK = """CASE event_id % 6 WHEN 0 THEN '{"datums":[{"datum":[{"datasource":"POP","POPAFFECTED":"1,' || (100 + event_id % 800) || '","SUMPOP5.0":"' || event_id || '"},{"datasource":"other","SUMPOP10":7}]}],"run":{"modelname":"","modelrun":2024},"modelname":"WF","modelrun":1,"episodeid":' || (event_id % 50) || '}'
  WHEN 1 THEN '{"scalars":[{"name":"SUMPOP1","value":' || event_id || '},{"name":"sumpop2","value":"x"},{"name":"SUMPOP2.0","amount":"1 234"}],"properties":{"episodes":[{"episodeid":"3"},{"episode_id":' || (event_id % 9) || '},{"episode":"none"}]}}'
  WHEN 2 THEN '{"channel":{"item":[{"id":"a","actual":"true","current":"false","advisory_datetime":"02 Jan 2024 06:00","pop39":"10"},{"id":"b","actual":"true","current":"true","advisory_number":7,"wind_speed":"85","advisory_datetime":"01 Jan 2024 06:00","pop39":"' || event_id || '","pop74":"20","popstormsurge":""},{"id":"c","actual":"false","current":"true","advisory_datetime":"05 Jan 2024 06:00","pop39":"99"}]}}'
  WHEN 3 THEN '{"deep":{"er":[[{"SUMPOP0":null},{"SUMPOP0":2.5}]]}}' WHEN 4 THEN NULL ELSE '{"broken":' END"""


@query(HAZARD + f""", r AS (SELECT event_id, event_id % 6 AS k, {WALK} AS p FROM hazard)
SELECT event_id, CASE k WHEN 0 THEN CAST(p->>'$.episodeid' AS BIGINT) WHEN 1 THEN greatest(3, CAST(p->>'$.properties.episodes[1].episode_id' AS BIGINT)) END AS latest_episode,
  CASE k WHEN 0 THEN CAST(replace(p->>'$.datums[0].datum[0].POPAFFECTED', ',', '') AS BIGINT) WHEN 3 THEN 2 END AS population_burned_area, CASE k WHEN 1 THEN CAST(p->>'$.scalars[0].value' AS BIGINT) END AS population_within_1km,
  CASE k WHEN 1 THEN 1234 END AS population_within_2km, CASE k WHEN 0 THEN CAST(p->>'$.datums[0].datum[0].\"SUMPOP5.0\"' AS BIGINT) END AS population_within_5km, CAST(NULL AS BIGINT) AS population_within_10km,
  CASE k WHEN 2 THEN CAST(p->>'$.channel.item[1].pop39' AS BIGINT) END AS population_wind_39kt, CASE k WHEN 2 THEN 20 END AS population_wind_74kt, CAST(NULL AS BIGINT) AS population_storm_surge, CASE k WHEN 2 THEN 'b' END AS advisory, CASE k WHEN 2 THEN true END AS advisory_current,
  CASE k WHEN 0 THEN '1' END AS model_run, CAST(NULL AS VARCHAR) AS model_status, CASE k WHEN 0 THEN 'WF' END AS model_name, CASE k WHEN 2 THEN '7' END AS advisory_number, CASE k WHEN 2 THEN '01 Jan 2024 06:00' END AS advisory_time,
  CASE k WHEN 2 THEN '85' END AS wind_speed, CAST(NULL AS VARCHAR) AS coordinates, CAST(NULL AS VARCHAR) AS alert_score, CASE k WHEN 2 THEN true END AS advisory_actual
  FROM (SELECT event_id, k, CASE WHEN k < 4 THEN p END AS p FROM r)""")
def payload_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes, impact numbers and the best advisory of nested payloads."""
    return documents.payload_facts(raw(spark, sf_dir, WALK), "event_id")


EPISODE = """CASE event_id % 5 WHEN 0 THEN '{"episodes":[{"episodeid":1,"Ha":"9,999","fromdate":"2024-01-01"},{"episodeid":"2","burned-area":"' || event_id || '","severitytext":"5 ha","fromdate":"02 Jan 2024","todate":"2024-01-09T00:00:00"}]}'
  WHEN 1 THEN '{"title":"Fire of 1,' || (100 + event_id % 800) || ' ha","startdate":"03/01/2024","Duration (days)":"7"}' WHEN 2 THEN '{"episode":2,"ha":-4,"name":"none","enddate":"soon"}' WHEN 3 THEN NULL ELSE '{"a":[{"hectares":"' || event_id || '"},{"episode_id":2}]}' END"""


@query(HAZARD + """, k AS (SELECT event_id, event_id % 5 AS k FROM hazard) SELECT event_id, CASE k WHEN 0 THEN event_id WHEN 1 THEN 1000 + 100 + event_id % 800 END::DOUBLE AS burned_area_ha, CASE k WHEN 0 THEN 'burned-area' WHEN 1 THEN 'title' END AS area_field,
  CASE k WHEN 0 THEN '2024-01-02' WHEN 1 THEN '2024-01-03' END AS start_date, CASE k WHEN 0 THEN '2024-01-09' END AS last_detection, CASE k WHEN 0 THEN 7 WHEN 1 THEN 7 END AS duration_days, CASE k WHEN 0 THEN 'derived' WHEN 1 THEN 'Duration (days)' END AS duration_field FROM k""")
def episode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, dates and duration of the second episode in nested payloads."""
    return documents.payload_episodes(raw(spark, sf_dir, EPISODE).withColumn("n", F.lit(2)), "event_id", "n")


@query(HAZARD + """, a AS (SELECT event_id, radians(lat) AS p, radians(20.0) AS q, radians(35.0 - lon) AS d, value, event_id % 40 AS z FROM hazard), b AS (SELECT *, (degrees(atan2(sin(d) * cos(q), cos(p) * sin(q) - sin(p) * cos(q) * cos(d))) + 360) % 360 AS bearing FROM a)
SELECT event_id, round(bearing, 6) AS bearing, round(abs((bearing - 10 + 180 + 360) % 360 - 180), 6) AS turn, round(sqrt(value * value + z * z), 6) AS speed, round(CASE WHEN z <> 0 THEN value / z END, 6) AS ratio FROM b""")
def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearings to a place, angles to a wind, speeds and ratios."""
    h, z = hazard_events(spark, sf_dir), F.col("event_id") % 40
    to = P.bearing(F.col("lat"), F.col("lon"), F.lit(20.0), F.lit(35.0))
    return h.select("event_id", F.round(to, 6).alias("bearing"), F.round(P.turn_between(to, F.lit(10.0)), 6).alias("turn"), F.round(F.hypot("value", z), 6).alias("speed"), F.round(P.safe_ratio(F.col("value"), z), 6).alias("ratio"))
