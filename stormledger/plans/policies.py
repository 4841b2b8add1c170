"""Queries of identity, display policy, the refresh gate and reports, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.functions import columns as C
from stormledger.operators import documents, evaluation, identity, joins, ledger, policy, refresh
from stormledger.plans.catalogue import CODE, MEMBERS, ORACLES, query, with_members
from stormledger.sources.hazard import HAZARD, hazard_events

METHOD = """CASE event_id % 9 WHEN 0 THEN 'gdacs_observed_wind_34kt_polygon' WHEN 1 THEN 'GDACS actual wind 64 knots polygon' WHEN 2 THEN 'forecast_wind_34kt_polygon' WHEN 3 THEN 'observed wind polygon' WHEN 4 THEN NULL WHEN 5 THEN 'observed-wind-34kt-polygon unverified' WHEN 6 THEN 'observed 34 kt' WHEN 7 THEN 'actual wind 134kt polygon' ELSE 'observed  wind 34kts  polygon' END"""
PROV = "CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE ' GDACS/GWIS ' END"
FACTS = f"""SELECT event_id, type, origin, alert, {METHOD} AS method, {PROV} AS prov, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 16 END AS src_episode, 16 + CAST(event_id % 11 = 3 AS INT) AS episode, value * 100 AS burned, value * (50 + event_id % 200) AS mapped,
  CAST(floor(value * 180) AS BIGINT) AS people, CASE alert WHEN 'Red' THEN 'High' WHEN 'Orange' THEN 'Medium' ELSE 'Standard' END AS priority, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 4 AS BIGINT) END AS inside, CAST(event_id % 2 AS BIGINT) AS near FROM"""
WORDS = "trim(regexp_replace(lower(coalesce(method, '')), '[\\s_-]+', ' ', 'g'))"
WIND = f"CASE WHEN NOT regexp_matches({WORDS}, 'forecast|fallback|proximity|generic|unverified|screening') AND {WORDS} LIKE '%wind%' AND {WORDS} LIKE '%polygon%' AND regexp_matches({WORDS}, 'observed|actual') THEN CASE WHEN regexp_matches({WORDS}, '\\b34\\s*(kt|kts|knot|knots)\\b') THEN '34 kt' WHEN regexp_matches({WORDS}, '\\b64\\s*(kt|kts|knot|knots)\\b') THEN '64 kt' END END"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FACTS + " {events}", events=hazard_events(spark, sf_dir))


@query(HAZARD + f", f AS ({FACTS} hazard), " + f"""q AS (SELECT *, lower(prov) LIKE '%gdacs%' AND lower(prov) LIKE '%gwis%' AS auth, coalesce(src_episode = episode, false) AS aligned, CASE WHEN burned > 0 AND mapped > 0 THEN mapped / burned END AS ratio, {WIND} AS wind FROM f WHERE event_id % 13 <> 0),
p AS (SELECT *, auth AND aligned AND coalesce(ratio BETWEEN 0.5 AND 2.0, false) AS ok FROM q)
SELECT event_id, CASE WHEN ok THEN 'pass' ELSE 'failed' END AS status, CASE WHEN ok THEN 'episode_aligned_gdacs_gwis_burned_area_perimeter' ELSE array_to_string(list_filter([CASE WHEN NOT auth THEN 'burned_area_source_provenance_not_verified_gdacs_gwis' END, CASE WHEN NOT aligned THEN 'burned_area_and_footprint_episode_not_aligned' END,
  CASE WHEN NOT coalesce(burned > 0, false) THEN 'source_burned_area_missing_or_invalid' END, CASE WHEN NOT coalesce(mapped > 0, false) THEN 'mapped_polygon_area_missing_or_invalid' END, CASE WHEN ratio IS NOT NULL AND NOT ratio BETWEEN 0.5 AND 2.0 THEN 'mapped_area_grossly_inconsistent_with_source_burned_area' END], lambda x: x IS NOT NULL), ';') END AS reason,
  round(ratio, 4) AS ratio, CASE WHEN ok AND abs(mapped - burned) / burned > 0.25 THEN 'mapped_vs_source_burned_area_difference_gt_25pct' END AS warning, wind,
  CASE WHEN (type = 'Wildfire' AND ok) OR (type = 'Storm' AND wind IS NOT NULL) THEN 'exposure_grade' WHEN type = 'Drought' THEN 'risk_grade' ELSE 'context_grade' END AS grade,
  CASE type WHEN 'Wildfire' THEN CASE WHEN ok THEN 'burned_fire_perimeter' ELSE 'wildfire_geometry_pending_perimeter_validation' END WHEN 'Storm' THEN CASE WHEN wind IS NOT NULL THEN 'tropical_cyclone_observed_wind_zone' ELSE 'tropical_cyclone_wind_context_unverified' END WHEN 'Flood' THEN 'reported_flood_event_area_context' WHEN 'Drought' THEN 'drought_risk_impact_area' ELSE 'mapped_event_context' END AS role,
  (type = 'Wildfire' AND ok) OR (type = 'Storm' AND wind IS NOT NULL) AS counts FROM p""")
def geometry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of perimeters and grades of mapped geometries."""
    f = facts(spark, sf_dir).where("event_id % 13 <> 0")
    f = f.withColumn("qc", policy.fire_qc(F.col("mapped"), F.col("burned"), F.col("episode"), F.col("prov"), F.lit("source_reported_current_episode"), F.col("src_episode")))
    grade = policy.geometry_grade(F.col("type"), F.col("method"), F.col("qc"))
    return f.select("event_id", "qc.status", "qc.reason", "qc.ratio", "qc.warning", policy.wind_threshold(F.col("method")).alias("wind"), grade["grade"].alias("grade"), grade["role"].alias("role"), grade["counts"].alias("counts"))


@query(HAZARD + f", f AS ({FACTS} hazard) " + """SELECT event_id, CASE type WHEN 'Wildfire' THEN coalesce(alert IN ('Orange', 'Red'), false) OR (burned >= 10000 AND people >= 10000) WHEN 'Storm' THEN coalesce(alert IN ('Orange', 'Red'), false) OR origin = 'cems' OR coalesce(inside, near) > 0 ELSE true END AS shown,
  CASE type WHEN 'Wildfire' THEN coalesce(alert IN ('Orange', 'Red'), false) OR (burned >= 10000 AND people > 10000) WHEN 'Storm' THEN coalesce(alert IN ('Orange', 'Red'), false) OR coalesce(inside, 0) > 0 OR near > 0 ELSE true END AS shown_strict FROM f""")
def display_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fires and storms are shown, by the final and by the stricter or source-first rules."""
    f = facts(spark, sf_dir)
    p, b, n = F.col("priority"), F.col("burned"), F.col("people")
    by = lambda fire, storm: F.when(F.col("type") == "Wildfire", fire).when(F.col("type") == "Storm", storm).otherwise(True)
    shown = by(policy.fire_shown(p, b, n), policy.storm_shown(p, F.col("origin"), F.col("inside"), F.col("near")))
    return f.select("event_id", shown.alias("shown"), by(policy.fire_shown(p, b, n, strict=True), policy.storm_shown_by_source(p, F.col("inside"), F.col("near"))).alias("shown_strict"))


@query(HAZARD + f", f AS ({FACTS} hazard) " + """SELECT type, count(*) AS n, count(*) FILTER (WHERE t IS NOT NULL AND NOT regexp_matches(t, 'storm surge|stormsurge|rainfall|precip') AND regexp_matches(t, '34kt|34 kt|34 knots|tropical storm|wind|63 km/h|64kt|64 kt')) AS wind FROM (SELECT type, lower(CASE WHEN event_id % 4 = 0 THEN method || ' storm surge' ELSE method END) AS t FROM f) GROUP BY type""")
def wind_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that speak of wind, by hazard."""
    t = F.when(F.col("event_id") % 4 == 0, F.concat("method", F.lit(" storm surge"))).otherwise(F.col("method"))
    return facts(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.count_if(policy.explicit_wind(t)).alias("wind"))


FIRES = HAZARD + """, f AS (SELECT *, CASE WHEN origin = 'cems' AND event_id % 2 = 0 THEN CAST(event_id - 2 AS VARCHAR) END AS gdacs_id, upper(origin) AS source, 'http://x/' || (event_id % 100) AS source_url FROM hazard WHERE type = 'Wildfire'),
i AS (SELECT *, CASE WHEN origin = 'gdacs' OR gdacs_id IS NOT NULL THEN 'gdacs:' || coalesce(gdacs_id, source_id) ELSE origin || ':' || source_id END AS ident FROM f) """


@query(FIRES + """SELECT ident, arg_max(id, struct_pack(g := origin = 'gdacs', t := epoch_us(ts), o := -event_id)) AS id, count(*) AS records, list_aggr(list_distinct(list(source)), 'count') AS n_sources, array_to_string(list(origin || ':' || source_id ORDER BY event_id), ',') AS members, coalesce(bool_or(origin = 'gdacs'), false) AS backed FROM i GROUP BY ident""")
def wildfire_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires merged only where a source links them."""
    n = F.col("event_id")
    f = hazard_events(spark, sf_dir).where("type = 'Wildfire'").withColumns({"gdacs_id": F.when((F.col("origin") == "cems") & (n % 2 == 0), (n - 2).cast("string")), "source": F.upper("origin"), "source_url": F.concat(F.lit("http://x/"), (n % 100).cast("string"))})
    who = identity.fire_identity(f)
    f = f.withColumn("ident", F.concat_ws(":", who["origin"], who["id"]))
    got = identity.merged(f, "ident", "event_id", F.struct((F.col("origin") == "gdacs").cast("int"), F.unix_micros("ts")), ["id", "origin"])
    backed = F.exists("members", lambda m: m.startswith("gdacs:"))
    return got.select("ident", "id", "records", F.size("sources").cast("long").alias("n_sources"), F.array_join("members", ",").alias("members"), backed.alias("backed"))


@query(ORACLES["dedupe_greedy"].replace("SELECT f.event_id, e.event_id AS anchor FROM f JOIN e ON e.i = f.j", """, a AS (SELECT h.*, e.event_id AS anchor FROM f JOIN e ON e.i = f.j JOIN hazard h ON h.event_id = f.event_id)
SELECT anchor, count(*) AS records, max(value) AS top_value, array_to_string(list_distinct(list(origin)).list_sort(), ',') AS origins, max(CASE alert WHEN 'Red' THEN 3 WHEN 'Orange' THEN 2 WHEN 'Green' THEN 1 ELSE 0 END) AS alert_rank,
  first(summary ORDER BY length(coalesce(summary, '')) DESC, ts DESC, event_id) AS summary, CASE WHEN bool_or(ts = top AND seen IS NOT NULL) THEN first(seen ORDER BY ts DESC, event_id DESC) FILTER (WHERE seen IS NOT NULL) END AS last_detection
FROM (SELECT *, CASE WHEN event_id % 4 > 0 THEN repeat('x', CAST(event_id % 13 AS INT)) || event_id % 4 END AS summary, CASE WHEN event_id % 3 > 0 THEN CAST(day AS VARCHAR) END AS seen, max(ts) OVER (PARTITION BY anchor) AS top FROM a) GROUP BY anchor"""))
def dedupe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of the greedy scan as one record each: members, greatest values, all origins, the longest summary and the anchor's times."""
    h, n = hazard_events(spark, sf_dir).where("type <> 'Wildfire'"), F.col("event_id")
    anchors = evaluation.greedy_dedupe(joins.near_pairs(h, times=True), h)
    text = F.when(n % 4 > 0, F.concat(F.repeat(F.lit("x"), (n % 13).cast("int")), (n % 4).cast("string")))
    rows = h.join(anchors, "event_id").withColumns({"summary": text, "last_detection": F.when(n % 3 > 0, F.col("day").cast("string"))})
    merged = identity.proximity_merged(rows, "anchor", "event_id", "ts", ("last_detection",)).select("anchor", "summary", "last_detection")
    sums = rows.groupBy("anchor").agg(F.count("*").alias("records"), F.max("value").alias("top_value"), F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"), F.max(C.alert_rank(F.col("alert"))).alias("alert_rank"))
    return sums.join(merged, "anchor")


@query(HAZARD + MEMBERS + f""", k AS (SELECT event_id, unnest(list_distinct(list_filter([id] || list_transform(members, lambda x: CASE WHEN lower(x.origin) = 'gdacs' THEN 'gdacs-' || {CODE} || '-' || x.source_id WHEN lower(x.origin) IN ('eonet', 'cems') THEN lower(x.origin) || '-' || x.source_id END), lambda x: x IS NOT NULL))) AS alias FROM m),
s AS (SELECT 'eonet-' || user_id AS alias, min(epoch_us(ts)) AS first_seen, max(epoch_us(ts)) AS last_seen, count(*) AS observations FROM hazard GROUP BY user_id UNION ALL SELECT id, epoch_us(ts), epoch_us(ts), 1 FROM hazard WHERE event_id % 2 = 0)
SELECT m.event_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, CAST(sum(observations) AS BIGINT) AS observations FROM m LEFT JOIN (SELECT k.event_id, s.* FROM k JOIN s USING (alias)) x ON x.event_id = m.event_id GROUP BY m.event_id""")
def lifecycle_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last sight of events under any of their aliases."""
    h = hazard_events(spark, sf_dir)
    us = F.unix_micros("ts")
    by_user = h.groupBy(F.concat(F.lit("eonet-"), F.col("user_id").cast("string")).alias("alias")).agg(F.min(us).alias("first_seen"), F.max(us).alias("last_seen"), F.count("*").alias("observations"))
    state = by_user.unionByName(h.where("event_id % 2 = 0").select(F.col("id").alias("alias"), us.alias("first_seen"), us.alias("last_seen"), F.lit(1).cast("long").alias("observations")))
    e = with_members(h).select("event_id", identity.alias_keys(F.col("id"), F.col("type"), F.col("members")).alias("aliases"))
    return identity.lifecycle_of(e, state, "event_id")


SNAP = HAZARD + """, s AS (SELECT user_id || '/' || type AS id, min(origin) AS origin, CAST(min(user_id) AS VARCHAR) AS source_id, min(type) AS type, ' Some  title ' AS title, max(alert) AS alert, max(ts) AS ts, max(lat) AS lat, max(lon) AS lon, max(burned_area_ha) AS burned_area_ha, day, min(user_id) AS u FROM hazard WHERE day IN (DATE '2024-01-10', DATE '2024-01-11') GROUP BY day, user_id, type),
b AS (SELECT * FROM s WHERE day = DATE '2024-01-10'), a AS (SELECT * FROM s WHERE day = DATE '2024-01-11'), d AS (SELECT id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (id)
  WHERE a.id IS NULL OR b.id IS NULL OR (b.origin, coalesce(b.alert, ''), epoch(b.ts)::BIGINT, b.lat, b.lon, coalesce(round(b.burned_area_ha, 1), -1)) IS DISTINCT FROM (a.origin, coalesce(a.alert, ''), epoch(a.ts)::BIGINT, a.lat, a.lon, coalesce(round(a.burned_area_ha, 1), -1))),
l AS (SELECT DISTINCT canonical, id FROM (SELECT 'c' || (u % 40) AS canonical, id FROM a WHERE u % 17 <> 0 UNION ALL SELECT 'c' || (u % 40), id FROM b WHERE u % 17 <> 0 AND 'c' || (u % 40) IN (SELECT 'c' || (u % 40) FROM a WHERE u % 17 <> 0))),
f AS (SELECT d.*, canonical, canonical IS NULL AND change <> 'removed' AS unresolved FROM d LEFT JOIN l USING (id)) """


def snapshot(spark: SparkSession, sf_dir: str, day: str) -> DataFrame:
    h = hazard_events(spark, sf_dir).where(F.col("day") == F.lit(day).cast("date"))
    g = h.groupBy("user_id", "type").agg(F.min("origin").alias("origin"), *[F.max(c).alias(c) for c in ("alert", "ts", "lat", "lon", "burned_area_ha")])
    return g.withColumns({"id": F.concat_ws("/", "user_id", "type"), "source_id": F.col("user_id").cast("string"), "title": F.lit(" Some  title ")})


def canonical_links(s: DataFrame) -> DataFrame:
    return s.where("user_id % 17 <> 0").select(F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("canonical"), F.col("id").alias("source"))


def found_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before, after = snapshot(spark, sf_dir, "2024-01-10"), snapshot(spark, sf_dir, "2024-01-11")
    changes = refresh.changed(refresh.semantic(before), refresh.semantic(after))
    return refresh.affected(changes, canonical_links(before), canonical_links(after)), canonical_links(after)


@query(SNAP + "SELECT id, change, canonical, unresolved FROM f")
def changed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed sources and the canonical events that hold them, now or before."""
    return found_changes(spark, sf_dir)[0].select("id", "change", "canonical", "unresolved")


@query(SNAP + """, c AS (SELECT count(DISTINCT id) AS sources, count(DISTINCT canonical) AS events, count(DISTINCT CASE WHEN unresolved THEN id END) AS unresolved FROM f), n AS (SELECT count(DISTINCT 'c' || (u % 40)) AS n FROM a WHERE u % 17 <> 0), t AS (SELECT *, greatest(12, CAST(ceil(0.25 * n) AS BIGINT)) AS threshold FROM c, n)
SELECT *, CASE WHEN sources = 0 THEN 'none' WHEN unresolved = 0 AND events <= threshold THEN 'incremental' ELSE 'full' END AS mode, CASE WHEN sources = 0 THEN 'no_semantic_change' WHEN unresolved > 0 THEN 'unresolved_sources' WHEN events > threshold THEN 'too_many_events' ELSE 'few_events' END AS reason FROM t""")
def refresh_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a snapshot is made again, and why."""
    return refresh.scope(*found_changes(spark, sf_dir), share=0.25, least=12)


@query(SNAP + """, w AS (SELECT coalesce(a.id, b.id) AS id FROM a FULL JOIN b USING (id) WHERE a.id IS NULL OR b.id IS NULL OR (a.origin, coalesce(a.alert, ''), a.ts, a.lat, a.lon, coalesce(a.burned_area_ha, -1)) IS DISTINCT FROM (b.origin, coalesce(b.alert, ''), b.ts, b.lat, b.lon, coalesce(b.burned_area_ha, -1)))
SELECT count(*) AS broad, (SELECT count(*) FROM d) AS semantic FROM w""")
def content_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events changed in any field of their documents, at any depth, and in one that counts."""

    def document(s: DataFrame, day: str) -> DataFrame:
        # what may change without a change of content: volatile fields inside, and the order of the members
        members = F.array(*[F.struct((F.col("user_id") + k).alias("id"), F.lit(day).alias("last_seen"), F.struct(F.lit(day).alias("checked_at"), "type").alias("of")) for k in (range(3) if day < "2024-01-11" else (2, 0, 1))])
        row = F.struct("id", "origin", "alert", F.unix_micros("ts").alias("ts"), F.struct("lat", "lon", F.lit(day).alias("updated")).alias("at"), "burned_area_ha", F.lit(day).alias("generated_at"), members.alias("members"))
        return s.select("id", F.to_json(row).alias("payload"))

    days = ("2024-01-10", "2024-01-11")
    s = [snapshot(spark, sf_dir, d) for d in days]
    broad = refresh.changed(*[documents.content(document(x, d), "id", refresh.VOLATILE) for x, d in zip(s, days)])
    semantic = refresh.changed(*map(refresh.semantic, s))
    n = [df.agg(F.count("*").alias(name)) for name, df in (("broad", broad), ("semantic", semantic))]
    return n[0].crossJoin(n[1])  # one row each


@query(SNAP + "SELECT a.id, CASE WHEN d.id IS NULL THEN b.burned_area_ha ELSE a.burned_area_ha END AS burned_area_ha, d.id IS NOT NULL AS fresh FROM a LEFT JOIN b USING (id) LEFT JOIN d ON d.id = a.id")
def incremental_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot in which unchanged events are the previous ones and only changed ones are processed again."""
    before, after = snapshot(spark, sf_dir, "2024-01-10"), snapshot(spark, sf_dir, "2024-01-11")
    changes = refresh.changed(refresh.semantic(before), refresh.semantic(after))
    fields = ["id", "burned_area_ha"]
    processed = after.join(changes, "id", "left_semi").select(*fields)
    return refresh.replaced(before.select(*fields), processed, after, "id")


@query(SNAP + """, w AS (SELECT id, sha256(to_json(struct_pack(id := id, v := v))) AS h FROM (SELECT id, CAST(burned_area_ha * 0 + u AS BIGINT) AS v FROM a)), p AS (SELECT substr(h, 1, 3) AS part, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM w GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY part)) AS sha256 FROM p""")
def snapshot_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a set of rows, whatever their order."""
    a = snapshot(spark, sf_dir, "2024-01-11")
    v = (F.col("burned_area_ha") * 0 + F.col("user_id")).cast("long")
    return refresh.fingerprint(a.select(F.struct("id", v.alias("v")).alias("row")))


@query(SNAP + """SELECT id, CASE WHEN a.id IS NULL THEN b.alert WHEN b.id IS NULL THEN coalesce(nullif(ta, ''), ta) ELSE coalesce(nullif(ta, ''), b.alert, ta) END AS alert, coalesce(a.lat, b.lat) AS lat FROM (SELECT *, CASE WHEN u % 3 = 0 THEN '' ELSE alert END AS ta FROM a) a FULL JOIN b USING (id)""")
def view_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views of events by id, missing fields filled from the second."""
    a, b = (snapshot(spark, sf_dir, d).select("id", "alert", "lat", "user_id") for d in ("2024-01-11", "2024-01-10"))
    a = a.withColumn("alert", F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("alert")))
    return refresh.field_fill(a.drop("user_id"), b.drop("user_id"), "id")


@query(SNAP + """, r AS (SELECT id, CASE u % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'ready' ELSE 'other' END AS status, CASE WHEN u % 4 = 2 THEN '' ELSE 'p' END AS path, CASE WHEN u % 3 = 0 THEN NULL ELSE 'why' END AS reason FROM b),
x AS (SELECT r.id, CASE WHEN a.id IS NULL THEN 'unmatched' WHEN status = 'ready' AND path = '' THEN 'ready_without_path' WHEN status = 'unavailable' AND reason IS NULL THEN 'unavailable_without_reason' WHEN status NOT IN ('ready', 'unavailable') THEN 'unknown_status' END AS fault FROM r LEFT JOIN a USING (id)) SELECT * FROM x WHERE fault IS NOT NULL""")
def reference_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of products that no event or no path backs."""
    u = F.col("user_id") % 4
    b = snapshot(spark, sf_dir, "2024-01-10")
    refs = b.select("id", F.when(u == 1, "unavailable").when(u == 3, "other").otherwise("ready").alias("status"), F.when(u == 2, "").otherwise("p").alias("path"), F.when(F.col("user_id") % 3 != 0, "why").alias("reason"))
    return refresh.references(snapshot(spark, sf_dir, "2024-01-11"), refs, "id")


METRIC = "CASE event_id % 6 WHEN 0 THEN 'population_direct' WHEN 1 THEN 'population_within_5km' WHEN 2 THEN 'population_wind_39kt' WHEN 3 THEN 'population_storm_surge' WHEN 4 THEN 'affected_population' ELSE 'fatalities' END"
PERIOD = HAZARD + f""", e AS (SELECT *, {METRIC} AS metric, CASE WHEN event_id % 10 = 0 THEN NULL ELSE floor(value * 70) END AS x, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Title ' || event_id END AS title FROM hazard WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'),
k AS (SELECT user_id, type, metric, max(x) AS top, arg_max(x, struct_pack(t := epoch_us(ts), i := event_id)) AS latest FROM e WHERE x IS NOT NULL GROUP BY ALL),
g AS (SELECT user_id, type, count(DISTINCT day) AS days, arg_max(title, struct_pack(t := epoch_us(ts), i := event_id)) AS title, count(*) AS n, max(CASE alert WHEN 'Red' THEN 3 WHEN 'Orange' THEN 2 WHEN 'Green' THEN 1 ELSE 0 END) AS r, min(day) AS f, max(day) AS l FROM e GROUP BY ALL),
m AS (SELECT user_id, type, map(list(metric), list(top)) AS m FROM k GROUP BY ALL),
s AS (SELECT g.*, CASE type WHEN 'Wildfire' THEN CASE WHEN m['population_direct'] IS NOT NULL THEN 'population_direct' WHEN m['population_within_5km'] IS NOT NULL THEN 'population_within_5km' END WHEN 'Storm' THEN CASE WHEN m['population_wind_39kt'] IS NOT NULL THEN 'population_wind_39kt' WHEN m['population_storm_surge'] IS NOT NULL THEN 'population_storm_surge' END WHEN 'Flood' THEN CASE WHEN m['affected_population'] IS NOT NULL THEN 'affected_population' END END AS key, m FROM g LEFT JOIN m USING (user_id, type)) """


def period_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a source and hazard of a week, with the greatest of each metric in a map."""
    e = hazard_events(spark, sf_dir).where("day between date'2024-01-08' and date'2024-01-14'")
    n = F.col("event_id")
    names = F.create_map(*[F.lit(v) for p in enumerate(("population_direct", "population_within_5km", "population_wind_39kt", "population_storm_surge", "affected_population", "fatalities")) for v in p])
    e = e.withColumns({"metric": names[(n % 6).cast("int")], "x": F.when(n % 10 != 0, F.floor(F.col("value") * 70).cast("double")), "title": F.when(n % 3 != 0, F.concat(F.lit("Title "), n.cast("string")))})
    return ledger.period_events(e, ["user_id", "type"])


@query(HAZARD + """, c AS (SELECT DISTINCT date_trunc('hour', ts) AS cycle, event_id % 1000 AS rid FROM hazard WHERE event_id % 4 = 0), e AS (SELECT id, date_trunc('hour', ts) AS frozen FROM hazard WHERE event_id % 3 = 0), x AS (SELECT e.id, min(c.rid) AS rid FROM e JOIN c ON c.cycle = e.frozen GROUP BY e.id),
n AS (SELECT e.id, min(struct_pack(gap := abs(epoch_us(c.cycle) - epoch_us(e.frozen)), rid := c.rid)) AS n FROM e JOIN c ON abs(epoch_us(c.cycle) - epoch_us(e.frozen)) <= 43200000000 GROUP BY e.id) SELECT e.id, coalesce(x.rid, n.n.rid) AS rid, CASE WHEN x.rid IS NOT NULL THEN 'frozen' WHEN n.n IS NOT NULL THEN 'nearest' END AS match FROM e LEFT JOIN x USING (id) LEFT JOIN n USING (id)""")
def frozen_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycle that was frozen for an event, else the nearest within 12 hours."""
    h, hour = hazard_events(spark, sf_dir), F.date_trunc("hour", "ts")
    c = h.where("event_id % 4 = 0").select(F.lit("all").alias("k"), hour.alias("rts"), (F.col("event_id") % 1000).alias("rid"))
    e = h.where("event_id % 3 = 0").select("id", F.lit("all").alias("k"), hour.alias("ts"))
    got = joins.nearest_in_time(e, c, "k", 12)
    return got.select("id", "rid", F.when(F.col("gap_s") == 0, "frozen").when(F.col("gap_s").isNotNull(), "nearest").alias("match"))


@query(PERIOD + "SELECT user_id, type, days, title, n, r AS alert_rank, key AS metric, m[key] AS people, CASE WHEN m[key] IS NULL THEN '—' WHEN m[key] = 0 THEN '0 people' WHEN m[key] < 1000 THEN '<1,000 people' ELSE '≈' || format('{:,}', CAST(round_even(m[key] / 1000, 0) AS BIGINT) * 1000) || ' people' END AS shown FROM s")
def event_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary rows of a period's events: days, last title, alert, preferred population and how it is printed."""
    p = period_events(spark, sf_dir).withColumn("p", policy.preferred_people(F.col("type"), F.col("metrics_max")))
    return p.select("user_id", "type", "days", "title", "n", "alert_rank", F.col("p.key").alias("metric"), F.col("p.people").alias("people"), C.rounded_people(F.col("p.people")).alias("shown"))


@query(PERIOD + """SELECT 'hazard' AS kind, type AS name, count(*) AS n FROM s GROUP BY type UNION ALL SELECT 'alert', (['Unclassified', 'Green', 'Orange', 'Red'])[r + 1], count(*) FROM s GROUP BY r
UNION ALL SELECT 'lifecycle', CASE WHEN l < DATE '2024-01-14' THEN 'New & resolved this period' ELSE 'New this period' END, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'people', coalesce(key, 'none'), CAST(coalesce(sum(m[key]), 0) AS BIGINT) FROM s GROUP BY ALL""")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a report by hazard, alert and lifecycle, and people by metric."""
    start, end = F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date")
    p = period_events(spark, sf_dir).withColumn("p", policy.preferred_people(F.col("type"), F.col("metrics_max")))
    alert = F.element_at(F.array(*map(F.lit, ("Unclassified", *C.ALERTS))), (F.col("alert_rank") + 1).cast("int"))
    label = C.lifecycle(F.col("first_day"), F.col("last_day"), start, end, F.lit(True))
    of = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n"))
    one = F.lit(1)
    facts_ = F.array(of("hazard", F.col("type"), one), of("alert", alert, one), of("lifecycle", label, one), of("people", F.coalesce("p.key", F.lit("none")), F.coalesce("p.people", F.lit(0.0))))
    return p.select(F.explode(facts_).alias("x")).groupBy("x.kind", "x.name").agg(F.sum("x.n").alias("n"))


@query(HAZARD + """, c AS (SELECT unnest(generate_series(DATE '2024-01-03', DATE '2024-02-05', INTERVAL 7 DAY))::DATE AS start), d AS (SELECT start, count(DISTINCT day) AS days, count(*) AS runs FROM c LEFT JOIN hazard ON day BETWEEN start AND start + 6 GROUP BY start)
SELECT CAST(start AS VARCHAR) AS start, days, runs, round(100.0 * days / 7, 1) AS day_pct, round(100.0 * runs / 21, 1) AS run_pct, CASE WHEN days < 7 THEN 'withheld_incomplete_coverage' ELSE 'complete_frozen_publication' END AS frozen, CASE WHEN days < 7 THEN 'partial_preview' ELSE 'complete_preview' END AS rolling FROM (SELECT start, CASE WHEN runs = 1 AND days = 0 THEN 0 ELSE days END AS days, CASE WHEN days = 0 THEN 0 ELSE runs END AS runs FROM d)""")
def publication_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of weeks in percent, and whether a report of each is published."""
    weeks = spark.sql("SELECT explode(sequence(date'2024-01-03', date'2024-02-05', interval 7 days)) AS start")
    days = hazard_events(spark, sf_dir).groupBy("day").agg(F.count("*").alias("runs"))
    cal = weeks.withColumn("day", F.explode(F.sequence("start", F.date_add("start", 6)))).join(days, "day", "left")
    w = cal.groupBy("start").agg(F.count("runs").alias("days"), F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"))
    status = lambda frozen: policy.publication(F.col("days"), F.lit(7), F.lit(frozen))
    return w.select(F.col("start").cast("string").alias("start"), "days", "runs", F.round(100.0 * F.col("days") / 7, 1).alias("day_pct"), F.round(100.0 * F.col("runs") / 21, 1).alias("run_pct"), status(True).alias("frozen"), status(False).alias("rolling"))


@query(HAZARD + """, d AS (SELECT type, day, count(*) AS n, max(value) AS top FROM hazard GROUP BY ALL)
SELECT type, CAST(w AS VARCHAR) AS week_end, CAST(sum(n) AS BIGINT) AS n, max(top) AS top FROM (SELECT *, unnest(generate_series(day, day + 6, INTERVAL 1 DAY))::DATE AS w FROM d) GROUP BY type, w""")
def sliding_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of every seven days, one a day: daily sums first, then the days of each window (M3, M4)."""
    d = hazard_events(spark, sf_dir).groupBy("type", "day").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    w = d.withColumn("week_end", F.explode(F.sequence("day", F.date_add("day", 6))))
    return w.groupBy("type", F.col("week_end").cast("string").alias("week_end")).agg(F.sum("n").alias("n"), F.max("top").alias("top"))
