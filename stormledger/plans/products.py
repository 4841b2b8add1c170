"""Queries of sources, sinks and gates of products, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.operators import evaluation, experiments, policy, refresh, shapes
from stormledger.plans.catalogue import KM, query
from stormledger.plans.policies import METHOD, WIND
from stormledger.sources import storage
from stormledger.sources.hazard import GRID, HAZARD, hazard_events, population_grid, table

HOSTS = ("gdacs.org", "europa.eu")
URL = "CASE event_id % 7 WHEN 0 THEN 'https://www.gdacs.org/report.aspx?id=' || event_id WHEN 1 THEN 'http://gdacs.org' WHEN 2 THEN 'https://evilgdacs.org/x' WHEN 3 THEN 'https://mapping.EUROPA.eu/a' WHEN 4 THEN 'not a link' WHEN 5 THEN NULL ELSE 'https://gdacs.org.evil.com/' END"


@query(HAZARD + f", u AS (SELECT event_id, lower(coalesce(regexp_extract({URL}, '^https?://([^/?#]+)', 1), '')) AS h FROM hazard) SELECT event_id, h IN ('gdacs.org', 'europa.eu') OR h LIKE '%.gdacs.org' OR h LIKE '%.europa.eu' AS allowed FROM u")
def host_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose host may be asked."""
    return hazard_events(spark, sf_dir).select("event_id", storage.allowed_host(F.expr(URL), HOSTS).alias("allowed"))


@query("""WITH c AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN '-99' WHEN n_nationkey % 4 = 1 THEN '' ELSE upper(left(n_name, 3)) END AS a, CASE WHEN n_nationkey % 8 = 0 THEN '-99' ELSE 'X' || (10 + n_nationkey) END AS b, 'LONGER' AS c FROM nation),
d AS (SELECT k, CASE WHEN a NOT IN ('', '-99') THEN a WHEN b NOT IN ('', '-99') THEN b ELSE c END AS x FROM c) SELECT k, CASE WHEN length(x) = 3 THEN upper(x) END AS code FROM d""")
def country_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of countries whose first ones may be unknown."""
    k = F.col("n_nationkey")
    a = F.when(k % 4 == 0, "-99").when(k % 4 == 1, "").otherwise(F.upper(F.substring("n_name", 1, 3)))
    b = F.when(k % 8 == 0, "-99").otherwise(F.concat(F.lit("X"), (k + 10).cast("string")))
    return table(spark, sf_dir, "nation").select(k.alias("k"), storage.country_code(a, b, F.lit("LONGER")).alias("code"))


@query("""WITH r AS (SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 6 = 0 THEN 'AB' ELSE ' ' || lower(left(n_name, 3)) END AS code, CASE WHEN s_suppkey % 5 = 0 THEN 'n/a' ELSE CAST(s_acctbal AS VARCHAR) END AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT upper(trim(code)) AS code, arg_max(TRY_CAST(v AS DOUBLE), pos) AS value FROM r WHERE length(trim(code)) = 3 AND TRY_CAST(v AS DOUBLE) >= 0 GROUP BY 1""")
def gdp_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last valid rate of each country."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    r = s.select(k.alias("at"), F.when(k % 6 == 0, "AB").otherwise(F.concat(F.lit(" "), F.lower(F.substring("n_name", 1, 3)))).alias("code"), F.when(k % 5 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string")).alias("v"))
    return storage.rates(r, "code", "v", "at")


@query(HAZARD + """, c AS (SELECT id, value FROM hazard WHERE event_id % 3 = 0), d AS (SELECT id, value + 1 AS value FROM hazard WHERE event_id % 2 = 0), s AS (SELECT id, value + 2 AS value FROM hazard WHERE event_id % 5 = 0), w AS (SELECT id FROM hazard)
SELECT w.id, coalesce(c.value, d.value, s.value, -1) AS value, CASE WHEN c.id IS NOT NULL THEN 'canonical' WHEN d.id IS NOT NULL THEN 'display' WHEN s.id IS NOT NULL THEN 'source' ELSE 'fallback' END AS view FROM w LEFT JOIN c USING (id) LEFT JOIN d USING (id) LEFT JOIN s USING (id)""")
def event_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's record in the first view that has it, else a fallback one."""
    h = hazard_events(spark, sf_dir)
    views = [h.where(f"event_id % {m} = 0").select("id", (F.col("value") + k).alias("value")) for k, m in enumerate((3, 2, 5))]
    found = h.select("id").join(storage.lookup(views, "id"), "id", "left")
    names = F.create_map(*[F.lit(x) for p in enumerate(("canonical", "display", "source")) for x in p])
    return found.select("id", F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce(names[F.col("view")], F.lit("fallback")).alias("view"))


@query(HAZARD + "SELECT user_id, count(*) AS features, count(*) FILTER (WHERE event_id % 3 = 0) AS seeds, count(*) FILTER (WHERE event_id % 3 = 1) AS tracks, coalesce(max(lon) FILTER (WHERE event_id % 3 = 0), -1) AS east FROM hazard WHERE alert = 'Red' GROUP BY user_id")
def artifact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen artifacts written as feature collections, and read back by the kind of each feature."""
    kind = F.when(F.col("event_id") % 3 == 0, "seed").when(F.col("event_id") % 3 == 1, "track").otherwise("perimeter")
    docs = storage.feature_collection(hazard_events(spark, sf_dir).where("alert = 'Red'").withColumn("kind", kind), "user_id", "lon", "lat", "kind", "event_id", order="event_id")
    schema = "features array<struct<geometry struct<coordinates array<double>>, properties struct<kind string>>>"
    f = docs.select("user_id", F.explode(F.from_json("geojson", schema)["features"]).alias("f")).select("user_id", "f.properties.kind", F.get("f.geometry.coordinates", F.lit(0)).alias("x"))
    is_kind = lambda k: F.col("kind") == k
    return f.groupBy("user_id").agg(F.count("*").alias("features"), F.count_if(is_kind("seed")).alias("seeds"), F.count_if(is_kind("track")).alias("tracks"), F.coalesce(F.max(F.when(is_kind("seed"), F.col("x"))), F.lit(-1.0)).alias("east"))


@query(HAZARD + "SELECT event_id, event_id % 3 = 0 AS kept, CASE WHEN event_id % 3 = 0 THEN 'old' ELSE 'new' END AS stamp FROM hazard")
def stabilised_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that differ from the stored ones in their time alone stay as they are."""
    n = F.col("event_id").cast("string")
    doc = lambda stamp, v, order: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in (['{"generated_at":"', F.lit(stamp), '","v":', v, ',"z":{"a":1}}'] if order else ['{"z":{"a":1},"v":', v, ',"generated_at":"', F.lit(stamp), '"}'])])
    h = hazard_events(spark, sf_dir)
    old = h.where("event_id % 3 < 2").select("event_id", doc("old", n, True).alias("doc"))
    new = h.select("event_id", doc("new", F.when(F.col("event_id") % 3 == 0, n).otherwise(F.concat(n, F.lit("1"))), False).alias("doc"))
    got = storage.stabilised(old, new, "event_id")
    return got.select("event_id", "kept", F.get_json_object("doc", "$.generated_at").alias("stamp"))


@query(HAZARD + """SELECT 'latest' AS place, '2024-01-12' AS generated_at, count(*) AS n FROM hazard WHERE day = DATE '2024-01-12' UNION ALL SELECT 'archive', CAST(day AS VARCHAR), count(*) FROM hazard WHERE day IN (DATE '2024-01-11', DATE '2024-01-12') GROUP BY day UNION ALL SELECT 'archive', '2024-01-10', count(*) FROM hazard WHERE day = DATE '2024-01-10' AND alert = 'Red' HAVING count(*) > 0""")
def snapshot_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three snapshots and a second run of the first: the latest, and an archive with one entry a run."""
    folder = f"{storage.shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    h = hazard_events(spark, sf_dir).select("id", "alert", "day")
    for day, where in (("2024-01-10", "true"), ("2024-01-11", "true"), ("2024-01-10", "alert = 'Red'"), ("2024-01-12", "true")):
        storage.write_snapshot(h.where(f"day = date'{day}' and {where}").drop("day"), folder, day)
    at = F.col("generated_at").cast("string").alias("generated_at")
    read = lambda place: spark.read.parquet(f"{folder}/{place}").groupBy(at).agg(F.count("*").alias("n")).withColumn("place", F.lit(place))
    return read("latest").unionByName(read("archive")).select("place", "generated_at", "n")


@query(HAZARD + "SELECT user_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE count(*) END AS n, CASE user_id % 5 WHEN 0 THEN 'broken' END AS fault FROM hazard WHERE type = 'Flood' GROUP BY user_id")
def product_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document an event, written under safe names and scanned again, broken ones kept as such."""
    folder = f"{storage.shared_folder(spark)}/products-{uuid.uuid4().hex}"
    d = hazard_events(spark, sf_dir).where("type = 'Flood'").groupBy("user_id").agg(F.count("*").alias("n"))
    doc = F.when(F.col("user_id") % 5 == 0, '{"n":').otherwise(F.to_json(F.struct("user_id", "n")))
    keyed = d.repartition(8).select(F.concat(F.lit("flood/"), F.col("user_id").cast("string")).alias("key"), doc.alias("doc"))
    storage.write_products(keyed.withColumn("doc", F.lit("{}")).limit(1), "key", "doc", folder)
    storage.write_products(keyed, "key", "doc", folder)
    read = storage.documents(spark, folder, "user_id long, n long", "*.txt")
    return read.select(F.regexp_extract("path", r"flood_(\d+)", 1).cast("long").alias("user_id"), "doc.n", "fault")


#: Suffixes, folders and words of names that a public artifact must not have (fixed values).
SUFFIXES, FOLDERS, TOKENS = ".py .pyc .ipynb .sh .ps1 .yml .yaml".split(), "scripts tests gee migration __pycache__ .runtime".split(), "credential credentials secret secrets service-account service_account .env".split()
#: Shapes of credentials, by what they are (fixed values).
SECRETS = {
    "PEM private key": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "GitHub token": r"\b(?:gh[pousr]_[A-Za-z0-9]{20,255}|github_pat_[A-Za-z0-9_]{20,255})\b",
    "Google API key": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "Google OAuth token": r"\bya29\.[0-9A-Za-z_-]{20,}\b",
    "AWS access key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "Slack token": r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    "Bearer token": r"(?i)\bBearer[ \t]+[A-Za-z0-9._~+/=-]{20,}\b",
}
ARTIFACT = "CASE event_id % 8 WHEN 0 THEN 'data/a' || event_id || '.json' WHEN 1 THEN 'Scripts/run.js' WHEN 2 THEN 'assets/x.PY' WHEN 3 THEN 'data/my-Credentials.txt' WHEN 4 THEN 'conf/app.yaml' WHEN 5 THEN 'docs/tests.md' WHEN 6 THEN 'a/.env.html' ELSE 'tests/secret.sh' END"


@query(HAZARD + f", p AS (SELECT event_id, lower({ARTIFACT}) AS p FROM hazard), f AS (SELECT event_id, p, regexp_extract(p, '(\\.[^./]*)$', 1) AS s, regexp_extract(p, '([^/]*)$', 1) AS n, string_split(p, '/') AS parts FROM p) SELECT event_id, list_contains({SUFFIXES!r}, s) AS code, list_has_any(parts, {FOLDERS!r}) AS private, n LIKE '%credential%' OR n LIKE '%secret%' OR n LIKE '%service-account%' OR n LIKE '%service~_account%' ESCAPE '~' OR n LIKE '%.env%' AS credential FROM f")
def artifact_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of an artifact that must not be published."""
    p = F.lower(F.expr(ARTIFACT))
    name, suffix = F.regexp_extract(p, "([^/]*)$", 1), F.regexp_extract(p, r"(\.[^./]*)$", 1)
    word = name.contains(TOKENS[0])
    for t in TOKENS[1:]:
        word = word | name.contains(t)
    return hazard_events(spark, sf_dir).select("event_id", suffix.isin(*SUFFIXES).alias("code"), F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, FOLDERS))).alias("private"), word.alias("credential"))


@query(" UNION ALL ".join(f"SELECT '{label}' AS label, count(*) AS documents FROM documents WHERE regexp_matches(text, '{shape}')" for label, shape in SECRETS.items()))
def secret_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each kind of credential, in one pass."""
    x = table(spark, sf_dir, "documents").agg(*[F.count_if(F.col("text").rlike(shape)).alias(label) for label, shape in SECRETS.items()])
    return x.select(F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"`{label}`").alias("documents")) for label in SECRETS])).alias("x")).select("x.*")


@query("SELECT doc_id AS path, CASE WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 2 THEN 'unlisted' ELSE 'changed' END AS fault FROM documents WHERE doc_id % 10 IN (1, 2, 3)")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a manifest of digests does not bear out."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 10
    content = F.coalesce("text", F.lit(""))
    files = d.where(k != 1).select(F.col("doc_id").alias("path"), content.cast("binary").alias("content"))
    return storage.manifest_faults(files, d.where(k != 2).select(F.col("doc_id").alias("path"), F.sha2(F.when(k == 3, F.concat(content, F.lit("!"))).otherwise(content), 256).alias("sha256")))


@query(HAZARD + ", " + GRID + """, c AS (SELECT row // 4 AS r, col // 4 AS c, sum(people) AS p FROM grid GROUP BY ALL), e AS (SELECT type, count(DISTINCT day) AS days, min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE abs(lat) > 90 OR abs(lon) > 180) AS outside FROM hazard GROUP BY type)
SELECT 'mass' AS gate, 'grid' AS name, (SELECT sum(p) FROM c) = (SELECT sum(people) FROM grid) AS holds UNION ALL SELECT 'range', type, lo >= 0 AND hi < 65000 FROM e UNION ALL SELECT 'days', type, days >= 28 FROM e UNION ALL SELECT 'places', type, outside = 0 FROM e""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass conserved by a coarser grid, values in range, enough days, valid places."""
    g = population_grid(spark)
    c = g.groupBy(F.floor(F.col("row") / 4), F.floor(F.col("col") / 4)).agg(F.sum("people").alias("p")).agg(F.sum("p").alias("a"))
    mass = c.crossJoin(g.agg(F.sum("people").alias("b"))).select(F.lit("mass").alias("gate"), F.lit("grid").alias("name"), (F.col("a") == F.col("b")).alias("holds"))  # one row each
    bad = (F.abs("lat") > 90) | (F.abs("lon") > 180)
    e = hazard_events(spark, sf_dir).groupBy("type").agg(F.countDistinct("day").alias("days"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(bad).alias("outside"))
    rows = F.array(*[F.struct(F.lit(n).alias("gate"), F.col("type").alias("name"), ok.alias("holds")) for n, ok in (("range", (F.col("lo") >= 0) & (F.col("hi") < 65000)), ("days", F.col("days") >= 28), ("places", F.col("outside") == 0))])
    return mass.unionByName(e.select(F.explode(rows).alias("x")).select("x.*"))


@query(HAZARD + f", m AS (SELECT user_id, type, CASE WHEN type = 'Storm' AND {WIND} IS NOT NULL THEN 'exposure_grade' WHEN type = 'Drought' THEN 'risk_grade' ELSE 'context_grade' END AS grade FROM (SELECT *, {METHOD} AS method FROM hazard)), p AS (SELECT type, grade, count(*) AS geometries, count(DISTINCT user_id) AS events FROM m GROUP BY type, grade) SELECT * FROM p")
def semantics_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometries and mapped events by grade and hazard; an event with two grades counts for each."""
    none = F.lit(None).cast("struct<status:string,authority:boolean,aligned:boolean>")
    m = hazard_events(spark, sf_dir).select("user_id", "type", policy.geometry_grade(F.col("type"), F.expr(METHOD), none)["grade"].alias("grade"))
    return m.groupBy("type", "grade").agg(F.count("*").alias("geometries"), F.countDistinct("user_id").alias("events"))


@query(HAZARD + """, t AS (SELECT user_id, type, min(day) AS a, max(day) AS b FROM hazard WHERE alert = 'Red' GROUP BY ALL), d AS (SELECT *, CASE WHEN user_id % 4 = 0 THEN 3 END AS said FROM t)
SELECT user_id, type, CAST(a AS VARCHAR) AS start_date, CAST(b AS VARCHAR) AS last_detection, coalesce(said, date_diff('day', a, b)) AS duration_days, CASE WHEN said IS NULL THEN 'derived' ELSE 'source' END AS origin, a <= DATE '2024-01-15' AND b >= DATE '2024-01-15' AS active FROM d""")
def episode_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of episodes, their duration as said or derived, and whether they are active on a day."""
    t = hazard_events(spark, sf_dir).where("alert = 'Red'").groupBy("user_id", "type").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    said, day = F.when(F.col("user_id") % 4 == 0, 3), F.lit("2024-01-15").cast("date")
    return t.select("user_id", "type", F.col("a").cast("string").alias("start_date"), F.col("b").cast("string").alias("last_detection"), F.coalesce(said, F.datediff("b", "a")).cast("long").alias("duration_days"), F.when(said.isNull(), "derived").otherwise("source").alias("origin"), ((F.col("a") <= day) & (F.col("b") >= day)).alias("active"))


@query(HAZARD + f"""SELECT id, sha256('bench-v1|' || id) AS h FROM hazard WHERE type = 'Wildfire' AND value * 250 >= 10000 AND event_id % 13 <> 0 AND event_id % 5 > 0 AND event_id % 7 > 0 AND coalesce((50 + event_id % 200) / 100.0 BETWEEN 0.5 AND 2.0, false) ORDER BY h LIMIT 45""")
def experiment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fires of a benchmark: 10,000 ha or more, a footprint, QC passed, the first 45 by a salted hash."""
    n = F.col("event_id")
    h = hazard_events(spark, sf_dir).withColumns({"burned": F.col("value") * 250, "mapped": F.when(n % 13 != 0, F.col("value") * 250 * (50 + n % 200) / 100)})
    qc = policy.fire_qc(F.col("mapped"), F.col("burned"), F.lit(16), F.when(n % 5 > 0, "GDACS/GWIS"), F.lit("source_reported_current_episode"), F.when(n % 7 > 0, 16))
    return experiments.candidates(h.withColumn("qc", qc), "id", "burned", "mapped", "qc", "bench-v1", 45)


@query(HAZARD + """, n AS (SELECT type, day, count(DISTINCT event_id % 9) AS steps FROM hazard GROUP BY ALL) SELECT a.type, CAST(a.day AS VARCHAR) AS day, CAST(max(b.day) AS VARCHAR) AS cycle, max(b.day) IS NULL OR max(b.day) <> a.day AS refresh FROM n a LEFT JOIN n b ON b.type = a.type AND b.steps = 9 AND b.day <= a.day AND b.day >= a.day - 10 GROUP BY a.type, a.day""")
def latest_complete_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each model and day the latest cycle with all its steps within ten days; a probe that finds none, or an older one, asks for a refresh."""
    c = hazard_events(spark, sf_dir).groupBy("type", "day").agg(F.countDistinct(F.col("event_id") % 9).alias("steps"))
    d = refresh.latest_cycle(c, "day", F.col("steps") == 9, 10, by="type")
    return d.select("type", F.col("day").cast("string").alias("day"), F.col("cycle").cast("string").alias("cycle"), (F.col("cycle").isNull() | (F.col("cycle") != F.col("day"))).alias("refresh"))


TRACK = HAZARD + ", " + GRID + """, n AS (SELECT user_id, event_id, lat, lon, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM hazard WHERE type = 'Storm' AND alert = 'Red'),
w AS (SELECT a.user_id, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS ey FROM n a JOIN n b ON b.user_id = a.user_id AND b.i = a.i + 1),
x AS (SELECT user_id, row, col, lat_c, lon_c, ax, ay, bx, ey, greatest(0.0, least(1.0, ((lon_c - ax) * (bx - ax) * pow(cos(radians(lat_c)), 2) + (lat_c - ay) * (ey - ay)) / nullif(pow((bx - ax) * cos(radians(lat_c)), 2) + pow(ey - ay, 2), 0))) AS t FROM w, grid WHERE lat_c BETWEEN least(ay, ey) - 2.3 AND greatest(ay, ey) + 2.3 AND lon_c BETWEEN least(ax, bx) - 2.6 AND greatest(ax, bx) + 2.6),
y AS (SELECT user_id, row, col, lat_c, lon_c, ax + coalesce(t, 0) * (bx - ax) AS px, ay + coalesce(t, 0) * (ey - ay) AS py FROM x), k AS (SELECT user_id, row, col, min(""" + KM.replace("{b}.lat", "py").replace("{a}.lat", "lat_c").replace("{b}.lon", "px").replace("{a}.lon", "lon_c") + ") AS km FROM y GROUP BY user_id, row, col) "


@query(TRACK + "SELECT user_id, count(*) FILTER (WHERE km <= 60) AS corridor, count(*) FILTER (WHERE km > 75 AND km <= 200) AS ring, round(list_sort(list(km))[12], 6) AS matched_km FROM k WHERE km <= 200 GROUP BY user_id HAVING count(*) >= 12")
def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells within 60 km of each track's legs, those of the control ring beyond, and the radius that gives an area of twelve cells."""
    from pyspark.sql import Window

    h = hazard_events(spark, sf_dir).where("type = 'Storm' and alert = 'Red'")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    legs = h.select("user_id", F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.lead("lon").over(w).alias("bx"), F.lead("lat").over(w).alias("by")).where("bx is not null")
    near = shapes.cells_along(legs, population_grid(spark), reach_km=200.0)
    cells = near.groupBy("user_id", "row", "col").agg(F.min("km").alias("km"))
    counts = cells.groupBy("user_id").agg(F.count_if(F.col("km") <= 60).alias("corridor"), F.count_if((F.col("km") > 75) & (F.col("km") <= 200)).alias("ring"), F.count("*").alias("n")).where("n >= 12")
    matched = cells.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("km"))).where("r = 12").select("user_id", F.round("km", 6).alias("matched_km"))
    return counts.drop("n").join(matched, "user_id")


FOLDS = """WITH c AS (SELECT l_suppkey % 6 AS block, 'c' || l_linenumber AS config, CAST(l_quantity AS DOUBLE) AS csi FROM lineitem), f AS (SELECT f.fold, config, quantile_cont(csi, 0.5) AS m FROM c, range(6) f(fold) WHERE block <> f.fold GROUP BY ALL),
b AS (SELECT fold, first(config ORDER BY m DESC, config) AS config FROM f GROUP BY fold)"""


@query(FOLDS + " SELECT b.fold, b.config, round(quantile_cont(csi, 0.5), 6) AS held_median, count(*) AS held FROM b JOIN c ON c.block = b.fold AND c.config = b.config GROUP BY ALL")
def nested_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each fold the configuration is chosen on the other blocks and tried on the one held out."""
    c = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 6).cast("long").alias("block"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("config"), F.col("l_quantity").cast("double").alias("csi"))
    folds = c.withColumn("fold", F.explode(F.filter(F.array(*[F.lit(k).cast("long") for k in range(6)]), lambda k: k != F.col("block")))).withColumn("key", F.struct("fold", "config"))
    m = evaluation.exact_quantiles(folds, "key", "csi", {"m": 0.5}).select("key.fold", "key.config", "m")
    chosen = experiments.best_configs(m, "fold", "config", "m")
    held = c.withColumn("key", F.struct(F.col("block").alias("fold"), "config"))
    tried = evaluation.exact_quantiles(held, "key", "csi", {"held_median": 0.5}).select("key.fold", "key.config", F.round("held_median", 6).alias("held_median"), F.col("n").alias("held"))
    return chosen.join(tried, ["fold", "config"])
