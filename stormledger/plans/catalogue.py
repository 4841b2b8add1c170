"""Queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormledger.functions import columns as C
from stormledger.operators import evaluation, joins, ledger
from stormledger.sources.hazard import GRID, HAZARD, hazard_events, population_grid, table
from stormledger.sources.storage import shared_folder
from stormledger.streaming import lifecycle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp")).alias(name)


def texts(df: DataFrame, *names: str) -> DataFrame:
    """df with its dates as texts."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(HAZARD + """SELECT CAST(date_trunc('week', day)::DATE AS VARCHAR) AS week, type, count(*) AS events, count(*) FILTER (WHERE alert = 'Red') AS red, count(DISTINCT user_id) AS sources,
  max(burned_area_ha) AS max_area_ha FROM hazard GROUP BY ALL""")
def hazard_report_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts by week and hazard."""
    h = hazard_events(spark, sf_dir)
    return h.groupBy(F.to_date(F.date_trunc("week", "day")).cast("string").alias("week"), "type").agg(F.count("*").alias("events"), F.count_if(F.col("alert") == "Red").alias("red"), F.countDistinct("user_id").alias("sources"), F.max("burned_area_ha").alias("max_area_ha"))


@query(HAZARD + """SELECT id, type, lat, lon, abs(lat) <= 90 AND abs(lon) <= 180 AS valid, CASE alert WHEN 'Red' THEN 'High' WHEN 'Orange' THEN 'Medium' ELSE 'Standard' END AS priority,
  (CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END) || '_' || (CASE WHEN abs(lat) < 23.5 THEN 'tropical' WHEN abs(lat) < 55 THEN 'mid' ELSE 'high' END) AS stratum FROM hazard""")
def hazard_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised events with priority, point check and stratum."""
    h = hazard_events(spark, sf_dir)
    return h.select("id", "type", "lat", "lon", C.valid_point(F.col("lat"), F.col("lon")).alias("valid"), C.priority(F.col("alert")).alias("priority"), C.stratum(F.col("lat")).alias("stratum"))


PAIRS = HAZARD + f", pairs AS (SELECT a.event_id AS event_id_a, b.event_id AS event_id_b, a.type, {KM.format(a='a', b='b')} AS km FROM hazard a JOIN hazard b ON a.type = b.type AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 432000000000 WHERE {KM.format(a='a', b='b')} < 80) "


@query(PAIRS + "SELECT event_id_a, event_id_b, type, round(km, 3) AS km FROM pairs")
def pair_join_spacetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one type within 80 km and 5 days."""
    return joins.near_pairs(hazard_events(spark, sf_dir)).withColumn("km", F.round("km", 3))


@query(PAIRS + """, e AS (SELECT type, event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS i FROM hazard WHERE type <> 'Wildfire'),
l AS (SELECT a.i AS i, list(b.i) AS earlier FROM (SELECT event_id_a AS x, event_id_b AS y FROM pairs UNION ALL SELECT event_id_b, event_id_a FROM pairs) JOIN e a ON a.event_id = x JOIN e b ON b.event_id = y WHERE b.i < a.i GROUP BY a.i),
s AS (SELECT type, list_reduce(list_prepend({'i': 0::BIGINT, 'earlier': []::BIGINT[], 'anchors': []::BIGINT[]}, list({'i': e.i, 'earlier': coalesce(l.earlier, []), 'anchors': []::BIGINT[]} ORDER BY e.i)),
  lambda acc, x: {'i': 0::BIGINT, 'earlier': []::BIGINT[], 'anchors': CASE WHEN list_has_any(acc.anchors, x.earlier) THEN acc.anchors ELSE list_append(acc.anchors, x.i) END}).anchors AS anchors FROM e LEFT JOIN l USING (i) GROUP BY type),
f AS (SELECT e.event_id, e.i, coalesce(list_min(list_intersect(l.earlier, s.anchors)), e.i) AS j FROM e LEFT JOIN l USING (i) JOIN s USING (type))
SELECT f.event_id, e.event_id AS anchor FROM f JOIN e ON e.i = f.j""")
def dedupe_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy proximity dedupe: anchors of all events that are no wildfires."""
    h = hazard_events(spark, sf_dir).where("type <> 'Wildfire'")
    return evaluation.greedy_dedupe(joins.near_pairs(h, times=True), h)


CODE = "CASE type WHEN 'Flood' THEN 'FL' WHEN 'Storm' THEN 'TC' WHEN 'Wildfire' THEN 'WF' WHEN 'Drought' THEN 'DR' ELSE upper(coalesce(type, 'EV')) END"
MEMBERS = """, m AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN [] WHEN event_id % 7 = 1 THEN [{'origin': 'other', 'source_id': 'b'}, {'origin': 'other', 'source_id': source_id}]
  WHEN event_id % 7 = 2 THEN [{'origin': 'eonet', 'source_id': source_id}, {'origin': 'GDACS', 'source_id': 'g' || source_id}, {'origin': 'gdacs', 'source_id': 'f' || source_id}] ELSE [{'origin': origin, 'source_id': source_id}] END AS members FROM hazard) """
FIRST_OF = "list_min(list_transform(list_filter(members, lambda x: lower(x.origin) = '{o}'), lambda x: x.source_id))"


def with_members(h: DataFrame) -> DataFrame:
    """Events with source members: none, of an unknown origin, of several origins, or their own."""
    one = lambda o, i: F.struct(F.lit(o).alias("origin") if isinstance(o, str) else o.alias("origin"), i.alias("source_id"))
    n, sid = F.col("event_id") % 7, F.col("source_id")
    own = F.array(one(F.col("origin"), sid))
    members = F.when(n == 0, F.filter(own, lambda x: F.lit(False))).when(n == 1, F.array(one("other", F.lit("b")), one("other", sid)))
    return h.withColumn("members", members.when(n == 2, F.array(one("eonet", sid), one("GDACS", F.concat(F.lit("g"), sid)), one("gdacs", F.concat(F.lit("f"), sid)))).otherwise(own))


@query(HAZARD + MEMBERS + f"""SELECT event_id, coalesce('gdacs:' || {CODE} || ':' || {FIRST_OF.format(o='gdacs')}, 'cems:' || {CODE} || ':' || {FIRST_OF.format(o='cems')}, 'eonet:' || {CODE} || ':' || {FIRST_OF.format(o='eonet')},
  'event:' || {CODE} || ':' || left(sha1(coalesce(nullif(array_to_string(list_sort(list_transform(members, lambda x: x.origin || ':' || x.source_id)), '|'), ''), id)), 16)) AS stable_id FROM m""")
def identity_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable identities of events with members of several origins."""
    h = with_members(hazard_events(spark, sf_dir))
    return h.select("event_id", ledger.stable_id(F.col("type"), F.col("members"), F.col("id")).alias("stable_id"))


LEDGER = HAZARD + """, ledger AS (SELECT day, user_id, min(ts) AS first_observed, max(ts) AS last_observed, count(*) AS observations, max(burned_area_ha) AS max_area_ha,
  arg_max(burned_area_ha, struct_pack(t := epoch_us(ts), e := event_id)) AS latest_any, arg_max_null(burned_area_ha, struct_pack(t := epoch_us(ts), e := event_id)) AS latest_area_ha,
  max(CASE alert WHEN 'Green' THEN 1 WHEN 'Orange' THEN 2 WHEN 'Red' THEN 3 ELSE 0 END) AS alert_rank FROM hazard GROUP BY day, user_id) """


@query(LEDGER + "SELECT CAST(day AS VARCHAR) AS day, user_id, epoch_us(first_observed) AS first_observed, epoch_us(last_observed) AS last_observed, observations, max_area_ha, latest_area_ha, alert_rank FROM ledger")
def ledger_daily_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily ledger by source (F1)."""
    rows = ledger.daily(hazard_events(spark, sf_dir), "user_id")
    return texts(rows.withColumns({n: micros(n) for n in ("first_observed", "last_observed")}), "day")


@query(LEDGER + """SELECT user_id, count(*) AS days_observed, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, sum(observations)::BIGINT AS observations, max(max_area_ha) AS max_area_ha,
  arg_max_null(latest_area_ha, struct_pack(t := last_observed, d := day)) AS latest_area_ha, (['', 'Green', 'Orange', 'Red'])[max(alert_rank) + 1] AS max_alert
  FROM ledger WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY user_id""")
def ledger_period_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weeks of the ledger merged per source (F2)."""
    return texts(ledger.period(ledger.daily(hazard_events(spark, sf_dir), "user_id"), "2024-01-08", "2024-01-21", "user_id"), "first_day", "last_day")


@query(HAZARD + """SELECT CAST(c.day::DATE AS VARCHAR) AS day, count(h.event_id) AS runs, count(h.event_id) > 0 AS covered, count(h.event_id) >= 3 AS complete
  FROM (SELECT unnest(generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS day) c LEFT JOIN hazard h ON h.day = c.day::DATE GROUP BY c.day""")
def coverage_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a period with their runs."""
    return texts(ledger.coverage(hazard_events(spark, sf_dir), "2023-12-28", "2024-02-03"), "day")


@query(HAZARD + """SELECT user_id, CASE WHEN f >= DATE '2024-01-08' AND l < DATE '2024-01-14' AND whole THEN 'New & resolved this period' WHEN l < DATE '2024-01-14' AND whole THEN 'Resolved this period' WHEN f >= DATE '2024-01-08' THEN 'New this period' ELSE 'Ongoing' END AS label
  FROM (SELECT user_id, min(day) AS f, max(day) AS l, user_id % 3 <> 0 AS whole FROM hazard WHERE type = 'Flood' GROUP BY user_id HAVING max(day) >= DATE '2024-01-08' AND min(day) <= DATE '2024-01-14')""")
def lifecycle_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle labels of sources in a week; a source's own runs stand for its coverage, and without a full one nothing is resolved (H2)."""
    start, end = F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date")
    seen = hazard_events(spark, sf_dir).where("type = 'Flood'").groupBy("user_id").agg(F.min("day").alias("f"), F.max("day").alias("l")).where((F.col("l") >= start) & (F.col("f") <= end))
    return seen.select("user_id", C.lifecycle(F.col("f"), F.col("l"), start, end, F.col("user_id") % 3 != 0).alias("label"))


SNAPSHOTS = HAZARD + """, before AS (SELECT user_id, type, count(*) AS n, max(round(value, 2)) AS top FROM hazard WHERE day = DATE '2024-01-10' GROUP BY ALL),
after AS (SELECT user_id, type, count(*) AS n, max(round(value, 2)) AS top FROM hazard WHERE day = DATE '2024-01-11' GROUP BY ALL), b AS (SELECT user_id || '/' || type AS key, n, top FROM before), a AS (SELECT user_id || '/' || type AS key, n, top FROM after) """


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = hazard_events(spark, sf_dir)
    of = lambda day: h.where(F.col("day") == F.lit(day).cast("date")).groupBy(F.concat_ws("/", "user_id", "type").alias("key")).agg(F.count("*").alias("n"), F.max(F.round("value", 2)).alias("top"))
    return of("2024-01-10"), of("2024-01-11")


@query(SNAPSHOTS + "SELECT key, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (key) WHERE b.n IS DISTINCT FROM a.n OR b.top IS DISTINCT FROM a.top")
def change_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that differ between two snapshots."""
    return joins.diff(*snapshots(spark, sf_dir), "key", ["n", "top"])


@query(SNAPSHOTS + """, d AS (SELECT count(*) AS changed FROM b FULL JOIN a USING (key) WHERE b.n IS DISTINCT FROM a.n OR b.top IS DISTINCT FROM a.top), c AS (SELECT count(*) AS current FROM a)
SELECT changed, current, least(60, greatest(12, CAST(ceil(0.5 * current) AS BIGINT))) AS cap, CASE WHEN changed = 0 THEN 'none' WHEN changed <= least(60, greatest(12, CAST(ceil(0.5 * current) AS BIGINT))) THEN 'incremental' ELSE 'full' END AS mode FROM d, c""")
def incremental_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a refresh is run for what changed (J4 to J6): one row."""
    before, after = snapshots(spark, sf_dir)
    one = joins.diff(before, after, "key", ["n", "top"]).agg(F.count("*").alias("changed")).crossJoin(F.broadcast(after.agg(F.count("*").alias("current"))))  # one row each
    cap = F.least(F.lit(60), F.greatest(F.lit(12), F.ceil(0.5 * F.col("current")))).cast("long")
    return one.withColumn("cap", cap).withColumn("mode", F.when(F.col("changed") == 0, "none").when(F.col("changed") <= F.col("cap"), "incremental").otherwise("full"))


@query(SNAPSHOTS + "SELECT a.key, a.n, CASE WHEN b.n = a.n THEN b.top ELSE a.top END AS top, coalesce(b.n = a.n, false) AS reused FROM a LEFT JOIN b USING (key)")
def reuse_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expensive columns copied from the previous snapshot where nothing changed."""
    before, after = snapshots(spark, sf_dir)
    return joins.reuse(before, after, "key", ["n"], ["top"])


@query(SNAPSHOTS + "SELECT key, n, top, 'current' AS side FROM a UNION ALL SELECT key, n, top, 'restored' FROM b WHERE key NOT IN (SELECT key FROM a)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current snapshot and what only the previous one had."""
    before, after = snapshots(spark, sf_dir)
    return after.withColumn("side", F.lit("current")).unionByName(before.join(after, "key", "left_anti").dropDuplicates(["key"]).withColumn("side", F.lit("restored")))


@query(HAZARD + """, r AS (SELECT type, day, CAST('0x' || substr(sha256(id || '|' || strftime(day, '%Y-%m-%d') || '|' || coalesce(alert, '')), 1, 15) AS BIGINT) AS d FROM hazard)
SELECT CAST(day AS VARCHAR) AS day, type, count(*) AS n, CAST(sum(CAST(d AS HUGEINT)) AS VARCHAR) AS digest_sum, bit_xor(d) AS digest_xor FROM r GROUP BY day, type""")
def fingerprint_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-insensitive fingerprints of event sets."""
    return texts(ledger.fingerprint(hazard_events(spark, sf_dir), ["id", "day", "alert"], ["day", "type"]), "day")


@query(HAZARD + f"""SELECT t.event_id FROM hazard t WHERE t.event_id % 10 <> 3 AND NOT EXISTS (SELECT 1 FROM hazard h WHERE h.event_id % 10 = 3 AND abs(epoch_us(t.ts) - epoch_us(h.ts)) <= 259200000000 AND {KM.format(a='t', b='h')} <= 250)""")
def embargo_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training events that no held-out event is near in time and space."""
    h = hazard_events(spark, sf_dir)
    return joins.embargoed(h.where("event_id % 10 <> 3"), h.where("event_id % 10 = 3"), 250.0, 72.0).select("event_id")


CELLS = HAZARD + ", " + GRID + ", touched AS (SELECT DISTINCT type, row, col, people FROM hazard, grid WHERE alert = 'Red' AND abs(lat_c - lat) <= 0.5 AND abs(lon_c - lon) <= 0.5) "


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = hazard_events(spark, sf_dir).where("alert = 'Red'").select("type", "lat", "lon")
    return joins.cells_within(red, population_grid(spark), 0.5)


@query(CELLS + "SELECT type, count(*) AS cells, sum(people)::BIGINT AS people FROM touched GROUP BY type")
def zonal_by_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People inside the union of each hazard's footprints: distinct cells of half-degree squares, then sums (F8, F10; no ray casting, D16)."""
    return touched(spark, sf_dir).groupBy("type", "row", "col").agg(F.first("people").alias("people")).groupBy("type").agg(F.count("*").alias("cells"), F.sum("people").alias("people"))


@query(CELLS + "SELECT count(*) AS cells, sum(people)::BIGINT AS people FROM (SELECT DISTINCT row, col, people FROM touched)")
def zonal_population_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People inside the union of all footprints (F8)."""
    return touched(spark, sf_dir).groupBy("row", "col").agg(F.first("people").alias("people")).agg(F.count("*").alias("cells"), F.sum("people").alias("people"))


NODES = HAZARD + ", " + GRID + """, node AS (SELECT user_id, lat, lon, exp(-(event_id % 5) * 3 / 12.0) * sqrt(greatest(0.05, value / 50.0)) AS w FROM hazard WHERE alert = 'Red' AND type = 'Storm'),
near AS (SELECT user_id, row, col, people, w * exp(-(pow((lat_c - lat) * 111, 2) + pow((lon_c - lon) * 111, 2)) / (2 * 35.0 * 35.0)) AS s FROM node, grid WHERE abs(lat_c - lat) <= 1.5 AND abs(lon_c - lon) <= 1.5),
score AS (SELECT user_id, row, col, row * 1000 + col AS cell, any_value(people) AS people, round(sum(s), 9) AS score FROM near GROUP BY user_id, row, col) """


def transport_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = hazard_events(spark, sf_dir).where("alert = 'Red' and type = 'Storm'")
    nodes = n.select("user_id", "lat", "lon", (F.exp(-(F.col("event_id") % 5) * 3 / 12.0) * F.sqrt(F.greatest(F.lit(0.05), F.col("value") / 50.0))).alias("w"))
    near = joins.cells_within(nodes, population_grid(spark), 1.5)
    d2 = F.pow((F.col("lat_c") - F.col("lat")) * 111, 2) + F.pow((F.col("lon_c") - F.col("lon")) * 111, 2)
    return near.groupBy("user_id", "row", "col").agg(F.any_value("people").alias("people"), F.round(F.sum(F.col("w") * F.exp(-d2 / (2 * 35.0 * 35.0))), 9).alias("score"))


@query(NODES + "SELECT user_id, row, col, people, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, cell DESC) AS rank FROM score) WHERE rank <= 4")
def topk_cells_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cells of each source's tracks by transport score: over all nodes, weight of lead and strength times a Gaussian of the distance.

    An area of four cells is asked for, as the area over a cell's area says; the score of a cell is a partial sum.
    """
    score = transport_scores(spark, sf_dir)
    return evaluation.top_cells(score.withColumn("cell", F.col("row") * 1000 + F.col("col")), "user_id", "cell", "score", 4).select("user_id", "row", "col", "people", "score", "rank")


@query(NODES + """, m AS (SELECT user_id, row, col, cell, CASE WHEN people % 5 > 0 THEN score END AS score, 9000.0 * (1 + user_id % 5) AS area FROM score), z AS (SELECT user_id, least(greatest(1, CAST(round_even(max(area) / 3000.0, 0) AS BIGINT)), count(*)) AS wanted, count(score) AS seen FROM m GROUP BY user_id)
SELECT user_id, row, col, score, rank, wanted FROM (SELECT m.*, wanted, seen, row_number() OVER (PARTITION BY m.user_id ORDER BY score DESC, cell DESC) AS rank FROM m JOIN z USING (user_id) WHERE score IS NOT NULL) WHERE rank <= wanted AND seen >= greatest(1, floor(0.8 * wanted))""")
def cells_of_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many of each source's best cells as a corridor's area holds, unless too many are masked."""
    score = transport_scores(spark, sf_dir).withColumns({"cell": F.col("row") * 1000 + F.col("col"), "area": 9000.0 * (1 + F.col("user_id") % 5), "score": F.when(F.col("people") % 5 > 0, F.col("score"))})
    return evaluation.cells_of_area(score, "user_id", "cell", "score", "area", 3000.0).select("user_id", "row", "col", "score", "rank", "wanted")


@query(HAZARD + """, p AS (SELECT h.id, h.ts, h.type, g.event_id AS rid, abs(epoch_us(h.ts) - epoch_us(g.ts)) AS gap FROM hazard h LEFT JOIN hazard g ON g.type = h.type AND g.origin = 'gdacs' AND abs(epoch_us(h.ts) - epoch_us(g.ts)) <= 64800000000 WHERE h.origin = 'cems')
SELECT id, type, arg_min(rid, struct_pack(gap := gap, rid := rid)) AS rid, min(gap) / 1e6 AS gap_s FROM p GROUP BY id, type""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each activation's nearest alert in time within 18 hours."""
    h = hazard_events(spark, sf_dir)
    left, right = h.where("origin = 'cems'").select("id", "type", "ts"), h.where("origin = 'gdacs'").select("type", F.col("event_id").alias("rid"), F.col("ts").alias("rts"))
    return joins.nearest_in_time(left, right, "type", 18).select("id", "type", "rid", "gap_s")


@query("""WITH c AS (SELECT s_nationkey AS nation, count(*) AS exposed, round(sum(s_acctbal), 2) AS proxy FROM supplier GROUP BY s_nationkey), n AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA'))
SELECT c.nation, n_name AS country, exposed, CASE WHEN n_name IS NOT NULL THEN proxy END AS proxy, round(100.0 * sum(CASE WHEN n_name IS NOT NULL THEN exposed END) OVER () / sum(exposed) OVER (), 3) AS coverage_pct FROM c LEFT JOIN n ON n_nationkey = nation""")
def gdp_country_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country components of an exposure, with the share of it that has a known rate; one region publishes none."""
    c = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("exposed"), F.round(F.sum("s_acctbal"), 2).alias("proxy"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("country"))
    joined = c.join(n, "nation", "left")
    total = joined.agg((100.0 * F.sum(F.when(F.col("country").isNotNull(), F.col("exposed"))) / F.sum("exposed")).alias("pct"))  # one row
    return joined.crossJoin(F.broadcast(total)).select("nation", "country", "exposed", F.when(F.col("country").isNotNull(), F.col("proxy")).alias("proxy"), F.round("pct", 3).alias("coverage_pct"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'assistant' AND turn % 2 = 1) DESC, (turn % 2 = 1) DESC, turn DESC, role DESC) AS rn FROM conversations) WHERE rn = 1")
def advisory_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best advisory of each timeline: current and actual ones first, then actual ones, then the latest (G2); a partial maximum, no sort of a group."""
    actual = F.col("turn") % 2 == 1
    rank = F.struct((actual & (F.col("role") == "assistant")).cast("int").alias("both"), actual.cast("int").alias("actual"), "turn", "role")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(rank).alias("x")).select("conv_id", "x.turn", "x.role")


@query(HAZARD + "SELECT type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for n, q in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))) + ", count(value) AS n FROM hazard GROUP BY type")
def percentile_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distributions by hazard."""
    shares = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    return evaluation.exact_quantiles(hazard_events(spark, sf_dir), "type", "value", shares).withColumns({n: F.round(n, 6) for n in shares})


@query(HAZARD + "SELECT type, round(quantile_cont(m, 0.5), 6) AS median_of_medians, round(max(m), 6) AS greatest, count(*) AS blocks FROM (SELECT type, user_id, quantile_cont(value, 0.5) AS m FROM hazard GROUP BY type, user_id) GROUP BY type")
def two_level_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and greatest of the blocks' medians."""
    h = hazard_events(spark, sf_dir).withColumn("block", F.struct("type", "user_id"))
    blocks = evaluation.exact_quantiles(h, "block", "value", {"m": 0.5}).select("block.type", "m")
    tops = blocks.groupBy("type").agg(F.round(F.max("m"), 6).alias("greatest"))
    return evaluation.exact_quantiles(blocks, "type", "m", {"median_of_medians": 0.5}).join(tops, "type").select("type", F.round("median_of_medians", 6).alias("median_of_medians"), "greatest", F.col("n").alias("blocks"))


CONFIGS = "WITH c AS (SELECT l_suppkey AS config, round(avg(l_extendedprice), 2) AS area, round(avg(l_quantity), 4) AS csi FROM lineitem GROUP BY l_suppkey) "


@query(CONFIGS + """, f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.area <= c.area AND d.csi >= c.csi AND (d.area < c.area OR d.csi > c.csi))), e AS (SELECT min(area) AS a, max(area) AS b, min(csi) AS c, max(csi) AS d FROM f)
SELECT config, area, csi, round(sqrt(pow(CASE WHEN e.b > e.a THEN (area - e.a) / (e.b - e.a) ELSE 0 END, 2) + pow(CASE WHEN e.d > e.c THEN (csi - e.d) / (e.d - e.c) ELSE 0 END, 2)), 6) AS gap FROM f, e""")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations on the front of small area and high skill, with their distance to the ideal point."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("config")).agg(F.round(F.avg("l_extendedprice"), 2).alias("area"), F.round(F.avg("l_quantity"), 4).alias("csi"))
    return evaluation.pareto_front(c, "config", "area", "csi").withColumn("gap", F.round("gap", 6))


@query("SELECT c_custkey, c_mktsegment, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('split-v1|' || c_custkey), c_custkey) % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM customer")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 2:1 split in each stratum by hash order."""
    return evaluation.stratified_split(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment").select("c_custkey", "c_mktsegment", "split")


MONTHLY = "WITH m AS (SELECT l_suppkey % 50 AS cell, year(l_shipdate) AS y, month(l_shipdate) AS mo, avg(l_quantity) AS tmp, avg(l_discount) * 100 AS vap FROM lineitem GROUP BY ALL) "


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy((F.col("l_suppkey") % 50).alias("cell"), F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("mo")).agg(F.avg("l_quantity").alias("tmp"), (F.avg("l_discount") * 100).alias("vap"))


@query(MONTHLY + "SELECT cell, mo, round(avg(tmp), 6) AS normal, count(*) AS years FROM m GROUP BY cell, mo")
def climate_monthly_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals of each cell's calendar month (F16)."""
    return monthly(spark, sf_dir).groupBy("cell", "mo").agg(F.round(F.avg("tmp"), 6).alias("normal"), F.count("*").alias("years"))


@query(MONTHLY + "SELECT cell, y, round(sum((6.1078 * exp(17.269 * tmp / (tmp + 237.3)) - vap) * d) / sum(d), 6) AS vpd FROM (SELECT *, day(last_day(make_date(y, mo, 1))) AS d FROM m) GROUP BY cell, y")
def vpd_weighted_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual vapour pressure deficit, months weighted by their days."""
    m = monthly(spark, sf_dir).withColumn("d", F.day(F.last_day(F.make_date("y", "mo", F.lit(1)))))
    return m.groupBy("cell", "y").agg(F.round(F.sum((C.saturation_pressure(F.col("tmp")) - F.col("vap")) * F.col("d")) / F.sum("d"), 6).alias("vpd"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c, regexp_extract(text, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1) AS num FROM documents)
SELECT doc_id, CASE WHEN length(c) > 480 THEN rtrim(substr(c, 1, 479)) || '…' ELSE c END AS summary, TRY_CAST(replace(num, ',', '') AS DOUBLE) AS first_number FROM t""")
def text_parse_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries and the first number of texts."""
    return table(spark, sf_dir, "documents").select("doc_id", C.collapsed(F.col("text")).alias("summary"), C.first_number(F.col("text")).alias("first_number"))


#: Names and shapes of credentials (fixed values).
SECRETS = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?:password|secret|api_key|token)[ ]?[=:][ ]?[^ ]{6,})"


@query(f"SELECT source, count(*) AS documents, count(*) FILTER (WHERE regexp_matches(text, '{SECRETS}')) AS with_secrets FROM documents GROUP BY source")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with credentials by source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("text").rlike(SECRETS)).alias("with_secrets"))


def new_folder(spark: SparkSession) -> str:
    """A folder of its own for one run of a query; a service names one that lasts."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT user_id, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, count(DISTINCT event_id) AS observations, 1 AS run_count FROM events GROUP BY user_id")
def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle state by key, kept by a stream of event files (M1, M2, M5)."""
    got = lifecycle.lifecycle(spark, sf_dir, "events.parquet", F.col("user_id"), F.col("event_id"), new_folder(spark))
    return got.select(F.col("key").alias("user_id"), micros("first_seen"), micros("last_seen"), "observations", F.col("run_count").cast("int").alias("run_count"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, epoch_us(min(ts)) AS first_run, epoch_us(max(ts)) AS last_run, count(DISTINCT date_trunc('hour', ts)) AS source_runs, 1 AS run_count FROM events GROUP BY CAST(ts AS DATE)")
def stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day ledger's runs as tumbling state: hourly snapshots are runs, files are deliveries; a day closes behind the watermark (M3, M7)."""
    got = lifecycle.lifecycle(spark, sf_dir, "events.parquet", F.to_date("ts"), F.date_trunc("hour", "ts"), new_folder(spark), closes=True)
    return got.select(F.col("key").cast("string").alias("day"), micros("first_seen").alias("first_run"), micros("last_seen").alias("last_run"), F.col("observations").alias("source_runs"), F.col("run_count").cast("int").alias("run_count"))


@query(HAZARD + """, p AS (SELECT type, user_id, avg(value) FILTER (WHERE day < DATE '2024-01-15') AS a, avg(value) FILTER (WHERE day >= DATE '2024-01-15') AS b FROM hazard GROUP BY type, user_id),
d AS (SELECT type, round(a - b, 6) AS d, row_number() OVER (PARTITION BY type ORDER BY user_id) - 1 AS i, count(*) OVER (PARTITION BY type) AS n FROM p WHERE a - b IS NOT NULL),
g AS (SELECT type, n, b, unnest(range(1, n + 1)) AS j FROM (SELECT DISTINCT type, n, unnest(range(1, 201)) AS b FROM d)),
r AS (SELECT g.type, g.b, quantile_cont(d.d, 0.5) AS m FROM g JOIN d ON d.type = g.type AND d.i = CAST('0x' || substr(sha256('20260914|' || g.b || '|' || g.j), 1, 12) AS BIGINT) % g.n GROUP BY g.type, g.b)
SELECT type, n, median, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT type, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median FROM d GROUP BY type) JOIN (SELECT type, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM r GROUP BY type) USING (type)""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded bootstrap intervals of the median difference of each source's means before and after a day, by hazard."""
    at = F.lit("2024-01-15").cast("date")
    p = hazard_events(spark, sf_dir).groupBy("type", "user_id").agg(F.avg(F.when(F.col("day") < at, F.col("value"))).alias("a"), F.avg(F.when(F.col("day") >= at, F.col("value"))).alias("b"))
    p = p.select("type", "user_id", F.round(F.col("a") - F.col("b"), 6).alias("d"), F.lit(0.0).alias("zero"))
    got = evaluation.paired_bootstrap(p, "type", "user_id", "d", "zero", 200)
    return got.select("type", "n", *[F.round(c, 6).alias(c) for c in ("median", "low", "high")])


@query(HAZARD + """, u AS (SELECT type, user_id, max(burned_area_ha) AS area, max(value) AS peak, max(CASE alert WHEN 'Red' THEN 3 WHEN 'Orange' THEN 2 WHEN 'Green' THEN 1 ELSE 0 END) AS r FROM hazard GROUP BY ALL)
SELECT type, user_id, r AS alert_rank, peak FROM u ORDER BY r DESC, peak DESC, type, user_id LIMIT 25""")
def report_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 rows of a report, by alert and peak."""
    u = hazard_events(spark, sf_dir).groupBy("type", "user_id").agg(F.max(C.alert_rank(F.col("alert"))).alias("alert_rank"), F.max("value").alias("peak"))
    return u.orderBy(F.desc("alert_rank"), F.desc("peak"), "type", "user_id").limit(25)


@query(HAZARD + """, d AS (SELECT user_id, day, sum(burned_area_ha) AS a FROM hazard WHERE burned_area_ha IS NOT NULL GROUP BY ALL), f AS (SELECT *, min(day) OVER (PARTITION BY user_id) AS first_day FROM d)
SELECT user_id, CAST(min(first_day) AS VARCHAR) AS first_day, round(sum(CASE WHEN day > first_day THEN a ELSE 0 END), 4) AS added FROM f GROUP BY user_id""")
def area_after_first_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area reported after a source's first observed day."""
    d = hazard_events(spark, sf_dir).where("burned_area_ha is not null").groupBy("user_id", "day").agg(F.sum("burned_area_ha").alias("a"))
    f = d.withColumn("first_day", F.min("day").over(Window.partitionBy("user_id")))
    return f.groupBy("user_id").agg(F.min("first_day").cast("string").alias("first_day"), F.round(F.sum(F.when(F.col("day") > F.col("first_day"), F.col("a")).otherwise(0.0)), 4).alias("added"))
