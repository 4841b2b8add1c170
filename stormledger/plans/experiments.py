"""Queries of the research track and of climate series, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.operators import clusters, evaluation, experiments, joins
from stormledger.plans.catalogue import KM, PAIRS, query
from stormledger.sources.hazard import HAZARD, hazard_events, table

CELLS = "cells AS (SELECT l_suppkey AS event, CAST(l_quantity + l_linenumber * 0.01 AS DOUBLE) AS value, CAST(l_extendedprice AS DOUBLE) AS area, l_tax < 0.04 AS control, l_linenumber AS line FROM lineitem)"
SKILL = f"""WITH {CELLS}, t AS (SELECT event, quantile_cont(value, 0.8) AS threshold FROM cells GROUP BY event), x AS (SELECT cells.*, round(value, 9) >= round(threshold, 9) AS high, 'c' || k AS config, line <= k AS inside FROM cells JOIN t USING (event), range(1, 6) r(k)),
s AS (SELECT event, config, coalesce(sum(area) FILTER (WHERE inside AND high), 0) AS b, coalesce(sum(area) FILTER (WHERE inside), 0) AS p, coalesce(sum(area) FILTER (WHERE high), 0) AS h, avg(value) FILTER (WHERE inside) AS m, avg(value) FILTER (WHERE control) AS bg FROM x GROUP BY event, config),
k AS (SELECT event, config, round(m / nullif(bg, 0), 6) AS enrichment, round(b / nullif(p, 0), 6) AS "precision", round(b / nullif(h, 0), 6) AS recall, round(b / nullif(p + h - b, 0), 6) AS csi, round(p, 2) AS area FROM s) """


def skill_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("event"), (F.col("l_quantity") + F.col("l_linenumber") * 0.01).cast("double").alias("value"), F.col("l_extendedprice").cast("double").alias("area"), (F.col("l_tax") < 0.04).alias("control"), F.col("l_linenumber").alias("line"))
    got = experiments.skill(cells, "event", {f"c{k}": line <= k for k in range(1, 6)})
    return got.select("event", "config", *[F.round(c, 6).alias(c) for c in ("enrichment", "precision", "recall", "csi")], F.round("area", 2).alias("area"))


@query(SKILL + "SELECT * FROM k")
def skill_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment, precision, recall and CSI of configurations by event."""
    return skill_of(spark, sf_dir)


@query(SKILL + "SELECT config, count(csi) AS n, " + ", ".join(f"round(quantile_cont(csi, {q}), 6) AS {n}" for n, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))) + " FROM k WHERE csi IS NOT NULL GROUP BY config")
def config_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of each configuration's CSI over events."""
    got = evaluation.exact_quantiles(skill_of(spark, sf_dir), "config", "csi", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return got.select("config", "n", *[F.round(c, 6).alias(c) for c in ("p10", "median", "p90")])


@query(SKILL + ", b AS (SELECT event, first(config ORDER BY coalesce(csi, '-infinity'::DOUBLE) DESC, coalesce(\"precision\", '-infinity'::DOUBLE) DESC, config) AS config FROM k GROUP BY event) SELECT * FROM b")
def best_config_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration of greatest CSI of each event, ties by precision, then name."""
    return experiments.best_configs(skill_of(spark, sf_dir), "event", "config", "csi", "precision")


@query(SKILL + """, b AS (SELECT event, first(config ORDER BY coalesce(csi, '-infinity'::DOUBLE) DESC, coalesce("precision", '-infinity'::DOUBLE) DESC, config) AS config FROM k GROUP BY event), q AS (SELECT config, round(quantile_cont(csi, 0.5), 6) AS median FROM k GROUP BY config)
SELECT config, count(*) AS folds FROM b JOIN q USING (config) GROUP BY config, median ORDER BY folds DESC, median DESC NULLS LAST, config LIMIT 1""")
def modal_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration that most folds chose."""
    s = skill_of(spark, sf_dir)
    quality = evaluation.exact_quantiles(s, "config", "csi", {"median": 0.5}).select("config", F.round("median", 6).alias("median"))
    return experiments.modal_config(experiments.best_configs(s, "event", "config", "csi", "precision"), "config", quality, "median")


ORIENT = """WITH c AS (SELECT l_suppkey AS event, CASE l_linenumber % 4 WHEN 0 THEN 'downwind' WHEN 1 THEN 'left' WHEN 2 THEN 'upwind' ELSE 'right' END AS o, CASE WHEN l_discount > 0.04 THEN CAST(l_quantity AS DOUBLE) END AS value, CAST(l_extendedprice AS DOUBLE) AS area FROM lineitem),
o AS (SELECT event, o, avg(value) AS mean, coalesce(sum(area) FILTER (WHERE value IS NOT NULL) / nullif(sum(area), 0), 0) >= 0.5 AS ok FROM c GROUP BY event, o),
e AS (SELECT event, max(mean) FILTER (WHERE ok AND o = 'downwind') AS down, count(*) FILTER (WHERE ok AND o <> 'downwind') AS controls, avg(mean) FILTER (WHERE ok AND o <> 'downwind') AS cm FROM o GROUP BY event),
r AS (SELECT e.event, down IS NOT NULL AND controls >= 2 AS eligible, controls, down - cm AS d, 1 + (SELECT count(*) FROM o WHERE o.event = e.event AND ok AND mean > down) AS rank FROM e),
f AS (SELECT event, eligible, controls, CASE WHEN eligible THEN round(d, 6) END AS difference, CASE WHEN eligible THEN rank END AS rank, CASE WHEN eligible THEN rank = 1 END AS is_max FROM r) """


def contrasts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("event"), F.when(n == 0, "downwind").when(n == 1, "left").when(n == 2, "upwind").otherwise("right").alias("orientation"), F.when(F.col("l_discount") > 0.04, F.col("l_quantity").cast("double")).alias("value"), F.col("l_extendedprice").cast("double").alias("area"))
    return experiments.contrasts(c, "event").withColumn("difference", F.round("difference", 6))


@query(ORIENT + "SELECT * FROM f")
def orientation_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downwind against the other orientations, and its rank."""
    return contrasts_of(spark, sf_dir)


@query(ORIENT + ", g AS (SELECT event % 4 AS block, *, count(*) FILTER (WHERE eligible) OVER () AS n FROM f) SELECT block, count(*) AS events, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE difference > 0) AS positive, count(*) FILTER (WHERE difference < 0) AS negative, count(*) FILTER (WHERE difference = 0) AS zero, round(quantile_cont(difference, 0.5), 6) AS median FROM g GROUP BY block HAVING count(difference) > 0")
def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible events, signs and median of the contrasts by block."""
    c = contrasts_of(spark, sf_dir).withColumn("block", F.col("event") % 4)
    d = F.col("difference")
    counts = c.groupBy("block").agg(F.count("*").alias("events"), F.count_if("eligible").alias("eligible"), F.count_if(d > 0).alias("positive"), F.count_if(d < 0).alias("negative"), F.count_if(d == 0).alias("zero"))
    return counts.join(evaluation.exact_quantiles(c, "block", "difference", {"median": 0.5}).select("block", F.round("median", 6).alias("median")), "block")


@query("""WITH RECURSIVE e AS (SELECT n_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey), s AS (SELECT region, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, region) AS i FROM e GROUP BY region), t AS (SELECT sum(n) AS total, count(*) AS blocks FROM s),
st(i, n, k, names) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) UNION ALL
  SELECT i, n, k, arg_min(names, sha256('holdout-v1|' || array_to_string(names, '|'))) FROM (SELECT st.i + 1 AS i, st.n + CASE WHEN v.t THEN s.n ELSE 0 END AS n, st.k + CAST(v.t AS BIGINT) AS k, CASE WHEN v.t THEN list_sort(list_append(st.names, s.region)) ELSE st.names END AS names FROM st JOIN s ON s.i = st.i + 1 CROSS JOIN (VALUES (true), (false)) v(t)) GROUP BY i, n, k),
b AS (SELECT names, n FROM st, t WHERE i = blocks AND k >= 2 AND blocks - k >= 2 AND n > 0 AND n < total ORDER BY abs(n - greatest(1, round_even(total / 3.0, 0))), k, sha256('holdout-v1|' || array_to_string(names, '|')) LIMIT 1) SELECT unnest(names) AS region, n AS events FROM b""")
def grouped_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole regions that make the test third of a benchmark, by reachable sums over all of them."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("region"))
    return clusters.holdout(table(spark, sf_dir, "customer").join(n, "c_nationkey").select("region"), "region")


DROUGHTS = HAZARD.replace("WITH", "WITH RECURSIVE", 1) + f""", p AS (SELECT event_id, lat, lon FROM hazard WHERE type = 'Drought' AND alert = 'Red'), spots AS (SELECT lat, lon, min(event_id) AS id FROM p GROUP BY lat, lon),
d(step, a, b, km) AS (SELECT 0, a.id, b.id, {KM.format(a='a', b='b')} FROM spots a JOIN spots b ON a.id < b.id UNION ALL
  SELECT step + 1, least(x, y), greatest(x, y), max(km) FROM (SELECT d.step, CASE WHEN d.a = m.b THEN m.a ELSE d.a END AS x, CASE WHEN d.b = m.b THEN m.a ELSE d.b END AS y, d.km FROM d CROSS JOIN (SELECT a, b FROM (SELECT * FROM d ORDER BY round(km, 9), sha256(a || '|' || b) LIMIT 1) WHERE km <= 500 + 1e-9) m) WHERE x <> y GROUP BY ALL),
best AS (SELECT step, arg_min(struct_pack(a := a, b := b, km := km), struct_pack(km := round(km, 9), tie := sha256(a || '|' || b))) AS m FROM d GROUP BY step), up AS (SELECT m.b AS low, m.a AS high FROM best WHERE m.km <= 500 + 1e-9),
roots(low, high) AS (SELECT id, id FROM spots UNION ALL SELECT r.low, up.high FROM roots r JOIN up ON r.high = up.low), blocks AS (SELECT low AS id, min(high) AS block FROM roots GROUP BY low) """


@query(DROUGHTS + "SELECT event_id, block, count(*) OVER (PARTITION BY block) AS events FROM p JOIN spots USING (lat, lon) JOIN blocks USING (id)")
def spatial_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Droughts in blocks no two of which are over 500 km apart, by complete link."""
    p = hazard_events(spark, sf_dir).where("type = 'Drought' and alert = 'Red'").select("event_id", "lat", "lon")
    blocks = clusters.complete_link(p, "event_id", 500.0)
    return blocks.join(blocks.groupBy("block").agg(F.count("*").alias("events")), "block").select("event_id", "block", "events")


LADDER = f"""t AS (SELECT * FROM hazard WHERE type = 'Wildfire' AND alert = 'Red' AND event_id % 10 <> 3), h AS (SELECT * FROM hazard WHERE type = 'Wildfire' AND alert = 'Red' AND event_id % 10 = 3), r(rung, km, hours) AS (VALUES (0, 500, 72), (1, 350, 48), (2, 250, 24), (3, 0, 0)),
kept AS (SELECT rung, t.event_id FROM t CROSS JOIN r WHERE r.km = 0 OR NOT EXISTS (SELECT 1 FROM h WHERE abs(epoch_us(t.ts) - epoch_us(h.ts)) / 3600000000 <= r.hours AND {KM.format(a='t', b='h')} <= r.km))"""


@query(HAZARD + ", " + LADDER + ", n AS (SELECT rung, count(*) AS n FROM kept GROUP BY rung) SELECT event_id, rung FROM kept WHERE rung = (SELECT coalesce(min(rung) FILTER (WHERE n >= {k}), 3) FROM n)".replace("{k}", "200"))
def embargo_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training fires apart from the held-out ones, by the strongest embargo that leaves 200 of them."""
    fires = hazard_events(spark, sf_dir).where("type = 'Wildfire' and alert = 'Red'")
    held = F.col("event_id") % 10 == 3
    return clusters.relaxed_embargo(fires.where(~held), fires.where(held), enough=200).select("event_id", "rung")


CYCLES = "SELECT ts AS cycle, range(0, 12 * (1 + epoch_us(ts) // 43200000000 % 6) + 1, CASE WHEN epoch_us(ts) // 43200000000 % 5 = 0 THEN 6 ELSE 3 END) AS leads FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-02-05', INTERVAL 12 HOUR)) AS ts)"


@query(HAZARD + f""", c AS ({CYCLES}), e AS (SELECT id, ts FROM hazard WHERE type = 'Wildfire' AND alert = 'Red'), x AS (SELECT id, cycle, leads, (floor(epoch(ts)) - epoch(cycle)) / 3600.0 AS ahead FROM e, c WHERE cycle >= ts - INTERVAL 5 DAY AND cycle <= ts + INTERVAL 4 HOUR),
s AS (SELECT *, list_min(list_transform(leads, lambda h: {{'offset': abs(h - ahead), 'lead': h}})) AS s FROM x WHERE ahead >= -3.1), w AS (SELECT id, cycle, s FROM s WHERE s.offset <= 3.1 AND len(list_filter(range(s.lead, s.lead + 25, 3), lambda h: NOT list_contains(leads, h))) = 0),
b AS (SELECT id, first(struct_pack(cycle := cycle, lead := s.lead, o := round(s.offset, 6)) ORDER BY round(s.offset, 6), cycle DESC) AS b FROM w GROUP BY id) SELECT e.id, epoch_us(b.cycle) AS cycle, b.lead AS lead, b.o AS "offset" FROM e LEFT JOIN b USING (id)""")
def forward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast cycle with all leads of the next day that starts nearest to each fire."""
    c = spark.sql("SELECT explode(sequence(timestamp'2023-12-28', timestamp'2024-02-05', interval 12 hours)) AS cycle")
    k = F.floor(F.unix_seconds("cycle") / 43200)
    c = c.withColumn("leads", F.sequence(F.lit(0).cast("long"), 12 * (1 + k % 6), F.when(k % 5 == 0, 6).otherwise(3).cast("long")))
    e = hazard_events(spark, sf_dir).where("type = 'Wildfire' and alert = 'Red'").select("id", "ts")
    got = experiments.forward_window(e, c, 24)
    return got.select("id", F.unix_micros("cycle").alias("cycle"), "lead", "offset")


THIN = PAIRS.replace("hazard a JOIN hazard b ON a.type = b.type", "(SELECT *, CAST(user_id AS VARCHAR) AS who FROM hazard) a JOIN (SELECT *, CAST(user_id AS VARCHAR) AS who FROM hazard) b ON a.who = b.who").replace("<= 432000000000", "<= 315360000000000").replace("< 80)", "< 400)")


@query(THIN + """, e AS (SELECT user_id, event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS i FROM hazard), l AS (SELECT a.i AS i, list(b.i) AS earlier FROM (SELECT event_id_a AS x, event_id_b AS y FROM pairs UNION ALL SELECT event_id_b, event_id_a FROM pairs) JOIN e a ON a.event_id = x JOIN e b ON b.event_id = y WHERE b.i < a.i GROUP BY a.i),
s AS (SELECT user_id, list_reduce(list_prepend({'i': 0::BIGINT, 'earlier': []::BIGINT[], 'anchors': []::BIGINT[]}, list({'i': e.i, 'earlier': coalesce(l.earlier, []), 'anchors': []::BIGINT[]} ORDER BY e.i)),
  lambda acc, x: {'i': 0::BIGINT, 'earlier': []::BIGINT[], 'anchors': CASE WHEN list_has_any(acc.anchors, x.earlier) THEN acc.anchors ELSE list_append(acc.anchors, x.i) END}).anchors AS anchors FROM e LEFT JOIN l USING (i) GROUP BY user_id)
SELECT user_id, e.event_id FROM (SELECT unnest(anchors) AS i FROM s) JOIN e USING (i)""")
def thinned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each source thinned so that no two are within 400 km: greedily from the latest on, in rounds of joins."""
    h = hazard_events(spark, sf_dir)
    pairs = joins.near_pairs(h.withColumn("type", F.col("user_id").cast("string")), max_km=400.0, max_days=3650.0, times=True)
    return evaluation.greedy_dedupe(pairs, h).where("anchor = event_id").join(h.select("event_id", "user_id"), "event_id").select("user_id", "event_id")


STEPS = "SELECT user_id, day, (event_id % 9) * 3 AS hours, avg(value / 3 - 8) AS t, avg(value / 4 - 10) AS dew, max(value / 1000) AS total FROM hazard GROUP BY ALL"
SVP = "CASE WHEN {t} >= 0 THEN 6.1078 * exp(17.269 * {t} / ({t} + 237.3)) ELSE 6.1078 * exp(21.875 * {t} / ({t} + 265.5)) END"


@query(HAZARD + f""", s AS (SELECT type, week, hours, avg(t) AS t, avg(dew) AS dew, max(total) AS total FROM (SELECT type, date_trunc('week', day)::DATE AS week, (event_id % 9) * 3 AS hours, value / 3 - 12 AS t, value / 4 - 10 AS dew, value / 1000 AS total FROM hazard) GROUP BY ALL), w AS (SELECT *, CASE WHEN hours IN (0, 24) THEN 0.5 ELSE 1.0 END AS w FROM s),
d AS (SELECT type, week, count(*) AS n, sum(w * t) / sum(w) AS t, sum(w * {SVP.format(t='dew')}) / sum(w) AS vap, greatest(0.0, (max(total) FILTER (WHERE hours = 24) - max(total) FILTER (WHERE hours = 0)) * 1000) AS pre FROM w GROUP BY ALL)
SELECT type, CAST(week AS VARCHAR) AS week, CASE WHEN n = 9 THEN round(t, 6) END AS tmp, CASE WHEN n = 9 THEN round(greatest(0.0, {SVP.format(t='t')} - vap), 6) END AS vpd, CASE WHEN n = 9 THEN round(pre, 6) END AS pre FROM d""")
def forecast_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of forecast steps by trapezoid weights, over water and ice, deficits not below zero."""
    h = hazard_events(spark, sf_dir)
    s = h.select("type", F.to_date(F.date_trunc("week", "day")).cast("string").alias("week"), ((F.col("event_id") % 9) * 3).alias("hours"), (F.col("value") / 3 - 12).alias("t"), (F.col("value") / 4 - 10).alias("dew"), (F.col("value") / 1000).alias("total"))
    s = s.groupBy("type", "week", "hours").agg(F.avg("t").alias("t"), F.avg("dew").alias("dew"), F.max("total").alias("total"))
    return experiments.daily_forecast(s, ["type", "week"]).select("type", "week", *[F.round(c, 6).alias(c) for c in ("tmp", "vpd", "pre")])


@query(HAZARD + """, d AS (SELECT type, day, avg(value) AS v FROM hazard WHERE NOT (type = 'Heat' AND day(day) % 5 = 0) GROUP BY type, day)
SELECT type, CAST(day AS VARCHAR) AS day, CASE WHEN (SELECT count(*) FROM d b WHERE b.type = a.type AND b.day BETWEEN a.day - 6 AND a.day) = 7 THEN round((SELECT avg(v) FROM d b WHERE b.type = a.type AND b.day BETWEEN a.day - 6 AND a.day), 6) END AS mean FROM d a""")
def trailing_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the last seven days where none is missing."""
    d = hazard_events(spark, sf_dir).where("not (type = 'Heat' and day(day) % 5 = 0)").groupBy("type", "day").agg(F.avg("value").alias("v"))
    return experiments.trailing_mean(d, "type", "day", "v").select("type", F.col("day").cast("string").alias("day"), F.round("mean", 6).alias("mean"))


@query("""WITH m AS (SELECT l_suppkey % 50 AS cell, month(l_shipdate) AS mo, avg(l_quantity) AS now, avg(l_tax) * 100 - 4 AS normal FROM lineitem GROUP BY ALL), d AS (SELECT mo, avg(day(last_day(make_date(y, mo, 1)))) AS days FROM (SELECT unnest(range(1, 13)) AS mo), (SELECT unnest(range(1991, 2021)) AS y) GROUP BY mo)
SELECT cell, mo, round(now - normal, 6) AS tmp_delta, round(CASE WHEN abs(round(normal, 1)) < 1e-9 THEN now - round(normal, 1) ELSE (now - round(normal, 1)) / round(normal, 1) * 100 END, 4) AS pre_delta, round(days, 6) AS days FROM m JOIN d USING (mo)""")
def climate_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from normals, and the mean days of a month over a period."""
    m = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("cell"), F.month("l_shipdate").alias("mo")).agg(F.avg("l_quantity").alias("now"), (F.avg("l_tax") * 100 - 4).alias("normal"))
    delta = lambda kind, normal: experiments.climate_delta(F.lit(kind), F.col("now"), normal)
    return m.select("cell", "mo", F.round(delta("tmp", F.col("normal")), 6).alias("tmp_delta"), F.round(delta("pre", F.round("normal", 1)), 4).alias("pre_delta"), F.round(experiments.mean_month_days(1991, 2020, F.col("mo")), 6).alias("days"))


@query(HAZARD + """, t AS (SELECT event_id, [CASE WHEN event_id % 3 = 0 THEN 'not a time' END, CASE WHEN event_id % 4 = 0 THEN '' ELSE NULL END, CASE WHEN event_id % 2 = 0 THEN CAST(day AS VARCHAR) || 'T06:00:00Z' END, CAST(day AS VARCHAR)] AS x, day, ts FROM hazard)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(day::TIMESTAMP) + 21600000000 ELSE epoch_us(day::TIMESTAMP) END AS event_time, epoch_us(date_trunc('day', ts)) AS day_start, epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) AS day_end, CASE WHEN event_id % 5 = 0 THEN 999.0 ELSE round(abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) / 86400000000.0, 6) END AS gap FROM t""")
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's time by the first field that is one, its day's bounds and the gap to another (H5, H7, H8, R2)."""
    n, day = F.col("event_id"), F.col("day").cast("string")
    fields = [F.when(n % 3 == 0, "not a time"), F.when(n % 4 == 0, ""), F.when(n % 2 == 0, F.concat(day, F.lit("T06:00:00Z"))), day]
    at = F.coalesce(*[f.try_cast("timestamp") for f in fields])
    start, other = F.date_trunc("day", "ts"), F.lit("2024-01-15").cast("timestamp")
    gap = F.coalesce(F.abs(F.unix_micros("ts") - F.unix_micros(F.when(n % 5 != 0, other))) / 86_400_000_000.0, F.lit(999.0))
    return hazard_events(spark, sf_dir).select("event_id", F.unix_micros(at).alias("event_time"), F.unix_micros(start).alias("day_start"), F.unix_micros(start + F.expr("interval 1 day")).alias("day_end"), F.round(gap, 6).alias("gap"))


@query(HAZARD + """, p AS (SELECT user_id, type, max(ts) AS last FROM hazard WHERE type <> 'Heat' GROUP BY ALL), c AS (SELECT p.user_id, p.type, d, count(*) AS seeds FROM p JOIN hazard h ON h.user_id = p.user_id AND h.type = p.type, (VALUES (2), (4), (7)) l(d) WHERE epoch_us(h.ts) >= epoch_us(p.last) - d * 86400000000 GROUP BY ALL)
SELECT p.user_id, p.type, min(d) FILTER (WHERE seeds >= 2) AS days, arg_min(seeds, d) FILTER (WHERE seeds >= 2) AS seeds FROM p JOIN c ON c.user_id = p.user_id AND c.type = p.type GROUP BY p.user_id, p.type""")
def seed_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest look-back of 2, 4 or 7 days with enough detections of each fire (H9): one pass, no join of a rung each."""
    h = hazard_events(spark, sf_dir).where("type <> 'Heat'")
    last = h.groupBy("user_id", "type").agg(F.max("ts").alias("last"))
    back = F.unix_micros("last") - F.unix_micros("ts")
    rungs = (2, 4, 7)
    c = h.join(last, ["user_id", "type"]).groupBy("user_id", "type").agg(*[F.count_if(back <= d * 86_400_000_000).alias(f"n{d}") for d in rungs])
    first = F.coalesce(*[F.when(F.col(f"n{d}") >= 2, F.struct(F.lit(d).cast("int").alias("days"), F.col(f"n{d}").alias("seeds"))) for d in rungs])
    return c.select("user_id", "type", first["days"].alias("days"), first["seeds"].alias("seeds"))


@query("""WITH x AS (SELECT p_partkey AS cell, p_size % 17 AS k, CAST(p_retailprice AS DOUBLE) AS share FROM part), t AS (SELECT cell % 20 AS row, sum(share) AS every, sum(share) FILTER (WHERE k = 0) AS water, sum(share) FILTER (WHERE k BETWEEN 1 AND 5) AS forest FROM x GROUP BY ALL)
SELECT row, round(100 - 100 * coalesce(water, 0) / every, 6) AS land_pct, CAST(least(65534, round_even(coalesce(forest, 0) / every * 30000, 0)) AS BIGINT) AS forest_ha FROM t""")
def land_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land and forest of grid rows by shares of classes, areas rounded and clipped."""
    x = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("row"), (F.col("p_size") % 17).alias("k"), F.col("p_retailprice").cast("double").alias("share"))
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("share"))), F.lit(0.0))
    t = x.groupBy("row").agg(F.sum("share").alias("every"), part(F.col("k") == 0).alias("water"), part(F.col("k").between(1, 5)).alias("forest"))
    return t.select("row", F.round(100 - 100 * F.col("water") / F.col("every"), 6).alias("land_pct"), F.least(F.lit(65534), F.rint(F.col("forest") / F.col("every") * 30000)).cast("long").alias("forest_ha"))
