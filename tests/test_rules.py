"""Rules on small rows: the cases that the specification's fixtures name, and nulls, ties, repeats and empty tables against plain versions."""

import datetime as dt
import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormledger.functions import columns as C
from stormledger.functions import geometry as G
from stormledger.functions import parsing as P
from stormledger.operators import evaluation, experiments, identity, joins, ledger, policy, refresh, shapes, tracks
from stormledger.sources import feeds, storage

DAY = 86_400


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(x)))


def points(spark, n, seed, spread=None):
    """Events crowded about the date line, a pole and two plain places, some twice at one place and time, some without a place."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        lat, lon = rng.choice([(10, 179.9), (-0.2, -179.8), (89.3, 40), (47, 8), (-60, 100)])
        lat, lon = min(90.0, lat + rng.uniform(-0.8, 0.8)), (lon + rng.uniform(-1.5, 1.5) + 180) % 360 - 180
        rows.append((i, rng.choice(["a", "b"]), lat, lon, rng.randrange(12 * DAY)))
    rows += [(n, *rows[0][1:]), (n + 1, "a", None, 5.0, 0), (n + 2, "a", 5.0, 5.0, None)]
    df = spark.createDataFrame(rows, "event_id long, type string, lat double, lon double, s long").withColumn("ts", F.timestamp_seconds("s"))
    return df, [r for r in rows if r[2] is not None and r[4] is not None]


def test_near_pairs_over_date_line_and_pole(spark):
    df, rows = points(spark, 150, 1)
    got = sorted((r.event_id_a, r.event_id_b) for r in joins.near_pairs(df).collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(a[4] - b[4]) <= 5 * DAY and km(a[2:4], b[2:4]) < 80)
    assert got == want and len(want) > 100
    assert joins.near_pairs(df.where("false")).collect() == []


def test_embargo_over_date_line_and_pole(spark):
    df, rows = points(spark, 150, 2)
    got = sorted(r.event_id for r in joins.embargoed(df.where("event_id % 5 > 0"), df.where("event_id % 5 = 0"), 60.0, 24.0).collect())
    held = [r for r in rows if r[0] % 5 == 0]
    near = {a[0] for a in rows for b in held if abs(a[4] - b[4]) <= DAY and km(a[2:4], b[2:4]) <= 60}
    assert got == sorted(r.event_id for r in df.where("event_id % 5 > 0").collect() if r.event_id not in near)


def test_as_of_joins_with_ties(spark):
    rng = random.Random(3)
    left = [(i, rng.choice("ab"), rng.randrange(0, 40 * 3600, 1800)) for i in range(120)] + [(200, None, 7), (201, "a", None), (202, "none", 5)]
    right = [(i, rng.choice("ab"), rng.randrange(0, 40 * 3600, 1800)) for i in range(60)] + [(99, "a", None), (98, None, 7)]
    l = spark.createDataFrame(left, "id long, k string, s long").select("id", "k", F.timestamp_seconds("s").alias("ts"))  # noqa: E741
    r = spark.createDataFrame(right, "rid long, k string, s long").select("rid", "k", F.timestamp_seconds("s").alias("rts"))
    ok = lambda a, b: a[1] is not None and a[1] == b[1] and a[2] is not None and b[2] is not None
    want = {a[0]: min(((abs(a[2] - b[2]), b[0]) for b in right if ok(a, b) and abs(a[2] - b[2]) <= 3 * 3600), default=(None, None)) for a in left}
    got = {x.id: (None if x.gap_s is None else int(x.gap_s), x.rid) for x in joins.nearest_in_time(l, r, "k", 3).collect()}
    assert got == want
    want = {a[0]: max(((b[2], b[0]) for b in right if ok(a, b) and 2 * 3600 <= a[2] - b[2] <= 9 * 3600), default=(None, None))[1] for a in left}
    assert {x.id: x.rid for x in tracks.previous_cycle(l, r, "k", 2, 9).collect()} == want
    assert {x.rid for x in joins.nearest_in_time(l, r.where("false"), "k", 3).collect()} == {None}


@pytest.mark.parametrize("fit", [0, evaluation.FIT])
def test_quantiles_fronts_and_splits_with_ties(spark, monkeypatch, fit):
    monkeypatch.setattr(evaluation, "FIT", fit)
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice([None, float("nan"), 1.0, 2.0, rng.uniform(-5, 9), 1e9])) for _ in range(300)] + [("one", 3.0), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in evaluation.exact_quantiles(df, "g", "v", {"q1": 0.1, "q2": 0.5, "q3": 0.975}).collect()}
    for g in ("a", "b", "c", "one"):
        v = [x for k, x in rows if k == g and x is not None and x == x]
        assert np.allclose([got[g].q1, got[g].q2, got[g].q3], np.quantile(v, [0.1, 0.5, 0.975])) and got[g].n == len(v)
    assert "void" not in got and evaluation.exact_quantiles(df.where("false"), "g", "v", {"q": 0.5}).collect() == []
    for spread in (4, 300):
        c = [(i, float(rng.randrange(spread)), float(rng.randrange(spread))) for i in range(200)] + [(900, None, 1.0), (901, 0.0, None)]
        front = sorted(r.k for r in evaluation.pareto_front(spark.createDataFrame(c, "k long, a double, s double"), "k", "a", "s").collect())
        clean = [x for x in c if None not in x]
        assert front == sorted(k for k, a, s in clean if not any(b <= a and t >= s and (b < a or t > s) for _, b, t in clean))
    keys = [(i, rng.choice(["x", None])) for i in range(90)]
    split = {r.k: r.split for r in evaluation.stratified_split(spark.createDataFrame(keys, "k long, s string"), "k", "s").collect()}
    for s in ("x", None):
        order = sorted((hashlib.sha256(f"split-v1|{k}".encode()).hexdigest(), k) for k, x in keys if x == s)
        assert all((split[k] == "test") == ((i + 1) % 3 == 0) for i, (_, k) in enumerate(order))


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = [("a", i, float(i * i % 37), float(i % 11)) for i in range(25)] + [("a", 99, None, 1.0), ("b", 1, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, k long, x double, y double")
    runs = [sorted(evaluation.paired_bootstrap(df.repartition(n), "g", "k", "x", "y", 60).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and [(r.g, r.n) for r in runs[0]] == [("a", 25), ("b", 1)] and runs[0][1].median == runs[0][1].low == 1.0
    d = [x - y for _, k, x, y in rows if _ == "a" and x is not None]
    assert runs[0][0].median == np.median(d) and runs[0][0].low <= runs[0][0].median <= runs[0][0].high


def test_null_keys_meet_in_a_diff(spark):
    a, b = (spark.createDataFrame(r, "k string, v long") for r in ([(None, 1), ("x", 1), ("y", None)], [(None, 1), ("x", 2), ("z", 0)]))
    assert sorted((r.k, r.change) for r in joins.diff(a, b, "k", ["v"]).collect()) == [("x", "changed"), ("y", "removed"), ("z", "added")]


def test_identities(spark):
    member = lambda *m: F.array(*[F.struct(F.lit(o).alias("origin"), F.lit(i).alias("source_id")) for o, i in m])
    ids = one(spark, ledger.stable_id(F.lit("Flood"), member(("eonet", "E1"), ("gdacs", "1104131")), F.lit("x")), ledger.stable_id(F.lit("Heat"), member(("eonet", "9"), ("eonet", "10")), F.lit("x")), ledger.stable_id(F.lit("Storm"), member(("other", "b"), ("other", "a")), F.lit("x")))
    assert ids == ("gdacs:FL:1104131", "eonet:HEAT:10", "event:TC:" + hashlib.sha1(b"other:a|other:b").hexdigest()[:16])
    fires = [("1", "gdacs", "100", None), ("2", "gdacs", "101", None), ("3", "cems", "E5", None), ("4", "cems", "E6", "100"), ("5", "cems", "E7", "")]
    df = spark.createDataFrame(fires, "id string, origin string, source_id string, gdacs_id string")
    who = identity.fire_identity(df)
    assert [tuple(r) for r in df.select(who["origin"], who["id"]).collect()] == [("gdacs", "100"), ("gdacs", "101"), ("cems", "E5"), ("gdacs", "100"), ("cems", "E7")]
    assert one(spark, identity.alias_keys(F.lit("i"), F.lit("Flood"), member(("gdacs", "7"), ("cems", "E"), ("other", "z"), ("gdacs", "7")))) == (["i", "gdacs-FL-7", "cems-E"],)


def test_text_cases(spark):
    lit = F.lit
    assert one(spark, P.drought_area_km2(lit("Drought impact for 1,412,468 km2")), P.drought_area_km2(lit("1,412,468 km2 of land")), P.drought_area_km2(lit(None).cast("string"))) == (1412468.0, None, None)
    assert one(spark, *[P.alert_level(lit(a), lit(b)) for a, b in (("red", ""), (None, "GDACS · Orange"), (None, "bored greenish"), ("x", "Red, then orange"))]) == ("Red", "Orange", "", "Red")
    assert one(spark, *[C.rounded_people(lit(x).cast("double")) for x in (None, 0, 999, 1000, 2443, 6868, 2500)]) == ("—", "0 people", "<1,000 people", "≈1,000 people", "≈2,000 people", "≈7,000 people", "≈2,000 people")
    now = lit("2026-09-06 12:00:00").cast("timestamp")
    at = lambda s: P.age_label(lit(s).cast("timestamp"), now)
    assert one(spark, at("2026-09-06 10:00:00"), at("2026-09-07 12:00:00"), at(None), at("2026-09-06 11:50:00"), at("2026-09-05 11:00:00"), at("2026-09-03 12:00:00")) == ("Updated 2 h ago", "Update time unavailable", "Update time unavailable", "Updated <1 hour ago", "Updated 1 day ago", "Updated 3 days ago")
    assert one(spark, P.as_count(lit("1 234 people")), P.as_count(lit("2.5")), P.as_count(lit("-3")), P.hectares(lit("900")), P.hectares(lit("12 ha")), P.hectares(lit("5,000"))) == (1234, 2, None, None, 12.0, 5000.0)
    assert one(spark, C.alert_rank(lit("red")), C.alert_rank(lit(" ORANGE ")), C.alert_rank(lit(None).cast("string"))) == (3, 2, 0)


def test_feed_of_a_gdacs_feature(spark):
    doc = '{"features":[{"geometry":{"type":"Point","coordinates":[30,10]},"properties":{"eventtype":"FL","eventid":7,"country":"Chad","fromdate":"2026-09-01","todate":"2026-09-05","lastupdate":"2026-09-06T10:00:00Z","alertlevel":"Orange","severitydata":{"severitytext":"Flood"}}},{"geometry":{"type":"Point","coordinates":[300,10]},"properties":{"eventtype":"FL","eventid":8}},{"geometry":null,"properties":null}]}'
    rows = feeds.gdacs(spark.createDataFrame([(doc,), (None,), ('{"features":',), ('{"other":1}',)], "payload string")).collect()
    assert len(rows) == 1 and rows[0].id == "gdacs-FL-7" and rows[0].source_updated_at == "2026-09-06T10:00:00Z" and (rows[0].event_start, rows[0].event_end, rows[0].last_detection) == ("2026-09-01", "2026-09-05", None)
    assert feeds.eonet(spark.createDataFrame([], "payload string")).collect() == []


def test_burned_area_fields(spark):
    def area(**properties):
        doc = json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"eventtype": "WF", "eventid": 1, **properties}}]})
        rows = feeds.gdacs(spark.createDataFrame([(doc,)], "payload string")).collect()
        return rows[0].burned_area_ha if rows else None

    assert [area(**{f: 20000}) for f in feeds.AREA_FIELDS] == [20000.0] * 8 and [area(severitydata={f: "20,000 ha"}) for f in feeds.SEVERITY_FIELDS] == [20000.0] * 6
    assert area(ha=900, burnedAreaHa="12000") == 12000.0 and area(severitydata={"other": {"text": "in 15 813 hectares"}}) == 15813.0
    assert area(BURNEDAREA=20000) is None and area(severitydata={"other": 20000}) is None and area(ha="9000") is None


def test_cells_beyond_the_date_line(spark):
    grid = spark.range(720 * 4).selectExpr("id % 720 * 0.5 - 179.75 AS lon_c", "floor(id / 720) * 0.5 - 0.75 AS lat_c")
    at = lambda lon: {r.lon_c for r in joins.cells_within(spark.createDataFrame([(lon, 0.0)], "lon double, lat double"), grid, 0.5).collect()}
    assert at(179.9) == {179.75, -179.75} and at(-179.9) == {179.75, -179.75} and at(0.0) == {0.25, -0.25}
    foot = lambda x0, x1, reach: {r.lon_c for r in shapes.cells_in(spark.createDataFrame([(square(x0, -1, x1, 1),)], "rings array<array<struct<x double, y double>>>"), grid, reach_km=reach).collect()}
    assert foot(179.6, 179.9, 60.0) == {179.25, 179.75, -179.75} and foot(179.6, 180.4, 0.0) == {179.75, -179.75} and foot(-180.4, -179.6, 0.0) == {179.75, -179.75}
    assert foot(1.0, 2.0, 0.0) == {1.25, 1.75}


def square(x0, y0, x1, y1):
    return [[{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]


FEATURE = "id long, index int, rings array<array<struct<x double, y double>>>, properties string, lon double, lat double"


def test_flood_polygon_cases(spark):
    rows = [
        (1, 0, square(29, 36, 39, 41.5), "context", 40.2948, 40.6191), (1, 1, square(40.28, 40.61, 40.31, 40.63), "flood affected area", 40.2948, 40.6191),
        (2, 0, square(10, 10, 11, 11), "", 40.0, 40.0), (3, 0, square(40, 40, 40.2, 40.2), "", 40.21, 40.10), (4, 0, square(100, 20, 108, 26), None, 104.0, 23.0), (5, 0, None, "flood", 1.0, 1.0),
    ]
    got = {r.id: r for r in shapes.best_polygon(spark.createDataFrame(rows, FEATURE), "id").collect()}
    assert got[1]["index"] == 1 and got[1].reason == "center_aligned_source_feature" and got[1].area_km2 < 100 and got[1].candidates == 2
    assert got[2]["index"] is None and got[2].reason == "no_center_aligned_polygon"
    assert got[3].status == "pass" and 0 < got[3].km < 10 and got[4].warning and 5 not in got
    # the area of a degree cell on the ellipsoid is 12,308.8 km2 at the equator
    a = spark.createDataFrame([(square(0, 0, 1, 1),)], "r array<array<struct<x double, y double>>>").select(G.area_km2(F.col("r"))).first()[0]
    assert abs(a - 12308.8) / 12308.8 < 0.006


def test_wildfire_qc_cases(spark):
    def qc(mapped, episode=16, source="GDACS/GWIS", burned=100.0):
        q = policy.fire_qc(F.lit(mapped), F.lit(burned), F.lit(episode), F.lit(source), F.lit("source_reported_current_episode"), F.lit(16))
        return one(spark, q["status"], q["warning"].isNotNull(), q["reason"], policy.fire_qc_pass(q))

    assert qc(100.0)[0] == "pass" and not qc(100.0)[1] and qc(100.0)[3]
    assert qc(100.0, episode=17)[2] == "burned_area_and_footprint_episode_not_aligned"
    assert qc(100.0, source="unknown")[0] == "failed" and qc(400.0)[0] == "failed" and qc(140.0)[:2] == ("pass", True)
    assert qc(None)[0] == "failed" and qc(100.0, burned=None)[0] == "failed"


def test_wind_methods(spark):
    good = ["gdacs_observed_wind_34kt_polygon", "gdacs_actual_wind_64kt_polygon", "GDACS observed wind 34 knots polygon"]
    bad = ["gdacs_forecast_wind_34kt_polygon", "gdacs_wind_polygon", "observed wind polygon", "observed 34kt polygon", "gdacs_event_polygon_fallback", "observed wind 34kt polygon proximity", "observed wind 134kt polygon", None]
    rows = spark.createDataFrame([(m,) for m in good + bad], "m string").select(policy.wind_threshold(F.col("m")).alias("t")).collect()
    assert [r.t is not None for r in rows] == [True] * 3 + [False] * 8 and rows[1].t == "64 kt"


def test_display_thresholds(spark):
    shown = lambda p, ha, n, strict=False: policy.fire_shown(F.lit(p), F.lit(ha).cast("double"), F.lit(n).cast("long"), strict)
    assert one(spark, shown("Standard", 10000, 10000), shown("Standard", 10000, 9999), shown("Standard", 10000, 10000, True), shown("High", None, None), shown("Standard", None, 1)) == (True, False, False, True, False)


def test_steps_wrap_and_clamp(spark):
    lat, lon = tracks.step_of(F.lit(89.0), F.lit(179.9), F.lit(20.0), F.lit(90.0), 10800)
    a, b = one(spark, lat, lon)
    turn = math.degrees(20.0 * 10800 / (6371000 * 0.05))  # the cosine is 0.05 at least
    assert a == 89.9 and abs(b - (179.9 + turn - 360)) < 1e-9


def test_lifecycle_labels(spark):
    day = lambda s: F.lit(s).cast("date")
    of = lambda f, l, whole=True: C.lifecycle(day(f), day(l), day("2026-09-01"), day("2026-09-07"), F.lit(whole))  # noqa: E731, E741
    assert one(spark, of("2026-09-02", "2026-09-07"), of("2026-08-20", "2026-09-07"), of("2026-08-20", "2026-09-03"), of("2026-09-02", "2026-09-03"), of("2026-08-20", "2026-09-03", False), of("2026-08-01", "2026-08-20")) == ("New this period", "Ongoing", "Resolved this period", "New & resolved this period", "Ongoing", "Ongoing")


def test_refresh_ignores_order_and_blanks(spark):
    at = dt.datetime(2026, 9, 1)
    rows = [(f"e{i}", "gdacs", str(i), "Flood", f"Title  {i}", "Red", at, 1.0 + i, 2.0, None) for i in range(40)]
    schema = "id string, origin string, source_id string, type string, title string, alert string, ts timestamp, lat double, lon double, burned_area_ha double"
    a = refresh.semantic(spark.createDataFrame(rows, schema))
    same = [(*r[:4], f" Title {k} ", *r[5:7], r[7] + 1e-9, *r[8:]) for k, r in enumerate(rows)]
    b = refresh.semantic(spark.createDataFrame(same[::-1], schema).repartition(3))
    moved = refresh.semantic(spark.createDataFrame([(*rows[0][:7], 9.0, *rows[0][8:]), *rows[1:]], schema))
    f = [refresh.fingerprint(x).first() for x in (a, b, moved)]
    assert f[0] == f[1] != f[2] and f[0].n == 40
    assert refresh.changed(a, b).collect() == [] and [r.id for r in refresh.changed(a, moved).collect()] == ["e0"]
    assert refresh.fingerprint(a.where("false")).first().n is None


def test_landed_files(spark, tmp_path):
    for name, text in (("b.json", '{"n": 2}'), ("a.json", '{"n": 1}'), ("c.json", '{"n":'), ("d.json", "[1]"), ("e.json", ""), ("x.txt", "no")):
        (tmp_path / name).write_text(text)
    files = storage.documents(spark, str(tmp_path), "n long")
    got = [(r.name, r.doc and r.doc.n, r.fault) for r in files.collect()]
    assert got[:4] == [("a.json", 1, None), ("b.json", 2, None), ("c.json", None, "broken"), ("d.json", None, "no_object")]
    with pytest.raises(ValueError):
        storage.require_objects(files)
    assert storage.only_one(files, "a.json").count() == 1
    for suffix in (".json", "none"):
        with pytest.raises(ValueError):
            storage.only_one(files, suffix)
    out = f"{tmp_path}/out"
    for keys in (["a/1", "b"], ["b"]):
        storage.write_products(spark.createDataFrame([(k, f'{{"k":"{k}"}}') for k in keys], "key string, doc string"), "key", "doc", out)
    assert [r.value for r in spark.read.text(out).collect()] == ['{"k":"b"}']


def test_contrasts_need_two_controls(spark):
    rows = [(1, o, v, 1.0) for o, v in (("downwind", 5.0), ("left", 3.0), ("right", 1.0), ("upwind", None))] + [(2, "downwind", 5.0, 1.0), (2, "left", 3.0, 1.0)] + [(3, o, 4.0, 1.0) for o in ("downwind", "left", "right")]
    got = {r.e: r for r in experiments.contrasts(spark.createDataFrame(rows, "e long, orientation string, value double, area double"), "e").collect()}
    assert (got[1].difference, got[1].rank, got[1].is_max) == (3.0, 1, True) and not got[2].eligible and got[2].difference is None
    assert (got[3].difference, got[3].rank) == (0.0, 1)


def test_cells_of_an_area_unless_too_many_are_masked(spark):
    rows = [("a", c, float(c), 50.0) for c in range(9)] + [("b", c, float(c) if c < 2 else None, 50.0) for c in range(9)] + [("c", 1, 1.0, 900.0), ("d", 1, 1.0, 1.0), ("d", 2, 1.0, 1.0), ("e", 1, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, c long, s double, area double")
    got = sorted((r.g, r.c, r.rank, r.wanted) for r in evaluation.cells_of_area(df, "g", "c", "s", "area", 10.0).collect())
    assert got == [("a", 8 - k, k + 1, 5) for k in range(5)][::-1] + [("c", 1, 1, 1), ("d", 2, 1, 1)]


def test_cells_along_legs_are_those_of_all_pairs(spark):
    grid = spark.range(90 * 40).selectExpr("(id % 90) * 4 - 178.0 AS lon_c", "floor(id / 90) * 3 - 58.5 AS lat_c")
    legs = [(1, -20.0, -15.0, 41.0, 25.0), (2, 176.0, 50.0, 186.0, 58.0), (3, -179.0, 3.0, -184.0, -4.0), (4, 10.0, 0.0, 10.0, 0.0), (5, 0.0, 5.0, 90.0, 5.0), (6, None, 1.0, 2.0, 3.0), (7, 30.0, -58.0, 30.0, 58.0)]
    legs = spark.createDataFrame(legs, "id long, ax double, ay double, bx double, by double")
    every = legs.where("ax is not null").crossJoin(grid).withColumn("rings", G.polygon([(F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))]))
    want = {(r.id, r.lon_c, r.lat_c): r.km for r in every.withColumn("km", G.distance_km(F.col("rings"), F.col("lon_c"), F.col("lat_c"))).where("km <= 450").collect()}
    found = shapes.cells_along(legs, grid, 450.0)
    got = {(r.id, r.lon_c, r.lat_c): r.km for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got) and {k[0] for k in got} == {1, 2, 3, 4, 5, 7}
    assert found.count() == len(got)
    # sides as arrays are walked a pair at a time, which corridors had no time for
    from stormledger.plans.products import corridors

    assert "zip_with" not in corridors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_a_step_there_and_back_ends_where_sql_says(spark):
    import math

    rows = [(x / 2, u) for x in range(120) for u in (4.0, 8.0, 12.0, 16.0)]
    df, lat = spark.createDataFrame(rows, "x double, u double"), F.lit(-19.75)
    _, there = tracks.step_of(lat, F.col("x"), F.col("u"), F.lit(0.0), 10800)
    _, back = tracks.step_of(lat, F.col("there"), -F.col("u"), F.lit(0.0), 10800)
    got = [(r.x, r.u, r.back) for r in df.withColumn("there", there).withColumn("back", back).collect()]
    step = lambda x, u: x + u * 10800 / (6371000.0 * math.cos(math.radians(-19.75))) * 180.0 / math.pi
    assert got == [(x, u, step(step(x, u), -u)) for x, u in rows]  # to the last bit: cells' borders are among them


@pytest.mark.parametrize("wide, lookup", [(10.0, 1000), (0.0, 1000), (0.05, 0)])
def test_medians_of_resamples_by_counted_ranks(spark, monkeypatch, wide, lookup):
    import hashlib
    import statistics

    from stormledger.operators import evaluation

    monkeypatch.setattr(evaluation, "WIDE", wide)
    monkeypatch.setattr(evaluation, "LOOKUP", lookup)
    rows = [("a", k, (k * 37 % 101) / 4, 1.0) for k in range(101)] + [("b", k, float(k % 3), 0.0) for k in range(40)] + [("c", 1, 2.5, 0.0), ("d", 1, None, 0.0)]
    got = {r.g: r for r in evaluation.paired_bootstrap(spark.createDataFrame(rows, "g string, k long, x double, y double"), "g", "k", "x", "y", 30).collect()}
    assert got.keys() == {"a", "b", "c"}
    for g in got:
        d = [x - y for h, _, x, y in rows if h == g]
        draw = lambda b, j: int(hashlib.sha256(f"20260914|{b}|{j}".encode()).hexdigest()[:12], 16) % len(d)
        medians = sorted(statistics.median(d[draw(b, j)] for j in range(1, len(d) + 1)) for b in range(1, 31))
        at = lambda q: medians[int(q * 29)] + (q * 29 - int(q * 29)) * (medians[min(29, int(q * 29) + 1)] - medians[int(q * 29)])
        assert (got[g].n, got[g]["median"]) == (len(d), statistics.median(d))
        assert got[g].low == pytest.approx(at(0.025)) and got[g].high == pytest.approx(at(0.975))
