import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stormledger.functions import geometry as G
from stormledger.operators import episodes, experiments, exposure, identity, policy, refresh, tracks

RINGS = "rings array<array<struct<x double, y double>>>"


def box(x0, y0, x1, y1):
    return [[{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]


@pytest.fixture(scope="module")
def grid(spark):
    cells = [(r, c, r + 0.5, c + 0.5, 10 * (r + c)) for r in range(10) for c in range(10)]
    return spark.createDataFrame(cells, "row int, col int, lat_c double, lon_c double, people long").withColumns({"land_ha": F.lit(100.0), "forest_ha": F.when(F.col("col") > 0, 50.0).otherwise(-1.0), "crop_ha": F.lit(20.0)})


def test_people_inside_and_around_a_fire(spark, grid):
    f = spark.createDataFrame([(1, box(0, 0, 2, 1)), (2, None), (3, box(50, 50, 51, 51))], f"id long, {RINGS}")
    got = {r.id: tuple(r)[1:] for r in exposure.fire_people(f, "id", grid, reach_km=60.0).collect()}
    assert got == {1: (10, 10 + 20 + 10 + 20, 50), 2: (None, None, None), 3: (0, 0, 0)}


def test_the_economy_by_country(spark, grid):
    f = spark.createDataFrame([(1, box(0, 0, 4, 1)), (2, box(8, 8, 9, 9)), (3, box(30, 30, 31, 31))], f"id long, {RINGS}")
    lands = spark.createDataFrame([("A", box(0, 0, 1.9, 9)), ("B", box(1.9, 0, 4, 9)), ("C", box(8, 8, 10, 10))], f"country string, {RINGS}")
    rates = spark.createDataFrame([("A", 100.0), ("C", None), ("D", 5.0)], "country string, rate double")
    got = exposure.economy(f, "id", grid, lands, rates).collect()
    assert [(r.id, r.value, r.coverage_pct, [tuple(c) for c in r.components]) for r in got] == [(1, 1000.0, 16.7, [(1000.0, "A", 10, 100.0)])]
    many = spark.createDataFrame([(f"L{k:02}", box(0, 0, 4, 1)) for k in range(15)], f"country string, {RINGS}")
    top = exposure.economy(f, "id", grid, many, many.select("country", F.substring("country", 2, 2).cast("double").alias("rate"))).first()
    assert [c.country for c in top.components] == [f"L{k:02}" for k in range(14, 2, -1)]


def test_assets_by_hazard(spark, grid):
    f = spark.createDataFrame([(1, "Drought", box(0, 0, 2, 1)), (2, "Wildfire", box(0, 0, 2, 1)), (3, "Flood", box(0, 0, 2, 1)), (4, "Heat", box(0, 0, 2, 1)), (5, "Storm", None)], f"id long, type string, {RINGS}")
    lands, rates = spark.createDataFrame([("A", box(0, 0, 9, 9))], f"country string, {RINGS}"), spark.createDataFrame([("A", 3.0)], "country string, rate double")
    got = {r.id: r for r in exposure.by_hazard(f, "id", grid, lands, rates).collect()}
    assert (got[1].land_km2, got[1].forest_km2, got[1].crop_km2, got[1].people, got[1].gdp_usd) == (2.0, 0.5, 0.4, None, None) and got[1].mapped_km2 > 20000
    assert (got[2].land_km2, got[2].forest_km2, got[2].mapped_km2) == (None, 0.5, None) and (got[3].people, got[3].gdp_usd, got[3].coverage_pct) == (10, 30.0, 100.0)
    assert [got[i].status for i in (1, 4, 5)] == ["ready", "no_assets", "unmapped"] and got[4].forest_km2 is None and got[5].components is None


def test_policy_changes_what_is_not_of_today(spark):
    def record(kind, method=None, qc=None, grade="context_grade", role="x", ratio=1.0, mapped=True):
        return (kind, mapped, method, qc, grade, role, 100.0 * ratio, 100.0, 16, "GDACS/GWIS", 16)

    schema = "type string, mapped boolean, method string, qc struct<status string, reason string, authority boolean, aligned boolean, ratio double, warning string>, grade string, role string, mapped_ha double, burned_ha double, episode int, source string, source_episode int"
    flood = policy.GRADES["flood"]
    rows = [record("Wildfire"), record("Wildfire", ratio=9.0), record("Flood", grade=flood[0], role=flood[1]), record("Flood"), record("Storm", "observed wind 34kt polygon"), record("Wildfire", mapped=False)]
    once = exposure.enforced(spark.createDataFrame(rows, schema))
    got = once.collect()
    assert [r.changed for r in got] == [True, True, False, True, True, False]
    assert (got[0].method, got[0].grade, got[0].qc.status) == (exposure.ADMITTED, "exposure_grade", "pass") and (got[1].method, got[1].grade) == (exposure.UNVERIFIED, "context_grade")
    assert got[4].grade == "exposure_grade" and got[5].method is None
    assert not any(r.changed for r in exposure.enforced(once.drop("changed")).collect())  # the second time nothing changes


def test_growth_of_a_footprint(spark):
    rows = [("a", 1, box(0, 0, 1, 1)), ("a", 1, box(0.5, 0, 1.5, 1)), ("a", 2, box(1, 0, 2, 1)), ("b", 5, box(0, 0, 1, 1)), (None, 5, box(0, 0, 1, 1))]
    got = {r.g: r for r in exposure.growth(spark.createDataFrame(rows, f"g string, day int, {RINGS}"), ["g"], "day").collect()}
    one = got["b"].union_km2
    assert got["a"].union_km2 == pytest.approx(2 * one) and got["a"].first_km2 == pytest.approx(1.5 * one) and got["a"].added_km2 == pytest.approx(0.5 * one) and got["b"].added_km2 == 0 and None in got


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_columns_of_events(spark):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, *[exposure.promoted(lit(p), lit(a)) for p, a in (("Standard", "Red"), ("High", "Orange"), (None, "Orange"), ("Standard", "Green"), ("Review", None))]) == ("High", "High", "Medium", "Standard", "Review")
    assert one(spark, exposure.area_replaced(lit("From 1,200 ha to 15 813 hectares, 7 hay."), F.lit(12345.5)), exposure.area_replaced(lit(None), F.lit(1.0))) == ("From 12,346 ha to 12,346 ha, 7 hay.", "")
    assert one(spark, *[exposure.region_key(lit(r)) for r in (None, " ", " Chad ")]) == ("UNKNOWN", "UNKNOWN", "Chad")


def test_local_places_and_back(spark):
    rows = spark.createDataFrame([(10.0, 20.0), (-33.0, 179.5), (70.0, -10.0), (12.0, 21.0)], "lat double, lon double")
    x, y = tracks.local_xy(F.col("lat"), F.col("lon"), F.lit(12.0), F.lit(21.0))
    lat, lon = exposure.from_local(x, y, F.lit(12.0), F.lit(21.0))
    for r in rows.select("lat", "lon", lat.alias("a"), lon.alias("b")).collect():
        assert (r.a, r.b % 360) == (pytest.approx(r.lat, abs=1e-9), pytest.approx(r.lon % 360, abs=1e-9))


def test_areas_are_matched(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-30.0, -20.0), (40.0, -10.0), (10.0, 50.0))])
    df = spark.createDataFrame([(0.0, 0.0, 500.0), (60.0, 170.0, 90000.0)], "lat double, lon double, km2 double").withColumn("f", exposure.scaled_to(ring, F.col("lat"), F.col("lon"), F.col("km2")))

    def point(p):
        lat, lon = exposure.from_local(p["x"] * F.col("f"), p["y"] * F.col("f"), F.col("lat"), F.col("lon"))
        return F.struct(lon.alias("x"), lat.alias("y"))

    for r in df.select("km2", G.area_km2(F.array(F.transform(ring, point))).alias("a")).collect():
        assert r.a == pytest.approx(r.km2, rel=1e-6)
    cells = spark.createDataFrame([(1, float(k), 10.0, 35.0) for k in range(1, 9)] + [(2, 1.0, 10.0, 35.0)], "id long, km double, km2 double, target double")
    got = {r.id: r for r in exposure.matched_radius(cells, "id", "target").collect()}
    assert got[1].radius_km == pytest.approx(4.0, abs=1e-5) and got[1].area_km2 == 40.0 and got[2].radius_km is None


def test_the_refresh_gate(spark, tmp_path):
    day = lambda d: dt.date(2026, 9, d)
    rows = [(False, False, False, day(1), day(1), day(1), day(1)), (False, False, True, day(1), day(2), day(1), day(1)), (False, True, True, day(1), day(1), day(1), day(2)), (True, False, False, None, day(1), None, None), (False, False, False, day(1), day(1), day(1), None), (False, False, False, day(1), day(1), None, day(1))]
    df = spark.createDataFrame(rows, "forced boolean, event_changed boolean, content_changed boolean, previous_at date, current_at date, prior_cycle date, latest_cycle date")
    got = [(r.full_refresh, r.climate_refresh, r.maintenance_refresh, r.any_refresh, r.reason) for r in refresh.gate(df).collect()]
    assert got == [(False, False, False, False, "no_scientific_input_change"), (False, False, True, True, "source_metadata_churn_suppressed,new_utc_day"), (True, True, False, True, "source_semantics_changed"), (True, True, True, True, "manual_dispatch,new_utc_day"), (False, True, False, True, "ifs_cycle_changed_or_unverified"), (False, True, False, True, "ifs_cycle_changed_or_unverified")]
    refresh.outputs(refresh.gate(df).where("content_changed and not event_changed").select("any_refresh", "reason", "latest_cycle"), f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["any_refresh=true", "reason=source_metadata_churn_suppressed,new_utc_day", "latest_cycle=2026-09-01"]
    steps = spark.createDataFrame([(day(1), True), (day(3), False), (day(11), False), (day(12), False)], "day date, whole boolean")
    assert {r.day.day: r.cycle for r in refresh.latest_cycle(steps, "day", F.col("whole"), 10).collect()} == {1: day(1), 3: day(1), 11: day(1), 12: None}


def test_choices(spark):
    c = spark.createDataFrame([("a", 10, 1.0, 0.9), ("b", 9, 5.0, 0.8), ("c", 10, 6.0, 0.79), ("d", 8, 0.5, 0.95), ("e", 10, None, 0.9)], "k string, n long, area double, csi double")
    assert tracks.parsimonious(c, "k", "area", "csi").first().k == "d" and tracks.parsimonious(c, "k", "area", "csi", support="n").first().k == "a"
    now = dt.datetime(2026, 9, 10)
    rows = [("a", 50.0, "ready", "pass", now), ("b", 50.0, "ready", "pass", now), ("c", 90.0, "pending", "pass", now), ("d", 90.0, "ready", None, now), ("e", 90.0, "ready", "pass", dt.datetime(2026, 9, 1)), ("f", 5.0, "ready", "pass", now), ("g", 90.0, "ready", "pass", None)]
    e = spark.createDataFrame(rows, "id string, burned_area_ha double, footprint string, qc string, last_detection timestamp").withColumns({"type": F.lit("Wildfire"), "lat": F.lit(1.0), "lon": F.lit(1.0)})
    assert [r.id for r in experiments.prospective(e, F.lit(now), 10.0, 24.0, 5).collect()] == ["b", "a"]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {tuple(r) for r in experiments.universe_faults(ids("a", "b"), ids("b", "c", "c"), "id").collect()} == {("a", "missing"), ("c", "unlisted")} and experiments.universe_faults(ids("a"), ids("a"), "id").count() == 0


def test_merge_rules_of_a_proximity_group(spark):
    at = lambda d: dt.datetime(2026, 9, d)
    rows = [("g", 1, at(5), "short", 10.0, "s1", None), ("g", 2, at(5), "longer", None, None, "d2"), ("g", 3, at(5), "tie-up", 30.0, "s3", None), ("g", 4, at(4), "the longest one", 20.0, "s4", "d4"), ("h", 5, at(4), None, None, None, None), ("h", 6, at(3), "", None, "s6", "d6")]
    df = spark.createDataFrame(rows, "g string, id long, at timestamp, summary string, burned_area_ha double, event_start string, last_detection string")
    got = {r.g: tuple(r)[1:] for r in identity.proximity_merged(df, "g", "id", "at", ("event_start", "last_detection")).collect()}
    assert got == {"g": (4, "the longest one", 30.0, "s3", "d2"), "h": (2, None, None, None, None)}
    assert identity.proximity_merged(df.where("id < 4"), "g", "id", "at", ()).first().summary == "longer"


def test_source_first_metrics(spark):
    rows = [(1, 5.0, 7.0, 3), (2, None, 7.0, None), (3, None, None, 1), (4, 0.0, None, 2)]
    df = spark.createDataFrame(rows, "id long, told double, found double, episode long")
    got = {r.id: r for r in episodes.source_first(df, {"people": ("told", "found")}, "feed", "episode").collect()}
    assert {i: r.metrics for i, r in got.items()} == {1: {"people": 5.0}, 2: {"people": 7.0}, 3: {}, 4: {"people": 0.0}}
    assert tuple(got[1].provenance["people"]) == ("feed", "told", episodes.REPORTED, False, 3) and tuple(got[2].provenance["people"]) == ("footprint", "found", episodes.DERIVED, True, None) and got[3].provenance == {}


def test_headlines_take_their_own_episode(spark):
    facts = "burned_area_ha double, start_date string, last_detection string, duration_days long"
    events = spark.createDataFrame([(1, 1, 9.0, "a", None, None), (2, 2, 9.0, None, None, None), (3, 5, 9.0, None, None, None), (4, None, 9.0, None, None, None)], f"id long, headline long, {facts}")
    told = spark.createDataFrame([(i, e, 10.0 * e, None, "z", 4) for i in (1, 2, 3) for e in (1, 2)], f"id long, episode long, {facts}")
    got = {r.id: (r.burned_area_ha, r.start_date, r.last_detection, r.duration_days, r.note) for r in episodes.aligned(events, "id", told).collect()}
    assert got == {1: (10.0, "a", "z", 4, "newer_episode_pending"), 2: (20.0, None, "z", 4, "current"), 3: (9.0, None, None, None, "episode_unknown"), 4: (9.0, None, None, None, "no_episode")}


def test_texts_patch_both_views(spark):
    rows = [(1, "Drought", "Impact for agricultural drought in 1,412,468 km2", "Standard", None, "GDACS · Orange"), (2, "Flood", "impact of drought 5 km2", "High", "green", ""), (3, "Drought", None, None, None, None)]
    df = episodes.source_semantics(spark.createDataFrame(rows, "id long, type string, summary string, priority string, alert_level string, source string"))
    got = {r.id: r for r in df.collect()}
    assert got[1].metrics == {episodes.DROUGHT_KM2: 1412468.0} and (got[1].priority, got[1].alert_level) == ("Medium", "Orange") and got[1].provenance[episodes.DROUGHT_KM2].method == episodes.TOLD
    assert (got[2].metrics, got[2].priority, got[2].alert_level) == (None, "High", "Green") and (got[3].alert_level, got[3].priority) == (None, None)
    view = df.withColumns({"alert_level": F.lit(None).cast("string"), "metrics": F.lit(None).cast("map<string,double>")})
    both = {r.id: r for r in episodes.patched_views(df.where("id < 3"), view, "id").collect()}
    assert both[1].alert_level == "Orange" and both[1].metrics == got[1].metrics and len(both) == 3


def test_climate_documents(spark):
    events = spark.createDataFrame([(1, "Flood", 1.0, 2.0, 3, 4, 5.25), (2, "Flood", 1.0, 2.0, None, None, None), (3, "Heat", 1.0, 2.0, 3, 4, 0.0)], "id long, type string, lat double, lon double, row int, col int, km double")
    periods = spark.createDataFrame([(1, "b", "tmp", 2.5), (1, "b", "pre", None), (1, "a", "tmp", None), (2, "a", "tmp", 1.0)], "id long, period string, variable string, value double")
    got = {r.id: (r.status, json.loads(r.doc)) for r in episodes.climate_documents(events, "id", periods).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["partial", "unavailable", "partial"] and "periods" not in got[2][1] and "comparison_location" not in got[2][1] and got[3][1]["periods"] == []
    assert got[1][1]["periods"] == [{"period": "a", "status": "unavailable"}, {"period": "b", "status": "ready", "values": {"tmp": 2.5}}]


def test_small_maps_grids_and_listings(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b"), ("g", None), ("h", None)], "g string, c string")
    assert {r.g: (r.n, r.counts) for r in episodes.frequencies(df, "g", "c").collect()} == {"g": (3, {"a": 1, "b": 2})}
    grid = episodes.config_grid(spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "a string, b int"), ["a", "b"]).collect()
    assert {(r.config, r.n) for r in grid} == {("x_1", 2), ("x_2", 0), ("y_1", 0), ("y_2", 1)}
    names = spark.createDataFrame([("l", "long_pop.tif"), ("l", "a.tif"), ("l", "POP.tif"), ("m", "bb"), ("m", "ba")], "l string, n string")
    assert {r.l: r.n for r in episodes.best_file(names, "l", "n", "pop").collect()} == {"l": "POP.tif", "m": "ba"}
    cells = spark.createDataFrame([(-1, 0, 5), (0, 0, 1), (1, 1, 2), (2, 3, 4)], "row long, col long, people long")
    assert {(r.row, r.col): r.people for r in episodes.coarser(cells, 2, "people").collect()} == {(-1, 0): 5, (0, 0): 3, (1, 1): 4}
