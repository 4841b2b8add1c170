import math
import random

import pytest
from pyspark.sql import functions as F

from stormledger.functions import geometry as G
from stormledger.operators import overlay

RINGS = "rings array<array<struct<x double, y double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x0, y0, x1, y1, turned=False):
    r = ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    return r[::-1] if turned else r


def area(spark, *polygons, group=None, tile=1.0):
    df = spark.createDataFrame([("g", list(p)) for p in polygons], f"g string, {RINGS}")
    got = overlay.union_area(df, "g", sphere=False, tile=tile).collect()
    return got[0].area if got else None


def test_unions_by_inclusion_and_exclusion(spark):
    a, b = [box(0, 0, 4, 4)], [box(3, 3, 5, 5)]
    assert area(spark, a, b) == pytest.approx(16 + 4 - 1)
    assert area(spark, a, a, a) == pytest.approx(16)
    hole = [box(0, 0, 4, 4), box(1, 1, 3, 3)]
    assert area(spark, hole) == pytest.approx(12) and area(spark, [box(0, 0, 4, 4), box(1, 1, 3, 3, True)]) == pytest.approx(12)
    assert area(spark, hole, [box(2, 0.5, 3.5, 2.5)]) == pytest.approx(12 + 1 * 1.5)
    assert area(spark, [box(-0.5, -0.5, 0.5, 0.5)], [box(10.25, 7, 30.75, 9)]) == pytest.approx(1 + 41)
    assert area(spark, [ring((0, 0), (4, 0), (2, 3))], [ring((0, 2), (4, 2), (2, -1))]) == pytest.approx(6 + 6 - 4)
    assert area(spark, [ring((0, 0), (1, 0), (2, 0))]) is None


def grid_area(polygons, n, size):
    """Share of fine points covered (every point at the middle of a small square)."""

    def inside(rings, x, y):
        odd = False
        for r in rings:
            for p, q in zip(r, r[1:] + r[:1]):
                if (p["y"] > y) != (q["y"] > y) and x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]:
                    odd = not odd
        return odd

    step = size / n
    return sum(any(inside(p, (i + 0.5) * step, (j + 0.5) * step) for p in polygons) for i in range(n) for j in range(n)) * step * step


@pytest.mark.parametrize("most", [3, 192])
def test_unions_of_random_triangles(spark, monkeypatch, most):
    monkeypatch.setattr(overlay, "MOST", most)
    monkeypatch.setattr(overlay, "DEEPEST", 3)
    rng = random.Random(2)
    polygons = [[ring(*[(rng.uniform(0.2, 3.8), rng.uniform(0.2, 3.8)) for _ in range(3)])] for _ in range(7)]
    polygons.append([ring((1, 1), (3, 3), (3, 1), (1, 3))])  # a bow-tie counts by even and odd
    assert area(spark, *polygons) == pytest.approx(grid_area(polygons, 160, 4), rel=0.01)
    assert area(spark, *polygons, tile=0.7) == pytest.approx(area(spark, *polygons, tile=64.0), rel=1e-12)


def test_a_union_on_the_sphere_is_the_area_of_one_alone(spark):
    p = [ring((10, 50), (13, 50.5), (12, 53), (9.5, 52)), ring((11, 51), (11.5, 51), (11.5, 51.5))]
    df = spark.createDataFrame([("g", p)], f"g string, {RINGS}")
    assert overlay.union_area(df, "g").first().area == pytest.approx(df.select(G.area_km2(F.col("rings"))).first()[0], rel=1e-12)


def test_shared_areas_add_up_to_the_whole(spark):
    feet = spark.createDataFrame([(1, [box(1, 1, 5, 3)]), (1, [box(2, 2, 6, 4)]), (2, [box(40, 40, 41, 41)]), (3, None)], f"f long, {RINGS}")
    lands = spark.createDataFrame([("A", [box(-20, -20, 3, 20)]), ("B", [box(3, -20, 30, 20), box(4, 0, 4.5, 10)]), ("C", [box(4, 0, 4.5, 10)])], f"c string, {RINGS}")
    got = {(r.f, r.c): r.area for r in overlay.shared_areas(feet, lands, "f", "c", sphere=False, tile=1.0).collect()}
    assert got == {(1, "A"): pytest.approx(5), (1, "B"): pytest.approx(8 - 1.5), (1, "C"): pytest.approx(1.5)}


def test_holes_whichever_way_they_turn(spark):
    for turned in (False, True):
        rows = [([box(0, 0, 10, 10), box(1, 1, 3, 3, turned)],), ([box(1, 1, 3, 3, turned), box(0, 0, 10, 10), box(1.5, 1.5, 2, 2), box(20, 0, 21, 1)],)]
        df = spark.createDataFrame(rows, RINGS)
        assert [r[0] for r in df.select(G.planar_area(F.col("rings"))).collect()] == [96.0, 97.25]
    assert spark.createDataFrame([(None,)], RINGS).select(G.planar_area(F.col("rings")), G.area_km2(F.col("rings"))).first() == (None, None)


def test_distances_to_the_truly_nearest_point(spark):
    at = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    df = spark.createDataFrame([([box(1.5, 55, 3, 65)],), ([ring((0, 61), (0.5, 61), (0.25, 62))],), ([box(-180, 0, -179, 1)],)], RINGS)
    r = F.col("rings")
    assert df.select(G.distance_km(r, *at(0, 60))).first()[0] == pytest.approx(83.4, abs=0.1)
    both = spark.createDataFrame([([box(1.5, 55, 3, 65), ring((0, 61), (0.5, 61), (0.25, 62))],)], RINGS)
    assert both.select(G.distance_km(r, *at(0, 60))).first()[0] == pytest.approx(83.4, abs=0.1)
    assert df.select(G.distance_km(r, *at(179.9, 0.5))).collect()[2][0] == pytest.approx(math.radians(0.1) * 6371, rel=1e-3)


@pytest.mark.parametrize("most", [24, 192])
def test_tiles_that_one_polygon_covers_are_as_much_as_their_slabs(spark, monkeypatch, most):
    monkeypatch.setattr(overlay, "MOST", most)
    monkeypatch.setattr(overlay, "DEEPEST", 3)
    rng = random.Random(5)
    at = lambda: (rng.randrange(0, 24) / 4, rng.randrange(0, 24) / 4)
    polygons = []
    for k in range(30):  # boxes on the tiles' borders, some with a hole; slanted ones; far apart from all a box alone
        (x, y), w, h = at(), rng.randrange(2, 9) / 4, rng.randrange(2, 9) / 4
        polygons.append([box(x, y, x + w, y + h)] + ([box(x + 0.25, y + 0.25, x + w - 0.25, y + h - 0.25)] if k % 3 == 0 and min(w, h) > 0.5 else []))
        polygons.append([ring((x + 0.1, y), (x + w, y + h / 3), (x + w / 2, y + h), (x - 0.2, y + h / 2))])
    polygons.append([box(40, 40, 45.5, 43)])
    df = spark.createDataFrame([(k % 2, k, p) for k, p in enumerate(polygons)], f"group int, member int, {RINGS}").withColumn("layer", F.lit(0)).withColumn("window", F.lit(None).cast(overlay.BOX))
    areas = lambda union: {r.group: r.area for r in overlay.measured(df, F.col("depth0") > 0, sphere=False, tile=1.0, union=union).collect()}
    whole, slabs = areas(True), areas(False)
    assert whole.keys() == slabs.keys() == {0, 1} and all(whole[g] == pytest.approx(slabs[g], rel=1e-12) for g in whole)


def test_sides_inside_a_deep_union_are_not_dealt(spark):
    rng = random.Random(6)
    polygons = [[ring(*[(x + 1.5 * math.cos(a), y + 1.5 * math.sin(a)) for a in (0.1, 1.4, 2.6, 3.9, 5.2)])] for x, y in ((rng.uniform(0, 6), rng.uniform(0, 6)) for _ in range(150))]
    df = spark.createDataFrame([("g", k, p) for k, p in enumerate(polygons)], f"group string, member int, {RINGS}").withColumn("layer", F.lit(0)).withColumn("window", F.lit(None).cast(overlay.BOX))
    every = overlay.sided(df, False)  # each side is in a tile or more
    left, done = overlay.dealt(overlay.sided(df, False, True), 1.0, overlay.covered_parts(df, False, 1.0))
    assert left.count() < 3 * every.count() and done.first().area > 36
    rows = left.select("level", "tx", "ty").collect()
    assert not any(1 < (r.tx + 0.5) / 2**r.level < 5 and 1 < (r.ty + 0.5) / 2**r.level < 5 for r in rows)


def test_sides_are_not_dealt_to_where_their_polygon_has_none(spark):
    notched = [[ring((0, 0), (8, 0), (8, 1), (1, 1), (1, 7), (8, 7), (8, 8), (0, 8))]]
    df = spark.createDataFrame([("g", k, p) for k, p in enumerate(notched)], f"group string, member int, {RINGS}").withColumn("layer", F.lit(0)).withColumn("window", F.lit(None).cast(overlay.BOX))
    left, _ = overlay.dealt(overlay.sided(df, False, True), 1.0, overlay.covered_parts(df, False, 1.0))
    assert not [r for r in left.collect() if 2 <= r.tx / 2**r.level < 8 and 2 <= r.ty / 2**r.level < 6]
    assert overlay.measured(df, F.col("depth0") > 0, sphere=False, tile=1.0, union=True).first().area == pytest.approx(64 - 42)
