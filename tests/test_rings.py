import math
import random

import pytest
from pyspark.sql import functions as F

from stormledger.functions import geometry as G
from stormledger.operators import overlay, rings

RINGS = "id long, rings array<array<struct<x double, y double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def area(points):
    return sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(points, points[1:] + points[:1])) / 2


def parts(spark, *polygons):
    df = spark.createDataFrame(list(enumerate(polygons)), RINGS)
    out = {}
    for r in rings.repaired(df, "id").orderBy("id", "part").collect():
        out.setdefault(r.id, []).append([[p.asDict() for p in x] for x in r.rings])
    return out


SHAPES = {
    "bow-tie": ([ring((0, 0), (4, 4), (4, 0), (0, 4))], [4, 4]),
    "valid": ([ring((0, 0), (4, 0), (4, 4), (0, 4))], [16]),
    "clockwise": ([ring((0, 0), (0, 4), (4, 4), (4, 0), (0, 0))], [16]),
    "hole": ([ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((1, 1), (2, 1), (2, 2), (1, 2))], [80]),
    "overlap": ([ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((2, 2), (6, 2), (6, 6), (2, 6))], [12, 12]),
    "spike": ([ring((0, 0), (4, 0), (4, 4), (8, 4), (4, 4), (0, 4))], [16]),
    "shared side": ([ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((4, 1), (6, 1), (6, 3), (4, 3))], [20]),
    "touching hole": ([ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((0, 2), (2, 1), (2, 3))], [14]),
    "island": ([ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((1, 1), (8, 1), (8, 8), (1, 8)), ring((3, 3), (5, 3), (5, 5), (3, 5))], [32, 4]),
    "line": ([ring((0, 0), (4, 4), (2, 2))], []),
    "twice": ([ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((0, 0), (4, 0), (4, 4), (0, 4))], []),
    "star": ([ring(*[(math.cos(math.pi / 2 + 4 * math.pi * k / 5), math.sin(math.pi / 2 + 4 * math.pi * k / 5)) for k in range(5)])], None),
}


def test_repair_by_even_and_odd(spark):
    got = parts(spark, *[s for s, _ in SHAPES.values()], None)
    for i, (name, (shape, want)) in enumerate(SHAPES.items()):
        found = got.get(i, [])
        areas = sorted((round(sum(area(r) for r in p), 9) for p in found), reverse=True)
        if want is None:  # the five points of a star, its middle is outside
            assert len(areas) == 5 and max(areas) - min(areas) < 1e-9 and all(len(p[0]) == 3 for p in found), name
        else:
            assert areas == [pytest.approx(w) for w in want], name
        assert all(area(p[0]) > 0 and all(area(h) < 0 for h in p[1:]) for p in found), name
    assert [len(p) for p in got[3]] == [2] and sorted(len(p) for p in got[8]) == [1, 2] and len(got) == len(SHAPES) - 2


def test_repair_of_random_lines_keeps_what_is_inside(spark):
    rng = random.Random(5)
    shapes = [[ring(*[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randrange(3, 14))])] for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(shapes)), RINGS)
    want = {r.id: r.area for r in overlay.union_area(df, "id", sphere=False, tile=16.0).collect()}
    got = {i: sum(area(r) for p in ps for r in p) for i, ps in parts(spark, *shapes).items()}
    assert got == {i: pytest.approx(a) for i, a in want.items()}


def plain(points, tol):
    """Points kept by halving a line at its farthest point (recursion)."""

    def off(p, a, b):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = max(0, min(1, ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)

    def keep(low, high):
        best = max(((off(points[k], points[low], points[high]), -k) for k in range(low + 1, high)), default=(0, 0))
        return keep(low, -best[1]) | keep(-best[1], high) if best[0] > tol else {low, high}

    return [points[k] for k in sorted(keep(0, len(points) - 1))]


def test_simplified_rings(spark):
    rng = random.Random(8)
    around = lambda n, rough: ring(*[((10 + rng.uniform(-rough, rough)) * math.cos(2 * math.pi * k / n), (10 + rng.uniform(-rough, rough)) * math.sin(2 * math.pi * k / n)) for k in range(n)])
    shapes = [[around(300, 0.03), around(50, 0.0)], [(r := around(200, 0.0)) + r[:1]], [around(40, 2.0)], [ring((0, 0), (1e-5, 0), (1e-5, 1e-5))], [ring((0, 0), (50, 0), (50, 1e-3), (25, 2e-3))], [ring((1, 1))], None]
    df = spark.createDataFrame(list(enumerate(shapes)), RINGS)
    got = {r.id: (r.tolerance, [[p.asDict() for p in x] for x in r.rings]) for r in rings.simplified(df, "id").collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5] and got[0][0] == pytest.approx(20.06 / 600, rel=0.01) and got[3][0] == 0.0002 and got[4][0] == 0.05
    for i in (0, 1, 2):
        for old, new in zip(shapes[i], got[i][1]):
            closed = old if old[0] == old[-1] else old + old[:1]
            want = plain(closed, got[i][0])
            assert new == (want if old[0] == old[-1] else want[:-1])
            assert new[0] == old[0] and (new[-1] == old[0]) == (old[0] == old[-1])
    assert len(got[0][1][0]) < 150 and [got[i][1] for i in (3, 4, 5)] == [shapes[i] for i in (3, 4, 5)]  # too small to lose a point
    assert rings.simplified(df.where("false"), "id").collect() == []


def test_lines_that_cross_themselves(spark):
    lines = [(ring((0, 0), (4, 4), (4, 0), (0, 4), (0, 0)), True), (ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), False), (ring((0, 0), (1, 0), (0, 1), (0, 0)), False), (ring((0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)), True)]
    df = spark.createDataFrame([(x,) for x, _ in lines], "p array<struct<x double, y double>>")
    assert [r[0] for r in df.select(rings.crosses_itself(F.col("p"))).collect()] == [w for _, w in lines]
    assert df.select(G.planar_area(F.array("p"))).count() == 4
