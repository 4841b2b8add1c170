import datetime as dt
import hashlib
import itertools
import math
import random

import pytest

from stormledger.operators import clusters, tracks

AT = dt.datetime(2026, 9, 1)


def km(a, b):
    (p, x), (q, y) = ((math.radians(v[0]), math.radians(v[1])) for v in (a, b))
    return 2 * 6371 * math.asin(min(1, math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2)))


def one_at_a_time(points, most, tie):
    groups = [[i] for i in sorted(points)]
    while True:
        best = None
        for i, j in itertools.combinations(range(len(groups)), 2):
            d = max(km(points[a], points[b]) for a in groups[i] for b in groups[j])
            if d <= most + 1e-9:
                name = "|".join(map(str, sorted((min(groups[i]), min(groups[j])))))
                rank = (round(d, 9), hashlib.sha256(name.encode()).hexdigest() if tie == "hash" else name)
                if best is None or rank < best[0]:
                    best = (rank, i, j)
        if best is None:
            return {i: min(g) for g in groups for i in g}
        _, i, j = best
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]


@pytest.mark.parametrize("tie, most", [("hash", 500.0), ("id", 800.0)])
def test_blocks_are_those_of_joining_one_pair_at_a_time(spark, tie, most):
    rng = random.Random(9)
    points = {i: (rng.uniform(-10, 10), rng.choice([178.0, -178.0]) + rng.uniform(-2, 2)) for i in range(60)} | {100: (1.0, 179.0), 101: (1.0, 179.0), 102: (88.0, 10.0), 103: (88.5, -170.0)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()] + [(200, None, 1.0)], "id long, lat double, lon double")
    got = {r.id: r.block for r in clusters.complete_link(df, "id", most, tie=tie).collect()}
    assert got == one_at_a_time(points, most, tie) | {200: 200}
    assert len(set(got.values())) < 40


def test_rounds_of_joins_leave_planning_as_short_as_it_is(spark, monkeypatch):
    lon = list(itertools.accumulate([2.0 * 0.85**k for k in range(15)], initial=0.0))  # each point is nearest to the next: a round a point
    points = {i: (0.0, x) for i, x in enumerate(lon)} | {50: (20.0, 0.0)}
    digits, isempty = [], type(spark.range(1)).isEmpty
    size = lambda df: len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    monkeypatch.setattr(type(spark.range(1)), "isEmpty", lambda df: digits.append(size(df)) or digits[-1] > 200 or isempty(df))
    got = {r.id: r.block for r in clusters.complete_link(spark.createDataFrame([(i, *p) for i, p in points.items()], "id long, lat double, lon double"), "id", 1500.0).collect()}
    assert got == one_at_a_time(points, 1500.0, "hash")
    assert len(digits) > 12 and max(digits) < 200


def test_keys_keep_blocks_apart(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 0.0, 0.1, "b"), (3, 0.0, 0.2, "a")], "id long, lat double, lon double, kind string")
    assert {r.id: r.block for r in clusters.complete_link(df, "id", 500.0, df["kind"]).collect()} == {1: 1, 2: 2, 3: 1}
    assert clusters.complete_link(df.where("false"), "id", 500.0).collect() == []


def test_holdout_takes_the_sum_nearest_to_a_third(spark):
    sizes = {"a": 7, "b": 5, "c": 3, "d": 3, "e": 2, "f": 1}
    df = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)] + [(None,)], "region string")
    got = clusters.holdout(df, "region").collect()
    every = [c for n in range(2, 5) for c in itertools.combinations(sorted(sizes), n) if 0 < sum(sizes[x] for x in c) < 21]
    best = min((abs(sum(sizes[x] for x in c) - 7), len(c)) for c in every)
    names = [r.region for r in got]
    assert (abs(sum(sizes[x] for x in names) - 7), len(names)) == best and {r.events for r in got} == {sum(sizes[x] for x in names)}
    assert clusters.holdout(df.where("region = 'a'"), "region").collect() == []


def test_the_strongest_embargo_that_leaves_enough(spark):
    schema = "id long, lat double, lon double, ts timestamp"
    hour = lambda h: AT + dt.timedelta(hours=h)
    train = [(1, 0.0, 0.5, hour(1)), (2, 0.0, 3.0, hour(30)), (3, 0.0, 4.0, hour(60)), (4, 0.0, 4.0, hour(80)), (5, 50.0, 0.0, hour(0)), (6, None, None, hour(0)), (7, 0.0, 2.0, hour(40))]
    df, held = spark.createDataFrame(train, schema), spark.createDataFrame([(9, 0.0, 0.0, AT), (9, None, 0.0, AT)], schema)
    left = lambda enough: sorted((r.id, r.rung) for r in clusters.relaxed_embargo(df, held, enough=enough).collect())
    assert left(3) == [(4, 0), (5, 0), (6, 0)]
    assert left(4) == [(3, 1), (4, 1), (5, 1), (6, 1)]
    assert left(5) == [(i, 2) for i in (2, 3, 4, 5, 6, 7)] and left(7) == [(i, 3) for i in range(1, 8)] == left(99)
    assert clusters.relaxed_embargo(df.where("false"), held).count() == 0


def test_rings_widen_across_the_date_line_and_near_the_pole(spark):
    rng = random.Random(1)
    step, south, west = 0.5, -89.75, -179.75
    valid = {(r, c) for r in range(360) for c in range(720) if rng.random() < 0.004 or (r > 355 and c % 97 == 3)}
    grid = spark.createDataFrame([(r, c, south + r * step, west + c * step) for r, c in valid], "row int, col int, lat_c double, lon_c double")
    points = {1: (0.1, 179.9), 2: (0.1, -179.9), 3: (89.0, 20.0), 4: (45.0, 0.0), 5: (-60.2, 179.99), 6: (10.0, -30.0), 7: (-89.9, 0.0)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()] + [(8, None, 1.0)], "id long, lat double, lon double")
    got = {r.id: (r.row, r.col, r.km, r.ring) for r in tracks.ring_cells(df, "id", grid, step, south, west).collect()}
    for i, (lat, lon) in points.items():
        y, x = math.floor((lat - south) / step + 0.5), math.floor((lon - west) / step + 0.5)
        best = None
        for ring in range(13):
            here = [(round(km((lat, lon), (south + r * step, west + c * step)), 6), r, c) for r, c in valid if max(abs(r - y), min((c - x) % 720, (x - c) % 720)) == ring]
            best = min(here + ([best] if best else []), default=None)
            if best and (best[0] <= 500 or not ring):
                break
        want = (best[1], best[2], best[0], ring) if best and (best[0] <= 500 or not ring) else (None,) * 4
        assert got[i] == (want[0], want[1], pytest.approx(want[2]), want[3]) if want[0] is not None else got[i] == want
    assert got[8] == (None,) * 4 and any(v[3] and v[3] > 2 for v in got.values())
