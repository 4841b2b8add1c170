"""Simplification and repair of polygons as joins over their points and sides, so that no ring is one task's loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormledger.functions import geometry as G
from stormledger.operators.components import checkpointed

#: Of a display tolerance: the part of the span, and its bounds in degrees (fixed values).
SPAN_PART, FINEST, COARSEST = 600.0, 0.0002, 0.05
#: Bands of heights that a polygon's sides are dealt to before pairs of them are tried.
BANDS = 32


def tolerance(rings: Column) -> Column:
    """How far a simplified outline may be from its polygon's, by the greater side of its box."""
    b = G.box(rings)
    return F.least(F.lit(COARSEST), F.greatest(F.lit(FINEST), F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"]) / SPAN_PART))


def away(p: Column, a: Column, b: Column) -> Column:
    """Distance in the plane of a point from a line between two others."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / square))).otherwise(0.0)
    return F.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)


def simplified(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """key, tolerance and rings of polygons with the points left out that are within the tolerance of the line that remains.

    Each ring is halved at its point farthest from the line between its ends, as long as that is beyond the tolerance: a round
    halves all parts of all rings, so there are as many rounds as the deepest halving. First and last points stay (a ring that is not
    closed counts as closed). A ring that would keep fewer than three places, or cross itself, stays as it is. key tells rows apart.
    """
    rows = polygons.where(F.col(rings).isNotNull()).withColumn("tol", tolerance(F.col(rings))).select(F.col(key).alias("key"), "tol", F.posexplode(rings).alias("ring", "points"))
    first, last = F.get("points", F.lit(0)), F.element_at("points", -1)
    closed = F.when(first == last, F.col("points")).otherwise(F.array_append("points", first))
    points = checkpointed(rows.where(F.size("points") > 0).select("key", "tol", "ring", F.size(closed).alias("n"), F.posexplode(closed).alias("k", "p")))
    place = points.select("key", "ring", "k", "p")
    parts = points.where("k > 0 and k < n - 1").select("key", "ring", "tol", "k", "p", F.lit(0).alias("low"), (F.col("n") - 1).alias("high"))
    kept = points.where("k = 0 or k = n - 1").select("key", "ring", "k")
    while True:
        for c in ("low", "high"):
            parts = parts.join(place.select("key", "ring", F.col("k").alias(c), F.col("p").alias(f"{c}_p")), ["key", "ring", c])
        parts = checkpointed(parts.withColumn("off", away(F.col("p"), F.col("low_p"), F.col("high_p"))).drop("low_p", "high_p"))
        top = parts.groupBy("key", "ring", "low", "high").agg(F.max(F.struct("off", F.negative("k").alias("k"))).alias("top"), F.first("tol").alias("tol"))
        cut = checkpointed(top.where(F.col("top.off") > F.col("tol")).select("key", "ring", "low", "high", F.negative("top.k").alias("at")))
        if cut.isEmpty():
            break
        kept = kept.unionByName(cut.select("key", "ring", F.col("at").alias("k")))
        left = parts.join(cut, ["key", "ring", "low", "high"]).where("k <> at")
        parts = left.select("key", "ring", "tol", "k", "p", F.when(F.col("k") < F.col("at"), F.col("low")).otherwise(F.col("at")).alias("low"), F.when(F.col("k") < F.col("at"), F.col("at")).otherwise(F.col("high")).alias("high"))
    line = kept.join(place, ["key", "ring", "k"]).groupBy("key", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("line"))
    both = rows.join(line, ["key", "ring"])
    open_ = F.slice("line", 1, F.size("line") - 1)  # without the point that closes it
    good = (F.size(F.array_distinct(open_)) >= 3) & ~crosses_itself(F.col("line"))
    new = both.select("key", "tol", "ring", F.when(~good, F.col("points")).when(first == last, F.col("line")).otherwise(open_).alias("points"))
    whole = new.groupBy("key").agg(F.first("tol").alias("tolerance"), F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda x: x["points"]).alias("rings"))
    return whole.withColumnRenamed("key", key)


def crosses_itself(line: Column) -> Column:
    """Whether two sides of a closed line that are not neighbours meet."""
    side = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.struct(i.alias("i"), F.element_at(line, i).alias("a"), F.element_at(line, i + 1).alias("b")))
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))
    meets = lambda s, t: (turn(s["a"], s["b"], t["a"]) * turn(s["a"], s["b"], t["b"]) <= 0) & (turn(t["a"], t["b"], s["a"]) * turn(t["a"], t["b"], s["b"]) <= 0)
    apart = lambda s, t: (t["i"] > s["i"] + 1) & ~((s["i"] == 1) & (t["i"] == F.size(line) - 1))
    return (F.size(line) > 4) & F.exists(side, lambda s: F.exists(side, lambda t: apart(s, t) & meets(s, t)))


def repaired(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """key, part and rings (the outer one first, then its holes) of valid polygons that cover what the even-odd rule says is inside.

    Sides are split where they cross or touch; pieces that lie on each other cancel in pairs. A piece has the inside on its left, and at
    its end goes on with the piece that turns most to the left: the rings close by doubling the steps along them. Outer rings are
    anticlockwise, holes clockwise, in the smallest outer ring around them. What has no area has no part. key tells rows apart.
    """
    rows = checkpointed(polygons.where(F.col(rings).isNotNull()).select(F.col(key).alias("key"), F.col(rings).alias("rings"), F.posexplode(G.sides(F.col(rings))).alias("k", "s")))
    sides = rows.where("s.a <> s.b").select("key", "k", F.col("s.a").alias("a"), F.col("s.b").alias("b"), G.box(F.col("rings")).alias("box"))
    cuts = sides.select("key", "k", F.explode(F.array("a", "b")).alias("p")).unionByName(crossings(sides)).distinct()
    # the pieces of a side, from one cut to the next along it
    ahead = (F.col("p.x") - F.col("a.x")) * (F.col("b.x") - F.col("a.x")) + (F.col("p.y") - F.col("a.y")) * (F.col("b.y") - F.col("a.y"))
    along = cuts.join(sides, ["key", "k"]).withColumn("t", ahead)
    pieces = along.withColumn("q", F.lead("p").over(Window.partitionBy("key", "k").orderBy("t"))).where("q is not null and p <> q")
    pieces = pieces.groupBy("key", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.count("*").alias("n"), F.first("box").alias("box")).where("n % 2 = 1")
    whole = rows.where("k = 0").select("key", "rings")
    size = F.greatest(F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0"))
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    # a point just beside the middle, to the left
    step = F.least(1e-7 * size, 1e-3 * F.hypot(dx, dy)) / F.hypot(dx, dy)
    left_in = G.covers(F.col("rings"), (F.col("p.x") + F.col("q.x")) / 2 - dy * step, (F.col("p.y") + F.col("q.y")) / 2 + dx * step)
    turned = pieces.join(whole, "key").withColumn("in", left_in)
    turned = turned.select("key", F.when(F.col("in"), F.col("p")).otherwise(F.col("q")).alias("p"), F.when(F.col("in"), F.col("q")).otherwise(F.col("p")).alias("q"))
    turned = checkpointed(turned.withColumn("e", F.monotonically_increasing_id()))
    back = F.atan2(F.col("p.y") - F.col("q.y"), F.col("p.x") - F.col("q.x"))
    onward = turned.select("key", F.col("p").alias("q"), F.col("e").alias("next"), F.atan2(F.col("q.y") - F.col("p.y"), F.col("q.x") - F.col("p.x")).alias("out"))
    turn = F.pmod(back - F.col("out"), F.lit(2 * 3.141592653589793))
    # clockwise from the way back: the first way on is the one most to the left
    linked = turned.join(onward, ["key", "q"]).groupBy("e").agg(F.min_by("next", F.when(turn < 1e-12, 7.0).otherwise(turn)).alias("next"))
    found = turned.join(closed_rings(checkpointed(linked)), "e").groupBy("key", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("points"))
    signed = G.total(F.transform(G.edges(F.col("points")), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2
    found = checkpointed(found.withColumn("area", signed).where("area <> 0"))
    outer, holes = found.where("area > 0"), found.where("area < 0")
    a, b = F.col("points")[0], F.col("points")[1]
    # a point of the hole's inside edge lies in the outer ring around it
    inside = holes.select("key", F.col("ring").alias("hole"), F.col("points").alias("hole_points"), F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")).alias("c"))
    around = inside.join(outer, "key").where(G.covers(F.array("points"), F.col("c.x"), F.col("c.y"))).groupBy("key", "hole").agg(F.min_by("ring", "area").alias("ring"), F.first("hole_points").alias("points"))
    of = around.groupBy("key", "ring").agg(F.array_sort(F.collect_list("points")).alias("holes"))
    parts = outer.join(of, ["key", "ring"], "left").select("key", F.concat(F.array("points"), F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>"))).alias("rings"), "area", "points")
    number = F.row_number().over(Window.partitionBy("key").orderBy("points")) - 1
    return parts.select(F.col("key").alias(key), number.alias("part"), "rings")


def crossings(sides: DataFrame) -> DataFrame:
    """(key, k, p) of the points that sides (key, k, a, b, box) share with others of their polygon: where they cross, or where one's end is on the other."""
    height = F.greatest(F.lit(1e-300), F.col("box.y1") - F.col("box.y0"))
    band = lambda y: F.floor((y - F.col("box.y0")) / height * BANDS)
    dealt = sides.withColumn("band", F.explode(F.sequence(band(F.least("a.y", "b.y")), band(F.greatest("a.y", "b.y"))))).drop("box")
    s, t = (dealt.select("key", "band", *[F.col(c).alias(f"{n}{c}") for c in ("k", "a", "b")]) for n in "st")
    overlap = [F.greatest(f"{n}a.{c}", f"{n}b.{c}") >= F.least(f"{m}a.{c}", f"{m}b.{c}") for c in "xy" for n, m in ("st", "ts")]
    pairs = s.join(t, ["key", "band"]).where((F.col("sk") < F.col("tk")) & overlap[0] & overlap[1] & overlap[2] & overlap[3]).drop("band").distinct()
    v = lambda p, q: (F.col(f"{q}.x") - F.col(f"{p}.x"), F.col(f"{q}.y") - F.col(f"{p}.y"))
    cross = lambda m, n: m[0] * n[1] - m[1] * n[0]
    u, w, d = v("sa", "sb"), v("ta", "tb"), v("sa", "ta")
    rate = lambda x: F.try_divide(x, cross(u, w))
    i, j = rate(cross(d, w)), rate(cross(d, u))
    point = F.struct((F.col("sa.x") + i * u[0]).alias("x"), (F.col("sa.y") + i * u[1]).alias("y"))
    # an end that is on the other side is the point itself, so that it has one place
    on = lambda p, a, b: (cross(v(a, b), v(a, p)) == 0) & (F.col(f"{p}.x").between(F.least(f"{a}.x", f"{b}.x"), F.greatest(f"{a}.x", f"{b}.x"))) & (F.col(f"{p}.y").between(F.least(f"{a}.y", f"{b}.y"), F.greatest(f"{a}.y", f"{b}.y")))
    ends = F.filter(F.array(*[F.when(on(p, *o), F.col(p)) for p, o in (("sa", ("ta", "tb")), ("sb", ("ta", "tb")), ("ta", ("sa", "sb")), ("tb", ("sa", "sb")))]), lambda x: x.isNotNull())
    met = F.when(F.size(ends) > 0, ends).when((i > 0) & (i < 1) & (j > 0) & (j < 1), F.array(point))
    met = pairs.select("key", F.array("sk", "tk").alias("ks"), F.explode(met).alias("p"))
    return met.select("key", F.explode("ks").alias("k"), "p")


def closed_rings(linked: DataFrame) -> DataFrame:
    """e, ring (the least e of its ring) and at (its place from there) of pieces that lead (e, next) round closed rings; steps double each round."""
    jump = linked.select("e", "next", F.col("e").alias("ring"))
    while True:  # the least e among ever more steps ahead
        there = jump.select(F.col("e").alias("next"), F.col("next").alias("after"), F.col("ring").alias("least"))
        new = checkpointed(jump.join(there, "next").select("e", F.col("after").alias("next"), F.least("ring", "least").alias("ring"), (F.col("least") < F.col("ring")).alias("less")))
        done = new.where("less").isEmpty()
        jump = new.drop("less")
        if done:
            break
    heads = jump.select("e", "ring")
    # steps to the piece that leads to the ring's head, which ends the line
    line = linked.join(heads, "e").select("e", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.when(F.col("next") != F.col("ring"), 1).otherwise(0).cast("long").alias("left"))
    while True:
        there = line.select(F.col("e").alias("next"), F.col("next").alias("after"), F.col("left").alias("more"))
        line = checkpointed(line.join(there, "next", "left").select("e", "ring", F.col("after").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
        if line.where("next is not null").isEmpty():
            return line.select("e", "ring", F.negative("left").alias("at"))
