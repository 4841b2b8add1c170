"""Areas of unions and intersections of polygons, exactly, by slabs.

Polygons are dealt to tiles. In a tile, the heights of all corners, of all crossings of two sides and of those with the
tile's upright edges cut it into slabs in which no two sides cross, so what is covered of a slab is its height times
what is covered at half of it, and that is a running count over the sides there in order. A tile with more than MOST sides
is quartered, round by round, so that its pairs of sides follow the density of one place; equal polygons of a group count once.
Of a union, a tile that one polygon covers whole is done with: first parts of the first tiles, found polygon by polygon, before any
side is dealt, then the quarters of each round. So where polygons lie many deep only the tiles at the union's edge are cut into slabs.

Rings are even-odd, in any direction and order. Areas are on the sphere of the ellipsoid's area, sides being straight in
longitude and the sine of the latitude as in functions.geometry.area_km2; with sphere=False they are those of the plane.
Null polygons and ones of no area cover nothing, and a group of such alone has no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormledger.functions import geometry as G
from stormledger.operators.components import checkpointed, spread

#: Sides of a tile beyond which it is quartered, how often at most, and the width of the first tiles (radians, or the unit of the plane).
MOST, DEEPEST, TILE = 192, 12, 0.0175
#: The same for unions' tiles quartered less than SHALLOW times, as quarters may be covered whole; how often the first tiles are quartered for parts that one polygon covers; so many rows of tiles are broadcast at most.
FEW, SHALLOW, PARTED, TILES = 48, 4, 2, 100_000
WIDE = 10.0
AT = ("group", "level", "tx", "ty")
BOX = "struct<x0 double, y0 double, x1 double, y1 double>"


def plane(rings: Column) -> Column:
    """Rings in the plane of longitude and the sine of latitude, whose areas are those of the unit sphere."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.radians(p["x"]).alias("x"), F.sin(F.radians(p["y"])).alias("y"))))


def sided(polygons: DataFrame, sphere: bool, level: bool = False) -> DataFrame:
    """Sides (x1, y1, x2, y2 with y1 < y2, slope, k) of polygons (group, member, layer, rings, window), and where they count: from `west` to `east`, from `south` to `north`.

    window: struct(x0, y0, x1, y1) outside of which nothing is asked for, or null. Level sides go, unless level says to keep them (their slope is null).
    """
    rings = plane(F.col("rings")) if sphere else F.col("rings")
    rows = polygons.where("rings is not null").withColumn("rings", rings)
    box, w = G.box(F.col("rings")), F.col("window")
    if sphere:
        w = F.struct(F.radians(w["x0"]).alias("x0"), F.sin(F.radians(w["y0"])).alias("y0"), F.radians(w["x1"]).alias("x1"), F.sin(F.radians(w["y1"])).alias("y1"))
    # greatest and least pass over nulls
    rows = rows.withColumn("west", F.greatest(box["x0"], w["x0"])).withColumn("east", F.least(box["x1"], w["x1"])).withColumn("w", w).withColumn("side", F.explode(G.sides(F.col("rings"))))
    a, b = F.col("side.a"), F.col("side.b")
    low, high = F.when(a["y"] < b["y"], a).otherwise(b), F.when(a["y"] < b["y"], b).otherwise(a)
    rows = rows.where((a["y"] != b["y"]) | F.lit(level)).select("group", "member", "layer", "west", "east", low["x"].alias("x1"), low["y"].alias("y1"), high["x"].alias("x2"), high["y"].alias("y2"), "w")
    rows = rows.withColumn("south", F.greatest("y1", "w.y0")).withColumn("north", F.least("y2", "w.y1")).where((F.col("south") < F.col("north")) | (F.lit(level) & (F.col("y1") == F.col("y2")))).where("west < east and least(x1, x2) <= east").drop("w")
    return rows.withColumn("slope", F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).withColumn("k", F.monotonically_increasing_id())


def x_at(y: Column, s: str = "") -> Column:
    return F.col(f"{s}x1") + (y - F.col(f"{s}y1")) * F.col(f"{s}slope")


def edges_of(tile: float) -> tuple[Column, Column, Column, Column]:
    """West, east, south and north of a row's tile."""
    size = F.lit(tile) / F.pow(F.lit(2.0), F.col("level"))
    return F.col("tx") * size, (F.col("tx") + 1) * size, F.col("ty") * size, (F.col("ty") + 1) * size


def meets_tile(tile: float) -> Column:
    """Whether a side counts in its row's tile."""
    x0, x1, y0, y1 = edges_of(tile)
    return (F.col("y2") > y0) & (F.col("y1") < y1) & (F.least("x1", "x2") < x1) & (F.col("east") > x0)


def covered_parts(polygons: DataFrame, sphere: bool, tile: float) -> DataFrame:
    """group, tx, ty and `mask` of the first tiles, a bit for each part (quartered PARTED times) that one polygon covers whole.

    A part counts if no side comes near it and its middle is inside, so one that is covered but for rounding may be left out, never the reverse.
    """
    n = 2**PARTED
    size = tile / n
    rings = plane(F.col("rings")) if sphere else F.col("rings")
    shapes = polygons.where("rings is not null").select("group", G.sides(rings).alias("sides"), G.box(rings).alias("box"))
    inner = lambda low, high: F.when(F.floor(high / size) > F.ceil(low / size), F.sequence(F.ceil(low / size), F.floor(high / size) - 1))
    rows = shapes.withColumn("py", F.explode(inner(F.col("box.y0"), F.col("box.y1"))))
    half, y = size / 2 * (1 + 1e-9), (F.col("py") + 0.5) * size

    def whole(px: Column) -> Column:
        x = (px + 0.5) * size

        def clear(e: Column) -> Column:
            a, b = e["a"], e["b"]
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            apart = (F.abs(a["x"] + dx / 2 - x) >= half + F.abs(dx) / 2) | (F.abs(a["y"] + dy / 2 - y) >= half + F.abs(dy) / 2)
            return apart | (F.abs(dx * (y - a["y"]) - dy * (x - a["x"])) > (F.abs(dx) + F.abs(dy)) * half)

        def meets(e: Column) -> Column:
            a, b = e["a"], e["b"]
            return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

        return F.forall("sides", clear) & (F.size(F.filter("sides", meets)) % 2 == 1)

    parts = rows.withColumn("px", F.explode(F.filter(inner(F.col("box.x0"), F.col("box.x1")), whole)))
    bit = F.expr(f"shiftleft(1L, cast(pmod(py, {n}) * {n} + pmod(px, {n}) as int))")
    return parts.groupBy("group", F.floor(F.col("px") / n).alias("tx"), F.floor(F.col("py") / n).alias("ty")).agg(F.bit_or(bit).alias("mask"))


def settled(rows: DataFrame, tile: float) -> tuple[DataFrame, DataFrame]:
    """Of rows (sides with their tiles, level ones too) the tiles that one member covers whole, and the (tile, member) that still count elsewhere.

    A member none of whose sides comes near a tile's inside covers all of it or nothing, as an odd or even number of them is to the
    west of its middle. Such sides would else be dealt to every quarter to the east of them.
    """
    x0, x1, y0, y1 = edges_of(tile)
    near = (x1 - x0) * 1e-9
    low, high = F.greatest("y1", y0), F.least("y2", y1)
    ends = [F.coalesce(x_at(y), F.col(c)) for y, c in ((low, "x1"), (high, "x2"))]  # a level side has no slope
    inside = (F.col("y2") > y0 - near) & (F.col("y1") < y1 + near) & (F.greatest(*ends) > x0 - near) & (F.least(*ends) < x1 + near)
    middle = (y0 + y1) / 2
    west = (F.col("y1") <= middle) & (middle < F.col("y2")) & (x_at(middle) < (x0 + x1) / 2)
    members = rows.select(*AT, "member", inside.alias("inside"), F.when(west, 1).otherwise(0).alias("west")).groupBy(*AT, "member").agg(F.max("inside").alias("inside"), F.sum("west").alias("west"))
    members = checkpointed(members.where("inside or west % 2 = 1"))
    whole = checkpointed(members.where("not inside").select(*AT).distinct())
    return whole, members.where("inside").select(*AT, "member").join(whole, [*AT], "left_anti")


def dealt(sides: DataFrame, tile: float, parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Sides with the tiles that they count in: those that their polygon's box meets, at their heights, and not all to the east of.

    parts: for unions, what covered_parts found; then such parts and later quarters have no rows, and `area` by group is theirs.
    """
    cell = lambda v, size: F.floor(v / size)
    first = F.sequence(cell(F.greatest("west", F.least("x1", "x2")), F.lit(tile)), cell(F.col("east"), F.lit(tile)))
    rows = sides.withColumn("level", F.lit(0)).withColumn("ty", F.explode(F.sequence(cell(F.col("south"), F.lit(tile)), cell(F.col("north"), F.lit(tile))))).withColumn("tx", F.explode(first))
    leaves, done, most = [], [], F.lit(MOST)
    if parts is not None:
        most, n = F.when(F.col("level") < SHALLOW, min(MOST, FEW)).otherwise(MOST), 2**PARTED
        parts = checkpointed(parts)
        done.append(parts.select("group", (F.bit_count("mask") * F.lit((tile / n) ** 2)).alias("area")))
        parts = F.broadcast(parts) if parts.count() <= TILES else parts.hint("merge")
        at = lambda level, i, j: F.struct(F.lit(level).alias("level"), F.lit(i).alias("i"), F.lit(j).alias("j"))
        open_ = F.filter(F.array(*[at(PARTED, i, j) for j in range(n) for i in range(n)]), lambda p: F.getbit("mask", p["j"] * n + p["i"]) == 0)
        rows = rows.join(parts, ["group", "tx", "ty"], "left").withColumn("p", F.explode(F.when(F.col("mask").isNull(), F.array(at(0, 0, 0))).otherwise(open_)))
        times = F.pow(F.lit(2), F.col("p.level")).cast("long")
        rows = rows.withColumns({"level": F.col("p.level"), "tx": F.col("tx") * times + F.col("p.i"), "ty": F.col("ty") * times + F.col("p.j")}).drop("p", "mask").where((F.col("level") == 0) | meets_tile(tile))
    while True:
        if parts is not None:
            whole, kept = settled(rows, tile)
            done.append(whole.select("group", F.pow(F.lit(tile) / F.pow(F.lit(2.0), F.col("level")), F.lit(2.0)).alias("area")))
            rows = rows.join(kept.hint("merge"), [*AT, "member"], "left_semi")
        rows = checkpointed(rows)
        full = checkpointed(rows.groupBy(*AT).count().where((F.col("count") > most) & (F.col("level") < DEEPEST)).drop("count"))
        if full.isEmpty():
            break
        leaves.append(rows.join(full, [*AT], "left_anti"))
        part = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
        inner = rows.join(full, [*AT], "left_semi").withColumn("p", part).withColumn("level", F.col("level") + 1).withColumn("tx", F.col("tx") * 2 + F.col("p.i")).withColumn("ty", F.col("ty") * 2 + F.col("p.j")).drop("p")
        rows = inner.where(meets_tile(tile))
    return reduce(DataFrame.unionByName, leaves, rows), reduce(DataFrame.unionByName, done).groupBy("group").agg(F.sum("area").alias("area")) if done else None


def slabs(rows: DataFrame, tile: float) -> DataFrame:
    """low and high of the slabs of each tile that no corner and no crossing is inside of."""
    x0, x1, y0, y1 = edges_of(tile)
    edge = lambda x: F.col("y1") + F.try_divide(x - F.col("x1"), F.col("slope"))
    within = lambda y: F.when((y >= F.col("y1")) & (y <= F.col("y2")), y)
    own = rows.select(*AT, F.explode(F.array(y0, y1, "y1", "y2", within(edge(x0)), within(edge(x1)))).alias("y"), y0.alias("y0"), y1.alias("y1"))
    # two sides cross where their lines do, if that is at the heights of both; sides to the west of the tile don't matter
    here = rows.where(F.greatest("x1", "x2") >= x0).select(*AT, "k", "x1", "y1", "slope", "y2")
    a, b = (here.select(*AT, *[F.col(c).alias(f"{s}{c}") for c in ("k", "x1", "y1", "slope", "y2")]) for s in ("a_", "b_"))
    pairs = a.join(b, [*AT]).where((F.col("a_k") < F.col("b_k")) & (F.col("a_y1") < F.col("b_y2")) & (F.col("b_y1") < F.col("a_y2")))
    y = F.col("a_y1") + F.try_divide(x_at(F.col("a_y1"), "b_") - F.col("a_x1"), F.col("a_slope") - F.col("b_slope"))  # null of parallel sides
    crossings = pairs.withColumn("y", y).where("y > a_y1 and y > b_y1 and y < a_y2 and y < b_y2").select(*AT, "y", y0.alias("y0"), y1.alias("y1"))
    heights = own.unionByName(crossings).where("y between y0 and y1").select(*AT, "y").distinct()
    above = F.lead("y").over(Window.partitionBy(*AT).orderBy("y"))
    return heights.select(*AT, F.col("y").alias("low"), above.alias("high")).where("high > low")


def measured(polygons: DataFrame, covered: Column, sphere: bool = True, tile: float = TILE, union: bool = False) -> DataFrame:
    """group and area of what is `covered`, a condition on depth0 and depth1, the number of polygons of each layer over a place.

    polygons: (group, member, layer, rings, window); members tell the polygons of a group and layer apart. union: what any polygon
    covers is covered, and there are no windows.
    """
    rows, done = dealt(sided(polygons, sphere, union), tile, covered_parts(polygons, sphere, tile) if union else None)
    size = F.lit(tile) / F.pow(F.lit(2.0), F.col("level"))
    middle = (F.col("low") + F.col("high")) / 2
    met = rows.join(slabs(rows, tile), [*AT]).where((F.col("y1") < middle) & (F.col("y2") > middle))
    met = met.select(*AT, "low", "high", "member", "layer", "k", x_at(middle).alias("x"), (F.col("tx") * size).alias("x0"), ((F.col("tx") + 1) * size).alias("x1"))
    slab = (*AT, "low")
    turn = F.when(F.row_number().over(Window.partitionBy(*slab, "layer", "member").orderBy("x", "k")) % 2 == 1, 1).otherwise(-1)
    met = met.withColumn("turn", turn).withColumn("x", F.greatest("x0", F.least("x1", "x")))
    order = Window.partitionBy(*slab).orderBy("x", "k")
    depth = [F.sum(F.when(F.col("layer") == n, F.col("turn")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(f"depth{n}") for n in (0, 1)]
    # sides to the east of the tile aren't there, so the last span ends at its edge
    spans = met.select("group", (F.col("high") - F.col("low")).alias("height"), (F.coalesce(F.lead("x").over(order), F.col("x1")) - F.col("x")).alias("width"), *depth)
    unit = G.AUTHALIC_KM**2 if sphere else 1.0
    found = spans.where(covered).groupBy("group").agg(F.sum(F.col("height") * F.col("width")).alias("area"))
    found = found if done is None else found.unionByName(done)
    return found.groupBy("group").agg((F.sum("area") * unit).alias("area"))


def union_area(polygons: DataFrame, group: str, rings: str = "rings", sphere: bool = True, tile: float = TILE) -> DataFrame:
    """group and `area`, what the polygons of each group cover together."""
    alone = spread(polygons.select(F.col(group).alias("group"), F.col(rings).alias("rings")).where("rings is not null"), "group", "rings").distinct()
    rows = checkpointed(alone.select("group", F.monotonically_increasing_id().alias("member"), F.lit(0).alias("layer"), "rings", F.lit(None).cast(BOX).alias("window")))
    return measured(rows, F.col("depth0") > 0, sphere, tile, union=True).withColumnRenamed("group", group)


def shared_areas(left: DataFrame, right: DataFrame, a: str, b: str, sphere: bool = True, tile: float = TILE) -> DataFrame:
    """a, b and `area` for shapes of left (a, rings) and right (b, rings) that overlap; the rows of one key are one shape, however they overlap.

    Pairs are those whose boxes meet in a tile of WIDE degrees (or units); of the right shape only the sides at the heights of the
    left one's box, and not to the east of it, go along.
    """

    def parts(df: DataFrame, key: str, name: str) -> DataFrame:
        return checkpointed(df.where("rings is not null").select(F.col(key).alias(name), "rings", F.monotonically_increasing_id().alias("member"), G.box(F.col("rings")).alias("box")))

    def placed(df: DataFrame, name: str) -> DataFrame:
        whole = F.struct(F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1"))
        cells = lambda c: F.explode(F.sequence(F.floor(F.col(f"box_{name}.{c}0") / WIDE), F.floor(F.col(f"box_{name}.{c}1") / WIDE)))
        return df.groupBy(name).agg(whole.alias(f"box_{name}")).withColumn("cx", cells("x")).withColumn("cy", cells("y"))

    one, two = parts(left, a, "a"), parts(right, b, "b")
    touch = " and ".join(f"box_{p}.{c}0 <= box_{q}.{c}1" for c in "xy" for p, q in ("ab", "ba"))
    pairs = placed(one, "a").join(placed(two, "b"), ["cx", "cy"]).where(touch).select("a", "b", F.col("box_a").alias("window")).distinct()
    of = lambda df, key, layer: pairs.join(df, key).select(F.struct("a", "b").alias("group"), "member", F.lit(layer).alias("layer"), "rings", "window")
    found = measured(of(one, "a", 0).unionByName(of(two, "b", 1)), (F.col("depth0") > 0) & (F.col("depth1") > 0), sphere, tile)
    return found.where("area > 0").select(F.col("group.a").alias(a), F.col("group.b").alias(b), "area")
