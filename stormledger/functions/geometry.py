"""Polygons as columns: arrays of rings, a ring being an array of structs (x, y) that need not be closed; x is a longitude.

Tests on points are even-odd over all rings, so holes and several parts need no order. Everything is an expression on the
row, without Python. A null polygon has no area, covers nothing and has no distance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormledger.functions.columns import haversine_km

#: Semi-axes of the reference ellipsoid in km, and the radius of the sphere of its area (fixed values).
MAJOR_KM, MINOR_KM, AUTHALIC_KM = 6378.137, 6356.752314245, 6371.0071809


def polygon(*rings: list[tuple[Column, Column]]) -> Column:
    return F.array(*[F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ring]) for ring in rings])


def edges(ring: Column) -> Column:
    """structs (a, b) of a ring's sides."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def sides(rings: Column) -> Column:
    return F.flatten(F.transform(rings, edges))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def covers(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside, by the number of sides that a ray to the east meets."""

    def meets(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.coalesce(F.size(F.filter(sides(rings), meets)) % 2 == 1, F.lit(False)) & rings.isNotNull()


def box(rings: Column) -> Column:
    """struct(x0, y0, x1, y1)."""
    of = lambda c: F.transform(F.flatten(rings), lambda p: p[c])
    return F.struct(F.array_min(of("x")).alias("x0"), F.array_min(of("y")).alias("y0"), F.array_max(of("x")).alias("x1"), F.array_max(of("y")).alias("y1"))


def _even_odd(rings: Column, ring_area) -> Column:
    """Areas of rings, those inside an odd number of others taken off, whichever way they are turned."""

    def part(r: Column, i: Column) -> Column:
        others = F.filter(rings, lambda _, j: j != i)
        hole = F.size(F.filter(others, lambda o: covers(F.array(o), F.get(r, F.lit(0))["x"], F.get(r, F.lit(0))["y"]))) % 2 == 1
        return F.abs(ring_area(edges(r))) * F.when(hole, -1.0).otherwise(1.0)

    # a polygon of one ring needs no tests
    alone = F.abs(ring_area(edges(F.get(rings, F.lit(0)))))
    return F.when(rings.isNotNull(), F.when(F.size(rings) == 1, alone).otherwise(total(F.transform(rings, part))))


def planar_area(rings: Column) -> Column:
    """Area in the unit of the coordinates; a ring whose first corner is inside an odd number of others is a hole."""
    return _even_odd(rings, lambda s: total(F.transform(s, lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / 2


def area_km2(rings: Column) -> Column:
    """Area on the sphere of the ellipsoid's area, sides being straight in longitude and the sine of the latitude; holes as in planar_area."""
    sine = lambda p: F.sin(F.radians(p["y"]))
    return _even_odd(rings, lambda s: total(F.transform(s, lambda e: F.radians(e["b"]["x"] - e["a"]["x"]) * (sine(e["a"]) + sine(e["b"])) / 2))) * AUTHALIC_KM**2


def distance_km(rings: Column, x: Column, y: Column) -> Column:
    """0 for a point inside, else the great circle to the nearest point of a side, found in the plane about the point: longitudes
    count by the cosine of its latitude, and sides beyond the date line are as near as they are."""
    scale = F.cos(F.radians(y))
    # sides are moved by whole turns to within half a turn of the point
    turn = lambda e: F.round(((e["a"]["x"] + e["b"]["x"]) / 2 - x) / 360) * 360

    def to(e: Column) -> Column:
        ax, ay = (e["a"]["x"] - turn(e) - x) * scale, e["a"]["y"] - y
        dx, dy = (e["b"]["x"] - e["a"]["x"]) * scale, e["b"]["y"] - e["a"]["y"]
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / square))).otherwise(0.0)
        px, py = ax + t * dx, ay + t * dy
        return F.struct((px * px + py * py).alias("d2"), (e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"])).alias("px"), (e["a"]["y"] + t * dy).alias("py"))

    near = F.array_min(F.transform(sides(rings), to))
    return F.when(covers(rings, x, y), 0.0).otherwise(haversine_km(y, x, near["py"], near["px"]))


def leg_km(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    """distance_km of a straight leg from a to b, without arrays."""
    scale, turn = F.cos(F.radians(y)), F.round(((ax + bx) / 2 - x) / 360) * 360
    dx, dy = (bx - ax) * scale, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x + turn - ax) * scale * dx + (y - ay) * dy) / square))).otherwise(0.0)
    return haversine_km(y, x, ay + t * dy, ax - turn + t * (bx - ax))


def rounded(rings: Column, digits: int = 4) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))))


def polygon_parts(geojson: Column) -> Column:
    """Polygons (arrays of rings) of a GeoJSON text: those of a Polygon, a MultiPolygon or a collection of them; lines and points are left out."""
    ring = "array<array<array<double>>>"
    single = "struct<type string, coordinates string>"
    # a collection's members, or the geometry alone
    every = F.coalesce(F.from_json(geojson, f"struct<geometries array<{single}>>")["geometries"], F.array(F.from_json(geojson, single)))

    def parts(g: Column) -> Column:
        one, many = F.array(F.from_json(g["coordinates"], ring)), F.from_json(g["coordinates"], f"array<{ring}>")
        return F.when(g["type"] == "Polygon", one).when(g["type"] == "MultiPolygon", many).otherwise(F.filter(one, lambda x: F.lit(False)))

    xy = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return F.transform(F.filter(F.flatten(F.transform(every, parts)), lambda p: p.isNotNull()), lambda p: F.transform(p, lambda r: F.transform(r, xy)))
