"""What lies in the footprints of hazards: people, the economy of countries, forests and crops; and the policy over ledger days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormledger.functions import geometry as G
from stormledger.operators import overlay, policy, shapes

#: Country components that a document lists (a fixed value).
COMPONENTS = 12
#: The method that a fire's perimeter has once it is admitted, and the one of a fire's polygon without any (fixed values).
ADMITTED, UNVERIFIED = "gdacs_gwis_episode_aligned_burned_area_perimeter_polygon", "gdacs_wildfire_event_polygon_unverified"


def fire_people(footprints: DataFrame, key: str, grid: DataFrame, reach_km: float = 5.0) -> DataFrame:
    """key and the people of each footprint: inside, within reach_km, and in the ring between; one join by the wider reach serves both. Nulls for a footprint without a shape."""
    inside = G.covers(F.col("rings"), F.col("lon_c"), F.col("lat_c"))
    met = shapes.cells_in(footprints.select(key, "rings"), grid.where("people >= 0"), reach_km=reach_km).withColumn("inside", inside)
    sums = met.groupBy(key).agg(F.sum(F.when(F.col("inside"), F.col("people")).otherwise(0)).alias("direct"), F.sum("people").alias("within"))
    out = footprints.select(key, F.col("rings").isNotNull().alias("mapped")).join(sums, key, "left")
    some = lambda c: F.when(F.col("mapped"), F.coalesce(c, F.lit(0)).cast("long"))
    return out.select(key, some(F.col("direct")).alias("population_direct"), some(F.col("within")).alias("population_within_5km"), some(F.greatest(F.lit(0), F.col("within") - F.col("direct"))).alias("population_5km_ring"))


def economy(footprints: DataFrame, key: str, grid: DataFrame, lands: DataFrame, rates: DataFrame) -> DataFrame:
    """key, value, coverage_pct and components of each footprint: people by country times the country's product a head.

    grid (row, col, lat_c, lon_c, people), lands (country, rings), rates (country, rate). A cell is of every country that covers its centre. People of a country
    without a rate lower the coverage; a footprint with no people of known rate has no row. components: the COMPONENTS
    countries of the greatest value, as structs (value, country, people, rate).
    """
    cells = shapes.cells_in(footprints.select(key, "rings"), grid.where("people > 0")).select(key, "row", "col", "people")
    # countries are laid over the grid once, not over each footprint
    of = shapes.cells_in(lands.select("country", "rings"), grid).select("country", "row", "col").distinct()
    people = cells.join(of, ["row", "col"]).groupBy(key, "country").agg(F.sum("people").cast("long").alias("people"))
    rated = people.join(rates.select("country", "rate"), "country", "left").withColumn("value", F.col("people") * F.col("rate"))
    known = F.col("rate").isNotNull()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("value"), "country"))
    rated = rated.withColumn("rank", rank)
    top = F.when(known & (F.col("rank") <= COMPONENTS), F.struct((-F.col("rank")).alias("order"), "value", "country", "people", "rate"))
    sums = rated.groupBy(key).agg(F.sum("value").alias("value"), F.sum(F.when(known, F.col("people"))).alias("known"), F.sum("people").alias("all"), F.reverse(F.array_sort(F.collect_list(top))).alias("top"))  # at most COMPONENTS
    components = F.transform("top", lambda x: F.struct(x["value"].alias("value"), x["country"].alias("country"), x["people"].alias("people"), x["rate"].alias("rate")))
    return sums.where("known > 0").select(key, "value", F.round(F.col("known") / F.col("all") * 100, 1).alias("coverage_pct"), components.alias("components"))


def area_in(footprints: DataFrame, key: str, grid: DataFrame, **shares: str) -> DataFrame:
    """key and, for each named column of the grid (hectares), its valid sum in the footprint in km²; null if no cell is in it."""
    met = shapes.cells_in(footprints.select(key, "rings"), grid)
    return met.groupBy(key).agg(*[(shapes.valid_sum(F.col(c)) / 100.0).alias(name) for name, c in shares.items()])


def by_hazard(footprints: DataFrame, key: str, grid: DataFrame, lands: DataFrame, rates: DataFrame) -> DataFrame:
    """key, type, status and the assets that each hazard's footprint is held against; footprints (key, type, rings), a null shape is unmapped.

    Droughts: land, forests and crops, and no people. Fires: forests. Floods: people and their economy. Storms: their economy. Other hazards and
    unmapped events have no assets. grid: people and the hectares land_ha, forest_ha and crop_ha of its cells.
    """
    of = lambda *types: footprints.where(F.col("type").isin(*types) & F.col("rings").isNotNull())
    drought = area_in(of("Drought"), key, grid, land_km2="land_ha", forest_km2="forest_ha", crop_km2="crop_ha")
    fire = area_in(of("Wildfire"), key, grid, forest_km2="forest_ha")
    gdp = economy(of("Flood", "Storm"), key, grid, lands, rates).select(key, F.col("value").alias("gdp_usd"), "coverage_pct", "components")
    people = shapes.cells_in(of("Flood").select(key, "rings"), grid).groupBy(key).agg(shapes.valid_sum(F.col("people")).cast("long").alias("people"))
    areas = drought.unionByName(fire, allowMissingColumns=True)
    out = footprints.select(key, "type", "rings").join(areas, key, "left").join(people, key, "left").join(gdp, key, "left")
    area = F.when(F.col("rings").isNotNull() & (F.col("type") == "Drought"), G.area_km2(F.col("rings")))
    status = F.when(~F.col("type").isin("Drought", "Wildfire", "Flood", "Storm"), "no_assets").when(F.col("rings").isNull(), "unmapped").otherwise("ready")
    return out.select(key, "type", status.alias("status"), area.alias("mapped_km2"), "land_km2", "forest_km2", "crop_km2", "people", "gdp_usd", "coverage_pct", "components")


def enforced(ledger: DataFrame) -> DataFrame:
    """ledger with the method, fire QC and grade that the policy of today gives each mapped record, and `changed`, whether one of them was another.

    ledger: (type, mapped, method, qc, grade, role, mapped_ha, burned_ha, episode, source, source_episode), rows of all days. A fire whose stored QC is not a strict pass is judged
    anew; an admitted one gets the admitted method, another without a method the unverified one. A record that is not mapped stays.
    """
    fire = F.col("type") == "Wildfire"
    fresh = policy.fire_qc(F.col("mapped_ha"), F.col("burned_ha"), F.col("episode"), F.col("source"), F.lit("source_reported_current_episode"), F.col("source_episode"))
    strict = policy.fire_qc_pass(F.col("qc"))
    rows = ledger.withColumn("new_qc", F.when(fire & ~strict, fresh).otherwise(F.col("qc")))
    admitted = policy.fire_qc_pass(F.col("new_qc"))
    rows = rows.withColumn("new_method", F.when(fire & admitted, ADMITTED).when(fire & (F.coalesce("method", F.lit("")) == ""), UNVERIFIED).otherwise(F.col("method")))
    rows = rows.withColumn("new", policy.geometry_grade(F.col("type"), F.col("new_method"), F.col("new_qc")))
    same = F.col("new_method").eqNullSafe(F.col("method")) & F.col("new_qc").eqNullSafe(F.col("qc")) & F.col("new.grade").eqNullSafe(F.col("grade")) & F.col("new.role").eqNullSafe(F.col("role"))
    keep = lambda new, old: F.when(F.col("mapped"), F.col(new)).otherwise(F.col(old)).alias(old)
    own = [c for c in ledger.columns if c not in ("method", "qc", "grade", "role")]
    return rows.select(*own, keep("new_method", "method"), keep("new_qc", "qc"), keep("new.grade", "grade"), keep("new.role", "role"), (F.col("mapped") & ~same).alias("changed"))


def growth(footprints: DataFrame, group: list[str], day: str) -> DataFrame:
    """group, union_km2 of all its footprints, first_km2 of those of its first day, and what was added since; exact unions of (group, day, rings)."""
    named = footprints.withColumn("__g", F.to_json(F.struct(*group)))
    first = named.groupBy(F.col("__g").alias("__h")).agg(F.min(day).alias("__first"))
    both = overlay.union_area(named.select("__g", "rings"), "__g").withColumnRenamed("area", "union_km2")
    start = named.join(first, (F.col("__g") == F.col("__h")) & (F.col(day) == F.col("__first"))).select("__g", "rings")
    firsts = overlay.union_area(start, "__g").withColumnRenamed("area", "first_km2")
    keys = named.select("__g", *group).distinct()
    out = keys.join(both, "__g").join(firsts, "__g")
    return out.select(*group, "union_km2", "first_km2", F.greatest(F.lit(0.0), F.col("union_km2") - F.col("first_km2")).alias("added_km2"))


# Columns of single events


def promoted(priority: Column, level: Column) -> Column:
    """A priority raised by an alert: red is high, orange at least medium."""
    return F.when(level == "Red", "High").when((level == "Orange") & (F.coalesce(priority, F.lit("")) != "High"), "Medium").otherwise(priority)


def area_replaced(summary: Column, hectares: Column) -> Column:
    """A summary whose areas in hectares are this one, in whole hectares with separators."""
    shown = F.concat(F.format_number(F.rint(hectares), 0), F.lit(" ha"))
    return F.regexp_replace(F.coalesce(summary, F.lit("")), F.lit(r"(?i)\b[0-9][0-9,.\s]*\s*(?:ha|hectares?)\b"), shown)


def region_key(region: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(region), F.lit("")), F.lit("UNKNOWN"))


# Areas matched by iteration inside one expression


def from_local(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """lat and lon of kilometres east and north of a centre, the inverse of tracks.local_xy."""
    p0 = F.radians(lat0)
    far = F.hypot(x, y)
    c = far / 6371.0
    lat = F.when(far == 0, lat0).otherwise(F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(c) * F.sin(p0) + y * F.sin(c) * F.cos(p0) / F.when(far > 0, far))))))
    lon = F.when(far == 0, lon0).otherwise(lon0 + F.degrees(F.atan2(x * F.sin(c), far * F.cos(p0) * F.cos(c) - y * F.sin(p0) * F.sin(c))))
    return lat, lon


def scaled_to(ring: Column, lat0: Column, lon0: Column, km2: Column, rounds: int = 6) -> Column:
    """The factor by which a ring of local kilometres is stretched about its centre so that it has this area on the sphere: fixed-point steps of the root of what is missing."""

    def placed(factor: Column) -> Column:
        def point(p: Column) -> Column:
            lat, lon = from_local(p["x"] * factor, p["y"] * factor, lat0, lon0)
            return F.struct(lon.alias("x"), lat.alias("y"))

        return F.array(F.transform(ring, point))

    def step(factor: Column, _: Column) -> Column:
        area = G.area_km2(placed(factor))
        return F.when(area > 0, factor * F.sqrt(km2 / area)).otherwise(factor)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(1.0), step)


def matched_radius(cells: DataFrame, key: str, target: str, most_km: float = 2500.0, halvings: int = 30) -> DataFrame:
    """key, radius_km and area_km2: the radius about an event at which the cells (key, km, km2, target) within it have the target's area, by halving.

    Null where all cells within most_km have less. Cells are in order of distance with running areas, so each halving is a search in one array of the event's cells.
    """
    near = cells.where(F.col("km") <= most_km).groupBy(key).agg(F.first(target).alias("target"), F.array_sort(F.collect_list(F.struct("km", "km2"))).alias("x"))
    area = lambda r: F.aggregate("x", F.lit(0.0), lambda s, c: s + F.when(c["km"] <= r, c["km2"]).otherwise(0.0))
    whole = area(F.lit(most_km))

    def step(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        short = area(mid) < F.col("target")
        return F.struct(F.when(short, mid).otherwise(s["low"]).alias("low"), F.when(short, s["high"]).otherwise(mid).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(most_km).alias("high"))
    found = near.withColumn("r", F.when(whole >= F.col("target"), F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, step)["high"]))
    return found.select(key, F.col("r").alias("radius_km"), F.when(F.col("r").isNotNull(), area(F.col("r"))).alias("area_km2"))
