"""Landed feed payloads (one JSON document a row) as normalised events. Nothing here fetches; a payload is what a poll stored.

A payload that is null, cut or of another shape gives no row. Each feed's rows have FIELDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.functions import parsing as P
from stormledger.functions.columns import priority, valid_point

FIELDS = "id source_id origin title type region lat lon status priority summary source source_url event_date source_updated_at event_start event_end last_detection burned_area_ha gdacs_id".split()
EONET = "events array<struct<id string, title string, description string, link string, categories array<struct<id string, title string>>, sources array<struct<url string>>, geometry array<struct<date string, type string, coordinates string>>>>"
CEMS = "results array<struct<code string, name string, closed boolean, category struct<slug string, name string, title string>, centroid string, countries array<string>, lastUpdate string, eventTime string, activationTime string, gdacsId string>>"
GDACS = "features array<struct<geometry struct<type string, coordinates string>, properties string>>"
GDACS_PROPERTIES = "eventtype string, eventid string, name string, country string, iso3 string, fromdate string, todate string, alertlevel string, lastupdate string, datemodified string, severitydata struct<severitytext string, severity string>"
#: Fields of a GDACS feature's properties, and of their severity data, that may tell a burned area, in order (fixed values).
AREA_FIELDS = ("ha", "hectares", "burnedarea", "burnedArea", "burned_area", "burnedarea_ha", "burnedAreaHa", "area_ha")
SEVERITY_FIELDS = ("ha", "hectares", "burnedarea", "burnedArea", "severitytext", "severity")


def landed(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """path and payload of each landed file, whole; files that are no JSON stay as rows and give no events."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def items(payloads: DataFrame, schema: str) -> DataFrame:
    """One row an item of each payload's list, its fields beside keep's columns."""
    name = schema.split()[0]
    parsed = payloads.select(F.from_json("payload", schema).alias("doc"))
    return parsed.select(F.explode(f"doc.{name}").alias("x")).select("x.*")


def event(**fields) -> list[Column]:
    return [(fields[f] if isinstance(fields.get(f), Column) else F.lit(fields.get(f))).cast("double" if f in ("lat", "lon", "burned_area_ha") else "string").alias(f) for f in FIELDS]


def eonet(payloads: DataFrame) -> DataFrame:
    """Events with a known category (their first) and a valid place (their last geometry)."""
    e = items(payloads, EONET)
    first, last = F.get("categories", F.lit(0)), F.get("geometry", F.size("geometry") - 1)
    e = e.withColumn("type", P.category(P.first_value(first["id"], first["title"]), P.EONET_CATEGORIES)).withColumn("last", last).withColumn("p", P.centre(last["type"], last["coordinates"]))
    e = e.where(F.col("type").isNotNull() & valid_point(F.col("p.lat"), F.col("p.lon")))
    url = P.first_value(F.get(F.filter(F.transform("sources", lambda s: s["url"]), lambda u: F.coalesce(u, F.lit("")) != ""), F.lit(0)), F.col("link"))
    date, start = F.col("last.date"), F.get("geometry", F.lit(0))["date"]
    return e.select(*event(
        id=F.concat(F.lit("eonet-"), "id"), source_id=F.col("id"), origin="eonet", title=P.first_value(F.col("title"), F.concat("type", F.lit(" event"))), type=F.col("type"),
        region=P.at_text(F.col("p.lat"), F.col("p.lon")), lat=F.col("p.lat"), lon=F.col("p.lon"), status="Open", priority="Standard",
        summary=P.squeezed(P.first_value(F.col("description"), F.concat("type", F.lit(" event tracked by the feed.")))), source="EONET", source_url=url,
        event_date=date, source_updated_at=date, event_start=start, last_detection=date,
    ))


def country_names(countries: Column) -> Column:
    """Names of countries (JSON texts or objects with short_name, name or title), joined."""
    name = F.transform(countries, lambda c: F.when(c.startswith("{"), F.coalesce(P.first_value(F.get_json_object(c, "$.short_name"), F.get_json_object(c, "$.name"), F.get_json_object(c, "$.title")), F.lit(""))).otherwise(c))
    return F.array_join(F.filter(name, lambda n: n != ""), " · ")


def cems(payloads: DataFrame) -> DataFrame:
    """Open activations with a known category and a valid centroid."""
    e = items(payloads, CEMS).where(~F.coalesce("closed", F.lit(False)))
    kind = P.category(P.first_value(F.col("category.slug"), F.col("category.name"), F.col("category.title")), P.CEMS_CATEGORIES)
    e = e.withColumn("type", kind).withColumn("p", P.wkt_point(F.col("centroid"))).where(F.col("type").isNotNull() & valid_point(F.col("p.lat"), F.col("p.lon")))
    code, lat, lon = F.coalesce("code", F.lit("")), F.col("p.lat"), F.col("p.lon")
    start = P.first_value(F.col("eventTime"), F.col("activationTime"))
    linked = F.when(P.first_value(F.col("gdacsId")).isNotNull(), F.concat(F.lit(" Linked GDACS ID: "), "gdacsId", F.lit("."))).otherwise("")
    return e.select(*event(
        id=F.concat(F.lit("cems-"), F.when(code != "", code).otherwise(F.format_string("%.2f-%.2f", lat, lon))), source_id=F.when(code != "", code).otherwise("unknown"), origin="cems",
        title=P.first_value(F.col("name"), F.concat("type", F.lit(" activation"))), type=F.col("type"), region=P.first_value(country_names(F.col("countries")), P.at_text(lat, lon)), lat=lat, lon=lon,
        status="Active", priority="Review", summary=P.squeezed(F.concat(F.lit("Rapid mapping activation"), F.when(code != "", F.concat(F.lit(" "), code)).otherwise(""), F.lit("."), linked)),
        source="CEMS", event_date=P.first_value(F.col("lastUpdate"), start), source_updated_at=F.col("lastUpdate"), event_start=start, last_detection=F.col("lastUpdate"), gdacs_id=F.col("gdacsId"),
    ))


def burned_area(properties: Column) -> Column:
    """The first area that the known fields of a GDACS feature's properties (JSON text) give, else one that the severity data say anywhere."""
    # maps, since names that differ in case alone are different fields
    own = F.from_json(properties, "map<string,string>")
    severity = own["severitydata"]
    inner = F.from_json(severity, "map<string,string>")
    return F.coalesce(*[P.hectares(own[c]) for c in AREA_FIELDS], *[P.hectares(inner[c]) for c in SEVERITY_FIELDS], P.hectares(severity))


def gdacs(payloads: DataFrame, least_ha: float = 10_000.0, green_only: bool = False) -> DataFrame:
    """Features with a known type and a valid place; fires need an area of least_ha.

    green_only: only green fires below it go, and orange or red ones stay whatever their area.
    """
    e = items(payloads, GDACS)
    e = e.select("properties", F.from_json("properties", GDACS_PROPERTIES).alias("x"), "geometry").select("x.*", "properties", P.centre(F.col("geometry.type"), F.col("geometry.coordinates")).alias("p"))
    e = e.withColumn("type", P.category(F.col("eventtype"), P.GDACS_CATEGORIES)).where(F.col("type").isNotNull() & valid_point(F.col("p.lat"), F.col("p.lon")))
    fire = F.col("type") == "Wildfire"
    e = e.withColumn("area", F.when(fire, burned_area(F.col("properties"))))
    enough = F.coalesce(F.col("area") >= least_ha, F.lit(False))
    if green_only:
        enough = enough | F.coalesce(F.lower("alertlevel").isin("orange", "red"), F.lit(False))
    e = e.where(~fire | enough)
    lat, lon = F.col("p.lat"), F.col("p.lon")
    eid = F.coalesce("eventid", F.concat(F.format_string("%.2f-%.2f-", lat, lon), F.coalesce("todate", F.lit(""))))
    region = P.first_value(F.col("country"), F.col("iso3"), P.at_text(lat, lon))
    updated, detected = P.first_value(F.col("lastupdate"), F.col("datemodified")), F.when(fire, F.col("todate"))
    level = P.first_value(F.col("alertlevel"))
    said = P.first_value(F.col("severitydata.severitytext"), F.col("severitydata.severity"), F.concat("type", F.lit(" event tracked by the feed.")))
    burned = F.when(F.col("area").isNotNull(), F.concat(F.lit("Burned area: "), F.format_number(F.rint("area"), 0), F.lit(" ha. "))).otherwise("")
    return e.select(*event(
        id=F.concat(F.lit("gdacs-"), P.first_value(F.col("eventtype"), F.lit("EV")), F.lit("-"), eid), source_id=eid, origin="gdacs", title=P.first_value(F.col("name"), F.concat("type", F.lit(" in "), region)),
        type=F.col("type"), region=region, lat=lat, lon=lon, status="Recent", priority=priority(F.coalesce("alertlevel", F.lit(""))),
        summary=P.squeezed(F.concat(burned, said, F.when(level.isNotNull(), F.concat(F.lit(" Alert level: "), level, F.lit("."))).otherwise(""))),
        source=F.concat(F.lit("GDACS"), F.when(level.isNotNull(), F.concat(F.lit(" · "), level)).otherwise("")),
        event_date=P.first_value(updated, detected, F.col("fromdate"), F.col("todate")), source_updated_at=updated, event_start=F.col("fromdate"), event_end=F.col("todate"), last_detection=detected, burned_area_ha=F.col("area"),
    ))


def carry_forward(current: DataFrame, previous: DataFrame, polls: DataFrame) -> DataFrame:
    """Rows of current of the origins whose poll succeeded, and those of previous for the others, `stale` saying which; polls: (origin, ok), a row an origin."""
    state = F.broadcast(polls.select("origin", "ok"))  # a row an origin
    fresh = current.join(state.where("ok"), "origin", "left_semi").withColumn("stale", F.lit(False))
    return fresh.unionByName(previous.join(state.where("not ok"), "origin", "left_semi").withColumn("stale", F.lit(True)))


def late_starts(events: DataFrame, now: Column, bands: tuple = ((8, 14), (15, 21)), fresh_days: int = 7) -> DataFrame:
    """Events that began in one of the bands of days ago and were detected within fresh_days: they enter again as normal input."""
    age, seen = F.datediff(now, F.col("event_start")), F.unix_seconds(now) - F.unix_seconds(F.col("last_detection"))
    in_band = F.lit(False)
    for a, b in bands:
        in_band = in_band | age.between(a, b)
    return events.where(in_band & (seen >= 0) & (seen <= fresh_days * 86400))
