"""Texts and nested values of source feeds as typed Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of feed categories and the hazard each stands for, the first that a category has (fixed values).
EONET_CATEGORIES = (("severestorm", "Storm"), ("flood", "Flood"), ("drought", "Drought"), ("tempextreme|temperature", "Heat"), ("landslide", "Landslide"))
CEMS_CATEGORIES = (("fire", "Wildfire"), ("flood", "Flood"), ("storm|cyclone|hurricane|typhoon", "Storm"), ("drought", "Drought"), ("landslide|mass movement", "Landslide"), ("heat|temperature", "Heat"))
GDACS_CATEGORIES = (("^fl$", "Flood"), ("^tc$", "Storm"), ("^wf$", "Wildfire"), ("^dr$", "Drought"))
#: Texts that stand for no number, and a space inside a number (fixed values).
NO_NUMBER, GROUPED = r"^(n/a|na|null|none|-)$", r"(?<=\d)[,\s](?=\d{3}(?:\D|$))"
NUMBER = r"-?\d+(?:\.\d+)?"


def category(text: Column, rules: tuple) -> Column:
    """The hazard of the first rule whose words the text has, in any case; else null."""
    out, low = F.lit(None).cast("string"), F.lower(text)
    for words, hazard in reversed(rules):
        out = F.when(low.rlike(words), hazard).otherwise(out)
    return out


def first_value(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(v.cast("string") != "", v) for v in values])


def squeezed(text: Column, limit: int = 480) -> Column:
    """White space runs become one space; what is longer than the limit is cut there, its last character an ellipsis."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def number_text(text: Column) -> Column:
    """The first number of a text, without separators of thousands."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(text, "\u00a0", " ")), GROUPED, "")
    return F.nullif(F.regexp_extract(plain, f"({NUMBER})", 1), F.lit(""))


def as_float(text: Column) -> Column:
    return number_text(text).try_cast("double")


def as_count(text: Column) -> Column:
    """A number of things: not negative, rounded half to even; null for texts that say there is none."""
    x = F.when(~F.lower(F.trim(F.regexp_replace(text, "\u00a0", " "))).rlike(NO_NUMBER), as_float(text))
    return F.when(x >= 0, F.rint(x).cast("long"))


def finite(text: Column) -> Column:
    """A text that is a number as a whole, and finite."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def truthy(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("1", "true", "yes", "y")


def normal_key(text: Column) -> Column:
    """A key in capitals with only letters, digits and points."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9.]", "")


def method_words(text: Column) -> Column:
    """A method's name in small letters with single spaces for underscores, hyphens and blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s_-]+", " "))


def wkt_point(text: Column) -> Column:
    """struct(lon, lat) of a WKT point, or null."""
    at = r"(?i)POINT\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*\)"
    lon, lat = (F.regexp_extract(text, at, k).try_cast("double") for k in (1, 2))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def centre(kind: Column, coordinates: Column) -> Column:
    """struct(lon, lat) of a geometry whose coordinates are JSON text: a point itself, else the plain mean of all its vertices."""
    number = r"\s*(-?[0-9][0-9.eE+-]*)\s*"
    lons, lats = (F.transform(F.regexp_extract_all(coordinates, F.lit(rf"\[{number},{number}"), F.lit(k)), lambda x: x.cast("double")) for k in (1, 2))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    lon, lat = (F.when(kind == "Point", F.get(xs, F.lit(0))).otherwise(mean(xs)) for xs in (lons, lats))
    return F.when(F.size(lons) > 0, F.struct(lon.alias("lon"), lat.alias("lat")))


def at_text(lat: Column, lon: Column) -> Column:
    return F.format_string("%.2f°, %.2f°", lat, lon)


def hectares(text: Column) -> Column:
    """An area with its unit whatever its size; a bare number only from 1,000 on."""
    united = F.regexp_replace(F.regexp_extract(text, r"(?i)([0-9][0-9.,\s]*)\s*(?:ha|hectares?)", 1), r"[\s,]", "").try_cast("double")
    bare = F.trim(F.regexp_replace(text, ",", "")).try_cast("double")
    has_unit = text.rlike(r"(?i)[0-9][0-9.,\s]*\s*(?:ha|hectares?)")
    return F.when(has_unit, united).otherwise(F.when((bare >= 1000) & (bare < float("inf")), bare))


def area_text(text: Column) -> Column:
    """The area of a text like `1,234.5 ha`."""
    return as_float(F.nullif(F.regexp_extract(text, r"(?i)([0-9][0-9,.\s]*)\s*(?:ha|hectares?)\b", 1), F.lit("")))


def drought_area_km2(text: Column) -> Column:
    """The area in km² of a text about a drought's impact or risk."""
    low = F.lower(text)
    km2 = as_float(F.nullif(F.regexp_extract(text, r"(?i)([0-9][0-9,\s]*(?:\.\d+)?)\s*km\s*(?:²|2|\^2)?", 1), F.lit("")))
    return F.when(low.contains("drought") & low.rlike("impact|risk"), km2)


def alert_level(explicit: Column, text: Column) -> Column:
    """Green, Orange or Red: as said, else the worst whose word the text has, else empty."""
    said = F.initcap(F.trim(F.coalesce(explicit, F.lit(""))))
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.when(low.rlike(r"\bred\b"), "Red").when(low.rlike(r"\borange\b"), "Orange").when(low.rlike(r"\bgreen\b"), "Green").otherwise("")
    return F.when(said.isin("Green", "Orange", "Red"), said).otherwise(found)


def age_label(at: Column, now: Column) -> Column:
    """How long ago a time is, hours and days rounded half to even; unknown for none or one over five minutes ahead."""
    seconds = F.unix_seconds(now) - F.unix_seconds(at)
    hours = F.greatest(F.lit(0), F.rint(seconds / 3600).cast("long"))
    days = F.rint(hours / 24).cast("long")
    plural = F.when(days == 1, "").otherwise("s")
    text = F.when(hours < 1, "Updated <1 hour ago").when(hours < 24, F.concat(F.lit("Updated "), hours.cast("string"), F.lit(" h ago"))).otherwise(F.concat(F.lit("Updated "), days.cast("string"), F.lit(" day"), plural, F.lit(" ago")))
    return F.when(at.isNull() | (seconds < -300), "Update time unavailable").otherwise(text)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from north of the great circle that leaves the first point for the second."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))) + 360, F.lit(360.0))


def turn_between(a: Column, b: Column) -> Column:
    """The angle between two bearings, 0 to 180."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)
