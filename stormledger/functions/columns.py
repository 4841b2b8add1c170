"""Scalar expressions of event normalisation, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
ALERTS = ("Green", "Orange", "Red")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def priority(alert: Column) -> Column:
    """High for red, Medium for orange, else Standard."""
    return F.when(F.lower(alert) == "red", "High").when(F.lower(alert) == "orange", "Medium").otherwise("Standard")


def alert_rank(alert: Column) -> Column:
    """0 for none, then green, orange, red, in any case."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ALERTS)), F.initcap(F.trim(alert))), F.lit(0))


def valid_point(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def stratum(lat: Column) -> Column:
    """Hemisphere and zone of a latitude."""
    half = F.when(lat >= 0, "N").otherwise("S")
    return F.concat_ws("_", half, F.when(F.abs(lat) < 23.5, "tropical").when(F.abs(lat) < 55, "mid").otherwise("high"))


def collapsed(text: Column, limit: int = 480) -> Column:
    """White space runs become one space; a longer text ends in an ellipsis at the limit."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))).otherwise(t)


def first_number(text: Column) -> Column:
    """The first number of a text with thousands separators, or null."""
    return F.regexp_replace(F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")


def saturation_pressure(t: Column) -> Column:
    """Saturation vapour pressure in hPa over water, or over ice below 0 degrees."""
    return F.when(t >= 0, 6.1078 * F.exp(17.269 * t / (t + 237.3))).otherwise(6.1078 * F.exp(21.875 * t / (t + 265.5)))


def rounded_people(n: Column) -> Column:
    """A population as the reports print it."""
    k = F.rint(n / 1000) * 1000
    return F.when(n.isNull(), "—").when(n == 0, "0 people").when(n < 1000, "<1,000 people").otherwise(F.concat(F.lit("≈"), F.format_number(k, 0), F.lit(" people")))


def lifecycle(first_seen: Column, last_seen: Column, start: Column, end: Column, complete: Column) -> Column:
    """New, ongoing, resolved or both in a period; nothing is resolved without full coverage, nor what was last seen before the period."""
    new, over = first_seen.between(start, end), complete & (last_seen >= start) & (last_seen < end)
    return F.when(new & over, "New & resolved this period").when(over, "Resolved this period").when(new, "New this period").otherwise("Ongoing")
