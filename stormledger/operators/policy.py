"""Which events are shown, and what a mapped geometry may be used for: columns that fail closed on anything unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormledger.functions.parsing import method_words

#: Areas and people from which a green fire is shown, and the ratio of mapped to reported area that a perimeter may have (fixed values).
FIRE_HA, FIRE_PEOPLE, RATIO, WARN = 10_000.0, 10_000, (0.5, 2.0), 0.25
#: Words that a wind method must not have (fixed values).
UNSURE = "forecast|fallback|proximity|generic|unverified|screening"
#: Grade, role, purpose and whether it counts for people across hazards, of each kind of geometry (fixed values).
GRADES = {
    "fire": ("exposure_grade", "burned_fire_perimeter", "cross_hazard_population_and_burned_area", True),
    "fire pending": ("context_grade", "wildfire_geometry_pending_perimeter_validation", "wildfire_event_context", False),
    "wind": ("exposure_grade", "tropical_cyclone_observed_wind_zone", "cross_hazard_population", True),
    "wind pending": ("context_grade", "tropical_cyclone_wind_context_unverified", "tc_wind_context_pending_threshold_temporal_validation", False),
    "flood": ("context_grade", "reported_flood_event_area_context", "reported_area_population_context", False),
    "drought": ("risk_grade", "drought_risk_impact_area", "drought_risk_and_crop_context", False),
    "other": ("context_grade", "mapped_event_context", "event_area_context", False),
}


def wind_threshold(method: Column) -> Column:
    """34 kt or 64 kt of a method that names an observed or actual wind polygon and nothing unsure; else null."""
    m = method_words(method)
    named = ~m.rlike(UNSURE) & m.contains("wind") & m.contains("polygon") & m.rlike("observed|actual")
    speed = F.when(m.rlike(r"\b34\s*(?:kt|kts|knot|knots)\b"), "34 kt").when(m.rlike(r"\b64\s*(?:kt|kts|knot|knots)\b"), "64 kt")
    return F.when(named, speed)


def explicit_wind(properties: Column) -> Column:
    """Whether a cyclone feature's properties (text) speak of wind, not of surge or rain."""
    t = F.lower(F.coalesce(properties, F.lit("")))
    return ~t.rlike("storm surge|stormsurge|rainfall|precip") & t.rlike("34kt|34 kt|34 knots|tropical storm|wind|63 km/h|64kt|64 kt")


def fire_qc(mapped_ha: Column, burned_ha: Column, episode: Column, source: Column, method: Column, source_episode: Column) -> Column:
    """struct of the admission of a fire's perimeter: status, reason, authority, aligned, ratio and warning."""
    s, m = F.lower(F.trim(F.coalesce(source, F.lit("")))), F.lower(F.trim(F.coalesce(method, F.lit(""))))
    authority = s.contains("gdacs") & s.contains("gwis") & m.contains("source_reported")
    aligned = F.coalesce(source_episode == episode, F.lit(False))
    has_burned, has_mapped = F.coalesce(burned_ha > 0, F.lit(False)), F.coalesce(mapped_ha > 0, F.lit(False))
    ratio = F.when(has_burned & has_mapped, mapped_ha / burned_ha)
    fits = F.coalesce(ratio.between(*RATIO), F.lit(False))
    passed = authority & aligned & fits
    why = F.array_compact(F.array(
        F.when(~authority, "burned_area_source_provenance_not_verified_gdacs_gwis"), F.when(~aligned, "burned_area_and_footprint_episode_not_aligned"), F.when(~has_burned, "source_burned_area_missing_or_invalid"),
        F.when(~has_mapped, "mapped_polygon_area_missing_or_invalid"), F.when(ratio.isNotNull() & ~fits, "mapped_area_grossly_inconsistent_with_source_burned_area"),
    ))
    reason = F.when(passed, "episode_aligned_gdacs_gwis_burned_area_perimeter").otherwise(F.array_join(why, ";"))
    far = passed & (F.abs(mapped_ha - burned_ha) / burned_ha > WARN)
    return F.struct(F.when(passed, "pass").otherwise("failed").alias("status"), reason.alias("reason"), authority.alias("authority"), aligned.alias("aligned"), F.round(ratio, 4).alias("ratio"), F.when(far, "mapped_vs_source_burned_area_difference_gt_25pct").alias("warning"))


def fire_qc_pass(qc: Column) -> Column:
    return F.coalesce((qc["status"] == "pass") & qc["authority"] & qc["aligned"], F.lit(False))


def geometry_grade(kind: Column, method: Column, qc: Column) -> Column:
    """struct(grade, role, purpose, counts) of a mapped geometry by its hazard, method and fire_qc()."""
    case = F.when(kind == "Wildfire", F.when(fire_qc_pass(qc), "fire").otherwise("fire pending")).when(kind == "Storm", F.when(wind_threshold(method).isNotNull(), "wind").otherwise("wind pending"))
    case = case.when(kind == "Flood", "flood").when(kind == "Drought", "drought").otherwise("other")
    table = F.create_map(*[x for name, (g, r, p, c) in GRADES.items() for x in (F.lit(name), F.struct(F.lit(g).alias("grade"), F.lit(r).alias("role"), F.lit(p).alias("purpose"), F.lit(c).alias("counts")))])
    return table[case]


def fire_shown(priority: Column, burned_ha: Column, people_5km: Column, strict: bool = False) -> Column:
    """Orange and red fires, and green ones with the area and the people; strict: more than the people."""
    people = people_5km > FIRE_PEOPLE if strict else people_5km >= FIRE_PEOPLE
    return priority.isin("Medium", "High") | F.coalesce((burned_ha >= FIRE_HA) & people, F.lit(False))


def storm_shown(priority: Column, origin: Column, footprint_people: Column, people_300km: Column) -> Column:
    """Orange and red storms and all of CEMS; else people in the footprint, or where none is mapped within 300 km."""
    people = F.coalesce(footprint_people, people_300km, F.lit(0)) > 0
    return priority.isin("Medium", "High") | (origin == "cems") | people


def storm_shown_by_source(priority: Column, *people: Column) -> Column:
    """Orange and red storms, and those for which the source itself counts people."""
    return priority.isin("Medium", "High") | (F.greatest(*[F.coalesce(p, F.lit(0)) for p in people]) > 0)


def backed_by(origin: str, own: Column, members: Column) -> Column:
    """Whether an event or one of its members is of an origin."""
    return F.coalesce(F.lower(own) == origin, F.lit(False)) | F.exists(members, lambda m: F.lower(m["origin"]) == origin)


def preferred_people(kind: Column, metrics: Column) -> Column:
    """struct(key, people): the first of a hazard's population metrics that a map has."""
    keys = {"Wildfire": ("population_direct", "population_within_5km"), "Storm": ("population_wind_39kt", "population_ts_or_impact_footprint", "population_storm_surge"), "Flood": ("affected_population", "estimated_population_exposed")}
    out = F.lit(None).cast("struct<key:string,people:double>")
    for hazard, names in keys.items():
        found = F.coalesce(*[F.when(metrics[n].isNotNull(), F.struct(F.lit(n).alias("key"), metrics[n].alias("people"))) for n in names])
        out = F.when(kind == hazard, found).otherwise(out)
    return out


def publication(days: Column, requested: Column, frozen: Column) -> Column:
    """A frozen report with missing days is withheld; one that still rolls is a preview."""
    whole = days >= requested
    return F.when(frozen & ~whole, "withheld_incomplete_coverage").when(frozen, "complete_frozen_publication").when(whole, "complete_preview").otherwise("partial_preview")
