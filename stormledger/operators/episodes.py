"""Headline metrics with where they come from, aligned with the episode that they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormledger.functions import parsing
from stormledger.operators.exposure import promoted

#: How a metric of the source itself came about, and one of the fallback (fixed values).
REPORTED, DERIVED = "source_reported_current_episode", "spatial_fallback"
PROVENANCE = "map<string,struct<source:string,field:string,method:string,derived:boolean,episode:bigint>>"


def provenance(source: str | Column, field: Column, method: str, derived: bool, episode: Column) -> Column:
    """Where one metric is from."""
    name = F.lit(source) if isinstance(source, str) else source
    return F.struct(name.alias("source"), field.cast("string").alias("field"), F.lit(method).alias("method"), F.lit(derived).alias("derived"), episode.cast("long").alias("episode"))


def source_first(events: DataFrame, metrics: dict[str, tuple[str, str]], source: str, episode: str) -> DataFrame:
    """events with `metrics`, a map of the metrics that are known, and `provenance`, a map of where each is from.

    metrics: by name the column of the source's own value and that of the fallback; a name of the source's column that is not the metric's own is its field.
    What the source reports comes first; the fallback stands in where it says nothing; what neither knows is in neither map.
    """
    values, origins = [], []
    for name, (native, fallback) in metrics.items():
        own, other, key = F.col(native).cast("double"), F.col(fallback).cast("double"), F.lit(name)
        values.append(F.when(F.coalesce(own, other).isNotNull(), F.struct(key.alias("key"), F.coalesce(own, other).alias("value"))))
        told, stands = provenance(source, F.lit(native), REPORTED, False, F.col(episode)), provenance("footprint", F.lit(fallback), DERIVED, True, F.col(episode))
        origins.append(F.when(own.isNotNull(), F.struct(key.alias("key"), told.alias("value"))).when(other.isNotNull(), F.struct(key.alias("key"), stands.alias("value"))))
    return events.withColumn("metrics", F.map_from_entries(F.array_compact(F.array(*values)))).withColumn("provenance", F.map_from_entries(F.array_compact(F.array(*origins))).cast(PROVENANCE))


#: Facts of an episode that a headline takes over.
ALIGNED = ("burned_area_ha", "start_date", "last_detection", "duration_days")


def aligned(events: DataFrame, key: str, episodes: DataFrame, facts: tuple[str, ...] = ALIGNED) -> DataFrame:
    """events (key, headline, facts) with the facts of the episode that the headline names, where that tells them, else their own; and `note`.

    episodes: (key, episode, facts), a row an episode. note: no_episode, episode_unknown (the headline's has no row), newer_episode_pending (one after it has a row) or current.
    """
    newest = episodes.groupBy(F.col(key).alias("__n")).agg(F.max("episode").alias("__newest"))
    named = episodes.select(F.col(key).alias("__k"), F.col("episode").alias("__e"), F.struct(*facts).alias("__x"))
    out = events.join(named, (F.col(key) == F.col("__k")) & (F.col("headline") == F.col("__e")), "left").join(newest, F.col(key) == F.col("__n"), "left")
    note = F.when(F.col("headline").isNull(), "no_episode").when(F.col("__e").isNull(), "episode_unknown").when(F.col("__newest") > F.col("headline"), "newer_episode_pending").otherwise("current")
    rest = [c for c in events.columns if c not in facts]
    return out.select(*rest, *[F.coalesce(f"__x.{c}", c).alias(c) for c in facts], note.alias("note"))


def event_times(event: str, fire: str) -> Column:
    """struct of an event's five times: its own, and where it has no start or last detection those of a fire's metrics. event and fire: struct columns, fire null for others."""
    own = lambda c: F.nullif(F.col(f"{event}.{c}"), F.lit(""))
    return F.struct(own("source_updated_at").alias("source_updated_at"), F.coalesce(own("event_start"), F.col(f"{fire}.start_date")).alias("event_start"), own("event_end").alias("event_end"), F.coalesce(own("last_detection"), F.col(f"{fire}.last_detection")).alias("last_detection"), own("event_date").alias("operational_event_date"))


def frequencies(rows: DataFrame, group: str, choice: str) -> DataFrame:
    """group, n and `counts`, a map of how often each choice was made, by name; nulls are no choice. Counts come first, so a group is as large as its choices."""
    c = rows.where(F.col(choice).isNotNull()).groupBy(group, choice).agg(F.count("*").alias("n"))
    return c.groupBy(group).agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(choice, "n")))).alias("counts"))


def config_grid(rows: DataFrame, axes: list[str]) -> DataFrame:
    """config, the axes and n of every combination of the values that each axis takes in rows, and how many rows have it; values are few, by the nature of a search."""
    counts = rows.groupBy(*axes).agg(F.count("*").alias("n"))
    sets = counts.agg(*[F.array_sort(F.collect_set(a)).alias(a) for a in axes])  # one row
    for a in axes:
        sets = sets.withColumn(a, F.explode(a))
    return sets.join(counts, axes, "left").select(F.concat_ws("_", *axes).alias("config"), *axes, F.coalesce("n", F.lit(0)).alias("n"))


def coarser(cells: DataFrame, times: int, value: str, *group: str) -> DataFrame:
    """group, row, col and the sum of value of cells `times` as wide: no count is lost, cells on the edge included."""
    return cells.groupBy(*group, *[F.floor(F.col(c) / times).cast("long").alias(c) for c in ("row", "col")]).agg(F.sum(value).alias(value))


def best_file(names: DataFrame, group: str, name: str, wanted: str) -> DataFrame:
    """group and name of the file to take of each listing: one with the wanted word before others, then the shortest name, then the lesser."""
    rank = F.struct((~F.upper(name).contains(wanted.upper())).alias("other"), F.length(name).alias("length"), F.col(name).alias("file"))
    return names.groupBy(group).agg(F.min(rank).alias("x")).select(group, F.col("x.file").alias(name))


#: The metric that a drought's own text tells, and how (fixed values).
DROUGHT_KM2, TOLD = "agricultural_drought_impact_area_km2", "source_published_event_severity_text"


def source_semantics(events: DataFrame) -> DataFrame:
    """events (type, summary, priority, alert_level, source) with what their own texts say: the alert's level, the priority that it raises, and a drought's impact area with its provenance.

    metrics and provenance are maps, null where the text tells no area.
    """
    level = parsing.alert_level(F.col("alert_level"), F.concat_ws(" ", "source", "summary"))
    km2 = F.when(F.col("type") == "Drought", parsing.drought_area_km2(F.col("summary")))
    told = F.create_map(F.lit(DROUGHT_KM2), provenance("GDACS / Global Drought Observatory", F.lit("summary"), TOLD, False, F.lit(None))).cast(PROVENANCE)
    rows = events.withColumn("__level", F.nullif(level, F.lit("")))
    return rows.withColumns({
        "priority": promoted(F.col("priority"), F.col("__level")), "alert_level": F.coalesce("__level", "alert_level"),
        "metrics": F.when(km2.isNotNull(), F.create_map(F.lit(DROUGHT_KM2), km2)), "provenance": F.when(km2.isNotNull(), told),
    }).drop("__level")


def patched_views(canonical: DataFrame, display: DataFrame, key: str) -> DataFrame:
    """The display view with the alert level and metrics of the canonical event of the same key, then with what its own texts say where it has none; both after source_semantics()."""
    of = canonical.select(F.col(key).alias("__k"), F.col("alert_level").alias("__level"), F.col("metrics").alias("__metrics"), F.col("provenance").alias("__provenance"))
    both = display.join(of, F.col(key) == F.col("__k"), "left").withColumn("alert_level", F.coalesce("__level", "alert_level"))
    both = both.withColumn("metrics", F.coalesce("__metrics", "metrics")).withColumn("provenance", F.coalesce("__provenance", "provenance"))
    return both.drop("__k", "__level", "__metrics", "__provenance").withColumn("priority", promoted(F.col("priority"), F.col("alert_level")))


def climate_documents(events: DataFrame, key: str, periods: DataFrame) -> DataFrame:
    """key, status and doc (JSON) of each event: where it is, the cell that stands for it, and a record for each period with the variables that it has.

    events (key, type, lat, lon, row, col, km), row null without a cell; periods (key, period, variable, value). A record without a value is unavailable; a document is
    complete if no record is, partial if one is, and unavailable without a cell. Periods and variables are a few.
    """
    values = periods.groupBy(key, "period").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("variable", "value"))))).alias("values"))
    record = F.struct("period", F.when(F.size("values") > 0, "ready").otherwise("unavailable").alias("status"), F.when(F.size("values") > 0, F.col("values")).alias("values"))
    listed = values.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list(record), lambda r, s: F.when(r["period"] < s["period"], -1).otherwise(1)).alias("records"))  # periods differ, maps have no order
    both = events.join(listed, F.col(key) == F.col("__k"), "left")
    records = F.coalesce("records", F.array().cast("array<struct<period:string,status:string,values:map<string,double>>>"))
    placed, ready = F.col("row").isNotNull(), F.forall("records", lambda r: r["status"] == "ready") & (F.size("records") > 0)
    both = both.withColumn("records", records).withColumn("status", F.when(~placed, "unavailable").when(ready, "complete").otherwise("partial"))
    doc = F.struct(F.col(key).alias("event_id"), "type", "status", F.struct("lat", "lon").alias("reported_location"), F.when(placed, F.struct("row", "col", F.round("km", 1).alias("km"))).alias("comparison_location"), F.when(placed, F.col("records")).alias("periods"))
    return both.select(key, "status", F.to_json(doc).alias("doc"))
