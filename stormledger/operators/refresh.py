"""What a new snapshot changes, and how little of it has to be made again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a fingerprint's rows are dealt to, so that no task holds all of them.
PARTS = 4096
#: Fields that change without a change of content, at any depth (fixed values).
VOLATILE = (
    "generated_at", "calculated_at", "checked_at", "fetched_at", "retrieved_at", "last_seen", "updated", "observations",
    "climate_context", "exposure", "asset_exposure", "footprint", "footprint_qc", "source_metrics", "display_eligible", "display_rule",
)


def semantic(events: DataFrame) -> DataFrame:
    """id and `row`, the fields whose change invalidates products: times to the second, places to 5 digits, areas to 1, blanks collapsed."""
    text = lambda c: F.nullif(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")), F.lit(""))
    row = F.struct(*[text(c).alias(c) for c in ("id", "origin", "source_id", "type", "title", "alert")], F.unix_seconds("ts").alias("ts"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.round("burned_area_ha", 1).alias("burned_area_ha"))
    return events.select("id", row.alias("row"))


def fingerprint(rows: DataFrame, row: str = "row") -> DataFrame:
    """One row: n, and a SHA-256 of the SHA-256 of all rows, whatever their order. Rows are dealt to PARTS by their hash; a part's sorted hashes give its digest."""
    hashed = rows.select(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias("h"))
    parts = hashed.groupBy(F.substring("h", 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.count("*").alias("n"))
    return parts.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), ""), 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """id and change of the semantic rows (id, row) that differ."""
    old, new = (df.select("id", F.xxhash64(F.to_json("row", {"ignoreNullFields": "false"})).alias(n)) for df, n in ((before, "old"), (after, "new")))
    both = old.join(new, "id", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("id", change.alias("change")).where("change is not null")


def affected(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """id, change, canonical and `unresolved` of the changed sources: the canonical events of after that hold one, now or before.

    before and after: (canonical, source), the members of each canonical event. A source that is still there and belongs to
    no canonical event is unresolved, so nothing less than a full run is safe.
    """
    alive = after.select("canonical").distinct()
    links = after.unionByName(before.join(alive, "canonical", "left_semi")).select("canonical", F.col("source").alias("id")).distinct()
    found = changes.join(links, "id", "left")
    return found.withColumn("unresolved", F.col("canonical").isNull() & (F.col("change") != "removed"))


def scope(found: DataFrame, canonical: DataFrame, share: float, least: int, most: int | None = None) -> DataFrame:
    """One row: sources and canonical events that changed, unresolved ones, the threshold and the mode none, incremental or full with its reason."""
    counts = found.agg(F.countDistinct("id").alias("sources"), F.countDistinct("canonical").alias("events"), F.countDistinct(F.when(F.col("unresolved"), F.col("id"))).alias("unresolved"))
    one = counts.crossJoin(F.broadcast(canonical.agg(F.countDistinct("canonical").alias("n"))))  # one row each
    cap = F.greatest(F.lit(least), F.ceil(share * F.col("n")))
    cap = F.when(F.col("n") > 0, F.least(F.lit(most), cap) if most else cap).otherwise(0).cast("long")
    one = one.withColumn("threshold", cap)
    mode = F.when(F.col("sources") == 0, "none").when((F.col("unresolved") == 0) & (F.col("events") <= F.col("threshold")), "incremental").otherwise("full")
    why = F.when(F.col("sources") == 0, "no_semantic_change").when(F.col("unresolved") > 0, "unresolved_sources").when(F.col("events") > F.col("threshold"), "too_many_events").otherwise("few_events")
    return one.withColumn("mode", mode).withColumn("reason", why)


def latest_cycle(steps: DataFrame, day: str, whole: Column, days: int, by: str | None = None) -> DataFrame:
    """day (and by) and `cycle`, the latest day up to it, at most `days` back, that is whole; null if there is none. steps: a row a day (and by)."""
    keys = [by] if by else []
    # an ordered pass in each range of days, into which the whole days just before it are carried
    span = max(32, days)
    known = steps.select(*keys, day, F.unix_date(day).alias("__d"), F.when(whole, F.unix_date(day)).alias("__w")).withColumn("__p", F.floor(F.col("__d") / span))
    carried = known.where("__w is not null").select(*keys, F.lit(None).cast("date").alias(day), "__d", "__w", (F.col("__p") + 1).alias("__p"))
    w = Window.partitionBy(*keys, "__p").orderBy("__d").rangeBetween(Window.unboundedPreceding, 0)
    last = known.unionByName(carried).withColumn("__last", F.max("__w").over(w)).where(F.col(day).isNotNull())
    return last.select(*keys, day, F.when(F.col("__last") >= F.col("__d") - days, F.date_from_unix_date("__last")).alias("cycle"))


def gate(polls: DataFrame) -> DataFrame:
    """polls with what is refreshed and why: full, climate, maintenance, any and reason.

    polls: (forced, event_changed, content_changed, previous_at, current_at, prior_cycle, latest_cycle), dates or times. A forced run or a change that counts refreshes all;
    else a new forecast cycle, or a probe that found none (null), refreshes the climate. Maintenance is once a day, or forced. Changes
    that don't count are named and refresh nothing.
    """
    full = F.col("forced") | F.col("event_changed")
    due = F.col("current_at").isNotNull() & (F.col("previous_at").isNull() | (F.to_date("current_at") != F.to_date("previous_at")))
    cycle = ~full & (F.col("latest_cycle").isNull() | ~F.col("latest_cycle").eqNullSafe(F.col("prior_cycle")))
    why = F.array_compact(F.array(
        F.when(F.col("forced"), "manual_dispatch"), F.when(F.col("event_changed"), "source_semantics_changed").when(F.col("content_changed"), "source_metadata_churn_suppressed"),
        F.when(due, "new_utc_day"), F.when(cycle, "ifs_cycle_changed_or_unverified"),
    ))
    reason = F.when(F.size(why) > 0, F.array_join(why, ",")).otherwise("no_scientific_input_change")
    climate, upkeep = full | cycle, F.col("forced") | due
    return polls.withColumns({"full_refresh": full, "climate_refresh": climate, "maintenance_refresh": upkeep, "any_refresh": full | climate | upkeep, "reason": reason})


def outputs(row: DataFrame, folder: str) -> None:
    """The columns of one row as lines `name=value`, in order, booleans in small letters: what a workflow's next step reads."""
    lines = F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.lower(F.col(c).cast("string")) if row.schema[c].dataType.typeName() == "boolean" else F.col(c).cast("string"), F.lit(""))) for c in row.columns])
    row.limit(1).select(F.posexplode(lines).alias("k", "value")).coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(folder)


def replaced(previous: DataFrame, processed: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The events of current: processed rows where there are any, else the previous ones; new ones that were not processed are absent from both. `fresh` says which."""
    seeded = previous.join(current.select(key), key, "left_semi").join(processed.select(key), key, "left_anti").withColumn("fresh", F.lit(False))
    return seeded.unionByName(processed.join(current.select(key), key, "left_semi").withColumn("fresh", F.lit(True)))


def field_fill(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The union by key of two views: fields that the first lacks or has empty are those of the second."""
    fields = [c for c in first.columns if c != key]
    a, b = (df.select(key, F.struct(*fields).alias(n)) for df, n in ((first, "a"), (second, "b")))

    def filled(c: str) -> Column:
        own = F.col(f"a.{c}")
        return F.coalesce(F.when(own.cast("string") != "", own), F.col(f"b.{c}"), own).alias(c)

    return a.join(b, key, "full_outer").select(key, *map(filled, fields))


def references(views: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """key and fault of every reference that is unfit: no event for it, ready without a path, or unavailable without a reason."""
    known = views.select(key).distinct().withColumn("known", F.lit(True))
    fault = F.when(F.col("known").isNull(), "unmatched").when((F.col("status") == "ready") & (F.coalesce("path", F.lit("")) == ""), "ready_without_path")
    fault = fault.when((F.col("status") == "unavailable") & (F.coalesce("reason", F.lit("")) == ""), "unavailable_without_reason").when(~F.col("status").isin("ready", "unavailable"), "unknown_status")
    return refs.join(known, key, "left").select(key, fault.alias("fault")).where("fault is not null")
