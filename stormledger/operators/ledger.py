"""The daily ledger and what periods, reports and change gates make of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormledger.functions.columns import ALERTS, alert_rank


#: Short codes of types in identities (fixed values); another type is its own name in capitals.
TYPE_CODES = {"Flood": "FL", "Storm": "TC", "Wildfire": "WF", "Drought": "DR"}
#: Origins whose ids identify an event, the first one that has any (fixed values).
ORIGINS = ("gdacs", "cems", "eonet")


def type_code(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in TYPE_CODES.items() for x in p])[kind], F.upper(F.coalesce(kind, F.lit("EV"))))


def stable_id(kind: Column, members: Column, own_id: Column) -> Column:
    """origin:CODE:source id by the first of ORIGINS with a member, its least source id; else a digest of all members, or of the event's id.

    members: array of structs (origin, source_id).
    """

    def least(origin: str) -> Column:
        return F.array_min(F.transform(F.filter(members, lambda m: F.lower(m["origin"]) == origin), lambda m: m["source_id"]))

    code = type_code(kind)
    out = F.coalesce(*[F.concat(F.lit(f"{origin}:"), code, F.lit(":"), least(origin)) for origin in ORIGINS])
    joined = F.array_join(F.array_sort(F.transform(members, lambda m: F.concat_ws(":", m["origin"], m["source_id"]))), "|")
    seed = F.coalesce(F.nullif(joined, F.lit("")), own_id, F.lit("unknown"))
    return F.coalesce(out, F.concat(F.lit("event:"), code, F.lit(":"), F.substring(F.sha1(seed), 1, 16)))


def daily(events: DataFrame, key: str = "stable_id") -> DataFrame:
    """One row per day and key: first and last observation, runs, greatest metrics, the latest ones, alert maximum. Partial sums only."""
    at = F.struct(F.unix_micros("ts"), F.col("event_id"))
    return events.groupBy("day", key).agg(
        F.min("ts").alias("first_observed"), F.max("ts").alias("last_observed"), F.count("*").alias("observations"),
        F.max("burned_area_ha").alias("max_area_ha"), F.max_by("burned_area_ha", at).alias("latest_area_ha"), F.max(alert_rank(F.col("alert"))).alias("alert_rank"),
    )


def period(ledger: DataFrame, start: str, end: str, key: str = "stable_id") -> DataFrame:
    """A ledger's rows of the days start..end merged per key; the filter reaches a ledger partitioned by day."""
    days = ledger.where((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") <= F.lit(end).cast("date")))
    merged = days.groupBy(key).agg(
        F.count("*").alias("days_observed"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("observations").alias("observations"),
        F.max("max_area_ha").alias("max_area_ha"), F.max_by("latest_area_ha", F.struct("last_observed", "day")).alias("latest_area_ha"), F.max("alert_rank").alias("alert_rank"),
    )
    return merged.withColumn("max_alert", F.element_at(F.array(F.lit(""), *map(F.lit, ALERTS)), (F.col("alert_rank") + 1).cast("int"))).drop("alert_rank")


def coverage(days: DataFrame, start: str, end: str, runs_per_day: int = 3) -> DataFrame:
    """Every day of a period with the runs seen (days: one row a run, column day) and whether that is complete."""
    calendar = days.sparkSession.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS day")
    runs = days.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy("day").agg(F.count("*").alias("runs"))
    out = calendar.join(runs, "day", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))
    return out.withColumn("covered", F.col("runs") > 0).withColumn("complete", F.col("runs") >= runs_per_day)


def fingerprint(rows: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """An order-insensitive fingerprint of each group: count, and the sum and exclusive-or of row digests, both partial aggregates."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 15), 16, 10).cast("long")
    return rows.select(*groups, digest.alias("d")).groupBy(*groups).agg(F.count("*").alias("n"), F.sum(F.col("d").cast("decimal(38,0)")).cast("string").alias("digest_sum"), F.bit_xor("d").alias("digest_xor"))


def period_events(observations: DataFrame, key: list[str]) -> DataFrame:
    """One row a key of observations (day, ts, event_id, title, alert, metric, x): days, the last title that is not empty, alert maximum, first and last day, maps of the greatest and the latest value of each metric.

    Metrics are in long form, so each is a partial maximum; a key with no value of any metric has null maps.
    """
    at = F.struct(F.unix_micros("ts"), F.col("event_id"))
    said = F.when(F.coalesce("title", F.lit("")) != "", F.col("title"))
    whole = observations.groupBy(*key).agg(
        F.countDistinct("day").alias("days"), F.max_by(said, F.when(said.isNotNull(), at)).alias("title"), F.count("*").alias("n"), F.max(alert_rank(F.col("alert"))).alias("alert_rank"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )
    metrics = observations.where("x is not null and not isnan(x)").groupBy(*key, "metric").agg(F.max("x").alias("top"), F.max_by("x", at).alias("latest"))
    maps = metrics.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("metric", "top"))).alias("metrics_max"), F.map_from_entries(F.collect_list(F.struct("metric", "latest"))).alias("metrics_latest"))
    return whole.join(maps, key, "left")
