"""Scores, contrasts, selections and holdouts of the research track, and climate series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormledger.functions.columns import saturation_pressure
from stormledger.functions.parsing import safe_ratio
from stormledger.operators.evaluation import exact_quantiles
from stormledger.operators.policy import fire_qc_pass


def skill(cells: DataFrame, event: str, configs: dict[str, Column], share: float = 0.8) -> DataFrame:
    """event, config, enrichment, precision, recall and csi of each configuration's cells against the event's high ones.

    cells (event, value, area, control): high is what reaches the event's quantile of `share`, to nine digits; control cells give the
    background mean. configs: which cells a configuration predicts. One pass of partial sums for all configurations.
    """
    top = exact_quantiles(cells, event, "value", {"threshold": share}).select(event, "threshold")
    c = cells.join(top, event).withColumn("high", F.round("value", 9) >= F.round("threshold", 9))
    area = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("area"))), F.lit(0.0))
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("config"), inside.alias("inside")) for name, inside in configs.items()]))
    c = c.select("*", rows.alias("x")).select("*", "x.config", "x.inside")
    s = c.groupBy(event, "config").agg(area(F.col("inside") & F.col("high")).alias("both"), area(F.col("inside")).alias("predicted"), area(F.col("high")).alias("seen"), F.avg(F.when(F.col("inside"), F.col("value"))).alias("mean"), F.avg(F.when(F.col("control"), F.col("value"))).alias("background"))
    both, pred, seen = F.col("both"), F.col("predicted"), F.col("seen")
    return s.select(event, "config", safe_ratio(F.col("mean"), F.col("background")).alias("enrichment"), safe_ratio(both, pred).alias("precision"), safe_ratio(both, seen).alias("recall"), safe_ratio(both, pred + seen - both).alias("csi"), pred.alias("area"))


def contrasts(cells: DataFrame, event: str, first: str = "downwind", least: float = 0.5) -> DataFrame:
    """Of each event the mean of `first` less that of its controls, its rank and whether it is the greatest.

    cells (event, orientation, value, area), value null where nothing was seen. An orientation counts if `least` of its area
    was seen; an event is eligible if the first one counts and two controls do.
    """
    seen = F.sum(F.when(F.col("value").isNotNull(), F.col("area")))
    o = cells.groupBy(event, "orientation").agg(F.avg("value").alias("mean"), F.coalesce(safe_ratio(seen, F.sum("area")), F.lit(0.0)).alias("coverage"))
    counts = F.col("coverage") >= least
    mine, other = counts & (F.col("orientation") == first), counts & (F.col("orientation") != first)
    e = o.groupBy(event).agg(F.max(F.when(mine, F.col("mean"))).alias("down"), F.count_if(other).alias("controls"), F.avg(F.when(other, F.col("mean"))).alias("control_mean"), F.collect_list(F.when(counts, F.col("mean"))).alias("means"))  # a few orientations
    fit = F.col("down").isNotNull() & (F.col("controls") >= 2)
    rank = 1 + F.size(F.filter("means", lambda m: m > F.col("down")))
    return e.select(event, fit.alias("eligible"), "controls", F.when(fit, F.col("down") - F.col("control_mean")).alias("difference"), F.when(fit, rank).cast("long").alias("rank"), F.when(fit, rank == 1).alias("is_max"))


def best_configs(scores: DataFrame, group: str, config: str, *by: str) -> DataFrame:
    """Of each group the configuration that is greatest in the first of `by`, ties by the others in turn, then the lesser name; nulls come last."""
    rank = F.struct(*[F.negative(F.coalesce(F.col(c), F.lit(float("-inf")))).alias(c) for c in by], F.col(config))
    return scores.groupBy(group).agg(F.min(rank).alias("x")).select(group, F.col(f"x.{config}").alias(config))


def modal_config(folds: DataFrame, config: str, quality: DataFrame, *by: str) -> DataFrame:
    """The configuration that most folds chose, ties by the greatest of `by` in quality, then the lesser name: one row."""
    n = folds.groupBy(config).agg(F.count("*").alias("folds")).join(quality, config, "left")
    return n.orderBy(F.desc("folds"), *[F.desc_nulls_last(c) for c in by], config).limit(1).select(config, "folds")


def candidates(events: DataFrame, key: str, area: str, mapped: str, qc: str, salt: str, limit: int, least_ha: float = 10_000.0) -> DataFrame:
    """key and h of the fires of a benchmark: type Wildfire, least_ha or more, a mapped footprint and a strict pass of its QC, each once, the first by a salted hash."""
    fit = (F.col("type") == "Wildfire") & (F.col(area) >= least_ha) & F.col(mapped).isNotNull() & fire_qc_pass(F.col(qc))
    return events.where(fit).select(key).distinct().withColumn("h", F.sha2(F.concat(F.lit(f"{salt}|"), key), 256)).orderBy("h").limit(limit)


def prospective(events: DataFrame, now: Column, least_ha: float, fresh_hours: float, limit: int) -> DataFrame:
    """The largest fires of events (id, type, lat, lon, burned_area_ha, footprint, qc, last_detection) that are fit for a trial: a ready footprint, QC passed, detected within fresh_hours; ties to the greater id."""
    fresh = F.unix_micros("last_detection") >= F.unix_micros(now) - int(fresh_hours * 3_600_000_000)
    fit = (F.col("type") == "Wildfire") & (F.col("burned_area_ha") >= least_ha) & F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("footprint") == "ready") & (F.col("qc") == "pass") & fresh
    return events.where(fit).orderBy(F.desc("burned_area_ha"), F.desc("id")).limit(limit)


def universe_faults(frozen: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """key and fault of what differs between a frozen set of names and the present one: missing or unlisted. No rows: no drift."""
    a, b = (df.select(key).distinct().withColumn(name, F.lit(True)) for df, name in ((frozen, "a"), (have, "b")))
    both = a.join(b, key, "full_outer").where("a is null or b is null")
    return both.select(key, F.when(F.col("b").isNull(), "missing").otherwise("unlisted").alias("fault"))


def forward_window(events: DataFrame, cycles: DataFrame, horizon: int, slack_hours: float = 3.1, step: int = 3) -> DataFrame:
    """Of each event (id, ts) the forecast cycle (cycle, leads) whose start lead is nearest to it and has every lead of the horizon: by offset, then the newest.

    cycles are dealt by day; a cycle reaches as far as its last lead, so an event looks into the days that this covers, and the next one.
    """
    longest = cycles.agg(F.max(F.array_max("leads")).alias("m")).first().m or 0  # one number
    days = int(longest // 24) + 1
    c = cycles.select("cycle", "leads", F.to_date("cycle").alias("day"))
    e = events.withColumn("day", F.explode(F.array(*[F.date_sub(F.to_date("ts"), k) for k in range(-1, days + 1)])))
    x = e.join(c, "day").withColumn("ahead", (F.unix_seconds("ts") - F.unix_seconds("cycle")) / 3600.0).where(F.col("ahead") >= -slack_hours)
    starts = F.transform("leads", lambda h: F.struct(F.abs(h - F.col("ahead")).alias("offset"), h.alias("lead")))
    x = x.withColumn("start", F.array_min(starts)).where(F.col("start.offset") <= slack_hours)
    need = F.sequence(F.col("start.lead"), F.col("start.lead") + horizon, F.lit(step))
    x = x.where(F.size(F.array_except(need, "leads")) == 0)
    best = x.groupBy("id").agg(F.min(F.struct(F.round("start.offset", 6).alias("offset"), F.negative(F.unix_seconds("cycle")).alias("newest"), F.col("start.lead").alias("lead"), "cycle")).alias("b"))
    return events.select("id").join(best, "id", "left").select("id", "b.cycle", "b.lead", "b.offset")


def daily_forecast(steps: DataFrame, key: list[str]) -> DataFrame:
    """key, mean temperature, vapour pressure deficit and precipitation of a cycle's day from its 3-hourly steps (hours, t, dew, total in m).

    The ends of the day weigh half; precipitation is the total's growth in mm; a cycle without both ends or with a step missing has nulls.
    """
    w = F.when(F.col("hours").isin(0, 24), 0.5).otherwise(1.0)
    at = lambda h: F.max(F.when(F.col("hours") == h, F.col("total")))
    d = steps.where(F.col("hours").between(0, 24)).groupBy(*key).agg(F.count("*").alias("n"), (F.sum(w * F.col("t")) / F.sum(w)).alias("t"), (F.sum(w * saturation_pressure(F.col("dew"))) / F.sum(w)).alias("vap"), F.greatest(F.lit(0.0), (at(24) - at(0)) * 1000).alias("pre"))
    whole = F.col("n") == 9
    return d.select(*key, F.when(whole, F.col("t")).alias("tmp"), F.when(whole, F.greatest(F.lit(0.0), saturation_pressure(F.col("t")) - F.col("vap"))).alias("vpd"), F.when(whole, F.col("pre")).alias("pre"))


def mean_month_days(start: int, end: int, month: Column) -> Column:
    """Mean number of days of a month over years, both ends included."""
    days = F.transform(F.sequence(F.lit(start), F.lit(end)), lambda y: F.day(F.last_day(F.make_date(y, month, F.lit(1)))).cast("double"))
    return reduce(lambda a, b: a + b, [F.element_at(days, k + 1) for k in range(end - start + 1)]) / (end - start + 1)


def climate_delta(kind: Column, now: Column, normal: Column) -> Column:
    """The change from a normal: in percent for precipitation (a difference where the normal is none), else the difference."""
    percent = F.when(F.abs(normal) < 1e-9, now - normal).otherwise((now - normal) / normal * 100)
    return F.when(kind == "pre", percent).otherwise(now - normal)


def trailing_mean(daily: DataFrame, key: str, day: str, value: str, days: int = 7) -> DataFrame:
    """daily with the mean of the last `days` days of each key, null unless each of them has a value."""
    w = Window.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(-(days - 1), 0)
    return daily.withColumn("mean", F.when(F.count(value).over(w) == days, F.avg(value).over(w)))
