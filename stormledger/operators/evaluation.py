"""Splits, selection and statistics of the research track."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpointed, spread


#: Ranges of values or hashes that a group is dealt to, so that no group is one task.
RANGES = 256
#: Different values of a group that one task may order.
FIT = 1 << 17
#: Rows of a bootstrap's values that are broadcast at most, and how far about a group's middle draws are counted by rank, in roots of its size (20 standard deviations).
LOOKUP, WIDE = 1_000_000, 10.0


def stratified_split(rows: DataFrame, key: str, stratum: str, every: int = 3, salt: str = "split-v1") -> DataFrame:
    """rows with `split`: in each stratum, ordered by the salted SHA-256 of the key, every third row is test. Repeated keys tie and follow each other.

    The first byte of the hash deals a stratum to RANGES parts; a row's rank is that in its part after the counts of the parts before.
    """
    hashed = rows.withColumn("__h", F.sha2(F.concat(F.lit(f"{salt}|"), F.col(key).cast("string")), 256)).withColumn("__part", F.substring("__h", 1, 2))
    counts = hashed.groupBy(stratum, "__part").agg(F.count("*").alias("n"))  # RANGES rows a stratum
    before = counts.select(F.col(stratum).alias("__stratum"), F.col("__part").alias("__of"), (F.sum("n").over(Window.partitionBy(stratum).orderBy("__part")) - F.col("n")).alias("__before"))
    ranked = hashed.withColumn("__rank", F.row_number().over(Window.partitionBy(stratum, "__part").orderBy("__h", key)))
    joined = ranked.join(before, F.col(stratum).eqNullSafe(F.col("__stratum")) & F.col("__part").eqNullSafe(F.col("__of")))
    return joined.withColumn("split", F.when((F.col("__before") + F.col("__rank")) % every == 0, "test").otherwise("train")).drop("__h", "__part", "__rank", "__before", "__stratum", "__of")


def pareto_front(configs: DataFrame, key: str, low: str, high: str, eps: float = 1e-12) -> DataFrame:
    """Configurations that none beats in both `low` (the smaller the better) and `high`, differences up to eps being none, with `gap`, the distance to the ideal point.

    Ordered by low, the running best of high decides: first over RANGES ranges of low, then inside each range. The ideal
    point has the least low and the best high of the front, both scaled to the front's spread. Nulls are never on the front.
    """
    clean = configs.where(F.col(low).isNotNull() & F.col(high).isNotNull())
    span = clean.agg(F.min(low).alias("__lo"), F.max(low).alias("__hi"))  # one row
    part = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col(low) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * RANGES), F.lit(RANGES - 1))).otherwise(F.lit(0))
    dealt = clean.crossJoin(F.broadcast(span)).withColumn("__part", part).drop("__lo", "__hi")
    parts = dealt.groupBy("__part").agg(F.max(high).alias("__max"))  # RANGES rows
    earlier = parts.select("__part", F.max("__max").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    left = dealt.join(F.broadcast(earlier), "__part").where(F.col("__before").isNull() | (F.col(high) > F.col("__before") + eps))
    here = Window.partitionBy("__part").orderBy(low)
    best = F.max(high).over(here.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    lower = left.groupBy("__part", low).agg(F.max(high).alias("__m"))
    lower = lower.select("__part", low, F.max("__m").over(here.rowsBetween(Window.unboundedPreceding, -1)).alias("__in"))
    front = left.withColumn("__best", best).join(lower, ["__part", low]).where((F.col(high) >= F.col("__best") - eps) & (F.col("__in").isNull() | (F.col(high) > F.col("__in") + eps)))
    ends = front.agg(F.min(low).alias("__a"), F.max(low).alias("__b"), F.min(high).alias("__c"), F.max(high).alias("__d"))  # one row
    away = lambda x, at, span: F.when(span > eps, (x - at) / span).otherwise(0.0)
    gap = F.sqrt(F.pow(away(F.col(low), F.col("__a"), F.col("__b") - F.col("__a")), 2) + F.pow(away(F.col(high), F.col("__d"), F.col("__d") - F.col("__c")), 2))
    return front.crossJoin(F.broadcast(ends)).select(key, low, high, gap.alias("gap"))


def exact_quantiles(values: DataFrame, group: str, value: str, shares: dict[str, float], levels: int = 2) -> DataFrame:
    """group, n and for each name the exact quantile, linear between the two ranks beside it; nulls, NaN and rows without a group do not count.

    Equal values are one row with a count. A group's span is cut into RANGES; counts tell which ranges hold the wanted
    ranks, and only their rows go on, cut again over the span that they really have. What is left is ordered, each range
    apart. So no aggregate keeps a group's values, and neither ties nor a few far values leave them in one range. What one
    level leaves for the next is written, as the plan would double with each. Where no group has more than FIT different values,
    which is counted, they are ordered as they are.
    """
    v = values.select(group, F.col(value).cast("double").alias("v")).where(f"{group} is not null and v is not null and not isnan(v)")
    rows = checkpointed(v.groupBy(group, "v").agg(F.count("*").alias("c")))
    sizes = rows.groupBy(group).agg(F.sum("c").alias("n"))
    names = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("n") - 1)).alias("at")) for name, q in shares.items()])
    ranks = sizes.select(group, F.explode(names).alias("x")).select(group, "x.name", "x.at")
    wanted = ranks.select(group, "name", "at", F.lit(0).cast("long").alias("before"), F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    keys = [group]
    most = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0  # one number
    levels = levels if most > FIT else 0
    for level in range(levels):
        part = f"part{level}"
        span = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        cut = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES), F.lit(RANGES - 1))).otherwise(F.lit(0))
        dealt = rows.join(span, keys).withColumn(part, cut.cast("int")).drop("lo", "hi")
        counts = dealt.groupBy(*keys, part).agg(F.sum("c").alias("m"))  # RANGES rows a key
        counts = counts.withColumn("inner", F.sum("m").over(Window.partitionBy(*keys).orderBy(part)) - F.col("m"))
        held = wanted.join(counts, keys).withColumn("before", F.col("before") + F.col("inner"))
        wanted = checkpointed(held.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m"))).drop("inner", "m"))
        keys = [*keys, part]
        rows = dealt.join(wanted.select(*keys).distinct(), keys, "left_semi")
        rows = checkpointed(rows) if level < levels - 1 else rows
    upto = rows.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("v")))
    got = wanted.join(upto, keys).where((F.col("rank") >= F.col("before") + F.col("upto") - F.col("c")) & (F.col("rank") < F.col("before") + F.col("upto")))
    # the upper of the two ranks counts by the part of a step beyond the lower
    weight = F.when(F.col("rank") == F.floor("at"), 1 - (F.col("at") - F.floor("at"))).otherwise(F.col("at") - F.floor("at"))
    sums = got.groupBy(group).agg(*[F.sum(F.when(F.col("name") == name, weight * F.col("v"))).alias(name) for name in shares])
    return sizes.join(sums, group)


def top_cells(scores: DataFrame, group: str, cell: str, score: str, k: int) -> DataFrame:
    """The k best cells of each group by score with their `rank`, ties to the greater cell; a group limit, so only k a task go to the shuffle. Null scores are masked."""
    ranked = scores.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.desc(cell))))
    return ranked.where(F.col("rank") <= k)


def cells_of_area(scores: DataFrame, group: str, cell: str, score: str, area: str, cell_area: float, least: float = 0.8) -> DataFrame:
    """The best cells of each group, as many as its area holds (rounded half to even, one at least, no more than it has), with `rank` and `wanted`.

    A null score is masked. A group whose cells with a score are fewer than `least` of those wanted has no rows: too much of it is masked.
    """
    sizes = scores.groupBy(group).agg(F.count("*").alias("__all"), F.count(score).alias("__seen"), F.max(area).alias("__area"))
    wanted = F.least(F.greatest(F.lit(1), F.rint(F.col("__area") / cell_area)), F.col("__all")).cast("long")
    fit = sizes.withColumn("wanted", wanted).where(F.col("__seen") >= F.greatest(F.lit(1), F.floor(least * F.col("wanted")))).select(F.col(group).alias("__group"), "wanted")
    ranked = scores.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.desc(cell))))
    return ranked.join(fit, F.col(group) == F.col("__group")).where(F.col("rank") <= F.col("wanted")).drop("__group")


def paired_bootstrap(pairs: DataFrame, group: str, key: str, a: str, b: str, resamples: int = 5000, seed: int = 20260914) -> DataFrame:
    """group, n, the median of the differences a - b and the 2.5 % and 97.5 % quantiles of that median over resamples with replacement.

    A draw is a hash of seed, resample and place, so it does not depend on partitions. Pairs are numbered by key in each
    group; rows without both values do not count. Resamples are spread over all tasks before their draws are made, and a draw is
    looked up as the rank of its value, in a table that is broadcast up to LOOKUP rows (counted). No draw is kept: each resample counts
    them by rank about its group's middle and by side beyond. Should a median lie beyond, its resample alone is counted by rank throughout.
    """
    d = pairs.select(group, key, (F.col(a) - F.col(b)).alias("d")).where(f"d is not null and not isnan(d) and {group} is not null")
    d = checkpointed(d.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1).withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("d", "i")) - 1))
    sizes = checkpointed(d.groupBy(group).agg(F.count("*").alias("n")))
    ranks = d.select(group, "i", "r")
    ranks = F.broadcast(ranks) if d.count() <= LOOKUP else ranks.hint("merge")
    i = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "b", "j"), 256), 1, 12), 16, 10).cast("long") % F.col("n")

    def middles(samples: DataFrame, width: Column) -> DataFrame:
        """group, n, b and the two ranks `r` about the median of samples (group, n, b): -1 or n where it is not within width of the group's middle."""
        draws = spread(samples).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("i", i)
        r = F.when(F.col("r") < F.col("n") / 2 - width, -1).when(F.col("r") > F.col("n") / 2 + width, F.col("n")).otherwise(F.col("r"))
        counts = draws.join(ranks, [group, "i"]).groupBy(group, "n", "b", r.alias("r")).agg(F.count("*").alias("c"))
        upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(group, "b").orderBy("r"))).withColumn("at", F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))))
        return checkpointed(upto.where((F.col("at") >= F.col("upto") - F.col("c")) & (F.col("at") < F.col("upto"))).select(group, "n", "b", "r"))

    found = middles(sizes.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))), WIDE * F.sqrt("n"))
    beyond = found.where("r = -1 or r = n").select(group, "n", "b").distinct()
    if not beyond.isEmpty():
        found = found.join(beyond, [group, "b"], "left_anti").unionByName(middles(beyond, F.col("n")))
    medians = found.join(d.select(group, F.col("r").cast("long").alias("r"), "d"), [group, "r"]).groupBy(group, "b").agg(F.sum(F.col("d") * 0.5).alias("m"))
    ci = exact_quantiles(medians, group, "m", {"low": 0.025, "high": 0.975}).drop("n")
    own = exact_quantiles(d, group, "d", {"median": 0.5})
    return own.join(ci, group)


def greedy_dedupe(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """event_id and anchor: events scanned from the latest on, each attached to the first anchor that a pair links it to, else an anchor itself.

    pairs: (event_id_a, event_id_b), each once or more; where they have us_a and us_b, the events' times in microseconds, events are not
    joined to learn them. The scan's outcome is found in rounds: an event that is the earlier one of open links only is an anchor, its
    later partners are none, and their links go. A round is joins of two written tables, links being two numbers; no component is one
    group. Rounds follow the longest chain of events that depend on each other, each within reach of the one before.
    """
    if "us_a" not in pairs.columns:
        ends = [events.select(F.col("event_id").alias(f"event_id_{x}"), F.unix_micros("ts").alias(f"us_{x}")).hint("merge") for x in "ab"]  # as many as the events
        pairs = pairs.join(ends[0], "event_id_a").join(ends[1], "event_id_b")
    a, b = (F.struct(F.negative(f"us_{x}").alias("order"), F.col(f"event_id_{x}").alias("event_id")) for x in "ab")
    first, second = F.least(a, b), F.greatest(a, b)
    links = checkpointed(pairs.select(second["event_id"].alias("later"), first["event_id"].alias("earlier"), first["order"].alias("order")))
    left, absorbed = links.select("later", "earlier"), []
    while not left.isEmpty():
        new = left.select("earlier").distinct().join(left.select(F.col("later").alias("earlier")), "earlier", "left_anti")
        gone = checkpointed(left.join(new, "earlier", "left_semi").select(F.col("later").alias("event_id")).distinct())
        absorbed.append(gone)
        left = checkpointed(left.join(gone.withColumnRenamed("event_id", "later"), "later", "left_anti").join(gone.withColumnRenamed("event_id", "earlier"), "earlier", "left_anti"))
    if absorbed:
        gone = reduce(DataFrame.unionByName, absorbed)
        links = links.join(gone.withColumnRenamed("event_id", "earlier"), "earlier", "left_anti")
    # an anchor has no anchor before it, so it has no row in attached
    attached = links.groupBy(F.col("later").alias("event_id")).agg(F.min(F.struct("order", "earlier"))["earlier"].alias("anchor"))
    return events.select("event_id").join(attached, "event_id", "left").withColumn("anchor", F.coalesce("anchor", "event_id"))
