"""Mixing sources to target weights: systematic sampling of documents within each source.

Targets: sources in order of code point, null last, weigh WEIGHTS in turn and share PERCENT of all sizes by weight. A target
stops at MOST times its source's size; what is over is shared anew by weight among the others until none is above.

Sampling: every document of a source is expected target / source_size times. Documents stand in order of (size, doc_id), so
that each stretch of similar sizes gives its share; their expected copies are summed up from the first, one offset by hash
of the source is added, and a document is taken once for every integer that its stretch crosses. So a source's taken words differ
from its target by about its longest document at most, and a document is taken at most MOST times.

Expected copies are integers of 2^-UNITS, so sums are exact in any order. The prefix sums come from ranges: rows are
dealt by (source, size, doc_id) into ranges, each range has a sum for each source, and those are added up before it; a hot
source is spread over many ranges.

Nulls: a null text has size 0; documents without a source form one. Documents of size 0 are counted among the copies, with no words.
Repeated rows count each, and which of two equal rows is taken does not show. If all sizes are 0 every target is 0. An
empty table gives an empty result. Only the columns named by keep are carried; ones named as a result column give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, written

WEIGHTS, PERCENT, MOST, UNITS = (5, 2, 1), 150, 2, 36
WORD = r"[^\x20\x09-\x0D]+"
#: Tasks that a source's rows are dealt to where the targets are too many to broadcast.
SALTS = 64


def by_ranges(rows: DataFrame, group: str, order: list[Column], value: str, out: str) -> DataFrame:
    """rows with `out`: the sum of value over the rows of the same group before each, in order, from ranges of (group, order).

    The order must tell rows apart or leave only equal ones untold. The sum of one range must fit a long; the sums of ranges are decimals.
    """
    dealt = written(rows.repartitionByRange(F.col(group).asc_nulls_last(), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(group, "__range").agg(F.sum(F.col(value).cast("decimal(38,0)")).alias("__sum"))
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row a group and a range, and only groups over several ranges have more than one
    starts = written(sums.select(F.col(group).alias("__g"), F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start")), "range-starts")
    local = Window.partitionBy(group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("__local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    same = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r"))
    return summed.join(sized(starts, row_bytes=96), same).withColumn(out, F.col("__start") + F.col("__local")).drop("__g", "__r", "__range", "__start", "__local")


def targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """source, source_size and target of each source. percent may be 100 * most at the greatest."""
    if percent > 100 * most:
        raise ValueError("the sources cannot give that much")
    totals = written(sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size")).withColumn("__one", F.lit(1)).withColumn("__all", F.lit(0)), "source-sizes")
    # the place of a source among all: a prefix sum of ones over one group, dealt by the name
    place = by_ranges(totals, "__all", [F.col(source).asc_nulls_last()], "__one", "__place")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("__place", F.lit(len(weights))) + 1).cast("int"))
    weighed = written(place.select(source, "source_size", turn.cast("long").alias("weight")), "source-weights")
    level, cap, total = 0.0, F.col("source_size") * most, None
    while True:  # one row a round; a round ends it or caps another source
        above = F.lit(level) * F.col("weight") > cap
        row = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, cap)).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        total = row["all"] or 0
        new = (total * percent / 100 - (row["capped"] or 0)) / row["free"] if row["free"] else level
        if new <= level:
            break
        level = new
    return weighed.select(source, "source_size", F.least(F.lit(level) * F.col("weight"), cap.cast("double")).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The one random offset of a source, in units: the first 36 bits of a digest of seed and source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, UNITS // 4), 16, 10).cast("long")


def systematic(rows: DataFrame, shares: DataFrame, source: str = "source", size: str = "size", doc_id: str = "doc_id", seed: str = "mix") -> DataFrame:
    """rows with source_size, target and copies, by the targets of their sources; rows is a written table with a column __row that tells equal rows apart."""
    unit = F.lit(float(1 << UNITS))
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * unit)).otherwise(0).cast("long")
    expected = joined(rows, shares, source).withColumn("__expected", rate)
    placed = by_ranges(expected, source, [F.col(size), F.col(doc_id).asc_nulls_first(), F.col("__row")], "__expected", "__before")
    start = F.pmod(F.col("__before") + offset(F.col(source), seed), F.lit(1 << UNITS).cast("decimal(38,0)")).cast("long")
    return placed.withColumn("copies", F.shiftright(start + F.col("__expected"), UNITS)).drop("__before", "__expected")


def joined(rows: DataFrame, shares: DataFrame, source: str) -> DataFrame:
    """Targets at the rows: broadcast while their counted size allows it; beyond that a source is dealt to SALTS tasks."""
    named = written(shares.withColumnRenamed(source, "__source"), "targets")
    same, small = F.col(source).eqNullSafe(F.col("__source")), sized(named, row_bytes=96)
    if small is named:
        rows = rows.withColumn("__salt", F.pmod("__row", F.lit(SALTS)))
        small = named.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        same = same & (F.col("__salt") == F.col("__salt2"))
    return rows.join(small, same).drop("__source", "__salt", "__salt2")


def mixed(docs: DataFrame, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep, source, size, source_size, target, copies and taken (copies * size) of each row of docs (doc_id, text, source)."""
    own = ("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    chosen = docs.select("doc_id", "source", *[c for c in keep if c not in own], words.alias("size"), F.monotonically_increasing_id().alias("__row"))
    rows = written(chosen, "mix-sizes")
    taken = systematic(rows, targets(rows), seed=seed).withColumn("taken", F.col("copies") * F.col("size"))
    return taken.drop("__row")


def emitted(mix: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, with `copy` from 0."""
    return mix.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS INT)] AS w FROM t),
o AS (SELECT *, row_number() OVER r AS k, sum(2 * source_size) OVER r AS caps, sum(w) OVER r AS ws, sum(source_size) OVER () AS total, sum(w) OVER () AS weights
      FROM w WINDOW r AS (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT CAST(total * 150 / 100 - (caps - 2 * source_size) AS DOUBLE) / CAST(weights - (ws - w) AS DOUBLE) AS level FROM o
      WHERE CAST(total * 150 / 100 - (caps - 2 * source_size) AS DOUBLE) / CAST(weights - (ws - w) AS DOUBLE) * w <= 2 * source_size ORDER BY k LIMIT 1),
g AS (SELECT source, source_size, least(level * w, CAST(2 * source_size AS DOUBLE)) AS target FROM w CROSS JOIN l),
e AS (SELECT d.doc_id, d.source, size, source_size, target,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * {float(1 << UNITS)}) AS BIGINT) ELSE 0 END AS e,
             CAST('0x' || substr(md5('mix:' || coalesce('s' || d.source, 'null')), 1, 9) AS BIGINT) AS u
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, (coalesce(sum(e) OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + u) % {1 << UNITS} AS b FROM e)
SELECT doc_id, size, source_size, target, CAST(((b + e) // {1 << UNITS}) * size AS BIGINT) AS taken FROM p
"""
