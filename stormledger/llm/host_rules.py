"""Quality rules with host-level verdicts: failures by host, shrunk by an empirical beta prior, joined back to documents.

A host's rate has a beta posterior. The host is rejected if the rate is, with some 95 % (LEVEL, by the normal
approximation), over TIMES the mean of all hosts or over MAX_RATE. So a host with few documents needs nearly all of them to fail, and among hosts that are all
alike none is rejected, whatever their common rate up to MAX_RATE.

Nulls: a null text has no words and fails the base rule; documents without a host form one host of their own, which gets
no verdict (they stand by their own rule). Repeated rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, with_fields, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host is rejected if the lower end of its failure rate (LEVEL deviations under the posterior mean) is over TIMES the mean of the hosts, or over MAX_RATE.
TIMES, MAX_RATE, LEVEL = 2.0, 0.5, 1.645
#: Tasks that a host's documents are dealt to where verdicts are too many to broadcast.
SALTS = 64
#: White space of words (a fixed value), and what counts as a symbol.
BLANKS, SYMBOLS = " \t\n\v\f\r", b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at the six blanks only
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    threes = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(threes)) < len(threes):
        times = Counter(threes)
        again = np.fromiter((times[t] > 1 for t in threes), bool, len(threes))
        marked = np.zeros(len(words), bool)
        for k in range(3):
            marked[k : k + len(threes)] |= again
        repeat = int(marked.sum())
    return len(words), chars, symbols, dup_lines, repeat


def with_counts(docs: DataFrame, host: str, keep: list[str]) -> DataFrame:
    """keep, `host` and COUNTS of each row; the texts are read once and go no further."""
    chosen = docs.select(*keep, F.col(host).cast("string").alias("__host"), F.col("text").alias("__text"))
    fields = with_fields(chosen.schema.fields[:-1], ", ".join(f"{c} long" for c in COUNTS))

    def run(batches):
        for batch in batches:
            got = [text_counts(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            cells = [pa.array([g[k] for g in got], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cells], names=[*batch.schema.names[:-1], *COUNTS])

    return chosen.mapInArrow(run, fields)


def host_rates(counted: DataFrame) -> DataFrame:
    """Per host: n, failures, the failure rate shrunk to the mean of all hosts, its lower end and the limit for that.

    The beta prior has the mean m and variance v of the host rates (method of moments, hosts weigh alike, both over hosts
    with a name); its strength is m(1-m)/v - 1, held between 1 and 1000.
    """
    hosts = counted.where(F.col("__host").isNotNull()).groupBy("__host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    strength = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(1000.0))
    prior = prior.select("m", strength.alias("strength"))
    shrunk = (F.col("host_failures") + F.col("strength") * F.col("m")) / (F.col("host_docs") + F.col("strength"))
    low = F.col("host_rate") - LEVEL * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("host_docs") + F.col("strength") + 1))
    rated = hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", shrunk).withColumn("host_low", low)  # one row
    return rated.withColumn("host_limit", F.least(TIMES * F.col("m"), F.lit(MAX_RATE))).drop("m", "strength")


def host_rules(docs: DataFrame, host: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, COUNTS, base_failed, host_rate (null without a host) and kept of each row of docs (text, host); kept columns named like these give way."""
    counted = with_counts(docs, host, [c for c in keep if c not in (*COUNTS, "base_failed", "host_rate", "kept")])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counted = written(counted.withColumn("base_failed", failed), "host-counts")
    verdicts = written(host_rates(counted).select("__host", "host_rate", (F.col("host_low") > F.col("host_limit")).alias("__bad")), "host-verdicts")
    return joined_back(counted, verdicts).withColumn("kept", ~F.col("base_failed") & ~F.coalesce("__bad", F.lit(False))).drop("__host", "__bad")


def joined_back(counted: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts at the documents: broadcast while their counted size allows it; beyond that a host is dealt to SALTS tasks, so that a hot one is no single task."""
    small = sized(verdicts, row_bytes=96)
    if small is not verdicts:
        return counted.join(small, "__host", "left")
    salted = counted.withColumn("__salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), F.lit(SALTS)))
    spread = verdicts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(spread, ["__host", "__salt"], "left").drop("__salt")


ORACLE = """
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
m AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r CROSS JOIN (VALUES (0), (1), (2)) k(k) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(m.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN m USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS BIGINT)) AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
b AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM h),
a AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(1000.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS k FROM b),
v AS (SELECT source, (bad + k * m) / (n + k) AS r, n + k + 1 AS s, least(2.0 * m, 0.5) AS top FROM h CROSS JOIN a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(r - 1.645 * sqrt(r * (1 - r) / s) > top, false) AS kept
FROM f LEFT JOIN v USING (source)
"""
