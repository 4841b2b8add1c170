"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

The unit of an edit is a word and the edit bound is one: two lines of NEAR_WORDS words or more are near duplicates if one
word inserted, deleted or replaced makes them equal (with six words that is still a similarity over 0.8; in a shorter line
one other word is another line). Lines with a word are duplicates if they are equal. A line goes if an earlier one, by
(doc_id, hash of the text, number of the line), is its duplicate or near duplicate, kept or not. White space at a line's ends and the length of its runs make no difference.

1. Each line gets a 128-bit key, and a long one the hashes of its first and last halves. Equal lines become one row.
2. Lines within the bound share the first or the last half, so only lines with a shared half go on, with their texts.
3. These emit their deletion variants as hashed keys: the line without its i-th word, for the i of the half that isn't
   known to be shared. Equal variants of equal i are replacements, a variant equal to a whole line is an insertion. Both
   need only the earliest of a key, so a key with very many lines costs a partial minimum, not its pairs.
4. The pairs found are verified on their words; then the lines that go are cut out of their documents.

Nulls: a null text stays null; a null doc_id comes before all others. Empty texts stay. Different texts under one doc_id,
or under none, are rows of their own. Repeated rows of one doc_id and text tie and keep or lose the same lines. An empty
table gives an empty result. Other columns stay as they are, but for one named n_lines or n_dropped, which gives way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, written

MIN_WORDS, NEAR_WORDS = 1, 6
#: A line that more than one in HOT of all lines equal is joined by broadcast (there are HOT such at most), the rest by shuffle.
HOT = 4096
#: White space inside a line besides the space (a fixed value).
OTHER_BLANKS = "\t\v\f\r"


def tidy(line: Column) -> Column:
    """The line with single spaces between words and none at its ends."""
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    for c in OTHER_BLANKS:
        odd = odd | line.contains(c)
    return F.when(odd, F.trim(F.regexp_replace(line, r"[ \t\x0B\f\r]+", " "))).otherwise(line)


def text_key() -> Column:
    """With doc_id the key of a row."""
    return F.xxhash64("text", F.lit(2))


def lines_of(docs: DataFrame, near_words: int) -> DataFrame:
    """doc_id, k (the text's key), line_no, h, g (the line's key), n (words) and halves (hashes, null for a short line) of each line."""
    lines = docs.select("doc_id", text_key().alias("k"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "k", "line_no", tidy(F.col("line")).alias("line"))
    lines = lines.withColumn("n", F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1))

    def half(kind: int, k: str) -> Column:  # the first or last k words
        return F.expr(f"xxhash64({kind}, {k}, substring_index(line, ' ', cast({'-' * kind}({k}) as int)))")

    halves = F.array(*[half(kind, k) for kind in (0, 1) for k in ("n div 2", "(n - 1) div 2")])
    return lines.select("doc_id", "k", "line_no", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g"), "n", F.when(F.col("n") >= near_words, halves).alias("halves"))


def without(line: str, n: str, pos: str) -> Column:
    """The line of n words without its pos-th word."""
    return F.expr(f"trim(concat(substring_index({line}, ' ', {pos} - 1), ' ', substring_index({line}, ' ', {pos} - {n})))")


def near_lines(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """h, g of the distinct lines (h, g, first, n, halves) with an earlier line within one word's edit."""
    keyed = distinct.where(F.col("halves").isNotNull()).select("h", "g", F.explode(F.expr("array_distinct(transform(halves, (x, i) -> named_struct('suffix', i >= 2, 'half', x)))")).alias("x")).select("h", "g", "x.suffix", "x.half")
    shared = keyed.groupBy("half").agg(F.count("*").alias("lines")).where("lines > 1").select("half")
    found = keyed.join(shared, "half", "left_semi").groupBy("h", "g").agg(F.max(~F.col("suffix")).alias("prefix"), F.max("suffix").alias("suffix"))
    found = found.join(distinct.select("h", "g", "first"), ["h", "g"])
    places = written(found.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.k").alias("k")).agg(F.collect_list(F.struct("first.line_no", "h", "g", "prefix", "suffix")).alias("lines")), "line-places")
    keyed = docs.select(F.col("doc_id").alias("__id"), text_key().alias("__k"), "text").where("text is not null")
    texts = keyed.join(sized(places, ("lines",), element_bytes=64), F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__k") == F.col("k")))
    texts = texts.withColumn("parts", F.split("text", "\n")).select("doc_id", "k", "parts", F.explode("lines").alias("x"))
    texts = texts.select("x.h", "x.g", "x.prefix", "x.suffix", F.struct("doc_id", "k", F.col("x.line_no").alias("line_no")).alias("ord"), tidy(F.expr("try_element_at(parts, x.line_no + 1)")).alias("line"))
    # of repeated rows one counts
    texts = texts.where((F.xxhash64("line") == F.col("h")) & (F.xxhash64("line", F.lit(1)) == F.col("g"))).dropDuplicates(["h", "g"])
    lines = written(texts.withColumn("n", F.size(F.split("line", " "))), "line-candidates")

    first_pos = F.when(F.col("suffix"), 1).otherwise(F.expr("(n - 1) div 2 + 1"))
    last_pos = F.when(F.col("prefix"), F.col("n")).otherwise(F.expr("n - (n - 1) div 2"))
    positions = F.concat(F.array(F.lit(0)), F.sequence(first_pos.cast("int"), last_pos.cast("int")))
    variants = lines.select("h", "g", "ord", "line", "n", F.explode(positions).alias("pos"))
    key = F.when(F.col("pos") == 0, F.col("line")).otherwise(without("line", "n", "pos"))
    variants = written(variants.select("h", "g", "ord", "pos", F.xxhash64(key).alias("key")), "line-variants")
    me = F.struct("ord", "h", "g", "pos")
    by_pos = variants.groupBy("key", "pos").agg(F.min(me).alias("least"), F.count("*").alias("m"))
    whole = F.col("pos") == 0
    by_key = by_pos.groupBy("key").agg(F.min(F.when(whole, F.col("least"))).alias("whole"), F.min(F.when(~whole, F.col("least"))).alias("deleted"), F.sum("m").alias("m")).where("m > 1")
    replaced = variants.where(~whole).join(by_pos.where((F.col("m") > 1) & ~whole).select("key", "pos", "least"), ["key", "pos"]).select("h", "g", "ord", "pos", "least", F.lit("replaced").alias("kind"))
    shorter = variants.where(~whole).join(by_key.where("whole is not null").select("key", F.col("whole").alias("least")), "key").select("h", "g", "ord", "pos", "least", F.lit("deleted").alias("kind"))
    longer = by_key.where("whole is not null and deleted is not null").select("whole.h", "whole.g", "whole.ord", "deleted.pos", F.col("deleted").alias("least"), F.lit("inserted").alias("kind"))
    pairs = replaced.unionByName(shorter).unionByName(longer).where("least.ord < ord").select("h", "g", "pos", "kind", F.col("least.h").alias("h2"), F.col("least.g").alias("g2")).distinct()

    own, other = (lines.select(F.col("h").alias(f"h{k}"), F.col("g").alias(f"g{k}"), F.col("line").alias(a), F.col("n").alias(f"n_{a}")) for k, a in (("", "a"), (2, "b")))
    same = F.when(F.col("kind") == "replaced", (F.col("n_a") == F.col("n_b")) & (without("a", "n_a", "pos") == without("b", "n_b", "pos")))
    same = same.when(F.col("kind") == "deleted", without("a", "n_a", "pos") == F.col("b")).otherwise(F.col("a") == without("b", "n_b", "pos"))
    return pairs.join(own, ["h", "g"]).join(other, ["h2", "g2"]).where(same).select("h", "g").distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs (doc_id, text, ...) with the text of the lines that stay, n_lines and n_dropped (both null for a null text)."""
    lines = written(lines_of(docs, near_words), "lines").where(F.col("n") >= min_words)
    firsts = lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "k", "line_no")).alias("first"), F.count("*").alias("times"), F.any_value("n").alias("n"), F.any_value("halves").alias("halves"))
    distinct = written(firsts, "lines-distinct")
    near = near_lines(distinct.drop("times", "n"), docs).withColumn("near", F.lit(True))
    repeated = distinct.select("h", "g", "first", "times").join(near, ["h", "g"], "left").where("times > 1 or near").select("h", "g", "first", "times", F.coalesce("near", F.lit(False)).alias("near"))
    many = distinct.agg(F.sum("times")).first()[0] or 0
    repeated = written(repeated.withColumn("hot", F.col("times") > many / HOT), "lines-repeated").drop("times")
    places = lines.select("doc_id", "k", "line_no", "h", "g")
    hot, rest = repeated.where("hot").drop("hot"), repeated.where("not hot").drop("hot")
    goes = places.join(F.broadcast(hot), ["h", "g"]).unionByName(places.join(F.broadcast(hot.select("h", "g")), ["h", "g"], "left_anti").join(rest, ["h", "g"]))  # HOT rows at most
    goes = goes.where(F.col("near") | (F.struct("doc_id", "k", "line_no") > F.col("first")))
    cut = written(goes.groupBy("doc_id", "k").agg(F.collect_set("line_no").alias("cut")), "lines-cut")  # no more than a document's lines
    right = sized(cut, ("cut",)).alias("r")
    left = docs.drop("n_lines", "n_dropped").alias("l")
    joined = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64("l.text", F.lit(2)) == F.col("r.k")), "left")
    text, parts, gone = F.col("l.text"), F.split("l.text", "\n"), F.col("r.cut")
    kept = F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n"))
    counts = F.when(text.isNotNull(), F.size(parts)).alias("n_lines"), F.when(text.isNotNull(), F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0))).alias("n_dropped")
    return joined.select(*[kept.alias(c) if c == "text" else F.col(f"l.`{c}`") for c in left.columns], *counts)


def lines_query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"))


ORACLE = """
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, no, raw, trim(regexp_replace(raw, '[ \\t\\x0B\\f\\r]+', ' ', 'g')) AS line, doc_id * 1000000 + no AS ord FROM s),
w AS (SELECT *, CASE WHEN line = '' THEN 0 ELSE len(string_split(line, ' ')) END AS n FROM l),
d AS (SELECT line, min(ord) AS ord, any_value(n) AS n, string_split(line, ' ') AS w FROM w WHERE n >= 1 GROUP BY line),
v AS (SELECT line, ord, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS k FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 6)),
r AS (SELECT line FROM (SELECT line, ord, min(ord) OVER (PARTITION BY k, i) AS least FROM v) WHERE least < ord),
x AS (SELECT v.line AS longer, d.line AS shorter, v.ord AS o1, d.ord AS o2 FROM v JOIN d ON v.k = d.line WHERE d.n >= 6),
near AS (SELECT line FROM r UNION SELECT longer FROM x WHERE o2 < o1 UNION SELECT shorter FROM x WHERE o1 < o2),
j AS (SELECT w.doc_id, w.no, w.raw, w.n >= 1 AND (w.line IN (SELECT line FROM near) OR w.ord > d.ord) AS goes FROM w LEFT JOIN d USING (line)),
a AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE NOT coalesce(goes, false)) AS text, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(goes, false)) AS n_dropped FROM j GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(a.text, '') END AS text, a.n_lines, a.n_dropped
FROM documents LEFT JOIN a USING (doc_id)
"""
