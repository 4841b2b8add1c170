import duckdb
import pytest
from pyspark.sql import functions as F

from helpers import ODD, none_of, odd_documents
from stormledger.llm import mixing
from stormledger.llm.queries import ORACLES, QUERIES


def test_query_against_sql(spark, sf):
    got = QUERIES["op13_systematic_mix"](spark, sf).toPandas()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(ORACLES["op13_systematic_mix"]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(map(repr, df[sorted(df.columns)].round(6).astype(str).values.tolist())) for df in (got, want)]
    assert rows[0] == rows[1]


def test_taken_words_come_near_the_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mix = mixing.mixed(docs)
    assert mix.where(F.col("taken") > 2 * F.col("size")).count() == 0
    sources = mix.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.max("size").alias("most"), F.sum("size").alias("all"), F.max("source_size").alias("source_size")).collect()
    assert all(abs(r.t - r.target) <= r.most + 1 and r["all"] == r.source_size and r.target <= 2 * r.source_size for r in sources)
    assert abs(sum(r.target for r in sources) - 1.5 * sum(r["all"] for r in sources)) < 1e-3
    assert mixing.emitted(mix).count() == mix.agg(F.sum("copies")).first()[0]
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()))


def filled(sizes, weights, percent, most):
    """Targets by raising a common level until all is given (bisection)."""
    want, low, high = sum(sizes) * percent / 100, 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * s, level * w) for s, w in zip(sizes, weights)) < want else (low, level)
    return [min(most * s, low * w) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("sizes", [[10, 1000, 5, 70, 70, 9000], [7], [0, 3], [1, 1, 1, 1000]])
def test_targets_against_bisection(spark, sizes):
    rows = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = filled(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(sizes))], 150, 2)
    assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(want)


def test_code_points_order_the_sources(spark):
    names = ["Z", "a", "é", "", "\U0001f642", None]  # the last two would change places by UTF-16 units
    rows = spark.createDataFrame([(n, 10) for n in names], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows, weights=(6, 5, 4, 3, 2, 1), percent=50).collect()}
    assert [got[n] for n in names] == pytest.approx([30 * w / 21 for w in (6, 5, 4, 3, 2, 1)])


def test_prefix_sums_over_many_ranges(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 7)) AS g", "id % 11 AS v", "id").withColumn("g", F.when(F.col("id") % 50 != 1, F.col("g")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = mixing.by_ranges(rows.repartition(9), "g", [F.col("v"), F.col("id")], "v", "before").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sums = {}
    for r in sorted(got, key=lambda r: (r.v, r.id)):
        assert r.before == sums.get(r.g, 0)
        sums[r.g] = sums.get(r.g, 0) + r.v
    assert len(got) == 5000


def test_targets_too_many_to_broadcast(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.expr("if(doc_id % 5 = 0, null, source)"))
    want = sorted(map(tuple, mixing.mixed(docs).na.fill("").collect()))
    monkeypatch.setattr(mixing, "sized", lambda df, **_: df)
    assert sorted(map(tuple, mixing.mixed(docs).na.fill("").collect())) == want


def test_odd_rows(spark):
    df = odd_documents(spark)
    got = mixing.mixed(df, keep=("lang", "n", "rank", "taken"))
    assert got.columns == ["doc_id", "source", "lang", "n", "rank", "size", "source_size", "target", "copies", "taken"]
    rows = got.collect()
    assert len(rows) == len(ODD) and {r.copies for r in rows} <= {1, 2}
    assert [r.size for r in rows if r.doc_id in (2, 3, 7)] == [0, 0, 0] and [r.size for r in rows if r.doc_id is None] == [4]
    assert mixing.mixed(none_of(df)).count() == 0
    empty = df.withColumn("text", F.lit(None).cast("string"))
    assert {(r.taken, r.target) for r in mixing.mixed(empty).collect()} == {(0, 0.0)}
