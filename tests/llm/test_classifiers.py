"""op5, op8 and the pipeline's stages against plain versions, and on odd rows."""

import math
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, ODD, none_of, odd_documents
from pyspark.sql import functions as F

import corpus_pipeline
from stormledger.llm import quality_gam, toxicity_cnn
from stormledger.llm.queries import QUERIES

CLASHES = ("score", "predicted", "held_out", "features", "threshold", "flagged", "cut", "__id", "n_lines", "n_dropped", "h", "g", "y", "id", "node", "root")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def labels_of(sf, name):
    return dict(duckdb.sql(f"select doc_id, {name} from '{sf}/labels.parquet' where {name} is not null").fetchall())


@pytest.mark.parametrize("query, name, cut", [("op5_quality_gam", "quality", 0.5), ("op8_toxicity_cnn", "toxic", 0.7)])
def test_query_on_the_held_out_fold(spark, query, name, cut):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES[query](spark, sf).collect()
    ids = [i for (i,) in duckdb.sql(f"select doc_id from '{sf}/documents.parquet'").fetchall()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    truth = labels_of(sf, name)
    right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    assert len(right) > 30 and np.mean(right) > 0.93


def test_the_held_out_labels_do_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    turned = labels.withColumns({c: F.when(out, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for scored in (quality_gam.scored, toxicity_cnn.scored):
        a, b = ({r.doc_id: r.score for r in scored(docs, x).collect()} for x in (labels, turned))
        assert a == b


def test_gam_scores_are_sums_of_its_tables():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    gam = quality_gam.Gam(x, y)
    slow = []
    for row in x:
        z = gam.base
        for f, (cuts, table) in enumerate(zip(gam.cuts, gam.tables)):
            z += table[sum(c <= row[f] for c in cuts)]
        for (i, j), table in zip(gam.pairs, gam.pair_tables):
            z += table[sum(c <= row[i] for c in gam.pair_cuts[i]), sum(c <= row[j] for c in gam.pair_cuts[j])]
        slow.append(1 / (1 + math.exp(-z)))
    assert np.allclose(gam.score(x), slow) and (0, 1) in gam.pairs
    assert np.mean((gam.score(x) >= 0.5) == y) > 0.9


def test_cnn_scores_are_those_of_a_plain_network():
    words = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, 12)) + (" very bad thing" if k % 3 == 0 else "") for k in range(240)]
    y = np.array([k % 3 == 0 for k in range(240)], float)
    buckets, codes, starts = toxicity_cnn.coded_words(pa.array(texts))
    rows = [buckets[c] for c in np.split(codes, starts[1:])]
    net = toxicity_cnn.Cnn(rows, y, ["en"] * 240)
    fast = net.score(buckets, codes, starts)
    for k in range(0, 240, 17):
        z = float(net.c) + net.shift
        n = len(rows[k])
        for j, tables in enumerate(net.tables):
            answers = [[sum(t[b] for b in rows[k][w]) for w in range(n)] for t in tables]
            at = [sum(answers[q][w + q] for q in range(len(tables)) if w + q < n) for w in range(n)]
            z += sum(float(v) * max(0.0, float(max(a[f] for a in at) + net.b[j, f])) for f, v in enumerate(net.v[j]))
        assert abs(fast[k] - 1 / (1 + math.exp(-z))) < 1e-4
    assert np.mean((fast >= 0.7) == (y > 0)) > 0.95
    learned = toxicity_cnn.Cnn(rows, y, ["en"] * 240, start=False).score(buckets, codes, starts)  # from random vectors alone
    assert np.mean((learned >= 0.7) == (y > 0)) > 0.9
    assert 0.5 <= net.thresholds["en"] <= 0.9


def test_thresholds_shrink_with_few_rows():
    assert toxicity_cnn.Cnn([], np.zeros(0), []).thresholds == {}
    z = np.array([0.1, 0.2, 0.8, 0.9])
    assert abs(toxicity_cnn.best_cut(z, np.array([0, 0, 1, 1])) - 0.5) < 1e-9


@pytest.mark.parametrize("scored, cut", [(quality_gam.scored, 0.5), (toxicity_cnn.scored, 0.7)])
def test_classifiers_on_odd_rows(spark, sf, scored, cut):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 0, 1), (None, 1, 1), (4, None, None), (5, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    df = odd_documents(spark)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    rows = scored(df, labels, keep=tuple(df.columns)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) and r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    assert scored(none_of(df), labels).collect() == []
    bare = {r.score for r in scored(df, none_of(labels)).collect()}
    assert bare == ({0.5} if scored is quality_gam.scored else {0.0})


def test_what_is_learned_from_is_bounded(spark, sf, monkeypatch):
    """All texts together stay within the bound, taken by the hash of doc_id, whatever the rest is."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = []
    monkeypatch.setattr(toxicity_cnn, "Cnn", lambda texts, y, lang: seen.append((len(texts), sum(map(len, texts)))))
    for chars in (0, 5000, 60_000, toxicity_cnn.FIT_CHARS):
        toxicity_cnn.fit(docs, labels, chars=chars)
    rows, words = zip(*seen)
    assert rows[0] == 0 < rows[1] < rows[2] <= rows[3] and words[1] < 5000 and words[2] < 60_000


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_pipeline_stages_keep_the_columns_and_what_they_should(spark, tmp_path):
    """Each stage on rows with nulls, repeats, long texts and clashing names, against what its operator says of the rows."""
    good = [(100 + i, " ".join(f"plain{(i * 7 + k) % 91} words" for k in range(40)) + ".") for i in range(30)]
    rows = [*ODD, *good]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(0))
    for c in CLASHES:
        df = df.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    labels = [(100 + i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/labels.parquet")
    verdicts = {"quality classifier": (quality_gam.scored, lambda r: r.predicted == 1), "toxicity": (toxicity_cnn.scored, lambda r: not r.flagged)}
    for name, (scored, keeps) in verdicts.items():
        want = Counter((r.doc_id, r.text) for r in scored(df.select("doc_id", "text", "lang"), table, keep=("doc_id", "text")).collect() if keeps(r))
        got = stage(name)(spark, df, str(tmp_path))
        assert got.columns == df.columns
        kept = got.collect()
        assert Counter((r.doc_id, r.text) for r in kept) == want
        assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in kept for c in CLASHES)
        assert stage(name)(spark, none_of(df), str(tmp_path)).collect() == []
    cut = stage("line dedup")(spark, df, str(tmp_path))
    assert cut.columns == df.columns
    texts = {(r.doc_id, r.text) for r in cut.collect()}
    assert (1, "one two three four") not in texts or (5, "one two three four") not in texts  # the later copy goes with its only line
    assert {(2, None), (3, ""), (4, LONG), (8, ODD[8][1])} <= texts
    assert stage("line dedup")(spark, none_of(df), str(tmp_path)).collect() == []
    near = stage("simhash near-dedup")(spark, df, str(tmp_path))
    assert near.columns == df.columns
    left = Counter((r.doc_id, r.text) for r in near.collect())
    assert max(left.values()) == 1 and (4, LONG) in left and (1, "one two three four") in left and (5, "one two three four") not in left
    assert (None, ODD[6][1]) in left  # a row without an id stays if no other has its text
    assert stage("simhash near-dedup")(spark, none_of(df), str(tmp_path)).collect() == []
    packed = stage("best-fit packing")(spark, df, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _ in rows)


def test_pipeline_is_its_stages(spark, sf):
    """The rows of the whole run are those of the stages one after another, and each stage's are some of its predecessor's."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, sf).toPandas()
        assert set(out.doc_id) <= ids
        ids = set(out.doc_id)
        if k < len(corpus_pipeline.STAGES) - 1:
            docs = spark.createDataFrame(out, docs.schema)
    got = corpus_pipeline.run(spark, sf).toPandas()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[names].values.tolist())) == sorted(map(tuple, out[names].values.tolist()))
    assert got.sequence_id.nunique() == out.sequence_id.nunique()


def test_release_removes_written_tables(spark):
    from stormledger.llm import common

    kept = list(common.WRITTEN)
    common.WRITTEN.clear()
    df = common.written(spark.range(3).toDF("a"), "test")
    path = common.WRITTEN[0]
    assert df.count() == 3 and common.release(spark) == 1 and common.WRITTEN == []
    with pytest.raises(Exception):
        spark.read.parquet(path)
    common.WRITTEN.extend(kept)
    assert "stormledger.llm" in sys.modules
