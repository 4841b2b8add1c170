import duckdb
import pytest

from helpers import ODD, none_of, odd_documents
from stormledger.llm import host_rules, line_dedup
from stormledger.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op6_line_dedup", "op7_host_rules"])
def test_query_against_sql(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(map(repr, df[sorted(df.columns)].astype(str).values.tolist())) for df in (got, want)]
    assert rows[0] == rows[1]


def distance_within_one(a, b):
    a, b = a.split(), b.split()
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = sorted((a, b), key=len)[::-1]
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs):
    seen, out = [], []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        kept = []
        for line in (text or "").split("\n"):
            n, plain = len(line.split()), " ".join(line.split())
            near = line_dedup.NEAR_WORDS
            goes = n >= line_dedup.MIN_WORDS and any(plain == s or (n >= near and len(s.split()) >= near and distance_within_one(plain, s)) for s in seen)
            seen.append(plain)
            if not goes:
                kept.append(line)
        out.append((i, None if text is None else "\n".join(kept)))
    return out


def test_lines_against_brute_force(spark):
    base = "a b c d e f g h i j"
    texts = [base, "a b c d X f g h i j\nother line here", "b c d e f g h i j", base.replace("j", "j k"), "  a  b c d e f g h\ti j ", "j i h g f e d c b a\nother line here",
             "x b c d e f g h i Y", "a b c d e f g", "a b c d e f X", "two words\ntwo words", "", None, base + "\n" + base, "a b c d e f g h", "a b c d e f g h z", "z a b c d e f g h z"]
    docs = [(i, t) for i, t in enumerate(texts)]
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute(docs)


def test_lines_of_odd_rows(spark):
    df = odd_documents(spark)
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    rows = sorted(((r.doc_id or 0), r.text) for r in got.collect() if r.doc_id != 5)
    assert [t for i, t in rows if i == 2] == [None] and len(rows) == len(ODD) - 2
    assert [r.text for r in got.where("doc_id = 5").collect()] == ["", ""]
    assert line_dedup.dedup_lines(none_of(df)).collect() == []


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good if i % 10 else bad, "good.org") for i in range(50)] + [(100 + i, bad if i % 10 else good, "bad.org") for i in range(50)] + [(200 + i, good if i % 8 else bad, f"h{i % 5}.org") for i in range(40)] + [(300, good, None), (301, None, None)]
    got = {r.doc_id: r for r in host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].kept and not got[0].kept and not got[100].kept and not got[101].kept and got[201].kept and got[300].kept and not got[301].kept
    assert got[301].n_words == 0 and got[301].base_failed
    assert len(host_rules.host_rules(odd_documents(spark)).collect()) == len(ODD)
    assert host_rules.host_rules(none_of(odd_documents(spark))).collect() == []


def test_counts_of_a_text():
    assert host_rules.text_counts("a b c a b c\n#x\n\n#x ") == (8, 11, 2, 0, 6)
    assert host_rules.text_counts("x y\nx y\n \n") == (4, 4, 0, 1, 0)
    assert host_rules.text_counts(None) == (0, 0, 0, 0, 0)


def test_different_texts_under_one_id_or_none(spark):
    common = "the very same words stand here"
    rows = [(i, f"{common}\nfirst own line of {n}\n{common}\nsecond own line of {n}") for n, i in enumerate((7, 7, 7, None, None, None))]
    df = spark.createDataFrame([*rows, rows[0], rows[3]], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()]
    assert len(got) == 8
    for n, (i, _) in enumerate(rows):
        mine = [t for k, t in got if k == i and f"first own line of {n}" in t]
        assert len(mine) == (2 if n in (0, 3) else 1) and len(set(mine)) == 1
        assert mine[0].replace(common + "\n", "") == f"first own line of {n}\nsecond own line of {n}"
    assert sum(t.count(common) for _, t in set(got)) == 1


def test_a_host_that_gathers_failures_is_rejected_in_the_real_table(spark):
    """Three of four failing documents of sf0.01, and every fiftieth other one, come from one host; the rest keeps its sources."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    failed = {r.doc_id for r in host_rules.host_rules(docs).where("base_failed").collect()}
    moved = [i for i in sorted(failed) if i % 4]
    rows = docs.toPandas()
    rows.loc[rows.doc_id.isin(moved) | (rows.doc_id % 50 == 0), "source"] = "bad.example"
    got = {r.doc_id: r for r in host_rules.host_rules(spark.createDataFrame(rows[["doc_id", "text", "source"]])).collect()}
    bad = set(rows.doc_id[rows.source == "bad.example"])
    assert {i for i, r in got.items() if not r.kept and not r.base_failed} == bad - failed and len(bad - failed) > 5
    assert len({r.host_rate for i, r in got.items() if i in bad}) == 1
