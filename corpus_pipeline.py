"""A corpus from documents to packed sequences: each stage calls one operator of the llm subpackage on all that its predecessor kept.

Every stage but the last returns the columns of documents, with the texts that its decisions leave. n_chars stays as it
came in. Nulls, repeated rows and empty tables are as in the operators' own descriptions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.llm import line_dedup, packing, quality_gam, simhash, toxicity_cnn
from stormledger.llm.common import renamed, table, written
from stormledger.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as label 1."""
    rows, names = renamed(docs, "doc_id", "text")
    return quality_gam.scored(rows, table(spark, sf_dir, "labels"), keep=tuple(rows.columns)).where("predicted = 1").select(*rows.columns).withColumnsRenamed(names)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold of their language."""
    rows, names = renamed(docs, "doc_id", "text", "lang")
    return toxicity_cnn.scored(rows, table(spark, sf_dir, "labels"), keep=tuple(rows.columns)).where(~F.col("flagged")).select(*rows.columns).withColumnsRenamed(names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; a document of which no line with words is left goes."""
    rows, names = renamed(docs, "doc_id", "text")
    left = line_dedup.dedup_lines(rows).where((F.coalesce("n_dropped", F.lit(0)) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*rows.columns).withColumnsRenamed(names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts (0.8 of their shingles of five words) one row: the smallest doc_id, and of different texts under it or none the least by hash.

    A row without a doc_id comes last; it stays unless its text is similar to that of another row. Of rows that repeat one, one stays.
    """
    h, g = simhash.text_keys()
    keyed = docs.select("doc_id", F.struct(h, g).alias("node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node"))
    groups = keyed.join(simhash.similar_texts(docs), "node", "left").groupBy(F.coalesce("root", "node")).agg(first.alias("x"))
    chosen = groups.select(F.col("x.doc_id").alias("__id"), F.col("x.node.h").alias("__h"), F.col("x.node.g").alias("__g"))
    rows, names = renamed(docs, "doc_id", "text")
    rows = rows.withColumns({"__h2": h, "__g2": g})
    same = (F.col("__h2") == F.col("__h")) & (F.col("__g2") == F.col("__g")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return rows.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "__h2", "__g2"]).drop("__h2", "__g2").withColumnsRenamed(names)


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' token pieces in sequences."""
    return packing.packed(docs, tokenizer("word_bpe_49k.json"), **packing.SMALL)


STAGES = [("quality classifier", quality), ("toxicity", toxicity), ("line dedup", lines), ("simhash near-dedup", near_copies), ("best-fit packing", packing_)]
#: The classifiers are not SQL; of the stages tests hold near copies against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
