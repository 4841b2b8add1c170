"""One query for each operator of this subpackage, with production parameters over whole tables; SQL where it can say the same."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import host_rules, html_extract, huffman_ids, line_dedup, mixing, packing, periodic_runs, piece_samples, progressive_jpeg, quality_gam, simhash, toxicity_cnn, whitening
from .common import table, written


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_piece_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sampled segmentations of each text, with scores and digests of the ids and of the decoded text."""
    return piece_samples.samples(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each text, read back from the blocks of the coded files."""
    blocks, lengths = huffman_ids.write_blocks(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return huffman_ids.read_blocks(blocks, lengths, digest=True)


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are written as a table and decoded from it; the result has the tensors, so they are stored with it."""
    stored = written(progressive_jpeg.media(table(spark, sf_dir, "documents")), "media", compression="zstd")  # file headers are alike
    return progressive_jpeg.features(stored, tensors=True)


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of each text."""
    return quality_gam.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text without lines that an earlier one has."""
    return line_dedup.lines_query(table(spark, sf_dir, "documents"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each text, its own rule and the verdict with that of its source."""
    return host_rules.host_rules(table(spark, sf_dir, "documents")).select("doc_id", *host_rules.COUNTS, "base_failed", "kept")


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of each text, and its flag by the threshold of its language."""
    return toxicity_cnn.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each text and the least doc_id of its group."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each text's token pieces in sequences."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the texts, by digest of doc_id, get a periodic end, as the query's contract has it; a text without a doc_id stays."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of periodic runs of each text, the longest of them, and digests of all and of the text without repeated periods."""
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), edit=planted).withColumn("best", periodic_runs.longest())
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    digests = (periodic_runs.runs_digest().alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), *digests)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of each vector."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each text, with its source's size and target."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_piece_samples, op2_site_style_tree, op3_huffman_ids, op4_progressive_jpeg, op5_quality_gam, op6_line_dedup, op7_host_rules, op8_toxicity_cnn, op9_simhash_near_dedup, op10_pattern_packing, op11_periodic_runs, op12_embedding_whitening, op13_systematic_mix)}
ORACLES = {"op6_line_dedup": line_dedup.ORACLE, "op7_host_rules": host_rules.ORACLE, "op13_systematic_mix": mixing.ORACLE}
