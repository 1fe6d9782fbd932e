"""The registered queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import byte_bpe, centroids, collocations, decontaminate, fingerprints, line_dedup, pii, quality_rules, simhash, substring_index, suffix_dedup, token_counts, warc
from pulsegrid.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents against the standard policy."""
    return quality_rules.quality(_table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two policies' ablations from the stored ledger of operator 4."""
    return quality_rules.policy_report(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded again."""
    return byte_bpe.encode(_table(spark, sf_dir, "documents"), with_ids=False)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals for every context limit over all documents."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written and read back."""
    rows = warc.round_trip(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    return pii.find(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-copy class of every whole text of documents."""
    return simhash.classes(_table(spark, sf_dir, "documents"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200-byte strings that repeat, over every whole text of documents."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50-word windows of earlier documents, over every whole text of documents."""
    return substring_index.remove_repeats(_table(spark, sf_dir, "documents"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on ten sites or more, cut out of every document."""
    return line_dedup.summary(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of documents, of its edited text and of the next document."""
    return fingerprints.neighbours(_table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector of embeddings by sixteen centroids, three rounds."""
    return centroids.clustered(_table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language over every whole text of documents."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_array": op3_suffix_array,
    "op4_quality_rules": op4_quality_rules,
    "quality_ablations": quality_ablations,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_phrase_collocations": op13_phrase_collocations,
}

__all__ = ["ORACLES", "QUERIES"]
