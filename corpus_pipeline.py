"""From raw documents to token ids: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, further columns of the input included, whatever their names. Texts of
any length are read whole, and an empty table passes through every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import byte_bpe, decontaminate, line_dedup, quality_rules, simhash
from pulsegrid.llm.shared import fresh_dir, remove_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go.

    Null and empty texts have too few words and go; rows with null ids and repeated rows are
    judged by their text alone, so ties don't arise.
    """
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten sites or more, there in ten distinct texts or more, go; ``n_chars`` follows the text.

    Copies of a text are left to the next stage, which keeps one of them with its text. A null
    text stays null and an empty one empty; lines of rows with a null source count for no site;
    null ids are kept; repeated rows are cut alike and stay repeated.
    """
    return line_dedup.without_boilerplate(docs, length_col="n_chars", min_texts=10)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (three bits, or five-word similarity 0.8) stays.

    It is the one of the least id; null ids come last, and of equal ids the hash of the text
    decides. Rows with equal ids and texts stay or go together. Null and empty texts are one
    group, of which one stays.
    """
    return simhash.keep_one(docs, similarity=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    Null and empty texts leak nothing and stay, as all rows do where the benchmark is empty;
    items that are null or have fewer than three words match nothing; null ids are kept, and
    repeated rows stay or go together.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids with their digests.

    A null or empty text has no tokens and the digest of nothing; null ids are kept, and a
    repeated row has a result row each time.
    """
    return byte_bpe.encode(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_copy_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("byte_level_bpe", token_stage),
]

#: SQL expresses neither SimHash components nor the alignment nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of documents; each is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        folder = fresh_dir(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove_dir(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
