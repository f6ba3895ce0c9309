"""A corpus pipeline: quality rules, line dedup, near-duplicates, packing. Part of the llm package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, near_duplicates, packing, quality_rules, token_counts
from tidewatch.llm.common import TOKENIZERS, materialise, n_words


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the tokenizer's bands keep."""
    judged = quality_rules.quality_rules(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return judged.where("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages of 50 words; those of which nothing is left go."""
    out = line_dedup.dedup_lines(docs, min_words=50)
    out = out.where((F.col("n_lines_removed") == 0) | (n_words(F.col("text")) > 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    copies = near_duplicates.near_duplicates(docs.select("doc_id", "text"), size=5, percent=80).where("NOT kept")
    return docs.join(copies.select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in tokens, with their bins; near-duplicates are gone by now, equal texts may not share one."""
    docs = docs.select("doc_id", "source", F.unhex(F.md5("text")).alias("cluster"), "text")
    sized = materialise(token_counts.with_counts(docs, f"{TOKENIZERS}/word_bpe_49k.json"), "sized")
    return packing.pack_documents(sized, capacity=2048, size=F.col("n_tokens"), cluster=F.col("cluster"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizer measures and walks over groups are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
