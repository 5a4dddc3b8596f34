"""From raw documents to token ids: five stages, each written as Parquet and reread as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of documents, extra ones included, whatever their names; each works on all rows that the stage before
it kept.

Null and empty texts, and those without words, fail the quality rules and go there. Of repeated rows,
and of texts that are alike, the one with the least (doc_id, hash of the text) stays; rows that share
an id, or have none, are told apart by their texts. Ties are settled so in every stage that has any.
Texts are taken whole, however long. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from indexloom.llm import chunk_bpe, decontam, jaccard_join, pii, quality_rules, textops


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the names of its kinds."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as digests."""
    return chunk_bpe.encode_digests(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("pii", redact), ("bpe", encode)]

#: The near-duplicate and byte-pair stages are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = textops.put(stage(spark, docs, sf_dir), name)
        if before:
            textops.drop(spark, before)  # the stage that read it is written
        before = path
    return docs
