"""From raw documents to packed training sequences.

Five stages, each on all rows that the one before it kept: the quality classifier drops what it rejects,
SimHash leaves one document of each group of near duplicates, documents with benchmark passages go,
secrets are masked, and what is left is packed. ``run`` writes each stage's rows as Parquet into the shared folder
and reads them again, so a lost executor costs no more than the stage at hand; the rows of a stage go when the next one's are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, packing, quality, secret_scan, simhash
from folioflow.llm._shared import release, scratch, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, scores 0.5 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return simhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and their lengths brought up to date."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and the sequences that hold them."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_distinct),
    ("decontamination", uncontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL can express neither the fitted classifier nor the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch(spark):  # what a stage writes on its way goes once its rows are written
            docs = written(stage(spark, before, sf_dir), f"stage-{name}", keep=True)
        release(before)
    return docs
