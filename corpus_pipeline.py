"""A corpus pipeline of five of the operators, each stage reading what the one before wrote.

Defined results beyond those of the operators: a document without an id can't be
named by the deduplicating and decontaminating stages and passes them; only the
last stage returns other columns than those of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import decontamination, language_id, line_dedup, near_dedup, packing
from linkloom.llm.common import shared_folder, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some learned language accepts; lang becomes the predicted language."""
    model = language_id.fit(docs)
    names = ["lang_pred", "score", "cross_entropy", "accepted"]
    own = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in names})
    accepted = language_id.identify(own, model).where("accepted").withColumn("lang", F.col("lang_pred")).drop(*names)
    return accepted.withColumnsRenamed({f"__own_{c}": c for c in names}).select(docs.columns)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text."""
    return line_dedup.deduplicate(docs).withColumn("n_chars", F.length("text").cast("long"))


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id."""
    return near_dedup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their training sequences."""
    return packing.assign(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("near_dedup", deduplicate_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express these stages; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the application's shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
