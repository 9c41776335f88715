"""Corpus pipeline: quality, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the docs of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.llm import pii, quality
from lexiloom.llm.bpe import digest_columns, encode_documents
from lexiloom.llm.mixing import repeated_documents
from lexiloom.llm.names import free_name
from lexiloom.llm.ngram_join import jaccard_groups
from lexiloom.session import shared_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go; null, empty and blank texts are rejected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.selected(docs, labels).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; rows of one doc_id share its fate."""
    gone = jaccard_groups(docs.select("doc_id", "text")).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by [KIND], and n_chars follows the text; every document stays."""
    text = pii.redact(F.col("text"), F.col(free_name(docs, "pii_spans")))
    made = {"text": text.alias("text"), "n_chars": F.length(text).cast("bigint").alias("n_chars")}
    return pii.personal_data(docs).select(*(made.get(c, F.col(c)) for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those of sources beyond their target go."""
    return repeated_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) per row of the mix."""
    coded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "ids", *digest_columns(F.col("ids"), F.col("decoded")))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: Trained models, seeded queues and byte-pair merges cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table; intermediate tables go to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
