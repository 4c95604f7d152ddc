"""Training-corpus pipeline over `documents`: toxicity, exact dedup, near dedup, PII, packing.

Every stage calls one operator of `shroud.llm`, takes the rows its predecessor kept and returns the
columns of `documents`; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shroud.llm import exact_dedup, near_dedup, packing, pii_sanitise, toxicity
from shroud.session import checkpoint_dir
from shroud.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents with a score of 0.5 or more go. Learned from the labelled documents of
    the stage's input, scored on all of it."""
    model = toxicity.learned(spark, docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts the row with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each near-duplicate class stays."""
    return near_dedup.keep_one(docs)


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data and the terms that disclose it are replaced in the text."""
    return pii_sanitise.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the pieces of packed training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("personal data", sanitise_personal_data),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # a learned model, hashing and a tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared folder and read again."""
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
