"""Readers for the input tables.

Tables are parquet; projection and filters written downstream reach the scan
through Catalyst (column pruning, pushed filters). Text scanning is CPU-bound and
narrow, so the only thing we add is a planning-time parallelism check: a scan
that yields fewer partitions than the cluster has cores (one small file) is
spread round-robin; a scan that is already wide (the 100 TB case) is left alone
and incurs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_parallel(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a narrow scan over the cluster's cores before CPU-heavy work."""
    try:
        want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a Spark Connect session): leave the scan as is
        return df
    return df if have >= want else df.repartition(want)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The driver writes `ts` as TIMESTAMP_NTZ; watermarks need TIMESTAMP.
    return read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
