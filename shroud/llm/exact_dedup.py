"""Exact deduplication: 128-bit content hash, smallest stable id, byte comparison.

Equal means: identical after every run of white space became one space (null text = empty).
Grouping is on (hash, text): rows meet by the 128-bit hash and are told apart by their bytes, so
two texts that share a hash stay two groups. Partial aggregation folds copies before the shuffle,
so a text that holds a third of all rows leaves each task as one row.

Defined cases: empty and null texts form one group; a null id is larger than any id; rows that
repeat the smallest id of a group: exactly one is kept; an empty table gives an empty result;
columns beside id and text never take part and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import spaced


def content_hash(norm) -> F.Column:
    """128 bits of content hash as 16 bytes."""
    return F.unhex(F.md5(norm))


def assign_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Two narrow scans: one finds the groups (bytes compared), one looks every row's group up by
    (hash, SHA-256), a join whose hot keys adaptive execution splits, as both inputs are plain
    exchanges. The last window only tells rows that repeat an id apart.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), spaced(text_col).alias("_norm"))
    keyed = keyed.select("_id", "_norm", content_hash(F.col("_norm")).alias("_hash"))
    groups = (keyed.groupBy("_hash", "_norm")
              .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select("_hash", F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    rows = keyed.select("_id", "_hash", F.sha2("_norm", 256).alias("text_sha256"))
    nth = F.row_number().over(Window.partitionBy("_id", "text_sha256").orderBy("_hash"))
    return (rows.join(groups, ["_hash", "text_sha256"])
            .select(F.col("_id").alias(id_col), "keep_id", "group_size",
                    (F.col("_id").eqNullSafe(F.col("keep_id")) & (nth == 1)).alias("kept"), "text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows only, whole and with the input's columns: of equal texts the row with the
    smallest id (then the least raw text). One shuffle, copies folded before it; no join."""
    norm = spaced(text_col)
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(F.col(text_col)))
    kept = (docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        order.alias("_order"), norm.alias("_norm"))
            .select("_row", "_order", "_norm", content_hash(F.col("_norm")).alias("_hash"))
            .groupBy("_hash", "_norm").agg(F.min_by("_row", "_order").alias("_row")))
    return kept.select("_row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_groups(read_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
