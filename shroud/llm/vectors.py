"""Reading tables of vectors: which rows count, and their values as numpy blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(rows `id`, `vec`, their length). A vector counts if it is not null, holds no null and no
    non-finite value, and has the table's most frequent length (the longest such on a tie)."""
    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec").isNotNull() & finite)
    lengths = (rows.where(F.size("vec") > 0).groupBy(F.size("vec").alias("dim")).count()
               .orderBy(F.desc("count"), F.desc("dim")).first())
    dim = lengths["dim"] if lengths else 0
    return rows.where((F.size("vec") == dim) & F.lit(dim > 0)), dim


def matrix(column, dim: int) -> np.ndarray:
    """The rows of an Arrow list column (no nulls) as a matrix of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
