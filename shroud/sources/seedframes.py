"""Small constant tables, emitted once as a Spark DataFrame and once as SQL text.

Every seed has a bounded, code-fixed size (tens of rows), which is what makes
broadcasting it safe; `broadcast_seed` asserts that bound instead of trusting it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import sql_str

MAX_SEED_ROWS = 10_000


def _sql_value(v, typ: str) -> str:
    if v is None:
        return f"CAST(NULL AS {typ})"
    if typ == "BOOLEAN":
        return "TRUE" if v else "FALSE"
    if typ in ("BIGINT", "INT", "INTEGER"):
        return f"CAST({int(v)} AS {typ})"
    return sql_str(str(v))


def _ddl(cols: Sequence[tuple[str, str]]) -> str:
    m = {"BIGINT": "bigint", "INT": "int", "INTEGER": "int", "BOOLEAN": "boolean", "VARCHAR": "string"}
    return ", ".join(f"`{c}` {m[t]}" for c, t in cols)


def seed_df(spark: SparkSession, rows: Sequence[Sequence], cols: Sequence[tuple[str, str]]) -> DataFrame:
    assert len(rows) <= MAX_SEED_ROWS
    return spark.createDataFrame([tuple(r) for r in rows], _ddl(cols))


def broadcast_seed(spark: SparkSession, rows, cols) -> DataFrame:
    """A seed marked for broadcast; its size is bounded by construction."""
    assert len(rows) <= MAX_SEED_ROWS, "seed too large to broadcast"
    return F.broadcast(seed_df(spark, rows, cols))


def seed_sql(rows: Sequence[Sequence], cols: Sequence[tuple[str, str]]) -> str:
    """`(VALUES ...) AS t(cols)` text for DuckDB."""
    body = ",\n    ".join("(" + ", ".join(_sql_value(v, t) for v, (_, t) in zip(r, cols)) + ")" for r in rows)
    names = ", ".join(c for c, _ in cols)
    return f"(VALUES\n    {body}) AS t({names})"
