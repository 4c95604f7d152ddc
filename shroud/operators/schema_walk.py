"""URL-like parameters of tool schemas, found by one recursive query.

Each distinct schema is parsed once to a VARIANT. A recursive query then explodes one level of all
schemas at a time, along `properties` and the schema containers only, so that a branch which can't
name a parameter is never entered. Entering `properties` is no step in depth; every other step is
one. Tools are joined back by the 128-bit digest of their schema: an inventory of a million tools
with ten thousand schemas walks ten thousand.

Defined cases: a null, malformed or scalar schema, and one with a repeated key, names no parameter;
`properties` that is no object holds none; nodes below `SCHEMA_MAX_DEPTH` are not entered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seeds

#: Spark ends a recursion at a million rows unless told otherwise; a walk here grows with the schemas.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def _walk_sql(schemas: str) -> str:
    containers = ", ".join(f"'{c}'" for c in ["properties", *seeds.SCHEMA_CONTAINERS])
    # two steps a level (`properties`, then a parameter), and the one that finds nothing more
    levels = 2 * (seeds.SCHEMA_MAX_DEPTH + 2)
    enters = "(NOT w.in_properties AND e.key <=> 'properties')"
    return f"""
WITH RECURSIVE w(schema_key, node, in_properties, depth, path, parameter) MAX RECURSION LEVEL {levels} AS (
  SELECT schema_key, node, false, 0, '$', CAST(NULL AS STRING) FROM {schemas}
  UNION ALL
  SELECT w.schema_key, e.value, {enters}, CASE WHEN {enters} THEN w.depth ELSE w.depth + 1 END,
         concat(w.path, coalesce('.' || e.key, '[' || e.pos || ']')), CASE WHEN w.in_properties THEN e.key END
  FROM w, LATERAL variant_explode(w.node) e
  WHERE w.depth <= {seeds.SCHEMA_MAX_DEPTH}
    AND CASE WHEN w.in_properties THEN e.key IS NOT NULL ELSE e.key IS NULL OR e.key IN ({containers}) END)
SELECT schema_key, path, parameter, depth - 1 AS depth FROM w WHERE parameter RLIKE :url_like"""


def url_parameters(tools: DataFrame) -> DataFrame:
    """One row per tool and URL-like parameter: session_id, name, path, parameter, depth (of the node
    whose `properties` names it)."""
    spark = tools.sparkSession
    spark.conf.set(ROW_LIMIT, "-1")
    keyed = tools.select("session_id", "name", "parameters", F.unhex(F.md5("parameters")).alias("schema_key"))
    schemas = (keyed.where("parameters IS NOT NULL").groupBy("schema_key").agg(F.first("parameters").alias("parameters"))
               .select("schema_key", F.try_parse_json("parameters").alias("node")).where("node IS NOT NULL"))
    found = spark.sql(_walk_sql("{schemas}"), args={"url_like": seeds.URL_PARAM}, schemas=schemas)
    return keyed.drop("parameters").join(found, "schema_key").drop("schema_key")
