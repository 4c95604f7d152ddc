"""Logs as they come: JSON lines of any shape, and settings files per layer.

Lines are read as VARIANT, so no shape has to be declared; a line that isn't JSON
comes out as a row with its text in `bad`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(line, v): v is the parsed line, NULL where it isn't valid JSON."""
    lines = spark.read.text(folder).withColumnRenamed("value", "line").where(F.trim("line") != "")
    return lines.select("line", F.try_parse_json("line").alias("v"), F.col("_metadata.file_path").alias("path"))


LAYERS = {"explicit": "file", "project": "project", "project-trusted": "project_trusted", "env": "env"}


def read_settings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Settings files `<folder>/<layer>/…`, a JSON document a line: {"host": …, "settings": {key: value}}.

    Returns (host, source, key, value_json) and the remarks (path, line, message)
    on lines that can't be used. The layer is the last folder name on the file's
    path that names one.
    """
    rows = read_json_lines(spark, folder)
    layer = F.regexp_extract("path", ".*/(" + "|".join(sorted(LAYERS, key=len, reverse=True)) + ")/", 1)
    source = F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])[layer]
    rows = rows.select("path", "line", source.alias("source"), F.try_variant_get("v", "$.host", "bigint").alias("host"),
                       F.try_variant_get("v", "$.settings", "map<string,variant>").alias("settings"), F.col("v").isNotNull().alias("json"))
    settings = (rows.where("source IS NOT NULL AND host IS NOT NULL").select("host", "source", F.explode("settings").alias("key", "v"))
                .select("host", "source", "key", F.to_json("v").alias("value_json")))
    why = (F.when(~F.col("json"), "is not valid JSON").when(F.col("source").isNull(), "lies under no known layer")
           .when(F.col("host").isNull(), "names no host").when(F.col("settings").isNull(), "has no object of settings"))
    remarks = rows.where(why.isNotNull()).select("path", "line", F.concat(F.lit("config file line "), why, F.lit(" — ignoring it.")).alias("message"))
    return settings, remarks
