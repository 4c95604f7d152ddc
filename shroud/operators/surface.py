"""Tool-surface inventory: provenance, declared reach, ranking, summaries.

Provenance is a fact from the inventory's source metadata; reach is a
capability the tool's own schema declares. The schema walk is bounded (depth
6), so it is unrolled level by level over per-row arrays of JSON nodes: narrow,
no shuffle, no recursion limit to tune.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seeds
from ..functions.regex import to_java

PROV_ORDER = {p: o for p, _, o in seeds.PROVENANCE}
PROV_LABEL = {p: lab for p, lab, _ in seeds.PROVENANCE}
REACH_LABEL = dict(seeds.REACH_LABEL)
CONCERN = dict(seeds.CONCERN)
URL_PARAM_JAVA = seeds.URL_PARAM
URL_IN_TEXT_JAVA = to_java(seeds.URL_IN_TEXT)

MAP_T = "map<string,string>"
ARR_T = "array<string>"


def provenance(name: Column, scope: Column, origin: Column) -> Column:
    """Project and temporary scope win over a familiar builtin name."""
    return (F.when(scope == "project", "project").when(scope == "temporary", "temporary")
            .when(name.isin(*seeds.BUILTIN_TOOLS), "builtin").when(origin == "package", "package")
            .when(scope == "user", "user").otherwise("unknown"))


def _is_obj(n: Column) -> Column:
    return F.ltrim(n).startswith("{")


def _is_arr(n: Column) -> Column:
    return F.ltrim(n).startswith("[")


def _node_hit(n: Column) -> Column:
    m = F.from_json(n, MAP_T)
    props = F.element_at(m, F.lit("properties"))
    keys = F.map_keys(F.from_json(props, MAP_T))
    return _is_obj(n) & F.coalesce(_is_obj(props) & F.exists(keys, lambda k: k.rlike(URL_PARAM_JAVA)), F.lit(False))


def _children(n: Column) -> Column:
    m = F.from_json(n, MAP_T)
    props = F.element_at(m, F.lit("properties"))
    pvals = F.when(_is_obj(props), F.map_values(F.from_json(props, MAP_T)))
    conts = F.filter(F.array(*[F.element_at(m, F.lit(c)) for c in seeds.SCHEMA_CONTAINERS]), lambda x: x.isNotNull())
    obj_kids = F.concat(F.coalesce(pvals, F.array().cast(ARR_T)), conts)
    arr_kids = F.from_json(n, ARR_T)
    return (F.when(_is_obj(n), obj_kids).when(_is_arr(n), arr_kids).otherwise(F.array().cast(ARR_T)))


def schema_declares_network(parameters: Column) -> Column:
    """A URL-like parameter name anywhere within the bounded schema walk."""
    nodes = F.array(parameters)
    hit = F.lit(False)
    for depth in range(seeds.SCHEMA_MAX_DEPTH + 1):
        hit = hit | F.exists(nodes, _node_hit)
        if depth < seeds.SCHEMA_MAX_DEPTH:
            nodes = F.flatten(F.transform(nodes, _children))
    return F.coalesce(hit, F.lit(False))


def reach(name: Column, prov: Column, net: Column, description: Column, guidelines: Column) -> Column:
    """Shell / local for genuine builtins, any bash is a shell, declared network, else unassessed."""
    url_text = (F.coalesce(description, F.lit("")).rlike(URL_IN_TEXT_JAVA)
                | F.coalesce(guidelines, F.lit("")).rlike(URL_IN_TEXT_JAVA))
    return (F.when(name.isin(*seeds.SHELL_TOOLS) & (prov == "builtin"), "shell")
            .when(name.isin(*seeds.LOCAL_TOOLS) & (prov == "builtin"), "local")
            .when(name.isin(*seeds.SHELL_TOOLS), "shell")
            .when(net | url_text, "network").otherwise("unknown"))


def _label(m: dict, c: Column) -> Column:
    return F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])[c]


def classify(tools: DataFrame) -> DataFrame:
    """T4: surface entries (provenance, reach, labels, glyph, concern)."""
    prov = provenance(F.col("name"), F.col("scope"), F.col("origin"))
    t = tools.withColumn("provenance", prov).withColumn("declares_network", schema_declares_network(F.col("parameters")))
    t = t.withColumn("reach", reach(F.col("name"), F.col("provenance"), F.col("declares_network"),
                                    F.col("description"), F.col("prompt_guidelines")))
    flagged = F.col("provenance").isin("project", "temporary", "unknown")
    where = F.when(F.col("path").isNotNull(), F.concat(F.lit(" ("), F.col("path"), F.lit(")"))).otherwise(F.lit(""))
    concern = F.lit(None).cast("string")
    for p, tmpl in reversed(seeds.CONCERN):
        before, _, after = tmpl.partition("{where}")
        concern = F.when(F.col("provenance") == p, F.concat(F.lit(before), where if "{where}" in tmpl else F.lit(""),
                                                             F.lit(after))).otherwise(concern)
    return t.select(
        "*", F.when(flagged, "⚠").otherwise("•").alias("glyph"),
        _label(PROV_LABEL, F.col("provenance")).alias("provenance_label"),
        _label(REACH_LABEL, F.col("reach")).alias("reach_label"),
        F.coalesce(F.col("name"), F.lit("(unnamed)")).alias("display_name"),
        concern.alias("concern"),
        _label({k: v for k, v in PROV_ORDER.items()}, F.col("provenance")).cast("int").alias("prov_ord"))


def rank(entries: DataFrame) -> DataFrame:
    """T5: attention order (project, temporary, unknown, package, user, builtin), then name."""
    w = Window.partitionBy("session_id").orderBy("prov_ord", "display_name")
    return entries.withColumn("rank", F.row_number().over(w).cast("int"))


def summary(entries: DataFrame) -> DataFrame:
    """Totals, not-yours count and a count per provenance (partial + final aggregate)."""
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("provenance").isin("project", "temporary", "unknown")).alias("not_yours")]
    aggs += [F.count_if(F.col("provenance") == p).alias(p) for p, _, _ in seeds.PROVENANCE]
    return entries.groupBy("session_id").agg(*aggs)


def entry_line(e=None) -> Column:
    """One display line: glyph, padded provenance label and name, path, reach label."""
    where = F.when(F.col("path").isNotNull(), F.concat(F.lit("  "), F.col("path"))).otherwise(F.lit(""))
    lab = F.col("provenance_label")
    name = F.col("display_name")
    return F.concat(F.col("glyph"), F.lit(" "), F.rpad(lab, F.greatest(F.length(lab), F.lit(9)), " "), F.lit(" "),
                    F.rpad(name, F.greatest(F.length(name), F.lit(14)), " "), where, F.lit(" — "), F.col("reach_label"))


def headline(total: Column, not_yours: Column) -> Column:
    return F.concat(total.cast("string"), F.lit(" tool"), F.when(total == 1, F.lit("")).otherwise(F.lit("s")),
                    F.lit(" available · "),
                    F.when(not_yours == 0, F.lit("all supplied by you or pi"))
                    .otherwise(F.concat(not_yours.cast("string"), F.lit(" not supplied by you"))))
