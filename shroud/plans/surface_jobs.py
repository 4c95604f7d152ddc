"""Tool-surface jobs (T1-T7), with SQL twins (the twin walks schemas with a recursive CTE)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seeds
from ..functions.regex import to_re2
from ..operators import schema_walk, surface as S
from ..sources import fixtures
from ..sources.seedframes import seed_sql
from . import oracle as O

K = ["session_id", "name"]


def entries(spark, sf):
    return S.classify(fixtures.tool_info(spark, sf))


def tool_provenance(spark, sf):
    return entries(spark, sf).select(*K, "provenance")


def tool_network_params(spark, sf):
    return entries(spark, sf).select(*K, "declares_network")


def tool_url_params(spark, sf):
    return schema_walk.url_parameters(fixtures.tool_info(spark, sf))


def tool_reach(spark, sf):
    return entries(spark, sf).select(*K, "reach")


def tool_surface(spark, sf):
    return entries(spark, sf).select(*K, "provenance", "reach", "glyph", "provenance_label", "reach_label",
                                     "concern", "path")


def surface_rank(spark, sf):
    return S.rank(entries(spark, sf)).select(*K, "rank")


def surface_summary(spark, sf):
    return S.summary(entries(spark, sf))


def surface_report(spark, sf):
    e = S.rank(entries(spark, sf))
    summ = S.summary(e)
    head = summ.select("session_id", F.lit(0).alias("line_no"), S.headline(F.col("total"), F.col("not_yours")).alias("line"))
    lines = e.where("provenance <> 'builtin'").select("session_id", F.col("rank").alias("line_no"), S.entry_line().alias("line"))
    shown = e.groupBy("session_id").agg(F.count_if(F.col("provenance") != "builtin").cast("int").alias("k"))
    coll = (summ.where("builtin > 0").join(shown, "session_id")
            .select("session_id", (F.col("k") + 1).alias("line_no"),
                    F.concat(F.lit("  … "), F.col("builtin").cast("string"), F.lit(" builtin")).alias("line")))
    return head.unionByName(lines).unionByName(coll).withColumn("line_no", F.col("line_no").cast("int"))


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------

def tools_cte():
    n = len(fixtures.TOOL_TEMPLATES)
    sh = "(t.i < 2 AND CAST(floor(p.p_partkey / 20) AS BIGINT) % 2 = 1)"
    return (f"tool_tpl AS (SELECT * FROM {seed_sql(fixtures.tool_rows(), fixtures.TOOL_COLS)}),\n"
            f"tools AS (SELECT CAST(floor(p.p_partkey / {n}) AS BIGINT) AS session_id, t.name, t.description, t.parameters, "
            f"t.prompt_guidelines, CASE WHEN {sh} THEN '.pi/extensions/' || t.name || '.ts' ELSE t.path END AS path, "
            f"CASE WHEN {sh} THEN 'local' ELSE t.source END AS source, CASE WHEN {sh} THEN 'project' ELSE t.scope END AS scope, "
            f"CASE WHEN {sh} THEN 'top-level' ELSE t.origin END AS origin FROM part p JOIN tool_tpl t ON p.p_partkey % {n} = t.i)")


def classified_ctes():
    builtin = ", ".join(O.q(t) for t in seeds.BUILTIN_TOOLS)
    local = ", ".join(O.q(t) for t in seeds.LOCAL_TOOLS)
    shell = ", ".join(O.q(t) for t in seeds.SHELL_TOOLS)
    url_param = O.q(seeds.URL_PARAM)
    url_text = O.q(to_re2(seeds.URL_IN_TEXT))
    conts = ", ".join(f"json_extract(w.node, {O.q('$.' + (c if c.isalnum() else chr(34) + c + chr(34)))})"
                      for c in seeds.SCHEMA_CONTAINERS)
    kids = (f"CASE WHEN json_type(w.node) = 'OBJECT' THEN list_concat(CASE WHEN json_type(json_extract(w.node, '$.properties')) "
            f"= 'OBJECT' THEN json_extract(w.node, '$.properties.*') ELSE [] END, list_filter([{conts}], lambda x: x IS NOT NULL)) "
            f"WHEN json_type(w.node) = 'ARRAY' THEN json_extract(w.node, '$[*]') ELSE [] END")
    hit = (f"(json_type(node) = 'OBJECT' AND coalesce(json_type(json_extract(node, '$.properties')) = 'OBJECT' AND "
           f"len(list_filter(json_keys(json_extract(node, '$.properties')), lambda k: regexp_matches(k, {url_param}))) > 0, FALSE))")
    prov = ("CASE WHEN scope = 'project' THEN 'project' WHEN scope = 'temporary' THEN 'temporary' "
            f"WHEN name IN ({builtin}) THEN 'builtin' WHEN origin = 'package' THEN 'package' WHEN scope = 'user' THEN 'user' "
            "ELSE 'unknown' END")
    labels = " ".join(f"WHEN {O.q(p)} THEN {O.q(lab)}" for p, lab, _ in seeds.PROVENANCE)
    ords = " ".join(f"WHEN {O.q(p)} THEN {o}" for p, _, o in seeds.PROVENANCE)
    rlab = " ".join(f"WHEN {O.q(r)} THEN {O.q(lab)}" for r, lab in seeds.REACH_LABEL)
    where = "CASE WHEN path IS NOT NULL THEN ' (' || path || ')' ELSE '' END"
    concern = "CASE " + " ".join(
        f"WHEN provenance = {O.q(p)} THEN {O.q(t.split('{where}')[0])}" + (f" || {where} || {O.q(t.split('{where}')[1])}" if "{where}" in t else "")
        for p, t in seeds.CONCERN) + " END"
    return (
        f"{tools_cte()},\n"
        "w AS (WITH RECURSIVE w(session_id, name, node, d) AS (SELECT session_id, name, CAST(parameters AS JSON), 0 FROM tools "
        f"UNION ALL SELECT w.session_id, w.name, c.child, w.d + 1 FROM w, LATERAL (SELECT unnest({kids}) AS child) c "
        f"WHERE w.d < {seeds.SCHEMA_MAX_DEPTH}) SELECT * FROM w),\n"
        f"net AS (SELECT session_id, name, bool_or({hit}) AS declares_network FROM w GROUP BY ALL),\n"
        f"c1 AS (SELECT t.*, {prov} AS provenance, coalesce(n.declares_network, FALSE) AS declares_network "
        "FROM tools t LEFT JOIN net n USING (session_id, name)),\n"
        f"c2 AS (SELECT *, CASE WHEN name IN ({shell}) AND provenance = 'builtin' THEN 'shell' "
        f"WHEN name IN ({local}) AND provenance = 'builtin' THEN 'local' WHEN name IN ({shell}) THEN 'shell' "
        f"WHEN declares_network OR regexp_matches(coalesce(description, ''), {url_text}) "
        f"OR regexp_matches(coalesce(prompt_guidelines, ''), {url_text}) THEN 'network' ELSE 'unknown' END AS reach FROM c1),\n"
        "ent AS (SELECT *, CASE WHEN provenance IN ('project', 'temporary', 'unknown') THEN '⚠' ELSE '•' END AS glyph, "
        f"CASE provenance {labels} END AS provenance_label, CASE reach {rlab} END AS reach_label, "
        f"coalesce(name, '(unnamed)') AS display_name, {concern} AS concern, CAST(CASE provenance {ords} END AS INTEGER) AS prov_ord "
        "FROM c2),\n"
        "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY prov_ord, display_name) AS INTEGER) AS rank FROM ent)")


def url_params_sql():
    containers = ", ".join(O.q(c) for c in ["properties", *seeds.SCHEMA_CONTAINERS])
    enters = "(NOT w.in_properties AND e.key IS NOT DISTINCT FROM 'properties')"
    return (f"WITH {tools_cte()},\n"
            # an element of an array has its position as key there
            "w AS (WITH RECURSIVE w(session_id, name, node, in_properties, depth, path, parameter) AS (SELECT session_id, name, "
            "CAST(parameters AS JSON), FALSE, 0, '$', CAST(NULL AS VARCHAR) FROM tools UNION ALL "
            f"SELECT w.session_id, w.name, e.value, {enters}, CASE WHEN {enters} THEN w.depth ELSE w.depth + 1 END, "
            "w.path || CASE WHEN json_type(w.node) = 'ARRAY' THEN '[' || e.key || ']' ELSE '.' || e.key END, "
            "CASE WHEN w.in_properties THEN e.key END FROM w, LATERAL (SELECT * FROM json_each(w.node)) e "
            f"WHERE w.depth <= {seeds.SCHEMA_MAX_DEPTH} AND json_type(w.node) IN ('OBJECT', 'ARRAY') AND CASE WHEN w.in_properties "
            f"THEN json_type(w.node) = 'OBJECT' ELSE json_type(w.node) = 'ARRAY' OR e.key IN ({containers}) END) SELECT * FROM w)\n"
            "SELECT session_id, name, path, parameter, CAST(depth - 1 AS INTEGER) AS depth FROM w "
            f"WHERE regexp_matches(parameter, {O.q(seeds.URL_PARAM)})")


def _sql(select):
    return f"WITH {classified_ctes()}\n{select}"


def summary_select():
    per = ", ".join(f"count(*) FILTER (WHERE provenance = {O.q(p)}) AS {p}" for p, _, _ in seeds.PROVENANCE)
    return ("SELECT session_id, count(*) AS total, count(*) FILTER (WHERE provenance IN ('project', 'temporary', 'unknown')) "
            f"AS not_yours, {per} FROM ent GROUP BY session_id")


def surface_report_sql():
    line = ("glyph || ' ' || rpad(provenance_label, CAST(greatest(length(provenance_label), 9) AS INTEGER), ' ') || ' ' || "
            "rpad(display_name, CAST(greatest(length(display_name), 14) AS INTEGER), ' ') || CASE WHEN path IS NOT NULL THEN '  ' || path "
            "ELSE '' END || ' — ' || reach_label")
    head = ("CAST(total AS VARCHAR) || ' tool' || CASE WHEN total = 1 THEN '' ELSE 's' END || ' available · ' || "
            "CASE WHEN not_yours = 0 THEN 'all supplied by you or pi' ELSE CAST(not_yours AS VARCHAR) || ' not supplied by you' END")
    return (f"WITH {classified_ctes()},\nsumm AS ({summary_select()})\n"
            f"SELECT session_id, CAST(0 AS INTEGER) AS line_no, {head} AS line FROM summ UNION ALL "
            f"SELECT session_id, rank AS line_no, {line} AS line FROM ranked WHERE provenance <> 'builtin' UNION ALL "
            "SELECT s.session_id, CAST(s.total - s.builtin + 1 AS INTEGER) AS line_no, '  … ' || CAST(s.builtin AS VARCHAR) "
            "|| ' builtin' AS line FROM summ s WHERE s.builtin > 0")


JOBS = {
    "tool_provenance": (tool_provenance, lambda: _sql("SELECT session_id, name, provenance FROM ent")),
    "tool_network_params": (tool_network_params, lambda: _sql("SELECT session_id, name, declares_network FROM ent")),
    "tool_url_params": (tool_url_params, url_params_sql),
    "tool_reach": (tool_reach, lambda: _sql("SELECT session_id, name, reach FROM ent")),
    "tool_surface": (tool_surface, lambda: _sql(
        "SELECT session_id, name, provenance, reach, glyph, provenance_label, reach_label, concern, path FROM ent")),
    "surface_rank": (surface_rank, lambda: _sql("SELECT session_id, name, rank FROM ranked")),
    "surface_summary": (surface_summary, lambda: _sql(summary_select())),
    "surface_report": (surface_report, surface_report_sql),
}
