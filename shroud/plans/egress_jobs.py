"""Egress analytics over tool calls (E1-E6), with SQL twins.

Spark judges each call from its own row with higher-order functions (no
shuffle). The DuckDB twin is deliberately relational instead: it unnests
segments and URLs into rows, classifies each URL in staged CTEs and folds the
verdicts back with FILTERed aggregates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seeds
from ..functions.regex import JS_SPACE, to_re2
from ..operators import egress as EG
from ..sources import fixtures
from ..sources.seedframes import seed_sql
from . import oracle as O

CALL_KEYS = ["session_id", "seq"]
AUTH = O.q(EG.AUTHORITY)
URL_RE2 = O.q(to_re2(seeds.URL_RE))
EGRESS_RE2 = O.q(to_re2(seeds.EGRESS_CMD))
SEG_RE2 = O.q(seeds.SEGMENT_SPLIT)
TRIM_RE2 = O.q(f"^[{JS_SPACE}]+|[{JS_SPACE}]+$")


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------

def _calls(spark, sf):
    return fixtures.tool_calls(spark, sf)


def _cmd():
    return F.coalesce(F.get_json_object("input_json", "$.command"), F.col("input_json"))


def command_segments(spark, sf):
    """Every segment of every shell line."""
    c = _calls(spark, sf).where("tool = 'bash'")
    return c.select(*CALL_KEYS, F.posexplode(EG.segments(_cmd())).alias("pos", "segment")).select(
        *CALL_KEYS, (F.col("pos") + 1).cast("int").alias("seg_no"), "segment")


def url_hosts(spark, sf):
    """Every http(s) URL in every call, its host and the loopback test."""
    c = _calls(spark, sf)
    u = c.select(*CALL_KEYS, F.posexplode(EG.urls(F.col("input_json"))).alias("pos", "url"))
    return u.select(*CALL_KEYS, (F.col("pos") + 1).cast("int").alias("url_no"), "url",
                    EG.url_host(F.col("url")).alias("host"), EG.is_local_url(F.col("url")).alias("is_local"))


def assessed(spark, sf):
    c = _calls(spark, sf)
    return c.withColumn("a", EG.assess(F.col("tool"), F.col("input_json")))


def egress_calls(spark, sf):
    """Per call, egress verdict, first remote target, sensitive files."""
    a = assessed(spark, sf)
    return a.select(*CALL_KEYS, "actor", "tool", F.col("a.egress").alias("egress"), F.col("a.target").alias("target"),
                    F.array_join("a.sensitive_files", ", ").alias("sensitive_files"))


def sensitive_file_refs(spark, sf):
    """E5: one row per sensitive-file label named by an egress call."""
    a = assessed(spark, sf)
    return a.select(*CALL_KEYS, F.posexplode("a.sensitive_files").alias("pos", "label")).select(
        *CALL_KEYS, (F.col("pos") + 1).cast("int").alias("file_no"), "label")


# ---------------------------------------------------------------------------
# DuckDB twin
# ---------------------------------------------------------------------------

def calls_cte() -> str:
    ev = session_events_cte()
    n = fixtures.N_SHELL_TEMPLATES
    return (f"{ev},\ncall_tpl AS (SELECT * FROM {seed_sql(fixtures.call_rows(), fixtures.CALL_COLS)}),\n"
            "calls AS (SELECT e.session_id, e.seq, e.ts, e.event_id, e.kind, "
            "CASE WHEN e.kind = 'user_bash' THEN 'user' ELSE 'model' END AS origin, "
            "CASE WHEN e.kind = 'user_bash' THEN 'bash' ELSE t.tool END AS tool, "
            "CASE WHEN e.kind = 'user_bash' THEN '! command' ELSE t.tool END AS actor, "
            "t.input_json, e.can_prompt, e.unattended, e.answer_i FROM sev e JOIN call_tpl t ON "
            f"(CASE WHEN e.kind = 'user_bash' THEN e.call_i % {n} ELSE e.call_i END) = t.i "
            "WHERE e.kind IN ('tool_call', 'user_bash'))")


def session_events_cte() -> str:
    kind = "CASE event_type " + " ".join(f"WHEN {O.q(a)} THEN {O.q(b)}" for a, b in fixtures.EVENT_KIND) + " END"
    return ("sev AS (SELECT user_id AS session_id, event_id * 10 AS seq, CAST(ts AS TIMESTAMP) AS ts, event_id, "
            f"{kind} AS kind, event_id % 16 AS snippet_i, event_id % 20 AS call_i, event_id % 9 AS provider_i, "
            "event_id % 5 AS answer_i, event_id % 7 <> 0 AS can_prompt, event_id % 11 = 0 AS unattended FROM events)")


DOTTED = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"


def _oct(c: str, k: int) -> str:
    return f"TRY_CAST(split_part({c}, '.', {k}) AS INTEGER)"


def _hexnum(s: str, base: int) -> str:
    digits = "0123456789abcdef"
    return (f"list_reduce(string_split(lower({s}), ''), lambda a, c: a * {base} + (instr('{digits}', c) - 1), "
            "CAST(0 AS DOUBLE))")


def url_ctes(src: str, keys: list[str], name: str = "ua") -> str:
    """Staged classification of (keys…, url) rows in `src`; final CTE `name`."""
    return _url_ctes(src, keys).replace("ua", name)


def _url_ctes(src: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    part = ("CASE WHEN regexp_matches(p, '^0[xX][0-9A-Fa-f]*$') THEN " + _hexnum("substr(p, 3)", 16) +
            " WHEN regexp_matches(p, '^0[0-7]+$') THEN " + _hexnum("p", 8) +
            " WHEN regexp_matches(p, '^[0-9]+$') THEN CAST(p AS DOUBLE) END")
    return (
        f"ua1 AS (SELECT {k}, url, regexp_matches(url, {AUTH}) AS ok, lower(regexp_extract(url, {AUTH}, 1)) AS h, "
        f"regexp_extract(url, {AUTH}, 2) AS port FROM {src}),\n"
        "ua2 AS (SELECT *, CASE WHEN len(string_split(h, '.')) > 1 AND string_split(h, '.')[-1] = '' "
        "THEN string_split(h, '.')[1:-2] ELSE string_split(h, '.') END AS labels FROM ua1),\n"
        f"ua3 AS (SELECT *, labels[-1] AS last, list_transform(labels, lambda p: {part}) AS vals FROM ua2),\n"
        "ua4 AS (SELECT *, CASE WHEN NOT (regexp_matches(last, '^[0-9]+$') OR regexp_matches(last, '^0[xX][0-9A-Fa-f]*$')) "
        "THEN NULL WHEN len(labels) > 4 OR len(list_filter(vals, lambda v: v IS NULL)) > 0 "
        "OR len(list_filter(vals[1:len(vals) - 1], lambda v: v > 255)) > 0 OR vals[-1] >= pow(256, 5 - len(labels)) "
        "THEN -1 ELSE CAST(list_reduce(vals[1:len(vals) - 1], lambda a, v: a * 256 + v, CAST(0 AS DOUBLE)) "
        "* pow(256, 5 - len(labels)) + vals[-1] AS BIGINT) END AS v4 FROM ua3),\n"
        "ua5 AS (SELECT *, CASE WHEN NOT ok OR NOT (port = '' OR (regexp_matches(port, '^[0-9]+$') "
        "AND TRY_CAST(port AS DOUBLE) <= 65535)) OR h = '' THEN NULL WHEN starts_with(h, '[') OR v4 IS NULL THEN h "
        "WHEN v4 >= 0 THEN CAST((v4 >> 24) & 255 AS VARCHAR) || '.' || CAST((v4 >> 16) & 255 AS VARCHAR) || '.' || "
        "CAST((v4 >> 8) & 255 AS VARCHAR) || '.' || CAST(v4 & 255 AS VARCHAR) END AS host FROM ua4),\n"
        "ua6 AS (SELECT *, split_part(CASE WHEN starts_with(host, '[') AND suffix(host, ']') "
        "THEN substr(host, 2, length(host) - 2) ELSE host END, '%', 1) AS hz FROM ua5),\n"
        "ua7 AS (SELECT *, string_split(hz, ':')[-1] AS l6 FROM ua6),\n"
        "ua8 AS (SELECT *, CASE WHEN contains(hz, ':') THEN CASE WHEN NOT contains(l6, '.') THEN hz "
        f"WHEN regexp_matches(l6, '{DOTTED}') AND greatest({_oct('l6', 1)}, {_oct('l6', 2)}, {_oct('l6', 3)}, {_oct('l6', 4)}) <= 255 "
        f"THEN substr(hz, 1, length(hz) - length(l6)) || printf('%x', {_oct('l6', 1)} * 256 + {_oct('l6', 2)}) || ':' || "
        f"printf('%x', {_oct('l6', 3)} * 256 + {_oct('l6', 4)}) END END AS h6 FROM ua7),\n"
        "ua9 AS (SELECT *, string_split(h6, '::') AS p6 FROM ua8),\n"
        "ua10 AS (SELECT *, CASE WHEN p6[1] = '' THEN [] ELSE string_split(p6[1], ':') END AS hd6, CASE WHEN len(p6) = 2 THEN "
        "CASE WHEN p6[2] = '' THEN [] ELSE string_split(p6[2], ':') END ELSE [] END AS tl6 FROM ua9),\n"
        "ua11 AS (SELECT *, list_concat(hd6, CASE WHEN len(p6) = 2 THEN list_transform(range(greatest(8 - len(hd6) - len(tl6), 0)), "
        "lambda x: '0') ELSE [] END, tl6) AS wd6 FROM ua10),\n"
        "ua12 AS (SELECT *, CASE WHEN ((len(p6) = 1 AND len(hd6) + len(tl6) = 8) OR (len(p6) = 2 AND len(hd6) + len(tl6) <= 7)) "
        "AND len(list_filter(wd6, lambda g: NOT regexp_matches(g, '^[0-9a-f]{1,4}$'))) = 0 THEN list_transform(wd6, lambda g: "
        f"CAST({_hexnum('g', 16)} AS BIGINT)) END AS w6 FROM ua11),\n"
        "ua AS (SELECT *, CASE WHEN host IS NULL THEN FALSE WHEN hz = 'localhost' OR suffix(hz, '.localhost') THEN TRUE "
        "WHEN contains(hz, ':') THEN coalesce(len(list_filter(w6[1:5], lambda x: x <> 0)) = 0 AND ((w6[6] = 0 AND w6[7] = 0 "
        "AND w6[8] IN (0, 1)) OR (w6[6] = 65535 AND ((w6[7] >> 8) = 127 OR (w6[7] = 0 AND w6[8] = 0)))), FALSE) "
        f"ELSE coalesce(regexp_matches(hz, '{DOTTED}') AND greatest({_oct('hz', 1)}, {_oct('hz', 2)}, {_oct('hz', 3)}, "
        f"{_oct('hz', 4)}) <= 255 AND ({_oct('hz', 1)} = 127 OR hz = '0.0.0.0'), FALSE) END AS is_local FROM ua12)")


def _files_sql(x: str) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches({x}, {O.q('(?i)' + to_re2(p))}) THEN {O.q(label)} END"
                      for label, p in seeds.SENSITIVE_FILES)
    return f"list_filter([{items}], lambda l: l IS NOT NULL)"


def _seg_list(cmd: str) -> str:
    return (f"list_filter(list_transform(string_split_regex({cmd}, {SEG_RE2}), "
            f"lambda s: regexp_replace(s, {TRIM_RE2}, '', 'g')), lambda s: s <> '')")


def assess_ctes() -> str:
    """CTEs ending in `assessed` (call columns + egress, target, files)."""
    local = ", ".join(O.q(t) for t in seeds.LOCAL_TOOLS)
    return (
        f"{calls_cte()},\n"
        "cmds AS (SELECT *, coalesce(json_extract_string(input_json, '$.command'), input_json) AS cmd FROM calls),\n"
        f"segs AS (SELECT session_id, seq, z.k AS seg_no, z.s AS seg FROM (SELECT session_id, seq, "
        f"unnest(list_transform({_seg_list('cmd')}, lambda s, k: {{'k': k, 's': s}})) AS z FROM cmds WHERE tool = 'bash')),\n"
        f"seg_u AS (SELECT session_id, seq, seg_no, y.j AS url_no, y.u AS url FROM (SELECT session_id, seq, seg_no, "
        f"unnest(list_transform(regexp_extract_all(seg, {URL_RE2}), lambda u, j: {{'j': j, 'u': u}})) AS y FROM segs)),\n"
        + url_ctes("seg_u", ["session_id", "seq", "seg_no", "url_no"], "sa") + ",\n"
        "seg_agg AS (SELECT session_id, seq, seg_no, count(*) AS n_urls, "
        "arg_min(url, url_no) FILTER (WHERE NOT is_local) AS remote FROM sa GROUP BY ALL),\n"
        "seg_eval AS (SELECT s.session_id, s.seq, s.seg_no, a.remote, (a.remote IS NOT NULL OR "
        f"(coalesce(a.n_urls, 0) = 0 AND regexp_matches(s.seg, {EGRESS_RE2}))) AS seg_egress FROM segs s "
        "LEFT JOIN seg_agg a USING (session_id, seq, seg_no)),\n"
        "bash_eval AS (SELECT session_id, seq, bool_or(seg_egress) AS egress, "
        "arg_min(remote, seg_no) FILTER (WHERE seg_egress AND remote IS NOT NULL) AS target FROM seg_eval GROUP BY ALL),\n"
        f"all_u AS (SELECT session_id, seq, y.j AS url_no, y.u AS url FROM (SELECT session_id, seq, "
        f"unnest(list_transform(regexp_extract_all(input_json, {URL_RE2}), lambda u, j: {{'j': j, 'u': u}})) AS y FROM calls)),\n"
        + url_ctes("all_u", ["session_id", "seq", "url_no"]) + ",\n"
        "other_eval AS (SELECT session_id, seq, arg_min(url, url_no) FILTER (WHERE NOT is_local) AS remote FROM ua GROUP BY ALL),\n"
        "assessed AS (SELECT c.*, CASE WHEN c.tool IN (" + local + ") THEN FALSE WHEN c.tool = 'bash' THEN coalesce(b.egress, FALSE) "
        "ELSE o.remote IS NOT NULL END AS egress, CASE WHEN c.tool IN (" + local + ") THEN NULL WHEN c.tool = 'bash' "
        "THEN b.target ELSE o.remote END AS target, CASE WHEN c.tool IN (" + local + ") THEN NULL "
        f"WHEN c.tool = 'bash' THEN CASE WHEN coalesce(b.egress, FALSE) THEN {_files_sql('c.cmd')} END "
        f"ELSE CASE WHEN o.remote IS NOT NULL THEN {_files_sql('c.input_json')} END END AS files0 "
        "FROM cmds c LEFT JOIN bash_eval b USING (session_id, seq) LEFT JOIN other_eval o USING (session_id, seq)),\n"
        "assessed2 AS (SELECT * EXCLUDE (files0), CASE WHEN len(files0) > 0 THEN files0 END AS files FROM assessed)")


def command_segments_sql():
    return (f"WITH {calls_cte()},\ncmds AS (SELECT *, coalesce(json_extract_string(input_json, '$.command'), input_json) "
            "AS cmd FROM calls WHERE tool = 'bash')\n"
            "SELECT session_id, seq, CAST(z.k AS INTEGER) AS seg_no, z.s AS segment FROM (SELECT session_id, seq, "
            f"unnest(list_transform({_seg_list('cmd')}, lambda s, k: {{'k': k, 's': s}})) AS z FROM cmds)")


def url_hosts_sql():
    return (f"WITH {calls_cte()},\nall_u AS (SELECT session_id, seq, y.j AS url_no, y.u AS url FROM (SELECT session_id, seq, "
            f"unnest(list_transform(regexp_extract_all(input_json, {URL_RE2}), lambda u, j: {{'j': j, 'u': u}})) AS y FROM calls)),\n"
            + url_ctes("all_u", ["session_id", "seq", "url_no"]) +
            "\nSELECT session_id, seq, CAST(url_no AS INTEGER) AS url_no, url, host, is_local FROM ua")


def egress_calls_sql():
    return (f"WITH {assess_ctes()}\nSELECT session_id, seq, actor, tool, egress, target, "
            "array_to_string(files, ', ') AS sensitive_files FROM assessed2")


def sensitive_file_refs_sql():
    return (f"WITH {assess_ctes()}\nSELECT session_id, seq, CAST(z.k AS INTEGER) AS file_no, z.l AS label FROM "
            "(SELECT session_id, seq, unnest(list_transform(files, lambda l, k: {'k': k, 'l': l})) AS z FROM assessed2)")


JOBS = {
    "command_segments": (command_segments, command_segments_sql),
    "url_hosts": (url_hosts, url_hosts_sql),
    "egress_calls": (egress_calls, egress_calls_sql),
    "sensitive_file_refs": (sensitive_file_refs, sensitive_file_refs_sql),
}
