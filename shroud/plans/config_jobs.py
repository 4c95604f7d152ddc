"""Configuration audit jobs (C1-C3), with SQL twins."""

from __future__ import annotations

from ..functions import seeds
from ..functions.regex import JS_SPACE
from ..operators import config_audit as C
from ..sources import fixtures
from ..sources.seedframes import seed_sql
from . import oracle as O

Q = O.q


def _cfg(spark, sf):
    return fixtures.config_settings(spark, sf)


def config_validate(spark, sf):
    return C.validate(_cfg(spark, sf)).select("host", "source", "key", "value_json", "valid", "value", "reason")


def config_floor(spark, sf):
    v = C.validate(_cfg(spark, sf)).where("valid AND source = 'project'")
    return C.floor(v).select("host", "key", "value", "kept", "violation")


def config_effective(spark, sf):
    return C.effective(C.validate(_cfg(spark, sf)))


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------

def _validate_ctes():
    def trim(x):
        return f"regexp_replace({x}, {Q(f'^[{JS_SPACE}]+|[{JS_SPACE}]+$')}, '', 'g')"
    split = Q(C.SPLIT)
    cases = []
    for k, (allowed, _) in C.ENUMS.items():
        lst = seeds.CONFIG_ENUM_SHOWN[k]
        al = ", ".join(Q(a) for a in allowed)
        env_v = f"lower({trim('sval')})"
        cases.append((f"key = {Q(k)} AND source <> 'env'", f"coalesce(lower(sval) IN ({al}), FALSE)", "lower(sval)",
                      f"CASE WHEN NOT coalesce(lower(sval) IN ({al}), FALSE) THEN 'config.{k}=' || value_json || ' is not one of {lst} — ignoring.' END"))
        cases.append((f"key = {Q(k)} AND source = 'env'", f"coalesce({env_v} IN ({al}), FALSE)", env_v,
                      f"CASE WHEN NOT coalesce({env_v} IN ({al}), FALSE) THEN '{k}=\"' || sval || '\" is not one of {lst} — ignoring, using the default.' END"))
    t_list = ", ".join(Q(x) for x in seeds.BOOL_TRUE)
    b_list = ", ".join(Q(x) for x in seeds.BOOL_TRUE + seeds.BOOL_FALSE)
    for k in seeds.CONFIG_BOOLS:
        cases.append((f"key = {Q(k)} AND source <> 'env'", "jt = 'BOOLEAN'", "lower(value_json)",
                      f"CASE WHEN jt <> 'BOOLEAN' THEN 'config.{k}=' || value_json || ' is not a boolean — ignoring.' END"))
        cases.append((f"key = {Q(k)} AND source = 'env'", f"coalesce(lower({trim('sval')}) IN ({b_list}), FALSE)",
                      f"CASE WHEN lower({trim('sval')}) IN ({t_list}) THEN 'true' ELSE 'false' END",
                      f"CASE WHEN NOT coalesce(lower({trim('sval')}) IN ({b_list}), FALSE) THEN '{k}=\"' || sval || '\" is not a boolean (true/false) — ignoring, using the default.' END"))
    kept = f"list_transform(list_filter(str_elems, lambda s: {trim('s')} <> ''), lambda s: {trim('s')})"
    env_list = f"list_filter(list_transform(string_split_regex(sval, {split}), lambda s: {trim('s')}), lambda s: s <> '')"
    cases.append(("key = 'piiAllow' AND source <> 'env'", f"coalesce(len({kept}) > 0, FALSE)", f"array_to_string({kept}, ',')",
                  "CASE WHEN elems IS NULL THEN 'config.piiAllow is not an array of strings — ignoring.' "
                  f"WHEN len({kept}) <> len(elems) THEN 'config.piiAllow has non-string/empty entries — dropping them.' END"))
    cases.append(("key = 'piiAllow' AND source = 'env'", f"len({env_list}) > 0", f"array_to_string({env_list}, ',')",
                  f"CASE WHEN len({env_list}) = 0 THEN 'piiAllow=\"' || sval || '\" has no entries — ignoring it.' END"))
    sl = ", ".join(Q(s) for s in seeds.BADGE_SINKS)
    sink_list = "|".join(seeds.BADGE_SINKS)
    sinks = f"list_filter(str_elems, lambda s: s IN ({sl}))"
    parts = f"list_filter(list_transform(string_split_regex(sval, {split}), lambda s: lower({trim('s')})), lambda s: s <> '')"
    env_sinks = f"list_filter({parts}, lambda s: s IN ({sl}))"
    bad = (f"list_transform(list_filter({parts}, lambda s: s NOT IN ({sl})), lambda s: 'badgeSinks: \"' || s || '\" is not a badge sink "
           f"({sink_list}) — dropping it.')")
    remarks = (f"array_to_string(list_concat({bad}, CASE WHEN len({env_sinks}) = 0 THEN ['badgeSinks=\"' || sval || "
               "'\" has no valid sinks — using the default chain.'] ELSE [] END), chr(10))")
    cases.append(("key = 'badgeSinks' AND source <> 'env'", f"coalesce(len({sinks}) > 0, FALSE)", f"array_to_string({sinks}, ',')",
                  "CASE WHEN elems IS NULL THEN 'config.badgeSinks is not an array — ignoring.' "
                  f"WHEN len({sinks}) = 0 THEN 'config.badgeSinks has no valid sinks ({sink_list}) — using the default chain.' END"))
    cases.append(("key = 'badgeSinks' AND source = 'env'", f"len({env_sinks}) > 0", f"array_to_string({env_sinks}, ',')",
                  f"CASE WHEN {remarks} <> '' THEN {remarks} END"))
    for k in seeds.CONFIG_STRINGS:
        cases.append((f"key = {Q(k)} AND source <> 'env'", f"coalesce({trim('sval')} <> '', FALSE)", trim("sval"),
                      f"CASE WHEN NOT coalesce({trim('sval')} <> '', FALSE) THEN 'config.{k}=' || value_json || ' is not a non-empty string — ignoring.' END"))
        cases.append((f"key = {Q(k)} AND source = 'env'", f"coalesce({trim('sval')} <> '', FALSE)", trim("sval"), "NULL"))
    for k in seeds.CODE_ONLY_OPTIONS:
        cases.append((f"key = {Q(k)} AND source <> 'env'", "FALSE", "NULL",
                      f"'config.{k} is a code-only option and can''t be set from JSON — it can only be passed in code.'"))
    cases.insert(0, ("source = 'env' AND sval = ''", "FALSE", "NULL", "NULL"))
    valid = "CASE " + " ".join(f"WHEN {c} THEN {ok}" for c, ok, _, _ in cases) + " ELSE FALSE END"
    value = "CASE " + " ".join(f"WHEN {c} THEN CASE WHEN {ok} THEN {val} END" for c, ok, val, _ in cases) + " END"
    reason_any = "CASE " + " ".join(f"WHEN {c} THEN {why}" for c, ok, _, why in cases) + " END"
    n = len(fixtures.CONFIG_TEMPLATES)
    return (f"cfg_tpl AS (SELECT * FROM {seed_sql(fixtures.config_rows(), fixtures.CONFIG_COLS)}),\n"
            f"cfg AS (SELECT CAST(floor(c.c_custkey / {fixtures.HOST_SIZE}) AS BIGINT) AS host, t.source, t.key, t.value_json "
            f"FROM customer c JOIN cfg_tpl t ON c.c_custkey % {n} = t.i),\n"
            "v0 AS (SELECT *, json_type(value_json) AS jt, CASE WHEN json_type(value_json) = 'VARCHAR' THEN "
            "json_extract_string(value_json, '$') END AS sval, CASE WHEN json_type(value_json) = 'ARRAY' THEN "
            "json_extract(value_json, '$[*]') END AS elems FROM cfg),\n"
            "v1 AS (SELECT *, list_transform(list_filter(elems, lambda e: json_type(e) = 'VARCHAR'), "
            "lambda e: json_extract_string(e, '$')) AS str_elems FROM v0),\n"
            f"val AS (SELECT host, source, key, value_json, coalesce({valid}, FALSE) AS valid, {value} AS value, "
            f"{reason_any} AS reason0 FROM v1),\n"
            "val2 AS (SELECT * EXCLUDE (reason0), reason0 AS reason FROM val)")


def _floor_ctes():
    rank = "CASE " + " ".join(f"WHEN key = {Q(k)} THEN coalesce(CASE value " + " ".join(
        f"WHEN {Q(a)} THEN {i}" for i, a in enumerate(allowed)) + " END, 0)" for k, (allowed, d) in C.ENUMS.items()) + " END"
    floor_rank = "CASE " + " ".join(f"WHEN key = {Q(k)} THEN {allowed.index(d)}" for k, (allowed, d) in C.ENUMS.items()) + " END"
    default = "CASE " + " ".join(f"WHEN key = {Q(k)} THEN {Q(d)}" for k, (_, d) in C.ENUMS.items()) + " END"
    prot = ", ".join(Q(k) for k in seeds.PROTECTIVE_WHEN_TRUE)
    why = "CASE " + " ".join(f"WHEN key = {Q(k)} THEN {Q(w)}" for k, w in seeds.PROJECT_MAY_NOT_SET) + " END"
    enum_keys = ", ".join(Q(k) for k in C.ENUMS)
    jv = f"CASE WHEN key IN ({enum_keys}) THEN '\"' || value || '\"' ELSE value END"
    msg = lambda fl: ("'project-local config sets ' || key || '=' || " + jv + " || ', which is WEAKER than the built-in default (' || "
                      + fl + " || ') — ignoring it. A project you open must not be able to turn off your privacy guards.'")
    viol = (f"CASE WHEN coalesce(({rank}) < ({floor_rank}), FALSE) THEN {msg(chr(39) + chr(34) + chr(39) + ' || ' + default + ' || ' + chr(39) + chr(34) + chr(39))} "
            f"WHEN key IN ({prot}) AND value = 'false' THEN {msg(Q('true'))} "
            f"WHEN ({why}) IS NOT NULL THEN 'project-local config sets ' || key || ' — ignoring it, since ' || ({why}) || '.' END")
    return f"fl AS (SELECT *, {viol} AS violation FROM val2 WHERE valid),\nfl2 AS (SELECT *, violation IS NULL AS kept FROM fl)"


def config_validate_sql():
    return f"WITH {_validate_ctes()}\nSELECT host, source, key, value_json, valid, value, reason FROM val2"


def config_floor_sql():
    return f"WITH {_validate_ctes()},\n{_floor_ctes()}\nSELECT host, key, value, kept, violation FROM fl2 WHERE source = 'project'"


def config_effective_sql():
    keys = ", ".join(Q(k) for k, _ in seeds.CONFIG_DEFAULTS)
    dflt = "CASE k.key " + " ".join(f"WHEN {Q(k)} THEN {Q(d)}" for k, d in seeds.CONFIG_DEFAULTS) + " END"
    return (f"WITH {_validate_ctes()},\n{_floor_ctes()},\n"
            "hf AS (SELECT DISTINCT host FROM val2 WHERE source = 'file'),\n"
            "cand AS (SELECT f.*, CASE WHEN source = 'env' THEN 0 WHEN source = 'project' THEN 2 ELSE 1 END AS prio FROM fl2 f WHERE "
            "(source IN ('env', 'file', 'project_trusted') OR (source = 'project' AND kept)) AND NOT "
            "(starts_with(source, 'project') AND host IN (SELECT host FROM hf))),\n"
            "ch AS (SELECT host, key, value, source FROM (SELECT *, row_number() OVER (PARTITION BY host, key ORDER BY prio, value, value_json) AS rn "
            "FROM cand) WHERE rn = 1),\n"
            f"hk AS (SELECT h.host, k.key FROM (SELECT DISTINCT host FROM cfg) h, (SELECT unnest([{keys}]) AS key) k)\n"
            f"SELECT k.host, k.key, coalesce(c.value, {dflt}) AS value, coalesce(c.source, 'default') AS source FROM hk k "
            "LEFT JOIN ch c USING (host, key)")


JOBS = {
    "config_validate": (config_validate, config_validate_sql),
    "config_floor": (config_floor, config_floor_sql),
    "config_effective": (config_effective, config_effective_sql),
}
