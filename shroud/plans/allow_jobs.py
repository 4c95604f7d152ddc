"""Allowlist rule-table jobs (A1-A6), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seeds
from ..functions.regex import JS_SPACE
from ..operators import allow, detect
from ..session import cut_lineage
from ..sources import fixtures
from ..sources.seedframes import seed_df, seed_sql
from . import oracle as O

FKEYS = ["doc_id", "pattern_id", "match_no"]
TRIM_RE = f"^[{JS_SPACE}]+|[{JS_SPACE}]+$"


def _entries(spark, sf) -> DataFrame:
    e = fixtures.fx_allow_entry(spark, sf)
    return e.withColumn("entry", F.regexp_replace("raw", TRIM_RE, ""))


def allow_rules(spark, sf):
    """A1: every entry classified (kind NULL = unusable)."""
    return (allow.parse_rules(_entries(spark, sf), "entry")
            .select("host", "raw", "kind", "domain", "prefix_len", "net", "glob_regex"))


def rejection_message(raw):
    esc = F.regexp_replace(F.regexp_replace(raw, r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('piiAllow entry "'), esc, F.lit('" is not a usable pattern — ignoring it.'))


def allow_rejects(spark, sf):
    """A2: every unusable entry reported, never dropped in silence."""
    r = allow_rules(spark, sf)
    return r.where("kind IS NULL").select("host", "raw", rejection_message(F.col("raw")).alias("message"))


def rule_table(spark, sf, defaults: bool = True):
    """Every distinct usable fleet entry, with the defaults unless opted out."""
    e = fixtures.fx_allow_entry(spark, sf)
    if defaults:
        e = e.unionByName(seed_df(spark, [(-1, d) for d in seeds.DEFAULT_ALLOW], [("host", "BIGINT"), ("raw", "VARCHAR")]))
    return allow.parse_rules(e.withColumn("entry", F.regexp_replace("raw", TRIM_RE, "")), "entry").where("kind IS NOT NULL").select(
        "kind", "domain", "prefix_len", "net", "glob_regex", "glob_side", "glob_key").distinct()


def _findings(spark, sf, types=None):
    return detect.findings(fixtures.fx_text(spark, sf), ["doc_id"], rules=[], types=types).drop("allowed")


def _matched(spark, sf, kind, types=None):
    rules = rule_table(spark, sf).where(F.col("kind") == kind)
    f = _findings(spark, sf, types)
    f = cut_lineage(f) if kind == "glob" else f  # globs take the findings twice: their values, then the rows
    return allow.match_rules(f, rules, FKEYS).where(F.col("rule_kind") == kind).select(*FKEYS).distinct()


def allow_domain(spark, sf):
    return _matched(spark, sf, "domain", ["email"])


def allow_cidr(spark, sf):
    return _matched(spark, sf, "cidr", ["ip"])


def allow_glob(spark, sf):
    return _matched(spark, sf, "glob")


def allow_split(spark, sf):
    """Every finding with its allowed flag (suppressed, still reported)."""
    # Scanned once and checkpointed: the rule joins reuse the findings three or
    # four times, and 15 patterns a text each time would dominate the job.
    f = cut_lineage(_findings(spark, sf))
    hit = allow.match_rules(f, rule_table(spark, sf), FKEYS).select(*FKEYS).distinct().withColumn("allowed", F.lit(True))
    return (f.join(hit, FKEYS, "left")
            .select(*FKEYS, "type", "value", F.coalesce("allowed", F.lit(False)).alias("allowed")))


HOST_SIZE = 4      # consecutive entries belong to one host
OPT_OUT = (5, 2)   # hosts with host mod 5 = 2 do without the built-in entries


def allow_split_hosts(spark, sf):
    """A6 per host: each document is scanned by one host, whose own entries (and, unless it opted
    out, the built-in ones) decide."""
    entries = _entries(spark, sf).withColumn("host", F.floor(F.col("host") / HOST_SIZE).cast("bigint"))
    rules = allow.parse_rules(entries, "entry").where("kind IS NOT NULL")
    hosts = entries.agg((F.max("host") + 1).alias("n_hosts"))  # one row
    f = _findings(spark, sf).crossJoin(F.broadcast(hosts)).withColumn("host", F.col("doc_id") % F.col("n_hosts")).drop("n_hosts")
    out = entries.select("host").where(F.col("host") % OPT_OUT[0] == OPT_OUT[1])
    return allow.split_by_host(cut_lineage(f), rules, out).select(*FKEYS, "host", "type", "value", "allowed")


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------

def _trim_sql(x):
    return f"regexp_replace({x}, {O.q(TRIM_RE)}, '', 'g')"


def _parse_sql(src):
    e = "entry"
    cidr = r"^(\d{1,3}(?:\.\d{1,3}){3})/(\d{1,2})$"
    addr = f"regexp_extract({e}, {O.q(cidr)}, 1)"
    plen = f"TRY_CAST(regexp_extract({e}, {O.q(cidr)}, 2) AS INTEGER)"
    o = f"string_split({addr}, '.')"
    valid_ip = f"(len({o}) = 4 AND len(list_filter({o}, lambda x: regexp_matches(x, '^[0-9]{{1,3}}$') AND CAST(x AS INTEGER) <= 255)) = 4)"
    ipn = O.ip_int_sql(addr)
    mask = f"(CASE WHEN {plen} = 0 THEN 0 ELSE ((4294967295 << (32 - {plen})) & 4294967295) END)"
    kind = (f"CASE WHEN {e} = '' OR regexp_matches({e}, '^\\*+$') THEN NULL "
            f"WHEN regexp_matches({e}, {O.q(cidr)}) THEN CASE WHEN {valid_ip} AND {plen} <= 32 THEN 'cidr' END "
            f"WHEN starts_with({e}, '@') THEN CASE WHEN substr({e}, 2) <> '' THEN 'domain' END "
            f"WHEN NOT contains({e}, '@') AND contains({e}, '.') AND NOT contains({e}, '*') "
            f"AND NOT regexp_matches({e}, '^\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}}$') THEN 'domain' "
            f"ELSE 'glob' END")
    esc = (f"array_to_string(list_transform(string_split({e}, '*'), "
           f"lambda p: regexp_replace(p, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')), '.*')")
    return (f"SELECT *, k AS kind, CASE WHEN k = 'domain' THEN CASE WHEN starts_with({e}, '@') THEN lower(substr({e}, 2)) "
            f"ELSE lower({e}) END END AS domain, CASE WHEN k = 'cidr' THEN {plen} END AS prefix_len, "
            f"CASE WHEN k = 'cidr' THEN {ipn} & {mask} END AS net, CASE WHEN k = 'glob' THEN {esc} END AS glob_regex "
            f"FROM (SELECT *, {kind} AS k FROM {src})")


def _entries_sql():
    n = len(fixtures.ALLOW_ENTRY_TEMPLATES)
    return (f"tpl AS (SELECT * FROM {seed_sql(fixtures.allow_entry_rows(), fixtures.ALLOW_ENTRY_COLS)}),\n"
            f"ent AS (SELECT c.c_custkey AS host, t.raw, {_trim_sql('t.raw')} AS entry FROM customer c "
            f"JOIN tpl t ON c.c_custkey % {n} = t.i)")


def allow_rules_sql():
    return (f"WITH {_entries_sql()},\np AS ({_parse_sql('ent')})\n"
            "SELECT host, raw, kind, domain, prefix_len, net, glob_regex FROM p")


def allow_rejects_sql():
    msg = ("'piiAllow entry \"' || replace(replace(raw, '\\', '\\\\'), '\"', '\\\"') || "
           "'\" is not a usable pattern — ignoring it.'")
    return (f"WITH {_entries_sql()},\np AS ({_parse_sql('ent')})\n"
            f"SELECT host, raw, {msg} AS message FROM p WHERE kind IS NULL")


def _rules_sql():
    defaults = seed_sql([(-1, d) for d in seeds.DEFAULT_ALLOW], [("host", "BIGINT"), ("raw", "VARCHAR")])
    return (f"{_entries_sql()},\nallent AS (SELECT host, raw, entry FROM ent UNION ALL "
            f"SELECT host, raw, {_trim_sql('raw')} AS entry FROM {defaults}),\n"
            f"rules AS (SELECT DISTINCT kind, domain, prefix_len, net, glob_regex FROM ({_parse_sql('allent')}) "
            f"WHERE kind IS NOT NULL)")


def _findings_sql():
    parts = []
    for i, (t, _, _) in enumerate(seeds.PATTERNS):
        parts.append(f"SELECT doc_id, CAST({i} AS INTEGER) AS pattern_id, {O.q(t)} AS type, "
                     f"CAST(z.k AS INTEGER) AS match_no, z.v AS value "
                     f"FROM (SELECT doc_id, unnest(list_transform(p{i}, lambda x, k: {{'k': k, 'v': x}})) AS z FROM cand)")
    return (f"{O.fx_text_cte()},\ncand AS ({O.candidates_sql('fx_text', ['doc_id'])}),\n"
            f"f AS ({' UNION ALL '.join(parts)})")


def _matched_sql():
    dom = (f"SELECT DISTINCT doc_id, pattern_id, match_no, 'domain' AS rule_kind FROM f JOIN rules r ON r.kind = 'domain' "
           f"AND f.type = 'email' AND (lower(split_part(f.value, '@', -1)) = r.domain "
           f"OR suffix(lower(split_part(f.value, '@', -1)), '.' || r.domain))")
    cidr = (f"SELECT DISTINCT doc_id, pattern_id, match_no, 'cidr' AS rule_kind FROM f JOIN rules r ON r.kind = 'cidr' "
            f"AND f.type = 'ip' AND ({O.ip_int_sql('f.value')} & (CASE WHEN r.prefix_len = 0 THEN 0 ELSE "
            f"((4294967295 << (32 - r.prefix_len)) & 4294967295) END)) = r.net")
    glob = (f"SELECT DISTINCT doc_id, pattern_id, match_no, 'glob' AS rule_kind FROM f JOIN rules r ON r.kind = 'glob' "
            f"AND regexp_matches(f.value, '(?i)^(?:' || r.glob_regex || ')$')")
    return f"m AS ({dom} UNION ALL {cidr} UNION ALL {glob})"


def _kind_sql(kind):
    return (f"WITH {_rules_sql()},\n{_findings_sql()},\n{_matched_sql()}\n"
            f"SELECT DISTINCT doc_id, pattern_id, match_no FROM m WHERE rule_kind = '{kind}'")


def allow_split_sql():
    return (f"WITH {_rules_sql()},\n{_findings_sql()},\n{_matched_sql()}\n"
            "SELECT f.doc_id, f.pattern_id, f.match_no, f.type, f.value, "
            "EXISTS (SELECT 1 FROM m WHERE m.doc_id = f.doc_id AND m.pattern_id = f.pattern_id "
            "AND m.match_no = f.match_no) AS allowed FROM f")


def allow_split_hosts_sql():
    defaults = seed_sql([(-1, d) for d in seeds.DEFAULT_ALLOW], [("host", "BIGINT"), ("raw", "VARCHAR")])
    mask = "(CASE WHEN r.prefix_len = 0 THEN 0 ELSE ((4294967295 << (32 - r.prefix_len)) & 4294967295) END)"
    at = "lower(split_part(v.value, '@', -1))"
    return (f"WITH {_entries_sql()},\nallent AS (SELECT host // {HOST_SIZE} AS host, raw, entry FROM ent UNION ALL "
            f"SELECT host, raw, {_trim_sql('raw')} AS entry FROM {defaults}),\n"
            f"rules AS (SELECT DISTINCT host, kind, domain, prefix_len, net, glob_regex FROM ({_parse_sql('allent')}) WHERE kind IS NOT NULL),\n"
            f"{_findings_sql()},\nfh AS (SELECT f.*, f.doc_id % (SELECT max(host // {HOST_SIZE}) + 1 FROM ent) AS host FROM f),\n"
            "v AS (SELECT DISTINCT host, type, value, CASE WHEN type = 'ip' THEN value END AS ip FROM fh),\n"
            "m AS (SELECT DISTINCT v.host, v.type, v.value FROM v JOIN rules r ON r.host = v.host OR "
            f"(r.host = -1 AND v.host % {OPT_OUT[0]} <> {OPT_OUT[1]}) WHERE CASE r.kind "
            f"WHEN 'domain' THEN v.type = 'email' AND ({at} = r.domain OR suffix({at}, '.' || r.domain)) "
            f"WHEN 'cidr' THEN v.type = 'ip' AND ({O.ip_int_sql('ip')} & {mask}) = r.net "
            "ELSE regexp_matches(v.value, '(?i)^(?:' || r.glob_regex || ')$') END)\n"
            "SELECT doc_id, pattern_id, match_no, host, type, value, "
            "EXISTS (SELECT 1 FROM m WHERE m.host = fh.host AND m.type = fh.type AND m.value = fh.value) AS allowed FROM fh")


JOBS = {
    "allow_split_hosts": (allow_split_hosts, allow_split_hosts_sql),
    "allow_rules": (allow_rules, allow_rules_sql),
    "allow_rejects": (allow_rejects, allow_rejects_sql),
    "allow_domain": (allow_domain, lambda: _kind_sql("domain")),
    "allow_cidr": (allow_cidr, lambda: _kind_sql("cidr")),
    "allow_glob": (allow_glob, lambda: _kind_sql("glob")),
    "allow_split": (allow_split, allow_split_sql),
}
