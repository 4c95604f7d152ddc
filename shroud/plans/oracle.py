"""DuckDB twins of the Spark jobs (the correctness oracle).

Each function returns SQL text over the driver's views (documents, events, ...).
They are written independently in DuckDB's dialect (list lambdas, RE2 regexes)
from the same fixed values in `functions.seeds`, so a disagreement between the
two engines points at a real semantic slip rather than a shared typo in logic.
"""

from __future__ import annotations

from ..functions import seeds
from ..functions.regex import sql_str, to_re2
from ..operators.allow import compile_rules
from ..sources import fixtures
from ..sources.seedframes import seed_sql

TYPE_ORDER = [t[0] for t in seeds.PII_TYPES]
SECRET_TYPES = [t[0] for t in seeds.PII_TYPES if t[1]]
MASKED_TYPES = ["email", "ip", "mac", "private-key", "aws-key", "gh-token", "api-key", "jwt"]


def cn(t: str) -> str:
    return t.replace("-", "_")


def q(s: str) -> str:
    return sql_str(s)


# ---------------------------------------------------------------------------
# fixtures
# ---------------------------------------------------------------------------

def snippet_cte() -> str:
    return f"snippet AS (SELECT * FROM {seed_sql(fixtures.snippet_rows(), fixtures.SNIPPET_COLS)})"


def fx_text_cte() -> str:
    n = len(fixtures.SNIPPETS)
    return (snippet_cte() + ",\nfx_text AS (SELECT d.doc_id, d.source, d.lang, concat_ws(' ', d.text, t.s) AS text "
            f"FROM documents d JOIN snippet t ON d.doc_id % {n} = t.i)")


def fx_turn_cte() -> str:
    n = len(fixtures.SNIPPETS)
    return (snippet_cte() + ",\nfx_turn AS (SELECT c.conv_id, c.turn, c.role, concat_ws(' ', c.text, t.s) AS text "
            f"FROM conversations c JOIN snippet t ON (c.conv_id + c.turn) % {n} = t.i)")


# ---------------------------------------------------------------------------
# detection pieces
# ---------------------------------------------------------------------------

def luhn_sql(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return (f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({d}), ''), "
            f"lambda c, i: CASE WHEN i % 2 = 0 THEN CAST(translate(c, '0123456789', '0246813579') AS INTEGER) "
            f"ELSE CAST(c AS INTEGER) END)) % 10 = 0)")


def iban_sql(v: str) -> str:
    s = f"upper({v})"
    rot = f"(substr({s}, 5) || substr({s}, 1, 4))"
    return (f"(length({s}) BETWEEN 15 AND 34 AND list_reduce(string_split({rot}, ''), lambda acc, c: "
            f"CASE WHEN c BETWEEN 'A' AND 'Z' THEN (acc * 100 + ascii(c) - 55) % 97 "
            f"ELSE (acc * 10 + CAST(c AS INTEGER)) % 97 END, CAST(0 AS BIGINT)) = 1)")


VALIDATOR_SQL = {"luhn": luhn_sql, "mod97": iban_sql}


def ip_int_sql(v: str) -> str:
    o = f"string_split({v}, '.')"
    return (f"(CAST({o}[1] AS BIGINT) * 16777216 + CAST({o}[2] AS BIGINT) * 65536 + "
            f"CAST({o}[3] AS BIGINT) * 256 + CAST({o}[4] AS BIGINT))")


def allowed_sql(rules, typ: str, v: str) -> str:
    conds = []
    doms = [r.domain for r in rules if r.kind == "domain"]
    if typ == "email" and doms:
        d = f"lower(split_part({v}, '@', -1))"
        conds.append("(" + " OR ".join([f"{d} = {q(x)} OR suffix({d}, {q('.' + x)})" for x in doms]) + ")")
    cidrs = [r for r in rules if r.kind == "cidr"]
    if typ == "ip" and cidrs:
        n = ip_int_sql(v)
        conds.append("(" + " OR ".join(f"({n} & {r.mask}) = {r.net}" for r in cidrs) + ")")
    globs = [r.glob for r in rules if r.kind == "glob"]
    if globs:
        conds.append(f"regexp_matches({v}, {q('(?i)^(?:' + '|'.join(f'(?:{g})' for g in globs) + ')$')})")
    return "(" + " OR ".join(conds) + ")" if conds else "FALSE"


def mask_sql(typ: str, v: str) -> str:
    if typ == "email":
        local, dom = f"split_part({v}, '@', 1)", f"split_part({v}, '@', 2)"
        return (f"(CASE WHEN length({local}) > 2 THEN left({local}, 1) || '…' || right({local}, 1) "
                f"ELSE '…' END || '@' || {dom})")
    if typ == "ip":
        return f"regexp_replace({v}, '\\.[0-9]{{1,3}}$', '.•')"
    if typ == "mac":
        return f"(left({v}, 8) || ':••:••:••')"
    if typ == "private-key":
        return q(seeds.PRIVATE_KEY_MASK)
    return f"(left({v}, 6) || '… (' || CAST(length({v}) AS VARCHAR) || ' chars)')"


def candidates_sql(src: str, keys: list[str], text: str = "text") -> str:
    """SELECT keys, p0..p14 (validated candidates) FROM src."""
    cols = []
    for i, (t, p, v) in enumerate(seeds.PATTERNS):
        m = f"regexp_extract_all({text}, {q(to_re2(p))})"
        guard = seeds.PATTERN_GUARDS[i]
        if guard:
            m = f"CASE WHEN {' OR '.join(f'contains({text}, {q(g)})' for g in guard)} THEN {m} ELSE [] END"
        if v:
            m = f"list_filter({m}, lambda x: {VALIDATOR_SQL[v]('x')})"
        cols.append(f"{m} AS p{i}")
    return f"SELECT {', '.join(keys)}, {', '.join(cols)} FROM {src}"


def typed_sql(cand: str, keys: list[str], rules=None) -> str:
    rules = compile_rules() if rules is None else rules
    cols = []
    for t in TYPE_ORDER:
        ids = [i for i, (pt, _, _) in enumerate(seeds.PATTERNS) if pt == t]
        vals = f"p{ids[0]}" if len(ids) == 1 else "list_concat(" + ", ".join(f"p{i}" for i in ids) + ")"
        cols.append(f"list_transform({vals}, lambda x: {{'value': x, 'allowed': {allowed_sql(rules, t, 'x')}}}) AS v_{cn(t)}")
    return f"SELECT {', '.join(keys)}, {', '.join(cols)} FROM {cand}"


def scan_sql(typed: str, keys: list[str], sample_cap: int = seeds.DEFAULT_SAMPLE_CAP) -> str:
    def counts(flag: bool) -> str:
        cond = "x.allowed" if flag else "NOT x.allowed"
        items = ", ".join(f"{{'type': {q(t)}, 'count': CAST(len(list_filter(v_{cn(t)}, lambda x: {cond})) AS BIGINT)}}"
                          for t in TYPE_ORDER)
        return f"list_filter([{items}], lambda h: h.count > 0)"
    parts = []
    for t in TYPE_ORDER:
        if t not in MASKED_TYPES or sample_cap <= 0:
            continue
        m = f"list_transform(list_filter(v_{cn(t)}, lambda x: NOT x.allowed), lambda x: {mask_sql(t, 'x.value')})"
        dist = f"list_filter({m}, lambda y, j: list_position({m}, y) = j)"
        parts.append(f"list_transform(({dist})[1:{sample_cap}], lambda y: {{'type': {q(t)}, 'masked': y}})")
    samples = "list_concat(" + ", ".join(parts) + ")" if parts else "[]"
    return (f"SELECT {', '.join(keys)}, {counts(False)} AS hits, {counts(True)} AS suppressed, "
            f"{samples} AS samples FROM {typed}")


def scan_ctes(src_cte: str, src: str, keys: list[str], rules=None, sample_cap=seeds.DEFAULT_SAMPLE_CAP) -> str:
    """WITH-list text ending in `scan` (keys, hits, suppressed, samples)."""
    return (f"{src_cte},\ncand AS ({candidates_sql(src, keys)}),\n"
            f"typed AS ({typed_sql('cand', keys, rules)}),\n"
            f"scan AS ({scan_sql('typed', keys, sample_cap)})")


def phrase_sql(h: str) -> str:
    one = " ".join(f"WHEN {q(t[0])} THEN {q(t[3])}" for t in seeds.PII_TYPES)
    many = " ".join(f"WHEN {q(t[0])} THEN {q(t[4])}" for t in seeds.PII_TYPES)
    return (f"(CAST({h}.count AS VARCHAR) || ' ' || CASE WHEN {h}.count = 1 THEN CASE {h}.type {one} END "
            f"ELSE CASE {h}.type {many} END END)")


def summary_sql(hits: str) -> str:
    return f"array_to_string(list_transform({hits}, lambda h: {phrase_sql('h')}), ', ')"


def _shown(samples: str, h: str) -> str:
    return f"list_transform(list_filter({samples}, lambda s: s.type = {h}.type), lambda s: s.masked)"


def detail_sql(hits: str, supp: str, samples: str) -> str:
    shown = _shown(samples, "h")
    more = f"(h.count - len({shown}))"
    tail = (f"CASE WHEN len({shown}) > 0 THEN ': ' || array_to_string({shown}, ', ') || "
            f"CASE WHEN {more} > 0 THEN ', +' || CAST({more} AS VARCHAR) || ' more' ELSE '' END "
            f"ELSE {q(seeds.DETAIL_NOT_SHOWN)} END")
    lines = f"list_transform({hits}, lambda h: {q(seeds.DETAIL_BULLET)} || {phrase_sql('h')} || {tail})"
    sup = f"CASE WHEN len({supp}) > 0 THEN [{q(seeds.DETAIL_ALLOWLISTED)} || {summary_sql(supp)}] ELSE [] END"
    return f"array_to_string(list_concat({lines}, {sup}, [{q(seeds.DETAIL_CAVEAT)}]), chr(10))"


def inline_sql(hits: str, samples: str) -> str:
    shown = _shown(samples, "h")
    more = f"(h.count - len({shown}))"
    tail = (f"CASE WHEN len({shown}) > 0 THEN ' (' || array_to_string({shown}, ', ') || "
            f"CASE WHEN {more} > 0 THEN ', +' || CAST({more} AS VARCHAR) || ' more' ELSE '' END || ')' ELSE '' END")
    return f"array_to_string(list_transform({hits}, lambda h: {phrase_sql('h')} || {tail}), ', ')"


def has_secret_sql(hits: str) -> str:
    return f"len(list_filter({hits}, lambda h: h.type IN ({', '.join(q(t) for t in SECRET_TYPES)}))) > 0"
