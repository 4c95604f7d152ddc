"""Detection and redaction jobs (D1-D15) over the corpus, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seeds
from ..functions.regex import to_re2
from ..operators import detect, redact
from ..operators.allow import allow_applies, compile_rules
from ..sources import fixtures
from ..sources.tables import documents, ensure_parallel
from . import oracle as O

KEYS = ["doc_id"]
SECRET_TYPES = detect.SECRET_TYPES


def _scan(spark, sf):
    return detect.with_scan(fixtures.fx_text(spark, sf))


def _scan_sql():
    return "WITH " + O.scan_ctes(O.fx_text_cte(), "fx_text", ["doc_id", "source", "lang"])


# D1 ------------------------------------------------------------------------
def pii_findings(spark: SparkSession, sf: str) -> DataFrame:
    return detect.findings(fixtures.fx_text(spark, sf), KEYS)


def pii_findings_sql() -> str:
    rules = compile_rules()
    parts = []
    for i, (t, _, _) in enumerate(seeds.PATTERNS):
        parts.append(
            f"SELECT doc_id, CAST({i} AS INTEGER) AS pattern_id, {O.q(t)} AS type, CAST(z.k AS INTEGER) AS match_no, "
            f"z.v AS value, {O.allowed_sql(rules, t, 'z.v')} AS allowed "
            f"FROM (SELECT doc_id, unnest(list_transform(p{i}, lambda x, k: {{'k': k, 'v': x}})) AS z FROM cand)")
    return (f"WITH {O.fx_text_cte()},\ncand AS ({O.candidates_sql('fx_text', KEYS)})\n"
            + "\nUNION ALL\n".join(parts))


# D2 / D3 -------------------------------------------------------------------
def _candidates(spark, sf, pattern_index):
    fx = fixtures.fx_text(spark, sf)
    (_, _, m), = detect.raw_matches(F.col("text"), [pattern_index])
    return detect.once(fx.select("doc_id", "text"), m.alias("m")).select("doc_id", F.posexplode("m").alias("pos", "candidate")).withColumn(
        "match_no", (F.col("pos") + 1).cast("int")).drop("pos")


CARD = [i for i, p in enumerate(seeds.PATTERNS) if p[0] == "credit-card"][0]
IBAN = [i for i, p in enumerate(seeds.PATTERNS) if p[0] == "iban"][0]


def card_luhn(spark, sf):
    c = _candidates(spark, sf, CARD)
    return c.select("doc_id", "match_no", "candidate",
                    F.regexp_replace("candidate", "[^0-9]", "").alias("digits"),
                    detect.luhn_ok(F.col("candidate")).alias("luhn_ok"))


def _cand_sql(pattern_index, cols):
    p = O.q(to_re2(seeds.PATTERNS[pattern_index][1]))
    return (f"WITH {O.fx_text_cte()},\nc AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, {p}), "
            f"lambda x, k: {{'k': k, 'v': x}})) AS z FROM fx_text)\n"
            f"SELECT doc_id, CAST(z.k AS INTEGER) AS match_no, z.v AS candidate, {cols} FROM c")


def card_luhn_sql():
    return _cand_sql(CARD, "regexp_replace(z.v, '[^0-9]', '', 'g') AS digits, " + O.luhn_sql("z.v") + " AS luhn_ok")


def iban_mod97(spark, sf):
    c = _candidates(spark, sf, IBAN)
    return c.select("doc_id", "match_no", "candidate", detect.iban_ok(F.col("candidate")).alias("iban_ok"))


def iban_mod97_sql():
    return _cand_sql(IBAN, O.iban_sql("z.v") + " AS iban_ok")


# D4 / D5 / D6 --------------------------------------------------------------
def pii_hits(spark, sf):
    return _scan(spark, sf).select("doc_id", F.inline("hits")).select("doc_id", "type", F.col("count").alias("hits"))


def pii_hits_sql():
    return _scan_sql() + "\nSELECT doc_id, h.type AS type, h.count AS hits FROM (SELECT doc_id, unnest(hits) AS h FROM scan)"


def pii_suppressed(spark, sf):
    return (_scan(spark, sf).select("doc_id", F.inline("suppressed"))
            .select("doc_id", "type", F.col("count").alias("suppressed")))


def pii_suppressed_sql():
    return (_scan_sql() + "\nSELECT doc_id, h.type AS type, h.count AS suppressed "
            "FROM (SELECT doc_id, unnest(suppressed) AS h FROM scan)")


def pii_samples(spark, sf):
    return (_scan(spark, sf).select("doc_id", F.posexplode("samples").alias("pos", "s"))
            .select("doc_id", (F.col("pos") + 1).cast("int").alias("sample_no"),
                    F.col("s.type").alias("type"), F.col("s.masked").alias("masked")))


def pii_samples_sql():
    return (_scan_sql() + "\nSELECT doc_id, CAST(z.k AS INTEGER) AS sample_no, z.s.type AS type, z.s.masked AS masked "
            "FROM (SELECT doc_id, unnest(list_transform(samples, lambda s, k: {'k': k, 's': s})) AS z FROM scan)")


# D7 ------------------------------------------------------------------------
def pii_units(spark, sf):
    s = _scan(spark, sf)
    return (s.where(F.size("hits") > 0)
            .select("doc_id", "source", "lang", F.size("hits").cast("int").alias("n_types"),
                    F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, h: a + h["count"]).alias("n_hits"),
                    detect.has_secret(F.col("hits")).alias("has_secret")))


def pii_units_sql():
    return (_scan_sql() + "\nSELECT doc_id, source, lang, CAST(len(hits) AS INTEGER) AS n_types, "
            "CAST(list_sum(list_transform(hits, lambda h: h.count)) AS BIGINT) AS n_hits, "
            f"{O.has_secret_sql('hits')} AS has_secret FROM scan WHERE len(hits) > 0")


def secret_units(spark, sf):
    s = _scan(spark, sf)
    return (s.select("doc_id", F.inline(detect.secret_hits(F.col("hits"))))
            .select("doc_id", "type", F.col("count").alias("hits")))


def secret_units_sql():
    types = ", ".join(O.q(t) for t in SECRET_TYPES)
    return (_scan_sql() + "\nSELECT doc_id, h.type AS type, h.count AS hits FROM "
            f"(SELECT doc_id, unnest(hits) AS h FROM scan) WHERE h.type IN ({types})")


# D8 / D9 -------------------------------------------------------------------
def redact_all(spark, sf):
    return redact.with_redacted(fixtures.fx_text(spark, sf)).select("doc_id", "redacted")


def redact_secrets(spark, sf):
    return redact.with_redacted(fixtures.fx_text(spark, sf), only=SECRET_TYPES).select("doc_id", "redacted")


def redact_sql_steps(src: str, text: str, only=None, rules=None) -> tuple[str, str]:
    """CTE chain rewriting `text`; returns (ctes, final cte name)."""
    rules = compile_rules() if rules is None else rules
    ctes, prev, col = [], src, text
    k = 0
    for i, (t, p, v) in enumerate(seeds.PATTERNS):
        if only is not None and t not in only:
            continue
        re2 = O.q(to_re2(p))
        ph = O.q(detect.PLACEHOLDER[t])
        if not v and not allow_applies(rules, t):
            expr = f"regexp_replace({col}, {re2}, {ph}, 'g')"
        else:
            keep = O.allowed_sql(rules, t, "m")
            if v:
                keep = f"({keep} OR NOT {O.VALIDATOR_SQL[v]('m')})"
            repl = f"list_transform(regexp_extract_all({col}, {re2}), lambda m: CASE WHEN {keep} THEN m ELSE {ph} END)"
            ctes.append(f"s{k} AS (SELECT *, string_split_regex({col}, {re2}) AS parts, {repl} AS repl FROM {prev})")
            prev = f"s{k}"
            expr = "array_to_string(list_transform(parts, lambda s, j: s || coalesce(repl[j], '')), '')"
        name = f"r{k}"
        drop = ["parts", "repl"] if f"s{k}" == prev else []
        if col == "rtext":
            drop.append(col)
        excl = f" EXCLUDE ({', '.join(drop)})" if drop else ""
        ctes.append(f"{name} AS (SELECT *{excl}, {expr} AS rtext FROM {prev})")
        prev, col, k = name, "rtext", k + 1
    return ",\n".join(ctes), prev


def redact_all_sql(only=None):
    ctes, last = redact_sql_steps("fx_text", "text", only)
    return f"WITH {O.fx_text_cte()},\n{ctes}\nSELECT doc_id, rtext AS redacted FROM {last}"


def redact_secrets_sql():
    return redact_all_sql(SECRET_TYPES)


# D12 / D13 / D14 -----------------------------------------------------------
def pii_summary(spark, sf):
    s = _scan(spark, sf)
    return s.where(F.size("hits") > 0).select("doc_id", detect.summary(F.col("hits")).alias("summary"))


def pii_summary_sql():
    return _scan_sql() + f"\nSELECT doc_id, {O.summary_sql('hits')} AS summary FROM scan WHERE len(hits) > 0"


def pii_detail(spark, sf):
    s = _scan(spark, sf)
    return (s.where((F.size("hits") > 0) | (F.size("suppressed") > 0))
            .select("doc_id", detect.detail(F.col("hits"), F.col("suppressed"), F.col("samples")).alias("detail")))


def pii_detail_sql():
    return (_scan_sql() + f"\nSELECT doc_id, {O.detail_sql('hits', 'suppressed', 'samples')} AS detail "
            "FROM scan WHERE len(hits) > 0 OR len(suppressed) > 0")


def pii_inline(spark, sf):
    s = _scan(spark, sf)
    return s.where(F.size("hits") > 0).select("doc_id", detect.inline(F.col("hits"), F.col("samples")).alias("inline"))


def pii_inline_sql():
    return _scan_sql() + f"\nSELECT doc_id, {O.inline_sql('hits', 'samples')} AS inline FROM scan WHERE len(hits) > 0"


# D15 -----------------------------------------------------------------------
def profile_of(scanned: DataFrame) -> DataFrame:
    """Hits, suppressed and affected units (rows with a hit) by source x lang x type with subtotals.

    A text adds one row per type and one for all types together, which alone counts it in the
    subtotals: no distinct count, and only sums by (source, lang, type) leave a task. The rollup runs
    over these few sums.
    """
    def count_of(field, t):
        return F.coalesce(F.get(F.filter(field, lambda h: h["type"] == t), 0)["count"], F.lit(0).cast("bigint"))

    def per_type(t):
        return F.struct(t.alias("type"), count_of("hits", t).alias("h"), count_of("suppressed", t).alias("s"))
    total = F.struct(F.lit(None).cast("string").alias("type"), F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("s"))
    types = F.transform(F.array(*[F.lit(t) for t in detect.TYPE_ORDER]), per_type)
    long = scanned.where((F.size("hits") > 0) | (F.size("suppressed") > 0)).select(
        "source", "lang", (F.size("hits") > 0).alias("any"), F.inline(F.concat(F.filter(types, lambda x: (x["h"] > 0) | (x["s"] > 0)), F.array(total))))
    sums = long.groupBy("source", "lang", "type").agg(F.sum("h").alias("h"), F.sum("s").alias("s"), F.count_if(F.col("h") > 0).alias("units"),
                                                      F.count_if("any").alias("any"))
    level = F.grouping("type") + F.grouping("lang") + F.grouping("source")
    rolled = sums.rollup("source", "lang", "type").agg(
        F.sum("h").alias("hits"), F.sum("s").alias("suppressed"), F.sum("units").alias("units"),
        F.sum(F.when(F.col("type").isNull(), F.col("any"))).alias("any"), level.alias("level"))
    return (rolled.where((F.col("level") > 0) | F.col("type").isNotNull())
            .select("source", "lang", "type", "hits", "suppressed", F.when(F.col("level") > 0, F.coalesce("any", F.lit(0))).otherwise(F.col("units")).alias("units")))


def pii_profile(spark, sf):
    return profile_of(detect.with_scan(ensure_parallel(documents(spark, sf)), sample_cap=0))


def pii_profile_fx(spark, sf):
    return profile_of(detect.with_scan(fixtures.fx_text(spark, sf), sample_cap=0))


def _profile_sql(src_cte, src):
    return ("WITH " + O.scan_ctes(src_cte, src, ["doc_id", "source", "lang"], sample_cap=0) + ",\n"
            "long AS (SELECT doc_id, source, lang, type, sum(h) AS h, sum(s) AS s FROM ("
            "SELECT doc_id, source, lang, x.type AS type, x.count AS h, 0 AS s FROM "
            "(SELECT doc_id, source, lang, unnest(hits) AS x FROM scan) UNION ALL "
            "SELECT doc_id, source, lang, x.type AS type, 0 AS h, x.count AS s FROM "
            "(SELECT doc_id, source, lang, unnest(suppressed) AS x FROM scan)) GROUP BY ALL)\n"
            "SELECT source, lang, type, CAST(sum(h) AS BIGINT) AS hits, CAST(sum(s) AS BIGINT) AS suppressed, "
            "CAST(count(DISTINCT CASE WHEN h > 0 THEN doc_id END) AS BIGINT) AS units "
            "FROM long WHERE h > 0 OR s > 0 GROUP BY ROLLUP (source, lang, type)")


def pii_profile_sql():
    return _profile_sql("docs AS (SELECT doc_id, source, lang, text FROM documents)", "docs")


def pii_profile_fx_sql():
    return _profile_sql(O.fx_text_cte(), "fx_text")


JOBS = {
    "pii_profile": (pii_profile, pii_profile_sql),
    "pii_profile_fx": (pii_profile_fx, pii_profile_fx_sql),
    "pii_findings": (pii_findings, pii_findings_sql),
    "card_luhn": (card_luhn, card_luhn_sql),
    "iban_mod97": (iban_mod97, iban_mod97_sql),
    "pii_hits": (pii_hits, pii_hits_sql),
    "pii_suppressed": (pii_suppressed, pii_suppressed_sql),
    "pii_samples": (pii_samples, pii_samples_sql),
    "pii_units": (pii_units, pii_units_sql),
    "secret_units": (secret_units, secret_units_sql),
    "redact_all": (redact_all, redact_all_sql),
    "redact_secrets": (redact_secrets, redact_secrets_sql),
    "pii_summary": (pii_summary, pii_summary_sql),
    "pii_detail": (pii_detail, pii_detail_sql),
    "pii_inline": (pii_inline, pii_inline_sql),
}
