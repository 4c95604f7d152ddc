"""Provider posture and attestation audit jobs (P1-P7), with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seeds
from ..operators import posture as P
from ..sources import fixtures
from ..sources.seedframes import seed_sql
from . import oracle as O
from .egress_jobs import session_events_cte, url_ctes

MK = ["session_id", "seq"]


def _ms(spark, sf):
    return fixtures.model_selects(spark, sf)


def _with_tiers(spark, sf):
    m = _ms(spark, sf)
    return (m.withColumn("effective_tier", P.effective_tier(F.col("provider"), F.col("base_url"), F.col("zdr_enforced"),
                                                          F.col("verified_tee")))
            .withColumn("capability_tier", P.capability_tier(F.col("provider"), F.col("base_url"), F.col("zdr_enforced"),
                                                            F.col("verified_tee"))))


def loopback_endpoints(spark, sf):
    """Every model endpoint seen at a switch, its parsed host and whether it
    is loopback (LAN and .local names are remote; unparseable is remote)."""
    from ..operators.egress import is_local_url, url_host
    m = _ms(spark, sf).where(F.col("base_url").isNotNull())
    return m.select(*MK, "provider", "base_url", url_host(F.col("base_url")).alias("host"),
                    is_local_url(F.col("base_url")).alias("is_local"))


def effective_tier(spark, sf):
    return _with_tiers(spark, sf).select(*MK, "provider", "model_id", "base_url", F.col("effective_tier").alias("tier"))


def capability_tier(spark, sf):
    return _with_tiers(spark, sf).select(*MK, "provider", "model_id", F.col("capability_tier").alias("tier"))


def tier_ladder(spark, sf):
    t = _with_tiers(spark, sf)
    tier = F.col("capability_tier")
    return t.select(*MK, tier.alias("tier"), P.tier_attr(tier, "rank").cast("int").alias("tier_rank"),
                    P.tier_attr(tier, "exposure").cast("int").alias("exposure"), P.tier_attr(tier, "label").alias("label"),
                    P.tier_attr(tier, "verifiability").alias("verifiability"), P.tier_attr(tier, "posture").alias("posture"))


def model_ranking(spark, sf):
    """The models each session used, strongest privacy first (rank, provider, id)."""
    t = _with_tiers(spark, sf).select("session_id", "provider", "model_id", "base_url", "zdr_enforced", "verified_tee",
                                      "capability_tier").distinct()
    att = P.attestable(F.col("provider"), F.col("verified_tee"))
    b = P.capability_badge(F.col("capability_tier"), att)
    w = Window.partitionBy("session_id").orderBy(P.tier_attr(F.col("capability_tier"), "rank"), "provider", "model_id", "base_url")
    return t.select(
        "session_id", "provider", "model_id", "base_url", F.col("capability_tier").alias("tier"),
        F.row_number().over(w).cast("int").alias("rank_no"), att.alias("attestable"),
        F.concat(b["glyph"], F.lit(" "), b["label"], F.lit("  ·  "), F.coalesce("provider", F.lit("?")), F.lit("/"),
                 F.coalesce("model_id", F.lit("?"))).alias("option_label"))


def attest_report_grade(spark, sf):
    r = fixtures.attest_reports(spark, sf)
    g = P.report_grade(F.col("raw"), F.col("nonce"))
    return r.select("report_id", g["has_address"].alias("has_address"), g["nvidia"].alias("nvidia"),
                    g["intel_tdx"].alias("intel_tdx"), g["nonce_echoed"].alias("nonce_echoed"),
                    g["posture"].alias("posture"), P.tier_from_tee(g["posture"]).alias("tier"))


def attest_key_grade(spark, sf):
    d = P.with_body_facts(fixtures.attest_docs(spark, sf))
    g = P.key_grade_of(F.col("format"), F.col("facts"), F.col("live_key"))
    return d.select("doc_id", "host", g["hardware"].alias("hardware"), g["attested_key"].alias("attested_key"),
                    g["matched"].alias("matched"), g["posture"].alias("posture"), P.tier_from_tee(g["posture"]).alias("tier"))


def resolve_tiers(m, spark, sf):
    """P7 over a model-switch frame: adds `tier` and `source`.

    Host override first; attested providers by their evidence grade; missing
    evidence (fetch failure) is tee-unverified, never standard; everything else
    by P1 without a base URL (as the runtime resolves it)."""
    # A switch's evidence is the document of one of all suppliers; number 0 has
    # none, so some fetches fail. The count is one row.
    n_docs = fixtures.read_table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n_docs"))
    m = m.join(F.broadcast(n_docs)).withColumn("evidence_id", F.col("event_id") % (F.col("n_docs") + 1)).drop("n_docs")
    keys = attest_key_grade(spark, sf).select(F.col("doc_id").alias("evidence_id"), F.col("tier").alias("key_tier"))
    reps = attest_report_grade(spark, sf).select(F.col("report_id").alias("evidence_id"), F.col("tier").alias("report_tier"))
    j = m.join(keys, "evidence_id", "left").join(reps, "evidence_id", "left")
    override = F.when((F.col("provider") == "acme-ai") & (F.col("session_id") % 5 == 0), F.lit("tee-verified"))
    base = P.effective_tier(F.col("provider"), F.lit(None).cast("string"), F.col("zdr_enforced"), F.lit(False))
    tier = F.coalesce(override,
                      F.when(F.col("provider") == "tinfoil", F.coalesce("key_tier", F.lit("tee-unverified")))
                      .when(F.col("provider") == "nearai", F.coalesce("report_tier", F.lit("tee-unverified")))
                      .otherwise(base))
    source = (F.when(override.isNotNull(), "host").when(F.col("provider") == "tinfoil", F.when(F.col("key_tier").isNull(),
              "fetch-failed").otherwise("key-pin")).when(F.col("provider") == "nearai", F.when(F.col("report_tier").isNull(),
              "fetch-failed").otherwise("report")).otherwise("static"))
    return j.withColumn("tier", tier).withColumn("source", source).drop("evidence_id", "key_tier", "report_tier")


def posture_resolution(spark, sf):
    """Final tier per model switch."""
    return resolve_tiers(_ms(spark, sf), spark, sf).select(*MK, "provider", "model_id", "tier", "source")


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------

def ms_cte():
    return (f"{session_events_cte()},\nprov_tpl AS (SELECT * FROM {seed_sql(fixtures.provider_rows(), fixtures.PROVIDER_COLS)}),\n"
            f"ep AS (SELECT * FROM {seed_sql(fixtures.endpoint_rows(), fixtures.ENDPOINT_COLS)}),\n"
            "ms AS (SELECT e.session_id, e.seq, e.event_id, t.provider, t.model_id, CASE WHEN t.provider = 'custom' "
            "THEN ep.endpoint ELSE t.base_url END AS base_url, e.session_id % 3 = 0 AS zdr_enforced, "
            "e.session_id % 4 = 0 AS verified_tee, e.can_prompt, e.unattended, e.answer_i FROM sev e "
            f"JOIN prov_tpl t ON e.provider_i = t.i JOIN ep ON e.event_id % {len(fixtures.ENDPOINTS)} = ep.j "
            "WHERE e.kind = 'model_select')")


def _cat(field, default="NULL"):
    idx = ["id", "label", "tier", "posture_aware", "attestable", "local", "base_url"].index(field)
    whens = " ".join(f"WHEN {O.q(p[0])} THEN {O.q(p[idx]) if isinstance(p[idx], str) else ('TRUE' if p[idx] else 'FALSE')}"
                     for p in seeds.PROVIDERS)
    return lambda c: f"(CASE {c} {whens} ELSE {default} END)"


def eff_sql(prov, loop, zdr, vt):
    known = ", ".join(O.q(p[0]) for p in seeds.PROVIDERS)
    return (f"CASE WHEN {prov} IS NULL OR {prov} NOT IN ({known}) THEN 'standard' WHEN {_cat('local', 'FALSE')(prov)} OR {loop} "
            f"THEN 'local' WHEN {prov} = 'openrouter' THEN CASE WHEN coalesce({zdr}, FALSE) THEN 'zdr-enforced' ELSE 'zdr-policy' END "
            f"WHEN {prov} = 'proxied-tee' THEN CASE WHEN coalesce({vt}, FALSE) THEN 'tee-verified' ELSE 'zdr-policy' END "
            f"ELSE {_cat('tier')(prov)} END")


def tiers_ctes():
    return (f"{ms_cte()},\nms_u AS (SELECT session_id, seq, base_url AS url FROM ms WHERE base_url IS NOT NULL),\n"
            + url_ctes("ms_u", ["session_id", "seq"]) + ",\n"
            "mt AS (SELECT m.*, coalesce(u.is_local, FALSE) AS loop FROM ms m LEFT JOIN ua u USING (session_id, seq)),\n"
            f"tiers AS (SELECT *, {eff_sql('provider', 'loop', 'zdr_enforced', 'verified_tee')} AS effective_tier, "
            f"CASE WHEN loop THEN 'local' ELSE {eff_sql('provider', 'loop', 'zdr_enforced', 'verified_tee')} END AS capability_tier "
            "FROM mt)")


def _tier_attr(c, attr):
    idx = ["tier", "label", "verifiability", "posture", "rank", "exposure"].index(attr)
    whens = " ".join(f"WHEN {O.q(t[0])} THEN {O.q(t[idx]) if isinstance(t[idx], str) else t[idx]}" for t in seeds.TIERS)
    return f"(CASE {c} {whens} END)"


def tier_ladder_sql():
    c = "capability_tier"
    return (f"WITH {tiers_ctes()}\nSELECT session_id, seq, {c} AS tier, CAST({_tier_attr(c, 'rank')} AS INTEGER) AS tier_rank, "
            f"CAST({_tier_attr(c, 'exposure')} AS INTEGER) AS exposure, {_tier_attr(c, 'label')} AS label, "
            f"{_tier_attr(c, 'verifiability')} AS verifiability, {_tier_attr(c, 'posture')} AS posture FROM tiers")


def model_ranking_sql():
    att = f"CASE WHEN provider = 'proxied-tee' THEN coalesce(verified_tee, FALSE) ELSE {_cat('attestable', 'FALSE')('provider')} END"
    badge = "CASE " + " ".join(
        f"WHEN capability_tier = {O.q(t)}" + ("" if a is None else f" AND att = {'TRUE' if a else 'FALSE'}") +
        f" THEN {O.q(g + ' ' + lab)}" for t, a, g, lab in seeds.CAPABILITY_BADGE) + " ELSE '• Standard' END"
    return (f"WITH {tiers_ctes()},\nd AS (SELECT DISTINCT session_id, provider, model_id, base_url, zdr_enforced, verified_tee, "
            f"capability_tier FROM tiers),\nd2 AS (SELECT *, {att} AS att FROM d)\n"
            "SELECT session_id, provider, model_id, base_url, capability_tier AS tier, CAST(row_number() OVER (PARTITION BY "
            f"session_id ORDER BY {_tier_attr('capability_tier', 'rank')}, provider, model_id, base_url) AS INTEGER) AS rank_no, "
            f"att AS attestable, {badge} || '  ·  ' || coalesce(provider, '?') || '/' || coalesce(model_id, '?') AS option_label FROM d2")


def reports_cte():
    k = "s_suppkey"
    nonce = f"CASE WHEN {k} % 11 = 0 THEN '' ELSE sha256('nonce' || CAST({k} AS VARCHAR)) END"
    addr = f"'0x' || substr(sha256(CAST({k} AS VARCHAR)), 1, 40)"
    echoed = f"CASE WHEN {k} % 7 <> 0 THEN {nonce} ELSE 'deadbeef' END"
    hw = (f"CASE WHEN {k} % 2 = 0 THEN ',\"nvidia_payload\":\"{{}}\"' ELSE '' END || "
          f"CASE WHEN {k} % 5 = 0 THEN ',\"intel_quote\":\"AAAA\"' ELSE '' END")
    ap = (f"CASE WHEN {k} % 3 = 0 THEN '' WHEN {k} % 3 = 1 THEN ',\"signing_address\":\"' || {addr} || '\"' "
          f"ELSE ',\"gateway\":{{\"SigningAddress\":\"' || {addr} || '\"}}' END")
    return (f"rep AS (SELECT {k} AS report_id, {nonce} AS nonce, '{{\"model\":\"' || s_name || '\",\"report_data\":\"' || "
            f"{echoed} || '\"' || {ap} || {hw} || '}}' AS raw FROM supplier)")


def report_grade_cte():
    blob = "lower(raw)"
    return (f"{reports_cte()},\nrg AS (SELECT report_id, coalesce(regexp_matches(raw, {O.q(P.ADDRESS_KEY.replace('(?i:', '(?i:'))}), FALSE) AS has_address, "
            f"contains({blob}, 'nvidia') OR contains({blob}, 'gpu') AS nvidia, contains({blob}, 'intel') OR contains({blob}, 'tdx') AS intel_tdx, "
            f"coalesce(length(nonce) >= {seeds.MIN_NONCE_LEN} AND contains({blob}, lower(nonce)), FALSE) AS nonce_echoed FROM rep),\n"
            "rg2 AS (SELECT *, CASE WHEN NOT has_address AND NOT (nvidia OR intel_tdx) THEN 'red' WHEN has_address AND "
            "(nvidia OR intel_tdx) AND nonce_echoed THEN 'green' ELSE 'yellow' END AS posture FROM rg),\n"
            "rg3 AS (SELECT *, CASE posture WHEN 'green' THEN 'tee-verified' WHEN 'yellow' THEN 'tee-unverified' ELSE 'standard' END AS tier FROM rg2)")


def docs_cte():
    k = "s_suppkey"
    key = f"sha256(CAST({k} AS VARCHAR))"
    return (f"docs AS (SELECT {k} AS doc_id, 'enclave-' || CAST({k} AS VARCHAR) || '.example.net' AS host, "
            f"CASE WHEN {k} % 4 = 3 THEN {O.q(fixtures.TDX_PREDICATE)} ELSE {O.q(fixtures.SEV_PREDICATE)} END AS format, "
            f"CASE WHEN {k} % 13 = 0 THEN NULL ELSE upper(repeat('00', 80) || {key} || repeat('00', 32)) END AS report_hex, "
            f"CASE WHEN {k} % 4 = 1 THEN sha256('other' || CAST({k} AS VARCHAR)) WHEN {k} % 4 = 2 THEN NULL ELSE {key} END AS live_key "
            "FROM supplier)")


def key_grade_cte():
    f = "lower(coalesce(format, ''))"
    return (f"{docs_cte()},\nkg AS (SELECT doc_id, host, list_filter([CASE WHEN regexp_matches({f}, 'sev|snp') THEN 'AMD SEV-SNP' END, "
            f"CASE WHEN contains({f}, 'tdx') THEN 'Intel TDX' END, CASE WHEN contains({f}, 'nitro') THEN 'AWS Nitro' END], "
            f"lambda x: x IS NOT NULL) AS hw, CASE WHEN contains({f}, 'sev-snp-guest') AND length(report_hex) / 2 >= "
            f"{seeds.SEV_REPORT_MIN_BYTES} THEN lower(substr(report_hex, {2 * seeds.SEV_KEY_OFFSET + 1}, "
            f"{2 * (seeds.SEV_KEY_END - seeds.SEV_KEY_OFFSET)})) END AS attested_key, report_hex, live_key FROM docs),\n"
            "kg2 AS (SELECT *, coalesce(regexp_matches(live_key, '^[0-9A-Fa-f]{64}$') AND report_hex IS NOT NULL AND "
            "(coalesce(attested_key = lower(live_key), FALSE) OR position(upper(live_key) IN report_hex) % 2 = 1), FALSE) AS matched FROM kg),\n"
            "kg3 AS (SELECT *, CASE WHEN len(hw) = 0 AND attested_key IS NULL THEN 'red' WHEN len(hw) > 0 AND matched THEN 'green' "
            "ELSE 'yellow' END AS posture FROM kg2),\n"
            "kg4 AS (SELECT *, CASE posture WHEN 'green' THEN 'tee-verified' WHEN 'yellow' THEN 'tee-unverified' ELSE 'standard' END AS tier FROM kg3)")


EVIDENCE_ID = "m.event_id % ((SELECT count(*) FROM supplier) + 1)"


def posture_resolution_sql():
    base = eff_sql("m.provider", "FALSE", "m.zdr_enforced", "FALSE")
    ov = "CASE WHEN m.provider = 'acme-ai' AND m.session_id % 5 = 0 THEN 'tee-verified' END"
    return (f"WITH {ms_cte()},\n{report_grade_cte()},\n{key_grade_cte()}\n"
            f"SELECT m.session_id, m.seq, m.provider, m.model_id, coalesce({ov}, CASE WHEN m.provider = 'tinfoil' THEN "
            "coalesce(k.tier, 'tee-unverified') WHEN m.provider = 'nearai' THEN coalesce(r.tier, 'tee-unverified') "
            f"ELSE {base} END) AS tier, CASE WHEN {ov} IS NOT NULL THEN 'host' WHEN m.provider = 'tinfoil' THEN CASE WHEN "
            "k.tier IS NULL THEN 'fetch-failed' ELSE 'key-pin' END WHEN m.provider = 'nearai' THEN CASE WHEN r.tier IS NULL "
            "THEN 'fetch-failed' ELSE 'report' END ELSE 'static' END AS source FROM ms m "
            f"LEFT JOIN kg4 k ON k.doc_id = {EVIDENCE_ID} LEFT JOIN rg3 r ON r.report_id = {EVIDENCE_ID}")


JOBS = {
    "loopback_endpoints": (loopback_endpoints, lambda: f"WITH {ms_cte()},\nms_u AS (SELECT session_id, seq, base_url AS url "
                           "FROM ms WHERE base_url IS NOT NULL),\n" + url_ctes("ms_u", ["session_id", "seq"]) +
                           "\nSELECT u.session_id, u.seq, m.provider, u.url AS base_url, u.host, u.is_local FROM ua u "
                           "JOIN ms m USING (session_id, seq)"),
    "effective_tier": (effective_tier, lambda: f"WITH {tiers_ctes()}\nSELECT session_id, seq, provider, model_id, base_url, "
                       "effective_tier AS tier FROM tiers"),
    "capability_tier": (capability_tier, lambda: f"WITH {tiers_ctes()}\nSELECT session_id, seq, provider, model_id, "
                        "capability_tier AS tier FROM tiers"),
    "tier_ladder": (tier_ladder, tier_ladder_sql),
    "model_ranking": (model_ranking, model_ranking_sql),
    "attest_report_grade": (attest_report_grade, lambda: f"WITH {report_grade_cte()}\nSELECT report_id, has_address, nvidia, "
                            "intel_tdx, nonce_echoed, posture, tier FROM rg3"),
    "attest_key_grade": (attest_key_grade, lambda: f"WITH {key_grade_cte()}\nSELECT doc_id, host, array_to_string(hw, ', ') AS "
                         "hardware, attested_key, matched, posture, tier FROM kg4"),
    "posture_resolution": (posture_resolution, posture_resolution_sql),
}
