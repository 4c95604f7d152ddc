"""Session replay jobs (W1-W11, P8, E6-E9), with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seeds
from ..operators import detect
from ..operators import posture as P
from ..operators import session as S
from ..operators.running import by_heat, running
from ..session import cut_lineage
from ..sources import fixtures
from ..sources.seedframes import broadcast_seed
from . import posture_jobs

TYPES = detect.TYPE_ORDER
RESOLVE_NEVER_LANDS = 6   # attestation never lands when event_id mod 6 = 0
RESOLVE_LATE = 4          # it lands several events later when event_id mod 4 = 1
LATE_BY = 35              # between the third and the fourth event after the switch
LANDS_S, LANDS_LATE_S = 5, 420  # seconds from a switch to its resolution


def _events(spark, sf, events=None):
    ev = fixtures.session_events(spark, sf, events)
    return ev.select("*", *S.policies(F.col("session_id")))


def switches(spark, sf, ev):
    """The model switches among `ev` with their ceiling and, where attestation landed, the resolved tier."""
    tpl = broadcast_seed(spark, fixtures.provider_rows(), fixtures.PROVIDER_COLS)
    ep = broadcast_seed(spark, fixtures.endpoint_rows(), fixtures.ENDPOINT_COLS)
    ms = (ev.where("kind = 'model_select'").join(tpl, ev.provider_i == tpl.i)
          .join(ep, (ev.event_id % len(fixtures.ENDPOINTS)) == ep.j)
          .withColumn("base_url", F.when(F.col("provider") == "custom", F.col("endpoint")).otherwise(F.col("base_url")))
          .withColumn("zdr_enforced", F.col("session_id") % 3 == 0)
          .withColumn("verified_tee", F.col("session_id") % 4 == 0)
          .drop("i", "j", "endpoint"))
    ms = posture_jobs.resolve_tiers(ms, spark, sf)
    return (ms.withColumn("ceiling", P.effective_tier(F.col("provider"), F.lit(None).cast("string"), F.col("zdr_enforced"),
                                                      F.lit(False)))
            .withColumn("resolved", F.when(F.col("event_id") % RESOLVE_NEVER_LANDS != 0, F.col("tier")))
            .drop("tier", "source", "base_url", "verified_tee"))


def resolutions(spark, sf, ms=None):
    """The resolution events: one for each switch whose posture landed, at its own place in the session."""
    ms = switches(spark, sf, _events(spark, sf)) if ms is None else ms
    late = F.col("event_id") % RESOLVE_LATE == 1
    return ms.where(F.col("event_id") % RESOLVE_NEVER_LANDS != 0).select(
        "session_id", (F.col("seq") + F.when(late, LATE_BY).otherwise(1)).alias("seq"),
        (F.col("ts") + F.when(late, F.expr(f"INTERVAL {LANDS_LATE_S} SECONDS")).otherwise(F.expr(f"INTERVAL {LANDS_S} SECONDS"))).alias("ts"),
        "event_id", F.lit("tier_resolved").alias("kind"), "resolved", "can_prompt", "unattended", "answer_i",
        "pii_policy", "exfil_policy", "result_policy", "downgrade_policy", "surface_policy", F.col("seq").alias("switch_seq"))


def timeline(spark, sf, events=None, landed: bool = True, scan: bool = True):
    """One row per session event, and with `landed` a `tier_resolved` row for each
    switch whose posture resolved; payload rows carry per-type message hit counts.
    Without `scan` these are left out. `events` may be a streaming DataFrame: every
    step here is stateless or a stream-static join."""
    ev = _events(spark, sf, events)
    ms = switches(spark, sf, ev)
    tl = ev.where(~F.col("kind").eqNullSafe("model_select")).unionByName(ms, allowMissingColumns=True)
    if landed:
        tl = tl.unionByName(resolutions(spark, sf, ms).drop("switch_seq"), allowMissingColumns=True)
    return with_message_hits(spark, tl) if scan else tl


def message_hits(spark, tl):
    """The `hits` (type, count) of each request's new message; empty on other rows."""
    snip = broadcast_seed(spark, fixtures.snippet_rows(), fixtures.SNIPPET_COLS)
    tl = (tl.join(snip, F.coalesce(tl.snippet_i, F.lit(-1)) == snip.i, "left")
          .withColumn("text", F.when(F.col("kind") == "payload", F.col("s")).otherwise(F.lit("")))
          .drop("i", "s"))
    return detect.with_scan(tl, sample_cap=0).drop("suppressed", "samples", "text")


def with_message_hits(spark, tl):
    """Per-type hit counts (m_<type>) of each request's new message; 0 on other rows."""
    tl = message_hits(spark, tl)
    for t in TYPES:
        tl = tl.withColumn(f"m_{detect.col_name(t)}", F.coalesce(F.get(F.filter("hits", _is_type(t)), 0)["count"], F.lit(0)))
    return tl.drop("hits")


def _is_type(t):
    return lambda h: h["type"] == t


STATE_KINDS = ["payload", "model_select", "tier_resolved"]


def replay(spark, sf, gate: bool = True):
    """Only payloads, switches and resolutions carry PII-gate / tier state, so
    tool rows are left out before the session passes. The scanned timeline (counts
    and scalars, no text) is checkpointed once."""
    base = cut_lineage(timeline(spark, sf).where(F.col("kind").isin(*STATE_KINDS)))

    def passes(rows, run):
        tl = S.downgrade(S.context_state(rows, run), run)
        return S.pii_gate(tl, run) if gate else tl
    return by_heat(base, "session_id", passes)


# W1 -------------------------------------------------------------------------
def context_hits(spark, sf):
    """W1 over conversations: hits of the whole conversation so far, per turn."""
    turns = detect.with_scan(fixtures.fx_turn(spark, sf), sample_cap=0).drop("suppressed", "samples", "text")
    for t in TYPES:
        turns = turns.withColumn(f"m_{detect.col_name(t)}", F.coalesce(F.get(F.filter("hits", _is_type(t)), 0)["count"],
                                                                        F.lit(0)))
    r = running(turns, ["conv_id"], "turn", [(f"c_{detect.col_name(t)}", "sum", F.col(f"m_{detect.col_name(t)}"), True)
                                             for t in TYPES])
    return r.select("conv_id", "turn", F.inline(S.hit_array("c_"))).select(
        "conv_id", "turn", "type", F.col("count").alias("hits"))


# W2 / W3 / W4 / W5 ------------------------------------------------------------
def provider_epoch(spark, sf):
    """W2 over switches only: nothing is scanned."""
    ms = switches(spark, sf, _events(spark, sf)).select("session_id", "seq", "kind", "provider", F.lit(None).cast("string").alias("resolved"))
    r = by_heat(ms, "session_id", lambda rows, run: S.with_epoch(S.tier_state(rows, run), run))
    return r.select("session_id", "seq", "provider", F.col("epoch").cast("bigint").alias("epoch"))


def pii_baseline(spark, sf):
    r = replay(spark, sf).where("gated")
    base = S.hit_array("base_")
    return r.select("session_id", "seq", F.inline(F.filter(
        F.array(*[F.struct(F.lit(t).alias("type"), F.col(f"base_{detect.col_name(t)}").cast("bigint").alias("count"))
                  for t in TYPES]), lambda h: h["count"] > 0))).select("session_id", "seq", "type",
                                                                      F.col("count").alias("baseline"))


def new_pii(spark, sf):
    r = replay(spark, sf).where("gated")
    return r.select("session_id", "seq", F.inline("fresh")).select("session_id", "seq", "type", F.col("count").alias("delta"))


def pii_gate(spark, sf):
    r = replay(spark, sf).where("kind = 'payload'")
    return r.select("session_id", "seq", F.col("epoch").cast("bigint").alias("epoch"), F.col("tier_now").alias("tier"),
                    "gated", F.coalesce(F.col("is_fresh"), F.lit(False)).alias("fresh"), "prompted", "action")


# W9 / W10 -------------------------------------------------------------------
def downgrade_guard(spark, sf):
    r = replay(spark, sf, gate=False).where("dg_pass IS NOT NULL")
    return r.select("session_id", "seq", F.col("dg_pass").cast("int").alias("pass_no"), F.col("dg_from").alias("from_tier"), F.col("dg_to").alias("to_tier"),
                    F.col("dg_severity").alias("severity"), F.col("dg_decision").alias("decision"))


def downgrade_report(spark, sf):
    r = replay(spark, sf, gate=False).where("dg_pass IS NOT NULL")
    lab = lambda c: P.tier_attr(c, "label")
    carried = F.when(F.size("ctx") > 0, F.concat(F.lit("carrying "), detect.summary(F.col("ctx")))).otherwise(
        F.lit("already in context"))
    target = F.concat(F.lit(" to "), F.col("dg_model"))
    text = F.concat(F.lit("⚠ Privacy downgrade: "), lab(F.col("dg_from")), F.lit(" → "), lab(F.col("dg_to")),
                    F.lit(". This session's history — "), carried, F.lit(" — will be re-sent"), target,
                    F.lit(" on the next turn. Detection is best-effort structured PII/secrets, so treat it as a floor, "
                          "not a full inventory."))
    return r.select("session_id", "seq", text.alias("warning"))


# P8 -------------------------------------------------------------------------
def posture_timeline(spark, sf):
    """Badge text per event; only changes are emitted (pending marker while unknown)."""
    tl = timeline(spark, sf, scan=False).where(F.col("kind").isin(*STATE_KINDS)).select("session_id", "seq", "kind", "provider", "resolved")
    return by_heat(tl, "session_id", lambda rows, run: badge_changes(S.tier_state(rows, run), run))


def badge_changes(tl, run=running):
    """P8 over a timeline with `tier_now`: the badge at switches, resolutions and
    requests, emitted only where it differs from the previous badge."""
    badge = F.when(F.col("kind").isin("model_select", "tier_resolved", "payload"), P.badge(F.col("tier_now")))
    r = run(tl.withColumn("badge", badge), ["session_id"], "seq", [("prev_badge", "last", F.col("badge"), False)],
            materialize=False)
    return r.where(F.col("badge").isNotNull() & ~F.col("badge").eqNullSafe(F.col("prev_badge"))).select(
        "session_id", "seq", "badge")


JOBS = {
    "context_hits": (context_hits, None),
    "provider_epoch": (provider_epoch, None),
    "pii_baseline": (pii_baseline, None),
    "new_pii": (new_pii, None),
    "pii_gate": (pii_gate, None),
    "downgrade_guard": (downgrade_guard, None),
    "downgrade_report": (downgrade_report, None),
    "posture_timeline": (posture_timeline, None),
}


# ---------------------------------------------------------------------------
# SQL twins: the same replay with plain window functions
# ---------------------------------------------------------------------------

from . import oracle as O  # noqa: E402

CN = detect.col_name
W_INC = "OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
W_EXC = "OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
WE_EXC = "OVER (PARTITION BY session_id, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _policies_sql(s="session_id"):
    return (f"CASE WHEN {s} % 7 = 3 THEN 'redact' WHEN {s} % 7 = 5 THEN 'off' ELSE 'warn' END AS pii_policy, "
            f"CASE WHEN {s} % 6 = 1 THEN 'block' WHEN {s} % 6 = 2 THEN 'off' ELSE 'warn' END AS exfil_policy, "
            f"CASE WHEN {s} % 5 = 4 THEN 'redact' WHEN {s} % 5 = 3 THEN 'off' ELSE 'warn' END AS result_policy, "
            f"CASE WHEN {s} % 8 = 3 THEN 'block' WHEN {s} % 8 = 5 THEN 'off' ELSE 'warn' END AS downgrade_policy, "
            f"CASE WHEN {s} % 9 = 4 THEN 'report' WHEN {s} % 9 = 7 THEN 'off' ELSE 'warn' END AS surface_policy")


def _ans(lst, col="answer_i"):
    return f"([{', '.join(O.q(a) for a in lst)}])[{col} % {len(lst)} + 1]"


def _hits_list(prefix):
    items = ", ".join(f"{{'type': {O.q(t)}, 'count': CAST({prefix}{CN(t)} AS BIGINT)}}" for t in TYPES)
    return f"list_filter([{items}], lambda h: h.count > 0)"


def _exposure(c):
    return "(CASE " + c + " " + " ".join(f"WHEN {O.q(t[0])} THEN {t[5]}" for t in seeds.TIERS) + " END)"


def resolved_ctes():
    """`sev`, `ms` and `res`: each switch's ceiling and the tier its evidence gives."""
    from .posture_jobs import eff_sql, key_grade_cte, ms_cte, report_grade_cte
    eid = posture_jobs.EVIDENCE_ID
    ov = "CASE WHEN m.provider = 'acme-ai' AND m.session_id % 5 = 0 THEN 'tee-verified' END"
    base = eff_sql("m.provider", "FALSE", "m.zdr_enforced", "FALSE")
    return (
        f"{ms_cte()},\n{report_grade_cte()},\n{key_grade_cte()},\n"
        f"res AS (SELECT m.session_id, m.seq, m.event_id, m.provider, coalesce({ov}, CASE WHEN m.provider = 'tinfoil' THEN coalesce(k.tier, 'tee-unverified') "
        f"WHEN m.provider = 'nearai' THEN coalesce(r.tier, 'tee-unverified') ELSE {base} END) AS tier, "
        f"{base} AS ceiling FROM ms m "
        f"LEFT JOIN kg4 k ON k.doc_id = {eid} LEFT JOIN rg3 r ON r.report_id = {eid})")


def timeline_ctes():
    delay = f"CASE WHEN s.event_id % {RESOLVE_LATE} = 1 THEN {LATE_BY} ELSE 1 END"
    pay_keys = ["session_id", "seq"]
    src = (O.snippet_cte() + ",\nptext AS (SELECT e.session_id, e.seq, t.s AS text FROM sev e JOIN snippet t "
           "ON e.snippet_i = t.i WHERE e.kind = 'payload')")
    msg_cols = ", ".join(f"coalesce((list_filter(hits, lambda h: h.type = {O.q(t)}))[1].count, 0) AS m_{CN(t)}" for t in TYPES)
    common = "session_id, seq, kind, event_id, snippet_i, call_i, answer_i, can_prompt, unattended"
    return (
        resolved_ctes() + ",\n"
        + O.scan_ctes(src, "ptext", pay_keys, sample_cap=0) + ",\n"
        f"msg AS (SELECT session_id, seq, {msg_cols} FROM scan),\n"
        f"tl0 AS (SELECT {common}, NULL AS provider, NULL AS model_id, NULL AS ceiling, NULL AS resolved FROM sev "
        "WHERE kind <> 'model_select' UNION ALL "
        f"SELECT s.session_id, s.seq, s.kind, s.event_id, s.snippet_i, s.call_i, s.answer_i, s.can_prompt, s.unattended, "
        f"m.provider, m.model_id, r.ceiling, CASE WHEN s.event_id % {RESOLVE_NEVER_LANDS} <> 0 THEN r.tier END FROM sev s "
        "JOIN ms m USING (session_id, seq) JOIN res r USING (session_id, seq) UNION ALL "
        f"SELECT s.session_id, s.seq + {delay}, 'tier_resolved', s.event_id, NULL, NULL, s.answer_i, s.can_prompt, s.unattended, NULL, NULL, NULL, r.tier "
        f"FROM sev s JOIN res r USING (session_id, seq) WHERE s.kind = 'model_select' AND s.event_id % {RESOLVE_NEVER_LANDS} <> 0),\n"
        f"tl1 AS (SELECT t.*, {_policies_sql('t.session_id')}, "
        + ", ".join(f"coalesce(g.m_{CN(x)}, 0) AS m_{CN(x)}" for x in TYPES) +
        " FROM tl0 t LEFT JOIN msg g USING (session_id, seq)),\n"
        "tl2 AS (SELECT *, " + ", ".join(f"sum(m_{CN(x)}) {W_INC} AS ctx_{CN(x)}" for x in TYPES) +
        f", last_value(provider IGNORE NULLS) {W_EXC} AS prev_provider, "
        f"last_value(CASE kind WHEN 'model_select' THEN 'pending' WHEN 'tier_resolved' THEN resolved END IGNORE NULLS) {W_INC} AS ts_now, "
        f"last_value(CASE kind WHEN 'model_select' THEN 'pending' WHEN 'tier_resolved' THEN resolved END IGNORE NULLS) {W_EXC} AS ts_before "
        "FROM tl1),\n"
        f"tl3 AS (SELECT *, CAST(sum(CASE WHEN kind = 'model_select' AND provider IS DISTINCT FROM prev_provider THEN 1 ELSE 0 END) "
        f"{W_INC} AS BIGINT) AS epoch, {_hits_list('ctx_')} AS ctx, CASE WHEN ts_now <> 'pending' THEN ts_now END AS tier_now, "
        "CASE WHEN ts_before <> 'pending' THEN ts_before END AS tier_before FROM tl2)")


def replay_ctes():
    secret = ", ".join(O.q(t) for t in detect.SECRET_TYPES)
    has_secret = f"len(list_filter(ctx, lambda h: h.type IN ({secret}))) > 0"

    def fires(prev, to):
        return (f"coalesce(downgrade_policy <> 'off' AND len(ctx) > 0 AND {prev} IS NOT NULL AND {to} IS NOT NULL "
                f"AND {_exposure(to)} > {_exposure(prev)}, FALSE)")
    sel = "kind = 'model_select'"
    dans = _ans(S.DOWNGRADE_ANSWERS)
    pans = _ans(S.PII_ANSWERS)
    return (
        timeline_ctes() + ",\n"
        f"dg0 AS (SELECT *, {sel} AND {fires('tier_before', 'ceiling')} AS f1 FROM tl3),\n"
        f"dg1 AS (SELECT *, last_value(CASE WHEN {sel} THEN {{'seq': seq, 'tier': tier_before, 'fired': f1, 'provider': provider, "
        f"'model_id': model_id}} END IGNORE NULLS) {W_INC} AS sw FROM dg0),\n"
        f"dg2a AS (SELECT *, kind = 'tier_resolved' AND NOT coalesce(sw.fired, TRUE) AND {fires('sw.tier', 'resolved')} AS late FROM dg1),\n"
        f"dg AS (SELECT *, late AND coalesce(last_value(CASE WHEN late THEN seq END IGNORE NULLS) {W_EXC}, -1) < sw.seq AS f2r FROM dg2a),\n"
        "dg2 AS (SELECT *, CASE WHEN f1 THEN 1 WHEN f2r THEN 2 END AS dg_pass, CASE WHEN f1 THEN ceiling WHEN f2r THEN resolved END AS dg_to, "
        "CASE WHEN f1 OR f2r THEN sw.tier END AS dg_from, sw.provider || '/' || sw.model_id AS dg_model, "
        f"CASE WHEN f1 OR f2r THEN CASE WHEN {has_secret} THEN 'secret' ELSE 'pii' END END AS dg_severity, "
        f"CASE WHEN f1 OR f2r THEN CASE WHEN downgrade_policy = 'block' THEN 'revert' WHEN can_prompt THEN CASE WHEN {dans} IN "
        f"('stay', 'cancel') THEN 'revert' ELSE {dans} END WHEN {has_secret} THEN 'revert' ELSE 'notice' END END AS dg_decision FROM dg),\n"
        "g1 AS (SELECT *, kind = 'payload' AND pii_policy <> 'off' AND NOT coalesce(tier_now IN ('tee-verified', 'local'), FALSE) "
        "AND len(ctx) > 0 AS gated FROM dg2),\n"
        "g2 AS (SELECT *, " + ", ".join(f"max(CASE WHEN gated THEN ctx_{CN(x)} END) {WE_EXC} AS base_{CN(x)}" for x in TYPES) +
        " FROM g1),\n"
        "g3 AS (SELECT *, CASE WHEN gated THEN list_filter([" + ", ".join(
            f"{{'type': {O.q(x)}, 'count': CAST(ctx_{CN(x)} - coalesce(base_{CN(x)}, 0) AS BIGINT)}}" for x in TYPES) +
        "], lambda h: h.count > 0) END AS fresh FROM g2),\n"
        "g4 AS (SELECT *, gated AND len(fresh) > 0 AS is_fresh FROM g3),\n"
        f"g5 AS (SELECT *, CASE WHEN is_fresh THEN CASE WHEN pii_policy = 'redact' THEN 'redact' WHEN unattended THEN 'redact' "
        f"WHEN can_prompt THEN CASE WHEN starts_with({pans}, 'redact') THEN 'redact' ELSE 'send' END ELSE 'send' END END AS fresh_action, "
        f"coalesce(is_fresh AND pii_policy = 'warn' AND NOT unattended AND can_prompt AND suffix({pans}, '+remember'), FALSE) AS candidate, "
        "coalesce(dg_decision = 'switch+redact', FALSE) AS w9_latch FROM g4),\n"
        f"g6 AS (SELECT *, last_value(fresh_action IGNORE NULLS) {WE_EXC} AS last_fresh_action, "
        f"coalesce(bool_or(candidate) {W_EXC}, FALSE) AS cand_before, coalesce(bool_or(w9_latch) {W_EXC}, FALSE) AS w9_before FROM g5),\n"
        f"g7 AS (SELECT *, CASE WHEN w9_latch THEN 'redact' WHEN candidate AND NOT cand_before AND NOT w9_before THEN "
        f"CASE WHEN starts_with({pans}, 'redact') THEN 'redact' ELSE 'send' END END AS latch_value FROM g6),\n"
        f"g8 AS (SELECT *, last_value(latch_value IGNORE NULLS) {W_EXC} AS latch_before FROM g7),\n"
        "rp AS (SELECT *, CASE WHEN NOT gated THEN 'pass' ELSE coalesce(latch_before, CASE WHEN pii_policy = 'redact' THEN 'redact' END, "
        "CASE WHEN is_fresh THEN fresh_action END, last_fresh_action, 'send') END AS action, "
        "coalesce(is_fresh AND latch_before IS NULL AND pii_policy = 'warn' AND NOT unattended AND can_prompt, FALSE) AS prompted FROM g8)")


def _w(select):
    return f"WITH {replay_ctes()}\n{select}"


def _tlabel(c):
    return "(CASE " + c + " " + " ".join(f"WHEN {O.q(t[0])} THEN {O.q(t[1])}" for t in seeds.TIERS) + " END)"


def downgrade_report_sql():
    carried = (f"CASE WHEN len(ctx) > 0 THEN 'carrying ' || {O.summary_sql('ctx')} ELSE 'already in context' END")
    return _w("SELECT session_id, seq, '⚠ Privacy downgrade: ' || " + _tlabel("dg_from") + " || ' → ' || "
              + _tlabel("dg_to") + " || '. This session''s history — ' || " + carried + " || ' — will be re-sent to ' || dg_model || "
              "' on the next turn. Detection is best-effort structured PII/secrets, so treat it as a floor, "
              "not a full inventory.' AS warning FROM rp WHERE dg_pass IS NOT NULL")


def posture_timeline_sql():
    glyph = dict(seeds.POSTURE_GLYPH)
    badge = ("CASE WHEN tier_now IS NULL THEN " + O.q(seeds.PENDING_BADGE) + " ELSE (CASE tier_now " +
             " ".join(f"WHEN {O.q(t[0])} THEN {O.q(glyph[t[3]] + ' ' + t[1])}" for t in seeds.TIERS) + " END) END")
    return (f"WITH {timeline_ctes()},\nb AS (SELECT session_id, seq, CASE WHEN kind IN ('model_select', 'tier_resolved', 'payload') "
            f"THEN {badge} END AS badge FROM tl3),\nb2 AS (SELECT *, last_value(badge IGNORE NULLS) {W_EXC} AS prev_badge FROM b)\n"
            "SELECT session_id, seq, badge FROM b2 WHERE badge IS NOT NULL AND badge IS DISTINCT FROM prev_badge")


def context_hits_sql():
    msg = ", ".join(f"coalesce((list_filter(hits, lambda h: h.type = {O.q(t)}))[1].count, 0) AS m_{CN(t)}" for t in TYPES)
    w = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return ("WITH " + O.scan_ctes(O.fx_turn_cte(), "fx_turn", ["conv_id", "turn"], sample_cap=0) + ",\n"
            f"m AS (SELECT conv_id, turn, {msg} FROM scan),\n"
            "c AS (SELECT conv_id, turn, " + ", ".join(f"sum(m_{CN(t)}) {w} AS c_{CN(t)}" for t in TYPES) + " FROM m)\n"
            f"SELECT conv_id, turn, h.type AS type, h.count AS hits FROM (SELECT conv_id, turn, unnest({_hits_list('c_')}) AS h FROM c)")


JOBS.update({
    "context_hits": (context_hits, context_hits_sql),
    "provider_epoch": (provider_epoch, lambda: _w("SELECT session_id, seq, provider, epoch FROM rp WHERE kind = 'model_select'")),
    "pii_baseline": (pii_baseline, lambda: _w(
        "SELECT session_id, seq, h.type AS type, h.count AS baseline FROM (SELECT session_id, seq, unnest(list_filter([" +
        ", ".join(f"{{'type': {O.q(x)}, 'count': CAST(base_{CN(x)} AS BIGINT)}}" for x in TYPES) +
        "], lambda h: h.count > 0)) AS h FROM rp WHERE gated)")),
    "new_pii": (new_pii, lambda: _w("SELECT session_id, seq, h.type AS type, h.count AS delta FROM "
                                    "(SELECT session_id, seq, unnest(fresh) AS h FROM rp WHERE gated)")),
    "pii_gate": (pii_gate, lambda: _w("SELECT session_id, seq, epoch, tier_now AS tier, gated, coalesce(is_fresh, FALSE) AS fresh, "
                                      "prompted, action FROM rp WHERE kind = 'payload'")),
    "downgrade_guard": (downgrade_guard, lambda: _w(
        "SELECT session_id, seq, CAST(dg_pass AS INTEGER) AS pass_no, dg_from AS from_tier, dg_to AS to_tier, "
        "dg_severity AS severity, dg_decision AS decision FROM rp WHERE dg_pass IS NOT NULL")),
    "downgrade_report": (downgrade_report, downgrade_report_sql),
    "posture_timeline": (posture_timeline, posture_timeline_sql),
})
