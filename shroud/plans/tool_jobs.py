"""Tool-call and tool-result gate jobs (W6, W7, W8, E6-E9, S2, D11), with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seeds
from ..operators import detect, redact
from ..operators import payload as PL
from ..operators import session as S
from ..operators import tool_gates as TG
from ..session import cut_lineage
from ..sources import fixtures
from ..sources.seedframes import broadcast_seed
from . import oracle as O
from . import surface_jobs
from .detection_jobs import redact_sql_steps
from .egress_jobs import assess_ctes, url_ctes
from .session_jobs import W_EXC, _ans, _policies_sql

TOP_K = 3  # of the registered report


def _calls(spark, sf):
    return fixtures.tool_calls(spark, sf).select("*", *S.policies(F.col("session_id")))


def _first_use(spark, sf, entries=None):
    return TG.first_use(_calls(spark, sf), surface_jobs.entries(spark, sf) if entries is None else entries)


def _gated(spark, sf, entries=None):
    """W8 -> E6 -> W6."""
    return TG.egress_gate(_verdicts(_first_use(spark, sf, entries)).where("fu_outcome <> 'block'"))


def _verdicts(f):
    """E6, checkpointed once without the calls' inputs: URL parsing and a 15-pattern scan per call are
    not repeated by the latch pass and the rows it does not touch."""
    stopped = f.where("fu_outcome = 'block'")  # kept out of the scan
    v = TG.verdict(f.where("fu_outcome <> 'block'")).drop("input_json", "hits")
    return cut_lineage(v.unionByName(stopped.drop("input_json"), allowMissingColumns=True))


def first_use_gate(spark, sf):
    return _first_use(spark, sf).where("fu_applies").select("session_id", "seq", "tool", F.col("fu_outcome").alias("outcome"))


def egress_verdicts(spark, sf):
    g = _gated(spark, sf).where("fires")
    return g.select("session_id", "seq", "actor", "severity", "what", F.col("a.target").alias("target"), "warning", "reason")


def egress_gate(spark, sf):
    return _gated(spark, sf).where("fires").select("session_id", "seq", "actor", "decision")


def egress_ledger(spark, sf):
    return TG.ledger(_gated(spark, sf))


def _ordered_ledger(spark, sf):
    w = Window.partitionBy("session_id").orderBy(F.desc("calls"), "tool", "host")
    return egress_ledger(spark, sf).withColumn("line_no", F.row_number().over(w).cast("int"))


def egress_top_hosts(spark, sf, k: int = TOP_K):
    """The `k` most active (tool, host) pairs per session; the limit is the report."""
    return _ordered_ledger(spark, sf).where(F.col("line_no") <= k).select("session_id", "line_no", "tool", "host", "calls")


def egress_report(spark, sf):
    """One line per observation; a session without egress has no lines."""
    led = _ordered_ledger(spark, sf)
    return led.select("session_id", "line_no", TG.observation_line(F.col("tool"), F.col("host"), F.col("calls"),
                                                                  F.col("with_pii"), F.col("blocked")).alias("line"))


def _results(spark, sf):
    ev = fixtures.session_events(spark, sf).where("kind = 'tool_result'").select("*", *S.policies(F.col("session_id")))
    snip = broadcast_seed(spark, fixtures.snippet_rows(), fixtures.SNIPPET_COLS)
    r = ev.join(snip, ev.snippet_i == snip.i).withColumn(
        "shape", F.element_at(F.array(*[F.lit(x) for x in TG.SHAPES]), (F.col("event_id") % len(TG.SHAPES) + 1).cast("int")))
    # The result in its shape: a string, parts (text and an image), strings, or any other JSON.
    s_, shape = F.col("s"), F.col("shape")
    image = PL.raw_part("image", F.concat(F.lit("img-"), F.col("event_id").cast("string")))
    content = F.struct(F.when(shape == "string", s_).alias("text"), F.when(shape == "string_parts", F.array(s_, F.lit("done"))).alias("strings"),
                       F.when(shape == "parts", F.array(PL.text_part(s_), image)).alias("parts"),
                       F.when(shape == "object", F.to_json(F.struct(s_.alias("output")))).alias("raw")).cast(PL.RESULT)
    r = r.withColumn("content", content).withColumn("text", PL.result_text(F.col("content")))
    r = detect.with_scan(r, sample_cap=0).drop("suppressed", "samples")
    return redact.with_redacted(r, text="s", out="redacted_s", only=detect.SECRET_TYPES)


def result_units(spark, sf):
    """Tool results flattened to scan text."""
    return _results(spark, sf).select("session_id", "seq", "shape", "text")


def redact_results(spark, sf):
    """Credential-only redaction of every result; unknown shapes cannot be rewritten."""
    r = _results(spark, sf).withColumn("red", PL.redact_result(F.col("content"), only=detect.SECRET_TYPES))
    outcome = PL.result_outcome(F.col("content"), F.col("red"), detect.has_secret(F.col("hits")))
    first = F.coalesce("red.text", F.get("red.strings", F.lit(0)), F.get("red.parts", F.lit(0))["text"])
    return r.select("session_id", "seq", "shape", outcome.alias("outcome"), first.alias("first")).select(
        "session_id", "seq", "shape", "outcome", F.when(F.col("outcome") == "redacted", F.col("first")).alias("redacted"))


def ingest_gate(spark, sf):
    g = TG.ingest_gate(_results(spark, sf))
    return g.where("applies").select("session_id", "seq", "shape", detect.summary(F.col("secret_hits")).alias("secrets"),
                                     "action", "outcome")


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------

def _fu_ctes():
    ans = _ans(S.FIRST_USE_ANSWERS)
    wt = "OVER (PARTITION BY session_id, tool ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (f"{assess_ctes()},\n{surface_jobs.classified_ctes()},\n"
            f"fu0 AS (SELECT c.*, {_policies_sql('c.session_id')}, e.provenance FROM calls c LEFT JOIN ent e "
            "ON e.session_id = c.session_id AND e.name = c.tool),\n"
            "fu1 AS (SELECT *, origin = 'model' AND surface_policy = 'warn' AND coalesce(provenance IN ('project', 'temporary'), "
            f"FALSE) AS fu_applies, {ans} AS fans FROM fu0),\n"
            f"fu2 AS (SELECT *, coalesce(bool_or(fu_applies AND (NOT can_prompt OR fans IN ('run', 'allow-project'))) {wt}, FALSE) "
            "AS tool_latch FROM fu1),\n"
            "fu3 AS (SELECT *, coalesce(bool_or(fu_applies AND can_prompt AND fans = 'allow-project' AND NOT tool_latch) "
            f"{W_EXC}, FALSE) AS session_latch FROM fu2),\n"
            "fu4 AS (SELECT *, CASE WHEN NOT fu_applies THEN 'allow' WHEN session_latch OR tool_latch THEN 'allow' "
            "WHEN NOT can_prompt THEN 'allow+notice' WHEN fans IN ('run', 'allow-project') THEN 'allow' ELSE 'block' END "
            "AS fu_outcome FROM fu3)")


def _gate_ctes():
    ans = _ans(S.EGRESS_ANSWERS)
    secret = ", ".join(O.q(t) for t in detect.SECRET_TYPES)
    what = ("array_to_string(list_filter([CASE WHEN coalesce(len(a.files), 0) > 0 THEN array_to_string(a.files, ', ') || ' contents' END, "
            f"CASE WHEN len(s.hits) > 0 THEN {O.summary_sql('s.hits')} END], lambda x: x IS NOT NULL), ' + ')")
    label = "CASE WHEN a.origin = 'user' THEN " + O.q(seeds.USER_COMMAND_LABEL) + " ELSE coalesce(a.tool, 'a tool') END"
    head, rest = seeds.EGRESS_WARNING.split("{label}")
    mid, tail = rest.split("{what}")
    pre, after = tail.split("{dest}")
    dest = "CASE WHEN a.target IS NOT NULL THEN ' → ' || a.target ELSE '' END"
    secret_c = f"(len(list_filter(s.hits, lambda h: h.type IN ({secret}))) > 0 OR coalesce(len(a.files), 0) > 0)"
    r_head, r_rest = seeds.EGRESS_REASON.split("{kind}")
    r_mid = r_rest.split("{label}")[0]
    return (_fu_ctes() + ",\n"
            + O.scan_ctes("ctext AS (SELECT session_id, seq, input_json AS text FROM calls)", "ctext", ["session_id", "seq"],
                          sample_cap=0) + ",\n"
            f"v AS (SELECT a.session_id, a.seq, a.actor, a.egress, a.target, f.exfil_policy, f.surface_policy, a.can_prompt, "
            f"a.answer_i, a.egress AND (len(s.hits) > 0 OR coalesce(len(a.files), 0) > 0) AS fires, "
            f"CASE WHEN {secret_c} THEN 'secret' ELSE 'pii' END AS sev, {what} AS what, "
            f"{O.q(head)} || {label} || {O.q(mid)} || {what} || {O.q(pre)} || {dest} || {O.q(after)} AS warning, "
            f"{O.q(r_head)} || CASE WHEN {secret_c} THEN 'credential' ELSE 'PII' END || {O.q(r_mid)} || {label} AS reason "
            "FROM assessed2 a JOIN fu4 f USING (session_id, seq) JOIN scan s USING (session_id, seq) WHERE f.fu_outcome <> 'block'),\n"
            f"v2 AS (SELECT *, coalesce(bool_or(fires AND exfil_policy = 'warn' AND can_prompt AND {ans} = 'allow-session') {W_EXC}, "
            "FALSE) AS allow_latch FROM v),\n"
            "gate AS (SELECT *, CASE WHEN NOT fires OR exfil_policy = 'off' THEN 'allow' WHEN allow_latch THEN 'allow+notice' "
            f"WHEN exfil_policy = 'block' THEN 'block' WHEN can_prompt THEN CASE WHEN {ans} IN ('allow-once', 'allow-session') "
            "THEN 'allow' ELSE 'block' END WHEN sev = 'secret' THEN 'block' ELSE 'allow+notice' END AS decision FROM v2)")


def _ledger_ctes():
    return (_gate_ctes() + ",\nobs AS (SELECT * FROM gate WHERE egress AND surface_policy <> 'off'),\n"
            "tgt AS (SELECT session_id, seq, target AS url FROM obs WHERE target IS NOT NULL),\n"
            + url_ctes("tgt", ["session_id", "seq"], "ta") + ",\n"
            "led AS (SELECT o.session_id, o.actor AS tool, coalesce(t.host, " + O.q(seeds.UNNAMED_HOST) + ") AS host, "
            "count(*) AS calls, count(*) FILTER (WHERE o.fires) AS with_pii, count(*) FILTER (WHERE o.decision = 'block') "
            "AS blocked FROM obs o LEFT JOIN ta t USING (session_id, seq) GROUP BY ALL),\n"
            "led2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY calls DESC, tool, host) AS INTEGER) "
            "AS line_no FROM led)")


def egress_report_sql():
    line = ("tool || ' → ' || host || '   ' || CAST(calls AS VARCHAR) || ' call' || CASE WHEN calls = 1 THEN '' ELSE 's' END || "
            "CASE WHEN with_pii > 0 OR blocked > 0 THEN '  (' || array_to_string(list_filter([CASE WHEN with_pii > 0 THEN "
            "CAST(with_pii AS VARCHAR) || ' carried PII/credentials' END, CASE WHEN blocked > 0 THEN CAST(blocked AS VARCHAR) "
            "|| ' blocked' END], lambda x: x IS NOT NULL), ', ') || ')' ELSE '' END")
    return f"WITH {_ledger_ctes()}\nSELECT session_id, line_no, {line} AS line FROM led2"


def _results_ctes():
    shapes = "[" + ", ".join(O.q(x) for x in TG.SHAPES) + "]"
    src = (O.snippet_cte() + f",\n{_tr_sev()},\ntr AS (SELECT e.session_id, e.seq, e.event_id, e.can_prompt, e.answer_i, "
           f"{_policies_sql('e.session_id')}, ({shapes})[e.event_id % {len(TG.SHAPES)} + 1] AS shape, t.s FROM sev e "
           "JOIN snippet t ON e.snippet_i = t.i WHERE e.kind = 'tool_result'),\n"
           "trt AS (SELECT *, CASE shape WHEN 'string' THEN s WHEN 'parts' THEN s || chr(10) WHEN 'string_parts' THEN "
           "s || chr(10) || 'done' ELSE CAST(to_json({'output': s}) AS VARCHAR) END AS text FROM tr)")
    ctes, last = redact_sql_steps("trs", "s", only=detect.SECRET_TYPES)
    return ("WITH " + O.scan_ctes(src, "trt", ["session_id", "seq"], sample_cap=0) + ",\n"
            "trs AS (SELECT t.*, c.hits FROM trt t JOIN scan c USING (session_id, seq)),\n" + ctes + ",\n"
            f"res AS (SELECT * EXCLUDE (rtext), rtext AS redacted_s FROM {last})")


def _tr_sev():
    from .egress_jobs import session_events_cte
    return session_events_cte()


def ingest_gate_sql():
    secret = ", ".join(O.q(t) for t in detect.SECRET_TYPES)
    ans = _ans(S.INGEST_ANSWERS)
    return (_results_ctes() + ",\n"
            f"i1 AS (SELECT *, list_filter(hits, lambda h: h.type IN ({secret})) AS secret_hits FROM res),\n"
            "i2 AS (SELECT *, result_policy <> 'off' AND len(secret_hits) > 0 AS applies FROM i1),\n"
            f"i3 AS (SELECT *, CASE WHEN applies AND result_policy = 'warn' AND can_prompt AND suffix({ans}, '+remember') THEN "
            f"CASE WHEN starts_with({ans}, 'redact') THEN 'redact' ELSE 'keep' END END AS remember FROM i2),\n"
            f"i4 AS (SELECT *, first_value(remember IGNORE NULLS) {W_EXC} AS result_latch FROM i3),\n"
            "i5 AS (SELECT *, CASE WHEN NOT applies THEN 'keep' WHEN result_latch IS NOT NULL THEN result_latch "
            f"WHEN result_policy = 'redact' THEN 'redact' WHEN can_prompt THEN CASE WHEN starts_with({ans}, 'redact') THEN 'redact' "
            "ELSE 'keep' END ELSE 'redact' END AS action FROM i4)\n"
            f"SELECT session_id, seq, shape, {O.summary_sql('secret_hits')} AS secrets, action, CASE WHEN action <> 'redact' THEN "
            "'kept' WHEN shape = 'object' THEN 'could-not-redact' WHEN redacted_s <> s THEN 'redacted' ELSE 'could-not-redact' END "
            "AS outcome FROM i5 WHERE applies")


def redact_results_sql():
    return (_results_ctes() + "\nSELECT session_id, seq, shape, CASE WHEN redacted_s = s THEN 'unchanged' WHEN shape = 'object' "
            "THEN 'could-not-redact' ELSE 'redacted' END AS outcome, CASE WHEN redacted_s <> s AND shape <> 'object' THEN "
            "redacted_s END AS redacted FROM res")


JOBS = {
    "first_use_gate": (first_use_gate, lambda: f"WITH {_fu_ctes()}\nSELECT session_id, seq, tool, fu_outcome AS outcome "
                       "FROM fu4 WHERE fu_applies"),
    "egress_verdicts": (egress_verdicts, lambda: f"WITH {_gate_ctes()}\nSELECT session_id, seq, actor, sev AS severity, what, "
                        "target, warning, reason FROM gate WHERE fires"),
    "egress_gate": (egress_gate, lambda: f"WITH {_gate_ctes()}\nSELECT session_id, seq, actor, decision FROM gate WHERE fires"),
    "egress_ledger": (egress_ledger, lambda: f"WITH {_ledger_ctes()}\nSELECT session_id, tool, host, calls, with_pii, blocked FROM led"),
    "egress_top_hosts": (egress_top_hosts, lambda: f"WITH {_ledger_ctes()}\nSELECT session_id, line_no, tool, host, calls FROM led2 "
                         f"WHERE line_no <= {TOP_K}"),
    "egress_report": (egress_report, egress_report_sql),
    "result_units": (result_units, lambda: _results_ctes() + "\nSELECT session_id, seq, shape, text FROM res"),
    "redact_results": (redact_results, redact_results_sql),
    "ingest_gate": (ingest_gate, ingest_gate_sql),
}
