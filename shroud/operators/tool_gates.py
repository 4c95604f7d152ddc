"""Gates on tool calls and tool results, replayed over the session log.

W8 (first use of a repo-supplied tool), E6/W6 (egress verdict and decision),
E7 (observed-egress ledger) and W7 (credentials arriving in tool results).
Latches ("allow for session", "remember") are running aggregates over the
session's earlier rows, computed with the skew-safe `running` helper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seeds
from . import detect, egress
from ..session import cut_lineage
from .running import by_heat
from .session import EGRESS_ANSWERS, FIRST_USE_ANSWERS, INGEST_ANSWERS, answer


def first_use(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds `fu_applies` and `fu_outcome` (allow / allow+notice / block).

    `calls` are tool-call rows with session_id, seq, tool, can_prompt,
    answer_i, surface_policy, origin; `entries` the classified inventory with
    `position`, its order of registration (needed only where a name repeats)."""
    # One entry a name, the last registered one, so that a repeated name never
    # multiplies calls.
    inv = (entries.groupBy("session_id", F.col("name").alias("tool"))
           .agg(F.max_by("provenance", "position" if "position" in entries.columns else "provenance").alias("provenance")))
    # Only repo-supplied tools that a model calls can be gated or latch: the passes run on the keys and
    # flags of these calls, and the outcome comes back by (session, seq). No call's input is moved for it.
    ans = answer(FIRST_USE_ANSWERS)
    asked = (calls.where((F.col("origin") == "model") & (F.col("surface_policy") == "warn")).select("session_id", "seq", "tool", "can_prompt", "answer_i")
             .join(inv.where(F.col("provenance").isin("project", "temporary")), ["session_id", "tool"], "left_semi"))

    def latches(g, run):
        let_through = ~F.col("can_prompt") | ans.isin("run", "allow-project")
        g = run(g, ["session_id", "tool"], "seq", [("tool_latch", "bool_or", let_through, False)], materialize=False)
        g = g.withColumn("sl_row", F.col("can_prompt") & (ans == "allow-project") & ~F.col("tool_latch"))
        return run(g, ["session_id"], "seq", [("session_latch", "bool_or", F.col("sl_row"), False)], materialize=False)
    outcome = (F.when(F.col("session_latch") | F.col("tool_latch"), "allow")
               .when(~F.col("can_prompt"), "allow+notice").when(ans.isin("run", "allow-project"), "allow").otherwise("block"))
    gated = by_heat(asked, "session_id", latches).select("session_id", "seq", "tool", outcome.alias("_outcome")).distinct()
    return (calls.join(gated, ["session_id", "seq", "tool"], "left")
            .withColumn("fu_applies", F.col("_outcome").isNotNull()).withColumn("fu_outcome", F.coalesce("_outcome", F.lit("allow"))).drop("_outcome"))


def verdict(calls: DataFrame) -> DataFrame:
    """Adds assessment `a`, detection `hits` over the input, and the verdict
    columns (`fires`, severity, what, warning, reason)."""
    a = calls.withColumn("a", egress.assess(F.col("tool"), F.col("input_json")))
    s = detect.with_scan(a.withColumn("text", F.col("input_json")), sample_cap=0).drop("suppressed", "samples", "text")
    files = F.col("a.sensitive_files")
    has_files = F.coalesce(F.size(files) > 0, F.lit(False))
    fires = F.col("a.egress") & ((F.size("hits") > 0) | has_files)
    secret = detect.has_secret(F.col("hits")) | has_files
    what = F.array_join(F.filter(F.array(F.when(has_files, F.concat(F.array_join(files, ", "), F.lit(" contents"))),
                                         F.when(F.size("hits") > 0, detect.summary(F.col("hits")))),
                                 lambda x: x.isNotNull()), " + ")
    label = F.when(F.col("origin") == "user", F.lit(seeds.USER_COMMAND_LABEL)).otherwise(F.coalesce("tool", F.lit("a tool")))
    dest = F.when(F.col("a.target").isNotNull(), F.concat(F.lit(" → "), F.col("a.target"))).otherwise(F.lit(""))
    w_head, w_rest = seeds.EGRESS_WARNING.split("{label}")
    w_mid, w_tail = w_rest.split("{what}")
    w_pre_dest, w_after = w_tail.split("{dest}")
    warning = F.concat(F.lit(w_head), label, F.lit(w_mid), what, F.lit(w_pre_dest), dest, F.lit(w_after))
    r_head, r_rest = seeds.EGRESS_REASON.split("{kind}")
    r_mid = r_rest.split("{label}")[0]
    reason = F.concat(F.lit(r_head), F.when(secret, "credential").otherwise("PII"), F.lit(r_mid), label)
    return (s.withColumn("fires", fires)
            .withColumn("severity", F.when(fires, F.when(secret, "secret").otherwise("pii")))
            .withColumn("what", F.when(fires, what)).withColumn("warning", F.when(fires, warning))
            .withColumn("reason", F.when(fires, reason)))


def egress_gate(v: DataFrame) -> DataFrame:
    """W6 over verdict rows not stopped by W8: adds `decision`."""
    ans = answer(EGRESS_ANSWERS)
    latch_row = (F.col("exfil_policy") == "warn") & F.col("can_prompt") & (ans == "allow-session")
    # The latch only matters for, and is only set by, calls with a verdict.
    g = by_heat(v.where("fires").withColumn("latch_row", latch_row), "session_id", lambda rows, run: run(
        rows, ["session_id"], "seq", [("allow_latch", "bool_or", F.col("latch_row"), False)], materialize=False))
    g = g.unionByName(v.where("NOT fires").withColumn("latch_row", F.lit(False)).withColumn("allow_latch", F.lit(False)))
    decision = (F.when(~F.col("fires") | (F.col("exfil_policy") == "off"), "allow")
                .when(F.col("allow_latch"), "allow+notice").when(F.col("exfil_policy") == "block", "block")
                .when(F.col("can_prompt"), F.when(ans.isin("allow-once", "allow-session"), "allow").otherwise("block"))
                .when(F.col("severity") == "secret", "block").otherwise("allow+notice"))
    return g.withColumn("decision", decision).drop("latch_row")


def ledger_host(target: Column) -> Column:
    return F.coalesce(egress.url_host(target), F.lit(seeds.UNNAMED_HOST))


def ledger(g: DataFrame) -> DataFrame:
    """Observed egress per (session, actor, host): calls, calls that carried
    PII/credentials, calls blocked. Partial aggregation before the shuffle."""
    obs = g.where(F.col("a.egress") & (F.col("surface_policy") != "off"))
    return (obs.groupBy("session_id", F.col("actor").alias("tool"), ledger_host(F.col("a.target")).alias("host"))
            .agg(F.count(F.lit(1)).alias("calls"), F.count_if("fires").alias("with_pii"),
                 F.count_if(F.col("decision") == "block").alias("blocked")))


def observation_line(tool: Column, host: Column, calls: Column, with_pii: Column, blocked: Column) -> Column:
    """`bash → x.com   4 calls  (2 carried PII/credentials, 1 blocked)`."""
    p_head, p_tail = seeds.LEDGER_PII_NOTE.split("{n}")
    b_head, b_tail = seeds.LEDGER_BLOCKED_NOTE.split("{n}")
    notes = F.filter(F.array(F.when(with_pii > 0, F.concat(F.lit(p_head), with_pii.cast("string"), F.lit(p_tail))),
                             F.when(blocked > 0, F.concat(F.lit(b_head), blocked.cast("string"), F.lit(b_tail)))),
                     lambda x: x.isNotNull())
    return F.concat(tool, F.lit(" → "), host, F.lit("   "), calls.cast("string"), F.lit(" call"),
                    F.when(calls == 1, F.lit("")).otherwise(F.lit("s")),
                    F.when(F.size(notes) > 0, F.concat(F.lit("  ("), F.array_join(notes, ", "), F.lit(")"))).otherwise(F.lit("")))


SHAPES = ["string", "parts", "string_parts", "object"]


def result_text(shape: Column, s: Column) -> Column:
    """A tool result flattened for detection (text parts joined by newline,
    non-text parts empty, unknown shapes serialized)."""
    return (F.when(shape == "string", s).when(shape == "parts", F.concat(s, F.lit("\n")))
            .when(shape == "string_parts", F.concat(s, F.lit("\ndone")))
            .otherwise(F.to_json(F.struct(s.alias("output")))))


def ingest_gate(r: DataFrame) -> DataFrame:
    """W7 over tool-result rows with `shape`, `s` (text), `redacted_s` and `hits`: adds
    `secret_hits`, `action` and `outcome` (kept / redacted / could-not-redact). The
    texts are left behind; only whether redaction changed them goes on."""
    sh = detect.secret_hits(F.col("hits"))
    applies = (F.col("result_policy") != "off") & (F.size(sh) > 0)
    ans = answer(INGEST_ANSWERS)
    remember = F.when(applies & (F.col("result_policy") == "warn") & F.col("can_prompt") & ans.endswith("+remember"),
                      F.when(ans.startswith("redact"), "redact").otherwise("keep"))
    r = r.withColumn("secret_hits", sh).withColumn("applies", applies).withColumn("remember", remember)
    r = cut_lineage(r.withColumn("changed", F.col("redacted_s") != F.col("s")).drop("redacted_s", "s", "text", "content", "hits"))
    g = by_heat(r.where("applies"), "session_id", lambda rows, run: run(
        rows, ["session_id"], "seq", [("result_latch", "first", F.col("remember"), False)], materialize=False))
    g = g.unionByName(r.where("NOT applies").withColumn("result_latch", F.lit(None).cast("string")))
    action = (F.when(~F.col("applies"), "keep").when(F.col("result_latch").isNotNull(), F.col("result_latch"))
              .when(F.col("result_policy") == "redact", "redact")
              .when(F.col("can_prompt"), F.when(ans.startswith("redact"), "redact").otherwise("keep"))
              .otherwise("redact"))
    outcome = (F.when(action != "redact", "kept").when(F.col("shape") == "object", "could-not-redact")
               .when(F.col("changed"), "redacted").otherwise("could-not-redact"))
    return g.withColumn("action", action).withColumn("outcome", outcome)
