"""Session replay: the stateful gate decisions as running aggregates.

Every piece of session state the gates carry (context hits, provider epoch,
PII baseline, latches, last action, current tier) is a running aggregate over
the session's events in arrival order, so the decisions are replayed (or
what-if'd with other policies) as window queries instead of an event loop.
Running aggregates go through `running.running`, which keeps a hot session from
landing in one task.

Prompt outcomes come from the log: `can_prompt` (a UI could ask), `unattended`
(nobody is at the keyboard) and `answer_i`, an index into each gate's answer
list below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seeds
from . import detect
from .running import plain, running

TYPES = detect.TYPE_ORDER
VERIFIED_PRIVATE = ["tee-verified", "local"]

# Answer lists per gate, indexed by answer_i (a log column).
PII_ANSWERS = ["send", "redact", "redact+remember", "send+remember", "cancel"]
EGRESS_ANSWERS = ["block", "allow-once", "allow-session", "cancel", "allow-once"]
INGEST_ANSWERS = ["redact", "keep", "redact+remember", "keep+remember", "cancel"]
DOWNGRADE_ANSWERS = ["stay", "switch", "switch+redact", "cancel", "switch"]
FIRST_USE_ANSWERS = ["run", "show-file", "allow-project", "block", "cancel"]


def answer(lst: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in lst]), (F.col("answer_i") % len(lst) + 1).cast("int"))


def policies(session: Column) -> list[Column]:
    """Per-session policy settings of the replayed fleet."""
    return [
        F.when(session % 7 == 3, "redact").when(session % 7 == 5, "off").otherwise("warn").alias("pii_policy"),
        F.when(session % 6 == 1, "block").when(session % 6 == 2, "off").otherwise("warn").alias("exfil_policy"),
        F.when(session % 5 == 4, "redact").when(session % 5 == 3, "off").otherwise("warn").alias("result_policy"),
        F.when(session % 8 == 3, "block").when(session % 8 == 5, "off").otherwise("warn").alias("downgrade_policy"),
        F.when(session % 9 == 4, "report").when(session % 9 == 7, "off").otherwise("warn").alias("surface_policy"),
    ]


def tier_exposure(t: Column) -> Column:
    return F.create_map(*[x for r in seeds.TIERS for x in (F.lit(r[0]), F.lit(r[5]))])[t]


def hit_array(prefix: str) -> Column:
    return F.filter(F.array(*[F.struct(F.lit(t).alias("type"), F.col(f"{prefix}{detect.col_name(t)}").cast("bigint")
                                       .alias("count")) for t in TYPES]), lambda h: h["count"] > 0)


def tier_state(tl: DataFrame, run=running, more: tuple = ()) -> DataFrame:
    """Current tier, the tier before, and the provider-change flag (a provider epoch
    starts at each change). `tl` needs session_id, seq, kind, provider
    (model_select) and resolved (tier_resolved)."""
    state = (F.when(F.col("kind") == "model_select", F.lit("pending"))
             .when(F.col("kind") == "tier_resolved", F.col("resolved")))
    a = run(tl, ["session_id"], "seq", [*more, ("prev_provider", "last", F.col("provider"), False),
                                        ("tier_state", "last", state, True), ("tier_state_before", "last", state, False)])
    change = (F.col("kind") == "model_select") & ~F.col("provider").eqNullSafe(F.col("prev_provider"))
    return (a.withColumn("change", change)
            .withColumn("tier_now", F.when(F.col("tier_state") != "pending", F.col("tier_state")))
            .withColumn("tier_before", F.when(F.col("tier_state_before") != "pending", F.col("tier_state_before"))))


def context_state(tl: DataFrame, run=running) -> DataFrame:
    """`tier_state` and, in the same pass, the context hits: running sums of the
    m_<type> message-hit counts of payload rows."""
    sums = tuple((f"ctx_{detect.col_name(t)}", "sum", F.col(f"m_{detect.col_name(t)}"), True) for t in TYPES)
    return tier_state(tl, run, sums).withColumn("ctx", hit_array("ctx_"))


def with_epoch(tl: DataFrame, run=running) -> DataFrame:
    """Provider epoch: the number of provider changes so far."""
    return run(tl, ["session_id"], "seq", [("epoch", "sum", F.col("change").cast("int"), True)])


def downgrade(tl: DataFrame, run=running) -> DataFrame:
    """Pass 1 on model_select rows against the ceiling; pass 2 on the
    tier_resolved rows that follow, whenever they arrive, against the resolved
    tier, with the hits as of that row and the tier held before the latest
    switch. One firing per transition: a switch arms the guard, the first
    firing disarms it. On the chunked way, pass 2 runs over switch and resolution
    rows only; plain windows take all rows, so that nothing is read twice."""
    hits = F.col("ctx")
    on = (F.col("downgrade_policy") != "off") & (F.size(hits) > 0)

    def fires(prev: Column, to: Column) -> Column:
        return F.coalesce(on & prev.isNotNull() & to.isNotNull() & (tier_exposure(to) > tier_exposure(prev)), F.lit(False))
    t = tl.withColumn("f1", (F.col("kind") == "model_select") & fires(F.col("tier_before"), F.col("ceiling")))
    split = run is not plain
    steps = t.where(F.col("kind").isin("model_select", "tier_resolved")) if split else t
    model = F.col("model_id") if "model_id" in tl.columns else F.lit(None).cast("string")
    switch = F.when(F.col("kind") == "model_select", F.struct(
        F.col("seq").alias("seq"), F.col("tier_before").alias("tier"), F.col("f1").alias("fired"),
        F.col("provider").alias("provider"), model.alias("model_id")))
    steps = run(steps, ["session_id"], "seq", [("switch", "last", switch, True)], materialize=False)
    late = (F.col("kind") == "tier_resolved") & ~F.coalesce(F.col("switch.fired"), F.lit(True)) & fires(F.col("switch.tier"), F.col("resolved"))
    steps = run(steps.withColumn("late", late), ["session_id"], "seq",
                [("last_late", "last", F.when(F.col("late"), F.col("seq")), False)], materialize=False)
    steps = steps.withColumn("f2", F.col("late") & (F.coalesce(F.col("last_late"), F.lit(-1)) < F.col("switch.seq"))).drop("late", "last_late")
    rest = t.where(~F.col("kind").isin("model_select", "tier_resolved"))
    all_rows = steps.unionByName(rest, allowMissingColumns=True) if split else steps
    f1, f2 = F.col("f1"), F.coalesce(F.col("f2"), F.lit(False))
    severity = F.when(detect.has_secret(hits), "secret").otherwise("pii")
    ans = answer(DOWNGRADE_ANSWERS)
    decision = (F.when(F.col("downgrade_policy") == "block", "revert")
                .when(F.col("can_prompt"), F.when(ans.isin("stay", "cancel"), "revert").otherwise(ans))
                .when(severity == "secret", "revert").otherwise("notice"))
    return (all_rows.withColumn("dg_pass", F.when(f1, 1).when(f2, 2))
            .withColumn("dg_from", F.when(f1 | f2, F.col("switch.tier")))
            .withColumn("dg_to", F.when(f1, F.col("ceiling")).when(f2, F.col("resolved")))
            .withColumn("dg_model", F.concat(F.col("switch.provider"), F.lit("/"), F.col("switch.model_id")))
            .withColumn("dg_severity", F.when(f1 | f2, severity))
            .withColumn("dg_decision", F.when(f1 | f2, decision)).drop("f1", "f2", "switch"))


def pii_gate(tl: DataFrame, run=running) -> DataFrame:
    """W3/W4/W5 on payload rows (tl after context_state and downgrade).

    The per-epoch baseline is the greatest context of each type over earlier
    gated payloads of the same provider epoch (a compacted conversation may
    lower the counts; what was decided stays decided); the carried last action
    is the latest earlier fresh row's action in the same epoch; the latch is
    the first eligible "remember" answer, overwritten by any later "switch,
    redacting PII" at a downgrade."""
    ctx_cols = {t_: f"ctx_{detect.col_name(t_)}" for t_ in TYPES}
    is_payload = F.col("kind") == "payload"
    gated = (is_payload & (F.col("pii_policy") != "off") & ~F.coalesce(F.col("tier_now").isin(*VERIFIED_PRIVATE), F.lit(False))
             & (F.size("ctx") > 0))
    t = with_epoch(tl.withColumn("gated", gated), run)
    c = run(t, ["session_id", "epoch"], "seq", [
        (f"base_{detect.col_name(t_)}", "max", F.when(F.col("gated"), F.col(ctx_cols[t_])), False) for t_ in TYPES])
    delta = {t_: F.col(f"ctx_{detect.col_name(t_)}") - F.coalesce(F.col(f"base_{detect.col_name(t_)}"), F.lit(0)) for t_ in TYPES}
    fresh = F.filter(F.array(*[F.struct(F.lit(t_).alias("type"), delta[t_].cast("bigint").alias("count")) for t_ in TYPES]),
                     lambda h: h["count"] > 0)
    c = c.withColumn("fresh", F.when(F.col("gated"), fresh))
    is_fresh = F.col("gated") & (F.size("fresh") > 0)
    ans = answer(PII_ANSWERS)
    fresh_action = (F.when(F.col("pii_policy") == "redact", "redact").when(F.col("unattended"), "redact")
                    .when(F.col("can_prompt"), F.when(ans.startswith("redact"), "redact").otherwise("send"))
                    .otherwise("send"))
    c = c.withColumn("is_fresh", is_fresh).withColumn("fresh_action", F.when(is_fresh, fresh_action))
    candidate = (is_fresh & (F.col("pii_policy") == "warn") & ~F.col("unattended") & F.col("can_prompt")
                 & ans.endswith("+remember"))
    cand_value = F.when(candidate, F.struct(F.col("seq").alias("s"),
                                            F.when(ans.startswith("redact"), "redact").otherwise("send").alias("v")))
    w9_seq = F.when(F.coalesce(F.col("dg_decision") == "switch+redact", F.lit(False)), F.col("seq"))
    c = run(c, ["session_id"], "seq", [
        ("last_fresh", "last", F.when(F.col("is_fresh"), F.struct(F.col("epoch").alias("e"), F.col("fresh_action").alias("a"))), False),
        ("first_cand", "first", cand_value, False),
        ("first_w9", "first", w9_seq, False),
        ("last_w9", "last", w9_seq, False)], materialize=False)
    last_fresh_action = F.when(F.col("last_fresh.e") == F.col("epoch"), F.col("last_fresh.a"))
    eligible = F.col("first_cand").isNotNull() & (F.col("first_w9").isNull() | (F.col("first_cand.s") < F.col("first_w9")))
    latch_before = (F.when(eligible, F.when(F.coalesce(F.col("last_w9") > F.col("first_cand.s"), F.lit(False)), F.lit("redact"))
                           .otherwise(F.col("first_cand.v")))
                    .when(F.col("last_w9").isNotNull(), F.lit("redact")))
    c = c.withColumn("latch_before", latch_before).withColumn("last_fresh_action", last_fresh_action)
    action = (F.when(~F.col("gated"), F.lit("pass"))
              .otherwise(F.coalesce(F.col("latch_before"), F.when(F.col("pii_policy") == "redact", F.lit("redact")),
                                    F.when(F.col("is_fresh"), F.col("fresh_action")),
                                    F.col("last_fresh_action"), F.lit("send"))))
    prompted = (F.col("is_fresh") & F.col("latch_before").isNull() & (F.col("pii_policy") == "warn")
                & ~F.col("unattended") & F.col("can_prompt"))
    return c.withColumn("action", action).withColumn("prompted", prompted)
