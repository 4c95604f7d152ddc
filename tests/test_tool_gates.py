"""Tool-gate decisions on hand-built call logs."""
from pyspark.sql import functions as F

from shroud.operators import session as S
from shroud.operators import tool_gates as TG

FU = {a: i for i, a in enumerate(S.FIRST_USE_ANSWERS)}
EG = {a: i for i, a in enumerate(S.EGRESS_ANSWERS)}


def test_first_use_gate(spark):
    inv = spark.createDataFrame([(1, "deploy", "project"), (1, "lister", "project"), (1, "scratch", "temporary"),
                                 (1, "bash", "builtin"), (2, "deploy", "project"), (3, "deploy", "project")],
                                "session_id bigint, name string, provenance string")
    calls = [  # session, seq, tool, can_prompt, answer
        (1, 10, "deploy", True, FU["block"]), (1, 20, "deploy", True, FU["run"]), (1, 30, "deploy", True, FU["block"]),
        (1, 40, "bash", True, FU["block"]), (1, 50, "unknown_tool", True, FU["block"]),
        (2, 10, "deploy", False, FU["block"]), (2, 20, "deploy", True, FU["block"]),
        (3, 10, "deploy", True, FU["allow-project"]),
        (1, 60, "lister", True, FU["allow-project"]), (1, 70, "scratch", True, FU["block"]),
        (1, 80, "lister", True, FU["show-file"])]
    df = spark.createDataFrame(calls, "session_id bigint, seq bigint, tool string, can_prompt boolean, answer_i int") \
        .withColumn("surface_policy", F.lit("warn")).withColumn("origin", F.lit("model"))
    out = {(r.session_id, r.seq): r.fu_outcome for r in TG.first_use(df, inv).collect()}
    assert out[(1, 10)] == "block" and out[(1, 20)] == "allow" and out[(1, 30)] == "allow"   # block does not latch
    assert out[(1, 40)] == "allow" and out[(1, 50)] == "allow"                               # builtin / no inventory
    assert out[(2, 10)] == "allow+notice" and out[(2, 20)] == "allow"                        # no UI: notice, latched
    assert out[(3, 10)] == "allow"
    assert out[(1, 60)] == "allow" and out[(1, 70)] == "allow" and out[(1, 80)] == "allow"   # session latch


def test_egress_gate(spark):
    rows = [  # session, seq, fires, severity, policy, can_prompt, answer
        (1, 10, True, "pii", "warn", True, EG["allow-session"]), (1, 20, True, "secret", "warn", True, EG["block"]),
        (2, 10, True, "secret", "warn", True, EG["cancel"]), (2, 20, True, "pii", "warn", True, EG["allow-once"]),
        (2, 30, True, "pii", "warn", True, EG["block"]),
        (3, 10, True, "secret", "warn", False, 0), (3, 20, True, "pii", "warn", False, 0),
        (4, 10, True, "pii", "block", True, EG["allow-session"]), (4, 20, True, "pii", "block", True, EG["allow-session"]),
        (5, 10, True, "secret", "off", False, 0), (5, 20, False, None, "warn", True, EG["block"])]
    v = spark.createDataFrame(rows, "session_id bigint, seq bigint, fires boolean, severity string, exfil_policy string, "
                                    "can_prompt boolean, answer_i int")
    out = {(r.session_id, r.seq): r.decision for r in TG.egress_gate(v).collect()}
    assert out[(1, 10)] == "allow" and out[(1, 20)] == "allow+notice"          # allow for session latches
    assert out[(2, 10)] == "block" and out[(2, 20)] == "allow" and out[(2, 30)] == "block"   # cancel = block
    assert out[(3, 10)] == "block" and out[(3, 20)] == "allow+notice"          # no UI: credential blocked, PII passes
    assert out[(4, 10)] == "block" and out[(4, 20)] == "block"                 # policy block never prompts or latches
    assert out[(5, 10)] == "allow" and out[(5, 20)] == "allow"                 # policy off / no verdict
