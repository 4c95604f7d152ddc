"""Expected rows written out by hand (not taken from the SQL twins)."""
import base64
import gzip

import pytest
from pyspark.sql import functions as F

from shroud.functions import gunzip
from shroud.operators import config_audit as C
from shroud.operators import detect
from shroud.operators import session as S
from shroud.operators import tool_gates as TG


def _cfg(spark, rows):
    return spark.createDataFrame(rows, "host bigint, source string, key string, value_json string")


def _validated(spark, source, key, value):
    r = C.validate(_cfg(spark, [(1, source, key, value)])).first()
    return r.valid, r.value, r.reason


def test_config_messages_list_values_in_documented_order(spark):
    assert _validated(spark, "file", "piiPolicy", '"loud"') == (False, None, 'config.piiPolicy="loud" is not one of warn|redact|off — ignoring.')
    assert _validated(spark, "env", "toolSurfacePolicy", '"x"')[2] == 'toolSurfacePolicy="x" is not one of warn|report|off — ignoring, using the default.'


def test_config_trims_every_white_space(spark):
    assert _validated(spark, "env", "showBadge", '"\\tno"') == (True, "false", None)
    assert _validated(spark, "env", "showBadge", '"\\u00a0Yes\\n"') == (True, "true", None)
    assert _validated(spark, "file", "piiAllow", '["\\tops@home.net\\n", "\\t"]') == (
        True, "ops@home.net", "config.piiAllow has non-string/empty entries — dropping them.")
    assert _validated(spark, "file", "badgeKey", '"\\t k \\n"') == (True, "k", None)
    assert _validated(spark, "file", "badgeKey", '"\\t"')[0] is False


def test_config_empty_environment_values_are_silent(spark):
    for key in ("piiPolicy", "showBadge", "badgeSinks", "piiAllow", "badgeKey"):
        assert _validated(spark, "env", key, '""') == (False, None, None)
    assert _validated(spark, "env", "piiAllow", '" , "')[2] == 'piiAllow=" , " has no entries — ignoring it.'


def test_config_every_bad_sink_is_named(spark):
    listed = "status|widget|title|notify"
    assert _validated(spark, "env", "badgeSinks", '"first second"') == (False, None, "\n".join([
        f'badgeSinks: "first" is not a badge sink ({listed}) — dropping it.', f'badgeSinks: "second" is not a badge sink ({listed}) — dropping it.',
        'badgeSinks="first second" has no valid sinks — using the default chain.']))
    assert _validated(spark, "env", "badgeSinks", '"TITLE;x, title"')[1] == "title"


def test_an_explicit_file_of_bad_rows_still_replaces_the_project_file(spark):
    rows = [(1, "file", "piiPolicy", '"loud"'), (1, "project", "piiPolicy", '"redact"'),
            (2, "project", "piiPolicy", '"redact"'), (2, "project_trusted", "piiPolicy", '"off"'),
            (3, "env", "badgeKey", '"b"'), (3, "env", "badgeKey", '"a"')]
    got = {(r.host, r.key): (r.value, r.source) for r in C.effective(C.validate(_cfg(spark, rows))).collect()}
    assert got[1, "piiPolicy"] == ("warn", "default")
    assert got[2, "piiPolicy"] == ("off", "project_trusted")
    assert got[3, "badgeKey"] == ("a", "env")


def test_undecodable_bodies_count_as_absent():
    whole = gzip.compress(b"x" * 500)
    assert gunzip.facts(whole, b"xx") == (b"x" * 144, 500, True)
    broken = whole[:12] + bytes(8) + whole[20:]
    for body in (broken, whole[:-9], b"not gzip", b"", base64.b64encode(whole)):
        assert gunzip.facts(body, b"xx") in (None, (b"", 0, False))
    assert gunzip.facts(None, b"xx") is None


def test_a_long_body_is_read_to_its_end():
    key = bytes(range(32))
    chunk = gunzip.CHUNK
    for at in (0, chunk - 31, chunk - 1, chunk, 3 * chunk - 16, 5 * chunk + 7):  # also across the edges of chunks
        body = gzip.compress(b"y" * at + key + b"z" * 100)
        assert gunzip.facts(body, key) == ((b"y" * at + key + b"z" * 100)[:144], at + 132, True)
        assert gunzip.facts(body, bytes(32)) == ((b"y" * at + key + b"z" * 100)[:144], at + 132, False)
    assert gunzip.facts(gzip.compress(b"y" * (70 << 20)), None) == (b"y" * 144, 70 << 20, False)


def test_a_repeated_tool_name_does_not_multiply_calls(spark):
    calls = spark.createDataFrame([(1, 10, "deploy", True, 0, "warn", "model"), (1, 20, "deploy", True, 3, "warn", "model"), (1, 30, "ls", True, 0, "warn", "model")],
                                  "session_id bigint, seq bigint, tool string, can_prompt boolean, answer_i bigint, surface_policy string, origin string")
    entries = spark.createDataFrame([(1, 0, "deploy", "user"), (1, 1, "deploy", "project"), (1, 2, "ls", "project"), (1, 3, "ls", "builtin")],
                                    "session_id bigint, position bigint, name string, provenance string")
    got = {r.seq: (r.fu_applies, r.fu_outcome) for r in TG.first_use(calls, entries).collect()}
    assert got == {10: (True, "allow"), 20: (True, "allow"), 30: (False, "allow")}


# --- session logs ------------------------------------------------------------------------------

def _log(spark, events):
    """events: (seq, kind, extra columns). One session; prompts can be asked, answers 'switch'."""
    cols = ["provider", "model_id", "ceiling", "resolved"]
    rows = []
    for seq, kind, x in events:
        rows.append((1, seq, kind, *[x.get(c) for c in cols], x.get("email", 0), x.get("answer", 1), x.get("pii_policy", "warn")))
    df = spark.createDataFrame(rows, "session_id bigint, seq bigint, kind string, provider string, model_id string, ceiling string, resolved string, "
                                     "m_email bigint, answer_i bigint, pii_policy string")
    for t in detect.TYPE_ORDER:
        if t != "email":
            df = df.withColumn(f"m_{detect.col_name(t)}", F.lit(0).cast("bigint"))
    return (df.withColumn("can_prompt", F.lit(True)).withColumn("unattended", F.lit(False)).withColumn("downgrade_policy", F.lit("warn")))


def _downgrades(spark, events):
    rows = S.downgrade(S.context_state(_log(spark, events))).where("dg_pass is not null").orderBy("seq").collect()
    return [(r.seq, r.dg_pass, r.dg_from, r.dg_to, r.dg_model) for r in rows]


START = [(10, "model_select", {"provider": "ollama", "model_id": "m", "ceiling": "local"}), (11, "tier_resolved", {"resolved": "local"})]
TEE = {"provider": "tinfoil", "model_id": "r1", "ceiling": "tee-verified"}


def test_late_resolution_fires_where_it_lands(spark):
    log = [*START, (20, "model_select", TEE | {"ceiling": "local"}), (30, "payload", {"email": 2}), (45, "tier_resolved", {"resolved": "tee-unverified"})]
    assert _downgrades(spark, log) == [(45, 2, "local", "tee-unverified", "tinfoil/r1")]


def test_a_transition_fires_once(spark):
    log = [*START, (15, "payload", {"email": 1}), (20, "model_select", TEE | {"ceiling": "standard"}), (25, "tier_resolved", {"resolved": "standard"}),
           (26, "tier_resolved", {"resolved": "standard"})]
    assert [(s, p) for s, p, *_ in _downgrades(spark, log)] == [(20, 1)]
    log = [*START, (15, "payload", {"email": 1}), (20, "model_select", TEE | {"ceiling": "local"}), (25, "tier_resolved", {"resolved": "standard"}),
           (26, "tier_resolved", {"resolved": "standard"}), (30, "model_select", TEE | {"ceiling": "standard"}), (31, "tier_resolved", {"resolved": "standard"})]
    assert [(s, p) for s, p, *_ in _downgrades(spark, log)] == [(25, 2)]


def test_no_hits_by_the_resolution_no_firing(spark):
    log = [*START, (20, "model_select", TEE | {"ceiling": "local"}), (45, "tier_resolved", {"resolved": "standard"}), (50, "payload", {"email": 2})]
    assert _downgrades(spark, log) == []


def test_baseline_is_the_greatest_context_of_the_epoch(spark):
    """A compaction takes two emails out of the context; the third email is not new again."""
    standard = {"provider": "acme", "model_id": "m", "ceiling": "standard"}
    log = [(10, "model_select", standard), (11, "tier_resolved", {"resolved": "standard"}), (20, "payload", {"email": 3}), (30, "payload", {"email": -2}),
           (40, "payload", {"email": 1}), (50, "payload", {"email": 2})]
    r = S.pii_gate(S.downgrade(S.context_state(_log(spark, log)))).where("gated").orderBy("seq").collect()
    assert [(x.seq, x.ctx_email, x.base_email, bool(x.is_fresh)) for x in r] == [(20, 3, None, True), (30, 1, 3, False), (40, 2, 3, False), (50, 4, 3, True)]


def test_a_cluster_session_without_a_shared_folder_is_refused():
    from shroud import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
