"""Gate decisions on hand-built session timelines (scenarios of the reference's
end-to-end tests), through the same replay code the jobs use."""
from shroud.operators import detect
from shroud.operators import session as S

TYPES = detect.TYPE_ORDER
ANS = {a: i for i, a in enumerate(S.PII_ANSWERS)}
DANS = {a: i for i, a in enumerate(S.DOWNGRADE_ANSWERS)}


def _tl(spark, rows):
    """rows: (seq, kind, dict) -> timeline frame for session 1."""
    cols = ["session_id", "seq", "kind", "provider", "ceiling", "resolved", "answer_i", "can_prompt", "unattended",
            "pii_policy", "downgrade_policy"] + [f"m_{detect.col_name(t)}" for t in TYPES]
    data = []
    for seq, kind, d in rows:
        hits = d.get("hits", {})
        data.append((1, seq, kind, d.get("provider"), d.get("ceiling"), d.get("resolved"), d.get("answer", 0),
                     d.get("can_prompt", True), d.get("unattended", False), d.get("policy", "warn"),
                     d.get("dpolicy", "warn"), *[hits.get(t, 0) for t in TYPES]))
    schema = ("session_id bigint, seq bigint, kind string, provider string, ceiling string, resolved string, answer_i int, "
              "can_prompt boolean, unattended boolean, pii_policy string, downgrade_policy string, "
              + ", ".join(f"m_{detect.col_name(t)} bigint" for t in TYPES))
    return spark.createDataFrame(data, schema)


def _replay(spark, rows):
    r = S.pii_gate(S.downgrade(S.context_state(_tl(spark, rows))))
    return {x.seq: x for x in r.collect()}


def test_same_pii_asks_once_growth_and_new_type_ask_again(spark):
    # message hits are per message; the payload context is their running sum
    rows = [(10, "payload", {"hits": {"email": 1}, "answer": ANS["send"]}),
            (20, "payload", {"answer": ANS["redact"]}),                       # same context -> no ask
            (30, "payload", {"answer": ANS["redact"]}),
            (40, "payload", {"hits": {"email": 1}, "answer": ANS["redact"]}),  # one more email -> ask
            (50, "payload", {"hits": {"ssn": 1}, "answer": ANS["send"]})]      # new type -> ask
    r = _replay(spark, rows)
    assert [r[s].prompted for s in (10, 20, 30, 40, 50)] == [True, False, False, True, True]
    assert [r[s].action for s in (10, 20, 30, 40, 50)] == ["send", "send", "send", "redact", "send"]


def test_provider_switch_rearms_and_remember_latch_survives(spark):
    rows = [(10, "model_select", {"provider": "venice", "ceiling": "zdr-policy", "resolved": "zdr-policy"}),
            (11, "tier_resolved", {"resolved": "zdr-policy"}),
            (20, "payload", {"hits": {"email": 1}, "answer": ANS["send"]}),
            (30, "model_select", {"provider": "fireworks", "ceiling": "zdr-policy", "resolved": "zdr-policy"}),
            (31, "tier_resolved", {"resolved": "zdr-policy"}),
            (40, "payload", {"answer": ANS["redact+remember"]}),             # new provider -> asks again
            (50, "model_select", {"provider": "venice", "ceiling": "zdr-policy", "resolved": "zdr-policy"}),
            (51, "tier_resolved", {"resolved": "zdr-policy"}),
            (60, "payload", {"answer": ANS["send"]})]                        # latch survives the switch
    r = _replay(spark, rows)
    assert (r[20].prompted, r[40].prompted, r[60].prompted) == (True, True, False)
    assert (r[40].action, r[60].action) == ("redact", "redact")
    assert r[60].epoch == 3


def test_unattended_redacts_without_latch_then_attended_asks(spark):
    rows = [(10, "payload", {"hits": {"email": 1}, "unattended": True, "answer": ANS["send"]}),
            (20, "payload", {"hits": {"ip": 1}, "answer": ANS["send"]})]
    r = _replay(spark, rows)
    assert (r[10].action, r[10].prompted) == ("redact", False)
    assert (r[20].action, r[20].prompted) == ("send", True)


def test_verified_private_tier_is_not_gated_and_policy_redact(spark):
    rows = [(10, "model_select", {"provider": "tinfoil", "ceiling": "tee-verified", "resolved": "tee-verified"}),
            (11, "tier_resolved", {"resolved": "tee-verified"}),
            (20, "payload", {"hits": {"email": 2}})]
    r = _replay(spark, rows)
    assert (r[20].gated, r[20].action) == (False, "pass")
    r = _replay(spark, [(10, "payload", {"hits": {"jwt": 1}, "policy": "redact"})])
    assert (r[10].action, r[10].prompted) == ("redact", False)


def test_downgrade_fires_once_per_transition(spark):
    rows = [(10, "model_select", {"provider": "tinfoil", "ceiling": "tee-verified", "resolved": "tee-verified"}),
            (11, "tier_resolved", {"resolved": "tee-verified"}),
            (20, "payload", {"hits": {"aws-key": 1}}),
            # ceiling pass fires (tee-verified -> zdr-policy); resolution pass does not fire again
            (30, "model_select", {"provider": "venice", "ceiling": "zdr-policy", "resolved": "standard",
                                  "answer": DANS["switch+redact"]}),
            (31, "tier_resolved", {"resolved": "standard"}),
            (40, "payload", {"hits": {"email": 1}, "answer": ANS["send"]}),
            # local -> tee-verified style moves (no exposure rise) never fire
            (50, "model_select", {"provider": "ollama", "ceiling": "local", "resolved": "local"}),
            (51, "tier_resolved", {"resolved": "local"}),
            (60, "model_select", {"provider": "tinfoil", "ceiling": "tee-verified", "resolved": "tee-verified"})]
    r = _replay(spark, rows)
    fired = {s: (x.dg_pass, x.dg_severity, x.dg_decision) for s, x in r.items() if x.dg_pass is not None}
    assert fired == {30: (1, "secret", "switch+redact")}
    assert r[40].action == "redact" and r[40].prompted is False     # "redact from now on" latched


def test_unknown_tier_on_either_side_never_fires(spark):
    rows = [(10, "payload", {"hits": {"email": 1}}),
            (20, "model_select", {"provider": "venice", "ceiling": "zdr-policy", "resolved": None})]
    r = _replay(spark, rows)
    assert r[20].dg_pass is None


def test_badge_changes_only(spark):
    from shroud.plans.session_jobs import badge_changes
    rows = [(10, "payload", {"hits": {"email": 1}}),                                   # no tier yet: pending
            (20, "model_select", {"provider": "tinfoil", "ceiling": "tee-verified"}),  # pending again: no change
            (21, "tier_resolved", {"resolved": "tee-verified"}),
            (30, "payload", {}),                                                         # unchanged
            (40, "model_select", {"provider": "venice", "ceiling": "zdr-policy"}),
            (41, "tier_resolved", {"resolved": "zdr-policy"})]
    got = [(r.seq, r.badge) for r in badge_changes(S.context_state(_tl(spark, rows))).orderBy("seq").collect()]
    assert got == [(10, "⋯ checking privacy"), (21, "🛡 Verified TEE"), (40, "⋯ checking privacy"),
                   (41, "⚠ ZDR (by policy)")]
