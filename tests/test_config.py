"""Configuration validation, the project-trust floor and layering."""
from shroud.operators import config_audit as C


def _rows(spark, rows):
    return spark.createDataFrame([(h, s, k, v) for h, s, k, v in rows], "host bigint, source string, key string, value_json string")


def test_validation_never_coerces(spark):
    v = {(r.key, r.value_json): (r.valid, r.value, r.reason) for r in C.validate(_rows(spark, [
        (1, "file", "piiPolicy", '"REDACT"'), (1, "file", "piiPolicy", '"redct"'), (1, "file", "showBadge", '"yes"'),
        (1, "file", "badgeKey", '"  k  "'), (1, "file", "resolveTier", '"x"'), (1, "env", "showBadge", '"off"'),
        (1, "env", "badgeSinks", '"status nope"'), (1, "file", "piiAllow", '["a@b.com", 3]')])).collect()}
    assert v[("piiPolicy", '"REDACT"')][:2] == (True, "redact")
    assert v[("piiPolicy", '"redct"')][0] is False and "is not one of warn|redact|off" in v[("piiPolicy", '"redct"')][2]
    assert v[("showBadge", '"yes"')][0] is False                      # JSON needs a real boolean
    assert v[("badgeKey", '"  k  "')][:2] == (True, "k")
    assert "code-only" in v[("resolveTier", '"x"')][2]
    assert v[("showBadge", '"off"')][:2] == (True, "false")            # env text booleans
    assert v[("badgeSinks", '"status nope"')][:2] == (True, "status") and "nope" in v[("badgeSinks", '"status nope"')][2]
    assert v[("piiAllow", '["a@b.com", 3]')][:2] == (True, "a@b.com")


def test_project_floor_only_tightens(spark):
    weak = [("piiPolicy", '"off"'), ("toolExfilPolicy", '"off"'), ("toolResultPolicy", '"off"'),
            ("downgradePolicy", '"off"'), ("toolSurfacePolicy", '"report"'), ("showBadge", "false"), ("modelPicker", "false")]
    tight = [("piiPolicy", '"redact"'), ("toolExfilPolicy", '"block"'), ("installDispatcher", "true")]
    forbidden = [("piiAllow", '["*@*"]'), ("badgeSinks", '["status"]'), ("toolSurfaceCommand", '"s"'),
                 ("modelPickerCommand", '"m"')]
    rows = [(1, "project", k, v) for k, v in weak + tight + forbidden]
    f = {r.key + r.value: (r.kept, r.violation) for r in C.floor(C.validate(_rows(spark, rows)).where("valid")).collect()}
    assert sum(1 for k, (kept, why) in f.items() if not kept and "WEAKER" in why) == len(weak)
    assert all(kept for k, (kept, _) in f.items() if k in {"piiPolicyredact", "toolExfilPolicyblock", "installDispatchertrue"})
    assert sum(1 for k, (kept, why) in f.items() if not kept and "since" in why) == len(forbidden)


def test_layering_env_over_file_over_default(spark):
    rows = [(1, "project", "piiPolicy", '"off"'), (1, "env", "piiPolicy", '"redact"'), (2, "project", "piiPolicy", '"off"'),
            (3, "file", "piiPolicy", '"off"'), (3, "project", "toolExfilPolicy", '"block"'),
            (4, "project_trusted", "piiPolicy", '"off"')]
    eff = {(r.host, r.key): (r.value, r.source) for r in C.effective(C.validate(_rows(spark, rows))).collect()}
    assert eff[(1, "piiPolicy")] == ("redact", "env")
    assert eff[(2, "piiPolicy")] == ("warn", "default")          # the floor dropped the weakening value
    assert eff[(3, "piiPolicy")] == ("off", "file")              # explicit file is exempt from the floor
    assert eff[(3, "toolExfilPolicy")] == ("warn", "default")    # an explicit file replaces the project file
    assert eff[(4, "piiPolicy")] == ("off", "project_trusted")   # trust resolved by the host
    assert eff[(1, "badgeKey")] == ("privacy-badge", "default")
