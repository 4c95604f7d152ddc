"""Raw JSON lines, settings files, request membership and allow rules per host: hand-made rows."""
import ipaddress
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from shroud.operators import allow, config_audit
from shroud.operators import context as CX
from shroud.operators import raw_payload as RP
from shroud.plans import config_jobs, raw_jobs
from shroud.sources import fixtures, raw_logs
from tests.conftest import SF_SMALL

MAIL = "write to eve@harbour.io"


def lines_frame(spark, tmp_path, lines):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n\n", encoding="utf-8")
    return RP.walked(raw_logs.read_json_lines(spark, str(tmp_path / "raw")))


def test_every_line_comes_out_with_an_outcome(spark, tmp_path):
    lines = [{"payload": {"messages": [{"role": "user", "content": MAIL, "id": 7}], "model": "m"}},
             {"payload": {"messages": [{"content": [{"type": "text", "text": MAIL, "cache": True}, {"type": "image", "data": "x"}, 5, None]}]}},
             {"payload": {"messages": [{"content": ["bare " + MAIL]}]}}, {"payload": {"messages": [{"content": {"blocks": MAIL}}]}},
             {"payload": {"messages": [{"content": "fine"}, {"role": "tool"}, 3, None]}}, {"payload": {"messages": []}}, {"payload": {"prompt": MAIL}},
             {"payload": MAIL}, {"payload": None}, {}, [1], "3", '{"payload": {"messages": [', "not json at all", {"payload": {"messages": {"0": MAIL}}}]
    got = [(r.outcome, r.body) for r in RP.redacted(lines_frame(spark, tmp_path, lines), only=["email"]).select("outcome", "body").collect()]
    assert [o for o, _ in got] == ["redacted", "redacted", "could-not-redact", "could-not-redact", "unchanged", "unchanged", "unknown-shape",
                                   "unknown-shape", "no-payload", "no-payload", "no-payload", "no-payload", "bad-record", "bad-record", "unknown-shape"]
    assert json.loads(got[0][1]) == {"messages": [{"role": "user", "content": "write to «email»", "id": 7}], "model": "m"}
    assert json.loads(got[1][1]) == {"messages": [{"content": [{"type": "text", "text": "write to «email»", "cache": True}, {"type": "image", "data": "x"}, 5, None]}]}
    for i in (2, 3, 4, 5, 6, 7, 14):  # passed through whole
        assert json.loads(got[i][1]) == lines[i]["payload"]
    assert [b for _, b in got[8:14]] == ['{"payload": null}', "{}", "[1]", "3", '{"payload": {"messages": [', "not json at all"]


def test_scan_sees_every_shape(spark, tmp_path):
    lines = [{"payload": {"messages": [{"content": MAIL}, {"content": [{"text": "a"}, "b", {"data": MAIL}]}, {"role": MAIL}]}}, {"payload": {"prompt": MAIL}}, "cut " + MAIL]
    got = sorted((r.line[:3], r.part_no, r.text) for r in RP.scan_texts(lines_frame(spark, tmp_path, lines), ["line"]).collect())
    assert [t for _, _, t in got] == ["cut " + MAIL, MAIL, 'a\nb\n{"data":"%s"}' % MAIL, '{"role":"%s"}' % MAIL, '{"prompt":"%s"}' % MAIL] or \
        sorted(t for _, _, t in got) == sorted(["cut " + MAIL, MAIL, 'a\nb\n{"data":"%s"}' % MAIL, '{"role":"%s"}' % MAIL, '{"prompt":"%s"}' % MAIL])


def test_settings_files_equal_the_table(spark):
    folder = raw_jobs.settings_files(spark, SF_SMALL)
    settings, remarks = raw_logs.read_settings(spark, f"{folder}/*/*")
    table = fixtures.config_settings(spark, SF_SMALL)
    rows = lambda df: Counter(map(tuple, df.select("host", "source", "key", "value_json").collect()))
    assert rows(settings) == rows(table) and remarks.count() == 0
    assert Counter(map(tuple, config_audit.effective(config_audit.validate(settings)).collect())) == \
        Counter(map(tuple, config_jobs.config_effective(spark, SF_SMALL).collect()))


def test_settings_files_by_hand(spark, tmp_path):
    def put(layer, name, *lines):
        (tmp_path / layer).mkdir(parents=True, exist_ok=True)
        (tmp_path / layer / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    put("explicit", "h1.json", {"host": 1, "settings": {"piiPolicy": "off", "showBadge": False}})
    put("project", "all.json", {"host": 1, "settings": {"piiPolicy": "redact"}}, {"host": 2, "settings": {"piiPolicy": "off", "toolExfilPolicy": "block"}},
        '{"host": 2, "settings": {"piiPol', {"settings": {"piiPolicy": "off"}}, {"host": 3, "settings": 5})
    put("project-trusted", "t.json", {"host": 4, "settings": {"piiPolicy": "off"}})
    put("env", "e.json", {"host": 2, "settings": {"showBadge": "no"}})
    put("elsewhere", "x.json", {"host": 9, "settings": {"piiPolicy": "off"}})
    settings, remarks = raw_logs.read_settings(spark, f"{tmp_path}/*")
    eff = {(r.host, r.key): (r.value, r.source) for r in config_audit.effective(config_audit.validate(settings)).collect()}
    assert eff[1, "piiPolicy"] == ("off", "file") and eff[1, "showBadge"] == ("false", "file")   # the explicit file is honoured in full
    assert eff[2, "piiPolicy"][1] == "default" and eff[2, "toolExfilPolicy"] == ("block", "project")  # a project may only tighten
    assert eff[2, "showBadge"] == ("false", "env") and eff[4, "piiPolicy"] == ("off", "project_trusted")
    assert not any(h == 9 for h, _ in eff)
    assert Counter(r.message for r in remarks.collect()) == Counter({
        "config file line is not valid JSON — ignoring it.": 1, "config file line names no host — ignoring it.": 1,
        "config file line has no object of settings — ignoring it.": 1, "config file line lies under no known layer — ignoring it.": 1})


def test_a_request_that_drops_messages_carries_less(spark):
    texts = {"a": "mail eve@harbour.io and bob@harbour.io", "b": "ssn 219-09-9999", "c": "nothing", "s": "summary of eve@harbour.io"}
    requests = {1: "a", 2: "ab", 3: "abc", 4: "sc", 5: "scb", 6: "aab", 7: "c"}
    messages = spark.createDataFrame(list(texts.items()) * 3, "name string, text string").withColumn("digest", CX.digest(F.col("text")))
    members = spark.createDataFrame([(r, m) for r, ms in requests.items() for m in ms], "req int, name string").join(
        messages.select("name", "digest").distinct(), "name").select("req", "digest")
    scanned = CX.scanned_messages(messages.select("digest", "text"))
    assert scanned.count() == len(texts)  # each once
    got = {}
    for r in CX.request_hits(members, scanned, ["req"]).collect():
        got.setdefault(r.req, {})[r.type] = r.hits
    assert got == {1: {"email": 2}, 2: {"email": 2, "ssn": 1}, 3: {"email": 2, "ssn": 1}, 4: {"email": 1}, 5: {"email": 1, "ssn": 1},
                   6: {"email": 4, "ssn": 1}}


def test_ranges_merge_and_hold_addresses(spark):
    rng = random.Random(5)
    raws = [(h, f"{rng.choice(['10', '10', '172', '192'])}.{rng.randrange(3)}.{rng.randrange(256)}.{rng.randrange(256)}/{rng.choice([8, 15, 16, 23, 24, 25, 31, 32])}")
            for h in range(4) for _ in range(25)] + [(5, "0.0.0.0/0"), (6, "10.0.0.0/25"), (6, "10.0.0.128/25"), (6, "10.0.1.0/24"), (6, "10.0.3.0/32")]
    rules = allow.parse_rules(spark.createDataFrame(raws, "host bigint, raw string")).where("kind IS NOT NULL")
    ranges = {}
    for r in allow.merged_ranges(rules).collect():
        ranges.setdefault(r.host, []).append((r.lo, r.hi))
    for spans in ranges.values():
        spans.sort()
        assert all(a[1] + 1 < b[0] for a, b in zip(spans, spans[1:]))
    base = int(ipaddress.ip_address("10.0.0.0"))
    assert ranges[5] == [(0, 2**32 - 1)] and ranges[6] == [(base, base + 511), (base + 768, base + 768)]
    edges = {x + d for spans in ranges.values() for lo, hi in spans for x in (lo, hi) for d in (-1, 0, 1) if 0 <= x + d < 2**32}
    asked = [(h, ip) for h in [*range(7), 99] for ip in edges]
    got = {tuple(r) for r in allow.addresses_in_ranges(spark.createDataFrame(asked, "host bigint, ip_int bigint"), allow.merged_ranges(rules)).collect()}
    nets = {h: [ipaddress.ip_network(raw, strict=False) for hh, raw in raws if hh == h] for h in [*range(7), 99]}
    assert got == {(h, ip) for h, ip in asked if any(ipaddress.ip_address(ip) in n for n in nets[h])}


def test_a_host_is_judged_by_its_own_entries(spark):
    entries = spark.createDataFrame([(1, "@harbour.io"), (2, "10.1.0.0/16"), (2, "eve*"), (3, "*@sea.io")], "host bigint, raw string")
    rules = allow.parse_rules(entries).where("kind IS NOT NULL")
    values = [("email", "eve@harbour.io"), ("email", "bob@dock.harbour.io"), ("ip", "10.1.2.3"), ("ip", "127.0.0.1"), ("email", "al@sea.io"), ("email", "x@example.com")]
    findings = spark.createDataFrame([(h, t, v, i) for h in (1, 2, 3, 4) for i, (t, v) in enumerate(values)], "host bigint, type string, value string, n int")
    out = allow.split_by_host(findings, rules, spark.createDataFrame([(3,), (3,)], "host bigint"))
    got = {}
    for r in out.collect():
        got.setdefault(r.host, {})[r.value] = r.allowed
    own = {1: {"eve@harbour.io", "bob@dock.harbour.io"}, 2: {"eve@harbour.io", "10.1.2.3"}, 3: {"al@sea.io"}, 4: set()}
    for h in own:
        default = set() if h == 3 else {"127.0.0.1", "x@example.com"}
        assert {v for v, a in got[h].items() if a} == own[h] | default, h
    assert out.count() == findings.count()
