import json

from pyspark.sql import functions as F

from shroud.operators import posture as P
from shroud.operators import surface as S


def test_provenance_and_reach(spark):
    rows = [("bash", None, None, "{}"), ("deploy", "project", None, "{}"), ("grep_web", "user", "package", "{}"),
            ("mytool", "user", None, json.dumps({"properties": {"q": {"description": "url"}}})),
            ("scratch", "temporary", None, "{}"), ("mystery", None, None, "{}"), ("bash", "project", None, "{}"),
            ("read", "project", None, "{}"),
            ("nested", "user", None, json.dumps({"properties": {"config": {"properties": {"base_url": {}}}}}))]
    df = spark.createDataFrame(rows, "name string, scope string, origin string, parameters string")
    e = S.classify(df.withColumn("description", F.lit(None).cast("string"))
                   .withColumn("prompt_guidelines", F.lit(None).cast("string")).withColumn("path", F.lit(None).cast("string")))
    got = [(r.name, r.provenance, r.reach) for r in e.collect()]
    assert got == [("bash", "builtin", "shell"), ("deploy", "project", "unknown"), ("grep_web", "package", "unknown"),
                   ("mytool", "user", "unknown"), ("scratch", "temporary", "unknown"), ("mystery", "unknown", "unknown"),
                   ("bash", "project", "shell"), ("read", "project", "unknown"), ("nested", "user", "network")]


def _nest(depth):
    s = {"properties": {"endpoint": {}}}
    for k in range(depth):
        s = {"properties": {f"l{k}": s}}
    return json.dumps(s)


def test_schema_depth_bound(spark):
    df = spark.createDataFrame([(_nest(6),), (_nest(7),), (json.dumps({"items": [{"properties": {"URL": {}}}]}),)], "p string")
    assert [r.n for r in df.select(S.schema_declares_network(F.col("p")).alias("n")).collect()] == [True, False, True]


def test_effective_tier(spark):
    rows = [("nope", None, False, False), ("ollama", None, False, False), ("custom", "http://127.0.0.1:8080/v1", False, False),
            ("custom", "https://api.example.com", False, False), ("openrouter", None, False, False),
            ("openrouter", None, True, False), ("proxied-tee", None, False, False), ("proxied-tee", None, False, True),
            ("tinfoil", None, False, False), ("venice", None, False, False)]
    df = spark.createDataFrame(rows, "p string, u string, z boolean, v boolean")
    got = [r.t for r in df.select(P.effective_tier(F.col("p"), F.col("u"), F.col("z"), F.col("v")).alias("t")).collect()]
    assert got == ["standard", "local", "local", "standard", "zdr-policy", "zdr-enforced", "zdr-policy", "tee-verified",
                   "tee-verified", "zdr-policy"]
    cap = df.select(P.capability_tier(F.lit("unknown-co"), F.lit("http://localhost:1234"), F.lit(False), F.lit(False)).alias("t")).first().t
    assert cap == "local"


def test_report_and_key_grades(spark):
    nonce = "a" * 64
    rows = [('{"signing_address":"0xabc","nvidia":"x","report_data":"' + nonce + '"}', nonce),
            ('{"signing_address":"0xabc","gpu":"x"}', ""), ("{}", nonce), ('{"intel_quote":"x"}', nonce)]
    df = spark.createDataFrame(rows, "raw string, nonce string")
    got = [r.g.posture for r in df.select(P.report_grade(F.col("raw"), F.col("nonce")).alias("g")).collect()]
    assert got == ["green", "yellow", "red", "yellow"]
    key = "ab" * 32
    body = "00" * 0x50 + key + "00" * 32
    sev = "https://x/predicate/sev-snp-guest/v2"
    rows = [(sev, body, key), (sev, body, "cd" * 32), (sev, body, None), ("", None, key)]
    d = spark.createDataFrame(rows, "f string, b string, k string")
    got = [r.g.posture for r in d.select(P.key_grade(F.col("f"), F.unhex(F.col("b")), F.col("k")).alias("g")).collect()]
    assert got == ["green", "yellow", "yellow", "red"]


def test_gzipped_key_pin_body(spark):
    import base64
    import gzip
    key = "ef" * 32
    raw = bytes.fromhex("00" * 0x50 + key + "00" * 32)
    rows = [(base64.b64encode(gzip.compress(raw)).decode(), key), (base64.b64encode(raw).decode(), key)]
    df = spark.createDataFrame(rows, "b string, k string")
    d = P.with_body_facts(df.withColumn("i", F.monotonically_increasing_id()), body="b", live_key="k")
    g = d.select("i", P.key_grade_of(F.lit("https://x/predicate/sev-snp-guest/v2"), F.col("facts"), F.col("k")).alias("g"))
    assert [r.g.posture for r in g.orderBy("i").collect()] == ["green", "green"]
