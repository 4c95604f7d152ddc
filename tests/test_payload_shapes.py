"""Nested payloads, tool results and request bodies: hand-made rows."""
import json

from pyspark.sql import functions as F

from shroud.operators import payload as PL
from shroud.plans.report_jobs import pin_bodies

TEXT = "write to eve@harbour.io"


def test_messages_keep_their_shape(spark):
    messages = [("user", TEXT, None), ("assistant", None, [("text", TEXT, None), ("image", None, "data:eve@harbour.io")]), ("tool", None, None), ("user", "", [])]
    df = spark.createDataFrame([(1, messages), (2, []), (3, None)], f"id int, m array<{PL.MESSAGE}>")
    out = {r.id: r for r in df.select("id", PL.redact_messages(F.col("m"), only=["email"]).alias("r"), F.transform("m", PL.message_text).alias("t"),
                                      F.transform("m", PL.message_json).alias("j")).collect()}
    red = out[1].r
    assert [m.role for m in red] == ["user", "assistant", "tool", "user"]
    assert red[0].content == "write to «email»" and red[0].parts is None
    assert [(p.kind, p.text, p.raw) for p in red[1].parts] == [("text", "write to «email»", None), ("image", None, "data:eve@harbour.io")]
    assert red[2].content is None and red[2].parts is None and red[3].content == "" and red[3].parts == []
    assert out[1].t == [TEXT, TEXT, "", ""]
    assert [json.loads(j) for j in out[1].j[:2]] == [{"role": "user", "content": TEXT}, {"role": "assistant", "content": [
        {"type": "text", "text": TEXT}, {"type": "image", "data": "data:eve@harbour.io"}]}]
    assert out[2].r == [] and out[3].r is None


def test_results_keep_their_shape(spark):
    rows = [(1, (TEXT, None, None, None)), (2, (None, [TEXT, "fine"], None, None)), (3, (None, None, [("text", TEXT, None), ("image", None, "x")], None)),
            (4, (None, None, None, '{"mail":"eve@harbour.io"}')), (5, ("fine", None, None, None)), (6, (None, None, None, None))]
    df = spark.createDataFrame(rows, f"id int, r {PL.RESULT}")
    red = PL.redact_result(F.col("r"), only=["email"])
    out = {x.id: x for x in df.withColumn("red", red).select("id", "red", PL.result_text(F.col("r")).alias("t"), PL.result_outcome(
        F.col("r"), F.col("red"), PL.result_text(F.col("r")).contains("@")).alias("o")).collect()}
    assert [out[i].t for i in range(1, 7)] == [TEXT, TEXT + "\nfine", TEXT + "\n", '{"mail":"eve@harbour.io"}', "fine", ""]
    assert [out[i].o for i in range(1, 7)] == ["redacted", "redacted", "redacted", "could-not-redact", "unchanged", "unchanged"]
    assert out[2].red.strings == ["write to «email»", "fine"] and out[3].red.parts[1].raw == "x" and out[4].red.raw == '{"mail":"eve@harbour.io"}'


def test_pins_merge_into_existing_bodies(spark):
    rows = [(1, "venice", False, '{"model":"m","temperature":0.5}'), (2, "venice", True, '{"venice_parameters":{"character":"c","include_venice_system_prompt":true},"n":[1,"2"]}'),
            (3, "venice", True, '{"venice_parameters":{"include_venice_system_prompt":false}}'), (4, "openrouter", True, '{"provider":{"order":["a"],"zdr":true}}'),
            (5, "openrouter", True, '{"provider":{"data_collection":"deny","zdr":true}}'), (6, "openrouter", False, '{"provider":{"zdr":false}}'),
            (7, "acme", True, '{"model":"m"}'), (8, "openrouter", True, '{"provider":"text"}'), (9, "venice", True, None)]
    out = {r.id: r for r in pin_bodies(spark.createDataFrame(rows, "id int, provider string, zdr boolean, raw string")).collect()}
    body = {i: None if r.body is None else json.loads(r.body) for i, r in out.items()}
    assert body[1] == {"model": "m", "temperature": 0.5, "venice_parameters": {"include_venice_system_prompt": False}}
    assert body[2] == {"venice_parameters": {"character": "c", "include_venice_system_prompt": False}, "n": [1, "2"]}
    assert body[4] == {"provider": {"order": ["a"], "zdr": True, "data_collection": "deny"}}
    assert body[6] == {"provider": {"zdr": False}} and body[7] == {"model": "m"}
    assert body[8] == {"provider": {"zdr": True, "data_collection": "deny"}} and body[9] == {"venice_parameters": {"include_venice_system_prompt": False}}
    assert {i: r.missing_pin for i, r in out.items()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False, 8: True, 9: True}
    assert [out[i].pin for i in (3, 5, 6, 7)] == ["venice-system-prompt-off", "openrouter-zdr", None, None]
