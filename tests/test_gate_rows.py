"""The gate's processor on rows: the same decisions as on data frames, few calls to the state store."""
from collections import Counter
from datetime import datetime, timedelta, timezone

from pyspark.sql import Row

from shroud.operators.detect import TYPE_ORDER, col_name
from shroud.streaming import gate_state
from shroud.streaming import jobs as SJ

START = datetime(2026, 3, 2, 8, 0, 0, 123456, tzinfo=timezone.utc)
DDL = ("session_id bigint, seq bigint, kind string, ts timestamp, provider string, ceiling string, resolved string, answer_i bigint, "
       "can_prompt boolean, unattended boolean, pii_policy string, downgrade_policy string, hits array<struct<type: string, count: bigint>>")


class _State:
    def __init__(self, calls):
        self.calls, self.kept = calls, None

    def get(self):
        self.calls["get"] += 1
        return self.kept

    def update(self, value):
        self.calls["update"] += 1
        self.kept = value

    def __getattr__(self, name):  # any other call is counted as well
        def call(*_):
            self.calls[name] += 1
            return iter(())
        return call


class _Handle:
    def __init__(self):
        self.calls = Counter()

    def getValueState(self, *_):
        return _State(self.calls)

    getMapState = getValueState


def event(seq, kind, at=START, hits=None, **more):
    r = {"session_id": 16, "seq": seq, "kind": kind, "ts": at, "provider": None, "ceiling": None, "resolved": None, "answer_i": seq % 5,
         "can_prompt": seq % 3 != 0, "unattended": False, "pii_policy": "warn", "downgrade_policy": "warn",
         "hits": list((hits or {}).items()), **more}
    return tuple(r[c.split()[0]] for c in DDL.split(", ") if not c.startswith("count"))


def session():
    out = [event(10, "model_select", provider="ollama", ceiling="local"), event(11, "tier_resolved", resolved="local"),
           event(20, "payload", hits={t: 2 for t in TYPE_ORDER}),
           event(30, "model_select", START + timedelta(minutes=3, microseconds=7), provider="openai", ceiling="standard"),
           event(31, "tier_resolved", resolved="standard"), event(40, "payload"), event(50, "payload", hits={TYPE_ORDER[0]: 1}),
           event(60, "payload", hits={TYPE_ORDER[-1]: 3}, can_prompt=None)]
    return out[::-1]  # arrival order does not matter


def on_rows(spark, made, handle):
    p = gate_state.GateRowProcessor()
    p.init(handle)
    half = [r for r in made if r[1] < 40], [r for r in made if r[1] >= 40]
    out = []
    for batch in half:
        steps = spark.createDataFrame(batch, DDL).withColumn("at", SJ.F.col("ts")).select("session_id", gate_state.packed_step()).collect()
        out += p.handleInputRows((16,), iter(steps), None)
    return [r.asDict() for r in gate_state.unpacked(spark.createDataFrame(out, "decisions string")).orderBy("seq", "out_kind").collect()]


def test_rows_and_frames_decide_alike(spark):
    made = session()
    rows = on_rows(spark, made, _Handle())
    frame = spark.createDataFrame(made, DDL).selectExpr("*", "ts AS at", "unix_millis(ts) AS at_ms").toPandas()
    for t in TYPE_ORDER:
        frame[f"m_{col_name(t)}"] = [dict(h).get(t, 0) for h in frame.hits]
    p = gate_state.GateProcessor()
    p.init(_Handle())
    frames = [r for part in (frame[frame.seq < 40], frame[frame.seq >= 40])
              for f in p.handleInputRows((16,), iter([part]), None) for r in f.to_dict("records")]
    frames.sort(key=lambda r: (r["seq"], r["out_kind"]))
    same = [c for c in gate_state.OUTPUT if c != "at"]
    none = lambda v: None if v is None or v != v else v
    assert [[r[c] for c in same] for r in rows] == [[none(r[c]) for c in same] for r in frames]
    assert {r["out_kind"] for r in rows} == {"pii", "downgrade"} and any(r["gated"] for r in rows)
    assert [r["at"] for r in rows] == [f["at"].to_pydatetime().replace(tzinfo=None) for f in frames]


def test_calls_to_the_state_store_do_not_grow_with_types(spark):
    handle = _Handle()
    assert on_rows(spark, session(), handle)
    assert handle.calls == {"get": 2, "update": 2}  # two micro-batches, every type found


def test_events_without_a_time_are_decided(spark):
    rows = on_rows(spark, [event(20, "payload", None, hits={TYPE_ORDER[0]: 1}), event(50, "payload", None)], _Handle())
    assert [(r["seq"], r["at"], r["gated"]) for r in rows] == [(20, None, True), (50, None, True)]


def test_many_decisions_leave_in_several_rows():
    p = gate_state.GateRowProcessor()
    p.init(_Handle())
    steps = (Row(step='{"seq": %d, "kind": "payload", "at_ms": 1, "pii_policy": "off"}' % i) for i in range(2_500))
    assert len(list(p.handleInputRows((1,), steps, None))) == 3
