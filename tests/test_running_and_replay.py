"""The skew-safe running aggregates equal plain windows; the batch replay equals
a brute-force, event-at-a-time replay of the same sessions."""
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from shroud.operators.running import running


def test_running_matches_plain_window(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 2, 3]) if i % 3 else 1, i * 10 + rnd.randint(0, 5), rnd.choice([None, 1, 2, 5]),
             rnd.choice([None, "a", "b"])) for i in range(600)]   # session 1 is hot
    df = spark.createDataFrame(rows, "k int, seq int, v int, s string").dropDuplicates(["k", "seq"])
    got = running(df, ["k"], "seq", [("sum_i", "sum", F.col("v"), True), ("max_e", "max", F.col("v"), False),
                                     ("last_e", "last", F.col("s"), False), ("first_e", "first", F.col("s"), False),
                                     ("any_i", "bool_or", F.col("v") == 5, True)], span=37)
    w_i = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    w_e = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.select("k", "seq", F.coalesce(F.sum("v").over(w_i), F.lit(0)).alias("sum_i"), F.max("v").over(w_e).alias("max_e"),
                    F.last("s", True).over(w_e).alias("last_e"), F.first("s", True).over(w_e).alias("first_e"),
                    F.coalesce(F.bool_or(F.col("v") == 5).over(w_i), F.lit(False)).alias("any_i"))
    cols = ["k", "seq", "sum_i", "max_e", "last_e", "first_e", "any_i"]
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in ref.select(*cols).collect())
    assert a == b


class _Value:
    """The state variables of one session, kept in memory."""

    def __init__(self):
        self.v = {}

    def exists(self):
        return bool(self.v)

    def get(self):
        return self.v.get(None)

    def update(self, v):
        self.v[None] = v

    def iterator(self):
        return iter(list(self.v.items()))

    def updateValue(self, k, v):
        self.v[k] = v

    def removeKey(self, k):
        del self.v[k]

    def clear(self):
        self.v.clear()


class _Handle:
    def getValueState(self, *_):
        return _Value()

    getMapState = getValueState


def _brute(pdf):
    """Every session through the stream's processor, in chunks of any order, in two micro-batches."""
    from shroud.streaming import gate_state
    out = []
    for sid, g in pdf.sort_values("seq").groupby("session_id"):
        p = gate_state.GateProcessor()
        p.init(_Handle())
        for batch in (g.iloc[:len(g) // 2], g.iloc[len(g) // 2:]):
            chunks = [c for c in (batch.iloc[::2].sample(frac=1.0, random_state=1), batch.iloc[1::2]) if len(c)]
            out += list(p.handleInputRows((sid,), iter(chunks), None)) if chunks else []
    return pd.concat(out)


@pytest.mark.parametrize("hot_rows", ["1000000", "30"])
def test_replay_equals_brute_force(spark, hot_rows):
    """With plain windows, and with the larger sessions in chunks."""
    from shroud.operators import detect
    from shroud.plans import session_jobs
    tl = session_jobs.timeline(spark, SF_SMALL).where(F.col("kind").isin(*session_jobs.STATE_KINDS))
    cols = ["session_id", "seq", "kind", "provider", "ceiling", "resolved", "answer_i", "can_prompt", "unattended",
            "pii_policy", "downgrade_policy"] + [f"m_{detect.col_name(t)}" for t in detect.TYPE_ORDER]
    brute = _brute(tl.select(*cols, F.col("ts").alias("at"), F.unix_millis("ts").alias("at_ms")).toPandas())
    assert tl.groupBy("session_id").count().agg(F.max("count"), F.min("count")).first()[0] > 30
    pii = brute[brute.out_kind == "pii"]
    spark.conf.set("shroud.running.hot_rows", hot_rows)
    spark.conf.set("shroud.running.span", "500")
    try:
        batch = session_jobs.pii_gate(spark, SF_SMALL).toPandas()
        dg = session_jobs.downgrade_guard(spark, SF_SMALL).toPandas()
    finally:
        spark.conf.unset("shroud.running.hot_rows")
        spark.conf.unset("shroud.running.span")
    m = batch.merge(pii, on=["session_id", "seq"], suffixes=("", "_b"))
    assert len(m) == len(batch) == len(pii)
    for c in ["action", "gated", "fresh", "prompted", "epoch"]:
        assert (m[c].astype(str) == m[c + "_b"].astype(str)).all(), c
    bd = brute[brute.out_kind == "downgrade"]
    assert sorted(zip(dg.seq, dg.decision)) == sorted(zip(bd.seq, bd.decision))


def test_hot_session_is_spread_over_tasks(spark):
    """One session holds 90% of the rows; after the chunked pass its rows sit in
    many partitions (a plain session window would put them in one task)."""
    rows = [(0 if i % 10 else 1 + i // 10, i * 10, 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, seq int, v int")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = running(df, ["k"], "seq", [("s", "sum", F.col("v"), True)], span=200, materialize=False)
        parts = r.where("k = 0").select(F.spark_partition_id().alias("p")).distinct().count()
        ok = r.where("k = 0").agg(F.max("s")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert parts >= 4
    assert ok == 1800   # the running sum still spans all of the session's chunks
