"""Structured Streaming forms of the jobs (ST1-ST5).

Event times are UTC instants and window bounds are reported as epoch values,
so results do not depend on the session time zone.

Sources are file streams over the input tables; every query runs with the
`availableNow` trigger. `base` names a folder on shared storage for its sink
(`out`) and `checkpoint`: a query started again with the same folder resumes
where it stopped and reads new files only. Without one a fresh folder under the
cluster's checkpoint folder is taken. Each job returns the sink read back as a
batch DataFrame, which equals the batch job on the same rows (windows: closed
windows only).
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, redact
from ..operators import session as S
from ..operators import tool_gates as TG
from ..plans import session_jobs
from ..session import checkpoint_dir
from ..sources import fixtures
from . import gate_state, sinks

LEDGER_WINDOW = "1 hour"
LEDGER_DELAY = "10 minutes"
SESSION_GAP = "30 minutes"
SESSION_DELAY = "1 hour"


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1_000) -> DataFrame:
    """A file stream over one input table (a directory, or the table's file glob). Up to `max_files`
    new files make a micro-batch, so that they are read side by side."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(f"{sf_dir.rstrip('/')}/{name}*.parquet"))


def run_available_now(df: DataFrame, name: str, base: str | None = None, mode: str = "append") -> DataFrame:
    """Drain the stream into a parquet sink under `base`."""
    spark = df.sparkSession
    base = base or f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def stream_redact(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """ST1: stateless scan + redaction of an incoming text stream."""
    docs = stream_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    fx = fixtures.fx_text(spark, sf_dir, docs)
    return run_available_now(redact.with_redacted(fx).select("doc_id", "redacted"), "stream_redact", base)


def stream_egress_ledger(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """ST2: rolling ledger per (hour, session, actor, host): calls and calls that
    carried PII/credentials. Late rows beyond the watermark are dropped."""
    ev = stream_table(spark, sf_dir, "events").withColumn("ts", fixtures.utc_instant("ts")) \
        .withWatermark("ts", LEDGER_DELAY)
    calls = fixtures.tool_calls(spark, sf_dir, ev)
    v = TG.verdict(calls.withColumn("origin", F.col("origin")))
    obs = v.where(F.col("a.egress")).withColumn("host", TG.ledger_host(F.col("a.target")))
    agg = (obs.groupBy(F.window("ts", LEDGER_WINDOW).alias("w"), "session_id", F.col("actor").alias("tool"), "host")
           .agg(F.count(F.lit(1)).alias("calls"), F.count_if("fires").alias("with_pii")))
    out = agg.select(F.unix_seconds("w.start").alias("window_start"), "session_id", "tool", "host", "calls", "with_pii")
    return run_available_now(out, "stream_egress_ledger", base)


STATE_STORE = "spark.sql.streaming.stateStore"
ROCKSDB = {
    f"{STATE_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a commit writes its changes only, and no store reserves disk for logs ahead: a query holds one or two stores a partition
    f"{STATE_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{STATE_STORE}.rocksdb.allowFAllocate": "false",
}


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that typed state and timers need, for the queries started inside. Options that
    the session sets itself stay."""
    before = {key: spark.conf.get(key, None) for key in ROCKSDB}
    for key, value in ROCKSDB.items():
        if key.endswith("providerClass") or before[key] is None:
            spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


RESOLUTION_COLS = ["session_id", "switch_seq", "seq", "ts", "resolved", "can_prompt", "unattended", "answer_i"]


def resolution_folder(spark: SparkSession, sf_dir: str, base: str) -> str:
    """The resolution log of the input's switches as a folder of its own under `base`; a restarted
    query finds it there."""
    folder = f"{base}/resolutions"
    session_jobs.resolutions(spark, sf_dir).select(*RESOLUTION_COLS).write.mode("ignore").parquet(folder)
    return folder


def resolution_stream(spark: SparkSession, folder: str) -> DataFrame:
    ddl = ("session_id bigint, switch_seq bigint, seq bigint, ts timestamp, resolved string, can_prompt boolean, unattended boolean, "
           "answer_i bigint")
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 10_000).parquet(folder)


def new_base(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def gate_stream(spark: SparkSession, sf_dir: str, base: str | None = None, resolutions: str | None = None,
                idle: str | None = None, delay: str = "0 seconds", replay_within: str | None = None) -> DataFrame:
    """ST3/ST4: per-session state over two streams, session events and posture
    resolutions; a resolution takes part from the micro-batch on in which its own
    event arrived. With `idle`, a session is dropped after so long without events
    (event time, `delay` behind the latest). With `replay_within`, an event that
    comes again within that span of event time is left out."""
    base = base or new_base(spark, "stream_gate")
    folder = resolutions or resolution_folder(spark, sf_dir, base)
    ev = stream_table(spark, sf_dir, "events").withColumn("ts", fixtures.utc_instant("ts"))
    tl = session_jobs.timeline(spark, sf_dir, ev, landed=False, scan=False).where(F.col("kind").isin("payload", "model_select"))
    tl = session_jobs.message_hits(spark, tl)
    landed = resolution_stream(spark, folder)
    landed = landed.select("*", F.lit("tier_resolved").alias("kind"), *S.policies(F.col("session_id"))).drop("switch_seq")
    tl = tl.unionByName(landed, allowMissingColumns=True)
    tl = tl.withColumn("at", F.col("ts"))
    if idle or replay_within:
        tl = tl.withWatermark("at", replay_within or delay)
    if replay_within:
        tl = tl.dropDuplicatesWithinWatermark(["session_id", "seq"])
    with rocksdb(spark):
        idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
        # by event time, rows behind the watermark are left out, which needs its column
        steps = tl.select("session_id", *(["at"] if idle else []), gate_state.packed_step())
        out = steps.groupBy("session_id").transformWithState(
            gate_state.GateRowProcessor(idle_ms), "decisions string", "append", "EventTime" if idle else "None")
        return run_available_now(gate_state.unpacked(out), "stream_gate", base)


def stream_pii_gate(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """ST3: live baseline, last action and latch per session."""
    g = gate_stream(spark, sf_dir, base)
    return g.where("out_kind = 'pii'").select("session_id", "seq", "epoch", "tier", "gated", "fresh", "prompted", "action")


DOWNGRADE_COLS = ["session_id", "seq", "pass_no", "from_tier", "to_tier", "severity", "decision"]


def stream_downgrade(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """ST4: context hits and previous tier per session; one alert per transition."""
    return gate_stream(spark, sf_dir, base).where("out_kind = 'downgrade'").select(*DOWNGRADE_COLS)


REPLAY_WITHIN = "7 days"


def stream_alerts(spark: SparkSession, sf_dir: str, base: str | None = None, within: str = REPLAY_WITHIN) -> DataFrame:
    """ST4, delivered once: the guard's alerts, one for a (session, switch), also when
    input files or alert files are replayed. Events and alerts already seen are
    remembered for the span `within` behind the latest one, so state stays bounded."""
    base = base or new_base(spark, "stream_alerts")
    gate_stream(spark, sf_dir, f"{base}/gate", replay_within=within)
    schema = spark.read.parquet(f"{base}/gate/out").schema
    alerts = spark.readStream.schema(schema).parquet(f"{base}/gate/out").where("out_kind = 'downgrade'")
    once = alerts.withWatermark("at", within).dropDuplicatesWithinWatermark(["session_id", "switch_seq"])
    return run_available_now(once.select(*DOWNGRADE_COLS), "stream_alerts", f"{base}/alerts")


LANDS_WITHIN = "10 minutes"
JOIN_DELAY = "1 minute"


def stream_switch_posture(spark: SparkSession, sf_dir: str, base: str | None = None, resolutions: str | None = None) -> DataFrame:
    """S3: every model switch with the posture that resolved for it within ten
    minutes. Two streams joined on (session, switch) and a time range; a switch
    whose resolution never lands comes out once the watermark has passed its
    range, with `landed` false."""
    base = base or new_base(spark, "stream_switch_posture")
    folder = resolutions or resolution_folder(spark, sf_dir, base)
    ev = stream_table(spark, sf_dir, "events").withColumn("ts", fixtures.utc_instant("ts"))
    ms = session_jobs.switches(spark, sf_dir, session_jobs._events(spark, sf_dir, ev))
    ms = ms.select("session_id", "seq", "ts", "provider", "ceiling").withWatermark("ts", JOIN_DELAY).alias("s")
    landed = (resolution_stream(spark, folder).select("session_id", "switch_seq", F.col("ts").alias("landed_at"), F.col("resolved").alias("tier"))
              .withWatermark("landed_at", JOIN_DELAY).alias("r"))
    joined = ms.join(landed, F.expr("s.session_id = r.session_id AND s.seq = r.switch_seq AND landed_at >= ts "
                                    f"AND landed_at <= ts + INTERVAL {LANDS_WITHIN}"), "left_outer")
    out = joined.select("s.session_id", "s.seq", "provider", "ceiling", "tier", F.col("landed_at").isNotNull().alias("landed"),
                        (F.unix_millis("landed_at") - F.unix_millis("ts")).alias("landed_after_ms"))
    return run_available_now(out, "stream_switch_posture", base)


def stream_multi_sink(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """One pass over incoming texts into three sinks: the clean text, the
    findings per type and the decision (unchanged / redacted, its severity and
    summary). Returns the three put together, a row per text."""
    base = base or new_base(spark, "stream_multi_sink")
    docs = stream_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    fx = redact.with_redacted(detect.with_scan(fixtures.fx_text(spark, sf_dir, docs), sample_cap=0))
    hits = F.col("hits")
    severity = F.when(F.size(hits) == 0, "none").when(detect.has_secret(hits), "secret").otherwise("pii")
    outcome = F.when(F.col("text") == F.col("redacted"), "unchanged").otherwise("redacted")
    once = fx.select("doc_id", "source", "lang", "redacted", "hits", "suppressed", outcome.alias("outcome"), severity.alias("severity"),
                     F.when(F.size(hits) > 0, detect.summary(hits)).alias("summary"))
    sinks.run_sinks(once, base, {
        "clean": lambda b: b.select("doc_id", "source", "lang", "redacted"),
        "findings": lambda b: b.select("doc_id", F.inline(F.concat(
            F.transform("hits", lambda h: F.struct(h["type"].alias("type"), h["count"].alias("count"), F.lit(True).alias("counted"))),
            F.transform("suppressed", lambda h: F.struct(h["type"].alias("type"), h["count"].alias("count"), F.lit(False).alias("counted")))))),
        "decisions": lambda b: b.select("doc_id", "outcome", "severity", "summary")})
    clean, findings, decisions = (sinks.read_sink(spark, base, name) for name in ("clean", "findings", "decisions"))
    found = findings.groupBy("doc_id").agg(F.sum(F.when(F.col("counted"), F.col("count")).otherwise(0)).alias("counted"),
                                           F.sum(F.when(~F.col("counted"), F.col("count")).otherwise(0)).alias("allowlisted"))
    return (clean.join(decisions, "doc_id").join(found, "doc_id", "left")
            .select("doc_id", "outcome", "severity", "summary", F.coalesce("counted", F.lit(0)).alias("counted"),
                    F.coalesce("allowlisted", F.lit(0)).alias("allowlisted"), "redacted"))


SLIDE = "15 minutes"


def sliding_ledger(calls: DataFrame, base: str, window: str = LEDGER_WINDOW, slide: str = SLIDE, delay: str = LEDGER_DELAY) -> None:
    """ST2 over overlapping windows, late rows counted. `calls` (a stream) has ts,
    session_id, tool, host, fires. A call belongs to every window over its time; a
    window is closed once the watermark (`delay` behind the latest time of the
    micro-batches before) has reached its end. What falls into an open window goes
    to the sink `on_time`, what falls into a closed one to `late`, both as partial
    sums per micro-batch: readers add them up."""
    seconds = int(pd.Timedelta(delay).total_seconds())

    def split(batch: DataFrame, seen_until) -> DataFrame:
        late = F.lit(False) if seen_until is None else (
            F.col("w.end") <= F.timestamp_micros(F.lit(seen_until)) - F.expr(f"INTERVAL {seconds} SECONDS"))
        return (batch.select("*", F.window("ts", window, slide).alias("w")).withColumn("late", late)
                .groupBy(F.unix_seconds("w.start").alias("window_start"), "session_id", "tool", "host", "late")
                .agg(F.count(F.lit(1)).alias("calls"), F.count_if("fires").alias("with_pii")))

    sinks.run_sinks(calls, base, {"on_time": lambda b: b.where(~F.col("late")).drop("late"), "late": lambda b: b.where("late").drop("late")},
                    prepare=split, high_water=F.max(F.unix_micros("ts")))


def read_ledger(spark: SparkSession, base: str) -> DataFrame:
    """Per window, session, tool and host: calls on time and late."""
    keys = ["window_start", "session_id", "tool", "host"]
    on_time = sinks.read_sink(spark, base, "on_time").select(*keys, "calls", "with_pii", F.lit(0).alias("late_calls"))
    late = sinks.read_sink(spark, base, "late").select(*keys, F.lit(0).alias("calls"), F.lit(0).alias("with_pii"), F.col("calls").alias("late_calls"))
    return on_time.unionByName(late).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("calls", "with_pii", "late_calls")])


def stream_egress_sliding(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """ST2: the rolling ledger over one-hour windows every quarter of an hour, with
    the calls that came after their window had closed."""
    base = base or new_base(spark, "stream_egress_sliding")
    ev = stream_table(spark, sf_dir, "events").withColumn("ts", fixtures.utc_instant("ts"))
    v = TG.verdict(fixtures.tool_calls(spark, sf_dir, ev))
    calls = v.where(F.col("a.egress")).select("ts", "session_id", F.col("actor").alias("tool"), TG.ledger_host(F.col("a.target")).alias("host"), "fires")
    sliding_ledger(calls, base)
    return read_ledger(spark, base)


def stream_session_window(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """ST5: sessions without an explicit id: activity bursts per user separated by
    a 30-minute gap; closed sessions only."""
    ev = stream_table(spark, sf_dir, "events").withColumn("ts", fixtures.utc_instant("ts")) \
        .withWatermark("ts", SESSION_DELAY)
    agg = (ev.groupBy(F.session_window("ts", SESSION_GAP).alias("s"), "user_id")
           .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "purchase").alias("model_switches")))
    out = agg.select("user_id", F.unix_micros("s.start").alias("session_start"), F.unix_micros("s.end").alias("session_end"),
                     "events", "model_switches")
    return run_available_now(out, "stream_session_window", base)
