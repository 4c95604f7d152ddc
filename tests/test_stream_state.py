"""Streams with state over more than one source, run, stopped and started again."""
import shutil
from collections import Counter
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shroud.plans import session_jobs
from shroud.streaming import jobs as SJ
from shroud.streaming import sinks
from tests.conftest import SF_SMALL

START = datetime(2026, 3, 2, 8, 0, tzinfo=timezone.utc)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small inputs: most of the time would go into empty partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(df):
    return Counter(map(tuple, df.collect()))


def put(df, folder, name):
    """One more file of a stream's folder, placed whole."""
    part = folder.parent / f"part-{folder.name}-{name}"
    df.coalesce(1).write.parquet(str(part))
    folder.mkdir(exist_ok=True)
    shutil.copy(next(part.glob("part-*.parquet")), folder / f"{name}.parquet")


def input_folder(tmp_path, *own):
    sf = tmp_path / "in"
    sf.mkdir()
    for table in Path(SF_SMALL).iterdir():
        if table.stem not in own:
            (sf / table.name).symlink_to(table)
    return sf


def events(spark, sf, name, made):
    """made: (event id, session, type, minutes after the start)."""
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    data = spark.createDataFrame([(i, (START + timedelta(minutes=m)).replace(tzinfo=None), s, t) for i, s, t, m in made],
                                 "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string")
    put(data.select(*[(F.col(f.name) if f.name in data.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]),
        sf / "files", name)
    shutil.copy(sf / "files" / f"{name}.parquet", sf / f"{name}.parquet")


def resolutions(spark):
    return session_jobs.resolutions(spark, SF_SMALL).select(*SJ.RESOLUTION_COLS)


def test_switch_shows_its_posture_only_after_it_arrived(spark, tmp_path):
    every = resolutions(spark)
    cut = every.select(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    folder, base = tmp_path / "res", str(tmp_path / "state")
    put(every.where(F.col("ts") <= cut), folder, "a")
    first = SJ.stream_switch_posture(spark, SF_SMALL, base, str(folder)).where("landed").count()
    assert first == every.where(F.col("ts") <= cut).count()
    put(every.where(F.col("ts") > cut), folder, "b")
    both = SJ.stream_switch_posture(spark, SF_SMALL, base, str(folder))
    once = SJ.stream_switch_posture(spark, SF_SMALL)
    assert rows(both.where("landed")) == rows(once.where("landed"))
    # a switch without a resolution waits for the watermark, which needs events on both sides
    assert rows(both.where("not landed")) <= rows(once.where("not landed"))
    assert both.where("landed").count() == every.count() > first
    switches = session_jobs.switches(spark, SF_SMALL, session_jobs._events(spark, SF_SMALL))
    never = both.where("not landed").join(switches.where("resolved is null"), ["session_id", "seq"], "left_semi").count()
    assert never == both.where("not landed").count() > 0


def test_gate_uses_a_resolution_from_its_arrival_on(spark, tmp_path):
    folder, base = tmp_path / "res", str(tmp_path / "state")
    folder.mkdir()
    first = SJ.gate_stream(spark, SF_SMALL, base, str(folder)).cache()
    requests = first.where("out_kind = 'pii'")
    assert requests.count() > 0 and requests.where("tier is not null").count() == 0
    assert first.where("pass_no = 2").count() == 0
    before = first.count()
    first.unpersist()
    put(resolutions(spark), folder, "a")
    second = SJ.gate_stream(spark, SF_SMALL, base, str(folder))
    assert second.count() >= before and second.where("out_kind = 'pii'").count() == requests.count()
    # together in one micro-batch they equal the replay
    together = SJ.gate_stream(spark, SF_SMALL)
    want = session_jobs.downgrade_guard(spark, SF_SMALL)
    assert rows(together.where("out_kind = 'downgrade'").select(*SJ.DOWNGRADE_COLS)) == rows(want)


def test_resolution_that_lands_after_a_restart_raises_the_alert_then(spark, tmp_path):
    """Session 16 warns on downgrades; a local model, a request with findings, then a plain provider."""
    sf = input_folder(tmp_path, "events")
    session = 16
    local = next(i for i in range(1, 200) if i % 9 == 6)      # ollama
    request = next(i for i in range(local + 1, 400) if i % 16 == 0)  # e-mails and an SSN
    switch = next(i for i in range(request + 1, 600) if i % 9 == 1 and i % 7)  # an attested provider
    events(spark, sf, "events", [(local, session, "purchase", 0), (request, session, "view", 5), (switch, session, "purchase", 6)])
    folder, base = tmp_path / "res", str(tmp_path / "state")
    ddl = "session_id bigint, switch_seq bigint, seq bigint, ts timestamp, resolved string, can_prompt boolean, unattended boolean, answer_i bigint"
    one = lambda at, tier: spark.createDataFrame([(session, at * 10, at * 10 + 1, START, tier, True, False, 1)], ddl)
    put(one(local, "local"), folder, "a")
    first = SJ.gate_stream(spark, str(sf), base, str(folder)).where("out_kind = 'downgrade'").collect()
    put(one(switch, "standard"), folder, "b")
    second = SJ.gate_stream(spark, str(sf), base, str(folder)).where("out_kind = 'downgrade'").collect()
    assert first == []
    assert [(r["switch_seq"], r["pass_no"], r["from_tier"], r["to_tier"], r["severity"]) for r in second] == [(switch * 10, 2, "local", "standard", "pii")]


def test_replayed_files_raise_no_second_alert(spark, tmp_path):
    sf = input_folder(tmp_path, "events")
    shutil.copy(f"{SF_SMALL}/events.parquet", sf / "events.parquet")
    base = str(tmp_path / "state")
    once = rows(SJ.stream_alerts(spark, str(sf), base))
    assert once == rows(session_jobs.downgrade_guard(spark, SF_SMALL)) and once
    shutil.copy(f"{SF_SMALL}/events.parquet", sf / "events-again.parquet")
    gate = Path(base) / "gate" / "resolutions"
    shutil.copy(next(gate.glob("part-*.parquet")), gate / "part-again.parquet")
    assert rows(SJ.stream_alerts(spark, str(sf), base)) == once


def test_idle_sessions_start_anew(spark, tmp_path):
    sf = input_folder(tmp_path, "events")
    request = 32  # e-mails and an SSN
    events(spark, sf, "events", [(request, 16, "view", 0)])
    events(spark, sf, "events-2", [(request + 1, 24, "view", 600)])
    events(spark, sf, "events-3", [(request + 15, 16, "view", 601), (request + 31, 24, "view", 610)])  # nothing to find in these
    folder = tmp_path / "res"
    folder.mkdir()
    gated = {}
    for idle in (None, "2 hours"):
        out = SJ.gate_stream(spark, str(sf), str(tmp_path / f"state{idle}"), str(folder), idle=idle).where("out_kind = 'pii'")
        gated[idle] = {(r["session_id"], r["seq"]): r["gated"] for r in out.collect()}
    assert gated[None][16, (request + 15) * 10] is True      # the findings of ten hours before still count
    assert gated["2 hours"][16, (request + 15) * 10] is False
    assert gated["2 hours"][24, (request + 31) * 10] is gated[None][24, (request + 31) * 10] is True


def test_sinks_after_a_failure_between_two_of_them(spark, tmp_path):
    folder, base = tmp_path / "src", str(tmp_path / "out")
    put(spark.range(0, 100), folder, "a")
    stream = lambda: spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(folder))

    def fails(batch):
        raise RuntimeError("killed between two sinks")

    both = {"kept": lambda b: b.where("id % 2 = 0"), "squares": lambda b: b.selectExpr("id", "id * id AS square")}
    sinks.run_sinks(stream(), base, both)
    put(spark.range(100, 250), folder, "b")
    with pytest.raises(Exception, match="killed between two sinks"):
        sinks.run_sinks(stream(), base, {"kept": both["kept"], "squares": fails})
    # the first sink has the files, but the batch is in none of them yet
    assert len(list((Path(base) / "kept").iterdir())) == 2
    assert sinks.read_sink(spark, base, "kept").count() == 50 and sinks.read_sink(spark, base, "squares").count() == 100
    sinks.run_sinks(stream(), base, both)
    assert sorted(r.id for r in sinks.read_sink(spark, base, "kept").collect()) == list(range(0, 250, 2))
    assert rows(sinks.read_sink(spark, base, "squares")) == Counter((i, i * i) for i in range(250))


def test_multi_sink_equals_the_batch_jobs(spark, tmp_path):
    from shroud.plans import detection_jobs
    base = str(tmp_path / "out")
    out = SJ.stream_multi_sink(spark, SF_SMALL, base)
    assert rows(out.select("doc_id", "redacted")) == rows(detection_jobs.redact_all(spark, SF_SMALL).select("doc_id", "redacted"))
    found = sinks.read_sink(spark, base, "findings")
    assert rows(found.where("counted").select("doc_id", "type", "count")) == rows(detection_jobs.pii_hits(spark, SF_SMALL).select("doc_id", "type", "hits"))
    assert rows(SJ.stream_multi_sink(spark, SF_SMALL, base)) == rows(out)  # nothing new: nothing twice


def test_sliding_ledger_counts_late_calls(spark, tmp_path):
    folder, base = tmp_path / "src", str(tmp_path / "out")
    ddl = "minute int, session_id bigint, tool string, host string, fires boolean"
    made = {"a": [(0, 1), (20, 1), (59, 1)], "b": [(61, 1), (200, 1)], "c": [(30, 1), (130, 1), (199, 1)], "d": [(210, 2)]}
    every = []
    for name, calls in made.items():
        df = spark.createDataFrame([(m, s, "bash", "h.example", m % 2 == 0) for m, s in calls], ddl)
        df = df.select(F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("minute") * 60).alias("ts"), "session_id", "tool", "host", "fires")
        every += calls
        put(df, folder, name)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        SJ.sliding_ledger(stream, base)  # stopped and started again for every file
    got = {(r["window_start"], r["session_id"]): (r["calls"], r["late_calls"]) for r in SJ.read_ledger(spark, base).collect()}
    total, late = Counter(), Counter()
    seen = None
    for calls in made.values():
        for m, s in calls:
            for w in range(m // 15 * 15 - 45, m // 15 * 15 + 1, 15):
                key = (int(START.timestamp()) + w * 60, s)
                total[key] += 1
                late[key] += seen is not None and w + 60 <= seen - 10
        seen = max([seen or 0, *(m for m, _ in calls)])
    assert {k: sum(v) for k, v in got.items()} == dict(total)
    assert {k: v[1] for k, v in got.items() if v[1]} == {k: n for k, n in late.items() if n} and sum(late.values()) > 4
