"""Streaming jobs (ST1-ST5) registered with the SQL of their batch equivalents:
a stream drained with `availableNow` must equal the batch job on the same rows
(closed windows only for watermarked aggregations)."""

from __future__ import annotations

from ..functions import seeds
from ..streaming import jobs as SJ
from . import detection_jobs, oracle as O, session_jobs, tool_jobs

Q = O.q


def stream_egress_ledger_sql():
    from .egress_jobs import url_ctes
    # the stream has no first-use gate (it is stateful); every call is assessed
    base = tool_jobs._gate_ctes().split(",\nv2 AS")[0].replace("WHERE f.fu_outcome <> 'block'", "")
    return (f"WITH {base},\n"
            "obs AS (SELECT v.*, c.ts FROM v JOIN calls c USING (session_id, seq) WHERE v.egress),\n"
            "tgt AS (SELECT session_id, seq, target AS url FROM obs WHERE target IS NOT NULL),\n"
            + url_ctes("tgt", ["session_id", "seq"], "ta") + ",\n"
            "lw AS (SELECT o.*, coalesce(t.host, " + Q(seeds.UNNAMED_HOST) + ") AS host, time_bucket(INTERVAL 1 HOUR, o.ts) AS ws "
            "FROM obs o LEFT JOIN ta t USING (session_id, seq))\n"
            "SELECT CAST(epoch(ws) AS BIGINT) AS window_start, session_id, actor AS tool, host, count(*) AS calls, "
            "count(*) FILTER (WHERE fires) AS with_pii FROM lw "
            "WHERE ws + INTERVAL 1 HOUR <= (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL")


def stream_session_window_sql():
    return ("WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_type FROM events),\n"
            "e2 AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR "
            "ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM e),\n"
            "e3 AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e2),\n"
            "s AS (SELECT user_id, min(ts) AS s0, max(ts) + INTERVAL 30 MINUTE AS s1, count(*) AS events, "
            "count(*) FILTER (WHERE event_type = 'purchase') AS model_switches FROM e3 GROUP BY user_id, sid)\n"
            "SELECT user_id, CAST(epoch_us(s0) AS BIGINT) AS session_start, CAST(epoch_us(s1) AS BIGINT) AS session_end, "
            "events, model_switches FROM s WHERE s1 <= (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 1 HOUR FROM events)")


def stream_egress_sliding_sql():
    """Every call in each of its overlapping windows; one batch, so none is late."""
    from .egress_jobs import url_ctes
    base = tool_jobs._gate_ctes().split(",\nv2 AS")[0].replace("WHERE f.fu_outcome <> 'block'", "")
    return (f"WITH {base},\n"
            "obs AS (SELECT v.*, c.ts FROM v JOIN calls c USING (session_id, seq) WHERE v.egress),\n"
            "tgt AS (SELECT session_id, seq, target AS url FROM obs WHERE target IS NOT NULL),\n"
            + url_ctes("tgt", ["session_id", "seq"], "ta") + ",\n"
            "lw AS (SELECT o.*, coalesce(t.host, " + Q(seeds.UNNAMED_HOST) + ") AS host, "
            "CAST(epoch(time_bucket(INTERVAL 15 MINUTE, o.ts)) AS BIGINT) - 900 * unnest([0, 1, 2, 3]) AS window_start "
            "FROM obs o LEFT JOIN ta t USING (session_id, seq))\n"
            "SELECT window_start, session_id, actor AS tool, host, count(*) AS calls, count(*) FILTER (WHERE fires) AS with_pii, "
            "CAST(0 AS BIGINT) AS late_calls FROM lw GROUP BY ALL")


def stream_switch_posture_sql():
    """All landed switches; the others once the lesser of both streams' watermarks has passed their range."""
    never, late = session_jobs.RESOLVE_NEVER_LANDS, session_jobs.RESOLVE_LATE
    after = f"CASE WHEN s.event_id % {late} = 1 THEN {session_jobs.LANDS_LATE_S} ELSE {session_jobs.LANDS_S} END"
    return (f"WITH {session_jobs.resolved_ctes()},\n"
            f"sw AS (SELECT r.*, CAST(s.ts AS TIMESTAMP) AS ts, s.event_id % {never} <> 0 AS landed, {after} AS after_s "
            "FROM res r JOIN sev s USING (session_id, seq)),\n"
            "mark AS (SELECT least(max(ts), max(ts + to_seconds(after_s)) FILTER (WHERE landed)) - INTERVAL 1 MINUTE AS w FROM sw)\n"
            "SELECT session_id, seq, provider, ceiling, CASE WHEN landed THEN tier END AS tier, landed, "
            "CASE WHEN landed THEN CAST(after_s * 1000 AS BIGINT) END AS landed_after_ms FROM sw, mark "
            "WHERE landed OR ts + INTERVAL 10 MINUTE < w")


def stream_multi_sink_sql():
    steps, last = detection_jobs.redact_sql_steps("fx_text", "text")
    total = "coalesce(list_sum(list_transform({}, lambda h: h.count)), 0)"
    secret = O.has_secret_sql("s.hits")
    return ("WITH " + O.scan_ctes(O.fx_text_cte(), "fx_text", ["doc_id"], sample_cap=0) + f",\n{steps}\n"
            "SELECT s.doc_id, CASE WHEN f.text = r.rtext THEN 'unchanged' ELSE 'redacted' END AS outcome, "
            f"CASE WHEN len(s.hits) = 0 THEN 'none' WHEN {secret} THEN 'secret' ELSE 'pii' END AS severity, "
            f"CASE WHEN len(s.hits) > 0 THEN {O.summary_sql('s.hits')} END AS summary, "
            f"CAST({total.format('s.hits')} AS BIGINT) AS counted, CAST({total.format('s.suppressed')} AS BIGINT) AS allowlisted, "
            f"r.rtext AS redacted FROM scan s JOIN fx_text f USING (doc_id) JOIN {last} r USING (doc_id)")


JOBS = {
    "stream_redact": (SJ.stream_redact, detection_jobs.redact_all_sql),
    "stream_egress_ledger": (SJ.stream_egress_ledger, stream_egress_ledger_sql),
    "stream_pii_gate": (SJ.stream_pii_gate, session_jobs.JOBS["pii_gate"][1]),
    "stream_downgrade": (SJ.stream_downgrade, session_jobs.JOBS["downgrade_guard"][1]),
    "stream_alerts": (SJ.stream_alerts, session_jobs.JOBS["downgrade_guard"][1]),
    "stream_switch_posture": (SJ.stream_switch_posture, stream_switch_posture_sql),
    "stream_multi_sink": (SJ.stream_multi_sink, stream_multi_sink_sql),
    "stream_egress_sliding": (SJ.stream_egress_sliding, stream_egress_sliding_sql),
    "stream_session_window": (SJ.stream_session_window, stream_session_window_sql),
}
