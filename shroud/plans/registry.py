"""All registered jobs: name -> (spark builder, DuckDB SQL builder or None)."""

from __future__ import annotations

from . import allow_jobs, config_jobs, detection_jobs, egress_jobs, posture_jobs, raw_jobs, report_jobs, session_jobs, stream_jobs, surface_jobs, tool_jobs

JOBS: dict = {}
JOBS.update(detection_jobs.JOBS)
JOBS.update(allow_jobs.JOBS)
JOBS.update(egress_jobs.JOBS)
JOBS.update(surface_jobs.JOBS)
JOBS.update(posture_jobs.JOBS)
JOBS.update(session_jobs.JOBS)
JOBS.update(tool_jobs.JOBS)
JOBS.update(config_jobs.JOBS)
JOBS.update(report_jobs.JOBS)
JOBS.update(raw_jobs.JOBS)
JOBS.update(stream_jobs.JOBS)


def queries():
    return {name: spark_fn for name, (spark_fn, _) in JOBS.items()}


def oracle_sql():
    return {name: sql_fn() for name, (_, sql_fn) in JOBS.items() if sql_fn is not None}
