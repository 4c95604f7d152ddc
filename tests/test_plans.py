"""Plan-shape checks for the scale properties the design relies on."""
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_detection_is_narrow_and_pruned(spark):
    from shroud.operators import detect
    from shroud.sources.tables import documents
    df = detect.with_scan(documents(spark, SF_SMALL).select("doc_id", "text"), sample_cap=0).select("doc_id", "hits")
    p = _plan(df)
    assert "Join" not in p and "Exchange hashpartitioning" not in p
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_running_windows_partition_by_chunk(spark):
    from shroud.operators.running import running
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 10).alias("seq"), F.col("id").alias("v"))
    r = running(df, ["k"], "seq", [("s", "sum", F.col("v"), True)], span=100, materialize=False)
    p = _plan(r)
    assert "Window" in p
    # every row-level window is partitioned by (key, chunk), never by the key alone
    assert "_ch" in p.split("Window")[1].split("\n")[0]


def test_rule_joins_are_equi_joins(spark):
    from shroud.plans import allow_jobs, egress_jobs
    for job in (allow_jobs.allow_glob, allow_jobs.allow_domain, allow_jobs.allow_cidr, allow_jobs.allow_split, egress_jobs.egress_calls):
        assert "NestedLoop" not in _plan(job(spark, SF_SMALL))


def test_gzip_udf_only_sees_filtered_rows(spark):
    from shroud.plans import posture_jobs
    p = _plan(posture_jobs.attest_key_grade(spark, SF_SMALL))
    assert "ArrowEvalPython" in p
    below = p.split("ArrowEvalPython")[1]
    assert "Filter" in below.split("Scan")[0]
