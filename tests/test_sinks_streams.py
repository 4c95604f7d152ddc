from collections import Counter

from tests.conftest import SF_SMALL


def test_write_clean_roundtrip(spark):
    from shroud.plans import report_jobs
    from shroud.session import checkpoint_dir
    import uuid
    out = f"{checkpoint_dir(spark)}/clean-{uuid.uuid4().hex}"
    back = report_jobs.write_clean(spark, SF_SMALL, out)
    assert set(back.columns) == {"doc_id", "lang", "redacted", "source"}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert back.count() == docs.count()
    assert back.where("redacted LIKE '%@%.%' AND redacted RLIKE '[A-Za-z0-9]@[A-Za-z]'").count() <= \
        docs.where("text RLIKE '[A-Za-z0-9]@[A-Za-z]'").count()


def test_stream_equals_batch(spark):
    from shroud.plans import detection_jobs
    from shroud.streaming import jobs as SJ
    s = Counter(tuple(r) for r in SJ.stream_redact(spark, SF_SMALL).select("doc_id", "redacted").collect())
    b = Counter(tuple(r) for r in detection_jobs.redact_all(spark, SF_SMALL).select("doc_id", "redacted").collect())
    assert s == b
    from shroud.plans import session_jobs
    g = SJ.stream_pii_gate(spark, SF_SMALL).select("session_id", "seq", "action", "prompted").collect()
    h = session_jobs.pii_gate(spark, SF_SMALL).select("session_id", "seq", "action", "prompted").collect()
    assert Counter(map(tuple, g)) == Counter(map(tuple, h))
