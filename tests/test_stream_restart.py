"""Streams that stop and start again with the same folder."""
from pathlib import Path

from tests.conftest import SF_SMALL
from pyspark.sql import functions as F

from shroud.streaming import jobs as SJ


def _two_parts(spark, folder, name, order):
    """The table as a first and a second half (by `order`), and the whole as one folder."""
    rows = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
    cut = rows.approxQuantile(order, [0.5], 0.0)[0]
    return rows.where(F.col(order) <= cut), rows.where(F.col(order) > cut)


def _restarted(spark, tmp_path, job, name, order):
    """The job over the first half, then started again with the same folder over both."""
    import shutil
    sf = tmp_path / "in"
    sf.mkdir()
    for other in Path(SF_SMALL).iterdir():
        if other.name != f"{name}.parquet":
            (sf / other.name).symlink_to(other)
    for k, part in enumerate(_two_parts(spark, sf, name, order)):
        part.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        source = next((tmp_path / f"part{k}").glob("part-*.parquet"))
        shutil.copy(source, sf / (f"{name}.parquet" if k == 0 else f"{name}-2.parquet"))
        out = job(spark, str(sf), str(tmp_path / "state"))
    return out


def test_a_restarted_stateless_stream_reads_new_files_only(spark, tmp_path):
    from shroud.plans import detection_jobs
    got = _restarted(spark, tmp_path, SJ.stream_redact, "documents", "doc_id").collect()
    want = detection_jobs.redact_all(spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.redacted) for r in want)


def test_a_restarted_window_stream_equals_one_run(spark, tmp_path):
    got = _restarted(spark, tmp_path, SJ.stream_session_window, "events", "event_id").collect()
    want = SJ.stream_session_window(spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
