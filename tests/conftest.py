import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("shroud-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shroud-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


def scan_texts(spark, texts, rules=None, cap=4):
    from shroud.operators import detect
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "uid bigint, text string")
    rows = detect.with_scan(df, rules=rules, sample_cap=cap).orderBy("uid").collect()
    out = []
    for r in rows:
        out.append({"hits": {h["type"]: h["count"] for h in r["hits"]},
                    "suppressed": {h["type"]: h["count"] for h in r["suppressed"]},
                    "samples": [(s["type"], s["masked"]) for s in r["samples"]]})
    return out
