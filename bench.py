"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each job is executed in full through the `noop` sink (every row computed, none
collected). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shroud.plans import registry  # noqa: E402
from shroud.session import get_spark  # noqa: E402

HEADLINE = [
    "pii_profile", "pii_findings", "redact_all", "pii_detail", "allow_split",
    "egress_calls", "egress_ledger", "surface_report", "posture_resolution", "model_ranking",
    "pii_gate", "downgrade_guard", "ingest_gate", "config_effective", "session_summary", "stream_pii_gate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark()
    qs = registry.queries()
    names = [n for n in HEADLINE if n in qs]
    # warm-up: JVM, codegen and file listing
    qs[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, failed = {}, []
    for n in names:
        t0 = time.time()
        try:
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - report, keep measuring the rest
            failed.append(n)
            print(f"{n} failed: {str(e)[:300]}", file=sys.stderr)
            continue
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_job_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
