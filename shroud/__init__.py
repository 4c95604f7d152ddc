"""shroud: privacy governance analytics on Spark.

functions/  fixed values and pattern dialects
sources/    input tables and the inputs Spark derives from them
operators/  Column- and DataFrame-level building blocks (detection, redaction,
            allowlist, egress, surface, posture, session replay, config audit,
            skew-safe running aggregates)
plans/      the registered jobs and their DuckDB SQL twins
streaming/  Structured Streaming forms of the jobs
"""
