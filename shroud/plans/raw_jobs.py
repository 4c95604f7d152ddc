"""Jobs over logs as they come: request membership (W1), raw JSON payloads
and settings files (C1-C3), with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import config_audit as C
from ..operators import context as CX
from ..operators import raw_payload as RP
from ..session import checkpoint_dir
from ..sources import fixtures, raw_logs
from . import config_jobs, oracle as O
from .detection_jobs import redact_sql_steps

COMPACT_EVERY = 8  # turns; a request carries the turns since the last compaction and a summary of those before
SHAPES = 8


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


# W1 -------------------------------------------------------------------------
def request_members(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(members: conv_id, turn, digest; messages: digest, text). The request at a turn sends the turns
    since the conversation was last compacted, after a summary of what came before."""
    turns = fixtures.fx_turn(spark, sf).select("conv_id", "turn", "text").withColumn("digest", CX.digest(F.col("text")))
    block = F.col("turn") - F.col("turn") % COMPACT_EVERY
    requests = turns.select("conv_id", "turn").distinct()
    sent = turns.select("conv_id", "digest", F.explode(F.sequence(F.col("turn"), block + COMPACT_EVERY - 1)).alias("turn"))
    sent = sent.join(requests, ["conv_id", "turn"], "left_semi")
    summary = F.concat(block.cast("string"), F.lit(" earlier messages, the last from 192.168.7."), (F.col("conv_id") % 200).cast("string"))
    summaries = requests.where(block > 0).select("conv_id", "turn", summary.alias("text")).withColumn("digest", CX.digest(F.col("text")))
    members = sent.select("conv_id", "turn", "digest").unionByName(summaries.drop("text"))
    return members, turns.select("digest", "text").unionByName(summaries.select("digest", "text"))


def request_context(spark, sf):
    """The hits each request carries, with every distinct message scanned once."""
    members, messages = request_members(spark, sf)
    return CX.request_hits(members, CX.scanned_messages(messages), ["conv_id", "turn"])


def request_context_sql():
    n = COMPACT_EVERY
    return ("WITH " + O.fx_turn_cte() + ",\nrq AS (SELECT DISTINCT conv_id, turn FROM fx_turn),\n"
            "tx AS (SELECT r.conv_id, r.turn, t.text FROM rq r JOIN fx_turn t ON t.conv_id = r.conv_id AND t.turn <= r.turn "
            f"AND t.turn >= r.turn - r.turn % {n} UNION ALL SELECT conv_id, turn, CAST(turn - turn % {n} AS VARCHAR) || "
            f"' earlier messages, the last from 192.168.7.' || CAST(conv_id % 200 AS VARCHAR) FROM rq WHERE turn >= {n}),\n"
            + O.scan_ctes("src AS (SELECT conv_id, turn, row_number() OVER () AS k, text FROM tx)", "src", ["conv_id", "turn", "k"], sample_cap=0)
            + "\nSELECT conv_id, turn, h.type AS type, CAST(sum(h.count) AS BIGINT) AS hits FROM "
            "(SELECT conv_id, turn, unnest(hits) AS h FROM scan) GROUP BY ALL")


# S1 / D10 over raw lines ------------------------------------------------------
def raw_lines(spark, sf) -> DataFrame:
    """One JSON line a turn, in eight shapes: string content, parts, bare strings, no messages, a line
    cut short, a string payload, content of another shape, no object at all."""
    t = fixtures.fx_turn(spark, sf)
    conv, turn, text, role = (F.col(c) for c in ("conv_id", "turn", "text", "role"))
    j = lambda *cols: F.to_json(F.struct(*cols))
    image = F.struct(F.concat(F.lit("img-"), turn.cast("string")).alias("data"), F.lit("image").alias("type"))
    message = lambda content: F.concat(F.lit('{"content":'), content, F.lit(',"role":'), _quoted(role), F.lit("}"))
    one = lambda content: F.concat(F.lit('{"messages":['), message(content), F.lit("]}"))
    parts = F.concat(F.lit("["), j(text.alias("text"), F.lit("text").alias("type")), F.lit(","), F.to_json(image), F.lit("]"))
    bare = F.concat(F.lit("["), _quoted(text), F.lit("]"))
    shapes = [one(_quoted(text)), one(parts), one(bare), j(text.alias("prompt")), one(_quoted(text)), _quoted(text), one(j(text.alias("blocks"))), None]
    k = (conv + turn) % SHAPES
    payload = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        if shape is not None:
            payload = F.when(k == i, shape).otherwise(payload)
    line = F.concat(F.lit('{"conv":'), conv.cast("string"), F.lit(',"payload":'), payload, F.lit(',"turn":'), turn.cast("string"), F.lit("}"))
    whole = F.concat(F.lit("["), conv.cast("string"), F.lit(","), turn.cast("string"), F.lit("]"))
    return t.select(F.when(k == 4, F.substring(line, F.lit(1), F.length(line) - 3)).when(k == 7, whole).otherwise(line).alias("value"))


def _quoted(text):
    """A JSON string."""
    j = F.to_json(F.array(text))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def _walked(spark, sf):
    folder = _folder(spark, "raw-lines")
    raw_lines(spark, sf).write.text(folder)
    w = RP.walked(raw_logs.read_json_lines(spark, folder))
    return w.select("*", F.try_variant_get("v", "$.conv", "bigint").alias("conv_id"), F.try_variant_get("v", "$.turn", "bigint").alias("turn"))


def raw_scan_units(spark, sf):
    """S1 over raw JSON lines: every text detection sees, bad lines too."""
    return RP.scan_texts(_walked(spark, sf), ["conv_id", "turn"])


def redact_raw_payload(spark, sf):
    """D10 over raw JSON lines: the payload as JSON text with an outcome per line."""
    return RP.redacted(_walked(spark, sf)).select("conv_id", "turn", "outcome", "body")


def _raw_ctes():
    """`raw`: per turn its shape k, role, text and the pieces of its line."""
    def q(x):
        return f"CAST(to_json({x}) AS VARCHAR)"
    image = "'{\"data\":\"img-' || CAST(turn AS VARCHAR) || '\",\"type\":\"image\"}'"

    def payload(text):
        message = "'{{\"messages\":[{{\"content\":' || {} || ',\"role\":' || " + q("role") + " || '}}]}}'"
        cases = [message.format(q(text)), message.format(f"'[{{\"text\":' || {q(text)} || ',\"type\":\"text\"}},' || {image} || ']'"),
                 message.format(f"'[' || {q(text)} || ']'"), f"'{{\"prompt\":' || {q(text)} || '}}'", message.format(q(text)), q(text),
                 message.format(f"'{{\"blocks\":' || {q(text)} || '}}'")]
        return "CASE k " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"
    line = ("'{\"conv\":' || CAST(conv_id AS VARCHAR) || ',\"payload\":' || payload || ',\"turn\":' || CAST(turn AS VARCHAR) || '}'")
    return payload, image, line


def raw_scan_units_sql():
    payload, image, line = _raw_ctes()
    return (f"WITH {O.fx_turn_cte()},\nraw0 AS (SELECT *, (conv_id + turn) % {SHAPES} AS k FROM fx_turn),\n"
            f"raw AS (SELECT *, {payload('text')} AS payload FROM raw0),\nlines AS (SELECT *, {line} AS line FROM raw)\n"
            "SELECT CASE WHEN k NOT IN (4, 7) THEN conv_id END AS conv_id, CASE WHEN k NOT IN (4, 7) THEN turn END AS turn, CAST(0 AS INTEGER) AS part_no, "
            f"CASE k WHEN 1 THEN text || chr(10) || {image} WHEN 3 THEN payload WHEN 4 THEN substr(line, 1, length(line) - 3) "
            "WHEN 6 THEN '{\"blocks\":' || CAST(to_json(text) AS VARCHAR) || '}' "
            "WHEN 7 THEN '[' || CAST(conv_id AS VARCHAR) || ',' || CAST(turn AS VARCHAR) || ']' ELSE text END AS text FROM lines")


def redact_raw_payload_sql():
    payload, image, line = _raw_ctes()
    steps, last = redact_sql_steps("src", "text")
    seen = "CASE WHEN k IN (2, 5) THEN text WHEN k = 6 THEN '{\"blocks\":' || CAST(to_json(text) AS VARCHAR) || '}' ELSE rtext END"
    src = f"src AS (SELECT *, row_number() OVER () AS n, (conv_id + turn) % {SHAPES} AS k FROM fx_turn)"
    scan = O.scan_ctes(f"seen AS (SELECT n, {seen} AS text FROM {last})", "seen", ["n"], sample_cap=0)
    return (f"WITH {O.fx_turn_cte()},\n{src},\n{steps},\n{scan},\n"
            f"lines AS (SELECT *, {line} AS line FROM (SELECT *, {payload('text')} AS payload FROM {last})),\n"
            f"outs AS (SELECT n, {payload('rtext')} AS redacted FROM {last})\n"
            "SELECT CASE WHEN k NOT IN (4, 7) THEN conv_id END AS conv_id, CASE WHEN k NOT IN (4, 7) THEN turn END AS turn, "
            "CASE WHEN k = 4 THEN 'bad-record' WHEN k = 7 THEN 'no-payload' WHEN k IN (3, 5) THEN 'unknown-shape' "
            "WHEN len(s.hits) > 0 THEN 'could-not-redact' WHEN k IN (2, 6) OR text = rtext THEN 'unchanged' ELSE 'redacted' END AS outcome, "
            "CASE WHEN k = 4 THEN substr(line, 1, length(line) - 3) WHEN k = 7 THEN '[' || CAST(conv_id AS VARCHAR) || ',' || CAST(turn AS VARCHAR) || ']' "
            "WHEN k IN (0, 1) THEN redacted ELSE payload END AS body FROM lines JOIN outs USING (n) JOIN scan s USING (n)")


# C1-C3 from files -------------------------------------------------------------
def settings_files(spark, sf) -> str:
    """The fleet's settings as files, a folder per layer; returns the folder."""
    folder = _folder(spark, "settings")
    line = F.concat(F.lit('{"host":'), F.col("host").cast("string"), F.lit(',"settings":{'), _quoted(F.col("key")), F.lit(":"), F.col("value_json"), F.lit("}}"))
    rows = fixtures.config_settings(spark, sf)
    for layer, source in raw_logs.LAYERS.items():
        rows.where(F.col("source") == source).select(line.alias("value")).write.text(f"{folder}/{layer}/batch-1")
    return folder


def config_from_files(spark, sf):
    """C3 from settings files: the layer is read off each file's path."""
    settings, _ = raw_logs.read_settings(spark, f"{settings_files(spark, sf)}/*/*")
    return C.effective(C.validate(settings))


JOBS = {
    "request_context": (request_context, request_context_sql),
    "raw_scan_units": (raw_scan_units, raw_scan_units_sql),
    "redact_raw_payload": (redact_raw_payload, redact_raw_payload_sql),
    "config_from_files": (config_from_files, config_jobs.JOBS["config_effective"][1]),
}
