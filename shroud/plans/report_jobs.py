"""Session summary (W11), request pins (P9), payload redaction (D10) and the
source/sink jobs (S1, S3, S5), with SQL twins where the output is relational."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import payload as PL
from ..operators import redact
from ..operators import surface as S
from ..operators import tool_gates as TG
from ..session import cut_lineage
from ..operators.running import by_heat
from ..sources import fixtures
from ..sources.seedframes import broadcast_seed
from ..sources.tables import documents, ensure_parallel
from . import oracle as O, session_jobs, surface_jobs, tool_jobs
from .egress_jobs import session_events_cte

Q = O.q


# W11 ------------------------------------------------------------------------
def _replay_agg(spark, sf):
    r = session_jobs.replay(spark, sf)
    return r.groupBy("session_id").agg(
        F.max_by("tier_now", "seq").alias("final_tier"), F.count_if(F.col("kind") == "payload").alias("payloads"),
        F.count_if(F.coalesce("prompted", F.lit(False))).alias("pii_prompts"),
        F.count_if(F.col("action") == "redact").alias("pii_redacted"),
        F.count_if(F.col("dg_pass").isNotNull()).alias("downgrades"))


def session_summary(spark, sf):
    """One row per session: final tier, PII gate, downgrades, tools not
    supplied by the user, first-use and egress decisions, observed egress hosts
    and blocks, credentials redacted at ingest. Each part is a per-session
    aggregate; the parts join on session. Three checkpoints, none with text: the
    scanned timeline, the calls' verdicts, the results' findings."""
    sessions = fixtures.session_events(spark, sf).select("session_id").distinct()
    rep = _replay_agg(spark, sf)
    entries = surface_jobs.entries(spark, sf)
    surf = S.summary(entries).select("session_id", "not_yours")
    verdicts = tool_jobs._verdicts(tool_jobs._first_use(spark, sf, entries))
    first = verdicts.groupBy("session_id").agg(F.count_if("fu_applies").alias("first_use_asked"),
                                               F.count_if(F.col("fu_outcome") == "block").alias("first_use_blocked"))
    gate = TG.egress_gate(verdicts.where("fu_outcome <> 'block'"))
    decided = gate.where("fires").groupBy("session_id").agg(F.count(F.lit(1)).alias("egress_flagged"),
                                                           F.count_if(F.col("decision") == "block").alias("egress_stopped"))
    led = TG.ledger(gate).groupBy("session_id").agg(
        F.count_distinct("host").alias("egress_hosts"), F.sum("blocked").cast("bigint").alias("egress_blocked"))
    ing = tool_jobs.ingest_gate(spark, sf).groupBy("session_id").agg(
        F.count_if(F.col("outcome") == "redacted").alias("secrets_redacted"))
    j = sessions
    for part in (rep, surf, first, decided, led, ing):
        j = j.join(part, "session_id", "left")
    return j.select("session_id", "final_tier", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in SUMMARY_COUNTS])


SUMMARY_COUNTS = ["payloads", "pii_prompts", "pii_redacted", "downgrades", "not_yours", "first_use_asked", "first_use_blocked",
                  "egress_flagged", "egress_stopped", "egress_hosts", "egress_blocked", "secrets_redacted"]


def session_summary_sql():
    rep = session_jobs._w("SELECT session_id, arg_max_null(tier_now, seq) AS final_tier, count(*) FILTER (WHERE kind = 'payload') "
                          "AS payloads, count(*) FILTER (WHERE prompted) AS pii_prompts, count(*) FILTER (WHERE action = 'redact') "
                          "AS pii_redacted, count(*) FILTER (WHERE dg_pass IS NOT NULL) AS downgrades FROM rp GROUP BY session_id")
    surf = f"WITH {surface_jobs.classified_ctes()}\n{surface_jobs.summary_select()}"
    first = (f"WITH {tool_jobs._fu_ctes()}\nSELECT session_id, count(*) FILTER (WHERE fu_applies) AS first_use_asked, "
             "count(*) FILTER (WHERE fu_outcome = 'block') AS first_use_blocked FROM fu4 GROUP BY session_id")
    decided = (f"WITH {tool_jobs._gate_ctes()}\nSELECT session_id, count(*) AS egress_flagged, "
               "count(*) FILTER (WHERE decision = 'block') AS egress_stopped FROM gate WHERE fires GROUP BY session_id")
    led = tool_jobs._ledger_ctes()
    led = f"WITH {led}\nSELECT session_id, count(DISTINCT host) AS egress_hosts, sum(blocked) AS egress_blocked FROM led GROUP BY session_id"
    ing = f"SELECT session_id, count(*) FILTER (WHERE outcome = 'redacted') AS secrets_redacted FROM ({tool_jobs.ingest_gate_sql()}) GROUP BY session_id"
    parts = "".join(f" LEFT JOIN ({part}) p{i} USING (session_id)" for i, part in enumerate((rep, surf, first, decided, led, ing)))
    return ("SELECT s.session_id, final_tier, " + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in SUMMARY_COUNTS) +
            " FROM (SELECT DISTINCT user_id AS session_id FROM events) s" + parts)


# P9 -------------------------------------------------------------------------
def request_pins(spark, sf):
    """Each outbound request with the pin its provider requires and the
    normalized body (existing fields kept, pin appended)."""
    ev = fixtures.session_events(spark, sf)
    tpl = broadcast_seed(spark, fixtures.provider_rows(), fixtures.PROVIDER_COLS)
    ev = ev.join(tpl, (ev.provider_i == tpl.i) & (ev.kind == "model_select"), "left")
    r = by_heat(ev, "session_id", lambda rows, run: run(rows, ["session_id"], "seq", [
        ("cur_provider", "last", F.col("provider"), True), ("cur_model", "last", F.col("model_id"), True)], materialize=False))
    snip = broadcast_seed(spark, fixtures.snippet_rows(), fixtures.SNIPPET_COLS)
    p = r.where("kind = 'payload'").join(snip.withColumnRenamed("i", "si"), F.col("snippet_i") == F.col("si"))
    zdr = F.col("session_id") % 3 == 0
    # Bodies as the client made them: some already hold the nested object, with fields of their
    # own and one that the pin overrules.
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("s").alias("content")))
    k = F.col("event_id") % 3
    own_venice = F.when((F.col("cur_provider") == "venice") & (k > 0), F.struct(
        F.lit("v1").alias("character"), F.when(k == 2, True).alias("include_venice_system_prompt")))
    own_router = F.when((F.col("cur_provider") == "openrouter") & (k > 0), F.struct(
        F.lit("price").alias("sort"), F.when(k == 2, "allow").alias("data_collection")))
    raw = F.to_json(F.struct(F.col("cur_model").alias("model"), msgs.alias("messages"), own_venice.alias("venice_parameters"), own_router.alias("provider")))
    sent = p.select("session_id", "seq", F.col("cur_provider").alias("provider"), zdr.alias("zdr"), raw.alias("raw"))
    pins = pin_bodies(sent)
    return pins.select("session_id", "seq", "provider", "pin", "missing_pin", "body")


PIN_FIELDS = {  # pin -> (nested object, its pinned fields)
    "venice-system-prompt-off": ("venice_parameters", [("include_venice_system_prompt", "false")]),
    "openrouter-zdr": ("provider", [("zdr", "true"), ("data_collection", '"deny"')]),
}


def pin_bodies(sent: DataFrame) -> DataFrame:
    """P9 over outbound bodies (provider, zdr, raw JSON): pin, missing_pin (the body lacked one of its
    fields or held another value) and the merged body. All other fields of the body and of the
    nested object stay with their values (a merged body lists the keys of its objects in alphabetical
    order); what is no JSON object counts as an empty one."""
    pin = (F.when(F.col("provider") == "venice", "venice-system-prompt-off")
           .when((F.col("provider") == "openrouter") & F.col("zdr"), "openrouter-zdr"))
    kind = "map<string,variant>"
    fields = lambda text: F.coalesce(F.from_json(text, kind), F.from_json(F.lit("{}"), kind))
    out = sent.withColumn("pin", pin).withColumn("_top", fields(F.col("raw")))
    body, missing = F.col("raw"), F.lit(False)
    for name, (field, pinned) in PIN_FIELDS.items():
        keys = [key for key, _ in pinned]
        nested = fields(F.to_json(F.col("_top")[field]))
        held = _all([F.coalesce(F.to_json(nested[key]) == F.lit(value), F.lit(False)) for key, value in pinned])
        fixed = F.create_map(*[x for key, value in pinned for x in (F.lit(key), F.parse_json(F.lit(value)))])
        merged = F.map_concat(_without(nested, keys), fixed)
        whole = F.map_concat(_without(F.col("_top"), [field]), F.create_map(F.lit(field), F.parse_json(F.to_json(merged))))
        body = F.when(F.col("pin") == name, F.to_json(whole)).otherwise(body)
        missing = F.when(F.col("pin") == name, ~held).otherwise(missing)
    return out.withColumn("missing_pin", missing).withColumn("body", body).drop("_top")


def _without(fields, keys):
    return F.map_filter(fields, lambda k, v: ~k.isin(*keys))


def _all(cs):
    out = cs[0]
    for c in cs[1:]:
        out = out & c
    return out


def request_pins_sql():
    w = "OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    from ..sources.seedframes import seed_sql
    model = "CASE WHEN cur_model IS NULL THEN '' ELSE '\"model\":' || CAST(to_json(cur_model) AS VARCHAR) || ',' END"
    msgs = ("'\"messages\":' || CASE WHEN pin IS NULL THEN CAST(to_json([{'role': 'user', 'content': s}]) AS VARCHAR) "
            "ELSE CAST(to_json([{'content': s, 'role': 'user'}]) AS VARCHAR) END")  # merged objects list their keys in order
    venice = "'{' || CASE WHEN k > 0 THEN '\"character\":\"v1\"' ELSE '' END"
    router = "'{' || CASE WHEN k > 0 THEN '\"sort\":\"price\"' ELSE '' END"
    sep = "CASE WHEN k > 0 THEN ',' ELSE '' END"
    return (f"WITH {session_events_cte()},\n{O.snippet_cte()},\n"
            f"prov_tpl AS (SELECT * FROM {seed_sql(fixtures.provider_rows(), fixtures.PROVIDER_COLS)}),\n"
            "e AS (SELECT s.*, p.provider, p.model_id FROM sev s LEFT JOIN prov_tpl p ON s.provider_i = p.i AND s.kind = 'model_select'),\n"
            f"e2 AS (SELECT *, last_value(provider IGNORE NULLS) {w} AS cur_provider, last_value(model_id IGNORE NULLS) {w} AS cur_model FROM e),\n"
            "e3 AS (SELECT e2.*, t.s, e2.event_id % 3 AS k, CASE WHEN cur_provider = 'venice' THEN 'venice-system-prompt-off' WHEN cur_provider = 'openrouter' "
            "AND session_id % 3 = 0 THEN 'openrouter-zdr' END AS pin FROM e2 JOIN snippet t ON e2.snippet_i = t.i WHERE kind = 'payload')\n"
            "SELECT session_id, seq, cur_provider AS provider, pin, pin IS NOT NULL AS missing_pin, "
            f"'{{' || {model} || {msgs} || CASE WHEN pin = 'venice-system-prompt-off' THEN ',\"venice_parameters\":' || {venice} || {sep} || "
            "'\"include_venice_system_prompt\":false}' WHEN pin = 'openrouter-zdr' THEN ',\"provider\":' || "
            "'{\"data_collection\":\"deny\"' || CASE WHEN k > 0 THEN ',\"sort\":\"price\"' ELSE '' END || ',\"zdr\":true}' "
            f"WHEN cur_provider = 'openrouter' AND k > 0 THEN ',\"provider\":' || {router} || CASE WHEN k = 2 THEN ',\"data_collection\":\"allow\"' ELSE '' END || '}}' "
            "ELSE '' END || '}' AS body FROM e3")


# D10 ------------------------------------------------------------------------
def payloads(spark, sf):
    """One payload a conversation, its messages in order: every fifth message has a string
    content, the others parts, of which some hold an image."""
    t = fixtures.fx_turn(spark, sf)
    image = PL.raw_part("image", F.concat_ws("-", F.lit("img"), F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    parts = F.when(F.col("turn") % 5 != 4, F.when(F.col("turn") % 3 == 2, F.array(PL.text_part(F.col("text")), image))
                   .otherwise(F.array(PL.text_part(F.col("text")))))
    message = F.struct(F.col("role").alias("role"), F.when(F.col("turn") % 5 == 4, F.col("text")).alias("content"), parts.alias("parts")).cast(PL.MESSAGE)
    turns = t.select("conv_id", F.struct("turn", message.alias("message")).alias("m"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m")).select(
        "conv_id", F.col("m.turn").alias("turns"), F.col("m.message").alias("messages"))


def _messages(df):
    """One row a message of payload rows."""
    return df.select("conv_id", F.inline(F.arrays_zip("turns", "messages"))).select(
        "conv_id", F.col("turns").alias("turn"), F.col("messages").alias("message"))


def redact_payload(spark, sf):
    """Messages keep their shape; string content and text parts are
    redacted, other parts pass through untouched."""
    r = _messages(payloads(spark, sf).withColumn("messages", PL.redact_messages(F.col("messages"))))
    return r.select("conv_id", "turn", "message.role", F.when(F.col("message.content").isNotNull(), "string").otherwise("parts").alias("shape"),
                    F.col("message.content").alias("content_text"), F.col("message.parts").alias("content_parts"))


def redact_payload_parts(spark, sf):
    """D10, flat: the rewritten content as `kind:value` parts joined by ` | `
    (text parts redacted, image parts untouched, string content as is)."""
    r = redact_payload(spark, sf)
    digest = F.array_join(F.transform("content_parts", lambda p: F.concat(p["kind"], F.lit(":"),
                                                                          F.coalesce(p["text"], p["raw"]))), " | ")
    return r.select("conv_id", "turn", "role", "shape", "content_text", digest.alias("parts"))


def redact_payload_parts_sql():
    from .detection_jobs import redact_sql_steps
    ctes, last = redact_sql_steps("fx_turn", "text")
    img = "'image:img-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)"
    return (f"WITH {O.fx_turn_cte()},\n{ctes}\nSELECT conv_id, turn, role, CASE WHEN turn % 5 = 4 THEN 'string' ELSE 'parts' END "
            "AS shape, CASE WHEN turn % 5 = 4 THEN rtext END AS content_text, CASE WHEN turn % 5 <> 4 THEN 'text:' || rtext || "
            f"CASE WHEN turn % 3 = 2 THEN ' | ' || {img} ELSE '' END END AS parts FROM {last}")


# S1 / S3 / S5 ---------------------------------------------------------------
def scan_units(spark, sf):
    """Every text that detection sees: documents and conversation messages."""
    d = documents(spark, sf).select(F.col("doc_id").alias("unit_id"), F.lit(0).alias("part_no"),
                                    F.lit("document").alias("source"), "text")
    c = _messages(payloads(spark, sf)).select(F.col("conv_id").alias("unit_id"), F.col("turn").cast("int").alias("part_no"),
                                              F.lit("conversation").alias("source"), PL.message_text(F.col("message")).alias("text"))
    return d.unionByName(c)


def scan_units_sql():
    return (f"WITH {O.fx_turn_cte()}\nSELECT doc_id AS unit_id, CAST(0 AS INTEGER) AS part_no, 'document' AS source, text "
            "FROM documents UNION ALL SELECT conv_id, CAST(turn AS INTEGER), 'conversation', text FROM fx_turn")


def session_timeline(spark, sf):
    """S3: the typed logs merged into one session event stream."""
    tl = session_jobs.timeline(spark, sf)
    return tl.select("session_id", "seq", "kind", "provider", "model_id", "resolved")


def write_clean(spark, sf, out_dir: str) -> DataFrame:
    """The redacted corpus written as parquet partitioned by source (no
    driver round trip; the sink is whatever shared path the cluster gives)."""
    clean = redact.with_redacted(ensure_parallel(documents(spark, sf))).select("doc_id", "source", "lang", "redacted")
    clean.write.mode("overwrite").partitionBy("source").parquet(out_dir)
    return spark.read.parquet(out_dir)


def write_clean_job(spark, sf):
    """S5 as a job: the sink lands under the cluster's shared checkpoint folder."""
    import uuid
    from ..session import checkpoint_dir
    return write_clean(spark, sf, f"{checkpoint_dir(spark).rstrip('/')}/clean/{uuid.uuid4().hex}")


def write_clean_sql():
    from .detection_jobs import redact_sql_steps
    ctes, last = redact_sql_steps("docs", "text")
    return (f"WITH docs AS (SELECT doc_id, source, lang, text FROM documents),\n{ctes}\n"
            f"SELECT doc_id, source, lang, rtext AS redacted FROM {last}")


JOBS = {
    "write_clean": (write_clean_job, write_clean_sql),
    "session_summary": (session_summary, session_summary_sql),
    "request_pins": (request_pins, request_pins_sql),
    "redact_payload": (redact_payload, None),
    "redact_payload_parts": (redact_payload_parts, redact_payload_parts_sql),
    "scan_units": (scan_units, scan_units_sql),
    "session_timeline": (session_timeline, lambda: f"WITH {session_jobs.timeline_ctes()}\nSELECT session_id, seq, kind, provider, "
                         "model_id, resolved FROM tl3"),
}
