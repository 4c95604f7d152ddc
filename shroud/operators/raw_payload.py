"""Payloads of unknown shape (S1, D10 on raw JSON).

A payload is a VARIANT. `messages` is walked where it is an array: a message's
content is a string, an array of parts, or anything else; a part counts by its
`text` if it has one, or as a bare string. What isn't recognised is scanned as
its JSON text and passes through rewriting untouched, never dropped. Every line
comes out with an outcome:

* `bad-record`: not JSON; `no-payload`: JSON without a payload;
* `unknown-shape`: a payload whose `messages` is no array: scanned whole, not rewritten;
* `could-not-redact`: something was found in a message that can't be rewritten;
* `redacted` / `unchanged`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import detect
from .payload import redacted_text


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _content(m: Column) -> Column:
    return F.try_variant_get(m, "$.content", "variant")


def _text(p: Column) -> Column:
    """A part's text: its `text` where that is a string; NULL else."""
    t = F.try_variant_get(p, "$.text", "variant")
    return F.when(_kind(t) == "STRING", t.cast("string"))


def _as_parts(content: Column) -> Column:
    return F.when(_kind(content).startswith("ARRAY"), content.cast("array<variant>"))


def message_text(m: Column) -> Column:
    """What detection sees of a message."""
    c = _content(m)
    seen = F.transform(_as_parts(c), lambda p: F.coalesce(_text(p), F.when(_kind(p) == "STRING", p.cast("string")), F.to_json(p)))
    return F.when(_kind(c) == "STRING", c.cast("string")).otherwise(F.coalesce(F.array_join(seen, "\n"), F.to_json(F.coalesce(c, m))))


def _with_field(v: Column, name: str, value: Column) -> Column:
    """The object with one field set, all others kept."""
    fields = v.cast("map<string,variant>")
    return F.parse_json(F.to_json(F.map_concat(F.map_filter(fields, lambda k, x: k != name), F.create_map(F.lit(name), value))))


def _as_variant(text: Column) -> Column:
    return F.to_variant_object(F.array(text)).cast("array<variant>")[0]


def redact_message(m: Column, **options) -> Column:
    """The message with string content and the `text` of parts redacted."""
    c = _content(m)
    parts = F.transform(_as_parts(c), lambda p: F.when(_text(p).isNotNull(), _with_field(p, "text", _as_variant(redacted_text(_text(p), **options))))
                        .otherwise(p))
    return (F.when(_kind(c) == "STRING", _with_field(m, "content", _as_variant(redacted_text(c.cast("string"), **options))))
            .when(parts.isNotNull(), _with_field(m, "content", F.parse_json(F.to_json(parts)))).otherwise(m))


def walked(lines: DataFrame, payload: str = "$.payload") -> DataFrame:
    """Adds `payload` and `messages` (NULL where it has no array of them) to (line, v, …)."""
    p = F.try_variant_get("v", payload, "variant")
    p = F.when(_kind(p) != "VOID", p)
    return lines.withColumn("payload", p).withColumn("messages", F.try_variant_get("payload", "$.messages", "array<variant>"))


def scan_texts(w: DataFrame, key: list[str]) -> DataFrame:
    """(key…, part_no, text), a row per message; an unknown shape or a bad line is one row of its text."""
    whole = F.array(F.when(F.col("payload").isNull(), F.col("line")).when(_kind(F.col("payload")) == "STRING", F.col("payload").cast("string"))
                    .otherwise(F.to_json("payload")))
    texts = F.when(F.col("messages").isNotNull(), F.transform("messages", message_text)).otherwise(whole)
    return w.select(*key, F.posexplode(texts).alias("part_no", "text"))


def redacted(w: DataFrame, **options) -> DataFrame:
    """Adds `outcome` and `body`, the payload as it may go out (a bad line: the line itself)."""
    w = w.withColumn("_new", F.transform("messages", lambda m: redact_message(m, **options)))
    # what is still found after rewriting stands where it can't be rewritten
    left = F.array_join(F.transform("_new", message_text), "\n")
    w = w.withColumn("_left", F.coalesce(left, F.lit("")))
    w = detect.with_scan(w, text="_left", sample_cap=0).drop("suppressed", "samples", "_left")
    outcome = (F.when(F.col("v").isNull(), "bad-record").when(F.col("payload").isNull(), "no-payload").when(F.col("messages").isNull(), "unknown-shape")
               .when(F.size("hits") > 0, "could-not-redact").when(F.to_json("_new") == F.to_json("messages"), "unchanged").otherwise("redacted"))
    body = (F.when(F.col("payload").isNull(), F.col("line"))
            .when(F.col("messages").isNull(), F.to_json("payload"))
            .otherwise(F.to_json(_with_field(F.col("payload"), "messages", F.parse_json(F.to_json("_new"))))))
    return w.withColumn("outcome", outcome).withColumn("body", body).drop("_new", "hits")
