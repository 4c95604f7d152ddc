"""Structured payloads and tool results: the shapes detection reads and redaction keeps.

A message is struct<role, content string, parts array<PART>>, with a string content or a list of
parts; a part is struct<kind, text, raw>: text parts hold `text`, all others (images, calls) `raw`.
A tool result is struct<text string, strings array<string>, parts array<PART>, raw string>, of which
one field is set; `raw` is the JSON of any other shape. Everything is a column expression over the
nested value, so a payload is never taken apart and put together again by a shuffle. What isn't a
string content or a text part passes through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .allow import Rule, compile_rules
from .detect import JAVA_PATTERNS
from .redact import redact_step

PART = "struct<kind:string,text:string,raw:string>"
MESSAGE = f"struct<role:string,content:string,parts:array<{PART}>>"
RESULT = f"struct<text:string,strings:array<string>,parts:array<{PART}>,raw:string>"


def _bound(x: Column, step) -> Column:
    """`step(x)` with x computed once, so a chain of steps stays linear."""
    return F.transform(F.array(x), step)[0]


def redacted_text(x: Column, only: list[str] | None = None, rules: list[Rule] | None = None) -> Column:
    """D8 / D9 as one expression, for texts inside arrays and structs. Null stays null."""
    rules = compile_rules() if rules is None else rules

    def step(i, t, jre, v):
        return lambda y: redact_step(y, jre, t, v, rules, i)
    for i, t, jre, v in JAVA_PATTERNS:
        if only is None or t in only:
            x = _bound(x, step(i, t, jre, v))
    return x


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("raw")).cast(PART)


def raw_part(kind: str, raw: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("text"), raw.alias("raw")).cast(PART)


def _redacted_parts(parts: Column, **options) -> Column:
    return F.transform(parts, lambda p: p.withField("text", redacted_text(p["text"], **options)))


def redact_message(message: Column, **options) -> Column:
    """D10 for one message."""
    return (message.withField("content", redacted_text(message["content"], **options))
            .withField("parts", _redacted_parts(message["parts"], **options)))


def redact_messages(messages: Column, **options) -> Column:
    """The messages of a payload, each in its shape."""
    return F.transform(messages, lambda m: redact_message(m, **options))


def message_text(message: Column) -> Column:
    """The text of a message that detection sees; parts without text add nothing."""
    texts = F.filter(F.transform(message["parts"], lambda p: p["text"]), lambda t: t.isNotNull())
    return F.coalesce(message["content"], F.array_join(texts, "\n"), F.lit(""))


def message_json(message: Column) -> Column:
    """The message as it goes out: `content` a string or a list of parts."""
    parts = F.transform(message["parts"], lambda p: F.when(p["kind"] == "text", F.to_json(F.struct(p["kind"].alias("type"), p["text"].alias("text"))))
                        .otherwise(F.to_json(F.struct(p["kind"].alias("type"), p["raw"].alias("data")))))
    role = F.to_json(F.struct(message["role"].alias("role")))
    head = F.substring(role, F.lit(1), F.length(role) - 1)
    return F.when(message["content"].isNotNull(), F.to_json(F.struct(message["role"].alias("role"), message["content"].alias("content")))).otherwise(
        F.concat(head, F.lit(',"content":['), F.array_join(parts, ","), F.lit("]}")))


def result_text(result: Column) -> Column:
    """A result flattened for detection: parts joined by newline (those without text empty),
    unknown shapes as their JSON, nothing as the empty text."""
    parts = F.transform(result["parts"], lambda p: F.coalesce(p["text"], F.lit("")))
    return F.coalesce(result["text"], F.array_join(result["strings"], "\n"), F.array_join(parts, "\n"), result["raw"], F.lit(""))


def redact_result(result: Column, **options) -> Column:
    """The result in its shape; an unknown shape is left as it is."""
    return (result.withField("text", redacted_text(result["text"], **options))
            .withField("strings", F.transform(result["strings"], lambda s: redacted_text(s, **options)))
            .withField("parts", _redacted_parts(result["parts"], **options)))


def result_outcome(result: Column, redacted: Column, found: Column) -> Column:
    """Redacted, unchanged, or could-not-redact where something was found in a shape that
    can't be rebuilt."""
    return (F.when(~redacted.eqNullSafe(result), "redacted").when(found & result["raw"].isNotNull(), "could-not-redact").otherwise("unchanged"))
