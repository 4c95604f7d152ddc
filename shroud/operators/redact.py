"""Redaction: typed placeholders, pattern by pattern on the rewritten text.

Plain patterns are one `regexp_replace`. A pattern whose replacement depends on
the matched value (validator, allowlist) is rewritten as split + extract with
the same regex: both walk the identical match sequence (no pattern matches the
empty string), so `parts[0] m1 parts[1] m2 ...` is the text, and replacing each
`m` by a per-value decision rebuilds it without a UDF. Each step is its own
projected column, so the previous text is computed once, never duplicated into
a growing expression tree. The steps run on the text without its prose
(`detect.brief`), which is put back at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .allow import Rule, allow_applies, compile_rules
from .detect import CORES, JAVA_PATTERNS, MARK, PLACEHOLDER, PROSE, VALIDATORS, WHOLE_FROM, guard_of, once
from .allow import allowed as allowed_col


def _conditional(rules: list[Rule], typ: str, validator: str | None) -> bool:
    return bool(validator) or allow_applies(rules, typ)


def redact_step(x: Column, jre: str, typ: str, validator: str | None, rules: list[Rule],
                pattern_id: int | None = None) -> Column:
    """One pattern's rewriting, skipped where its required literal is absent (no match is possible
    there, so the text is unchanged)."""
    step = _step(x, jre, typ, validator, rules)
    guard = None if pattern_id is None else guard_of(x, pattern_id)
    return step if guard is None else F.when(guard, step).otherwise(x)


def _step(x: Column, jre: str, typ: str, validator: str | None, rules: list[Rule]) -> Column:
    ph = PLACEHOLDER[typ]
    if not _conditional(rules, typ, validator):
        return F.regexp_replace(x, F.lit(jre), F.lit(ph))
    parts = F.split(x, jre, -1)
    found = F.regexp_extract_all(x, F.lit(jre), 0)

    def decide(m):
        keep = allowed_col(rules, typ, m)
        if validator:
            keep = keep | ~VALIDATORS[validator](m)
        return F.when(keep, m).otherwise(F.lit(ph))
    repl = F.concat(F.transform(found, decide), F.array(F.lit("")))
    return F.array_join(F.zip_with(parts, repl, lambda a, b: F.concat(a, b)), "")


def _cut(text: Column) -> list[Column]:
    """`__pieces`: the text cut before and after each stretch of prose, which is every second piece, and
    `__rest`: what follows the start of a private key, whose match may hold prose. A text with marks of its
    own is all rest."""
    head = F.when(text.contains(MARK), "").otherwise(F.substring_index(text, WHOLE_FROM, 1))
    rest = F.when(text.contains(MARK), text).when(text.contains(WHOLE_FROM), F.substring(text, F.length(head) + 1, F.length(text))).otherwise("")
    pieces = F.split(F.regexp_replace(head, PROSE, f"{MARK}$0{MARK}"), MARK, -1)
    return [pieces.alias("__pieces"), rest.alias("__rest")]


def _kept() -> Column:
    return F.concat(F.array_join(F.filter("__pieces", lambda x, k: k % 2 == 0), MARK), "__rest")


def _put_back(kept: Column) -> Column:
    """The text again: its prose in place of the marks."""
    prose = F.concat(F.filter("__pieces", lambda x, k: k % 2 == 1), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.split(kept, MARK, -1), prose, lambda a, b: F.concat(a, b)), "")
    return F.when(F.size("__pieces") == 1, kept).otherwise(whole)


def with_redacted(df: DataFrame, text: str = "text", out: str = "redacted",
                  only: list[str] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """Adds `out` = text with every (or every `only`-typed) match replaced.

    The steps run on the text without its prose. No match holds a character of a placeholder, so what a
    later step rewrites stood in the original text already: prose stays out of every step's reach, and a
    step whose number, looked for without its boundaries, isn't there leaves the text as it is."""
    rules = compile_rules() if rules is None else rules
    steps = [(i, t, jre, v) for i, t, jre, v in JAVA_PATTERNS if only is None or t in only]
    cores = [i for i, *_ in steps if i in CORES]
    df = once(df, *_cut(F.col(text))).withColumn("__kept", _kept())
    if cores:
        df = once(df, F.struct(*[F.col("__kept").rlike(CORES[i]).alias(f"p{i}") for i in cores]).alias("__may"))
    cur = "__kept"
    for n, (i, t, jre, v) in enumerate(steps):
        nxt = f"__r{n}"
        step = redact_step(F.col(cur), jre, t, v, rules, i)
        df = df.withColumn(nxt, F.when(F.col("__may")[f"p{i}"], step).otherwise(F.col(cur)) if i in CORES else step).drop(cur)
        cur = nxt
    # a filter on the result would be pushed below the steps, each of which names the text before it several times
    return once(df, _put_back(F.col(cur)).alias(out)).drop("__may", "__pieces", "__rest", cur)
