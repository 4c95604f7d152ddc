"""Structured PII / credential detection as one narrow projection.

Every pattern runs once per text (`regexp_extract_all`, behind a cheap literal
guard); validators filter the candidate arrays; the allowlist splits each type's
values into counted and suppressed; samples are masked at the source. Everything
downstream (hits, suppressed, samples, findings, summaries) derives from the
same per-row arrays (`once`), so no regex is evaluated twice and nothing shuffles.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seeds
from ..functions.regex import to_java
from .allow import Rule, allowed, compile_rules

TYPE_ORDER = [t[0] for t in seeds.PII_TYPES]
SECRET_TYPES = [t[0] for t in seeds.PII_TYPES if t[1]]
PLACEHOLDER = {t[0]: t[2] for t in seeds.PII_TYPES}
LABEL_ONE = {t[0]: t[3] for t in seeds.PII_TYPES}
LABEL_MANY = {t[0]: t[4] for t in seeds.PII_TYPES}
MASKED_TYPES = ["email", "ip", "mac", "private-key", "aws-key", "gh-token", "api-key", "jwt"]

def _java(i: int, p: str) -> str:
    start = seeds.PATTERN_STARTS[i]
    return (f"(?={start})" if start else "") + to_java(p)


CORES = {i: to_java(p) for i, p in seeds.PATTERN_CORES.items()}
JAVA_PATTERNS = [(i, t, _java(i, p), v) for i, (t, p, v) in enumerate(seeds.PATTERNS)]


def col_name(t: str) -> str:
    return t.replace("-", "_")


# ---------------------------------------------------------------------------
# validators (pure Column arithmetic, no UDF)
# ---------------------------------------------------------------------------

def luhn_ok(v: Column) -> Column:
    """Mod-10 check over the digits of a 13-19 digit candidate."""
    d = F.regexp_replace(v, "[^0-9]", "")
    digits = F.split(F.reverse(d), "")
    total = F.aggregate(
        F.transform(digits, lambda c, i: F.when(i % 2 == 1, F.translate(c, "0123456789", "0246813579"))
                    .otherwise(c).cast("int")),
        F.lit(0), lambda acc, x: acc + x)
    return F.length(d).between(13, 19) & (total % 10 == 0)


def iban_ok(v: Column) -> Column:
    """ISO 13616: rotate four, letters to 10..35, remainder mod 97 must be 1."""
    s = F.upper(v)
    rot = F.concat(F.substring(s, 5, 1 << 20), F.substring(s, 1, 4))
    rem = F.aggregate(
        F.split(rot, ""), F.lit(0).cast("bigint"),
        lambda acc, c: F.when(c.between("A", "Z"), (acc * 100 + F.ascii(c) - 55) % 97)
        .otherwise((acc * 10 + c.try_cast("int")) % 97))
    return F.length(s).between(15, 34) & (rem == 1)


VALIDATORS = {"luhn": luhn_ok, "mod97": iban_ok}


# ---------------------------------------------------------------------------
# masking
# ---------------------------------------------------------------------------

def mask(typ: str, v: Column) -> Column | None:
    if typ == "email":
        dom = F.substring_index(v, "@", -1)
        local = F.substring(v, F.lit(1), F.length(v) - F.length(dom) - 1)
        head = F.when(F.length(local) > 2,
                      F.concat(F.substring(local, 1, 1), F.lit("…"), F.substring(local, -1, 1))
                      ).otherwise(F.lit("…"))
        return F.concat(head, F.lit("@"), dom)
    if typ == "ip":
        return F.regexp_replace(v, r"\.[0-9]{1,3}$", ".•")
    if typ == "mac":
        return F.concat(F.substring(v, 1, 8), F.lit(":••:••:••"))
    if typ == "private-key":
        return F.lit(seeds.PRIVATE_KEY_MASK)
    if typ in ("aws-key", "gh-token", "api-key", "jwt"):
        return F.concat(F.substring(v, 1, 6), F.lit("… ("), F.length(v).cast("string"), F.lit(" chars)"))
    return None


# ---------------------------------------------------------------------------
# the scan
# ---------------------------------------------------------------------------

def once(df: DataFrame, *cols: Column) -> DataFrame:
    """Adds named columns that are worked out once a row. A filter on a plain projected column (or on
    the size of an array that is exploded) is pushed below the projection together with a copy of its
    expression, here every pattern; it is not pushed below a generator."""
    return df.select("*", F.inline_outer(F.array(F.struct(*cols))))


def excerpt(text: Column, kind: str) -> Column:
    """A shorter text on which some patterns have the same matches as on the whole.

    `at` (emails): between two `@` (or an end), what lies between the first and the last character
    that no address can hold goes; both stay, so no match and no boundary changes. `digits` (all that
    is made of digits or of pairs with separators): of a longer run without digits, `:` and `-`
    the first and last three characters stay, and before these the capitals it begins with. Such a
    match holds no three others in a row, but for an IBAN's capitals after a digit, and looks at one
    character beyond its ends.
    """
    if kind == "at":
        return F.when(text.contains("@"), F.regexp_replace(text, r"([^@A-Za-z0-9._%+-])[^@]*([^@A-Za-z0-9._%+-])", "$1$2"))
    return F.regexp_replace(text, r"([A-Z]*+[^0-9:-]{3})[^0-9:-]+([^0-9:-]{3})", "$1$2")


#: Characters no address, key or number of letters alone can hold, and characters that a match of any
#: pattern but the private key's holds one of in the middle (`I`, `J`: AKIA, ASIA, AIza, eyJ). Spelled out: the
#: JVM looks such a class up in one table, ranges one after the other.
_GAP = "[^ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@:-]"
_PLAIN = "[^0123456789@:_IJ-]"
PROSE = f"(?<={_GAP}{_PLAIN}{_PLAIN}){_PLAIN}{{8}}{_PLAIN}+(?={_PLAIN}{_PLAIN}{_GAP})"
MARK = "\x1a"  # stands where prose was
#: The patterns whose matches may hold prose (the private key's), and what these matches start with.
WHOLE_TEXT = [i for i, (t, _, _) in enumerate(seeds.PATTERNS) if t == "private-key"]
WHOLE_FROM = "-----BEGIN"


def brief(text: Column) -> Column:
    """The text with a mark for each stretch of prose: every pattern but those of `WHOLE_TEXT` has the same
    matches on it.

    A run of plain characters holds neither digits nor `@:_IJ-`, and each match holds one of these. So a
    match reaches into a run from an end only: an address, a key or an IBAN's capitals up to its first gap,
    any other number over two characters, and the character beyond is looked at. Prose is what lies in a
    run with a gap and two more characters before it and two characters and a gap behind it; these stay.
    """
    return F.regexp_replace(text, PROSE, MARK)


def guard_of(text: Column, i: int) -> Column | None:
    """Whether the text holds a literal without which pattern i has no match."""
    guard = seeds.PATTERN_GUARDS[i]
    return reduce(or_, [text.contains(g) for g in guard]) if guard else None


def raw_matches(text: Column, pattern_ids: list[int] | None = None, short: Column | None = None) -> list[tuple[int, str, Column]]:
    """Guarded `regexp_extract_all` per pattern: [(pattern_id, type, array<string>)]. `short` names the
    text's `brief`, if it is a column already; without it each pattern takes its own excerpt."""
    out = []
    for i, t, jre, _ in JAVA_PATTERNS:
        if pattern_ids is not None and i not in pattern_ids:
            continue
        kind = seeds.PATTERN_EXCERPTS[i]
        base = text if short is None or i in WHOLE_TEXT else short
        part = excerpt(text, kind) if kind and short is None else base
        m = F.regexp_extract_all(part, F.lit(jre), 0)
        guard = guard_of(base, i)
        if guard is not None:
            m = F.when(guard, m).otherwise(F.array().cast("array<string>"))
        out.append((i, t, m))
    return out


def with_candidates(df: DataFrame, text: str = "text", pattern_ids: list[int] | None = None) -> DataFrame:
    """Adds `p{i}`: the validated candidates of pattern i (original text), of all patterns or the given."""
    df = df.select("*", brief(F.col(text)).alias("__brief"))
    cols = []
    for i, t, m in raw_matches(F.col(text), pattern_ids, F.col("__brief")):
        v = seeds.PATTERNS[i][2]
        cols.append((F.filter(m, VALIDATORS[v]) if v else m).alias(f"p{i}"))
    return once(df, *cols).drop("__brief")


def _tag_allowed(rules, t):
    return lambda v: F.struct(v.alias("value"), allowed(rules, t, v).alias("allowed"))


def _masker(t):
    return lambda x: mask(t, x["value"])


def _sample_of(t):
    return lambda m: F.struct(F.lit(t).alias("type"), m.alias("masked"))


def _finding_of(rules, i, t):
    return lambda v, k: F.struct(F.lit(i).alias("pattern_id"), F.lit(t).alias("type"),
                                 (k + 1).alias("match_no"), v.alias("value"),
                                 allowed(rules, t, v).alias("allowed"))


def with_scan(df: DataFrame, rules: list[Rule] | None = None, sample_cap: int = seeds.DEFAULT_SAMPLE_CAP,
              text: str = "text", keep_candidates: bool = False) -> DataFrame:
    """Adds `hits`, `suppressed` (array<struct<type,count>> in report order) and
    `samples` (array<struct<type,masked>>). `rules` defaults to the built-in list."""
    rules = compile_rules() if rules is None else rules
    cand = with_candidates(df, text)
    # per type: values in pattern order, split by the allowlist
    per_type = []
    for t in TYPE_ORDER:
        ids = [i for i, (pt, _, _) in enumerate(seeds.PATTERNS) if pt == t]
        vals = F.col(f"p{ids[0]}") if len(ids) == 1 else F.concat(*[F.col(f"p{i}") for i in ids])
        per_type.append(F.transform(vals, _tag_allowed(rules, t)).alias(f"v_{col_name(t)}"))
    staged = cand.select("*", *per_type)

    def counts(flag: bool) -> Column:
        items = [F.struct(F.lit(t).alias("type"),
                          F.size(F.filter(F.col(f"v_{col_name(t)}"),
                                          lambda x: x["allowed"] if flag else ~x["allowed"])).cast("bigint").alias("count"))
                 for t in TYPE_ORDER]
        return F.filter(F.array(*items), lambda h: h["count"] > 0)

    sample_parts = []
    if sample_cap > 0:
        for t in MASKED_TYPES:
            masked = F.transform(F.filter(F.col(f"v_{col_name(t)}"), lambda x: ~x["allowed"]), _masker(t))
            sample_parts.append(F.transform(F.slice(F.array_distinct(masked), 1, sample_cap), _sample_of(t)))
        order = {t: TYPE_ORDER.index(t) for t in MASKED_TYPES}
        sample_parts = [p for _, p in sorted(zip([order[t] for t in MASKED_TYPES], sample_parts), key=lambda z: z[0])]
        samples = F.concat(*sample_parts)
    else:
        samples = F.array().cast("array<struct<type:string,masked:string>>")

    drop = [f"v_{col_name(t)}" for t in TYPE_ORDER]
    if not keep_candidates:
        drop += [f"p{i}" for i in range(len(seeds.PATTERNS))]
    return (staged.select("*", counts(False).alias("hits"), counts(True).alias("suppressed"),
                          samples.alias("samples"))
            .drop(*drop))


def findings(df: DataFrame, key_cols: list[str], rules: list[Rule] | None = None,
             text: str = "text", types: list[str] | None = None) -> DataFrame:
    """One row per validated match: keys, pattern_id, type, match_no, value, allowed.
    Only the patterns of `types` run, if given."""
    rules = compile_rules() if rules is None else rules
    ids = [i for i, (t, _, _) in enumerate(seeds.PATTERNS) if types is None or t in types]
    cand = with_candidates(df.select(*key_cols, text), text, ids)
    per = [F.transform(F.col(f"p{i}"), _finding_of(rules, i, seeds.PATTERNS[i][0])) for i in ids]
    return cand.select(*key_cols, F.inline(F.concat(*per)))


# ---------------------------------------------------------------------------
# wording
# ---------------------------------------------------------------------------

def _label_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def hit_phrase(h: Column) -> Column:
    """`2 emails` / `1 SSN` for one {type, count} struct."""
    lab = F.when(h["count"] == 1, _label_map(LABEL_ONE)[h["type"]]).otherwise(_label_map(LABEL_MANY)[h["type"]])
    return F.concat(h["count"].cast("string"), F.lit(" "), lab)


def summary(hits: Column) -> Column:
    """`2 emails, 1 SSN`."""
    return F.array_join(F.transform(hits, hit_phrase), ", ")


def _shown(samples: Column, h: Column) -> Column:
    return F.transform(F.filter(samples, lambda s: s["type"] == h["type"]), lambda s: s["masked"])


def _more(samples: Column, h: Column) -> Column:
    return h["count"] - F.size(_shown(samples, h))


def detail(hits: Column, suppressed: Column, samples: Column) -> Column:
    """Multi-line breakdown with masked samples, suppressed line and caveat."""
    def line(h):
        shown = _shown(samples, h)
        more = _more(samples, h)
        tail = F.when(F.size(shown) > 0, F.concat(
            F.lit(": "), F.array_join(shown, ", "),
            F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit(""))
        )).otherwise(F.lit(seeds.DETAIL_NOT_SHOWN))
        return F.concat(F.lit(seeds.DETAIL_BULLET), hit_phrase(h), tail)
    lines = F.transform(hits, line)
    supp = F.when(F.size(suppressed) > 0,
                  F.array(F.concat(F.lit(seeds.DETAIL_ALLOWLISTED), summary(suppressed)))
                  ).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(lines, supp, F.array(F.lit(seeds.DETAIL_CAVEAT))), "\n")


def inline(hits: Column, samples: Column) -> Column:
    """`2 IP addresses (192.168.1.•, 10.0.0.•), 1 email (p…k@x.com)`."""
    def part(h):
        shown = _shown(samples, h)
        more = _more(samples, h)
        tail = F.when(F.size(shown) > 0, F.concat(
            F.lit(" ("), F.array_join(shown, ", "),
            F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")),
            F.lit(")"))).otherwise(F.lit(""))
        return F.concat(hit_phrase(h), tail)
    return F.array_join(F.transform(hits, part), ", ")


def has_secret(hits: Column) -> Column:
    return F.exists(hits, lambda h: h["type"].isin(SECRET_TYPES))


def secret_hits(hits: Column) -> Column:
    return F.filter(hits, lambda h: h["type"].isin(SECRET_TYPES))
