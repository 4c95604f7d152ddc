"""Allowlist: values that are not counted as PII, yet always reported.

Two forms of one semantics:

* a short rule list (the defaults plus a user's entries) compiles into a Column
  predicate `allowed(type, value)` that runs inside the scan projection;
* a rule *table* (many hosts, many entries) is parsed by `parse_rules` and
  matched by joins: domains by an equi-join on every label suffix of the email
  domain, CIDR blocks by an equi-join per distinct prefix length on the masked
  address, globs by an equi-join on a literal part of the entry (the whole of an
  exact entry, else what stands before the first or after the last `*`, else a
  part between), confirmed with `rlike`. No rule table needs a bound.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seeds
from .running import running

IPV4_SHAPE = r"^\d{1,3}(?:\.\d{1,3}){3}$"
CIDR_SHAPE = r"^(\d{1,3}(?:\.\d{1,3}){3})/(\d{1,2})$"


@dataclass(frozen=True)
class Rule:
    kind: str            # domain | cidr | glob
    domain: str | None = None
    net: int | None = None
    prefix: int | None = None
    glob: str | None = None   # regex body (anchored, case-insensitive)
    literal: str | None = None  # glob entry without its `*`s

    @property
    def mask(self) -> int:
        return 0 if not self.prefix else (0xFFFFFFFF << (32 - self.prefix)) & 0xFFFFFFFF


def glob_body(entry: str) -> str:
    return ".*".join("".join("\\" + c if c in seeds.GLOB_SPECIALS else c for c in part)
                     for part in entry.split("*"))


def _ip_int(s: str) -> int | None:
    parts = s.split(".")
    if len(parts) != 4 or any(not p.isdigit() or int(p) > 255 for p in parts):
        return None
    a, b, c, d = (int(p) for p in parts)
    return (a << 24) | (b << 16) | (c << 8) | d


def parse_entry(raw: str) -> Rule | None:
    """Parse one configured entry (driver-side, for a bounded rule list)."""
    e = raw.strip()
    if not e or re.fullmatch(r"\*+", e):
        return None
    m = re.fullmatch(CIDR_SHAPE[1:-1], e)
    if m:
        net, n = _ip_int(m.group(1)), int(m.group(2))
        if net is None or n > 32:
            return None
        r = Rule("cidr", prefix=n)
        return Rule("cidr", net=net & r.mask, prefix=n)
    if e.startswith("@"):
        d = e[1:].lower()
        return Rule("domain", domain=d) if d else None
    if "@" not in e and "." in e and "*" not in e and not re.fullmatch(IPV4_SHAPE[1:-1], e):
        return Rule("domain", domain=e.lower())
    return Rule("glob", glob=glob_body(e), literal=e.replace("*", ""))


def compile_rules(entries: list[str] | None = None, defaults: bool = True) -> list[Rule]:
    out = []
    for raw in (seeds.DEFAULT_ALLOW if defaults else []) + list(entries or []):
        r = parse_entry(raw)
        if r is not None:
            out.append(r)
    return out


# ---------------------------------------------------------------------------
# Column forms
# ---------------------------------------------------------------------------

def email_domain(value: Column) -> Column:
    return F.lower(F.substring_index(value, "@", -1))


def ip_to_int(value: Column) -> Column:
    """Dotted quad to BIGINT; NULL if it is not four octets 0-255."""
    o = F.split(value, r"\.")
    good = (F.size(o) == 4) & F.forall(o, lambda x: x.rlike(r"^[0-9]{1,3}$") & (x.cast("int") <= 255))
    n = (o[0].cast("bigint") * 16777216 + o[1].cast("bigint") * 65536
         + o[2].cast("bigint") * 256 + o[3].cast("bigint"))
    return F.when(good, n)


def allowed(rules: list[Rule], typ: str, value: Column) -> Column:
    """Predicate for one detected value of a statically known type."""
    conds = []
    doms = [r.domain for r in rules if r.kind == "domain"]
    if typ == "email" and doms:
        d = email_domain(value)
        conds.append(d.isin(doms) | _any([d.endswith("." + x) for x in doms]))
    cidrs = [r for r in rules if r.kind == "cidr"]
    if typ == "ip" and cidrs:
        n = ip_to_int(value)
        conds.append(F.coalesce(_any([n.bitwiseAND(F.lit(r.mask)) == F.lit(r.net) for r in cidrs]),
                                F.lit(False)))
    globs = [r.glob for r in rules if r.kind == "glob" and glob_may_match(r, typ)]
    if globs:
        conds.append(value.rlike("(?i)^(?:" + "|".join(f"(?:{g})" for g in globs) + r")\z"))
    return _any(conds) if conds else F.lit(False)


# Characters a detected value of each type can consist of (read off the
# patterns' character classes, lower-cased). A glob whose literal characters
# are not all in a type's alphabet can never match a value of that type.
VALUE_ALPHABET = {
    "email": r"[a-z0-9._%+@-]", "ssn": r"[0-9-]", "private-key": None, "aws-key": r"[a-z0-9]",
    "gh-token": r"[a-z0-9_]", "jwt": r"[a-z0-9_.-]", "api-key": r"[a-z0-9_-]", "credit-card": r"[0-9 -]",
    "ip": r"[0-9.]", "iban": r"[a-z0-9]", "mac": r"[0-9a-f:-]", "phone": r"[0-9+().\s-]",
}


def glob_may_match(rule: Rule, typ: str) -> bool:
    alpha = VALUE_ALPHABET.get(typ)
    return alpha is None or all(re.fullmatch(alpha, c) for c in (rule.literal or "").lower())


def allow_applies(rules: list[Rule], typ: str) -> bool:
    """Whether any rule can ever allow a value of this type."""
    return any((r.kind == "glob" and glob_may_match(r, typ)) or (r.kind == "domain" and typ == "email")
               or (r.kind == "cidr" and typ == "ip") for r in rules)


def _any(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


# ---------------------------------------------------------------------------
# Rule tables
# ---------------------------------------------------------------------------

def prefix_mask(n: Column) -> Column:
    """Netmask of an IPv4 prefix length as BIGINT: 2^32 - 2^(32-n) (0 for /0)."""
    return F.lit(4294967296) - F.pow(F.lit(2), F.lit(32) - n).cast("bigint")


def parse_rules(entries: DataFrame, raw: str = "raw") -> DataFrame:
    """A1: classify every entry: domain / cidr / glob, or rejected with NULL kind.

    Adds columns kind, domain, net (BIGINT), prefix_len, glob_regex, and for globs
    glob_side (exact, prefix, suffix, inner) and glob_key, the lower-case literal
    part that any matching value holds there.
    """
    e = F.trim(F.col(raw))
    addr = F.regexp_extract(e, CIDR_SHAPE, 1)
    plen = F.regexp_extract(e, CIDR_SHAPE, 2).cast("int")
    net = ip_to_int(addr)
    mask = prefix_mask(plen)
    is_cidr = e.rlike(CIDR_SHAPE)
    is_bad = (e == "") | e.rlike(r"^\*+$")
    at_dom = F.lower(F.substring(e, 2, 1 << 30))
    bare_dom = (~e.contains("@")) & e.contains(".") & (~e.contains("*")) & (~e.rlike(IPV4_SHAPE))
    kind = (F.when(is_bad, F.lit(None))
            .when(is_cidr, F.when(net.isNotNull() & (plen <= 32), F.lit("cidr")))
            .when(e.startswith("@"), F.when(at_dom != "", F.lit("domain")))
            .when(bare_dom, F.lit("domain"))
            .otherwise(F.lit("glob")))
    parts = F.split(e, r"\*", -1)
    first, last = F.lower(F.element_at(parts, 1)), F.lower(F.element_at(parts, -1))
    longest = F.lower(F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"])
    side = (F.when(F.size(parts) == 1, "exact").when(F.length(first) >= F.greatest(F.length(last), F.lit(1)), "prefix")
            .when(last != "", "suffix").otherwise("inner"))
    key = F.when(side == "suffix", last).when(side == "inner", longest).otherwise(first)
    esc = F.transform(parts, lambda p: F.regexp_replace(p, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    return (entries
            .withColumn("kind", kind)
            .withColumn("domain", F.when(kind == "domain",
                                         F.when(e.startswith("@"), at_dom).otherwise(F.lower(e))))
            .withColumn("prefix_len", F.when(kind == "cidr", plen))
            .withColumn("net", F.when(kind == "cidr", net.bitwiseAND(mask)))
            .withColumn("glob_regex", F.when(kind == "glob", F.array_join(esc, ".*")))
            .withColumn("glob_side", F.when(kind == "glob", side)).withColumn("glob_key", F.when(kind == "glob", key)))


def domain_suffixes(value: Column) -> Column:
    """Every label suffix of the email domain: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(email_domain(value), r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def glob_parts(value: Column, lengths: dict[str, list[int]]) -> Column:
    """array<struct<glob_side,glob_key>>: the parts of a value that a rule with literal
    parts of these lengths (by side) could name."""
    v = F.lower(value)
    part = lambda side, k: F.struct(F.lit(side).alias("glob_side"), k.alias("glob_key"))
    fits = lambda n, x: F.when(F.length(v) >= n, x)
    one = [part("exact", v)]
    one += [fits(n, part("prefix", F.substring(v, 1, n))) for n in lengths.get("prefix", [])]
    one += [fits(n, part("suffix", F.right(v, F.lit(n)))) for n in lengths.get("suffix", [])]
    none = F.array().cast("array<struct<glob_side:string,glob_key:string>>")

    def inner(n):
        return F.coalesce(fits(n, F.transform(F.sequence(F.lit(1), F.length(v) - n + 1), lambda i: part("inner", F.substring(v, i, F.lit(n))))), none)
    many = [inner(n) for n in lengths.get("inner", [])]
    return F.array_distinct(F.concat(F.filter(F.array(*one), lambda x: x.isNotNull()), *many))


def match_globs(findings: DataFrame, globs: DataFrame) -> DataFrame:
    """The findings whose value matches a glob rule (glob_side, glob_key, glob_regex). Distinct values
    meet the rules by an equi-join on their literal parts; `rlike` confirms."""
    globs = globs.distinct()
    # at most as many lengths a side as the longest entry has characters
    seen = globs.select("glob_side", F.length("glob_key").alias("n")).distinct().collect()
    lengths = {side: sorted(r["n"] for r in seen if r["glob_side"] == side) for side in ("prefix", "suffix", "inner")}
    values = findings.select("value").distinct()
    asked = values.select("value", F.inline(glob_parts(F.col("value"), lengths)))
    hit = (asked.join(globs, ["glob_side", "glob_key"]).where(F.expr(r"value RLIKE concat('(?i)^(?:', glob_regex, ')\\z')"))
           .select("value").distinct())
    return findings.join(hit, "value", "left_semi")


def match_rules(findings: DataFrame, rules: DataFrame, key_cols: list[str]) -> DataFrame:
    """A3-A5: findings (key_cols…, type, value) that some rule allows.

    Returns key rows with the matching rule kind. Domains, CIDR blocks and globs
    are equi-joins, so they scale with both sides.
    """
    keys = key_cols
    dom_rules = rules.where("kind = 'domain'").select("domain").distinct()
    emails = (findings.where("type = 'email'")
              .select(*keys, F.explode(domain_suffixes(F.col("value"))).alias("domain")))
    by_domain = emails.join(dom_rules, "domain", "left_semi").select(*keys).withColumn("rule_kind", F.lit("domain"))

    cidr_rules = rules.where("kind = 'cidr'").select("net", "prefix_len").distinct()
    # Prefix lengths are 0..32, so this list is bounded by 33 by construction.
    lengths = sorted(r[0] for r in cidr_rules.select("prefix_len").distinct().collect())
    ips = findings.where("type = 'ip'").withColumn("ip_int", ip_to_int(F.col("value"))).where("ip_int IS NOT NULL")
    masked = (ips.withColumn("prefix_len", F.explode(F.array(*[F.lit(n) for n in lengths] or [F.lit(None).cast("int")])))
              .withColumn("net", F.col("ip_int").bitwiseAND(prefix_mask(F.col("prefix_len")))))
    by_cidr = masked.join(cidr_rules, ["net", "prefix_len"], "left_semi").select(*keys).withColumn("rule_kind", F.lit("cidr"))

    by_glob = (match_globs(findings, rules.where("kind = 'glob'").select("glob_side", "glob_key", "glob_regex"))
               .select(*keys).withColumn("rule_kind", F.lit("glob")))
    return by_domain.unionByName(by_cidr).unionByName(by_glob)


# ---------------------------------------------------------------------------
# Rules of their owner only (A4 / A6 per host)
# ---------------------------------------------------------------------------

IP_CHUNK = 1 << 17  # two numbers an address, so a chunk of the running lookup is a /16


def merged_ranges(rules: DataFrame) -> DataFrame:
    """(host, lo, hi): each host's address blocks merged to disjoint, not even touching ranges."""
    size = F.pow(F.lit(2), F.lit(32) - F.col("prefix_len")).cast("bigint")
    blocks = rules.where("kind = 'cidr'").select("host", F.col("net").alias("lo"), (F.col("net") + size - 1).alias("hi")).distinct()
    by_start = Window.partitionBy("host").orderBy("lo", "hi")
    reached = F.max("hi").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.withColumn("new", F.coalesce((F.col("lo") > reached + 1).cast("int"), F.lit(1)))
    island = F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    return starts.withColumn("island", island).groupBy("host", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def addresses_in_ranges(asked: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows (host, ip_int) of `asked` that lie in a range of their host. As ranges are disjoint,
    only the last one that starts at or before an address can hold it: ranges and addresses are put
    in one order and the range's end is carried forward, in chunks of the address space, so a host
    with a third of all findings is no single task."""
    none = F.lit(None).cast("bigint")
    line = (ranges.select("host", (F.col("lo") * 2).alias("at"), F.col("hi").alias("hi"), none.alias("ip_int"))
            .unionByName(asked.distinct().select("host", (F.col("ip_int") * 2 + 1).alias("at"), none.alias("hi"), "ip_int")))
    held = running(line, ["host"], "at", [("until", "last", F.col("hi"), True)], span=IP_CHUNK, materialize=False)
    return held.where(F.col("ip_int") <= F.col("until")).select("host", "ip_int")


def match_host_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, type, value) of `findings` that a rule of the same host allows."""
    asked = findings.select("host", "type", "value").distinct()
    domains = rules.where("kind = 'domain'").select("host", "domain").distinct()
    by_domain = (asked.where("type = 'email'").select("*", F.explode(domain_suffixes(F.col("value"))).alias("domain"))
                 .join(domains, ["host", "domain"], "left_semi").select("host", "type", "value"))
    ips = asked.where("type = 'ip'").withColumn("ip_int", ip_to_int(F.col("value"))).where("ip_int IS NOT NULL")
    by_range = ips.join(addresses_in_ranges(ips.select("host", "ip_int"), merged_ranges(rules)), ["host", "ip_int"], "left_semi").select("host", "type", "value")
    globs = rules.where("kind = 'glob'").select("host", "glob_side", "glob_key", "glob_regex").distinct()
    # at most as many lengths a side as the longest entry has characters
    seen = globs.select("glob_side", F.length("glob_key").alias("n")).distinct().collect()
    lengths = {side: sorted(r["n"] for r in seen if r["glob_side"] == side) for side in ("prefix", "suffix", "inner")}
    by_glob = (asked.select("*", F.inline(glob_parts(F.col("value"), lengths))).join(globs, ["host", "glob_side", "glob_key"])
               .where(F.expr(r"value RLIKE concat('(?i)^(?:', glob_regex, ')\\z')")).select("host", "type", "value"))
    return by_domain.unionByName(by_range).unionByName(by_glob).distinct()


def default_allowed(typ: Column, value: Column) -> Column:
    """The built-in entries (a short fixed list), for a value of any type."""
    rules = compile_rules()
    out = F.lit(False)
    for t in (t[0] for t in seeds.PII_TYPES):
        if allow_applies(rules, t):
            out = F.when(typ == t, allowed(rules, t, value)).otherwise(out)
    return out


def split_by_host(findings: DataFrame, rules: DataFrame, opted_out: DataFrame) -> DataFrame:
    """Findings (host, type, value, …) with `allowed`: a rule of the same host, or a built-in
    entry unless the host is among `opted_out`."""
    own = match_host_rules(findings, rules).withColumn("own", F.lit(True))
    out = findings.join(own, ["host", "type", "value"], "left").join(opted_out.select("host").distinct().withColumn("out", F.lit(True)), "host", "left")
    default = F.col("out").isNull() & F.coalesce(default_allowed(F.col("type"), F.col("value")), F.lit(False))
    return out.withColumn("allowed", F.coalesce("own", F.lit(False)) | default).drop("own", "out")
