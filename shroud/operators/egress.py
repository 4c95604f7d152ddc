"""Tool-call egress assessment as Column expressions (no UDF, no shuffle).

A call is judged from its own row: shell lines are split into segments, URLs
extracted per segment, hosts parsed the way a WHATWG URL parser reads them
(lower-cased, userinfo and port stripped, numeric IPv4 forms normalised), and
each segment decides egress independently. Sensitive-file references are read
over the whole line, but only for a call already judged to be egress.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import seeds
from ..functions.regex import JS_SPACE, to_java

URL_JAVA = to_java(seeds.URL_RE)
EGRESS_JAVA = to_java(seeds.EGRESS_CMD)
SEGMENT_JAVA = seeds.SEGMENT_SPLIT
FILES_JAVA = [(label, "(?i)" + to_java(p)) for label, p in seeds.SENSITIVE_FILES]
TRIM_JS = f"^[{JS_SPACE}]+|[{JS_SPACE}]+$"

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#\\]*@)?(\[[^\]]*\]|[^/:?#\\]*)(?::([^/?#\\]*))?(?:[/?#\\]|$)"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, TRIM_JS, "")


def let(value: Column, body) -> Column:
    """Bind `value` once and pass it to `body` as a lambda variable.

    Inside higher-order functions Catalyst cannot share common subexpressions, so
    a value used several times would be re-inlined (and re-evaluated) at every
    use; binding keeps the expression tree linear in the source size.
    """
    return F.get(F.transform(F.array(value), body), 0)


def _num_part(p: Column) -> Column:
    """One IPv4 number part in WHATWG reading: 0x hex, leading-0 octal, decimal."""
    return (F.when(p.rlike(r"^0[xX][0-9A-Fa-f]*$"),
                   F.when(F.length(p) == 2, F.lit(0.0)).otherwise(F.conv(F.substring(p, 3, 64), 16, 10).cast("double")))
            .when(p.rlike(r"^0[0-7]+$"), F.conv(p, 8, 10).cast("double"))
            .when(p.rlike(r"^[0-9]+$"), p.cast("double")))


def _labels(host: Column) -> Column:
    return let(F.split(host, r"\.", -1), lambda raw: F.when(
        (F.size(raw) > 1) & (F.element_at(raw, -1) == ""), F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw))


def ipv4_value(host: Column) -> Column:
    """BIGINT value of a numeric host; NULL for a domain name; -1 for a host that
    ends in a number but is not a valid IPv4 address (the URL fails to parse)."""
    def with_vals(labels, vals):
        n = F.size(labels)
        head = F.slice(vals, 1, F.greatest(n - 1, F.lit(0)))
        last = F.element_at(labels, -1)
        ends_num = last.rlike(r"^[0-9]+$") | last.rlike(r"^0[xX][0-9A-Fa-f]*$")
        bad = ((n > 4) | F.exists(vals, lambda v: v.isNull()) | F.exists(head, lambda v: v > 255)
               | (F.element_at(vals, -1) >= F.pow(F.lit(256), F.lit(5) - n)))
        total = F.aggregate(head, F.lit(0.0), lambda acc, v: acc * 256 + v)
        value = total * F.pow(F.lit(256), F.lit(5) - n) + F.element_at(vals, -1)
        return (F.when(~ends_num, F.lit(None).cast("bigint")).when(bad, F.lit(-1).cast("bigint"))
                .otherwise(value.cast("bigint")))
    return let(_labels(host), lambda labels: let(F.transform(labels, _num_part), lambda vals: with_vals(labels, vals)))


def _host_from(ok: Column, h: Column, port: Column) -> Column:
    port_ok = (port == "") | (port.rlike(r"^[0-9]+$") & (port.cast("double") <= 65535))

    def pick(v4):
        dotted = F.concat_ws(".", *[F.shiftright(v4, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
        norm = F.when(h.startswith("[") | v4.isNull(), h).when(v4 >= 0, dotted)
        return F.when(ok & port_ok & (h != "") & norm.isNotNull(), norm)
    return let(ipv4_value(h), pick)


def url_host(u: Column) -> Column:
    """Hostname as a URL parser reports it, or NULL when the URL does not parse."""
    parts = F.struct(u.rlike(AUTHORITY).alias("ok"), F.lower(F.regexp_extract(u, AUTHORITY, 1)).alias("h"),
                     F.regexp_extract(u, AUTHORITY, 2).alias("port"))
    return let(parts, lambda r: _host_from(r["ok"], r["h"], r["port"]))


def _dotted_v4(v4: Column) -> Column:
    m = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"
    octs = [F.regexp_extract(v4, m, k).cast("int") for k in (1, 2, 3, 4)]
    valid = v4.rlike(m) & (F.greatest(*octs) <= 255)
    return valid & ((octs[0] == 127) | (v4 == "0.0.0.0"))


def ipv6_words(host: Column) -> Column:
    """An IPv6 literal (brackets and zone removed) as its 8 16-bit words, or NULL
    when it is not a valid literal. A dotted IPv4 tail becomes two words."""
    dotted = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"

    def with_tail(last):
        o = [F.regexp_extract(last, dotted, k).cast("int") for k in (1, 2, 3, 4)]
        ok = last.rlike(dotted) & (F.greatest(*o) <= 255)
        hexes = F.concat(F.lower(F.hex(o[0] * 256 + o[1])), F.lit(":"), F.lower(F.hex(o[2] * 256 + o[3])))
        return (F.when(~last.contains("."), host)
                .when(ok, F.concat(F.substring(host, F.lit(1), F.length(host) - F.length(last)), hexes)))

    def from_parts(parts):
        head = F.when(F.get(parts, 0) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(parts, 0), ":", -1))
        tail = F.when(F.size(parts) == 2, F.when(F.get(parts, 1) == "", F.array().cast("array<string>"))
                      .otherwise(F.split(F.get(parts, 1), ":", -1))).otherwise(F.array().cast("array<string>"))
        n = F.size(head) + F.size(tail)
        fill = F.when(F.size(parts) == 2, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - n, F.lit(0)))).otherwise(
            F.array().cast("array<string>"))
        words = F.concat(head, fill, tail)
        valid = ((((F.size(parts) == 1) & (n == 8)) | ((F.size(parts) == 2) & (n <= 7)))
                 & F.forall(words, lambda g: g.rlike("^[0-9a-f]{1,4}$")))
        return F.when(valid, F.transform(words, lambda g: F.conv(g, 16, 10).cast("int")))
    h2 = let(F.substring_index(host, ":", -1), with_tail)
    return let(F.split(h2, "::", -1), from_parts)


def _local_v6(w: Column) -> Column:
    """::1, ::, or IPv4-mapped (::ffff:a.b.c.d) of 127/8 or 0.0.0.0."""
    zeros5 = F.forall(F.slice(w, 1, 5), lambda x: x == 0)
    loop = zeros5 & (F.get(w, 5) == 0) & (F.get(w, 6) == 0) & (F.get(w, 7).isin(0, 1))
    mapped = zeros5 & (F.get(w, 5) == 65535) & ((F.shiftright(F.get(w, 6), 8) == 127)
                                               | ((F.get(w, 6) == 0) & (F.get(w, 7) == 0)))
    return F.coalesce(loop | mapped, F.lit(False))


def local_host(h: Column) -> Column:
    """Loopback test on a parsed host (NULL host = unparseable URL = remote)."""
    def judge(host):
        return F.coalesce(
            F.when(h.isNull(), F.lit(False))
            .when((host == "localhost") | host.endswith(".localhost"), F.lit(True))
            .when(host.contains(":"), let(ipv6_words(host), _local_v6))
            .otherwise(let(host, _dotted_v4)), F.lit(False))
    inner = F.when(h.startswith("[") & h.endswith("]"), F.substring(h, F.lit(2), F.length(h) - 2)).otherwise(h)
    return let(F.substring_index(inner, "%", 1), judge)


def is_local_url(u: Column) -> Column:
    """Loopback only: localhost / *.localhost, ::1, ::, 127.0.0.0/8, 0.0.0.0 and
    their IPv4-mapped IPv6 forms. LAN and `.local` names are remote."""
    return let(url_host(u), local_host)


def urls(text: Column) -> Column:
    """http(s) URLs in the text; the regex only runs where `://` occurs."""
    return F.when(text.contains("://"), F.regexp_extract_all(text, F.lit(URL_JAVA), 0)).otherwise(
        F.array().cast("array<string>"))


def first_remote_of(us: Column) -> Column:
    return F.get(F.filter(us, lambda u: ~is_local_url(u)), 0)


def first_remote(text: Column) -> Column:
    return first_remote_of(urls(text))


def segments(cmd: Column) -> Column:
    """Shell line split on `||`, `&&`, `;`, `|`, newline; trimmed; empties dropped."""
    return F.filter(F.transform(F.split(cmd, SEGMENT_JAVA, -1), js_trim), lambda s: s != "")


def segment_verdict(seg: Column) -> Column:
    """STRUCT<e: segment is egress, r: its first remote URL>."""
    def judge(us):
        return let(first_remote_of(us), lambda r: F.struct(
            (r.isNotNull() | ((F.size(us) == 0) & seg.rlike(EGRESS_JAVA))).alias("e"), r.alias("r")))
    return let(urls(seg), judge)


def sensitive_files(text: Column) -> Column:
    labels = [F.when(text.rlike(p), F.lit(label)) for label, p in FILES_JAVA]
    return F.filter(F.array(*labels), lambda x: x.isNotNull())


def assess(tool: Column, input_json: Column) -> Column:
    """STRUCT<egress BOOLEAN, target STRING, sensitive_files ARRAY<STRING>>."""
    text = input_json
    cmd = F.coalesce(F.get_json_object(input_json, "$.command"), text)
    segs = segments(cmd)
    seg_eg = F.transform(segs, segment_verdict)
    bash_egress = F.exists(seg_eg, lambda x: x["e"])
    bash_target = F.get(F.filter(F.transform(F.filter(seg_eg, lambda x: x["e"]), lambda x: x["r"]),
                                 lambda r: r.isNotNull()), 0)
    bash_files = F.when(bash_egress, sensitive_files(cmd))
    other_remote = first_remote(text)
    other_files = F.when(other_remote.isNotNull(), sensitive_files(text))
    local = tool.isin(*seeds.LOCAL_TOOLS)
    is_bash = tool == "bash"
    egress = F.when(local, F.lit(False)).when(is_bash, bash_egress).otherwise(other_remote.isNotNull())
    target = F.when(local, F.lit(None)).when(is_bash, bash_target).otherwise(other_remote)
    files = F.when(local, F.lit(None)).when(is_bash, bash_files).otherwise(other_files)
    files = F.when(F.size(files) > 0, files)
    return F.struct(egress.alias("egress"), target.alias("target"), files.alias("sensitive_files"))
