"""Pattern dialects.

Patterns are written once in JavaScript/RE2 notation (see ``seeds``). Two
engines have to agree on them:

* DuckDB (RE2): ``\\b`` is already an ASCII word boundary; only ``\\s`` must be
  widened to the JavaScript whitespace set.
* Spark (java.util.regex on Java 17): ``\\b`` is Unicode-aware, so ``é123`` would
  hide a number that the JavaScript reading sees. Every ``\\b`` is rewritten to
  an ASCII boundary built from look-arounds. Where the neighbouring atom can only
  be a word character, the one-sided form is enough and much cheaper.
"""

from __future__ import annotations

import re

WORD = "[A-Za-z0-9_]"
NOT_BEFORE = f"(?<!{WORD})"
NOT_AFTER = f"(?!{WORD})"
FULL_BOUNDARY = f"(?:(?={WORD})(?<!{WORD})|(?!{WORD})(?<={WORD}))"  # the cheaper look ahead comes first

# The JavaScript `\s` set, spelled out so that Java, RE2 and JS read it alike.
JS_SPACE = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

_ANY = "\u0000ANYCHAR\u0000"


def _widen_space(p: str) -> str:
    p = p.replace(r"[\s\S]", _ANY)
    out, i, in_class = [], 0, False
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            tok = p[i:i + 2]
            if tok == r"\s":
                out.append(JS_SPACE if in_class else f"[{JS_SPACE}]")
            else:
                out.append(tok)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out).replace(_ANY, r"[\s\S]")


def _class_is_word_only(body: str) -> bool:
    if body.startswith("^") or body.startswith("-") or body.endswith("-"):
        return False
    i = 0
    while i < len(body):
        if body[i] == "\\":
            if body[i:i + 2] not in (r"\d", r"\w"):
                return False
            i += 2
            continue
        if i + 2 < len(body) and body[i + 1] == "-":
            lo, hi = body[i], body[i + 2]
            if not any(a <= lo and hi <= b for a, b in (("0", "9"), ("A", "Z"), ("a", "z"))):
                return False
            i += 3
            continue
        if not re.fullmatch(WORD, body[i]):
            return False
        i += 1
    return True


_QUANT = re.compile(r"(\{(\d+)(,\d*)?\}|[+*?])$")


def _atom_word_only(atom: str) -> bool:
    if atom in (r"\d", r"\w"):
        return True
    if atom.startswith("[") and atom.endswith("]"):
        return _class_is_word_only(atom[1:-1])
    return len(atom) == 1 and re.fullmatch(WORD, atom) is not None


def _leading_atom(rest: str) -> str | None:
    m = re.match(r"(\\[dw]|\[[^\]]*\]|[A-Za-z0-9_])([+*?]|\{\d+(,\d*)?\})?", rest)
    if not m:
        return None
    quant = m.group(2) or ""
    if quant in ("*", "?") or quant.startswith("{0"):
        return None
    return m.group(1)


def _trailing_atom(head: str) -> str | None:
    quant = ""
    m = _QUANT.search(head)
    if m:
        quant = m.group(0)
        head = head[: m.start()]
        if quant in ("*", "?") or quant.startswith("{0"):
            return None
    m = re.search(r"(\\[dw]|\[[^\]]*\]|[A-Za-z0-9_])$", head)
    if not m or (m.group(1).startswith("[") is False and head.endswith("\\" + m.group(1))):
        return None
    return m.group(1)


def to_java(p: str) -> str:
    """JavaScript/RE2 notation to java.util.regex with ASCII word boundaries."""
    p = _widen_space(p)
    prefix = ""
    if p.startswith("(?i)"):
        prefix, p = "(?i)", p[4:]
    out, i = [], 0
    while i < len(p):
        if p.startswith(r"\\", i):
            out.append(r"\\")
            i += 2
            continue
        if p.startswith(r"\b", i):
            head, rest = "".join(out), p[i + 2:]
            if i == 0 and (a := _leading_atom(rest)) and _atom_word_only(a):
                out.append(NOT_BEFORE)
            elif i + 2 == len(p) and (a := _trailing_atom(head)) and _atom_word_only(a):
                out.append(NOT_AFTER)
            else:
                out.append(FULL_BOUNDARY)
            i += 2
            continue
        if p[i] == "\\" and i + 1 < len(p):
            out.append(p[i:i + 2])
            i += 2
            continue
        out.append(p[i])
        i += 1
    return prefix + "".join(out)


def to_re2(p: str) -> str:
    """JavaScript notation to RE2 (DuckDB): only the whitespace set changes."""
    return _widen_space(p)


def sql_str(s: str) -> str:
    """A SQL string literal (standard quoting, no backslash escapes)."""
    return "'" + s.replace("'", "''") + "'"
