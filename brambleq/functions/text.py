"""Column expressions on text: lines, byte columns, globs, canonical keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def canonical(c: Column, kind: Column | str = "class") -> Column:
    """Key under which a symbol is looked up: no leading separator; ASCII case is
    ignored except for constants."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    name = F.ltrim(c, F.lit("\\"))
    return F.when(kind == "constant", name).otherwise(ascii_lower(name))


def lines(text: Column) -> Column:
    """Only a line feed ends a line."""
    return F.split(text, "\n", -1)


def byte_column(line: Column, needle: str) -> Column:
    """1-based byte column of the first ``needle`` in ``line``; null if absent."""
    at = F.instr(line, needle)
    return F.when(at > 0, F.octet_length(F.substring(line, F.lit(1), at - 1)) + 1).cast("int")


def line_of(text: Column, byte_offset: Column) -> Column:
    """1-based line of a byte offset."""
    head = F.substring(F.encode(text, "UTF-8"), F.lit(1), byte_offset.cast("int"))
    return (F.length(head) - F.length(F.replace(F.decode(head, "ISO-8859-1"), F.lit("\n"), F.lit(""))) + 1).cast("int")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a path pattern.

    ``**/`` is any number of folders, ``**`` anything, ``*`` anything within a
    segment, ``?`` one character but a slash.  A pattern without wildcards also
    covers what lies below it, and without a slash it matches at any depth.
    """
    p = pattern[2:] if pattern.startswith("./") else pattern
    p = p.rstrip("/") or p
    if not set(p) & set("*?"):
        head = "" if "/" in p else "(?:.*/)?"
        return f"^{head}{re.escape(p)}(?:/.*)?$"
    out, i = [], 0
    while i < len(p):
        if p.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif p.startswith("**", i):
            out.append(".*")
            i += 2
        elif p[i] == "*":
            out.append("[^/]*")
            i += 1
        elif p[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(p[i]))
            i += 1
    return "^" + "".join(out) + "$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """One alternation, compiled once per query."""
    return path.rlike("|".join(glob_regex(p) for p in patterns)) if patterns else F.lit(False)
