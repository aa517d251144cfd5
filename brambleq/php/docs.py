"""Docblocks: tags, their types, and the priority of tool prefixes."""

from __future__ import annotations

import re

_TAG = re.compile(r"@([A-Za-z][\w\\-]*)[ \t]*(.*?)(?=\n\s*@[A-Za-z]|\Z)", re.DOTALL)
PRIORITY = {"phpstan": 2, "psalm": 1}


def lines(doc: str) -> str:
    body = doc[3:-2] if doc.endswith("*/") else doc[3:]
    return "\n".join(re.sub(r"^[ \t]*\*?[ \t]?", "", x) for x in body.split("\n"))


def tags(doc: str | None) -> list[tuple[str, int, str, str | None]]:
    """(tag without prefix, priority, type text, variable or None) in order."""
    out = []
    for m in _TAG.finditer(lines(doc)) if doc else ():
        name, rest = m[1], " ".join(m[2].split())
        prefix, _, bare = name.partition("-")
        prio = PRIORITY.get(prefix, 0)
        name = bare if prio else name
        kind, end = type_text(rest)
        var = re.match(r"\s*(?:&|\.\.\.)*\$(\w+)", rest[end:])
        out.append((name, prio, kind, var[1] if var else None))
    return out


def type_text(s: str) -> tuple[str, int]:
    """The type at the start of ``s``: up to a blank outside brackets that no operator follows."""
    depth, i = 0, 0
    while i < len(s):
        c = s[i]
        if c in "<({[":
            depth += 1
        elif c in ">)}]":
            depth -= 1
        elif c == " " and depth <= 0:
            after = s[i + 1 : i + 2]
            before = s[i - 1 : i]
            if after not in ("|", "&") and before not in ("|", "&", ",", ":") and not re.match(r" (?:is|\?|:) ", s[i:]):
                break
        elif c == "$" and depth <= 0 and i == 0:
            break
        i += 1
    return s[:i].strip(), i


def best(found: list[tuple[str, int, str, str | None]], tag: str, var: str | None = None) -> str | None:
    """Type of the tag of highest priority, the first among equals."""
    rows = [t for t in found if t[0] == tag and (var is None or t[3] == var)]
    return max(rows, key=lambda t: t[1])[2] if rows else None
