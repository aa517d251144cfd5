"""Run configuration and baselines: a subset of YAML and of NEON, read and written on the driver."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field, fields

from brambleq.php.rules_local import Options


@dataclass
class Config:
    """Keys have the names that configuration files use."""

    paths: list = field(default_factory=list)
    scanFiles: list = field(default_factory=list)
    scanDirectories: list = field(default_factory=list)
    stubFiles: list = field(default_factory=list)
    excludePaths: list = field(default_factory=list)
    analyseOnlyExcludes: list = field(default_factory=list)
    level: int = 5
    phpVersion: int = 80400
    ignoreErrors: list = field(default_factory=list)
    reportUnmatchedIgnoredErrors: bool = True
    checkNullables: bool | None = None
    reportMaybes: bool | None = None
    checkExplicitMixed: bool | None = None
    checkImplicitMixed: bool | None = None
    checkThisOnly: bool | None = None
    earlyTerminatingFunctionCalls: list = field(default_factory=list)
    earlyTerminatingMethodCalls: dict = field(default_factory=dict)
    typeAliases: dict = field(default_factory=dict)
    universalObjectCratesClasses: list = field(default_factory=list)
    inferUntyped: bool = True
    editorUrl: str | None = None
    errorFormat: str = "table"
    warnings: list = field(default_factory=list)

    def gates(self) -> dict[str, bool]:
        """Strictness flags: those set win, the level gives the others."""
        lv = self.level
        given = {"reportMaybes": lv >= 7, "checkNullables": lv >= 8, "checkExplicitMixed": lv >= 9, "checkImplicitMixed": lv >= 10, "checkThisOnly": lv < 2}
        return {k: v if getattr(self, k) is None else getattr(self, k) for k, v in given.items()}

    def options(self) -> Options:
        return Options(level=self.level, php=self.phpVersion)


def read(text: str) -> Config:
    """A configuration; unknown keys are warned of, with the nearest known key."""
    data = parse(text)
    data = data.get("parameters", data) if isinstance(data, dict) else {}
    known = {f.name for f in fields(Config)} - {"warnings"}
    out = Config()
    for k, v in data.items():
        if k in known:
            if k == "level" and v == "max":
                v = 10
            if k == "excludePaths" and isinstance(v, dict):
                out.analyseOnlyExcludes = list(v.get("analyse") or [])
                v = list(v.get("analyseAndScan") or [])
            setattr(out, k, v)
        else:
            near = difflib.get_close_matches(k, known, 1)
            out.warnings.append(f"Unknown key '{k}'" + (f", did you mean '{near[0]}'?" if near else "."))
    return out


def _scalar(s: str):
    s = s.strip()
    if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
        body = s[1:-1]
        return body.replace("''", "'") if s[0] == "'" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), body)
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in re.findall(r"(?:'[^']*'|\"[^\"]*\"|[^,\[\]])+", s[1:-1]) if x.strip()]
    low = s.lower()
    if low in ("true", "yes", "on", "false", "no", "off"):
        return low in ("true", "yes", "on")
    if low in ("null", "~", ""):
        return None
    return int(s) if re.fullmatch(r"-?\d+", s) else s


def parse(text: str):
    """Nested maps and lists by indentation, scalars, inline lists and comments."""
    rows = []
    for raw in text.split("\n"):
        line = raw.replace("\t", "    ").rstrip()
        body = re.sub(r"(^|\s)#(?=([^'\"]|'[^']*'|\"[^\"]*\")*$).*$", "", line).rstrip()
        if body.strip():
            rows.append((len(body) - len(body.lstrip()), body.strip()))
    value, _ = _block(rows, 0, -1)
    return value if value is not None else {}


def _block(rows, i: int, above: int):
    if i >= len(rows) or rows[i][0] <= above:
        return None, i
    depth = rows[i][0]
    out: list | dict = [] if rows[i][1].startswith("-") else {}
    while i < len(rows) and rows[i][0] == depth:
        body = rows[i][1]
        if body.startswith("-") and isinstance(out, list):
            rest = body[1:].strip()
            if not rest:
                v, i = _block(rows, i + 1, depth)
            elif m := re.match(r"([\w.]+):(?:\s+(.*))?$", rest):
                rows[i] = (depth + 2, rest)
                v, i = _block(rows, i, depth)
            else:
                v, i = _scalar(rest), i + 1
            out.append(v)
        elif (m := re.match(r"('[^']*'|\"[^\"]*\"|[^:\s]+)\s*[:=](?:\s+(.*))?$", body)) and isinstance(out, dict):
            key = str(_scalar(m[1]))
            if m[2]:
                out[key], i = _scalar(m[2]), i + 1
            else:
                j = i + 1
                if j < len(rows) and rows[j][0] == depth and rows[j][1].startswith("-"):
                    rows_in = [(d + 1 if d >= depth and k >= j else d, b) for k, (d, b) in enumerate(rows)]
                    end = j
                    while end < len(rows) and (rows[end][0] > depth or rows[end][0] == depth and rows[end][1].startswith("-")):
                        end += 1
                    out[key], _ = _block(rows_in[:end], j, depth)
                    i = end
                else:
                    out[key], i = _block(rows, j, depth)
        else:
            i += 1
    return out, i


def ignores(entries: list) -> list[dict]:
    """Ignore entries in one shape: (ord, path, message, identifier, count), an entry's
    lists multiplied out; empty entries and broken patterns are left out."""
    from brambleq.functions.text import glob_regex

    out = []
    for k, e in enumerate(entries):
        e = {"message": e} if isinstance(e, str) else e or {}
        messages = [strip_delimiters(m) for m in [e.get("message"), *(e.get("messages") or [])] if m] + [f"^{re.escape(m)}$" for m in [e.get("rawMessage"), *(e.get("rawMessages") or [])] if m]
        ids = [x for x in [e.get("identifier"), *(e.get("identifiers") or [])] if x]
        paths = [glob_regex(p) for p in [e.get("path"), *(e.get("paths") or [])] if p]
        if not (messages or ids or paths):
            continue
        try:
            for m in messages:
                re.compile(m)
        except re.error:
            continue
        out += [{"ord": k, "path": p, "message": m, "identifier": i, "count": e.get("count")} for p in paths or [None] for m in messages or [None] for i in ids or [None]]
    return out


def strip_delimiters(pattern: str) -> str:
    """The inside of a delimited pattern such as ``#^text$#``."""
    if len(pattern) > 1 and not pattern[0].isalnum() and pattern[0] not in "^\\(" and pattern.rfind(pattern[0]) > 0:
        return pattern[1 : pattern.rfind(pattern[0])]
    return pattern


def write_baseline(rows: list, neon: bool = True) -> str:
    """A baseline of (path, message pattern, identifier, count) rows, by path, message, identifier."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = ["parameters:", "    ignoreErrors:"] if neon else ["ignoreErrors:"]
    pad = "        " if neon else "  "
    for path, message, identifier, count in sorted(rows):
        out.append(f"{pad}-")
        out += [f"{pad}    {k}: {v}" for k, v in (("message", quote(f"#{message}#")), ("identifier", identifier), ("count", count), ("path", path))]
    return "\n".join(out) + "\n"
