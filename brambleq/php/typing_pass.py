"""The pass that types a file: its source and the signatures that its names reach, to findings and types."""

from __future__ import annotations

import pyarrow as pa

from brambleq.functions.types import NEVER, VOID, render, widen
from brambleq.php.extract import SCHEMA, Rows
from brambleq.php.knowledge import Known, describe
from brambleq.php.model import File, lower
from brambleq.php.rules_declared import TYPED_RULES
from brambleq.php.rules_flow import Typed, _calls
from brambleq.php.rules_local import Options


def typed_rows(path: str, ord_: int, source: bytes, known: list[tuple], options: Options, want: frozenset[str], base: int) -> list[dict]:
    """``rel`` is ``finding`` (``alt``: the rule's number, from ``base``), ``return`` (a body's inferred type by
    function or method, where none is declared), ``arg`` (what a call hands to a parameter without a type) and, if wanted, ``type`` (an expression's)."""
    f = File(path, source)
    x = Typed(f, Known([*known, *describe(f)]), options)
    out = Rows(f, ord_)
    for k, r in enumerate(TYPED_RULES):
        if r.level <= options.level:
            for at, code, message in r.run(x):
                out.add("finding", at, None, code, None, r.name, str(base + k))
                out.rows[-1]["name"] = message
    for n, sig, label in _calls(x):
        if all(a.kind == "arg" and not a.spread and not a.name for a in n.args):
            for i, (a, p) in enumerate(zip(n.args, sig["p"], strict=False)):
                if not p[3] and not sig.get("told", [q[1] is not None for q in sig["p"]])[i]:
                    key, member = (lower(sig["of"]), lower(sig["name"])) if "of" in sig else (lower(sig["name"]), None)
                    out.add("arg", a, member, key, None, None, str(i), [render(widen(x.of(a.value)))])
    for flow in x.flows:
        s = flow.scope
        if s.kind in ("function", "method") and s.node.get("returns") is None:
            t = flow.returned()
            if t is not None:
                out.add("return", s.node, s.name, lower(s.cls.fqn if s.cls else s.name), s.cls.fqn if s.cls else None, s.kind, None, [render(t if t in (VOID, NEVER) else widen(t))])
    if "type" in want:
        for kind, nodes in f.by_kind.items():
            for n, s in nodes:
                if id(n) in x.types:
                    name = n.get("name") if isinstance(n.get("name"), str) else n.get("op")
                    out.add("type", n, name, None, s.cls.fqn if s.cls else None, kind, s.name, [render(x.types[id(n)])])
    return out.rows


def worker(options: Options, want: frozenset[str], base: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[dict] = []
        known = [(r["what"], r["key"], r["member"], r["data"]) for r in right.to_pylist()]
        for r in left.to_pylist():
            rows += typed_rows(r["path"], r["ord"], bytes(r["source"] or b""), known, options, want, base)
        return pa.Table.from_pylist(rows, SCHEMA)

    return run
