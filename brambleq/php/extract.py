"""Everything that one pass over a file yields, as rows of one wide relation.

``rel`` names the relation: ``decl``, ``edge``, ``member``, ``import``, ``ref``,
``access``, ``doc``, ``marker``, ``finding``, ``error``, ``file``, the fact views and, if
asked for, ``node`` and ``token``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

from brambleq.php.ast import Node, peel, walk_scope
from brambleq.php.docs import tags
from brambleq.php.knowledge import describe, mentions
from brambleq.php.lexer import tokenize
from brambleq.php.model import ClassInfo, File, lower, render_hint, utf8
from brambleq.php.rules_local import RULES, Options

SCHEMA = pa.schema(
    [("path", pa.string()), ("ord", pa.int32()), ("rel", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("name", pa.string()), ("key", pa.string()), ("owner", pa.string()), ("res", pa.string()), ("alt", pa.string()), ("args", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string()))]
)
DDL = "path string, ord int, rel string, start int, end int, line int, col int, name string, key string, owner string, res string, alt string, args array<string>, attrs map<string,string>"

#: Fact views of expressions and statements: node kinds of each.
VIEWS = {
    "function_calls": ("call",), "method_calls": ("mcall",), "static_calls": ("scall",), "property_fetches": ("prop",), "class_consts": ("cconst",), "indexes": ("index",), "binaries": ("bin",), "unaries": ("unary",), "casts": ("cast",), "prints": ("print",), "arrays": ("array",), "assignments": ("assign", "assignop", "assignref"), "news": ("new",), "clones": ("clone",), "echoes": ("echo",), "foreaches": ("foreach",), "issets": ("isset",), "empties": ("empty",),
}
STATEMENTS = {"expr", "echo", "return", "block", "if", "while", "dowhile", "for", "foreach", "switch", "try", "break", "continue", "goto", "label", "global", "static", "unset", "declare", "namespace", "use", "function", "class", "const", "halt", "html", "nop", "error"}
_PARTS = {"arg", "item", "hole", "param", "case", "catch", "finally", "staticvar", "useitem", "constitem", "propitem", "method", "property", "classconst", "enumcase", "traituse", "insteadof", "traitalias", "attribute", "hook", "arm", "closureuse", "directive", "name", "nullable", "union", "intersection", "anonclass", "placeholder", "file"}


class Rows:
    def __init__(self, f: File, ord_: int) -> None:
        self.f, self.ord, self.rows = f, ord_, []

    def add(self, rel: str, n: Node | int, name=None, key=None, owner=None, res=None, alt=None, args=None, **attrs) -> None:
        start, end = (n.start, n.end) if isinstance(n, Node) else (n, n)
        line, col = self.f.location(start)
        text = lambda s: None if s is None else utf8(str(s))
        self.rows.append({"path": self.f.path, "ord": self.ord, "rel": rel, "start": start, "end": end, "line": line, "col": col, "name": text(name), "key": text(key), "owner": text(owner), "res": res, "alt": text(alt), "args": None if args is None else [text(a) for a in args], "attrs": [(k, text(v)) for k, v in attrs.items() if v is not None] or None})


def visibility(mods) -> str:
    return next((m for m in mods if m in ("public", "protected", "private")), "public")


def arity(params: list[Node]) -> tuple[int, str]:
    """Least number of arguments, and the most or ``*``."""
    need = 0
    for k, p in enumerate(params):
        if p.default is None and not p.variadic:
            need = k + 1
    return need, "*" if any(p.variadic for p in params) else str(len(params))


def declarations(f: File, out: Rows) -> None:
    for c in f.classes:
        key = lower(c.fqn)
        own = c.node.kind == "class"
        if own:
            out.add("decl", c.node, c.fqn, key, None, "class", c.what, final="1" if "final" in c.mods else None, abstract="1" if "abstract" in c.mods or c.what in ("interface", "trait") else None)
        edges = [("trait", t) for t in c.traits] + ([("parent", c.parent)] if c.parent else []) + [("interface", i) for i in c.interfaces] + [("mixin", f_mixin(c, t[2])) for t in tags(c.node.get("doc")) if t[0] == "mixin" and re.fullmatch(r"[\\\w]+", t[2])]
        if c.what == "enum":
            edges.append(("interface", "BackedEnum" if c.node.get("backing") is not None else "UnitEnum"))
        for k, (role, name) in enumerate(edges):
            out.add("edge", c.node, name, lower(name), key, role, c.fqn, what=c.what, ord=k, anon=None if own else "1")
        member(f, c, key, out)
    for n, fqn, _ in f.functions:
        need, most = arity(n.params)
        out.add("decl", n, fqn, lower(fqn), None, "function", None, need=need, most=most, returns=render_hint(n.returns))
    for i, fqn in f.constants:
        out.add("decl", i, fqn, fqn, None, "constant")
    for n, s in f.nodes("call"):
        if n.callee.kind == "constfetch" and lower(n.callee.name.text.lstrip("\\")) == "define" and n.args and n.args[0].kind == "arg" and n.args[0].value.kind == "string":
            out.add("decl", n, n.args[0].value.value, n.args[0].value.value.lstrip("\\"), None, "constant")
    for n, s in f.nodes("useitem"):
        out.add("import", n, n.target, lower(n.target) if n.use != "const" else n.target, s.names.ns, n.use, n.alias)


def f_mixin(c: ClassInfo, text: str) -> str:
    return c.names.cls(text)[1]


def member(f: File, c: ClassInfo, key: str, out: Rows) -> None:
    for m in c.methods:
        need, most = arity(m.params)
        mods = set(m.mods)
        out.add("member", m, m.name, lower(m.name), key, "method", c.fqn, vis=visibility(mods), static="1" if "static" in mods else None, abstract="1" if m.body is None else None, final="1" if "final" in mods else None, need=need, most=most, returns=render_hint(m.returns))
    for p, i in c.props:
        out.add("member", i, i.name, i.name, key, "property", c.fqn, vis=visibility(p.mods), static="1" if "static" in p.mods else None, readonly="1" if "readonly" in p.mods or "readonly" in c.mods else None, hint=render_hint(p.hint))
    for p in c.promoted():
        out.add("member", p, p.name, p.name, key, "property", c.fqn, vis=visibility(p.mods), readonly="1" if "readonly" in p.mods or "readonly" in c.mods else None, hint=render_hint(p.hint))
    for p, i in c.consts:
        out.add("member", i, i.name, i.name, key, "constant", c.fqn, vis=visibility(p.mods), final="1" if "final" in p.mods else None)
    for k in c.cases:
        out.add("member", k, k.name, k.name, key, "constant", c.fqn, vis="public", case="1")
    for t in tags(c.node.get("doc")):
        if t[0] in ("property", "property-read", "property-write") and t[3]:
            out.add("member", c.node, t[3], t[3], key, "property", c.fqn, vis="public", doc="1", hint=t[2])
    for m in re.finditer(r"@method\s+(static\s+)?(?:[\w\\|<>\[\], ?]+\s+)?(\w+)\s*\(", c.node.get("doc") or ""):
        out.add("member", c.node, m[2], lower(m[2]), key, "method", c.fqn, vis="public", static="1" if m[1] else None, doc="1", most="*", need=0)


def receivers(f: File) -> dict[int, dict[str, str]]:
    """Per scope: variables that hold one class in the whole scope (a typed parameter or one ``new``)."""
    out = {}
    for s in f.scopes:
        if s.kind in ("class", "file"):
            continue
        known: dict[str, str | None] = {}
        for p in s.params:
            h = p.hint
            if h is not None and h.kind == "name" and not p.by_ref and not p.variadic:
                kind, name = s.names.cls(h.text)
                if kind == "fqn":
                    known[p.name] = name
        for n in walk_scope(s.body):
            t = None
            if n.kind in ("assign", "assignref", "assignop"):
                t, v = peel(n.target), peel(n.value)
                if t.kind == "var" and t.name:
                    cls = None
                    if n.kind == "assign" and v.kind == "new" and v.cls.kind == "name":
                        kind, name = s.names.cls(v.cls.text)
                        cls = name if kind == "fqn" else None
                    known[t.name] = cls if t.name not in known else None
                else:
                    for x in t.walk():
                        if x.kind == "var" and x.name and t.kind in ("array", "list"):
                            known[x.name] = None
            elif n.kind == "foreach":
                for x in (n.key, n.value):
                    for y in x.walk() if x is not None else ():
                        if y.kind == "var" and y.name:
                            known[y.name] = None
            elif n.kind in ("global", "static", "unset", "catch", "instanceof", "isset"):
                for y in n.walk() if n.kind != "catch" else ():
                    if y.kind == "var" and y.name:
                        known[y.name] = None
                if n.kind == "catch" and n.var:
                    known[n.var] = None
                if n.kind == "static":
                    for i in n.items:
                        known[i.name] = None
        out[id(s)] = {k: v for k, v in known.items() if v}
    return out


def accesses(f: File, out: Rows) -> None:
    """Uses of members on a receiver whose class is known."""
    known = receivers(f)
    for n, s in f.nodes("mcall", "prop"):
        if not isinstance(n.name, str):
            continue
        o = peel(n.obj)
        cls, how = None, None
        if o.kind == "var" and o.name == "this" and s.cls is not None and s.cls.what != "trait" and s.kind in ("method", "arrow", "closure") and not s.static:
            cls, how = s.cls.fqn, "this"
        elif o.kind == "var" and o.name in known.get(id(s), {}):
            cls, how = known[id(s)][o.name], "typed"
        elif o.kind == "new" and o.cls.kind == "name":
            kind, name = f.resolve(o.cls, s)
            cls, how = (name, "new") if kind == "fqn" else (None, None)
        if cls is None:
            continue
        method = n.kind == "mcall"
        up = f.up(n)
        quiet = up is not None and up.kind in ("isset", "empty") or up is not None and up.kind == "bin" and up.op == "??" and up.left is n
        if quiet:
            continue
        write = up is not None and up.kind in ("assign", "assignop", "assignref") and up.target is n
        out.add("access", n, n.name, lower(n.name) if method else n.name, lower(cls), "method" if method else "property", cls, how=how, nargs=_count(n.args) if method else None, write="1" if write else None, inside=lower(s.cls.fqn) if s.cls else None)
    for n, s in f.nodes("scall", "sprop", "cconst"):
        x = n.cls.name if n.cls.kind == "constfetch" else n.cls
        if x.kind != "name" or not isinstance(n.name, str):
            continue
        kind, name = f.resolve(x, s)
        if kind != "fqn" or n.kind == "cconst" and lower(n.name) == "class":
            continue
        out.add("access", n, n.name, lower(n.name) if n.kind == "scall" else n.name, lower(name), {"scall": "static_method", "sprop": "static_property", "cconst": "constant"}[n.kind], name, how="late" if lower(x.text) in ("self", "parent") else "name", nargs=_count(n.args) if n.kind == "scall" else None, inside=lower(s.cls.fqn) if s.cls else None)


def _count(args: list[Node]) -> str | None:
    return None if any(a.kind != "arg" or a.spread or a.name for a in args) else str(len(args))


def facts(f: File, out: Rows) -> None:
    head = lambda n: f.text[n.start : n.end]
    for view, kinds in VIEWS.items():
        for n, s in f.nodes(*kinds):
            name = n.get("name") if isinstance(n.get("name"), str) else n.get("op") or n.get("word") or ({"assign": "plain", "assignref": "ref"}.get(n.kind))
            if n.kind == "call" and n.callee.kind == "constfetch":
                name = n.callee.name.text
            elif n.kind == "new" and n.cls.kind == "name":
                name = n.cls.text
            parts = [n.get(k) for k in ("obj", "base", "left", "target", "inner", "subject", "cls") if isinstance(n.get(k), Node)] + [n.get(k) for k in ("right", "value", "index", "key") if isinstance(n.get(k), Node)]
            items = n.get("args") or n.get("items") or n.get("exprs") or n.get("vars") or []
            out.add(view, n, name, None, s.cls.fqn if s.cls else None, n.kind, s.name, [head(p) for p in [*parts, *items]], nullsafe="1" if n.get("nullsafe") else None)
            if view == "function_calls" and s.kind != "file":
                out.add("scoped_function_calls", n, name, None, s.cls.fqn if s.cls else None, s.kind, s.name, [head(a) for a in n.args])
            if view == "method_calls" and s.kind != "file":
                out.add("scoped_method_calls", n, name, None, s.cls.fqn if s.cls else None, s.kind, s.name, [head(n.obj), *[head(a) for a in n.args]])
    for n, s in f.nodes("bin", "assignop"):
        if n.op == "??":
            left = n.left if n.kind == "bin" else n.target
            out.add("coalesces", n, None, None, s.cls.fqn if s.cls else None, left.kind, s.name, [head(left)])
    for n, fqn, s in f.functions:
        out.add("functions", n, fqn, lower(fqn), None, "function", s.name, [p.name for p in n.params])
    for c in f.classes:
        out.add("classes", c.node, c.fqn, lower(c.fqn), None, c.what)
        for m in c.methods:
            out.add("methods", m, m.name, lower(m.name), c.fqn, "method", None, [p.name for p in m.params])
        for p, i in c.props:
            out.add("property_elems", i, i.name, i.name, c.fqn, "property")
        for p in {id(p): p for p, _ in c.props}.values():
            out.add("properties", p, None, None, c.fqn, "property", None, [i.name for i in p.items])
    for kind, rows in f.by_kind.items():
        rel = "statements" if kind in STATEMENTS else None if kind in _PARTS else "expressions"
        if rel:
            for n, s in rows:
                out.add(rel, n, kind, None, s.cls.fqn if s.cls else None, kind, s.name)


def nodes(f: File, out: Rows) -> None:
    """The tree as an adjacency list: key is the node's number in pre-order, owner its parent's, alt its role."""
    stack = [(f.tree, None, "root", 0)]
    number = 0
    while stack:
        n, parent, role, k = stack.pop()
        me, number = number, number + 1
        plain = {x: v for x, v in n.parts.items() if isinstance(v, (str, int, float, bool)) and x != "doc"}
        out.add("node", n, n.kind, me, parent, str(k), role, None)
        out.rows[-1]["attrs"] = [(x, utf8(str(v))) for x, v in plain.items()] or None
        stack += [(c, me, r, i) for i, (r, c) in reversed(list(enumerate(n.children())))]


_MARK = re.compile(r"@phpstan-ignore(-next-line|-line)?(?![\w-])([^\r\n]*)")
_COMMENT = re.compile(r"//|#|/\*|\*")


def markers(f: File, out: Rows) -> None:
    """Inline ignores: name is the target line; args its identifiers, none for all; res tells a malformed list."""
    for k, text in enumerate(f.text.split("\n"), 1):
        for m in _MARK.finditer(text):
            c = _COMMENT.search(text)
            trailing = bool(text[: c.start()].strip()) if c else False
            rest = re.sub(r"\*/.*", "", m[2]).strip()
            if m[1]:
                out.add("marker", f._lines[k - 1] + m.start(), k + (m[1] == "-next-line"))
                continue
            plain = re.sub(r"\([^()]*\)", "", rest).strip()
            ids = [x.strip() for x in plain.split(",")]
            bad = not all(re.fullmatch(r"[a-zA-Z0-9_.]+", x) for x in ids)
            out.add("marker", f._lines[k - 1] + m.start(), k if trailing else k + 1, res="bad" if bad else None, args=[] if bad else ids)


def extract(path: str, ord_: int, source: bytes, analyze: bool, options: Options, want: frozenset[str]) -> list[dict]:
    f = File(path, source)
    out = Rows(f, ord_)
    out.add("file", 0, path, None, None, None, None, None, errors=len(f.errors), analyze="1" if analyze else None)
    declarations(f, out)
    for what, key, member_, data in describe(f):
        out.add("sig", 0, what, key, None, None, member_, [data, *sorted(mentions(what, data))])
    if analyze:
        for at, message in f.errors:
            out.add("error", at, message, res="phpParser.error")
        for n, kind, how, name, fallback, context in f.references():
            key = lower(name) if kind != "constant" else name
            out.add("ref", n, name, key, None, kind, None if fallback is None else lower(fallback) if kind != "constant" else fallback, None, how=how, context=context, text=n.text)
        accesses(f, out)
        markers(f, out)
        for k, r in enumerate(RULES):
            if r.level <= options.level:
                for at, code, message in r.run(f, options):
                    out.add("finding", at, message, code, None, r.name, str(k))
        if "facts" in want:
            facts(f, out)
        if "doc" in want:
            for kind in ("function", "method", "class", "property", "classconst"):
                for n, s in f.nodes(kind):
                    for k, (tag, prio, text, var) in enumerate(tags(n.get("doc"))):
                        out.add("doc", n, tag, None, n.get("name") or (n.items[0].name if n.get("items") else None), kind, var, [text], prio=prio, ord=k)
        if "node" in want:
            nodes(f, out)
        if "token" in want:
            for k, (name, s, e) in enumerate(tokenize(f.text)):
                out.add("token", Node("", s, e), name, k, None, None, None, [f.text[s:e]])
    return out.rows


def table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, SCHEMA)


def worker(options: Options, want: frozenset[str]):
    """Batches of (path, ord, analyze, source) to rows, some files at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for path, ord_, analyze, source in zip(*(b.column(c).to_pylist() for c in ("path", "ord", "analyze", "source")), strict=True):
                rows += extract(path, ord_, bytes(source or b""), bool(analyze), options, want)
                if len(rows) > 20_000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    return run
