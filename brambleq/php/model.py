"""One file's tree with its names resolved: scopes, declarations, references, facts."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from brambleq.php.ast import Node, peel
from brambleq.php.parser import parse

#: Names that are types of the language.
BUILTIN_TYPES = set("int float string bool array object mixed void never null false true iterable callable".split())
LATE = {"self", "static", "parent"}
SUPERGLOBALS = set("GLOBALS _SERVER _GET _POST _FILES _COOKIE _SESSION _REQUEST _ENV".split())


def lower(s: str) -> str:
    """ASCII case only."""
    return s.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def utf8(s: str) -> str:
    return s.encode("latin-1").decode("utf-8", "replace")


class Scope:
    """A function-like body, or the file's own statements."""

    __slots__ = ("node", "kind", "cls", "name", "params", "body", "names", "static", "outer")

    def __init__(self, node, kind, cls, name, params, body, names, static=False, outer=None):
        self.node, self.kind, self.cls, self.name, self.params, self.body, self.names, self.static, self.outer = node, kind, cls, name, params, body, names, static, outer


class Names:
    """Namespace and imports that hold in a region of the file."""

    __slots__ = ("ns", "classes", "functions", "consts")

    def __init__(self, ns: str) -> None:
        self.ns = ns
        self.classes: dict[str, str] = {}
        self.functions: dict[str, str] = {}
        self.consts: dict[str, str] = {}

    def qualify(self, name: str) -> str:
        return f"{self.ns}\\{name}" if self.ns else name

    def cls(self, name: str) -> tuple[str, str]:
        """(kind, name): fqn, late or builtin."""
        if name.startswith("\\"):
            return "fqn", name[1:]
        low = lower(name)
        if low.startswith("namespace\\"):
            return "fqn", self.qualify(name[10:])
        head, _, rest = name.partition("\\")
        if not rest:
            if low in LATE:
                return "late", low
            if low in BUILTIN_TYPES:
                return "builtin", low
        target = self.classes.get(lower(head))
        if target:
            return "fqn", f"{target}\\{rest}" if rest else target
        return "fqn", self.qualify(name)

    def other(self, name: str, kind: str) -> tuple[str, str | None]:
        """(first candidate, fallback) of a function or constant."""
        if name.startswith("\\"):
            return name[1:], None
        if lower(name).startswith("namespace\\"):
            return self.qualify(name[10:]), None
        head, _, rest = name.partition("\\")
        if rest:
            target = self.classes.get(lower(head))
            return (f"{target}\\{rest}" if target else self.qualify(name)), None
        imported = self.functions.get(lower(name)) if kind == "function" else self.consts.get(name)
        if imported:
            return imported, None
        return (self.qualify(name), name) if self.ns else (name, None)


class ClassInfo:
    __slots__ = ("node", "fqn", "what", "names", "parent", "interfaces", "traits", "methods", "props", "consts", "cases", "mods", "outer")

    def __init__(self, node: Node, fqn: str, names: Names) -> None:
        self.node, self.fqn, self.names = node, fqn, names
        self.what, self.mods = node.what, set(node.mods)
        res = lambda n: names.cls(n.text)[1]
        up = [res(n) for n in node.extends]
        self.parent = up[0] if up and self.what == "class" else None
        self.interfaces = (up if self.what == "interface" else []) + [res(n) for n in node.implements]
        self.traits = [res(n) for m in node.members if m.kind == "traituse" for n in m.names]
        self.methods = [m for m in node.members if m.kind == "method"]
        self.props = [(m, i) for m in node.members if m.kind == "property" for i in m.items]
        self.consts = [(m, i) for m in node.members if m.kind == "classconst" for i in m.items]
        self.cases = [m for m in node.members if m.kind == "enumcase"]

    def promoted(self) -> Iterator[Node]:
        for m in self.methods:
            if lower(m.name) == "__construct":
                yield from (p for p in m.params if p.mods)

    @property
    def display(self) -> str:
        return self.fqn if not self.fqn.startswith("class@") else "class@anonymous"


class File:
    """``source`` is the file's bytes."""

    def __init__(self, path: str, source: bytes) -> None:
        self.path = path
        self.text = source.decode("latin-1")
        self.tree, self.errors = parse(self.text)
        self._lines = [0] + [m.end() for m in re.finditer("\n", self.text)]
        self.scopes: list[Scope] = []
        self.classes: list[ClassInfo] = []
        self.functions: list[tuple[Node, str, Scope]] = []
        self.constants: list[tuple[Node, str]] = []
        self.regions: list[Names] = []
        self.by_kind: dict[str, list[tuple[Node, Scope]]] = {}
        self.parent: dict[int, Node] = {}
        self.names_of: dict[int, Names] = {}
        self._regions()

    def location(self, offset: int) -> tuple[int, int]:
        k = bisect_right(self._lines, offset)
        return k, offset - self._lines[k - 1] + 1

    def _regions(self) -> None:
        names = Names("")
        self.regions.append(names)
        top = Scope(self.tree, "file", None, "", [], self.tree.body, names)
        self.scopes.append(top)
        pending: list[Node] = []
        for st in self.tree.body:
            self.parent[id(st)] = self.tree
            if st.kind == "namespace":
                names = Names(st.name)
                self.regions.append(names)
                top_ns = Scope(self.tree, "file", None, "", [], [], names)
                if st.body is not None:
                    top_ns.body = st.body
                    self.scopes.append(top_ns)
                    self._imports(st.body, names)
                    self._note(st, top)
                    self._visit_all(st, st.body, top_ns)
                    names = Names("")
                    self.regions.append(names)
                    continue
                self._note(st, top)
                top = top_ns
                self.scopes.append(top)
                continue
            if st.kind == "use":
                self._imports([st], names)
            if top.node is self.tree and top.body is not self.tree.body:
                top.body.append(st)
            pending.append(st)
            top.names = names
            self._visit(st, top)

    def _imports(self, body: list[Node], names: Names) -> None:
        for st in body:
            if st.kind == "use":
                for i in st.items:
                    if i.use == "class":
                        names.classes.setdefault(lower(i.alias), i.target)
                    elif i.use == "function":
                        names.functions.setdefault(lower(i.alias), i.target)
                    else:
                        names.consts.setdefault(i.alias, i.target)

    def _note(self, n: Node, scope: Scope) -> None:
        self.by_kind.setdefault(n.kind, []).append((n, scope))

    def _visit_all(self, parent: Node, nodes, scope: Scope) -> None:
        for c in nodes:
            self.parent[id(c)] = parent
            self._visit(c, scope)

    def _visit(self, root: Node, scope: Scope) -> None:
        """Pre-order, with a stack: the tree may be deep."""
        stack = [(root, scope)]
        while stack:
            n, s = stack.pop()
            self._note(n, s)
            inner, below = s, [c for _, c in n.children()]
            k = n.kind
            if k in ("class", "anonclass"):
                fqn = s.names.qualify(n.name) if k == "class" else f"class@anonymous:{n.start}"
                info = ClassInfo(n, fqn, s.names)
                info_scope = Scope(n, "class", info, fqn, [], [], s.names, outer=s)
                self.classes.append(info)
                inner = info_scope
            elif k == "function":
                inner = Scope(n, "function", None, s.names.qualify(n.name), n.params, n.body, s.names, outer=s)
                self.functions.append((n, s.names.qualify(n.name), s))
                self.scopes.append(inner)
            elif k == "method":
                inner = Scope(n, "method", s.cls, n.name, n.params, n.body or [], s.names, static="static" in n.mods, outer=s)
                self.scopes.append(inner)
            elif k == "hook":
                inner = Scope(n, "hook", s.cls, n.name, n.params, n.body or [], s.names, outer=s)
                self.scopes.append(inner)
            elif k == "closure":
                inner = Scope(n, "closure", s.cls, "{closure}", n.params, n.body, s.names, static=n.static or s.static, outer=s)
                self.scopes.append(inner)
            elif k == "arrow":
                inner = Scope(n, "arrow", s.cls, "{closure}", n.params, [Node("return", n.body.start, n.body.end, value=n.body)], s.names, static=n.static or s.static, outer=s)
                self.scopes.append(inner)
            elif k == "const":
                self.constants += [(i, s.names.qualify(i.name)) for i in n.items]
            for c in below:
                self.parent[id(c)] = n
            # a closure's uses belong to the outer scope
            stack += [(c, s if k == "closure" and c.kind == "closureuse" else inner) for c in reversed(below)]

    def nodes(self, *kinds: str) -> Iterator[tuple[Node, Scope]]:
        for k in kinds:
            yield from self.by_kind.get(k, ())

    def up(self, n: Node) -> Node | None:
        return self.parent.get(id(n))

    def class_of(self, scope: Scope) -> ClassInfo | None:
        return scope.cls

    def resolve(self, n: Node, scope: Scope) -> tuple[str, str]:
        """A class name node: (kind, name); self and parent become class names where they can."""
        kind, name = scope.names.cls(n.text)
        if kind == "late" and scope.cls:
            if name == "self":
                return "fqn", scope.cls.fqn
            if name == "parent" and scope.cls.parent:
                return "fqn", scope.cls.parent
        return kind, name

    # -- references

    def references(self) -> Iterator[tuple[Node, str, str, str, str | None, str]]:
        """(node, symbol kind, resolution kind, name, fallback, context) of each use of a name."""

        def cls(n: Node, s: Scope, context: str):
            kind, name = s.names.cls(n.text)
            yield n, "class", kind, name, None, context

        for k, context in (("class", ""), ("anonclass", "")):
            for n, s in self.nodes(k):
                for x in n.extends:
                    yield from cls(x, s, "extends")
                for x in n.implements:
                    yield from cls(x, s, "implements")
                for m in n.members:
                    if m.kind == "traituse":
                        for x in m.names:
                            yield from cls(x, s, "use")
        for n, s in self.nodes("new", "instanceof", "scall", "sprop", "cconst"):
            if n.cls.kind in ("name", "constfetch"):
                x = n.cls if n.cls.kind == "name" else n.cls.name
                yield from cls(x, s, n.kind)
        for n, s in self.nodes("catch"):
            for x in n.types:
                yield from cls(x, s, "catch")
        for n, s in self.nodes("attribute"):
            yield from cls(n.name, s, "attribute")
        for n, s in self.nodes("param", "function", "method", "closure", "arrow", "property", "classconst"):
            for x in hint_names(n.get("hint") or n.get("returns")):
                yield from cls(x, s, "type")
        for n, s in self.nodes("call"):
            x = n.callee
            x = x.name if x.kind == "constfetch" else x
            if x.kind == "name":
                a, b = s.names.other(x.text, "function")
                yield x, "function", "fallback" if b else "fqn", a, b, "call"
        for n, s in self.nodes("constfetch"):
            up = self.up(n)
            if up is not None and (up.kind == "call" and up.callee is n or up.kind in ("scall", "sprop", "cconst", "new", "instanceof") and up.get("cls") is n):
                continue
            if lower(n.name.text) in ("true", "false", "null"):
                continue
            a, b = s.names.other(n.name.text, "constant")
            yield n.name, "constant", "fallback" if b else "fqn", a, b, "const"


def hint_names(h: Node | None) -> Iterator[Node]:
    if h is None:
        return
    if h.kind == "name":
        yield h
    elif h.kind == "nullable":
        yield from hint_names(h.inner)
    else:
        for x in h.items:
            yield from hint_names(x)


def render_hint(h: Node | None) -> str | None:
    if h is None:
        return None
    if h.kind == "name":
        return h.text
    if h.kind == "nullable":
        return "?" + render_hint(h.inner)
    return ("|" if h.kind == "union" else "&").join(f"({render_hint(x)})" if x.kind == "intersection" else render_hint(x) for x in h.items)


def constant_value(n: Node | None):
    """(value,) of a literal or an operation on literals; None if there is none.  Strings are Latin-1 bytes."""
    if n is None:
        return None
    n = peel(n)
    k = n.kind
    if k in ("int", "float", "string"):
        return (n.value,)
    if k == "constfetch" and lower(n.name.text.lstrip("\\")) in ("true", "false", "null"):
        return ({"true": True, "false": False, "null": None}[lower(n.name.text.lstrip("\\"))],)
    if k == "unary":
        v = constant_value(n.inner)
        if v is None:
            return None
        v = v[0]
        if n.op == "!":
            return (not truthy(v),)
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return None
        if n.op == "~":
            return (~v,) if isinstance(v, int) else None
        return _fits(-v if n.op == "-" else v)
    if k == "bin":
        a, b = constant_value(n.left), constant_value(n.right)
        return fold(n.op, a[0], b[0]) if a is not None and b is not None else None
    return None


def truthy(v) -> bool:
    return v not in ("", "0", 0, 0.0, None, False) if not isinstance(v, bool) else v


def _fits(v):
    return None if isinstance(v, int) and not isinstance(v, bool) and not -(2**63) <= v < 2**63 else (v,)


def fold(op: str, a, b):
    num = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if op in ("&&", "and"):
        return (truthy(a) and truthy(b),)
    if op in ("||", "or"):
        return (truthy(a) or truthy(b),)
    if op == "xor":
        return (truthy(a) != truthy(b),)
    if op == ".":
        return (a + b,) if isinstance(a, str) and isinstance(b, str) else (f"{a}{b}",) if all(isinstance(x, (str, int)) and not isinstance(x, bool) for x in (a, b)) else None
    if op in ("===", "!=="):
        return ((type(a) is type(b) and a == b) == (op == "==="),)
    if op in ("==", "!=", "<>"):
        same = num(a) and num(b) or type(a) is type(b) and isinstance(a, (str, bool, type(None)))
        return ((a == b) == (op == "=="),) if same and not (isinstance(a, str) and a != b and a[:1].strip("-+. ").isdigit() and b[:1].strip("-+. ").isdigit()) else None
    if op in ("<", "<=", ">", ">="):
        ok = lambda x: isinstance(x, (int, float))
        return ({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op],) if ok(a) and ok(b) else None
    if not (num(a) and num(b)):
        return None
    if op == "+":
        return _fits(a + b)
    if op == "-":
        return _fits(a - b)
    if op == "*":
        return _fits(a * b)
    if b == 0:
        return None
    if op == "/":
        return _fits(a // b) if isinstance(a, int) and isinstance(b, int) and a % b == 0 else (a / b,)
    if op == "%" and isinstance(a, int) and isinstance(b, int):
        r = abs(a) % abs(b)
        return (-r if a < 0 else r,)
    return None


def array_key(v):
    """The key that PHP makes of a value; None if it makes none."""
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return int(v) if abs(v) < 2**63 else None
    if v is None:
        return ""
    if isinstance(v, str) and re.fullmatch(r"0|-?[1-9][0-9]*", v) and -(2**63) <= int(v) < 2**63:
        return int(v)
    return v
