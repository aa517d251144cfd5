"""What a file's expressions can be typed with: signatures, members and constants, as rows and as lookups.

``describe`` turns declarations into rows (what, key, member, data); a run joins to each
file the rows that its names can reach, and ``Known`` looks them up."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from brambleq.functions import types as ty
from brambleq.php.ast import Node
from brambleq.php.docs import best, tags
from brambleq.php.model import ClassInfo, File, Names, constant_value, lower, render_hint

#: What functions of the language return.  No entry: nothing is said.
RETURNS = {
    "strlen": "int<0, max>", "mb_strlen": "int<0, max>", "count": "int<0, max>", "sizeof": "int<0, max>", "intval": "int", "floatval": "float", "boolval": "bool", "strval": "string", "strcmp": "int", "strpos": "int<0, max>|false", "stripos": "int<0, max>|false", "strrpos": "int<0, max>|false", "substr": "string", "mb_substr": "string", "substr_count": "int<0, max>", "ucwords": "string", "nl2br": "string", "md5": "non-falsy-string", "sha1": "non-falsy-string", "implode": "string", "join": "string", "json_encode": "string|false", "serialize": "string", "file_get_contents": "string|false", "is_int": "bool", "is_string": "bool", "is_bool": "bool", "is_float": "bool", "is_array": "bool", "is_null": "bool", "is_object": "bool", "is_callable": "bool", "is_iterable": "bool", "is_numeric": "bool", "in_array": "bool", "array_key_exists": "bool", "key_exists": "bool", "function_exists": "bool", "class_exists": "bool", "method_exists": "bool", "property_exists": "bool", "str_contains": "bool", "str_starts_with": "bool", "str_ends_with": "bool", "ctype_digit": "bool", "time": "int<1, max>", "microtime": "float|string", "rand": "int", "mt_rand": "int", "random_int": "int", "floor": "float", "ceil": "float", "round": "float", "sqrt": "float", "pi": "float", "usleep": "void", "sleep": "int", "array_sum": "int|float", "array_product": "int|float", "ord": "int<0, 255>", "chr": "non-empty-string", "bin2hex": "string", "dechex": "non-empty-string", "spl_object_id": "int", "get_class": "class-string", "get_object_vars": "array<string, mixed>", "func_get_args": "list<mixed>", "array_is_list": "bool", "usort": "true", "uasort": "true", "uksort": "true", "sort": "true", "rsort": "true", "ksort": "true", "asort": "true", "printf": "int", "error_log": "bool", "define": "bool", "password_hash": "non-empty-string", "similar_text": "int", "levenshtein": "int", "checkdate": "bool", "mktime": "int|false", "strtotime": "int|false", "preg_match": "0|1|false", "preg_match_all": "int<0, max>|false", "preg_quote": "string", "htmlspecialchars": "string", "addslashes": "string", "str_word_count": "array<int, string>|int", "str_split": "non-empty-list<string>", "array_key_last": "int|string|null", "array_rand": "int|string|array", "var_export": "string|null", "print_r": "string|true",
}


def show(t: ty.Type) -> str:
    return ty.render(t)


def place_names(t: ty.Type, cls: str | None, parent: str | None) -> ty.Type:
    """``self`` and ``parent`` as classes."""
    turn = {"self": cls, "parent": parent}
    return ty.rewrite(t, lambda x: ("named", turn[x[0]], ()) if x[0] in turn and turn[x[0]] else x)


def hint_type(text: str | None, names: Names, cls: ClassInfo | None, templates: frozenset[str] = frozenset()) -> ty.Type | None:
    if not text:
        return None
    t = ty.parse_type(text, lambda n: names.cls(n)[1], templates)
    return place_names(t, cls.fqn if cls else None, cls.parent if cls else None)


def templates_of(doc: str | None) -> frozenset[str]:
    return frozenset(t[2].split(" ")[0] for t in tags(doc) if t[0] in ("template", "template-covariant", "template-contravariant") and t[2])


def signature(n: Node, names: Names, cls: ClassInfo | None, outer: frozenset[str] = frozenset()) -> dict:
    """Parameters (name, type or null, optional, variadic, by reference), return type and templates of a function-like."""
    found = tags(n.get("doc"))
    own = templates_of(n.get("doc"))
    every = own | outer
    out = []
    for p in n.params:
        native = hint_type(render_hint(p.hint), names, cls, every)
        doc = hint_type(best(found, "param", p.name), names, cls, every)
        t = doc or native
        if t is not None and native is not None and p.default is not None and constant_value(p.default) == (None,):
            t = ty.union(t, ty.NULL)
        out.append([p.name, show(t) if t else None, p.default is not None or p.variadic, p.variadic, p.by_ref])
    native, doc = hint_type(render_hint(n.get("returns")), names, cls, every), hint_type(best(found, "return"), names, cls, every)
    ret = doc or native
    sig = {"p": out, "r": show(ret) if ret else None, "t": sorted(every), "n": show(native) if native else None}
    # what a call proves of its arguments (when, parameter, type, negated), and leaves in those it takes by reference
    proves = [(tag, var, hint_type(text.lstrip("!="), names, cls, every), text.startswith("!")) for tag, _, text, var in found if tag in ("assert", "assert-if-true", "assert-if-false") and var]
    leaves = {var: hint_type(text, names, cls, every) for tag, _, text, var in found if tag == "param-out" and var}
    if proves:
        sig["a"] = [[tag, var, show(t), no] for tag, var, t, no in proves if t]
    if leaves:
        sig["o"] = {var: show(t) for var, t in leaves.items() if t}
    return sig


def value_type(n: Node | None) -> str | None:
    v = constant_value(n)
    return None if v is None else show(literal(v[0]))


def literal(v) -> ty.Type:
    if isinstance(v, bool):
        return ty.TRUE if v else ty.FALSE
    if v is None:
        return ty.NULL
    if isinstance(v, int):
        return ("lit-int", v)
    return ty.FLOAT if isinstance(v, float) else ("lit-string", v) if len(v) <= 64 else ("string-of", "non-falsy")


def describe(f: File) -> Iterator[tuple[str, str, str | None, str]]:
    """(what, key, member, data) of all that the file declares."""
    for n, fqn, s in f.functions:
        yield "function", lower(fqn), None, json.dumps(signature(n, s.names, None) | {"name": fqn})
    for i, fqn in f.constants:
        t = value_type(i.value)
        if t:
            yield "const", fqn, None, json.dumps(t)
    for c in f.classes:
        key, generic = lower(c.fqn), templates_of(c.node.get("doc"))
        ups = ([c.parent] if c.parent else []) + c.interfaces + c.traits
        yield "class", key, None, json.dumps({"name": c.fqn, "what": c.what, "final": "final" in c.mods, "up": ups, "t": sorted(generic)})
        for m in c.methods:
            yield "method", key, lower(m.name), json.dumps(signature(m, c.names, c, generic) | {"name": m.name, "static": "static" in m.mods, "of": c.fqn})
        for p, i in c.props:
            doc = hint_type(best(tags(p.get("doc")), "var"), c.names, c, generic)
            native = hint_type(render_hint(p.hint), c.names, c, generic)
            yield "property", key, i.name, json.dumps({"type": show(doc or native) if doc or native else None, "native": show(native) if native else None, "static": "static" in p.mods, "of": c.fqn})
        for p in c.promoted():
            t = hint_type(render_hint(p.hint), c.names, c, generic)
            yield "property", key, p.name, json.dumps({"type": show(t) if t else None, "native": show(t) if t else None, "static": False, "of": c.fqn})
        for _, i in c.consts:
            yield "classconst", key, i.name, json.dumps(value_type(i.value))
        for k in c.cases:
            yield "classconst", key, k.name, json.dumps(f"{c.fqn}::{k.name}")
        for tag, _, text, var in tags(c.node.get("doc")):
            if tag in ("property", "property-read", "property-write") and var:
                t = hint_type(text, c.names, c, generic)
                yield "property", key, var, json.dumps({"type": show(t) if t else None, "native": None, "static": False, "of": c.fqn})


def mentions(what: str, data: str) -> set[str]:
    """Classes that a row of ``describe`` leads to, lower case."""
    d = json.loads(data)
    texts = [p[1] for p in d.get("p", ())] + [d.get("r"), d.get("type")] if isinstance(d, dict) else [d]
    out = {lower(u) for u in d.get("up", ())} if isinstance(d, dict) else set()

    def note(t: ty.Type) -> ty.Type:
        if t[0] in ("named", "case"):
            out.add(lower(t[1]))
        return t

    for text in texts:
        if text:
            ty.rewrite(ty.parse_type(text), note)
    return out


class Known:
    """Lookups over such rows.  Of a class, members are found on the way up."""

    def __init__(self, rows: Iterable[tuple[str, str, str | None, str]]) -> None:
        self.rows: dict[tuple[str, str, str | None], object] = {}
        for what, key, member, data in rows:
            self.rows.setdefault((what, key, member), data)
        self._types: dict[tuple[str, frozenset], ty.Type] = {}
        classes = {k: json.loads(d) for (w, k, _), d in self.rows.items() if w == "class"}
        self.classes = classes
        above = set()
        for k in classes:
            above |= {(k, a) for a in self.above(k) if a != k}
        whole = {k for k in classes if all(a in classes for a in self.above(k))}
        self.world = ty.World(frozenset(whole), frozenset(above))

    def _get(self, what: str, key: str, member: str | None = None):
        data = self.rows.get((what, key, member))
        return json.loads(data) if isinstance(data, str) else data

    def type(self, text: str | None, templates: Iterable[str] = ()) -> ty.Type:
        if text is None:
            return ty.MIXED
        at = (text, frozenset(templates))
        if at not in self._types:
            self._types[at] = ty.parse_type(text, templates=at[1])
        return self._types[at]

    def function(self, key: str, fallback: str | None = None) -> dict | None:
        got = self._get("function", key)
        if got is None and fallback:
            key, got = fallback, self._get("function", fallback)
        return self.completed(got, key, None) if got else None

    def completed(self, sig: dict, key: str, member: str | None) -> dict:
        """A signature with what calls and bodies tell of the types that it leaves out."""
        found = self._get("inferred", key, member)
        if not found:
            return sig
        params = [[p[0], found["p"].get(str(i)) if p[1] is None and not p[3] else p[1], *p[2:]] for i, p in enumerate(sig["p"])]
        return sig | {"p": params, "r": sig["r"] or found.get("r"), "told": [p[1] is not None for p in sig["p"]]}

    def constant(self, name: str, fallback: str | None = None) -> ty.Type | None:
        t = self._get("const", name) or (self._get("const", fallback) if fallback else None)
        return self.type(t) if t else None

    def above(self, key: str) -> list[str]:
        """The class and its ancestors, each once, nearest first."""
        out, todo = [], [key]
        while todo:
            k = todo.pop(0)
            if k not in out:
                out.append(k)
                todo += [lower(u) for u in self.classes.get(k, {}).get("up", [])]
        return out

    def whole(self, key: str) -> bool:
        """Whether the class and all above it are known."""
        return key in self.world.known

    def member(self, what: str, cls: str, name: str) -> dict | None:
        for k in self.above(lower(cls)):
            got = self._get(what, k, name)
            if got is not None:
                return self.completed(got, k, name) if what == "method" else got if isinstance(got, dict) else {"type": got}
        return None
