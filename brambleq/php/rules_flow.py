"""Rules on the types of expressions.  Each takes a ``Typed`` file and yields (byte offset,
identifier, message).  They report what every value of a type does, not what one may do."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from brambleq.functions import types as ty
from brambleq.functions.types import FALSE, MIXED, NEVER, NULL, TRUE, VOID, Type, arms, assignable, render, strip_null, union
from brambleq.php.ast import Node, peel, walk_scope, yields
from brambleq.php.flow import Flow, flows, is_kind, key_value, truth
from brambleq.php.knowledge import Known, hint_type
from brambleq.php.model import File, array_key, constant_value, fold, lower, render_hint, utf8
from brambleq.php.rules_local import Options

Hit = tuple[int, str, str]


class Typed:
    """A file with its expressions' types."""

    def __init__(self, f: File, known: Known, options: Options) -> None:
        self.f, self.known, self.options = f, known, options
        self.flows: list[Flow] = flows(f, known)
        self.types: dict[int, Type] = {}
        for x in self.flows:
            self.types.update(x.types)

    def of(self, n: Node) -> Type:
        return self.types.get(id(n), self.types.get(id(peel(n)), MIXED))

    def nodes(self, *kinds: str) -> Iterator[Node]:
        for n, _ in self.f.nodes(*kinds):
            if id(n) in self.types or kinds[0] in _STATEMENTS:
                yield n

    def accepts(self, value: Type, target: Type) -> bool:
        return assignable(value, target, self.known.world) != ty.NO

    def show(self, t: Type) -> str:
        return utf8(render(t))


_STATEMENTS = {"if", "while", "dowhile", "foreach", "echo", "unset", "class"}


@dataclass(frozen=True)
class FlowRule:
    name: str
    level: int
    run: Callable[[Typed], Iterator[Hit]]


FLOW_RULES: list[FlowRule] = []


def rule(name: str, level: int):
    def keep(f):
        FLOW_RULES.append(FlowRule(name, level, f))
        return f

    return keep


def vague(t: Type) -> bool:
    """Whether a type says too little to report on."""
    return any(x[0] in ("mixed", "unknown", "template", "intersection", "conditional", "never", "void", "static", "self", "iterable", "callable", "object", "resource") for x in arms(t))


def category(t: Type) -> str | None:
    """int, float, string, bool, null, array or object, where all alternatives are of one."""
    found = {next((k for k in ("int", "float", "string", "bool", "null", "array", "object") if is_kind(k, x) is True), None) for x in arms(t)} if not vague(t) else {None}
    return found.pop() if len(found) == 1 else None


def known_truth(x: Typed, n: Node) -> bool | None:
    v = constant_value(n)
    if v is not None:
        return bool(v[0] not in ("", "0", 0, 0.0, None, False)) if not isinstance(v[0], bool) else v[0]
    t = x.of(n)
    return truth(t) if t in (TRUE, FALSE, NULL) else None


def word(v: bool) -> str:
    return "true" if v else "false"


def says(v) -> str:
    v = v[0]
    return word(v) if isinstance(v, bool) else "null" if v is None else f"'{utf8(v)}'" if isinstance(v, str) else f"{v:.1f}" if isinstance(v, float) and v.is_integer() else str(v)


# -- conditions that are settled


def leaves(body: list[Node]) -> bool:
    return any(n.kind in ("break", "return", "throw", "exit", "goto", "yield", "yieldfrom") for n in walk_scope(body))


@rule("comparison.while", 4)
def while_condition(x: Typed):
    yield from _loop(x, "while", "While loop", "while")


@rule("comparison.doWhile", 4)
def do_condition(x: Typed):
    yield from _loop(x, "dowhile", "Do-while loop", "doWhile")


def _loop(x: Typed, kind: str, shown: str, code: str) -> Iterator[Hit]:
    for n in x.nodes(kind):
        v = known_truth(x, n.cond)
        if v is False or v and constant_value(n.cond) is not None and not leaves(n.body):
            yield n.cond.start, f"{code}.always{word(v).capitalize()}", f"{shown} condition is always {word(v)}."


@rule("comparison.booleanNot", 4)
def negation(x: Typed):
    for n in x.nodes("unary"):
        v = known_truth(x, n.inner) if n.op == "!" else None
        if v is not None:
            yield n.start, f"booleanNot.always{word(not v).capitalize()}", f"Negated boolean expression is always {word(not v)}."


@rule("comparison.booleanAnd", 4)
def and_sides(x: Typed):
    yield from _sides(x, "booleanAnd", ("&&", "and"))


@rule("comparison.booleanOr", 4)
def or_sides(x: Typed):
    yield from _sides(x, "booleanOr", ("||", "or"))


@rule("comparison.logicalXor", 4)
def xor_sides(x: Typed):
    yield from _sides(x, "logicalXor", ("xor",))


def _sides(x: Typed, code: str, ops: tuple[str, ...]) -> Iterator[Hit]:
    for n in x.nodes("bin"):
        if n.op in ops:
            for side, e in (("Left", n.left), ("Right", n.right)):
                v = known_truth(x, e)
                if v is not None:
                    yield e.start, f"{code}.{side.lower()}Always{word(v).capitalize()}", f"{side} side of {n.op} is always {word(v)}."
                    break


@rule("comparison.strict", 4)
def strict(x: Typed):
    for n in x.nodes("bin"):
        if n.op not in ("===", "!=="):
            continue
        code = "identical" if n.op == "===" else "notIdentical"
        a, b = constant_value(n.left), constant_value(n.right)
        if a is not None and b is not None and type(a[0]) is type(b[0]):
            v = fold(n.op, a[0], b[0])
            if v is not None:
                yield n.start, f"{code}.always{word(v[0]).capitalize()}", f"Strict comparison using {n.op} between {says(a)} and {says(b)} will always evaluate to {word(v[0])}."
            continue
        s, t = x.of(n.left), x.of(n.right)
        if n.op == "===" and category(s) and category(t) and category(s) != category(t):
            yield n.start, "identical.alwaysFalse", f"Strict comparison using === between {x.show(s)} and {x.show(t)} will always evaluate to false."


@rule("comparison.constant", 4)
def constants(x: Typed):
    names = {"==": "equal", "!=": "notEqual", "<>": "notEqual", "<": "smaller", "<=": "smallerOrEqual", ">": "greater", ">=": "greaterOrEqual"}
    for n in x.nodes("bin"):
        a, b = constant_value(n.left), constant_value(n.right)
        if n.op in names and a is not None and b is not None and (v := fold(n.op, a[0], b[0])) is not None:
            code = f"{names[n.op]}.always{word(v[0]).capitalize()}"
            if names[n.op].lower().endswith("equal") and n.op in ("==", "!=", "<>"):
                yield n.start, code, f"Loose comparison using {n.op} between {says(a)} and {says(b)} will always evaluate to {word(v[0])}."
            else:
                yield n.start, code, f'Comparison operation "{n.op}" between {says(a)} and {says(b)} is always {word(v[0])}.'


@rule("comparison.impossibleInstanceof", 4)
def impossible_instanceof(x: Typed):
    for n, s in x.f.nodes("instanceof"):
        c = n.cls if n.cls.kind == "name" else n.cls.name if n.cls.kind == "constfetch" else None
        if c is None or id(n) not in x.types:
            continue
        kind, name = s.names.cls(c.text)
        t = x.of(n.value)
        if kind != "fqn" or t[0] != "named" or not x.known.whole(lower(name)) or not x.known.whole(lower(t[1])):
            continue
        here, there = x.known.classes[lower(t[1])], x.known.classes[lower(name)]
        closed = here["final"] or here["what"] == "enum" or here["what"] == "class" and there["what"] == "class"
        if closed and x.known.world.below(t[1], name) is False and x.known.world.below(name, t[1]) is False:
            yield n.start, "instanceof.alwaysFalse", f"Instanceof between {x.show(t)} and {name} will always evaluate to false."


@rule("comparison.impossibleCheckType", 4)
def impossible_check(x: Typed):
    tests = {"is_int": ("int",), "is_integer": ("int",), "is_long": ("int",), "is_float": ("float",), "is_double": ("float",), "is_string": ("string",), "is_bool": ("bool",), "is_array": ("array",), "is_null": ("null",), "is_object": ("object",), "is_numeric": ("int", "float", "string"), "is_scalar": ("int", "float", "string", "bool")}
    for n in x.nodes("call"):
        if n.callee.kind != "constfetch" or not n.args or n.args[0].kind != "arg" or n.args[0].spread or n.args[0].name:
            continue
        name = lower(n.callee.name.text.lstrip("\\"))
        have = category(x.of(n.args[0].value))
        if name in tests and have and have not in tests[name]:
            yield n.start, "function.impossibleType", f"Call to function {name}() will always evaluate to false."


@rule("comparison.matchArms", 4)
def match_arms(x: Typed):
    for n in x.nodes("match"):
        subject, met = constant_value(n.subject), False
        if subject is None:
            continue
        for i, arm in enumerate(n.arms):
            for t in arm.tests or []:
                v = constant_value(t)
                if v is None or met:
                    continue
                same = fold("===", subject[0], v[0])[0]
                if not same:
                    yield t.start, "match.alwaysFalse", f"Match arm comparison between {says(subject)} and {says(v)} is always false."
                else:
                    if i + 1 < len(n.arms):
                        yield t.start, "match.alwaysTrue", f"Match arm comparison between {says(subject)} and {says(v)} is always true."
                    met = True


@rule("comparison.voidMatch", 4)
def void_match(x: Typed):
    for n in x.nodes("match"):
        up = x.f.up(n)
        if x.of(n) == VOID and up is not None and up.kind != "expr":
            yield n.start, "match.void", "Result of match expression (void) is used."


# -- operands


def no_number(t: Type) -> bool:
    return all(is_kind("array", y) is True for y in arms(strip_null(t))) and strip_null(t) != NEVER


@rule("cast.invalid", 2)
def invalid_cast(x: Typed):
    words = {"int": ("int", "cast.int"), "integer": ("int", "cast.int"), "float": ("float", "cast.double"), "double": ("float", "cast.double"), "string": ("string", "cast.string")}
    for n in x.nodes("cast"):
        if n.word in words and no_number(t := x.of(n.inner)):
            yield n.inner.start, words[n.word][1], f"Cannot cast {x.show(t)} to {words[n.word][0]}."


@rule("cast.echo", 2)
def echo_array(x: Typed):
    for n in x.nodes("echo"):
        for i, e in enumerate(n.exprs):
            if id(e) in x.types and no_number(t := x.of(e)):
                yield e.start, "echo.nonString", f"Parameter #{i + 1} ({x.show(t)}) of echo cannot be converted to string."


@rule("cast.print", 2)
def print_array(x: Typed):
    for n in x.nodes("print"):
        if no_number(t := x.of(n.inner)):
            yield n.inner.start, "print.nonString", f"Parameter {x.show(t)} of print cannot be converted to string."


@rule("cast.encapsedPart", 2)
def part_array(x: Typed):
    for n in x.nodes("interp"):
        for p in n.parts_:
            if p.kind != "string" and no_number(t := x.of(p)):
                yield p.start, "encapsedStringPart.nonString", f"Part expression ({x.show(t)}) of encapsed string cannot be cast to string."


@rule("operators.invalidBinary", 2)
def invalid_binary(x: Typed):
    for n in x.nodes("bin", "assignop"):
        left, right = (n.left, n.right) if n.kind == "bin" else (n.target, n.value)
        if n.op in (".", "-", "*", "/", "%", "**", "|", "&", "^", "<<", ">>"):
            a, b = x.of(left), x.of(right)
            if no_number(a) or no_number(b):
                yield n.start, "binaryOp.invalid" if n.kind == "bin" else "assignOp.invalid", f'Binary operation "{n.op}" between {x.show(a)} and {x.show(b)} results in an error.'


@rule("operators.invalidUnary", 2)
def invalid_unary(x: Typed):
    for n in x.nodes("unary"):
        if n.op in ("-", "+", "~") and no_number(t := x.of(n.inner)):
            yield n.start, "unaryOp.invalid", f'Unary operation "{n.op}" on {x.show(t)} results in an error.'


@rule("operators.invalidComparison", 2)
def invalid_comparison(x: Typed):
    names = {"==": "equal", "!=": "notEqual", "<>": "notEqual", "<": "smaller", "<=": "smallerOrEqual", ">": "greater", ">=": "greaterOrEqual", "<=>": "spaceship"}
    for n in x.nodes("bin"):
        if n.op in names:
            a, b = x.of(n.left), x.of(n.right)
            kinds = {category(a), category(b)}
            if kinds & {"int", "float"} and kinds & {"array", "object"}:
                yield n.start, f"{names[n.op]}.invalid", f'Comparison operation "{n.op}" between {x.show(a)} and {x.show(b)} results in an error.'


# -- isset, empty, ??


def _told(kind: str, t: Type) -> str | None:
    if vague(t):
        return None
    null = True if t == NULL else False if NULL not in arms(t) else None
    if kind != "empty":
        return None if null is None else "is always null" if null else "is not nullable"
    k = truth(t)
    return None if null is None or k is None else "is not falsy" if k else "is always falsy"


def _isset_like(x: Typed, kind: str, n: Node, phrase: str, bound: set[str]) -> Iterator[Hit]:
    n = peel(n)
    if n.kind == "var" and n.name:
        if n.name not in bound:
            yield n.start, f"{kind}.variable", f"Variable ${n.name} {phrase} is never defined."
        elif (m := _told(kind, x.of(n))) and n.name != "_SESSION":
            yield n.start, f"{kind}.variable", f"Variable ${n.name} {phrase} always exists and {m}."
        return
    if n.kind == "index":
        base, k = x.of(n.base), constant_value(n.index)
        if k is not None and base[0] == "shape":
            status = ty.offset(base, array_key(k[0]))
            shown = f"Offset {x.show(x.of(n.index))} on {x.show(base)} {phrase}"
            if status == "missing":
                yield n.start, f"{kind}.offset", f"{shown} does not exist."
                return
            if status == "present" and (m := _told(kind, next(v for f, _, v in base[1] if f == array_key(k[0])))):
                yield n.start, f"{kind}.offset", f"{shown} always exists and {m}."
                return
        inner = peel(n.base)
        while inner.kind in ("index", "prop"):
            inner = peel(inner.base if inner.kind == "index" else inner.obj)
        if inner.kind == "var" and inner.name and inner.name not in bound:
            yield inner.start, f"{kind}.variable", f"Variable ${inner.name} {phrase} is never defined."


def _bound(x: Typed, flow: Flow) -> set[str] | None:
    """Variables that a scope may define; None where it can hide some."""
    from brambleq.php.definedness import ESCAPES, _assigned
    from brambleq.php.model import SUPERGLOBALS

    s = flow.scope
    if s.kind in ("file", "class", "arrow"):
        return None
    out = {"this"} | SUPERGLOBALS | {p.name for p in s.params} | _assigned(s.body) | {u.name for u in s.node.get("uses") or ()}
    for n in walk_scope(s.body):
        if n.kind == "var" and n.name is None or n.kind in ("include", "eval"):
            return None
        if n.kind == "call" and n.callee.kind == "constfetch" and lower(n.callee.name.text.lstrip("\\")) in ESCAPES:
            return None
        if n.kind == "arg":
            v = peel(n.value)
            out |= {v.name} if v.kind == "var" and v.name else set()
        if n.kind == "global":
            out |= {v.name for v in n.vars if v.kind == "var" and v.name}
        if n.kind == "closure":
            out |= {u.name for u in n.uses}
    return out


def _in_scope(x: Typed, *kinds: str) -> Iterator[tuple[Node, set[str]]]:
    for flow in x.flows:
        bound = _bound(x, flow)
        if bound is not None:
            for n in walk_scope(flow.scope.body):
                if n.kind in kinds:
                    yield n, bound


@rule("isset", 1)
def isset_rule(x: Typed):
    for n, bound in _in_scope(x, "isset"):
        for v in n.vars:
            yield from _isset_like(x, "isset", v, "in isset()", bound)


@rule("empty", 1)
def empty_rule(x: Typed):
    for n, bound in _in_scope(x, "empty"):
        for _, v in n.children():
            yield from _isset_like(x, "empty", v, "in empty()", bound)


@rule("nullCoalesce", 1)
def coalesce_rule(x: Typed):
    for n, bound in _in_scope(x, "bin", "assignop"):
        if n.op == "??":
            yield from _isset_like(x, "nullCoalesce", n.left if n.kind == "bin" else n.target, "on left side of ??" if n.kind == "bin" else "on left side of ??=", bound)


@rule("unset.variable/offset", 0)
def unset_rule(x: Typed):
    for n, bound in _in_scope(x, "unset"):
        for v in n.vars:
            v = peel(v)
            if v.kind == "var" and v.name and v.name not in bound:
                yield v.start, "unset.variable", f"Call to function unset() contains undefined variable ${v.name}."
            elif v.kind == "index" and v.index is not None and (k := constant_value(v.index)) is not None and (t := x.of(v.base))[0] == "shape" and ty.offset(t, array_key(k[0])) == "missing":
                yield v.start, "unset.offset", f"Cannot unset offset {x.show(x.of(v.index))} on {x.show(t)}."


@rule("clone.nonObject", 3)
def clone_rule(x: Typed):
    for n in x.nodes("clone"):
        t = x.of(n.inner)
        if not vague(t) and all(is_kind("object", y) is False for y in arms(t)):
            v = peel(n.inner)
            yield n.start, "clone.nonObject", f"Cannot clone non-object variable ${v.name} of type {x.show(t)}." if v.kind == "var" and v.name else f"Cannot clone {x.show(t)}."


# -- arrays


def not_iterable(x: Typed, t: Type) -> bool:
    def one(y: Type) -> bool:
        if y[0] == "named":
            return x.known.whole(lower(y[1])) and not any(a in ("traversable", "iterator", "iteratoraggregate", "generator") for a in x.known.above(lower(y[1])))
        return is_kind("iterable", y) is False and y[0] not in ("object", "void", "never")

    return all(one(y) for y in arms(t))


@rule("foreach.nonIterable", 3)
def foreach_rule(x: Typed):
    for n in x.nodes("foreach"):
        if id(n.subject) in x.types and not_iterable(x, t := x.of(n.subject)):
            yield n.subject.start, "foreach.nonIterable", f"Argument of an invalid type {x.show(t)} supplied for foreach, only iterables are supported."


@rule("arrayUnpacking.nonIterable", 3)
def unpack_rule(x: Typed):
    for n in x.nodes("array"):
        for i in n.items:
            if i.kind == "item" and i.spread and not_iterable(x, t := x.of(i.value)):
                yield i.value.start, "arrayUnpacking.nonIterable", f"Only iterables can be unpacked, {x.show(t)} given."


@rule("offsetAccess.nonArray", 3)
def destructuring_rule(x: Typed):
    for n in x.nodes("assign"):
        target = peel(n.target)
        t = x.of(n.value)
        if target.kind in ("array", "list") and not vague(t) and t != NULL and all(is_kind("array", y) is False and is_kind("object", y) is False for y in arms(t)):
            yield n.value.start, "offsetAccess.nonArray", f"Cannot use array destructuring on {x.show(t)}."


def _bad_key(t: Type) -> bool:
    return not vague(t) and all(is_kind("array", y) is True or is_kind("object", y) is True for y in arms(t))


@rule("array.invalidKey", 3)
def key_rule(x: Typed):
    for n in x.nodes("array"):
        for i in n.items:
            if i.kind == "item" and i.key is not None and _bad_key(t := x.of(i.key)):
                yield i.key.start, "array.invalidKey", f"Invalid array key type {x.show(t)}."


@rule("offsetAccess.invalidOffset", 3)
def offset_key_rule(x: Typed):
    for n in x.nodes("index"):
        if n.index is not None and _bad_key(t := x.of(n.index)) and all(is_kind("array", y) is True for y in arms(x.of(n.base))):
            yield n.index.start, "offsetAccess.invalidOffset", f"Invalid array key type {x.show(t)}."


def _read(x: Typed, n: Node) -> bool:
    """Whether an index is read where a missing offset matters."""
    up, here = x.f.up(n), n
    while up is not None and up.kind == "paren":
        up, here = x.f.up(up), up
    if up is None:
        return True
    if up.kind in ("isset", "empty", "unset") or up.kind in ("assign", "assignref", "assignop") and up.target is here or up.kind == "bin" and up.op == "??" and up.left is here:
        return False
    if up.kind in ("index", "prop") and (up.get("base") is here or up.get("obj") is here):
        return _read(x, up)
    return up.kind not in ("foreach", "ref", "item", "incdec") or up.kind == "foreach" and up.subject is here or up.kind == "item" and up.value is here


@rule("offsetAccess.notFound", 3)
def offset_rule(x: Typed):
    yield from _offsets(x, "missing", "does not exist")


@rule("offsetAccess.maybeNotFound", 7)
def maybe_offset_rule(x: Typed):
    yield from _offsets(x, "maybe", "might not exist")


def _offsets(x: Typed, which: str, phrase: str) -> Iterator[Hit]:
    for n in x.nodes("index"):
        k = constant_value(n.index) if n.index is not None else None
        t = x.of(n.base)
        if k is not None and all(y[0] == "shape" for y in arms(t)) and array_key(k[0]) is not None and ty.offset(t, array_key(k[0])) == which and _read(x, n) and not (which == "maybe" and x.of(n) != NULL and NULL not in arms(x.of(n)) and n.get("held")):
            yield n.start, "offsetAccess.notFound", f"Offset {x.show(x.of(n.index))} {phrase} on {x.show(t)}."


@rule("offsetAccess.nullable", 8)
def nullable_offset_rule(x: Typed):
    for n in x.nodes("index"):
        t = x.of(n.base)
        if NULL in arms(t) and len(arms(t)) > 1 and not vague(strip_null(t)) and all(is_kind("array", y) or is_kind("string", y) for y in arms(strip_null(t))) and _read(x, n):
            yield n.start, "offsetAccess.nonOffsetAccessible", f"Cannot access offset {x.show(x.of(n.index))} on {x.show(t)}." if n.index is not None else f"Cannot access an offset on {x.show(t)}."


@rule("offsetAccess.union", 7)
def union_offset_rule(x: Typed):
    for n in x.nodes("index"):
        t = strip_null(x.of(n.base))
        parts = [is_kind(k, y) for y in arms(t) for k in ("int", "float", "bool") if is_kind(k, y)]
        if not vague(t) and parts and len(parts) < len(arms(t)) and _read(x, n) and n.index is not None:
            yield n.start, "offsetAccess.nonOffsetAccessible", f"Cannot access offset {x.show(x.of(n.index))} on {x.show(t)}."


# -- calls, members, returns


def _calls(x: Typed) -> Iterator[tuple[Node, dict, str]]:
    """Calls whose target is known: the call, its signature and how it is named."""
    for n, s in x.f.nodes("call"):
        if n.callee.kind == "constfetch" and id(n) in x.types:
            a, b = s.names.other(n.callee.name.text, "function")
            sig = x.known.function(lower(a), lower(b) if b else None)
            if sig:
                yield n, sig, f"function {sig['name']}"
    for n in x.nodes("mcall"):
        t = strip_null(x.of(n.obj))
        if isinstance(n.name, str) and t[0] == "named" and (sig := x.known.member("method", t[1], lower(n.name))):
            yield n, sig, f"method {sig['of']}::{sig['name']}()"
    for n, s in x.f.nodes("scall"):
        c = n.cls.name if n.cls.kind == "constfetch" else n.cls
        if c.kind == "name" and isinstance(n.name, str) and id(n) in x.types:
            kind, name = x.f.resolve(c, s)
            if kind == "fqn" and (sig := x.known.member("method", name, lower(n.name))):
                yield n, sig, f"method {sig['of']}::{sig['name']}()"
    for n, s in x.f.nodes("new"):
        if n.cls.kind == "name" and id(n) in x.types:
            kind, name = x.f.resolve(n.cls, s)
            if kind == "fqn" and (sig := x.known.member("method", name, "__construct")):
                yield n, sig, f"method {sig['of']}::{sig['name']}()"


@rule("argument.type", 5)
def argument_rule(x: Typed):
    for n, sig, label in _calls(x):
        if any(a.kind != "arg" or a.spread or a.name for a in n.args):
            continue
        for i, (a, p) in enumerate(zip(n.args, sig["p"], strict=False)):
            name, text, _, variadic, by_ref = p
            if variadic or by_ref or not text or not sig.get("told", [True] * (i + 1))[i]:
                continue
            t, want = x.of(a.value), x.known.type(text, sig.get("t") or ())
            if not x.accepts(t, want) or x.options.level >= 7 and assignable(t, want, x.known.world) == ty.PARTIAL:
                yield a.value.start, "argument.type", f"Parameter #{i + 1} ${name} of {label} expects {x.show(want)}, {x.show(t)} given."


@rule("arguments.count", 0)
def count_rule(x: Typed):
    for n, s in x.f.nodes("call"):
        if n.callee.kind != "constfetch" or any(a.kind != "arg" or a.spread or a.name for a in n.args):
            continue
        a, b = s.names.other(n.callee.name.text, "function")
        sig = x.known.function(lower(a), lower(b) if b else None)
        if sig is None:
            continue
        need = max([i + 1 for i, p in enumerate(sig["p"]) if not p[2]], default=0)
        most = None if any(p[3] for p in sig["p"]) else len(sig["p"])
        given = len(n.args)
        if given < need or most is not None and given > most:
            arity = f"at least {need}" if most is None else str(need) if need == most else f"{need}-{most}"
            yield n.start, "arguments.count", f"Function {sig['name']} invoked with {given} {'parameter' if given == 1 else 'parameters'}, {arity} required."


@rule("return-type", 3)
def return_rule(x: Typed):
    yield from _returned(x, "function", "method")


@rule("closure.returnType", 3)
def closure_return_rule(x: Typed):
    yield from _returned(x, "closure")


@rule("arrowFunction.returnType", 3)
def arrow_return_rule(x: Typed):
    yield from _returned(x, "arrow")


def _returned(x: Typed, *kinds: str) -> Iterator[Hit]:
    for flow in x.flows:
        s = flow.scope
        if s.kind not in kinds or yields(s.body) and s.kind != "arrow":
            continue
        native = hint_type(render_hint(s.node.get("returns")), s.names, s.cls)
        if s.kind in ("function", "method"):
            sig = x.known.function(lower(s.name)) if s.kind == "function" else x.known.member("method", s.cls.fqn, lower(s.name))
            want = x.known.type(sig["r"], sig.get("t") or ()) if sig and sig.get("r") and s.node.get("returns") is not None or sig and sig.get("r") and "told" not in sig else None
        else:
            want = native
        if want is None or want in (VOID, NEVER, MIXED):
            continue
        if s.cls is not None:
            late = ("named", s.cls.fqn, ())
            want = ty.rewrite(want, lambda y, late=late: late if y[0] in ("static", "self") else union(*y[1]) if y[0] == "union" else y)
        label = {"function": f"function {s.name}()", "method": f"{s.cls.fqn if s.cls else ''}::{s.name}()"}.get(s.kind, "Anonymous function")
        for n, t in flow.returns:
            if t == VOID and n.get("value") is None:
                continue
            if t != VOID and not x.accepts(t, want):
                yield n.value.start, "return.type", f"{label} should return {x.show(want)} but returns {x.show(t)}{'' if s.kind in ('function', 'method') else '.'}"


@rule("assign.propertyType", 3)
def property_rule(x: Typed):
    for n in x.nodes("assign"):
        target = peel(n.target)
        if target.kind != "prop" or not isinstance(target.name, str):
            continue
        obj = strip_null(x.of(target.obj))
        got = x.known.member("property", obj[1], target.name) if obj[0] == "named" else None
        if got and got.get("type"):
            info = x.known.classes.get(lower(obj[1])) or {}
            want, t = x.known.type(got["type"], info.get("t") or ()), x.of(n.value)
            if not x.accepts(t, want):
                yield n.start, "assign.propertyType", f"Property {got['of']}::${target.name} ({x.show(want)}) does not accept {x.show(t)}."


@rule("property.defaultValue", 3)
def default_rule(x: Typed):
    from brambleq.php.knowledge import literal

    for c in x.f.classes:
        for p, i in c.props:
            v = constant_value(i.value) if i.value is not None else None
            got = x.known.member("property", c.fqn, i.name)
            if v is not None and got and got.get("type"):
                want, t = x.known.type(got["type"]), literal(v[0])
                if not x.accepts(t, want):
                    yield i.value.start, "property.defaultValue", f"{'Static property' if 'static' in p.mods else 'Property'} {c.fqn}::${i.name} ({x.show(want)}) does not accept default value of type {x.show(t)}."


def _no_object(t: Type) -> bool:
    return category(t) in ("int", "float", "string", "bool", "array") and len(arms(t)) == 1


@rule("method.nonObject", 2)
def method_receiver_rule(x: Typed):
    for n in x.nodes("mcall"):
        if isinstance(n.name, str) and _no_object(t := x.of(n.obj)):
            yield n.start, "method.nonObject", f"Cannot call method {n.name}() on {x.show(t)}."


@rule("method.nullableAccess", 8)
def nullable_method_rule(x: Typed):
    yield from _nullable(x, "mcall", "method", lambda n: f"Cannot call method {n.name}()")


@rule("property.nullableAccess", 8)
def nullable_property_rule(x: Typed):
    yield from _nullable(x, "prop", "property", lambda n: f"Cannot access property ${n.name}")


def _nullable(x: Typed, kind: str, code: str, lead) -> Iterator[Hit]:
    for n in x.nodes(kind):
        t = x.of(n.obj)
        if isinstance(n.name, str) and not n.nullsafe and NULL in arms(t) and len(arms(t)) > 1 and all(y[0] in ("named", "object", "case") for y in arms(strip_null(t))) and _read(x, n):
            yield n.start, f"{code}.nonObject", f"{lead(n)} on {x.show(t)}."


@rule("property.access", 0)
def property_receiver_rule(x: Typed):
    if x.options.level >= 2:
        for n in x.nodes("prop"):
            if isinstance(n.name, str) and _no_object(t := x.of(n.obj)) and _read(x, n):
                yield n.start, "property.nonObject", f"Cannot access property ${n.name} on {x.show(t)}."


@rule("nullsafe.neverNull", 4)
def nullsafe_rule(x: Typed):
    for kind, what in (("mcall", "method call"), ("prop", "property access")):
        for n in x.nodes(kind):
            t = x.of(n.obj)
            if n.nullsafe and not vague(t) and NULL not in arms(t):
                yield n.start, "nullsafe.neverNull", f"Using nullsafe {what} on non-nullable type {x.show(t)}. Use -> instead."


@rule("callable.nonCallable", 2)
def callable_rule(x: Typed):
    for n in x.nodes("call"):
        c = peel(n.callee)
        if c.kind == "constfetch" or any(a.kind == "placeholder" for a in n.args):
            continue
        t = x.of(c)
        if category(t) in ("int", "float", "bool") or t == NULL:
            yield n.start, "callable.nonCallable", f"Trying to invoke {x.show(t)} but it's not a callable."


@rule("throw.notThrowable", 3)
def throw_rule(x: Typed):
    for n in x.nodes("throw"):
        t = x.of(n.inner)
        if peel(n.inner).kind in ("int", "float", "string"):
            continue  # literals are told without types
        if category(t) in ("int", "float", "string", "bool", "array") or t == NULL:
            yield n.inner.start, "throw.notThrowable", f"Invalid type {x.show(t)} to throw."
        elif t[0] == "named" and x.known.whole(lower(t[1])) and not any(a in ("throwable", "exception", "error") for a in x.known.above(lower(t[1]))):
            yield n.inner.start, "throw.notThrowable", f"Invalid type {t[1]} to throw."


#: Functions whose call has no effect but its result.
PURE = {"strlen", "count", "sizeof", "strtolower", "strtoupper", "ucfirst", "lcfirst", "trim", "ltrim", "rtrim", "implode", "explode", "str_replace", "substr", "strpos", "in_array", "array_keys", "array_values", "array_merge", "array_map", "array_filter", "is_int", "is_string", "is_array", "is_null", "is_bool", "is_float", "max", "min", "abs", "floor", "ceil", "round", "sprintf", "md5", "sha1", "str_repeat", "str_contains", "array_sum", "array_reverse", "array_slice", "array_unique", "range", "intval", "floatval", "strval", "ord", "chr"}


@rule("deadCode.function.resultUnused", 4)
def unused_result(x: Typed):
    for n, s in x.f.nodes("expr"):
        c = peel(n.expr)
        if c.kind == "call" and c.callee.kind == "constfetch":
            a, b = s.names.other(c.callee.name.text, "function")
            name = lower((b or a).rsplit("\\", 1)[-1])
            if name in PURE and x.known.function(lower(a), lower(b) if b else None) is None and not any(peel(y.value).kind in ("closure", "arrow", "var") and name == "array_map" for y in c.args if y.kind == "arg"):
                yield n.start, "function.resultUnused", f"Call to function {name}() on a separate line has no effect."


@rule("generators.yieldFromType", 3)
def yield_from_rule(x: Typed):
    for n in x.nodes("yieldfrom"):
        if not_iterable(x, t := x.of(n.inner)):
            yield n.inner.start, "generator.nonIterable", f"Argument of an invalid type {x.show(t)} passed to yield from, only iterables are supported."
