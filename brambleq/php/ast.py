"""Syntax nodes.  A node has a kind, a byte span and named parts, which are nodes, lists of nodes or plain values."""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    __slots__ = ("kind", "start", "end", "parts")

    def __init__(self, kind: str, start: int, end: int, **parts) -> None:
        self.kind, self.start, self.end, self.parts = kind, start, end, parts

    def __getattr__(self, name: str):
        try:
            return self.parts[name]
        except KeyError:
            raise AttributeError(name) from None

    def get(self, name: str, default=None):
        return self.parts.get(name, default)

    def children(self) -> Iterator[tuple[str, Node]]:
        for role, v in self.parts.items():
            if isinstance(v, Node):
                yield role, v
            elif isinstance(v, list):
                for x in v:
                    if isinstance(x, Node):
                        yield role, x

    def walk(self) -> Iterator[Node]:
        """This node and all below, in pre-order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed([c for _, c in n.children()]))

    def __repr__(self) -> str:
        return sexpr(self)


#: Kinds that open a scope of variables of their own.
SCOPES = {"function", "method", "closure", "hook"}
CLASSES = {"class", "anonclass"}


def walk_scope(nodes: list[Node]) -> Iterator[Node]:
    """Pre-order over a body without entering functions, methods, closures or classes (arrow functions share the scope)."""
    stack = list(reversed(nodes))
    while stack:
        n = stack.pop()
        yield n
        if n.kind in SCOPES or n.kind in CLASSES:
            if n.kind == "closure":
                stack.extend(reversed(n.uses))
            continue
        stack.extend(reversed([c for _, c in n.children()]))


def sexpr(v) -> str:
    if isinstance(v, Node):
        inner = " ".join(f"{k}={sexpr(x)}" for k, x in v.parts.items() if x not in (None, [], False) and k != "doc")
        return f"({v.kind}{' ' if inner else ''}{inner})"
    if isinstance(v, list):
        return "[" + " ".join(map(sexpr, v)) + "]"
    return str(v)


def peel(n: Node) -> Node:
    """Without parentheses."""
    while n.kind == "paren":
        n = n.inner
    return n


def yields(body: list[Node]) -> bool:
    return any(n.kind in ("yield", "yieldfrom") for n in walk_scope(body))
