"""Parser for PHP: statements by descent, expressions by binding power.

Total: errors become rows of the diagnostics list and the parser resumes at the
next statement.  Docblocks attach to the token they precede.
"""

from __future__ import annotations

import re

from brambleq.php.ast import Node
from brambleq.php.lexer import literal_int, tokenize

MAX_DEPTH = 256
_MODIFIERS = {"T_PUBLIC": "public", "T_PROTECTED": "protected", "T_PRIVATE": "private", "T_STATIC": "static", "T_ABSTRACT": "abstract", "T_FINAL": "final", "T_READONLY": "readonly", "T_VAR": "var", "T_PUBLIC_SET": "public(set)", "T_PROTECTED_SET": "protected(set)", "T_PRIVATE_SET": "private(set)"}
_NAMES = {"T_STRING", "T_NAME_QUALIFIED", "T_NAME_FULLY_QUALIFIED", "T_NAME_RELATIVE"}
_AMP = {"T_AMPERSAND_FOLLOWED_BY_VAR_OR_VARARG", "T_AMPERSAND_NOT_FOLLOWED_BY_VAR_OR_VARARG"}
#: Binding powers of infix operators: (left, right); equal sides do not associate.
_LEFT = lambda n: (n, n + 1)
_RIGHT = lambda n: (n, n)
INFIX = {
    "T_LOGICAL_OR": _LEFT(2), "T_LOGICAL_XOR": _LEFT(4), "T_LOGICAL_AND": _LEFT(6),
    "T_COALESCE": _RIGHT(22), "T_BOOLEAN_OR": _LEFT(24), "T_BOOLEAN_AND": _LEFT(26), "|": _LEFT(28), "^": _LEFT(30), "&": _LEFT(32),
    "T_IS_EQUAL": _LEFT(34), "T_IS_NOT_EQUAL": _LEFT(34), "T_IS_IDENTICAL": _LEFT(34), "T_IS_NOT_IDENTICAL": _LEFT(34), "T_SPACESHIP": _LEFT(34),
    "<": _LEFT(36), ">": _LEFT(36), "T_IS_SMALLER_OR_EQUAL": _LEFT(36), "T_IS_GREATER_OR_EQUAL": _LEFT(36),
    "T_PIPE": _LEFT(38), ".": _LEFT(40), "T_SL": _LEFT(42), "T_SR": _LEFT(42), "+": _LEFT(44), "-": _LEFT(44), "*": _LEFT(46), "/": _LEFT(46), "%": _LEFT(46),
    "T_POW": _RIGHT(56),
}
_NOT, _INSTANCEOF, _UNARY, _CLONE = 48, 50, 54, 58
_TERNARY, _ASSIGN, _YIELD, _PRINT = 20, 18, 12, 10
_ASSIGN_OPS = {"T_PLUS_EQUAL", "T_MINUS_EQUAL", "T_MUL_EQUAL", "T_DIV_EQUAL", "T_CONCAT_EQUAL", "T_MOD_EQUAL", "T_AND_EQUAL", "T_OR_EQUAL", "T_XOR_EQUAL", "T_SL_EQUAL", "T_SR_EQUAL", "T_POW_EQUAL", "T_COALESCE_EQUAL"}
_WRITABLE = {"var", "index", "prop", "sprop", "array", "list"}
_MAGIC = {"T_CLASS_C", "T_DIR", "T_FILE", "T_FUNC_C", "T_LINE", "T_METHOD_C", "T_NS_C", "T_TRAIT_C", "T_PROPERTY_C"}
_INCLUDE = {"T_INCLUDE", "T_INCLUDE_ONCE", "T_REQUIRE", "T_REQUIRE_ONCE"}
_ESC = {"n": "\n", "t": "\t", "r": "\r", "v": "\v", "e": "\x1b", "f": "\f", "\\": "\\", "$": "$"}
_ESCAPE = re.compile(r"\\(?:([ntrvef\\$])|([0-7]{1,3})|x([0-9a-fA-F]{1,2})|u\{([0-9a-fA-F]+)\}|(.))", re.DOTALL)


class Stop(Exception):
    pass


def unescape(s: str, quote: str) -> str:
    """The value of the inside of a literal; ``quote`` is its delimiter."""
    if quote == "'":
        return re.sub(r"\\([\\'])", r"\1", s)

    def one(m: re.Match) -> str:
        if m[1]:
            return _ESC[m[1]]
        if m[2]:
            return chr(int(m[2], 8) & 255)
        if m[3]:
            return chr(int(m[3], 16))
        if m[4]:
            c = int(m[4], 16)
            return chr(c).encode("utf-8", "replace").decode("latin-1") if c < 0x110000 else m.group()
        return m[5] if m[5] == quote else m.group()

    return _ESCAPE.sub(one, s)


class Parser:
    def __init__(self, text: str) -> None:
        self.text = text
        self.names: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.docs: list[tuple[int, int] | None] = []
        doc = None
        for name, s, e in tokenize(text):
            if name == "T_DOC_COMMENT":
                doc = (s, e)
            elif name not in ("T_WHITESPACE", "T_COMMENT", "T_OPEN_TAG"):
                self.names.append(";" if name == "T_CLOSE_TAG" else "T_ECHO" if name == "T_OPEN_TAG_WITH_ECHO" else name)
                self.spans.append((s, e))
                self.docs.append(doc)
                doc = None
        self.names.append("")
        self.spans.append((len(text), len(text)))
        self.docs.append(doc)
        self.at = 0
        self.depth = 0
        self.errors: list[tuple[int, str]] = []

    # -- tokens

    @property
    def tok(self) -> str:
        return self.names[self.at]

    def peek(self, n: int = 1) -> str:
        return self.names[min(self.at + n, len(self.names) - 1)]

    def raw(self, at: int | None = None) -> str:
        s, e = self.spans[self.at if at is None else at]
        return self.text[s:e]

    def start(self) -> int:
        return self.spans[self.at][0]

    def end(self) -> int:
        return self.spans[self.at - 1][1] if self.at else 0

    def next(self) -> str:
        t = self.raw()
        if self.at < len(self.names) - 1:
            self.at += 1
        return t

    def has(self, *names: str) -> bool:
        return self.names[self.at] in names

    def take(self, name: str) -> bool:
        if self.names[self.at] == name:
            self.at += 1
            return True
        return False

    def need(self, name: str) -> str:
        if self.names[self.at] != name:
            self.fail(f"expected {name}, found {self.raw() or 'end of file'}")
        return self.next()

    def fail(self, why: str):
        self.errors.append((self.start(), f"Syntax error, {why}"))
        raise Stop

    def doc(self) -> str | None:
        d = self.docs[self.at]
        return self.text[d[0] : d[1]] if d else None

    def semicolon(self) -> None:
        if not self.take(";") and not self.has("", "T_INLINE_HTML"):
            self.fail(f"unexpected {self.raw()}")

    def amp(self) -> bool:
        if self.tok in _AMP:
            self.at += 1
            return True
        return False

    # -- statements

    def program(self) -> Node:
        body = self.statements(("",))
        return Node("file", 0, len(self.text), body=body)

    def statements(self, until: tuple[str, ...]) -> list[Node]:
        out: list[Node] = []
        while not self.has("", *until) or self.has("") and "" not in until and False:
            if self.has(""):
                break
            before = self.at
            try:
                self.depth += 1
                if self.depth > MAX_DEPTH:
                    self.fail("nested too deeply")
                out.append(self.statement())
            except Stop:
                self.sync(before)
                out.append(Node("error", self.spans[before][0], self.end()))
            finally:
                self.depth -= 1
        return out

    def sync(self, before: int) -> None:
        """Go on after the next semicolon, or before a brace or a word that begins a statement."""
        if self.at == before:
            self.at += 1
        while not self.has("", "}", "T_FUNCTION", "T_CLASS", "T_IF", "T_FOREACH", "T_FOR", "T_WHILE", "T_RETURN", "T_NAMESPACE", "T_USE", "T_INTERFACE", "T_TRAIT", "T_PUBLIC", "T_PRIVATE", "T_PROTECTED", "T_ECHO"):
            if self.take(";"):
                return
            self.at += 1
        if self.has("}") and self.depth <= 1:
            self.at += 1
        self.at = min(self.at, len(self.names) - 1)

    def block(self) -> list[Node]:
        self.need("{")
        out = self.statements(("}",))
        self.need("}")
        return out

    def body(self, *ends: str) -> list[Node]:
        """A statement, or the alternative form up to one of ``ends``."""
        if self.take(":"):
            return self.statements(ends)
        s = self.statement()
        return s.body if s.kind == "block" else [s]

    def statement(self) -> Node:
        s, t = self.start(), self.tok
        make = getattr(self, f"st_{t[2:].lower()}", None) if t.startswith("T_") else None
        if t == "{":
            body = self.block()
            return Node("block", s, self.end(), body=body)
        if t == ";":
            self.at += 1
            return Node("nop", s, self.end())
        if t == "T_INLINE_HTML":
            self.at += 1
            return Node("html", s, self.end())
        if t == "T_ATTRIBUTE":
            return self.attributed()
        if t in ("T_ABSTRACT", "T_FINAL", "T_CLASS", "T_INTERFACE", "T_TRAIT", "T_ENUM") or t == "T_READONLY" and self.peek() != "(":
            return self.class_()
        if t == "T_FUNCTION" and (self.peek() in _NAMES or self.peek() in _AMP and self.peek(2) in _NAMES or self.peek() in ("T_ENUM", "T_READONLY")):
            return self.function()
        if t == "T_STATIC" and self.peek() == "T_VARIABLE":
            return self.static()
        if t == "T_STRING" and self.peek() == ":" and self.peek(2) != ":":
            name = self.next()
            self.at += 1
            return Node("label", s, self.end(), name=name)
        if t == "T_NAMESPACE" and self.peek() in (*_NAMES, "{"):
            return self.namespace()
        if make and t not in ("T_STATIC", "T_FUNCTION", "T_NAMESPACE"):
            return make()
        e = self.expr()
        self.semicolon()
        return Node("expr", s, self.end(), expr=e)

    def attributed(self) -> Node:
        s, attrs, doc = self.start(), self.attributes(), self.doc()
        if self.has("T_FUNCTION") and (self.peek() in _NAMES or self.peek() in _AMP and self.peek(2) in _NAMES):
            n = self.function()
        elif self.has("T_ABSTRACT", "T_FINAL", "T_CLASS", "T_INTERFACE", "T_TRAIT", "T_ENUM", "T_READONLY"):
            n = self.class_()
        elif self.has("T_CONST"):
            n = self.st_const()
        else:
            e = self.expr()
            self.semicolon()
            n = Node("expr", s, self.end(), expr=e)
            return n
        n.parts["attrs"] = attrs
        n.parts["doc"] = n.get("doc") or doc
        n.start = s
        return n

    def attributes(self) -> list[Node]:
        out: list[Node] = []
        while self.take("T_ATTRIBUTE"):
            while not self.has("]", ""):
                s = self.start()
                name = self.name()
                args = self.args() if self.has("(") else []
                out.append(Node("attribute", s, self.end(), name=name, args=args))
                if not self.take(","):
                    break
            self.need("]")
        return out

    def st_echo(self) -> Node:
        s = self.start()
        self.at += 1
        exprs = [self.expr()]
        while self.take(","):
            exprs.append(self.expr())
        self.semicolon()
        return Node("echo", s, self.end(), exprs=exprs)

    def st_return(self) -> Node:
        s = self.start()
        self.at += 1
        e = None if self.has(";", "", "T_INLINE_HTML") else self.expr()
        self.semicolon()
        return Node("return", s, self.end(), value=e)

    def st_if(self) -> Node:
        s = self.start()
        self.at += 1
        self.need("(")
        cond = self.expr()
        self.need(")")
        alt = self.has(":")
        then = self.body("T_ELSEIF", "T_ELSE", "T_ENDIF")
        other: list[Node] = []
        has_else = False
        if self.has("T_ELSEIF") or self.has("T_ELSE") and self.peek() == "T_IF" and not alt:
            if self.has("T_ELSE"):
                self.at += 1
            other, has_else = [self.st_if_chain(alt)], True
            return Node("if", s, self.end(), cond=cond, then=then, other=other, has_else=has_else)
        if self.take("T_ELSE"):
            other, has_else = self.body("T_ENDIF"), True
        if alt:
            self.need("T_ENDIF")
            self.semicolon()
        return Node("if", s, self.end(), cond=cond, then=then, other=other, has_else=has_else)

    def st_if_chain(self, alt: bool) -> Node:
        n = self.st_if()
        n.parts["chained"] = True
        return n

    def st_while(self) -> Node:
        s = self.start()
        self.at += 1
        self.need("(")
        cond = self.expr()
        self.need(")")
        alt = self.has(":")
        body = self.body("T_ENDWHILE")
        if alt:
            self.need("T_ENDWHILE")
            self.semicolon()
        return Node("while", s, self.end(), cond=cond, body=body)

    def st_do(self) -> Node:
        s = self.start()
        self.at += 1
        body = self.body()
        self.need("T_WHILE")
        self.need("(")
        cond = self.expr()
        self.need(")")
        self.semicolon()
        return Node("dowhile", s, self.end(), body=body, cond=cond)

    def st_for(self) -> Node:
        s = self.start()
        self.at += 1
        self.need("(")
        parts = []
        for end in (";", ";", ")"):
            part: list[Node] = []
            while not self.has(end, ""):
                part.append(self.expr())
                if not self.take(","):
                    break
            self.need(end)
            parts.append(part)
        alt = self.has(":")
        body = self.body("T_ENDFOR")
        if alt:
            self.need("T_ENDFOR")
            self.semicolon()
        return Node("for", s, self.end(), init=parts[0], cond=parts[1], step=parts[2], body=body)

    def st_foreach(self) -> Node:
        s = self.start()
        self.at += 1
        self.need("(")
        subject = self.expr()
        self.need("T_AS")
        key, by_ref = None, self.amp()
        value = self.expr()
        if self.take("T_DOUBLE_ARROW"):
            key, by_ref = value, self.amp()
            value = self.expr()
        self.need(")")
        alt = self.has(":")
        body = self.body("T_ENDFOREACH")
        if alt:
            self.need("T_ENDFOREACH")
            self.semicolon()
        return Node("foreach", s, self.end(), subject=subject, key=key, value=value, by_ref=by_ref, body=body)

    def st_switch(self) -> Node:
        s = self.start()
        self.at += 1
        self.need("(")
        subject = self.expr()
        self.need(")")
        alt = self.take(":")
        end = "T_ENDSWITCH" if alt else "}"
        if not alt:
            self.need("{")
        cases = []
        self.take(";")
        while self.has("T_CASE", "T_DEFAULT"):
            cs = self.start()
            test = self.expr() if self.next().lower() == "case" else None
            if not self.take(":"):
                self.need(";")
            body = self.statements(("T_CASE", "T_DEFAULT", end))
            cases.append(Node("case", cs, self.end(), test=test, body=body))
        self.need(end)
        if alt:
            self.semicolon()
        return Node("switch", s, self.end(), subject=subject, cases=cases)

    def st_try(self) -> Node:
        s = self.start()
        self.at += 1
        body, catches, final = self.block(), [], None
        while self.has("T_CATCH"):
            cs = self.start()
            self.at += 1
            self.need("(")
            types = [self.name()]
            while self.take("|"):
                types.append(self.name())
            var = self.next()[1:] if self.has("T_VARIABLE") else None
            self.need(")")
            catches.append(Node("catch", cs, self.end(), types=types, var=var, body=self.block()))
        if self.take("T_FINALLY"):
            final = Node("finally", self.start(), self.end(), body=self.block())
        if not catches and final is None:
            self.fail("try without catch or finally")
        return Node("try", s, self.end(), body=body, catches=catches, final=final)

    def _jump(self, kind: str) -> Node:
        s = self.start()
        self.at += 1
        level = None if self.has(";", "", "T_INLINE_HTML") else self.expr()
        self.semicolon()
        return Node(kind, s, self.end(), level=level)

    def st_break(self) -> Node:
        return self._jump("break")

    def st_continue(self) -> Node:
        return self._jump("continue")

    def st_goto(self) -> Node:
        s = self.start()
        self.at += 1
        name = self.need("T_STRING")
        self.semicolon()
        return Node("goto", s, self.end(), name=name)

    def st_global(self) -> Node:
        s = self.start()
        self.at += 1
        names = [self.primary()]
        while self.take(","):
            names.append(self.primary())
        self.semicolon()
        return Node("global", s, self.end(), vars=names)

    def static(self) -> Node:
        s = self.start()
        self.at += 1
        items = []
        while True:
            vs, name = self.start(), self.need("T_VARIABLE")[1:]
            value = self.expr() if self.take("=") else None
            items.append(Node("staticvar", vs, self.end(), name=name, value=value))
            if not self.take(","):
                break
        self.semicolon()
        return Node("static", s, self.end(), items=items)

    def st_unset(self) -> Node:
        s = self.start()
        self.at += 1
        self.need("(")
        items = []
        while not self.has(")", ""):
            items.append(self.expr())
            if not self.take(","):
                break
        self.need(")")
        self.semicolon()
        return Node("unset", s, self.end(), vars=items)

    def st_declare(self) -> Node:
        s = self.start()
        self.at += 1
        self.need("(")
        items = []
        while not self.has(")", ""):
            ds, name = self.start(), self.next()
            self.need("=")
            items.append(Node("directive", ds, self.end(), name=name, value=self.expr()))
            if not self.take(","):
                break
        self.need(")")
        body = None
        if self.has("{", ":"):
            alt = self.has(":")
            body = self.body("T_ENDDECLARE")
            if alt:
                self.need("T_ENDDECLARE")
                self.semicolon()
        else:
            self.semicolon()
        return Node("declare", s, self.end(), items=items, body=body)

    def namespace(self) -> Node:
        s = self.start()
        self.at += 1
        name = "" if self.has("{") else self.name().text
        if self.has("{"):
            return Node("namespace", s, self.end(), name=name, body=self.block(), braced=True)
        self.semicolon()
        return Node("namespace", s, self.end(), name=name, body=None, braced=False)

    def st_use(self) -> Node:
        s = self.start()
        self.at += 1
        kind = self._use_kind() or "class"
        items: list[Node] = []
        while True:
            us = self.start()
            name = self.raw()
            if not self.has(*_NAMES, "T_NS_SEPARATOR") and not self.tok.startswith("T_"):
                self.fail(f"unexpected {name}")
            self.at += 1
            if self.take("T_NS_SEPARATOR") or name.endswith("\\"):
                self.need("{")
                while not self.has("}", ""):
                    gs = self.start()
                    k = self._use_kind() or kind
                    part = self.name().text
                    items.append(self._use_item(gs, k, name.strip("\\") + "\\" + part))
                    if not self.take(","):
                        break
                self.need("}")
            else:
                items.append(self._use_item(us, kind, name.lstrip("\\")))
            if not self.take(","):
                break
        self.semicolon()
        return Node("use", s, self.end(), items=items)

    def _use_kind(self) -> str | None:
        if self.has("T_FUNCTION", "T_CONST"):
            return {"function": "function", "const": "const"}[self.next().lower()]
        return None

    def _use_item(self, s: int, kind: str, target: str) -> Node:
        alias = self.next() if self.take("T_AS") else target.rsplit("\\", 1)[-1]
        return Node("useitem", s, self.end(), use=kind, target=target, alias=alias)

    def st_const(self) -> Node:
        s, doc = self.start(), self.doc()
        self.at += 1
        items = []
        while True:
            cs, name = self.start(), self.next()
            self.need("=")
            items.append(Node("constitem", cs, self.end(), name=name, value=self.expr()))
            if not self.take(","):
                break
        self.semicolon()
        return Node("const", s, self.end(), items=items, doc=doc)

    def st_halt_compiler(self) -> Node:
        s = self.start()
        self.at = len(self.names) - 1
        return Node("halt", s, self.end())

    def function(self) -> Node:
        s, doc = self.start(), self.doc()
        self.at += 1
        by_ref = self.amp()
        ns, name = self.start(), self.next()
        params = self.params()
        ret = self.hint() if self.take(":") else None
        body = self.block()
        return Node("function", s, self.end(), name=name, name_at=ns, by_ref=by_ref, params=params, returns=ret, body=body, doc=doc, attrs=[])

    def params(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.has(")", ""):
            s, doc = self.start(), self.doc()
            attrs = self.attributes()
            mods = []
            while self.tok in _MODIFIERS:
                mods.append(_MODIFIERS[self.tok])
                self.at += 1
            hint = None if self.has("T_VARIABLE", "T_ELLIPSIS", *_AMP) and not (self.tok in _AMP and False) else self.hint()
            by_ref = self.amp()
            variadic = self.take("T_ELLIPSIS")
            name = self.need("T_VARIABLE")[1:]
            default = self.expr() if self.take("=") else None
            hooks = self.hooks() if self.has("{") else None
            out.append(Node("param", s, self.end(), name=name, hint=hint, by_ref=by_ref, variadic=variadic, default=default, mods=mods, attrs=attrs, hooks=hooks, doc=doc))
            if not self.take(","):
                break
        self.need(")")
        return out

    def hint(self) -> Node:
        s = self.start()
        if self.take("?"):
            inner = self.hint_atom()
            return Node("nullable", s, self.end(), inner=inner)
        items, op = [self.hint_atom()], None
        while self.has("|") or self.tok in _AMP and not (self.tok == "T_AMPERSAND_FOLLOWED_BY_VAR_OR_VARARG"):
            op = "union" if self.has("|") else op or "intersection"
            self.at += 1
            items.append(self.hint_atom())
        return items[0] if len(items) == 1 else Node(op, s, self.end(), items=items)

    def hint_atom(self) -> Node:
        s = self.start()
        if self.take("("):
            h = self.hint()
            self.need(")")
            return h
        if self.has("T_ARRAY", "T_CALLABLE", "T_STATIC"):
            return Node("name", s, self.end() if False else self.spans[self.at][1], text=self.next())
        return self.name()

    def name(self) -> Node:
        s = self.start()
        if not self.has(*_NAMES, "T_STATIC", "T_ENUM", "T_READONLY"):
            if self.tok.startswith("T_") and self.raw().isidentifier() and not self.has("T_VARIABLE"):
                return Node("name", s, self.spans[self.at][1], text=self.next())
            self.fail(f"unexpected {self.raw() or 'end of file'}, expected a name")
        text = self.next()
        return Node("name", s, self.end(), text=text)

    # -- classes

    def class_(self) -> Node:
        s, doc, mods = self.start(), self.doc(), []
        while self.tok in _MODIFIERS:
            mods.append(_MODIFIERS[self.tok])
            self.at += 1
        kind = self.next().lower()
        if kind not in ("class", "interface", "trait", "enum"):
            self.at -= 1
            self.fail(f"unexpected {self.raw()}")
        ns, name = self.start(), self.next()
        backing = self.hint() if kind == "enum" and self.take(":") else None
        extends, implements = [], []
        if self.take("T_EXTENDS"):
            extends = self._names()
        if self.take("T_IMPLEMENTS"):
            implements = self._names()
        members = self.members()
        return Node("class", s, self.end(), what=kind, name=name, name_at=ns, mods=mods, backing=backing, extends=extends, implements=implements, members=members, doc=doc, attrs=[])

    def _names(self) -> list[Node]:
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        return out

    def members(self) -> list[Node]:
        self.need("{")
        out: list[Node] = []
        while not self.has("}", ""):
            before = self.at
            try:
                out.append(self.member())
            except Stop:
                self.sync(before)
        self.need("}")
        return out

    def member(self) -> Node:
        s, doc = self.start(), self.doc()
        if self.has("T_USE"):
            return self.trait_use()
        attrs = self.attributes()
        doc = doc or self.doc()
        if self.has("T_CASE"):
            self.at += 1
            name = self.next()
            value = self.expr() if self.take("=") else None
            self.semicolon()
            return Node("enumcase", s, self.end(), name=name, value=value, doc=doc, attrs=attrs)
        mods = []
        while self.tok in _MODIFIERS:
            mods.append(_MODIFIERS[self.tok])
            self.at += 1
        if self.take("T_CONST"):
            hint = self.hint() if self.peek() != "=" else None
            items = []
            while True:
                cs, name = self.start(), self.next()
                self.need("=")
                items.append(Node("constitem", cs, self.end(), name=name, value=self.expr()))
                if not self.take(","):
                    break
            self.semicolon()
            return Node("classconst", s, self.end(), mods=mods, hint=hint, items=items, doc=doc, attrs=attrs)
        if self.take("T_FUNCTION"):
            by_ref = self.amp()
            ns, name = self.start(), self.next()
            params = self.params()
            ret = self.hint() if self.take(":") else None
            body = self.block() if self.has("{") else None
            if body is None:
                self.semicolon()
            return Node("method", s, self.end(), name=name, name_at=ns, mods=mods, by_ref=by_ref, params=params, returns=ret, body=body, doc=doc, attrs=attrs)
        hint = None if self.has("T_VARIABLE") else self.hint()
        items = []
        while True:
            ps, name = self.start(), self.need("T_VARIABLE")[1:]
            value = self.expr() if self.take("=") else None
            hooks = self.hooks() if self.has("{") else None
            items.append(Node("propitem", ps, self.end(), name=name, value=value, hooks=hooks))
            if hooks is not None or not self.take(","):
                break
        if items[-1].hooks is None:
            self.semicolon()
        return Node("property", s, self.end(), mods=mods, hint=hint, items=items, doc=doc, attrs=attrs)

    def hooks(self) -> list[Node]:
        self.need("{")
        out = []
        while not self.has("}", ""):
            s = self.start()
            self.attributes()
            mods = []
            while self.tok in _MODIFIERS:
                mods.append(_MODIFIERS[self.tok])
                self.at += 1
            self.amp()
            name = self.next()
            params = self.params() if self.has("(") else []
            body = None
            if self.take("T_DOUBLE_ARROW"):
                e = self.expr()
                self.semicolon()
                body = [Node("return", e.start, e.end, value=e)]
            elif self.has("{"):
                body = self.block()
            else:
                self.semicolon()
            out.append(Node("hook", s, self.end(), name=name, mods=mods, params=params, body=body))
        self.need("}")
        return out

    def trait_use(self) -> Node:
        s = self.start()
        self.at += 1
        names, rules = self._names(), []
        if self.take("{"):
            while not self.has("}", ""):
                rs = self.start()
                a, cls = self.name(), None
                if self.take("T_DOUBLE_COLON"):
                    cls, a = a, self.name()
                if self.take("T_INSTEADOF"):
                    rules.append(Node("insteadof", rs, self.end(), cls=cls, method=a.text, others=self._names()))
                else:
                    self.need("T_AS")
                    vis = _MODIFIERS[self.tok] if self.tok in _MODIFIERS else None
                    if vis:
                        self.at += 1
                    alias = None if self.has(";") else self.next()
                    rules.append(Node("traitalias", rs, self.end(), cls=cls, method=a.text, alias=alias, vis=vis))
                self.semicolon()
            self.need("}")
        else:
            self.semicolon()
        return Node("traituse", s, self.end(), names=names, rules=rules)

    # -- expressions

    def expr(self, power: int = 0) -> Node:
        self.depth += 1
        try:
            if self.depth > MAX_DEPTH:
                self.fail("nested too deeply")
            return self._expr(power)
        finally:
            self.depth -= 1

    def _expr(self, power: int) -> Node:
        left = self.prefix()
        while True:
            t = self.tok
            if t == "=" and (left.kind in _WRITABLE or power <= _ASSIGN):
                self.at += 1
                if self.amp():
                    right = self.expr(_ASSIGN)
                    left = Node("assignref", left.start, self.end(), target=left, value=right)
                else:
                    right = self.expr(_ASSIGN)
                    left = Node("assign", left.start, self.end(), target=left, value=right)
                continue
            if t in _ASSIGN_OPS and (left.kind in _WRITABLE or power <= _ASSIGN):
                op = self.next()
                right = self.expr(_ASSIGN)
                left = Node("assignop", left.start, self.end(), op=op[:-1], target=left, value=right)
                continue
            if t == "?" and power <= _TERNARY:
                self.at += 1
                then = None if self.has(":") else self.expr()
                self.need(":")
                other = self.expr(_TERNARY + 1)
                left = Node("ternary", left.start, self.end(), cond=left, then=then, other=other)
                continue
            if t == "T_INSTANCEOF" and power <= _INSTANCEOF:
                self.at += 1
                cls = self.name() if self.has(*_NAMES, "T_STATIC") else self.expr(_UNARY)
                left = Node("instanceof", left.start, self.end(), value=left, cls=cls)
                continue
            key = "&" if t in _AMP else t
            if key not in INFIX or INFIX[key][0] < power:
                return left
            op = self.next()
            right = self.expr(INFIX[key][1])
            left = Node("bin", left.start, self.end(), op=op.lower(), left=left, right=right)

    def prefix(self) -> Node:
        s, t = self.start(), self.tok
        if t in ("!", "-", "+", "~"):
            self.at += 1
            e = self.expr(_NOT if t == "!" else _UNARY)
            return Node("unary", s, self.end(), op=t, inner=e)
        if t in ("T_INC", "T_DEC"):
            self.at += 1
            e = self.expr(_UNARY)
            return Node("incdec", s, self.end(), op=self.text[s : s + 2], prefix=True, target=e)
        if t.endswith("_CAST"):
            word = self.next()
            e = self.expr(_UNARY)
            return Node("cast", s, self.end(), to=t[2:-5].lower(), word=word[1:-1].strip().lower(), inner=e)
        if t == "@":
            self.at += 1
            e = self.expr(_UNARY)
            return Node("suppress", s, self.end(), inner=e)
        if t in _AMP:
            self.at += 1
            e = self.expr(_UNARY)
            return Node("ref", s, self.end(), inner=e)
        if t == "T_CLONE" and self.peek() != "(":
            self.at += 1
            e = self.expr(_CLONE)
            return Node("clone", s, self.end(), inner=e)
        if t == "T_PRINT":
            self.at += 1
            e = self.expr(_PRINT)
            return Node("print", s, self.end(), inner=e)
        if t == "T_THROW":
            self.at += 1
            e = self.expr()
            return Node("throw", s, self.end(), inner=e)
        if t in _INCLUDE:
            what = self.next().lower()
            e = self.expr(_PRINT)
            return Node("include", s, self.end(), what=what, inner=e)
        if t == "T_YIELD":
            self.at += 1
            if self.has(";", ")", ",", "]", ":", ""):
                return Node("yield", s, self.end(), key=None, value=None)
            value, key = self.expr(_YIELD), None
            if self.take("T_DOUBLE_ARROW"):
                key, value = value, self.expr(_YIELD)
            return Node("yield", s, self.end(), key=key, value=value)
        if t == "T_YIELD_FROM":
            self.at += 1
            e = self.expr(_YIELD)
            return Node("yieldfrom", s, self.end(), inner=e)
        return self.postfix(self.primary())

    def primary(self) -> Node:
        s, t = self.start(), self.tok
        if t == "T_VARIABLE":
            name = self.next()[1:]
            return Node("var", s, self.end(), name=name)
        if t == "$":
            self.at += 1
            if self.take("{"):
                e = self.expr()
                self.need("}")
            else:
                e = self.primary()
            return Node("var", s, self.end(), name=None, expr=e)
        if t == "T_LNUMBER":
            return Node("int", s, self.spans[self.at][1], value=literal_int(self.next()))
        if t == "T_DNUMBER":
            raw = self.next().replace("_", "")
            low = raw.lower()
            value = float(raw) if not low.startswith(("0x", "0b", "0o")) and (set(raw) & set(".eE") or raw[0] != "0") else float(literal_int(raw))
            return Node("float", s, self.end(), value=value)
        if t == "T_CONSTANT_ENCAPSED_STRING":
            raw = self.next()
            raw = raw[1:] if raw[0] in "bB" else raw
            return Node("string", s, self.end(), value=unescape(raw[1:-1], raw[0]))
        if t in ('"', "`", "T_START_HEREDOC"):
            return self.interpolated()
        if t in ("[", "T_ARRAY", "T_LIST"):
            return self.array()
        if t == "(":
            self.at += 1
            e = self.expr()
            self.need(")")
            return Node("paren", s, self.end(), inner=e)
        if t == "T_NEW":
            return self.new()
        if t in ("T_ISSET", "T_EMPTY", "T_EVAL"):
            word = self.next().lower()
            self.need("(")
            items = []
            while not self.has(")", ""):
                items.append(self.expr())
                if not self.take(","):
                    break
            self.need(")")
            if word == "isset":
                return Node("isset", s, self.end(), vars=items)
            if not items:
                self.fail("expected an expression")
            return Node(word, s, self.end(), inner=items[0])
        if t == "T_EXIT":
            self.at += 1
            args = self.args() if self.has("(") else []
            return Node("exit", s, self.end(), args=args)
        if t == "T_CLONE":
            self.at += 1
            args = self.args()
            return Node("clone", s, self.end(), inner=args[0].value if args and args[0].kind == "arg" else Node("error", s, s), args=args)
        if t == "T_MATCH":
            return self.match()
        if t == "T_ATTRIBUTE":
            attrs = self.attributes()
            if self.has("T_NEW"):
                return self.new()
            e = self.closure()
            e.parts["attrs"] = attrs
            return e
        if t in ("T_FUNCTION", "T_FN") or t == "T_STATIC" and self.peek() in ("T_FUNCTION", "T_FN"):
            return self.closure()
        if t in _MAGIC:
            return Node("magic", s, self.spans[self.at][1], name=self.next())
        if t in (*_NAMES, "T_STATIC", "T_ENUM", "T_READONLY"):
            return self.name()
        self.fail(f"unexpected {self.raw() or 'end of file'}")

    def postfix(self, e: Node) -> Node:
        while True:
            t = self.tok
            if t == "[":
                self.at += 1
                i = None if self.has("]") else self.expr()
                self.need("]")
                e = Node("index", e.start, self.end(), base=e, index=i)
            elif t == "{" and e.kind in ("index",) and False:
                return e
            elif t in ("T_OBJECT_OPERATOR", "T_NULLSAFE_OBJECT_OPERATOR"):
                self.at += 1
                ns = self.start()
                name = self.member_name()
                safe = t == "T_NULLSAFE_OBJECT_OPERATOR"
                if self.has("("):
                    e = Node("mcall", e.start, self.end(), obj=e, name=name, name_at=ns, args=self.args(), nullsafe=safe)
                    e.end = self.end()
                else:
                    e = Node("prop", e.start, self.end(), obj=e, name=name, name_at=ns, nullsafe=safe)
            elif t == "T_DOUBLE_COLON":
                self.at += 1
                ns = self.start()
                if self.has("T_VARIABLE", "$"):
                    v = self.primary()
                    if self.has("("):
                        e = Node("scall", e.start, self.end(), cls=e, name=v, name_at=ns, args=self.args())
                        e.end = self.end()
                    else:
                        e = Node("sprop", e.start, self.end(), cls=e, name=v.name or v, name_at=ns)
                else:
                    name = self.member_name()
                    if self.has("("):
                        e = Node("scall", e.start, self.end(), cls=e, name=name, name_at=ns, args=self.args())
                        e.end = self.end()
                    else:
                        e = Node("cconst", e.start, self.end(), cls=e, name=name, name_at=ns)
            elif t == "(":
                e = Node("constfetch", e.start, e.end, name=e) if e.kind == "name" else e
                e = Node("call", e.start, self.end(), callee=e, args=self.args())
                e.end = self.end()
            elif t in ("T_INC", "T_DEC"):
                op = self.next()
                e = Node("incdec", e.start, self.end(), op=op, prefix=False, target=e)
            else:
                return Node("constfetch", e.start, e.end, name=e) if e.kind == "name" and t not in ("T_VARIABLE",) else e

    def member_name(self):
        """A word of any kind as text, or an expression."""
        if self.take("{"):
            e = self.expr()
            self.need("}")
            return e
        if self.has("T_VARIABLE", "$"):
            return self.primary()
        if self.tok.startswith("T_") and re.fullmatch(r"[A-Za-z_\x80-\xff][\w\x80-\xff]*", self.raw()):
            return self.next()
        self.fail(f"unexpected {self.raw() or 'end of file'}")

    def args(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.has(")", ""):
            s = self.start()
            if self.has("T_ELLIPSIS") and self.peek() == ")":
                self.at += 1
                out.append(Node("placeholder", s, self.end()))
                break
            if self.has("?") and self.peek() in (")", ","):
                self.at += 1
                out.append(Node("placeholder", s, self.end()))
            else:
                spread = self.take("T_ELLIPSIS")
                name = None
                if self.peek() == ":" and self.peek(2) != ":" and self.tok.startswith("T_") and self.raw().replace("_", "a").isalnum() and not self.has("T_LNUMBER", "T_VARIABLE", "T_DNUMBER"):
                    name = self.next()
                    self.at += 1
                v = self.expr()
                out.append(Node("arg", s, self.end(), value=v, spread=spread, name=name))
            if not self.take(","):
                break
        self.need(")")
        return out

    def new(self) -> Node:
        s = self.start()
        self.at += 1
        attrs = self.attributes()
        mods = []
        while self.has("T_READONLY", "T_FINAL", "T_ABSTRACT") and self.peek() in ("T_CLASS", "T_READONLY", "T_FINAL"):
            mods.append(_MODIFIERS[self.tok])
            self.at += 1
        if self.has("T_CLASS"):
            cs = self.start()
            self.at += 1
            args = self.args() if self.has("(") else []
            extends = [self.name()] if self.take("T_EXTENDS") else []
            implements = self._names() if self.take("T_IMPLEMENTS") else []
            members = self.members()
            cls = Node("anonclass", cs, self.end(), what="class", name=None, mods=mods, extends=extends, implements=implements, members=members, attrs=attrs, doc=None)
            return Node("new", s, self.end(), cls=cls, args=args)
        if self.take("("):
            cls = self.expr()
            self.need(")")
        elif self.has("T_VARIABLE", "$"):
            cls = self.primary()
            while self.has("[", "T_OBJECT_OPERATOR", "T_NULLSAFE_OBJECT_OPERATOR", "T_DOUBLE_COLON"):
                if self.take("["):
                    i = self.expr()
                    self.need("]")
                    cls = Node("index", cls.start, self.end(), base=cls, index=i)
                else:
                    static = self.next() == "::"
                    ns = self.start()
                    name = self.member_name()
                    cls = Node("sprop", cls.start, self.end(), cls=cls, name=name.name if isinstance(name, Node) and name.name else name, name_at=ns) if static else Node("prop", cls.start, self.end(), obj=cls, name=name, name_at=ns, nullsafe=False)
        else:
            cls = self.name()
        args = self.args() if self.has("(") else []
        return Node("new", s, self.end(), cls=cls, args=args)

    def match(self) -> Node:
        s = self.start()
        self.at += 1
        self.need("(")
        subject = self.expr()
        self.need(")")
        self.need("{")
        arms = []
        while not self.has("}", ""):
            a = self.start()
            tests: list[Node] | None = []
            if self.take("T_DEFAULT"):
                tests = None
                self.take(",")
            else:
                while not self.has("T_DOUBLE_ARROW", ""):
                    tests.append(self.expr())
                    if not self.take(","):
                        break
            self.need("T_DOUBLE_ARROW")
            value = self.expr()
            arms.append(Node("arm", a, self.end(), tests=tests, value=value))
            if not self.take(","):
                break
        self.need("}")
        return Node("match", s, self.end(), subject=subject, arms=arms)

    def closure(self) -> Node:
        s, static = self.start(), self.take("T_STATIC")
        if self.take("T_FN"):
            by_ref = self.amp()
            params = self.params()
            ret = self.hint() if self.take(":") else None
            self.need("T_DOUBLE_ARROW")
            body = self.expr(_PRINT)
            return Node("arrow", s, self.end(), static=static, by_ref=by_ref, params=params, returns=ret, body=body, attrs=[])
        self.need("T_FUNCTION")
        by_ref = self.amp()
        params, uses = self.params(), []
        if self.take("T_USE"):
            self.need("(")
            while not self.has(")", ""):
                us, ref = self.start(), self.amp()
                uses.append(Node("closureuse", us, self.spans[self.at][1], name=self.need("T_VARIABLE")[1:], by_ref=ref))
                if not self.take(","):
                    break
            self.need(")")
        ret = self.hint() if self.take(":") else None
        body = self.block()
        return Node("closure", s, self.end(), static=static, by_ref=by_ref, params=params, uses=uses, returns=ret, body=body, attrs=[])

    def array(self) -> Node:
        s, kind = self.start(), "array"
        end = "]"
        if not self.take("["):
            kind = "list" if self.next().lower() == "list" else "array"
            end = ")"
            if not self.take("("):
                return Node("name", s, self.end(), text=self.raw(self.at - 1))
        items: list[Node] = []
        while not self.has(end, ""):
            i = self.start()
            if self.take(","):
                items.append(Node("hole", i, i))
                continue
            spread, by_ref, key = self.take("T_ELLIPSIS"), self.amp(), None
            v = self.expr()
            if self.take("T_DOUBLE_ARROW"):
                key, by_ref = v, self.amp()
                v = self.expr()
            items.append(Node("item", i, self.end(), key=key, value=v, by_ref=by_ref, spread=spread))
            if not self.take(","):
                break
        self.need(end)
        return Node(kind, s, self.end(), items=items, short=end == "]")

    def interpolated(self) -> Node:
        s, opening = self.start(), self.tok
        close = "T_END_HEREDOC" if opening == "T_START_HEREDOC" else opening
        nowdoc = opening == "T_START_HEREDOC" and "'" in self.raw()
        self.at += 1
        parts: list[Node] = []
        while not self.has(close, ""):
            ps, t = self.start(), self.tok
            if t == "T_ENCAPSED_AND_WHITESPACE":
                raw = self.next()
                parts.append(Node("string", ps, self.end(), value=raw if nowdoc else unescape(raw, '"' if opening == '"' else opening if opening == "`" else "")))
            elif t == "T_VARIABLE":
                v = self.primary()
                if self.take("["):
                    ks, neg = self.start(), self.take("-")
                    kt, raw = self.tok, self.next()
                    if kt == "T_NUM_STRING":
                        k = Node("int", ks, self.end(), value=-literal_int(raw) if neg else literal_int(raw)) if raw == "0" or raw[0] != "0" and raw.isdigit() else Node("string", ks, self.end(), value=raw)
                    else:
                        k = Node("var", ks, self.end(), name=raw[1:]) if kt == "T_VARIABLE" else Node("string", ks, self.end(), value=raw)
                    self.need("]")
                    v = Node("index", ps, self.end(), base=v, index=k)
                elif self.has("T_OBJECT_OPERATOR", "T_NULLSAFE_OBJECT_OPERATOR"):
                    safe = self.next() == "?->"
                    ns = self.start()
                    v = Node("prop", ps, self.spans[self.at][1], obj=v, name=self.next(), name_at=ns, nullsafe=safe)
                parts.append(v)
            elif t == "T_CURLY_OPEN":
                self.at += 1
                parts.append(self.expr())
                self.need("}")
            elif t == "T_DOLLAR_OPEN_CURLY_BRACES":
                self.at += 1
                if self.has("T_STRING_VARNAME"):
                    v = Node("var", self.start(), self.spans[self.at][1], name=self.next())
                    if self.take("["):
                        i = self.expr()
                        self.need("]")
                        v = Node("index", ps, self.end(), base=v, index=i)
                else:
                    v = Node("var", ps, self.end(), name=None, expr=self.expr())
                self.need("}")
                parts.append(v)
            else:
                self.fail(f"unexpected {self.raw()}")
        end_text = self.raw()
        self.need(close)
        if opening == "T_START_HEREDOC":
            indent = len(end_text) - len(end_text.lstrip(" \t"))
            _dedent(parts, indent)
        if opening == "`":
            return Node("shell", s, self.end(), parts_=parts)
        if all(p.kind == "string" and p.end > p.start for p in parts) and opening == "T_START_HEREDOC":
            return Node("string", s, self.end(), value="".join(p.value for p in parts))
        return Node("interp", s, self.end(), parts_=parts)


def _dedent(parts: list[Node], indent: int) -> None:
    """Strip the closing marker's indentation, and the last line break."""
    for k, p in enumerate(parts):
        if p.kind == "string":
            v = p.value
            if indent:
                v = re.sub(rf"(?<=\n)[ \t]{{1,{indent}}}", "", v)
                if k == 0:
                    v = re.sub(rf"\A[ \t]{{1,{indent}}}", "", v)
            p.parts["value"] = v
    if parts and parts[-1].kind == "string":
        parts[-1].parts["value"] = re.sub(r"(\r\n|\n|\r)\Z", "", parts[-1].value)


def parse(text: str) -> tuple[Node, list[tuple[int, str]]]:
    """The tree of ``text`` (bytes as Latin-1), and (offset, message) of each syntax error."""
    import sys

    if sys.getrecursionlimit() < 12_000:
        sys.setrecursionlimit(12_000)
    p = Parser(text)
    tree = p.program()
    while not p.has(""):  # a stray closing brace
        p.errors.append((p.start(), f"Syntax error, unexpected {p.raw()}"))
        p.at += 1
        tree.body.extend(p.statements(("",)))
    return tree, p.errors
