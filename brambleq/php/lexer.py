"""Scanner for PHP text.  Total: any input yields tokens that cover it.

Text is bytes read as Latin-1, so that positions are byte offsets.  A token is
(name, start, end); names are those of the language's own tokenizer, and a single
character names itself.
"""

from __future__ import annotations

import re

Token = tuple[str, int, int]

#: Reserved words and their token names.
KEYWORDS = {
    w: f"T_{n}"
    for w, n in (
        [(w, w.upper()) for w in "abstract array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile eval exit extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new print private protected public readonly require require_once return static switch throw trait try unset use var while yield".split()]
        + [("and", "LOGICAL_AND"), ("or", "LOGICAL_OR"), ("xor", "LOGICAL_XOR"), ("die", "EXIT"), ("__halt_compiler", "HALT_COMPILER")]
        + [("__class__", "CLASS_C"), ("__dir__", "DIR"), ("__file__", "FILE"), ("__function__", "FUNC_C"), ("__line__", "LINE"), ("__method__", "METHOD_C"), ("__namespace__", "NS_C"), ("__trait__", "TRAIT_C"), ("__property__", "PROPERTY_C")]
    )
}
#: Operators of more than one character, longest first.
OPERATORS = {
    "<=>": "T_SPACESHIP", "===": "T_IS_IDENTICAL", "!==": "T_IS_NOT_IDENTICAL", "**=": "T_POW_EQUAL", "<<=": "T_SL_EQUAL", ">>=": "T_SR_EQUAL", "...": "T_ELLIPSIS", "??=": "T_COALESCE_EQUAL", "?->": "T_NULLSAFE_OBJECT_OPERATOR",
    "->": "T_OBJECT_OPERATOR", "=>": "T_DOUBLE_ARROW", "::": "T_DOUBLE_COLON", "++": "T_INC", "--": "T_DEC", "==": "T_IS_EQUAL", "!=": "T_IS_NOT_EQUAL", "<>": "T_IS_NOT_EQUAL", "<=": "T_IS_SMALLER_OR_EQUAL", ">=": "T_IS_GREATER_OR_EQUAL", "&&": "T_BOOLEAN_AND", "||": "T_BOOLEAN_OR", "??": "T_COALESCE",
    "+=": "T_PLUS_EQUAL", "-=": "T_MINUS_EQUAL", "*=": "T_MUL_EQUAL", "/=": "T_DIV_EQUAL", ".=": "T_CONCAT_EQUAL", "%=": "T_MOD_EQUAL", "&=": "T_AND_EQUAL", "|=": "T_OR_EQUAL", "^=": "T_XOR_EQUAL", "**": "T_POW", "<<": "T_SL", ">>": "T_SR", "|>": "T_PIPE", "#[": "T_ATTRIBUTE",
}
#: Words of a cast and the cast's name.
CASTS = {"int": "INT", "integer": "INT", "bool": "BOOL", "boolean": "BOOL", "float": "DOUBLE", "double": "DOUBLE", "real": "DOUBLE", "string": "STRING", "binary": "STRING", "array": "ARRAY", "object": "OBJECT", "unset": "UNSET", "void": "VOID"}

_ID = r"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*"
_SPACE = re.compile(r"[ \t\r\n]+")
_OPEN = re.compile(r"<\?(?:php(?=[ \t\r\n]|\Z)(?:[ \t]|\r\n|\r|\n)?|=)", re.IGNORECASE)
_NAME = re.compile(rf"\\{_ID}(?:\\{_ID})*|{_ID}(?:\\{_ID})*")
_VARIABLE = re.compile(rf"\${_ID}")
_LABEL = re.compile(_ID)
_CAST = re.compile(r"\([ \t]*([A-Za-z]+)[ \t]*\)")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO][0-7]+(?:_[0-7]+)*|(?P<f>(?:\d+(?:_\d+)*)?\.\d+(?:_\d+)*(?:[eE][+-]?\d+(?:_\d+)*)?|\d+(?:_\d+)*\.(?:[eE][+-]?\d+(?:_\d+)*)?|\d+(?:_\d+)*[eE][+-]?\d+(?:_\d+)*)|\d+(?:_\d+)*")
_LINE = re.compile(r"(?:(?!\?>)[^\r\n])*")
_HEREDOC = re.compile(rf"[bB]?<<<[ \t]*(?:({_ID})|'({_ID})'|\"({_ID})\")(\r\n|\n|\r)")
_SINGLE = re.compile(r"[bB]?'(?:[^'\\]|\\.)*'", re.DOTALL)
_PLAIN = re.compile(rf"[bB]?\"(?:[^\"\\${{]|\\.|\$(?![A-Za-z_\x80-\xff{{])|{{(?!\$))*\"", re.DOTALL)
_OFFSET = re.compile(r"0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO][0-7]+(?:_[0-7]+)*|\d+(?:_\d+)*")
_YIELD_FROM = re.compile(r"yield[ \t\r\n]+from(?![A-Za-z0-9_\x80-\xff\\])", re.IGNORECASE)
_SET = re.compile(r"(public|protected|private)\(set\)", re.IGNORECASE)
_AFTER_AMP = re.compile(r"(?:[ \t\r\n]+|/\*.*?\*/|(?:#(?!\[)|//)[^\r\n]*)*(?:\$[A-Za-z_\x80-\xff]|\.\.\.)", re.DOTALL)
_ENUM = re.compile(rf"enum[ \t\r\n]+(?!(?:extends|implements)(?![A-Za-z0-9_\x80-\xff])){_ID}", re.IGNORECASE)
_OP3 = re.compile("|".join(re.escape(o) for o in sorted(OPERATORS, key=len, reverse=True)))
_TRIVIA = {"T_WHITESPACE", "T_COMMENT", "T_DOC_COMMENT", "T_OPEN_TAG"}


class Lexer:
    def __init__(self, text: str) -> None:
        self.text = text
        self.out: list[Token] = []
        self.states: list[str] = ["html"]

    def run(self) -> list[Token]:
        at, n = 0, len(self.text)
        while at < n:
            state = self.states[-1]
            if state == "html":
                at = self._html(at)
            elif state == "code":
                at = self._code(at)
            else:
                at = self._inside(at, state)
        return self.out

    def _add(self, name: str, start: int, end: int) -> int:
        if end > start:
            self.out.append((name, start, end))
        return end

    def _html(self, at: int) -> int:
        m = _OPEN.search(self.text, at)
        if not m:
            return self._add("T_INLINE_HTML", at, len(self.text))
        self._add("T_INLINE_HTML", at, m.start())
        self.states[-1] = "code"
        return self._add("T_OPEN_TAG_WITH_ECHO" if m.group() == "<?=" else "T_OPEN_TAG", m.start(), m.end())

    def _last(self) -> str:
        for name, _, _ in reversed(self.out):
            if name not in _TRIVIA:
                return name
        return ""

    def _code(self, at: int) -> int:
        t = self.text
        c = t[at]
        if c in " \t\r\n":
            return self._add("T_WHITESPACE", at, _SPACE.match(t, at).end())
        if c == "$":
            m = _VARIABLE.match(t, at)
            return self._add("T_VARIABLE", at, m.end()) if m else self._add("$", at, at + 1)
        if c == "?" and t.startswith("?>", at):
            self.states[-1] = "html"
            end = at + 2
            end += 2 if t.startswith("\r\n", end) else 1 if end < len(t) and t[end] in "\r\n" else 0
            return self._add("T_CLOSE_TAG", at, end)
        if c in "#/" and (t.startswith("//", at) or c == "#" and not t.startswith("#[", at)):
            return self._add("T_COMMENT", at, max(at + 1, _LINE.match(t, at).end()))
        if c == "/" and t.startswith("/*", at):
            end = t.find("*/", at + 2)
            end = len(t) if end < 0 else end + 2
            doc = t.startswith("/**", at) and at + 3 < len(t) and t[at + 3] in " \t\r\n"
            return self._add("T_DOC_COMMENT" if doc else "T_COMMENT", at, end)
        if c in "bB<\"'`" and (end := self._string(at)) is not None:
            return end
        if c.isdigit() or c == "." and at + 1 < len(t) and t[at + 1].isdigit():
            m = _NUMBER.match(t, at)
            return self._add("T_DNUMBER" if m["f"] or _overflows(m.group()) else "T_LNUMBER", at, m.end())
        if c.isalpha() or c == "_" or c == "\\" or c >= "\x80":
            return self._word(at)
        if c == "(" and (m := _CAST.match(t, at)) and m[1].lower() in CASTS:
            return self._add(f"T_{CASTS[m[1].lower()]}_CAST", at, m.end())
        if c == "{":
            self.states.append("code")
            return self._add("{", at, at + 1)
        if c == "}":
            if len(self.states) > 1:
                self.states.pop()
            return self._add("}", at, at + 1)
        if c == "&" and not (t.startswith("&&", at) or t.startswith("&=", at)):
            name = "T_AMPERSAND_FOLLOWED_BY_VAR_OR_VARARG" if _AFTER_AMP.match(t, at + 1) else "T_AMPERSAND_NOT_FOLLOWED_BY_VAR_OR_VARARG"
            return self._add(name, at, at + 1)
        if m := _OP3.match(t, at):
            return self._add(OPERATORS[m.group()], at, m.end())
        return self._add(c, at, at + 1)

    def _word(self, at: int) -> int:
        t = self.text
        if t[at] == "\\" and not _NAME.match(t, at):
            return self._add("T_NS_SEPARATOR", at, at + 1)
        after = self._last()
        m = _NAME.match(t, at)
        word = m.group()
        if after in ("T_OBJECT_OPERATOR", "T_NULLSAFE_OBJECT_OPERATOR"):
            return self._add("T_STRING", at, _LABEL.match(t, at).end()) if word[0] != "\\" else self._add("T_NAME_FULLY_QUALIFIED", at, m.end())
        if "\\" in word:
            if word[0] == "\\":
                return self._add("T_NAME_FULLY_QUALIFIED", at, m.end())
            return self._add("T_NAME_RELATIVE" if word[:10].lower() == "namespace\\" else "T_NAME_QUALIFIED", at, m.end())
        low = word.lower()
        if low == "yield" and (y := _YIELD_FROM.match(t, at)):
            return self._add("T_YIELD_FROM", at, y.end())
        if low in ("public", "protected", "private") and (s := _SET.match(t, at)):
            return self._add(f"T_{low.upper()}_SET", at, s.end())
        if low == "enum":
            return self._add("T_ENUM" if _ENUM.match(t, at) else "T_STRING", at, m.end())
        name = KEYWORDS.get(low, "T_STRING")
        self._add(name, at, m.end())
        if name == "T_HALT_COMPILER":
            return self._halt(m.end())
        return m.end()

    def _halt(self, at: int) -> int:
        """After the three tokens that follow, all is data."""
        left = 3
        while left and at < len(self.text):
            before = len(self.out)
            at = self._code(at)
            if self.states[-1] == "html":
                break
            left -= any(x[0] not in _TRIVIA for x in self.out[before:])
        return self._add("T_INLINE_HTML", at, len(self.text))

    def _string(self, at: int) -> int | None:
        t = self.text
        if m := _SINGLE.match(t, at):
            return self._add("T_CONSTANT_ENCAPSED_STRING", at, m.end())
        k = at + (t[at] in "bB")
        if t.startswith("'", k):
            return self._add("T_ENCAPSED_AND_WHITESPACE", at, len(t))
        if t.startswith('"', k):
            if m := _PLAIN.match(t, at):
                return self._add("T_CONSTANT_ENCAPSED_STRING", at, m.end())
            self.states.append('"')
            return self._add('"', at, k + 1)
        if t[at] == "`":
            self.states.append("`")
            return self._add("`", at, at + 1)
        if m := _HEREDOC.match(t, at):
            label = m[1] or m[2] or m[3]
            close = re.compile(rf"(?:\A|(?<=[\r\n]))[ \t]*{re.escape(label)}(?![A-Za-z0-9_\x80-\xff])").search(t, m.end())
            self._add("T_START_HEREDOC", at, m.end())
            end = close.start() if close else len(t)
            if m[2]:
                self._add("T_ENCAPSED_AND_WHITESPACE", m.end(), end)
                return self._add("T_END_HEREDOC", end, close.end()) if close else end
            self.states.append(f"<{end},{close.end() if close else end}")
            return m.end()
        return None

    def _inside(self, at: int, state: str) -> int:
        """Within a string that interpolates, or one of its parts."""
        t = self.text
        if state == "offset":
            return self._offset(at)
        if state == "property":
            self.states.pop()
            op = "?->" if t.startswith("?->", at) else "->"
            at = self._add(OPERATORS[op], at, at + len(op))
            return self._add("T_STRING", at, _LABEL.match(t, at).end())
        if state == "varname":
            self.states[-1] = "code"
            m = _LABEL.match(t, at)
            return self._add("T_STRING_VARNAME", at, m.end()) if m and m.end() < len(t) and t[m.end()] in "[}" else at
        stop, close = (int(x) for x in state[1:].split(",")) if state[0] == "<" else (len(t), 0)
        if state[0] == "<" and at >= stop:
            self.states.pop()
            return self._add("T_END_HEREDOC", at, close) if close > stop else max(at, stop)
        k = at
        while k < stop:
            c = t[k]
            if c == "\\" and k + 1 < stop:
                k += 2
            elif c == state:
                break
            elif c == "$" and k + 1 < stop and (t[k + 1] == "{" or _LABEL.match(t, k + 1)) or c == "{" and t.startswith("$", k + 1) and k + 1 < stop:
                break
            else:
                k += 1
        k = min(k, stop)
        if k > at:
            return self._add("T_ENCAPSED_AND_WHITESPACE", at, k)
        if t[k] == state:
            self.states.pop()
            return self._add(state, k, k + 1)
        if t[k] == "{":
            self.states.append("code")
            return self._add("T_CURLY_OPEN", k, k + 1)
        if t[k + 1] == "{":
            self.states.append("varname")
            return self._add("T_DOLLAR_OPEN_CURLY_BRACES", k, k + 2)
        end = self._add("T_VARIABLE", k, _VARIABLE.match(t, k).end())
        if t.startswith("[", end):
            self.states.append("offset")
            return self._add("[", end, end + 1)
        for op in ("->", "?->"):
            if t.startswith(op, end) and _LABEL.match(t, end + len(op)):
                self.states.append("property")
        return end

    def _offset(self, at: int) -> int:
        t = self.text
        c = t[at]
        if c == "]":
            self.states.pop()
            return self._add("]", at, at + 1)
        if m := _OFFSET.match(t, at):
            return self._add("T_NUM_STRING", at, m.end())
        if m := _VARIABLE.match(t, at):
            return self._add("T_VARIABLE", at, m.end())
        if m := _LABEL.match(t, at):
            return self._add("T_STRING", at, m.end())
        if c in " \t\r\n\\'#":
            self.states.pop()
            return self._add("T_ENCAPSED_AND_WHITESPACE", at, at + 1)
        return self._add(c, at, at + 1)


def _overflows(digits: str) -> bool:
    return literal_int(digits) > 2**63 - 1


def literal_int(digits: str) -> int:
    """The value of an integer literal, of any size."""
    d = digits.replace("_", "").lower()
    if d[:2] in ("0x", "0b", "0o"):
        return int(d, {"x": 16, "b": 2, "o": 8}[d[1]])
    if len(d) > 1 and d[0] == "0":
        octal = re.match(r"[0-7]*", d).group()
        return int(octal or "0", 8)
    return int(d)


def tokenize(text: str) -> list[Token]:
    return Lexer(text).run()


def render(text: str) -> list[str]:
    """Tokens as lines: name, span, escaped text."""
    esc = lambda s: s.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return [f"{n}\t{s}..{e}\t{esc(text[s:e])}" for n, s, e in tokenize(text)]
