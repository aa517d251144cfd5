"""Scanner, parser, local rules, docs and definedness on text."""

import random

import pytest

from brambleq.php.ast import Node
from brambleq.php.definedness import Definedness
from brambleq.php.docs import best, tags
from brambleq.php.lexer import tokenize
from brambleq.php.model import File, array_key, constant_value
from brambleq.php.parser import parse
from brambleq.php.rules_local import RULES, Options


def names(code):
    return [n for n, _, _ in tokenize(code) if n not in ("T_WHITESPACE", "T_OPEN_TAG")]


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("<?php $a?->b ?? c\\d;", ["T_VARIABLE", "T_NULLSAFE_OBJECT_OPERATOR", "T_STRING", "T_COALESCE", "T_NAME_QUALIFIED", ";"]),
        ('<?php "x $a[0] {$b} ${c}";', ['"', "T_ENCAPSED_AND_WHITESPACE", "T_VARIABLE", "[", "T_NUM_STRING", "]", "T_ENCAPSED_AND_WHITESPACE", "T_CURLY_OPEN", "T_VARIABLE", "}", "T_ENCAPSED_AND_WHITESPACE", "T_DOLLAR_OPEN_CURLY_BRACES", "T_STRING_VARNAME", "}", '"', ";"]),
        ("<?php <<<A\n  x $y\n  A;", ["T_START_HEREDOC", "T_ENCAPSED_AND_WHITESPACE", "T_VARIABLE", "T_ENCAPSED_AND_WHITESPACE", "T_END_HEREDOC", ";"]),
        ("<?php (int) 0x1F 1_0.5 9223372036854775808;", ["T_INT_CAST", "T_LNUMBER", "T_DNUMBER", "T_DNUMBER", ";"]),
        ("<?php enum A {} enum(1); f(&$a, $b & 1);", ["T_ENUM", "T_STRING", "{", "}", "T_STRING", "(", "T_LNUMBER", ")", ";", "T_STRING", "(", "T_AMPERSAND_FOLLOWED_BY_VAR_OR_VARARG", "T_VARIABLE", ",", "T_VARIABLE", "T_AMPERSAND_NOT_FOLLOWED_BY_VAR_OR_VARARG", "T_LNUMBER", ")", ";"]),
        ("a <?= 1 ?>\nb", ["T_INLINE_HTML", "T_OPEN_TAG_WITH_ECHO", "T_LNUMBER", "T_CLOSE_TAG", "T_INLINE_HTML"]),
    ],
)
def test_tokens(code, want):
    assert names(code) == want


def test_totality():
    r = random.Random(0)
    bits = ["<?php ", "$a", '"', "{", "}", "${", "<<<A\n", "A\n", "->", "[", "]", "\\", "`", "'", "/*", "#", "?>", "&", "class ", "function ", "(", ")", ";", "match", "fn", "=>", "\xff", "\x00", "yield from", "::", "use ", "enum X "]
    for _ in range(800):
        text = "".join(r.choice(bits) for _ in range(25))
        toks = tokenize(text)
        assert "".join(text[s:e] for _, s, e in toks) == text
        tree, _ = parse(text)
        assert tree.kind == "file"
    for deep in ("[" * 4000, "(" * 4000 + "1", "{" * 3000, "!" * 3000 + "1", "1" + "+1" * 5000):
        parse("<?php " + deep)


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("1 + 2 * 3", "(bin op=+ left=(int value=1) right=(bin op=* left=(int value=2) right=(int value=3)))"),
        ("-$a ** 2", "(unary op=- inner=(bin op=** left=(var name=a) right=(int value=2)))"),
        ("!$a instanceof B", "(unary op=! inner=(instanceof value=(var name=a) cls=(name text=B)))"),
        ("$a ?? $b ?? $c", "(bin op=?? left=(var name=a) right=(bin op=?? left=(var name=b) right=(var name=c)))"),
        ("$a = $b and $c", "(bin op=and left=(assign target=(var name=a) value=(var name=b)) right=(var name=c))"),
        ("'a' . 1 + 2", "(bin op=. left=(string value=a) right=(bin op=+ left=(int value=1) right=(int value=2)))"),
        ("!$x = 3", "(unary op=! inner=(assign target=(var name=x) value=(int value=3)))"),
    ],
)
def test_precedence(code, want):
    tree, errors = parse(f"<?php {code};")
    assert not errors and str(tree.body[0].expr) == want


def test_modern_syntax_has_no_errors():
    code = r"""<?php declare(strict_types=1);
namespace A\B { use C\{D, E as F, function g}; use const H\I;
#[Attr(1)] final readonly class K extends D implements F, \L { use T1, T2 { T1::m insteadof T2; T2::m as protected n; }
  const int X = 1, Y = 2; public private(set) string $p = 'x' { get => $this->p; set(string $v) { $this->p = $v; } }
  public function __construct(private readonly ?int $q = null, protected D&F ...$r) {}
  abstract protected static function &z(self|null $a, callable $b = null): static|false; }
enum S: string implements I { case A = 'a'; const B = self::A; public static function f(): self { return self::A; } }
function h(int|string $x, &$y, ...$z): iterable { foreach ($x as [$k, 'v' => $v]) { yield $k => $v; } yield from []; }
$f = static fn(int $a): int => $a <=> 2; $g = strlen(...); $m = match(true) { 1, 2 => 'a', default => throw new \E };
for ($i = 0, $j = 1; $i < 3; $i++): if ($i): continue; elseif ($j): break; else: endif; endfor;
try { } catch (A | B) { } finally { } switch ($x) { case 1: default; }
$o = new class(1) extends D { }; [$a, , $b] = [1, 2, ...$c]; list('k' => $q) = $z; $x?->y::Z; $n = new ($cls); static $s = 1; goto e; e:
echo <<<"T"
  {$a['b']->c[1]} ${d} $e[f] $g->h
  T . `ls $x`; isset($a, $b); print 1; }"""
    tree, errors = parse(code)
    assert errors == []
    assert isinstance(tree, Node)


@pytest.mark.parametrize(("code", "value"), [("1 + 2", 3), ("7 / 2", 3.5), ("6 / 2", 3), ("'a' . 'b'", "ab"), ("-7 % 3", -1), ("9223372036854775807 + 1", None), ("1 / 0", None), ("!0", True), ("1 === 1.0", False), ("'a' == 'b'", False), ("true && '0'", False), ("$x + 1", None)])
def test_folding(code, value):
    got = constant_value(parse(f"<?php {code};")[0].body[0].expr)
    assert (got[0] if got else None) == value


def test_array_keys():
    assert [array_key(v) for v in ("5", "05", "-0", 1.9, True, None, "x", "9223372036854775808")] == [5, "05", "-0", 1, 1, "", "x", "9223372036854775808"]


CASES = [
    ("[1 => 'a', '1' => 'b', true => 'c'];", ["array.duplicateKey"]),
    ("$x = $a[];", ["offsetAccess.noDim"]),
    ("$a[] = 1; foreach ($x as $a[]) {}", []),
    ("break; while (1) { break 2; }", ["break.outOfLoop", "break.outOfLoop"]),
    ("goto a; b: echo 1;", ["goto.labelUndefined", "label.unused"]),
    ("function f($a, $a, ...$b, $c) {}", ["parameter.duplicate", "parameter.variadicNotLast"]),
    ("function f() { $g = function () use ($this, $a) {}; }", ["closure.useThis", "variable.undefined"]),
    ("class A { private final function f() {} abstract function g(); }", ["method.finalPrivate", "method.abstract"]),
    ("interface I { private function f(); public $x; }", ["method.visibility", "property.nonHookedInInterface"]),
    ("enum E: float { case A; case B = 1.0; function cases() {} function __construct() {} }", ["enum.backingType", "enum.missingCase", "enum.methodRedeclaration", "enum.constructor"]),
    ("class A { const X = 1; const X = 2; function f() {} function F() {} }", ["classConstant.duplicate", "method.duplicate"]),
    ("class A { readonly $x = 1; } class a {}", ["property.readOnlyNoNativeType", "property.readOnlyDefaultValue", "class.duplicate", "class.duplicate"]),
    ("function f(): int { if ($GLOBALS) { return 1; } }", ["return.missing"]),
    ("function f(): int { while (true) { } } function g(): void { return 1; } function h(): int { return; }", ["return.void", "return.empty"]),
    ("sprintf('%s %d', 1); sprintf('%1$s %1$s', 1); sprintf('%%');", ["argument.sprintf"]),
    ("preg_match('abc', $GLOBALS); preg_match('/a', ''); preg_match('{a}i', '');", ["regexp.pattern", "regexp.pattern"]),
    ("function f(mixed|int $a, ?void $b) {}", ["unionType.mixed", "nullableType.void"]),
    ("f() = 1; f()++; $a?->b = 2;", ["assign.invalidExpr", "postInc.expr", "nullsafe.assign"]),
    ("function f($a) { if ($a) { $x = 1; } return $x; }", []),
    ("function f($a) { if ($a) { echo 1; } return $x; }", ["variable.undefined"]),
    ("function f($a) { if ($a) { $x = 1; } else { throw $a; } return $x; }", []),
    ("function f($a) { foreach ($a as &$v) {} foreach ($a as $v) {} }", ["assign.byRefForeachExpr"]),
    ("new static; echo self::X; namespace\\f();", ["outOfClass.static", "outOfClass.self"]),
    ("echo __CLASS__, __FUNCTION__, __LINE__;", ["magicConstant.outOfClass", "magicConstant.outOfFunction"]),
    ("global $this; $this = 1;", ["global.this", "assign.this"]),
    ("(unset) $GLOBALS; $x = (void) 1;", ["cast.unset", "cast.void"]),
]


@pytest.mark.parametrize(("code", "want"), CASES)
def test_rules(code, want):
    f = File("t.php", f"<?php {code}".encode())
    assert not f.errors
    got = [code for r in RULES if r.level <= 0 for _, code, _ in r.run(f, Options(level=0))]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize(
    ("level", "code", "want"),
    [
        (1, "function f() { return function () use ($a) { return 1; }; }", "closure.unusedUse"),
        (1, "function f($a) { if ($a) { $x = 1; } return $x; }", "variable.undefined"),
        (1, "class A { function __construct($x) { echo 1; } }", "constructor.unusedParameter"),
        (4, "function f() { return 1; echo 2; }", "deadCode.unreachable"),
        (4, "class A { private $p; private const K = 1; private function m() {} }", "property.unused classConstant.unused method.unused"),
        (4, "if (0) { f(); } $a + 1; $a && $b;", "if.alwaysFalse expr.resultUnused booleanAnd.resultUnused"),
        (6, "function f($a) {} class A { public $p; function m() {} }", "missingType.return missingType.parameter missingType.property missingType.return"),
    ],
)
def test_levels(level, code, want):
    f = File("t.php", f"<?php {code}".encode())
    got = [c for r in RULES if r.level == level for _, c, _ in r.run(f, Options(level=level))]
    assert sorted(got) == sorted(want.split())


def test_versions():
    f = File("t.php", b"<?php class A { final const int X = 1; } f(...); (integer) 1; `ls`; $a = fn() => throw $b;")
    codes = lambda php: {c for r in RULES for _, c, _ in r.run(f, Options(php=php))}
    assert {"classConstant.finalNotSupported", "classConstant.nativeTypeNotSupported", "callable.notSupported", "throw.notSupported"} <= codes(70400)
    assert {"cast.deprecated", "backtick.deprecated"} <= codes(80500) and not {"cast.deprecated", "throw.notSupported"} & codes(80400)


def test_docs():
    t = tags("/**\n * @param array<int, string> $a text\n * @phpstan-param list<string> $a\n * @return int|null  the value\n * @var Foo\n */")
    assert [(x[0], x[1]) for x in t] == [("param", 0), ("param", 2), ("return", 0), ("var", 0)]
    assert best(t, "param", "a") == "list<string>" and best(t, "return") == "int|null"


def test_names():
    f = File("t.php", b"<?php namespace A; use B\\C; use function D\\e; new C; new C\\X; new Y; new \\Z; new namespace\\W; e(); g(); h\\i(); K; new self;")
    got = [(k, name, fb) for _, k, how, name, fb, _ in f.references() if how != "late"]
    assert got == [("class", "B\\C", None), ("class", "B\\C\\X", None), ("class", "A\\Y", None), ("class", "Z", None), ("class", "A\\W", None), ("function", "D\\e", None), ("function", "A\\g", "g"), ("function", "A\\h\\i", None), ("constant", "A\\K", "K")]


def test_definedness_of_loops_and_tries():
    def run(body):
        f = File("t.php", f"<?php function f($a) {{ {body} }}".encode())
        return [(n, how) for s in f.scopes for _, n, how in Definedness(s).run()]

    assert run("foreach ($a as $k => $v) {} return $v;") == [("v", 1)]
    assert run("do { $x = 1; } while ($x); return $x;") == []
    assert run("try { $x = 1; } catch (E $e) { return; } return $x;") == []
    assert run("try { $x = f(); } catch (E $e) {} return $x;") == [("x", 1)]
    assert run("switch ($a) { case 1: $x = 1; break; default: $x = 2; } return $x;") == []
    assert run("while (true) { $x = 1; if ($a) { break; } } return $x;") == []
    assert run("isset($x); $x ?? 1; empty($x); return compact('x');") == []
    assert run("extract($a); return $x;") == []
