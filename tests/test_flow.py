"""Types along control flow, and the rules on them, on small sources."""

import pytest

from brambleq.functions.types import render
from brambleq.php.knowledge import Known, describe
from brambleq.php.model import File
from brambleq.php.rules_declared import TYPED_RULES as FLOW_RULES
from brambleq.php.rules_flow import Typed
from brambleq.php.rules_local import Options


def typed(source, level=9):
    f = File("a.php", ("<?php " + source).encode())
    assert not f.errors, f.errors
    return Typed(f, Known(list(describe(f))), Options(level=level))


def last(source, params="int $a, ?string $s, int|string $u, array $xs, $m, bool $b, float $f"):
    """The type of ``$r`` where it is assigned last."""
    x = typed(f"function f({params}) {{ {source} }}")
    return [render(x.of(n)) for n, _ in x.f.nodes("var") if n.name == "r"][-1]


def codes(source, level=9):
    x = typed(source, level)
    return sorted({code for r in FLOW_RULES if r.level <= level for _, code, _ in r.run(x)})


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("$r = 2 ** 3;", "int|float"), ("$r = $a % 3;", "int"), ("$r = -$a;", "int"), ("$r = 'a' . 1;", "'a1'"), ("$r = \"x{$a}\";", "non-empty-string"), ("$r = [...[1, 2], 3];", "array{0: 1, 1: 2, 2: 3}"), ("$x = []; $x['k'] = 1; $x[] = 'v'; $r = $x;", "array{k: 1, 0: 'v'}"), ("[$p, [$r]] = [1, ['q']];", "'q'"), ("['k' => $r] = ['k' => 5];", "5"),
        ("$r = $b ? 1 : 'x';", "1|'x'"), ("$r = $s ?: 'd';", "non-falsy-string|'d'"), ("$r = match(true) { $a > 3 => 'b', default => 's' };", "'b'|'s'"), ("$x = 1; $f = function () use ($x) { return $x; }; $r = $f();", "mixed"), ("$i = 3; $i++; $r = $i;", "4"), ("$x = null; $x ??= 7; $r = $x;", "7"), ("$r = $xs['q'] ?? null;", "mixed"), ("$r = (bool) 0;", "false"), ("$r = (array) $a;", "array"), ("$r = clone new f();", "f"),
        ("if (isset($m['k'])) { $r = $m['k']; }", "mixed"), ("if (!is_null($s)) { $r = $s; }", "string"), ("if (is_int($u) || $b) { $r = $u; }", "int|string"), ("if (!(is_int($u) && $b)) { $r = $u; }", "string|int"), ("if ($a >= 2 && $a < 5) { $r = $a; }", "int<2, 4>"), ("if (gettype($u) === 'integer') { $r = $u; }", "int"), ("assert(is_string($u)); $r = $u;", "string"), ("if (empty($s)) { return; } $r = $s;", "non-falsy-string"), ("if (str_contains($u, 'x')) { $r = 1; }", "1"), ("while ($a > 10) { $a--; } $r = $a;", "int<min, 10>"), ("do { $x = 1; } while ($b); $r = $x;", "1"), ("foreach ([1, 2] as $k => $v) { } $r = $v;", "1|2"), ("for (;;) { if ($b) { $x = 'y'; break; } } $r = $x;", "'y'"), ("try { throw new E(); } finally { $r = 1; }", "1"), ("try { $q = 1; } catch (A|B $e) { $r = $e; }", "A|B"), ("switch ($a) { case 1: case 2: $r = $a; }", "1|2"),
        ("$o = new stdClass; $o->p = 5; $r = $o->p;", "5"), ("$o = new stdClass; $o->p = 5; g(); $r = $o->p;", "mixed"), ("sort($xs); $r = $xs;", "list"), ("unset($xs); $r = 2;", "2"), ("$g = fn(int $x) => $x + 1; $r = array_map($g, [1]);", "non-empty-list"), ("$r = array_map(function ($x) { return $x . 'q'; }, ['a', 'b']);", "non-empty-list<non-empty-string>"), ("$r = array_filter([1, null], fn($x) => $x !== null);", "array<int, 1|null>"), ("$r = usort($xs, fn($p, $q) => $p <=> $q);", "true"),
    ],
)
def test_types(source, want):
    assert last(source) == want


def test_members_and_templates():
    lib = """
    /**
     * @template T
     */
    class Box {
        /** @var T */
        public $v;
        /** @param T $v */
        function __construct($v) {}
        /** @return T */
        function get() {}
        function self(): static { return $this; }
    }
    /**
     * @template T
     * @param list<T> $xs
     * @return T|null
     */
    function head(array $xs) {}
    /** @return ($x is int ? string : bool) */
    function cond($x) {}
    enum Suit { case A; case B; const C = 5; }
    abstract class P { public ?int $n = null; abstract function m(): string; static function make(): static {} }
    final class K extends P { function m(): string { return ''; } }
    """
    for source, want in [("$r = (new Box(5))->get();", "int"), ("$r = (new Box('x'))->self();", "Box<string>"), ("$r = head([1, 2]);", "int|null"), ("$r = cond(1);", "string"), ("$r = cond('s');", "bool"), ("$r = Suit::A;", "Suit::A"), ("$r = Suit::C;", "5"), ("$r = (new K)->n;", "int|null"), ("$r = K::make()->m();", "string"), ("$r = K::class;", "class-string<K>"), ("$k = new K; if ($k->n !== null) { $r = $k->n; }", "int")]:
        x = typed(f"{lib} function f() {{ {source} }}")
        assert [render(x.of(n)) for n, _ in x.f.nodes("var") if n.name == "r"][-1] == want, source


def test_assert_tags_and_out_types():
    lib = """
    class K { /** @phpstan-assert-if-true string $x */ function isText($x): bool {} }
    /** @phpstan-assert int $x */
    function mustBeInt($x) {}
    /** @phpstan-assert !null $x */
    function there($x) {}
    /** @phpstan-assert-if-false int $x */
    function noInt($x): bool {}
    /** @param-out string $x */
    function fill(&$x) {}
    """
    for source, want in [("mustBeInt($m); $r = $m;", "int"), ("mustBeInt($u); $r = $u;", "int"), ("there($s); $r = $s;", "string"), ("if ($k->isText($u)) { $r = $u; }", "string"), ("if ($k->isText($u)) {} else { $r = $u; }", "int|string"), ("if (!noInt($u)) { $r = $u; }", "int"), ("fill($q); $r = $q;", "string")]:
        x = typed(f"{lib} function f($m, int|string $u, ?string $s, K $k) {{ {source} }}")
        assert [render(x.of(n)) for n, _ in x.f.nodes("var") if n.name == "r"][-1] == want, source


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("function f(int $a) { return $a === 's'; }", ["identical.alwaysFalse"]), ("function f(int $a) { return $a === 5; }", []), ("function f(array $x) { echo $x; }", ["echo.nonString"]), ("function f(?array $x) { echo $x; }", ["echo.nonString"]), ("function f($x) { echo $x; }", []), ("function f(int $x) { foreach ($x as $y) {} }", ["foreach.nonIterable"]), ("function f(iterable $x) { foreach ($x as $y) {} }", []), ("class C {} function f(C $x) { foreach ($x as $y) {} }", ["foreach.nonIterable"]), ("function f(Unknown $x) { foreach ($x as $y) {} }", []),
        ("function f(int $x) {} f('a');", ["argument.type"]), ("function f(int $x) {} f(1);", []), ("function f(float $x) {} f(1);", []), ("function f(int ...$x) {} f(1, 2, 3);", []), ("function f($a, $b = 1) {} f();", ["arguments.count"]), ("function f(): int { return 1; }", []), ("function f(): ?int { return null; }", ["return.unusedType"]), ("function f(): int { return null; }", ["return.type"]), ("function g(): Generator { yield 1; return 'x'; }", []), ("class C { public int $p; function m() { $this->p = []; } }", ["assign.propertyType"]),
        ("function f() { $x = 1; return isset($x); }", ["isset.variable"]), ("function f($x) { return isset($x); }", []), ("function f() { extract(g()); return isset($x); }", []), ("function f(string $s) { $s->m(); }", ["method.nonObject"]), ("class C { function m() {} } function f(C $c) { $c?->m(); }", ["nullsafe.neverNull"]), ("function f(int $x) { throw $x; }", ["throw.notThrowable"]), ("function f(Exception $x) { throw $x; }", []), ("function f() { $a = ['x' => 1]; return $a['y'] ?? 1; }", ["nullCoalesce.offset"]), ("function f() { $a = ['x' => 1]; return $a['y']; }", ["offsetAccess.notFound"]), ("function f(int $x) { while (true) { $x++; } }", ["while.alwaysTrue"]), ("function f(int $x) { while (true) { if ($x) break; } }", []),
    ],
)
def test_rules(source, want):
    assert codes(source) == want


def test_rules_have_names_of_their_own():
    names = [r.name for r in FLOW_RULES]
    assert len(names) == len(set(names)) > 70


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("/** @param int|string $x */ function f(int $x) {}", []), ("/** @return static */ function f(): object {}", []), ("/** @template T\n * @return T */ function f(): int {}", []), ("/** @throws Exception */ function f() {}", []), ("/** @throws Unknown */ function f() {}", []), ("class C {} /** @throws C */ function f() {}", ["throws.notThrowable"]), ("function f(?int $x = null) {}", []), ("class C { const int A = 1; }", []), ("/** @throws void */ function f() { try { throw new E; } catch (E $e) {} }", []),
        ("function f(): iterable { yield 1; }", []), ("function f(): ?int { if (g()) { return 1; } }", []), ("function f(): int|string { return 1; }", ["return.unusedType"]), ("function f(): int|string { return g(); }", []), ("class C { readonly int $p; function __construct() { $this->p = 1; } }", []), ("class C { readonly int $p; function __construct() { $this->init(); } }", []), ("/** @phpstan-assert int $x */ function f($x) {}", []), ("/** @phpstan-assert int $y */ function f($x) {}", ["parameter.notFound"]), ("/** @return ($y is int ? int : string) */ function f($x) {}", ["parameter.notFound"]), ("function f(mixed $x) { return $x->p; }", ["property.nonObject"]), ("function f(mixed $x) { if ($x instanceof E) { return $x->p; } }", []),
    ],
)
def test_declared_rules(source, want):
    assert codes(source) == want
