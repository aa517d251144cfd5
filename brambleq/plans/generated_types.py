"""Generated programs whose expressions have types that follow from the rows they were written
from: flow typing, narrowing, calls across files and the rules on them, against DuckDB.

A file holds the rows of some hundred consecutive keys, so files stay small whatever the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brambleq.php.rules_local import Options
from brambleq.plans.analysis import Run
from brambleq.sources.generated import program

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        SQL[f.__name__] = sql
        return f

    return keep


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _text(template: str, **values) -> Column:
    """A line of source with {names} replaced by columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min((i for i in (rest.find("{" + k + "}") for k in values) if i >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        parts += [F.lit(rest[:at]), _s(values[name])]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def _by_kind(kind: Column, lines: list[Column]) -> Column:
    out = F.when(kind == 0, lines[0])
    for i, x in enumerate(lines[1:], 1):
        out = out.when(kind == i, x)
    return out


def _files(rows: DataFrame, folder: str, key: str, line: Column, each: int, head: str = "<?php") -> DataFrame:
    return program(rows, F.concat(F.lit(f"{folder}/"), F.expr(f"{key} div {each}").cast("string"), F.lit(".php")), [key], line, head=head)


def _lined(folder: str, key: str, each: int, table: str, more: str) -> str:
    """The rows of a table with the path and line of their source."""
    return f"(SELECT '{folder}/' || {key} // {each} || '.php' AS path, (row_number() OVER (PARTITION BY {key} // {each} ORDER BY {key}) + 1)::INT AS line, {more} FROM {table})"


def _r(run: Run) -> DataFrame:
    """The type of every variable ``$r`` where it is assigned."""
    return run.typed.where("rel = 'type' and res = 'var' and name = 'r'").select("path", "line", F.element_at("args", 1).alias("type"))


def _found(run: Run, *identifiers: str) -> DataFrame:
    return run.typed.where((F.col("rel") == "finding") & F.col("key").isin(*identifiers)).select("path", "line", F.col("key").alias("identifier"), F.col("name").alias("message"))


_TYPES = frozenset({"type"})


def _cases(kind: str, values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {kind} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query(f"""SELECT path, line, {_cases("k", ["(c + 1)::VARCHAR", "'''v' || c || ''''", "'int|float'", "'array{0: 1, k: ' || c || '}'", "'bool'", "'-1|0|1'", "'string'", "'string|' || c", "'int<' || c || ', ' || (c + 10) || '>'", "'true'"])} AS type
FROM {_lined("x", "o_orderkey", 300, "orders", "o_orderkey % 10 AS k, o_custkey % 100 + 1 AS c")}""")
def gen_expr_types(t):
    """Literals, operators, arrays, casts, intervals."""
    o = t("orders").withColumn("c", F.col("o_custkey") % 100 + 1)
    body = _by_kind(F.col("o_orderkey") % 10, [_text(x, c="c") for x in ("$r = {c} + 1;", "$r = 'v' . {c};", "$r = $a / 2;", "$r = [1, 'k' => {c}];", "$r = $a > {c};", "$r = $a <=> 2;", "$r = (string) $f;", "$r = $s ?? {c};", "$r = ($a < 0 || $a > 10 ? 0 : $a) + {c};", "$r = !false;")])
    return _r(Run(_files(o, "x", "o_orderkey", F.concat(_text("function f{i}(int $a, float $f, ?string $s) { ", i="o_orderkey"), body, F.lit(" }")), 300), Options(level=-1), _TYPES))


@query(f"""SELECT path, line, {_cases("k", ["'string'", "'int'", "'string'", "'int<' || (c + 1) || ', max>'", "'Foo'", "c::VARCHAR", "'non-falsy-string'", "'non-empty-array<string, int>'", "'''a''|''b'''", "'string'", "'int'", "'array{k: int, l?: string}'", "'true'", "'numeric-string'"])} AS type
FROM {_lined("n", "o_orderkey", 300, "orders", "o_orderkey % 14 AS k, o_custkey % 100 + 1 AS c")}""")
def gen_narrowing(t):
    """What conditions guarantee on either branch."""
    o = t("orders").withColumn("c", F.col("o_custkey") % 100 + 1)
    lines = (
        "?string $s) { if ($s === null) { return; } $r = $s; }", "int|string $u) { if (is_int($u)) { $r = $u; } }", "int|string $u) { if (!is_string($u)) { return; } $r = $u; }", "int $a) { if ($a > {c}) { $r = $a; } }", "$o) { if ($o instanceof Foo) { $r = $o; } }", "int $a) { if ($a === {c}) { $r = $a; } }", "string $s) { if ($s) { $r = $s; } }",
        "array $m) { /** @var array<string, int> $m */ $m; if (count($m) > 0) { $r = $m; } }", "string $s) { if (in_array($s, ['a', 'b'], true)) { $r = $s; } }", "?string $s, bool $b) { if ($b && $s !== null) { $r = $s; } }", "int|string|null $u) { if ($u === null || is_string($u)) { return; } $r = $u; }", "$m) { /** @var array{k?: int, l?: string} $m */ $m; if (array_key_exists('k', $m)) { $r = $m; } }", "bool $b) { if (!$b) { return; } $r = $b; }", "string $s) { if (ctype_digit($s)) { $r = $s; } }",
    )
    line = _by_kind(F.col("o_orderkey") % 14, [_text("function f{i}(" + x, i="o_orderkey", c="c") for x in lines])
    return _r(Run(_files(o, "n", "o_orderkey", line, 300, head="<?php class Foo {}"), Options(level=-1), _TYPES))


@query(f"""SELECT path, line, {_cases("k", ["'int'", "'int<' || c || ', max>'", "'int|string'", "c || '|''c'''", "'list<int>'", "'int<9, max>'", "'1|2'", "'int|string'"])} AS type
FROM {_lined("l", "c_custkey", 100, "customer", "c_custkey % 8 AS k, c_nationkey + 3 AS c")}""")
def gen_loop_types(t):
    """Loops to a fixpoint, branches that merge, try and switch."""
    c = t("customer").withColumn("c", F.col("c_nationkey") + 3)
    lines = (
        "$n = 0; foreach ($xs as $v) { $n++; } $r = $n; }", "for ($i = 0; $i < {c}; $i++) { } $r = $i; }", "$x = 1; while ($a) { $x = '{c}'; } $r = $x; }", "$x = 1; try { $x = {c}; h(); } catch (E $e) { $x = 'c'; } $r = $x; }", "$x = []; foreach ($xs as $v) { $x[] = 1; } $r = $x; }", "$x = 0; do { $x += 2; } while ($x < 9); $r = (int) $x; }", "if ($a) { $x = 1; } else { $x = 2; } $r = $x; }", "switch ($a) { case 1: $x = strval($a); break; default: $x = (int) $b; } $r = $x; }",
    )
    line = _by_kind(F.col("c_custkey") % 8, [_text("function f{i}(array $xs, $a, $b) { " + x, i="c_custkey", c="c") for x in lines])
    return _r(Run(_files(c, "l", "c_custkey", line, 100), Options(level=-1), _TYPES))


_BUILTINS = {
    "strlen($s)": "int<0, max>", "count([1, 2])": "2", "array_map(fn($x) => $x . 'a', $l)": "list<non-empty-string>", "array_merge($l, [5])": "non-empty-list<int>", "array_pop($l)": "int|null", "array_keys($m)": "list<string>", "array_values($m)": "list<int>", "array_filter($l)": "array<int, int>", "array_flip($m)": "array<int, string>", "array_search(1, $m)": "string|false", "explode(',', $s)": "non-empty-list<string>", "strtoupper('ab')": "'AB'", "trim(' x ')": "'x'", "str_repeat('ab', 3)": "'ababab'", "sprintf('a%d', 1)": "non-empty-string", "range(1, 3)": "non-empty-list<int>", "abs($i)": "int<0, max>", "max($i, 1.5)": "int|float", "array_chunk($l, 2)": "list<non-empty-list<int>>", "preg_split('/a/', $s)": "list<string>|false", "array_reverse($l)": "list<int>", "array_key_first($m)": "string|null", "str_replace('a', 'b', $s)": "string", "array_combine(['a'], [1])": "non-empty-array<string, 1>", "array_fill_keys(['a', 'b'], 0)": "array<string, 0>", "number_format($i)": "non-empty-string", "array_column([['k' => 1], ['k' => 2]], 'k')": "list<1|2>", "strpos($s, 'x')": "int<0, max>|false", "ucfirst('ab')": "'Ab'", "count_chars($s, 1)": "array<int, int>", "md5($s)": "non-falsy-string", "is_int($i)": "bool",
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""SELECT path, line, {_cases("k", [_quoted(v) for v in _BUILTINS.values()])} AS type
FROM {_lined("b", "p_partkey", 100, "part", f"p_partkey % {len(_BUILTINS)} AS k")}""")
def gen_builtin_returns(t):
    """What functions of the language return, by their arguments."""
    p = t("part")
    line = _by_kind(F.col("p_partkey") % len(_BUILTINS), [_text("function f{i}(string $s, int $i, array $l, array $m) { /** @var list<int> $l */ $l; /** @var array<string, int> $m */ $m; $r = " + x + "; }", i="p_partkey") for x in _BUILTINS])
    return _r(Run(_files(p, "b", "p_partkey", line, 100), Options(level=-1), _TYPES))


@query(f"""SELECT path, line, {_cases("k", ["'int'", "'N' || c", "'string'", "'int|null'", "'list<int>'", "'N' || c || '::A'"])} AS type
FROM {_lined("m", "s_suppkey", 50, "supplier", "s_suppkey % 6 AS k, s_nationkey AS c")}""")
def gen_member_types(t):
    """Calls, properties, constants and templates across files."""
    n = t("nation")
    lib = _files(n, "lib", "n_nationkey", _text("class P{i} {{o} public int $p = 0; public function me(): static { return $this; } public ?Q{i} $q = null; } class Q{i} { public int $v = 1; } class N{i} extends P{i} {{o} const K = 'x'; public function k(): string { return self::K; } /** @return list<int> */ public function l() { return []; } } enum E{i} { case A; case B; }", i="n_nationkey", o=F.lit("")), 10)
    s = t("supplier").withColumn("c", F.col("s_nationkey"))
    lines = ("$r = $n->p; }", "$r = $n->me(); }", "$r = $n->me()->k(); }", "$r = $n->q?->v; }", "$r = $n->l(); }", "$r = N{c}::A; }")
    own = _by_kind(F.col("s_suppkey") % 6, [_text("function f{i}(N{c} $n) { " + x, i="s_suppkey", c="c") for x in lines])
    own = F.when(F.col("s_suppkey") % 6 == 5, _text("enum N{c}x{i} { case A; } function f{i}() { $r = N{c}x{i}::A; }", i="s_suppkey", c="c")).otherwise(own)
    run = Run(lib.unionByName(_files(s, "m", "s_suppkey", own, 50)), Options(level=-1), _TYPES)
    return _r(run).withColumn("type", F.regexp_replace("type", r"x\d+::", "::"))


@query(f"""SELECT path, line, 'arguments.count' AS identifier, 'Function f' || p || ' invoked with ' || g || CASE WHEN g = 1 THEN ' parameter, ' ELSE ' parameters, ' END || '1-2 required.' AS message
FROM {_lined("u", "p_partkey", 100, "part", "p_partkey AS p, p_size % 4 AS g")} WHERE g NOT IN (1, 2)""")
def gen_function_arguments(t):
    """Arity of functions that other files declare."""
    p = t("part")
    lib = _files(p, "lib", "p_partkey", _text("function f{i}($a, $b = 1) {}", i="p_partkey"), 200)
    args = F.array_join(F.slice(F.array(F.lit("1"), F.lit("2"), F.lit("3")), F.lit(1), (F.col("p_size") % 4).cast("int")), ", ")
    uses = _files(p, "u", "p_partkey", F.concat(_text("f{i}(", i="p_partkey"), args, F.lit(");")), 100)
    return _found(Run(lib.unionByName(uses), Options(level=0)), "arguments.count")


@query(f"""SELECT path, line, 'argument.type' AS identifier, 'Parameter #1 $x of ' || CASE WHEN k % 2 = 0 THEN 'function f' || p ELSE 'method C' || p || '::m()' END || ' expects int, ' || CASE WHEN k < 2 THEN '''s''' ELSE 'string' END || ' given.' AS message
FROM {_lined("u", "p_partkey", 100, "part", "p_partkey AS p, p_partkey % 6 AS k")} WHERE k < 4""")
def gen_argument_types(t):
    """Arguments against parameters that other files declare."""
    p = t("part")
    lib = _files(p, "lib", "p_partkey", _text("function f{i}(int $x) {} class C{i} { public function m(int $x) {} }", i="p_partkey"), 100)
    lines = ("f{i}('s');", "(new C{i})->m('s');", "function g{i}(string $v) { f{i}($v); }", "function g{i}(string $v, C{i} $c) { $c->m($v); }", "f{i}(5);", "function g{i}(int $v, C{i} $c) { $c->m($v); }")
    uses = _files(p, "u", "p_partkey", _by_kind(F.col("p_partkey") % 6, [_text(x, i="p_partkey") for x in lines]), 100)
    return _found(Run(lib.unionByName(uses), Options(level=5)), "argument.type")


@query(f"""SELECT path, line, 'return.type' AS identifier, {_cases("k", ["'function f' || c || '() should return int but returns ''s'''", "'K' || c || '::m() should return string but returns ' || n", "'Anonymous function should return bool but returns ' || n || '.'"])} AS message
FROM {_lined("r", "c_custkey", 100, "customer", "c_custkey AS c, c_custkey % 5 AS k, c_nationkey AS n")} WHERE k < 3""")
def gen_return_types(t):
    c = t("customer")
    lines = ("function f{i}(): int { return 's'; }", "class K{i} { function m(): string { return {n}; } }", "function f{i}() { return function (): bool { return {n}; }; }", "function f{i}(int $a): int|float { return $a / 2; }", "class K{i} { function m(): static { return $this; } }")
    return _found(Run(_files(c, "r", "c_custkey", _by_kind(F.col("c_custkey") % 5, [_text(x, i="c_custkey", n="c_nationkey") for x in lines]), 100), Options(level=3)), "return.type")


@query(f"""SELECT path, line, CASE WHEN k = 0 THEN 'assign.propertyType' ELSE 'property.defaultValue' END AS identifier, 'Property K' || c || '::$p (int) does not accept ' || CASE WHEN k = 0 THEN '''s''.' ELSE 'default value of type ''d''.' END AS message
FROM {_lined("p", "c_custkey", 100, "customer", "c_custkey AS c, c_custkey % 3 AS k")} WHERE k < 2""")
def gen_property_types(t):
    lines = ("class K{i} { public int $p = 1; function m() { $this->p = 's'; } }", "class K{i} { public int $p = 'd'; }", "class K{i} { public int $p = 1; function m() { $this->p = 2; } }")
    return _found(Run(_files(t("customer"), "p", "c_custkey", _by_kind(F.col("c_custkey") % 3, [_text(x, i="c_custkey") for x in lines]), 100), Options(level=3)), "assign.propertyType", "property.defaultValue")


_ISSET = ["('isset.variable', 'Variable $x in isset() always exists and is not nullable.')", "('empty.variable', 'Variable $x in empty() always exists and is always falsy.')", "('nullCoalesce.variable', 'Variable $x on left side of ?? is never defined.')", "('isset.offset', 'Offset ''z'' on array{a: ' || c || '} in isset() does not exist.')", "('nullCoalesce.offset', 'Offset ''a'' on array{a: ' || c || '} on left side of ?? always exists and is not nullable.')"]


@query(f"""SELECT path, line, v[1] AS identifier, v[2] AS message FROM (SELECT path, line, {_cases("k", [x.replace("(", "[", 1)[:-1] + "]" for x in _ISSET])} AS v
FROM {_lined("i", "c_custkey", 100, "customer", "c_custkey % 7 AS k, c_nationkey AS c")} WHERE k < 5)""")
def gen_isset(t):
    lines = ("$x = {c}; return isset($x); }", "$x = 0; return empty($x); }", "return $x ?? {c}; }", "$x = ['a' => {c}]; return isset($x['z']); }", "$x = ['a' => {c}]; return $x['a'] ?? 1; }", "$x = $a ? {c} : null; return isset($x); }", "return isset($a['z']); }")
    return _found(Run(_files(t("customer"), "i", "c_custkey", _by_kind(F.col("c_custkey") % 7, [_text("function f{i}($a) { " + x, i="c_custkey", c="c_nationkey") for x in lines]), 100), Options(level=1)), "isset.variable", "isset.offset", "empty.variable", "nullCoalesce.variable", "nullCoalesce.offset")


_SETTLED = [
    ("identical.alwaysFalse", "'Strict comparison using === between int and string will always evaluate to false.'"), ("identical.alwaysFalse", "'Strict comparison using === between ' || c || ' and 99 will always evaluate to false.'"), ("greater.alwaysFalse", "'Comparison operation \">\" between ' || c || ' and 99 is always false.'"), ("equal.alwaysFalse", "'Loose comparison using == between ' || c || ' and 99 will always evaluate to false.'"), ("booleanNot.alwaysFalse", "'Negated boolean expression is always false.'"), ("booleanAnd.leftAlwaysTrue", "'Left side of && is always true.'"), ("booleanOr.rightAlwaysFalse", "'Right side of || is always false.'"), ("while.alwaysFalse", "'While loop condition is always false.'"), ("function.impossibleType", "'Call to function is_string() will always evaluate to false.'"), ("instanceof.alwaysFalse", "'Instanceof between A and B will always evaluate to false.'"), ("match.alwaysFalse", "'Match arm comparison between ' || c || ' and 99 is always false.'"),
]


@query(f"""SELECT path, line, {_cases("k", [_quoted(i) for i, _ in _SETTLED])} AS identifier, {_cases("k", [m for _, m in _SETTLED])} AS message
FROM {_lined("c", "c_custkey", 100, "customer", f"c_custkey % {len(_SETTLED) + 2} AS k, c_nationkey + 1 AS c")} WHERE k < {len(_SETTLED)}""")
def gen_settled_conditions(t):
    c = t("customer").withColumn("c", F.col("c_nationkey") + 1)
    lines = ("return $a === $s; }", "return {c} === 99; }", "return {c} > 99; }", "return {c} == 99; }", "return !{c}; }", "return {c} && $a; }", "return $a || false; }", "while (null) { h(); } }", "return is_string($a); }", "return $o instanceof B; }", "return match({c}) { 99 => 1, default => 2 }; }", "return $a === $b; }", "return is_int($u); }")
    line = _by_kind(F.col("c_custkey") % len(lines), [_text("function f{i}(int $a, int $b, string $s, A $o, int|string $u) { " + x, i="c_custkey", c="c") for x in lines])
    return _found(Run(_files(c, "c", "c_custkey", line, 100, head="<?php class A {} class B {}"), Options(level=4)), *[i for i, _ in _SETTLED])


_OPERANDS = [
    ("cast.int", "'Cannot cast array to int.'", "return (int) $xs; }"), ("echo.nonString", "'Parameter #1 (array) of echo cannot be converted to string.'", "echo $xs; }"), ("print.nonString", "'Parameter array of print cannot be converted to string.'", "print $xs; }"), ("binaryOp.invalid", "'Binary operation \"-\" between array and ' || c || ' results in an error.'", "return $xs - {c}; }"), ("unaryOp.invalid", "'Unary operation \"-\" on array results in an error.'", "return -$xs; }"), ("smaller.invalid", "'Comparison operation \"<\" between ' || c || ' and array results in an error.'", "return {c} < $xs; }"), ("foreach.nonIterable", "'Argument of an invalid type int supplied for foreach, only iterables are supported.'", "foreach ($a as $v) {} }"), ("arrayUnpacking.nonIterable", "'Only iterables can be unpacked, int given.'", "return [...$a]; }"), ("offsetAccess.notFound", "'Offset ''z'' does not exist on array{a: ' || c || '}.'", "$x = ['a' => {c}]; return $x['z']; }"), ("clone.nonObject", "'Cannot clone non-object variable $a of type int.'", "return clone $a; }"), ("method.nonObject", "'Cannot call method m() on int.'", "return $a->m(); }"), ("property.nonObject", "'Cannot access property $p on int.'", "return $a->p; }"), ("callable.nonCallable", "'Trying to invoke int but it''s not a callable.'", "return $a(); }"), ("throw.notThrowable", "'Invalid type int to throw.'", "throw $a; }"), ("offsetAccess.nonArray", "'Cannot use array destructuring on int.'", "[$p, $q] = $a; }"), ("array.invalidKey", "'Invalid array key type array.'", "return [$xs => 1]; }"), ("function.resultUnused", "'Call to function strlen() on a separate line has no effect.'", "strlen('x'); }"), ("nullsafe.neverNull", "'Using nullsafe property access on non-nullable type O. Use -> instead.'", "return $o?->p; }"), ("assignOp.invalid", "'Binary operation \"*\" between array and ' || c || ' results in an error.'", "$xs *= {c}; }"), ("encapsedStringPart.nonString", "'Part expression (array) of encapsed string cannot be cast to string.'", 'return "x {$xs}"; }'),
]


@query(f"""SELECT path, line, {_cases("k", [_quoted(i) for i, *_ in _OPERANDS])} AS identifier, {_cases("k", [m for _, m, _ in _OPERANDS])} AS message
FROM {_lined("o", "p_partkey", 100, "part", f"p_partkey % {len(_OPERANDS) + 1} AS k, p_size AS c")} WHERE k < {len(_OPERANDS)}""")
def gen_operands(t):
    """One rule on types a line."""
    lines = [x for *_, x in _OPERANDS] + ["return $a + {c}; }"]
    line = _by_kind(F.col("p_partkey") % len(lines), [_text("function f{i}(int $a, array $xs, O $o) { " + x, i="p_partkey", c="p_size") for x in lines])
    return _found(Run(_files(t("part"), "o", "p_partkey", line, 100, head="<?php class O { public $p; }"), Options(level=4)), *[i for i, *_ in _OPERANDS])


@query(f"""SELECT 'f' || p AS name, {_cases("k", ["'int'", "'string|null'", "'void'", "'float|int'", "'never'"])} AS type FROM (SELECT p_partkey AS p, p_partkey % 5 AS k FROM part)""")
def gen_return_inference(t):
    """What bodies without a declared type return."""
    lines = ("return 5; }", "if ($a) { return 'x'; } return null; }", "h(); }", "return $a ? 1.5 : 2; }", "throw new E(); }")
    run = Run(_files(t("part"), "q", "p_partkey", _by_kind(F.col("p_partkey") % 5, [_text("function f{i}($a) { " + x, i="p_partkey") for x in lines]), 100), Options(level=-1))
    return run.typed.where("rel = 'return'").select("name", F.element_at("args", 1).alias("type"))


@query(f"""SELECT path, line, CASE WHEN k = 0 THEN 'method.nonObject' WHEN k = 1 THEN 'property.nonObject' ELSE 'offsetAccess.nonOffsetAccessible' END AS identifier, {_cases("k", ["'Cannot call method m() on O|null.'", "'Cannot access property $p on O|null.'", "'Cannot access offset ' || c || ' on list<int>|null.'"])} AS message
FROM {_lined("z", "s_suppkey", 50, "supplier", "s_suppkey % 5 AS k, s_nationkey AS c")} WHERE k < 3""")
def gen_nullable_access(t):
    lines = ("?O $o) { return $o->m(); }", "?O $o) { return $o->p; }", "$l) { /** @var list<int>|null $l */ $l; return $l[{c}]; }", "?O $o) { return $o?->m(); }", "?O $o) { if ($o === null) { return 1; } return $o->p; }")
    line = _by_kind(F.col("s_suppkey") % 5, [_text("function f{i}(" + x, i="s_suppkey", c="s_nationkey") for x in lines])
    return _found(Run(_files(t("supplier"), "z", "s_suppkey", line, 50, head="<?php class O { public $p; function m() {} }"), Options(level=8)), "method.nonObject", "property.nonObject", "offsetAccess.nonOffsetAccessible")


@query("""SELECT 'f' || p AS name, CASE WHEN p_size % 3 = 0 THEN 'int' WHEN p_size % 3 = 1 THEN 'int|string' ELSE 'array' END AS param, CASE WHEN p_size % 3 = 0 THEN 'int' WHEN p_size % 3 = 1 THEN 'int|string' ELSE 'array' END AS returned
FROM (SELECT p_partkey AS p, p_size FROM part)""")
def gen_inferred_signatures(t):
    """Parameters typed by their calls, and returns by their bodies, across files and rounds."""
    p = t("part")
    lib = _files(p, "lib", "p_partkey", _text("function f{i}($x) { return g{i}($x); } function g{i}($y) { return $y; }", i="p_partkey"), 100)
    calls = _by_kind(F.col("p_size") % 3, [_text(x, i="p_partkey") for x in ("f{i}(1); f{i}(2);", "f{i}(1); f{i}('s');", "f{i}([1]);")])
    run = Run(lib.unionByName(_files(p, "use", "p_partkey", calls, 100)), Options(level=-1), infer=4)
    told = run.inferred.where("member is null and key like 'f%'").select(F.col("key").alias("name"), F.from_json("data", "p map<string,string>, r string").alias("d"))
    return told.select("name", F.regexp_replace(F.col("d.p")["0"], r"array\{.*\}", "array").alias("param"), F.regexp_replace("d.r", r"array\{.*\}", "array").alias("returned"))


_DECLARED = [
    ("parameter.phpDocType", "'PHPDoc tag @param for parameter $x with type string is incompatible with native type int.'", "/** @param string $x */ function f{i}(int $x) {}"), ("parameter.notFound", "'PHPDoc tag @param references unknown parameter: $y'", "/** @param int $y */ function f{i}(int $x) {}"), ("return.phpDocType", "'PHPDoc tag @return with type string is incompatible with native type int.'", "/** @return string */ function f{i}(): int { return {c}; }"), ("property.phpDocType", "'PHPDoc tag @var for property K' || i || '::$p with type string is incompatible with native type int.'", "class K{i} { /** @var string */ public int $p = {c}; }"),
    ("throws.notThrowable", "'PHPDoc tag @throws with type O is not subtype of Throwable'", "/** @throws O */ function f{i}() {}"), ("parameter.notByRef", "'Parameter $x for PHPDoc tag @param-out is not passed by reference.'", "/** @param-out int $x */ function f{i}($x) {}"), ("phpDoc.phpstanTag", "'Unknown PHPDoc tag: @phpstan-foo'", "/** @phpstan-foo */ function f{i}() {}"), ("generics.existingClass", "'PHPDoc tag @template for class K' || i || ' cannot have existing class O as its name.'", "/** @template O */ class K{i} {}"), ("enum.generic", "'Enum K' || i || ' has PHPDoc @template tag but enums cannot be generic.'", "/** @template T */ enum K{i} { case A; }"),
    ("method.shadowTemplate", "'PHPDoc tag @template T for method K' || i || '::m() shadows @template T for class K' || i || '.'", "/** @template T */ class K{i} { /** @template T */ function m() {} }"), ("parameter.defaultValue", "'Default value of the parameter #1 $x (''s'') of function f' || i || '() is incompatible with type int.'", "function f{i}(int $x = 's') {}"), ("classConstant.value", "'Constant K' || i || '::C (string) does not accept value ' || c || '.'", "class K{i} { const string C = {c}; }"), ("throws.void", "'Function f' || i || '() throws exception E but the PHPDoc contains @throws void.'", "/** @throws void */ function f{i}() { throw new E(); }"),
    ("generator.returnType", "'Yield can be used only with these return types: Generator, Iterator, Traversable, iterable.'", "function f{i}(): int { yield {c}; }"), ("pureFunction.void", "'Function f' || i || '() is marked as pure but returns void.'", "/** @pure */ function f{i}(): void {}"), ("return.unusedType", "'Function f' || i || '() never returns null so it can be removed from the return type.'", "function f{i}(): ?int { return {c}; }"), ("property.readOnlyAssignNotInConstructor", "'Readonly property K' || i || '::$p is assigned outside of the constructor.'", "class K{i} { function __construct(public readonly int $p) {} function m() { $this->p = {c}; } }"), ("property.uninitializedReadonly", "'Class K' || i || ' has an uninitialized readonly property $p. Assign it in the constructor.'", "class K{i} { public readonly int $p; }"), ("new.resultUnused", "'Call to new O() on a separate line has no effect.'", "new O();"),
]


@query(f"""SELECT path, line, {_cases("k", [_quoted(i) for i, *_ in _DECLARED])} AS identifier, {_cases("k", [m for _, m, _ in _DECLARED])} AS message
FROM {_lined("d", "p_partkey", 100, "part", f"p_partkey % {len(_DECLARED) + 1} AS k, p_size AS c, p_partkey AS i")} WHERE k < {len(_DECLARED)}""")
def gen_declarations(t):
    """One rule on declarations and docblocks a line."""
    lines = [x for *_, x in _DECLARED] + ["/** @param int $x */ function f{i}(int $x): int { return $x; }"]
    line = _by_kind(F.col("p_partkey") % len(lines), [_text(x, i="p_partkey", c="p_size") for x in lines])
    return _found(Run(_files(t("part"), "d", "p_partkey", line, 100, head="<?php class O {}"), Options(level=4)), *[i for i, *_ in _DECLARED])
