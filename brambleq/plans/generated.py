"""Queries over generated programs: text, scanner, parser, resolution and rules together,
against DuckDB on the rows that the programs were written from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambleq.operators import signatures
from brambleq.php.rules_local import Options
from brambleq.plans import analysis
from brambleq.plans.analysis import Run
from brambleq.sources.generated import program

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _n(c: str):
    return F.col(c).cast("string")


def _path(folder: str, key: str, each: int):
    """Files of so many consecutive keys, whatever the table's size."""
    return F.concat(F.lit(folder), F.expr(f"{key} div {each}").cast("string"), F.lit(".php"))


def _brief(df: DataFrame) -> DataFrame:
    return df.select("path", "line", "identifier", "message")


def _local(run: Run, identifier: str) -> DataFrame:
    return run.relation("finding").where(F.col("key") == identifier).select("path", "line", F.col("key").alias("identifier"), F.col("name").alias("message"))


def _customers(t):
    c = t("customer").where("c_acctbal >= 0")
    return program(c, _path("model/n", "c_custkey", 200), ["c_custkey"], F.concat(F.lit("class C"), _n("c_custkey"), F.lit(" {}")), head="<?php namespace Model;")


_LINED = "row_number() OVER (PARTITION BY {p} ORDER BY {o}) + 1"


@query(f"""SELECT path, line, 'class.notFound' AS identifier, 'unknown class `Model\\C' || o_custkey || '`' AS message FROM (
  SELECT 'run/o' || o_orderkey // 400 || '.php' AS path, ({_LINED.format(p="o_orderkey // 400", o="o_orderkey")})::INT AS line, o_custkey FROM orders)
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def gen_class_not_found(t):
    uses = program(t("orders"), _path("run/o", "o_orderkey", 400), ["o_orderkey"], F.concat(F.lit("new M\\C"), _n("o_custkey"), F.lit(";")), head="<?php use Model as M;")
    return _brief(analysis.unknown_symbol(Run(_customers(t).unionByName(uses), Options(level=0))))


_H = """RECURSIVE up AS (SELECT p_partkey AS node, p_partkey AS anc FROM part UNION ALL SELECT node, anc // 2 FROM up WHERE anc > 1),
have AS (SELECT DISTINCT node, p_size AS m FROM up JOIN part ON p_partkey = anc)"""


@query(f"""WITH {_H} SELECT path, line, 'method.notFound' AS identifier, 'Call to an undefined method P' || p_partkey || '::m' || m || '().' AS message FROM (
  SELECT 'use/u' || p_partkey // 100 || '.php' AS path, ({_LINED.format(p="p_partkey // 100", o="p_partkey")})::INT AS line, p_partkey, (p_size * 7) % 50 + 1 AS m FROM part)
WHERE NOT EXISTS (SELECT 1 FROM have WHERE node = p_partkey AND have.m = (SELECT (p_size * 7) % 50 + 1 FROM part q WHERE q.p_partkey = node))""".replace("have.m = (SELECT (p_size * 7) % 50 + 1 FROM part q WHERE q.p_partkey = node)", "have.m = _.m").replace("FROM part)\nWHERE", "FROM part) AS _\nWHERE"))
def gen_method_lookup(t):
    p = t("part")
    parent = F.when(F.col("p_partkey") > 1, F.concat(F.lit(" extends P"), F.expr("p_partkey div 2").cast("string"))).otherwise(F.lit(""))
    classes = program(p, _path("lib/p", "p_partkey", 100), ["p_partkey"], F.concat(F.lit("class P"), _n("p_partkey"), parent, F.lit(" { public function m"), _n("p_size"), F.lit("(): void {} }")))
    uses = program(p, _path("use/u", "p_partkey", 100), ["p_partkey"], F.concat(F.lit("(new P"), _n("p_partkey"), F.lit(")->m"), ((F.col("p_size") * 7) % 50 + 1).cast("string"), F.lit("();")))
    return _brief(analysis.method_typed(Run(classes.unionByName(uses), Options(level=2))))


@query(f"""SELECT path, line, 'method.unused' AS identifier, 'Method C' || c_custkey || '::m() is unused.' AS message FROM (
  SELECT 'c/' || c_custkey // 100 || '.php' AS path, ({_LINED.format(p="c_custkey // 100", o="c_custkey")})::INT AS line, c_custkey FROM customer) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def gen_unused_method(t):
    used = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("u", F.lit(True))
    c = t("customer").join(used, "c_custkey", "left")
    body = F.when(F.col("u"), "public function run(): void { $this->m(); }").otherwise("public function run(): void { $this->run(); }")
    files = program(c, _path("c/", "c_custkey", 100), ["c_custkey"], F.concat(F.lit("class C"), _n("c_custkey"), F.lit(" { private function m(): void {} "), body, F.lit(" }")))
    return _local(Run(files, Options(level=4)), "method.unused")


@query(f"""SELECT path, line, 'variable.undefined' AS identifier, CASE WHEN k = 1 THEN 'Variable $x might not be defined.' ELSE 'Undefined variable: $x' END AS message FROM (
  SELECT 'f/' || event_id // 400 || '.php' AS path, ({_LINED.format(p="event_id // 400", o="event_id")})::INT AS line, event_id % 4 AS k FROM events) WHERE k IN (1, 2)""")
def gen_undefined_variable(t):
    k = F.col("event_id") % 4
    body = F.when(k == 0, "$x = 1;").when(k == 1, "if ($a) { $x = 1; }").when(k == 2, "$y = $a;").otherwise("if ($a) { $x = 1; } else { return; }")
    files = program(t("events"), _path("f/", "event_id", 400), ["event_id"], F.concat(F.lit("function f"), _n("event_id"), F.lit("($a) { "), body, F.lit(" return $x + 1; }")))
    return _local(Run(files, Options(level=1)), "variable.undefined")


@query(f"""SELECT path, line, 'array.duplicateKey' AS identifier, 'Array has 2 duplicate keys with value ' || a || ' (' || a || ', ''' || a || ''').' AS message FROM (
  SELECT 'a/' || l_orderkey // 100 || '.php' AS path, ({_LINED.format(p="l_orderkey // 100", o="l_orderkey, l_linenumber, l_partkey, l_suppkey")})::INT AS line, l_suppkey % 3 AS a, l_partkey % 3 AS b FROM lineitem) WHERE a = b""")
def gen_duplicate_key(t):
    return _duplicate_key(t("lineitem"))


def _duplicate_key(li: DataFrame) -> DataFrame:
    line = F.concat(F.lit("$a = ["), (F.col("l_suppkey") % 3).cast("string"), F.lit(" => 1, '"), (F.col("l_partkey") % 3).cast("string"), F.lit("' => 2, 'k' => 3];"))
    files = program(li, _path("a/", "l_orderkey", 100), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], line)
    return _local(Run(files, Options(level=0)), "array.duplicateKey")


@query(f"""SELECT path, line, 'class.notFound' AS identifier FROM (
  SELECT 'i/' || o_orderkey // 400 || '.php' AS path, ({_LINED.format(p="o_orderkey // 400", o="o_orderkey")})::INT AS line, o_orderkey % 3 AS k FROM orders) WHERE k <> 0""")
def gen_inline_ignore(t):
    return _inline_ignore(t("orders"))


def _inline_ignore(o: DataFrame) -> DataFrame:
    mark = F.when(F.col("o_orderkey") % 3 == 0, " // @phpstan-ignore class.notFound").when(F.col("o_orderkey") % 3 == 1, " // @phpstan-ignore other.thing (no reason)").otherwise("")
    files = program(o, _path("i/", "o_orderkey", 400), ["o_orderkey"], F.concat(F.lit("new Q"), _n("o_orderkey"), F.lit(";"), mark))
    from brambleq.operators.findings import unmarked

    run = Run(files, Options(level=0))
    marks = run.relation("marker").where("res is null").select("path", F.col("name").cast("int").alias("line"), F.when(F.size("args") > 0, F.col("args")).alias("identifiers"))
    return unmarked(analysis.unknown_symbol(run), marks).select("path", "line", "identifier")


@query("""SELECT 'new' AS name, count(*) AS n FROM orders UNION ALL SELECT 'class', count(*) FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'interp', count(*) FROM events UNION ALL SELECT 'match', count(*) FROM supplier""")
def gen_nodes(t):
    """The tree as an adjacency list: nodes of four kinds."""
    o = program(t("orders"), _path("o", "o_orderkey", 400), ["o_orderkey"], F.concat(F.lit("new C"), _n("o_custkey"), F.lit(";")))
    e = program(t("events"), _path("e", "event_id", 400), ["event_id"], F.concat(F.lit('echo "id $a['), _n("event_id"), F.lit("] {$b->c}\";")))
    s = program(t("supplier"), _path("s", "s_suppkey", 50), ["s_suppkey"], F.concat(F.lit("$x = match("), _n("s_suppkey"), F.lit(") { 1, 2 => 'a', default => null };")))
    files = _customers(t).unionByName(o).unionByName(e).unionByName(s)
    return Run(files, Options(level=-1), frozenset({"node"})).relation("node").where("name in ('new', 'class', 'interp', 'match')").groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT 'assignments' AS rel, count(*) AS n FROM events UNION ALL SELECT 'function_calls', count(*) FROM events UNION ALL SELECT 'binaries', count(*) FROM events UNION ALL SELECT 'method_calls', count(*) FROM supplier UNION ALL SELECT 'coalesces', count(*) FROM supplier""")
def gen_fact_views(t):
    e = program(t("events"), _path("e", "event_id", 400), ["event_id"], F.concat(F.lit("$a = strlen($b) + "), _n("event_id"), F.lit(";")))
    s = program(t("supplier"), _path("s", "s_suppkey", 50), ["s_suppkey"], F.concat(F.lit("$s?->call($x["), _n("s_suppkey"), F.lit("]); $q ??= 1;")))
    files = e.unionByName(s)
    return Run(files, Options(level=-1), frozenset({"facts"})).rows.where("rel in ('assignments', 'function_calls', 'binaries', 'method_calls', 'coalesces') and not (rel = 'assignments' and name = '??')").groupBy("rel").agg(F.count("*").alias("n"))


@query("""SELECT n, count(*) AS tokens FROM (SELECT unnest(['T_NEW', 'T_STRING', ';', 'T_LNUMBER', '(', ')']) AS n FROM orders) GROUP BY n""")
def gen_tokens(t):
    files = program(t("orders"), _path("o", "o_orderkey", 400), ["o_orderkey"], F.concat(F.lit("new C("), _n("o_custkey"), F.lit(");")))
    return Run(files, Options(level=-1), frozenset({"token"})).relation("token").where("name in ('T_NEW', 'T_STRING', ';', 'T_LNUMBER', '(', ')')").groupBy(F.col("name").alias("n")).agg(F.count("*").alias("tokens"))


@query(f"""SELECT path, line, 'arguments.count' AS identifier, 'Method S' || s || '::m() invoked with ' || g || CASE WHEN g = 1 THEN ' parameter, ' ELSE ' parameters, ' END || '1-2 required.' AS message FROM (
  SELECT 'k/' || s_suppkey // 50 || '.php' AS path, ({_LINED.format(p="s_suppkey // 50", o="s_suppkey")})::INT AS line, s_suppkey AS s, s_suppkey % 4 AS g FROM supplier) WHERE g NOT IN (1, 2)""")
def gen_arguments_count(t):
    s = t("supplier")
    classes = program(s, _path("lib", "s_suppkey", 50), ["s_suppkey"], F.concat(F.lit("class S"), _n("s_suppkey"), F.lit(" { function m($a, $b = 1) {} }")))
    args = F.array_join(F.slice(F.array(F.lit("1"), F.lit("2"), F.lit("3")), F.lit(1), (F.col("s_suppkey") % 4).cast("int")), ", ")
    uses = program(s, _path("k/", "s_suppkey", 50), ["s_suppkey"], F.concat(F.lit("(new S"), _n("s_suppkey"), F.lit(")->m("), args, F.lit(");")))
    return _brief(analysis.method_arguments(Run(classes.unionByName(uses), Options(level=0))))


@query(f"""SELECT path, line, 'method.parentMethodFinal' AS identifier, 'Method K' || s || '::m() overrides final method B' || s % 7 || '::m().' AS message FROM (
  SELECT 'k/' || s_suppkey // 50 || '.php' AS path, ({_LINED.format(p="s_suppkey // 50", o="s_suppkey")})::INT AS line, s_suppkey AS s FROM supplier) WHERE s % 7 < 3""")
def gen_final_override(t):
    s = t("supplier")
    base = program(s.select((F.col("s_suppkey") % 7).alias("b")).distinct(), F.lit("base.php"), ["b"], F.concat(F.lit("class B"), _n("b"), F.lit(" { "), F.when(F.col("b") < 3, "final ").otherwise(""), F.lit("public function m() {} }")))
    kids = program(s, _path("k/", "s_suppkey", 50), ["s_suppkey"], F.concat(F.lit("class K"), _n("s_suppkey"), F.lit(" extends B"), (F.col("s_suppkey") % 7).cast("string"), F.lit(" { public function m() {} }")))
    return _brief(analysis.overriding(Run(base.unionByName(kids), Options(level=0))))


@query("""SELECT source AS path, count(*) FILTER (error) AS errors, count(*) AS docs FROM (SELECT source, false AS error FROM documents) GROUP BY 1""")
def gen_total_parse(t):
    """The scanner and the parser on any text at all: every document is taken as a file's inline text."""
    d = t("documents").select(F.col("doc_id"), "source", F.encode("text", "UTF-8").alias("b"))
    files = d.select(_n("doc_id").alias("path"), F.lit(0).alias("ord"), F.lit(True).alias("analyze"), F.lit(False).alias("stub"), F.col("b").alias("source"))
    rows = Run(files, Options(level=-1)).rows
    bad = rows.where("rel = 'error'").select("path").distinct().withColumn("e", F.lit(1))
    return d.select(_n("doc_id").alias("path"), F.col("source").alias("s")).join(bad, "path", "left").groupBy(F.col("s").alias("path")).agg(F.count("e").alias("errors"), F.count("*").alias("docs"))


@query("""WITH RECURSIVE k AS (SELECT p_partkey AS node, CASE WHEN p_size < 3 THEN 'int' WHEN p_size < 5 THEN 'string' END AS type, 0 AS r FROM part WHERE p_size < 5
  UNION SELECT p_partkey, type, r + 1 FROM k JOIN part ON p_partkey // 2 = node WHERE r < 3 AND p_partkey > 1 AND p_size >= 5)
SELECT 'f' || node AS node, string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM k GROUP BY 1""")
def gen_signatures(t):
    """Argument evidence harvested from calls, then handed along calls for three rounds."""
    p = t("part")
    literal = F.when(F.col("p_size") < 3, "1").otherwise("'s'")
    own = program(p, _path("f", "p_partkey", 200), ["p_partkey"], F.concat(F.lit("function f"), _n("p_partkey"), F.lit("($x) { f"), (F.col("p_partkey") * 2).cast("string"), F.lit("($x); f"), (F.col("p_partkey") * 2 + 1).cast("string"), F.lit("($x); }")))
    calls = program(p.where("p_size < 5"), _path("c", "p_partkey", 200), ["p_partkey"], F.concat(F.lit("f"), _n("p_partkey"), F.lit("("), literal, F.lit(");")))
    run = Run(own.unionByName(calls), Options(level=-1), frozenset({"facts"}))
    arg = F.element_at("args", 1)
    seen = run.relation("function_calls")
    declared = p.select(F.concat(F.lit("f"), _n("p_partkey")).alias("dst"), (F.col("p_size") >= 5).alias("free"))
    known = seen.where(arg != "$x").select(F.col("name").alias("node"), F.when(arg == "1", "int").otherwise("string").alias("type"))
    flows = seen.where(arg == "$x").select(F.col("alt").alias("src"), F.col("name").alias("dst")).join(declared.where("free"), "dst", "left_semi").select("src", "dst")
    return signatures.propagate(known, flows)


_MEMBERS = [("property.nonStatic", "'Non-static property K' || s || '::$p overrides static property B0::$p.'", "public static $p; ", "public $p; "), ("property.readOnly", "'Readonly property K' || s || '::$p overrides readwrite property B1::$p.'", "public int $p; ", "public readonly int $p; "), ("property.visibility", "'Protected property K' || s || '::$p overriding public property B2::$p should also be public.'", "public $p; ", "protected $p; "), ("classConstant.final", "'Constant K' || s || '::C overrides final constant B3::C.'", "final const C = 1; ", "const C = 2; "), ("classConstant.visibility", "'Private constant K' || s || '::C overriding protected constant B4::C should be protected or public.'", "protected const C = 1; ", "private const C = 2; "), ("property.missingNativeType", "'Property K' || s || '::$p overriding property B5::$p should have native type int.'", "public int $p; ", "public $p; ")]


@query(f"""SELECT path, line, CASE {" ".join(f"WHEN k = {i} THEN '{c}'" for i, (c, *_) in enumerate(_MEMBERS))} END AS identifier, CASE {" ".join(f"WHEN k = {i} THEN {m}" for i, (_, m, *_) in enumerate(_MEMBERS))} END AS message FROM (
  SELECT 'k/' || s_suppkey // 50 || '.php' AS path, ({_LINED.format(p="s_suppkey // 50", o="s_suppkey")})::INT AS line, s_suppkey AS s, s_suppkey % 7 AS k FROM supplier) WHERE k < {len(_MEMBERS)}""")
def gen_member_overriding(t):
    """Properties and constants against those above them, across files."""
    s = t("supplier")
    k = F.col("s_suppkey") % 7
    pick = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (k + 1).cast("int"))
    base = program(s.select(k.cast("int").alias("b")).distinct(), F.lit("base.php"), ["b"], F.concat(F.lit("class B"), _n("b"), F.lit(" { "), F.element_at(F.array(*[F.lit(x) for *_, x, _ in _MEMBERS], F.lit("public $p; ")), F.col("b") + 1), F.lit("}")))
    kids = program(s, _path("k/", "s_suppkey", 50), ["s_suppkey"], F.concat(F.lit("class K"), _n("s_suppkey"), F.lit(" extends B"), k.cast("string"), F.lit(" { "), pick([*[x for *_, x in _MEMBERS], "public $p; "]), F.lit("}")))
    run = Run(base.unionByName(kids), Options(level=0))
    return _brief(analysis.property_overriding(run).unionByName(analysis.constant_overriding(run)))
