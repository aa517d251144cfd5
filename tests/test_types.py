"""Type algebra, column semantics, configuration."""

import pytest
from pyspark.sql import functions as F

from brambleq.functions.types import assignable, intersection, normal_type, offset, parse_type, render, strip_falsy, strip_null, union, verdict, widen, World
from brambleq.sources import config


@pytest.mark.parametrize(
    ("text", "want"),
    [("int|string|5|?foo", "int|string|foo|null"), ("array<string,int>[]", "array<array<string, int>>"), ("array{a: int, b?: string, ...}", "array{a: int, b?: string, ...}"), ("callable(int, string=): bool", "callable(int, string): bool"), ("'a'|'b'|string", "string"), ("true|false", "bool"), ("int<3, 3>", "3"), ("int<min, max>", "int"), ("($x is string ? int : float)", "($x is string ? int : float)"), ("Foo::BAR", "Foo::BAR"), ("positive-int", "int<1, max>"), ("!!", "")],
)
def test_parse_and_render(text, want):
    assert render(parse_type(text)) == (want or text)


@pytest.mark.parametrize(
    ("value", "target", "want"),
    [("int", "float", "yes"), ("float", "int", "no"), ("int|null", "int", "partial"), ("mixed", "int", "uncertain"), ("never", "int", "yes"), ("'x'", "non-empty-string", "yes"), ("''", "non-empty-string", "no"), ("string", "non-empty-string", "yes"), ("numeric-string", "non-falsy-string", "no"), ("int<1,5>", "int<0,10>", "yes"), ("int<0,10>", "int<1,5>", "no"), ("int", "int<1,5>", "yes"), ("array", "list<int>", "yes"), ("array<string,int>", "list<int>", "no"), ("array{a:int}", "array{a:int,b?:string}", "yes"), ("array{}", "array{a:int}", "no"), ("Foo", "object", "yes"), ("Foo", "Bar", "yes"), ("string", "callable", "yes"), ("int|float", "float", "yes"), ("non-empty-list<int>", "list<int>", "yes"), ("A&B", "B", "yes"), ("int", "A&B", "no")],
)
def test_assignability(value, target, want):
    assert assignable(parse_type(value), parse_type(target)) == want


def test_classes_need_a_path_only_where_both_are_known():
    w = World({"a", "b"}, {("c", "a")})
    t = lambda n: ("named", n, ())
    assert assignable(t("A"), t("B"), w) == "no" and assignable(t("C"), t("A"), w) == "yes" and assignable(t("A"), t("Z"), w) == "yes"


def test_refinement():
    p = parse_type
    assert render(strip_null(p("?int"))) == "int" and render(strip_falsy(p("bool|0|''|string|null"))) == "true|non-falsy-string"
    assert render(widen(p("1|'a'|true"))) == "int|string|bool" and union() == ("never",) and intersection(("int",), ("int",)) == ("int",)
    assert [offset(p("array{a: int, b?: int}"), k) for k in "abc"] == ["present", "maybe", "missing"]


def test_columns(spark):
    df = spark.createDataFrame([("int|5", "int"), (None, "int")], "a string, b string")
    got = [tuple(r) for r in df.select(normal_type("a"), verdict("a", "b")).collect()]
    assert got == [("int", "yes"), (None, None)]
    from brambleq.functions import values as v

    row = spark.range(1).select(v.union_types(F.array(F.lit("?int"), F.lit("int(3)"), F.lit("true"))).alias("u"), v.fold_divide(F.lit(7), F.lit(0)).alias("z"), v.fold_int("+", F.lit(2**63 - 1), F.lit(1).cast("bigint")).alias("o")).first()
    assert row["u"] == "int|null|true" and row["z"] == (None, None) and row["o"] is None


def test_config():
    c = config.read("parameters:\n    level: max\n    paths:\n        - src\n        - 'lib'\n    excludePaths: [a, b]\n    ignoreErrors:\n        -\n            message: '#^x$#'\n            count: 2\n            path: src/a.php\n        - '#plain#'\n    phpVersions: 1 # note\n")
    assert c.level == 10 and c.paths == ["src", "lib"] and c.excludePaths == ["a", "b"]
    assert c.warnings == ["Unknown key 'phpVersions', did you mean 'phpVersion'?"]
    e = config.ignores(c.ignoreErrors)
    assert [(x["message"], x["count"]) for x in e] == [("^x$", 2), ("plain", None)]
    assert c.gates() == {"reportMaybes": True, "checkNullables": True, "checkExplicitMixed": True, "checkImplicitMixed": True, "checkThisOnly": False}
    text = config.write_baseline([("a.php", "^it's$", "x.y", 3)])
    back = config.ignores(config.parse(text)["parameters"]["ignoreErrors"])
    assert back[0]["message"] == "^it's$" and back[0]["count"] == 3 and config.ignores([{}, {"message": "#(#"}]) == []
