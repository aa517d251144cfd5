"""Every query that has SQL against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from brambleq import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if isinstance(v, float):
            return "" if math.isnan(v) else f"{v:.9g}"
        return "" if v is None else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_duckdb(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got.collect(), got.columns) == norm(want.fetchall(), want.columns)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_closure_ends_on_cycles(spark):
    from brambleq.operators import hierarchy

    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("c", "d", 1), ("x", "x", 0)], "child string, parent string, ord int")
    got = {(r["node"], r["ancestor"]) for r in hierarchy.ancestors(edges).collect()}
    assert got == {(n, a) for n in "abc" for a in "abcd"} | {("d", "d"), ("x", "x")}


def test_whole_tables_of_programs(spark):
    """Every row is parsed and ruled on: as many findings as rows of the whole table have by the rule."""
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    assert catalogue.QUERIES["gen_duplicate_key"](spark, SF).count() == read("lineitem").where("l_suppkey % 3 = l_partkey % 3").count()
    assert catalogue.QUERIES["gen_inline_ignore"](spark, SF).count() == read("orders").where("o_orderkey % 3 <> 0").count()


def test_closure_of_a_long_chain(spark):
    from brambleq.operators import hierarchy

    edges = spark.createDataFrame([(i, i + 1, 0) for i in range(100)], "child long, parent long, ord int")
    closure = hierarchy.ancestors(edges)
    assert closure.count() == 101 * 102 // 2
    declared = spark.createDataFrame([(i,) for i in range(100)], "node long")
    assert not any(r["known"] for r in hierarchy.fully_known(closure, declared).collect())


def test_closure_of_diamonds(spark):
    from brambleq.operators import hierarchy

    # twenty stacked diamonds: a million ways up, one row a pair, by the first branch
    edges = [e for i in range(20) for e in ((f"t{i}", f"l{i}", 0), (f"t{i}", f"r{i}", 1), (f"l{i}", f"t{i + 1}", 0), (f"r{i}", f"t{i + 1}", 0))]
    rows = hierarchy.ancestors(spark.createDataFrame(edges, "child string, parent string, ord int"), spark.createDataFrame([("t0",)], "node string")).collect()
    assert len(rows) == 61 and len({r["ancestor"] for r in rows}) == 61
    first = {r["ancestor"]: r["path"] for r in rows}
    assert first["t20"] == "0000/" * 40 and first["r0"] == "0001/"
    many = [(0, i, i) for i in (9_999, 10_000, 10_001, 123_456)]
    order = [r["ancestor"] for r in hierarchy.ancestors(spark.createDataFrame(many, "child long, parent long, ord int")).where("node = 0").orderBy("path").collect()]
    assert order == [0, 9_999, 10_000, 10_001, 123_456]


def test_entries_take_findings_in_order(spark):
    import random

    from brambleq.operators.findings import settle

    r = random.Random(3)
    for _ in range(4):
        n, entries = 30, {e: r.choice([None, 1, 2, 5]) for e in range(6)}
        pairs = [(f, f, e, entries[e]) for f in range(n) for e in entries if r.random() < 0.4]
        left, want = dict(entries), {}
        for f in range(n):  # each goes to its first entry that is not full
            for e in sorted(e for g, _, e, _ in pairs if g == f):
                if left[e] is None or left[e] > 0:
                    want[f] = e
                    left[e] = None if left[e] is None else left[e] - 1
                    break
        got = {x["fid"]: x["entry"] for x in settle(spark.createDataFrame(pairs, "fid long, at long, entry int, n int")).collect() if x["fid"] in want or True}
        assert {f: e for f, e in got.items() if f in want} == want and set(got) == set(want)


def test_globs():
    import re

    from brambleq.functions.text import glob_regex

    yes = [("vendor", "vendor/a.php"), ("vendor", "x/vendor/a.php"), ("a/b", "a/b/c.php"), ("**/x.php", "x.php"), ("**/x.php", "a/b/x.php"), ("a/*.php", "a/b.php"), ("a/**", "a/b/c"), ("f?.php", "f1.php")]
    no = [("a/b", "x/a/b/c.php"), ("a/*.php", "a/b/c.php"), ("f?.php", "f/.php"), ("vendor", "vendors/a.php")]
    assert all(re.search(glob_regex(g), p) for g, p in yes) and not any(re.search(glob_regex(g), p) for g, p in no)
