"""Runs over several files: joined rules, suppression, repairs, incremental passes, command line."""

import pytest

from brambleq.operators import findings as fnd
from brambleq.operators import repairs
from brambleq.php.rules_local import Options
from brambleq.plans import fixing
from brambleq.plans.analysis import Run, manifest
from brambleq.streaming import watch

BASE = rb"""<?php
namespace App;
abstract class Base { abstract function go(); final function fin() {} static function st() {} const K = 1; }
class A extends Base { function fin() {} function st() {} function t() { $this->nope(); $this->q; self::Z; self::K; A::nos(); } }
final class Fi {} class Ch extends Fi implements A { use I; }
interface I {} trait T {}
class Magic { function __call($a, $b) {} function __get($a) {} } class Lost extends Missing { function x() { $this->any(); } }
function foo($a) { try { new Base; new I; new Nope; } catch (A $e) {} catch (\Exception $e) {} $x = new A; $x->zip(); (new Magic)->any()->p; FOO(1); UNKNOWN_C; bar(); }
"""


def files(spark, sources):
    return spark.createDataFrame([(p, i, True, False, s) for i, (p, s) in enumerate(sources.items())], "path string, ord int, analyze boolean, stub boolean, source binary")


def test_joined_rules(spark):
    use = b"<?php\n$a = new \\App\\A; // @phpstan-ignore new.abstract\n$b instanceof \\App\\T;\nnew Zork; // @phpstan-ignore class.notFound\n// @phpstan-ignore-next-line\nnew Zork;\n"
    run = Run(files(spark, {"a.php": BASE, "b.php": use}), Options(level=2), functions_complete=True)
    got = {(r["path"], r["line"], r["identifier"]) for r in run.report().collect()}
    want = {
        ("a.php", 7, "class.notFound"), ("a.php", 8, "class.notFound"), ("a.php", 8, "constant.notFound"), ("a.php", 8, "function.notFound"), ("a.php", 8, "function.nameCase"), ("a.php", 8, "new.abstract"), ("a.php", 8, "new.interface"), ("a.php", 5, "traitUse.interface"), ("a.php", 5, "class.extendsFinal"), ("a.php", 5, "classImplements.class"), ("a.php", 8, "catch.notThrowable"),
        ("a.php", 4, "classConstant.notFound"), ("a.php", 4, "method.notFound"), ("a.php", 8, "method.notFound"), ("a.php", 4, "staticMethod.notFound"), ("a.php", 4, "property.notFound"), ("a.php", 4, "method.missingImplementation"), ("a.php", 5, "method.missingImplementation"), ("a.php", 4, "method.parentMethodFinal"), ("a.php", 4, "method.nonStatic"), ("b.php", 3, "instanceof.trait"),
    }
    assert got == want
    assert len(manifest()) > 100


def test_baseline_takes_what_it_counts(spark):
    f = spark.createDataFrame([("a", 1, "m. (x)", "i"), ("a", 2, "m. (x)", "i"), ("b", 1, "n", "i")], "path string, line int, message string, identifier string")
    base = fnd.build_baseline(f)
    assert {(r["path"], r["message"], r["count"]) for r in base.collect()} == {("a", "^m\\. \\(x\\)$", 2), ("b", "^n$", 1)}
    more = f.union(f.where("line = 2"))
    left = fnd.apply_counts(more.withColumn("message", fnd.anchored(more["message"])), base, ["path", "message", "identifier"], ["line"])
    assert left.count() == 1
    gone = fnd.unmatched(base, f.where("path = 'b'").withColumn("message", fnd.anchored(f["message"])), ["path", "message", "identifier"])
    assert [r["path"] for r in gone.collect()] == ["a"]


def test_repairs(spark):
    src = b"<?php $f = function () use ($a, &$b, $c) { return $c; }; $g = function () use ($z) { return (integer) 1; };"
    out = fixing.fix(files(spark, {"a.php": src, "b.php": b"<?php echo 1;"}), Options(level=1, php=80500))
    got = {r["path"]: bytes(r["source"]) for r in out.collect()}
    assert got["a.php"] == b"<?php $f = function () use ($c) { return $c; }; $g = function () { return (int) 1; };" and got["b.php"] == b"<?php echo 1;"
    edits = spark.createDataFrame([("a", 0, 3, "x", None), ("a", 2, 4, "y", None), ("b", 5, 5, "p", "return"), ("b", 5, 5, "q", "param"), ("b", 5, 5, "q", "param")], "path string, start int, end int, text string, tag string")
    left = repairs.applicable(repairs.mergeable(edits)).collect()
    assert [(r["path"], r["text"]) for r in left] == [("b", "qp")]


def _rows(df):
    return sorted((r["path"], r["line"], r["column"], r["identifier"], r["message"]) for r in df.collect())


def test_incremental_equals_fresh(spark):
    a = b"<?php class A { function m() {} }"
    b = b"<?php class B extends A { function t() { $this->m(); $this->n(); } }"
    c = b"<?php (new B)->m(); new C; echo $q[];"
    steps = [{"a.php": a, "b.php": b, "c.php": c}, {"a.php": b"<?php class A { function n() {} }", "b.php": b, "d.php": b"<?php class C {}"}]
    session = watch.Session(Options(level=2))
    session.update(files(spark, steps[0]))
    got = session.update(files(spark, steps[1]))
    assert _rows(got) == _rows(Run(files(spark, steps[1]), Options(level=2)).report())
    assert {r["path"] for r in session.touched.collect()} >= {"a.php", "b.php", "d.php"}


def test_incremental_parses_what_changed(spark):
    lib, use = b"<?php class A { function m(int $x) {} }", b"<?php (new A)->m(1); (new A)->n();"
    session = watch.Session(Options(level=5))
    session.update(files(spark, {"a.php": lib, "b.php": use, "c.php": b"<?php echo 1;"}))
    assert session.parsed.count() == 3
    changes = [
        {"a.php": b"<?php\n\nclass A { function m(string $x) { return 2; } function n() {} }", "b.php": use, "c.php": b"<?php echo 1;"},  # lines move, a signature changes
        {"a.php": b"<?php\n\nclass A { function m(string $x) { return 2; } function n() {} }", "b.php": use},  # a file goes
    ]
    for step, n in zip(changes, (1, 0), strict=True):
        got = session.update(files(spark, step))
        assert session.parsed.count() == n
        assert _rows(got) == _rows(Run(files(spark, step), Options(level=5)).report())


def test_watch_stream(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.php").write_bytes(b"<?php new Q;")
    seen = []
    q = watch.watch(watch.arrivals(spark, str(root)), lambda df, n: seen.extend(r["path"].rsplit("/", 1)[-1] for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    (root / "b.php").write_bytes(b"<?php new R;")
    q.processAllAvailable()
    q.stop()
    assert seen == ["a.php", "b.php"]


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src" / "vendor" / "x" / "vendor").mkdir(parents=True)
    (tmp_path / "src" / "a.php").write_bytes(b"<?php new Nope; // \xff")
    (tmp_path / "src" / "vendor" / "x" / "vendor" / "b.php").write_bytes(b"<?php new Nope2;")
    (tmp_path / "src" / "skip.php").write_bytes(b"<?php new Nope3;")
    return tmp_path


def test_command_line(spark, tree, capsys):
    from brambleq.__main__ import main

    conf = tree / "c.neon"
    conf.write_text("parameters:\n    level: 0\n    excludePaths:\n        - skip.php\n")
    assert main(["--no-infer-untyped", str(tree / "src"), "-c", str(conf), "--error-format", "raw"], spark) == 1
    assert capsys.readouterr().out.strip() == "a.php:1:unknown class `Nope`"
    assert main([], spark) == 2
    base = tree / "b.neon"
    assert main(["--no-infer-untyped", str(tree / "src"), "-c", str(conf), "-b", str(base)], spark) == 0
    assert "identifier: class.notFound" in base.read_text()


def test_baseline_round_trip(spark, tree, capsys):
    import json

    from brambleq.__main__ import main

    (tree / "src" / "a.php").write_bytes(b"<?php new Nope;\nnew Nope;\nnew Other;")
    conf, base = tree / "c.neon", tree / "b.neon"
    conf.write_text("parameters:\n    level: 0\n    excludePaths:\n        - skip.php\n")
    assert main(["--no-infer-untyped", str(tree / "src"), "-c", str(conf), "-b", str(base)], spark) == 0
    both = tree / "d.neon"
    entries = base.read_text().split("ignoreErrors:", 1)[1]
    both.write_text(conf.read_text() + "    ignoreErrors:" + entries)
    capsys.readouterr()
    assert main(["--no-infer-untyped", str(tree / "src"), "-c", str(both), "--error-format", "raw"], spark) == 0
    # one more of a kind than the baseline has, and one of a new kind
    (tree / "src" / "a.php").write_bytes(b"<?php new Nope;\nnew Nope;\nnew Other;\nnew Nope;\nnew Third;")
    assert main(["--no-infer-untyped", str(tree / "src"), "-c", str(both), "--error-format", "json"], spark) == 1
    doc = json.loads(capsys.readouterr().out)
    assert doc["totals"] == {"errors": 0, "file_errors": 2} and [m["line"] for m in doc["files"]["a.php"]["messages"]] == [4, 5]


def test_documents(spark):
    import json
    import xml.dom.minidom

    from brambleq.operators import reports

    rows = [("a.php", 4, 1, "one <b>", "x.y", "error", 0, 0, 9), ("a.php", 2, 3, "two", "x.z", "error", 1, 0, 3), ("b.php", 1, 1, "three", "x.y", "error", 0, 1, 0)]
    found = spark.createDataFrame(rows, "path string, line int, column int, message string, identifier string, severity string, rule_ord int, ord int, start int")
    whole = {name: "\n".join(reports.document(name, found)) for name in reports.FORMATS}
    assert json.loads(whole["json"]) == json.loads(whole["prettyJson"])
    assert json.loads(whole["json"])["totals"] == {"errors": 0, "file_errors": 3}
    assert [(x["location"]["path"], x["location"]["lines"]["begin"]) for x in json.loads(whole["gitlab"])] == [("a.php", 2), ("a.php", 4), ("b.php", 1)]
    assert [e.getAttribute("line") for e in xml.dom.minidom.parseString(whole["checkstyle"]).getElementsByTagName("error")] == ["2", "4", "1"]
    assert len(xml.dom.minidom.parseString(whole["junit"]).getElementsByTagName("failure")) == 3
    assert whole["raw"].split("\n")[0] == "a.php:4:one <b>" and whole["table"].split("\n")[0] == "a.php"
    none = {name: "\n".join(reports.document(name, found.limit(0))) for name in reports.FORMATS}
    assert json.loads(none["gitlab"]) == [] and 'tests="1"' in none["junit"] and json.loads(none["json"])["files"] == {}
