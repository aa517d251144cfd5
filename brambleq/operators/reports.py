"""Findings as rows of each report format; rendering is a plain write of these rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_blocks(findings: DataFrame) -> DataFrame:
    """Per file: number of findings and the messages in line order, as JSON."""
    m = F.array_sort(F.collect_list(F.struct("line", "message", "identifier")))
    return findings.groupBy("path").agg(F.count("*").alias("errors"), F.to_json(F.transform(m, lambda x: F.struct(x["message"].alias("message"), x["line"].alias("line"), F.lit(True).alias("ignorable"), x["identifier"].alias("identifier")))).alias("messages"))


def totals(findings: DataFrame) -> DataFrame:
    """``errors``: findings outside files; ``file_errors``: the others that are errors."""
    outside = F.col("path") == "(ignore)"
    return findings.agg(F.sum(outside.cast("long")).alias("errors"), F.sum((~outside & (F.col("severity") == "error")).cast("long")).alias("file_errors"))


def gitlab(findings: DataFrame) -> DataFrame:
    """Code-quality rows with a fingerprint of path, line and message."""
    print_ = F.sha2(F.concat(F.col("path"), F.col("line").cast("string"), F.col("message")).cast("binary"), 256)
    return findings.select(F.col("message").alias("description"), "identifier", print_.alias("fingerprint"), F.when(F.col("severity") == "error", "major").otherwise("minor").alias("severity"), "path", "line")


def raw(findings: DataFrame) -> DataFrame:
    return findings.select(F.concat_ws(":", "path", F.col("line").cast("string"), "message").alias("value"))


def github(findings: DataFrame) -> DataFrame:
    """Workflow commands; properties escape two characters more than data."""
    data = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    prop = lambda c: F.replace(F.replace(data(c), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))
    return findings.select(F.concat(F.lit("::"), F.col("severity"), F.lit(" file="), prop(F.col("path")), F.lit(",line="), F.col("line").cast("string"), F.lit(",col="), F.col("column").cast("string"), F.lit("::"), data(F.col("message"))).alias("value"))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def checkstyle(findings: DataFrame) -> DataFrame:
    """One XML element per file; sort by ``path`` when writing."""
    one = F.concat(F.lit('<error line="'), F.col("line").cast("string"), F.lit('" column="'), F.col("column").cast("string"), F.lit('" severity="'), F.col("severity"), F.lit('" message="'), _xml(F.col("message")), F.lit('" source="'), _xml(F.col("identifier")), F.lit('"/>')).alias("e")
    rows = findings.select("path", F.struct("line", "column", "identifier", one).alias("s"))
    return rows.groupBy("path").agg(F.array_sort(F.collect_list("s")).alias("s")).select("path", F.concat(F.lit('<file name="'), _xml(F.col("path")), F.lit('">'), F.array_join(F.transform("s", lambda x: x["e"]), ""), F.lit("</file>")).alias("value"))


def junit(findings: DataFrame) -> DataFrame:
    return findings.select(F.concat(F.lit('<testcase name="'), _xml(F.concat_ws(":", "path", F.col("line").cast("string"))), F.lit('"><failure type="'), F.col("severity"), F.lit('" message="'), _xml(F.col("message")), F.lit('"/></testcase>')).alias("value"))


def table(findings: DataFrame) -> DataFrame:
    """Lines of the plain table, in order within a file."""
    return findings.select("path", "line", F.concat(F.lit("  "), F.lpad(F.col("line").cast("string"), 6, " "), F.lit("  "), F.col("message"), F.lit("  ["), F.col("identifier"), F.lit("]")).alias("value"))


def document(name: str, findings: DataFrame) -> Iterator[str]:
    """The lines of a whole report.  Rows come to the driver in order, some at a time."""
    found = findings.orderBy("path", "line", "column", "rule_ord", "start") if "rule_ord" in findings.columns else findings.orderBy("path", "line", "column")
    inside, outside = findings.where(F.col("path") != OUTSIDE), findings.where(F.col("path") == OUTSIDE)
    if name in ("json", "prettyJson"):
        indent = 4 if name == "prettyJson" else None
        t = totals(findings).first()
        files = {r["path"]: {"errors": r["errors"], "messages": json.loads(r["messages"])} for r in json_blocks(inside).orderBy("path").toLocalIterator()}
        yield json.dumps({"totals": {"errors": t["errors"] or 0, "file_errors": t["file_errors"] or 0}, "files": files, "errors": [r["message"] for r in outside.toLocalIterator()]}, indent=indent, ensure_ascii=False)
    elif name == "gitlab":
        yield "["
        comma = ""
        for r in gitlab(found.where(F.col("path") != OUTSIDE)).toLocalIterator():
            yield comma + json.dumps({"description": r["description"], "check_name": r["identifier"], "fingerprint": r["fingerprint"], "severity": "blocker" if r["identifier"] == "ignore.parseError" else "major", "location": {"path": r["path"], "lines": {"begin": r["line"]}}}, ensure_ascii=False)
            comma = ","
        yield "]"
    elif name == "checkstyle":
        yield '<?xml version="1.0" encoding="UTF-8"?>'
        yield "<checkstyle>"
        for r in checkstyle(findings).orderBy("path").toLocalIterator():
            yield r["value"]
        yield "</checkstyle>"
    elif name == "junit":
        n = findings.where("severity = 'error'").count()
        yield '<?xml version="1.0" encoding="UTF-8"?>'
        yield f'<testsuite failures="{n}" name="{SUITE}" tests="{max(1, n)}">'
        for r in junit(found).toLocalIterator():
            yield r["value"]
        if not n:
            yield f'<testcase name="{SUITE}"/>'
        yield "</testsuite>"
    else:
        path = None
        for r in FORMATS[name](findings.orderBy(*[c for c in ("ord", "rule_ord", "start") if c in findings.columns])).toLocalIterator():
            if name == "table" and r["path"] != path:
                path = r["path"]
                yield path
            yield r["value"]


#: The path of findings outside files, and the name of a test suite of findings.
OUTSIDE, SUITE = "(ignore)", "phpstan"
FORMATS = {"raw": raw, "github": github, "checkstyle": checkstyle, "junit": junit, "table": table, "gitlab": gitlab, "json": json_blocks, "prettyJson": json_blocks}
