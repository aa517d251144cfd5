"""Command line: ``python -m brambleq [paths] [-c FILE] [-l LEVEL] ...``

Exit codes: 0 nothing found, 1 findings, 2 wrong use.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from brambleq.operators import findings as fnd
    from brambleq.operators import reports
    from brambleq.php.rules_local import Options
    from brambleq.plans import analysis, fixing
    from brambleq.sources import config as cfg
    from brambleq.sources import files as src

    p = argparse.ArgumentParser(prog="brambleq")
    p.add_argument("paths", nargs="*")
    p.add_argument("-c", "--configuration")
    p.add_argument("-l", "--level")
    p.add_argument("--error-format", default=None, choices=[*reports.FORMATS])
    p.add_argument("-b", "--generate-baseline", nargs="?", const="baseline.neon")
    p.add_argument("--allow-empty-baseline", action="store_true")
    p.add_argument("--fix", action="store_true")
    p.add_argument("--no-infer-untyped", action="store_true", help="do not type what declarations leave out")
    p.add_argument("--manifest", action="store_true", help="list the rules by level and name")
    a = p.parse_args(argv)
    if a.manifest:
        for level, name in analysis.manifest():
            print(level, name)
        return 0
    if a.fix and a.generate_baseline:
        print("--fix and --generate-baseline exclude each other", file=sys.stderr)
        return 2
    c = cfg.read(open(a.configuration, encoding="utf-8").read()) if a.configuration else cfg.Config()
    for w in c.warnings:
        print(w, file=sys.stderr)
    if a.level is not None:
        c.level = 10 if a.level == "max" else int(a.level)
    paths = a.paths or c.paths
    if not paths:
        print("no paths", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("brambleq").getOrCreate()
    files = src.discover(spark, [os.path.abspath(x) for x in paths], c.scanDirectories, c.stubFiles, c.excludePaths, c.analyseOnlyExcludes)
    options = Options(level=c.level, php=c.phpVersion)
    if a.fix:
        before = files.select("path", F.sha2("source", 256).alias("before"), F.col("source").alias("old"))
        from brambleq.operators.repairs import write_back

        fixed = fixing.fix(files, options).join(before, "path").withColumn("changed", F.col("source") != F.col("old"))
        for path in paths:
            write_back(fixed, os.path.abspath(path)).count()
        files = fixed.select(*files.columns)
    entries = cfg.ignores(c.ignoreErrors)
    ig = spark.createDataFrame(entries, "ord int, path string, message string, identifier string, count long") if entries else None
    found = analysis.Run(files, options, infer=0 if a.no_infer_untyped else analysis.INFER_ROUNDS).report(ig).cache()
    if a.generate_baseline:
        rows = [tuple(r) for r in fnd.build_baseline(found).select("path", "message", "identifier", "count").toLocalIterator()]
        if not rows and not a.allow_empty_baseline:
            print("nothing to put in a baseline", file=sys.stderr)
            return 1
        with open(a.generate_baseline, "w", encoding="utf-8") as f:
            f.write(cfg.write_baseline(rows, a.generate_baseline.endswith(".neon")))
        return 0
    fmt = a.error_format or c.errorFormat
    for line in reports.document(fmt, found):
        print(line)
    return int(not found.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
