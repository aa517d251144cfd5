"""Repairs that follow from findings, repeated until a round changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambleq.operators import repairs
from brambleq.operators._tables import written
from brambleq.php.rules_local import Options
from brambleq.plans.analysis import Run

ROUNDS = 5


def edits(run: Run, files: DataFrame) -> DataFrame:
    """(``path``, ``start``, ``end``, ``text``, ``tag``) of the findings that have a repair:
    an unused capture goes from its list, a deprecated cast takes its short name."""
    text = files.select("path", F.decode("source", "ISO-8859-1").alias("t"))
    f = run.relation("finding").join(text, "path")
    rest = F.expr("substring(t, start + 1)")
    cast = f.where("key = 'cast.deprecated'")
    short = F.regexp_extract("name", r"Use \((\w+)\) instead", 1)
    length = F.length(F.regexp_extract(rest, r"^\(\s*\w+\s*\)", 0))
    casts = cast.select("path", "start", (F.col("start") + length).alias("end"), F.concat(F.lit("("), short, F.lit(")")).alias("text"), F.lit(None).cast("string").alias("tag"))
    before = F.expr("substring(t, 1, start)")
    # captures of one list share their commas: one of them goes in a round
    opened = F.length(F.regexp_extract(before, r"(?s)^(.*\buse\s*\()", 1))
    first = Window.partitionBy("path", "__list").orderBy("start")
    use = f.where("key = 'closure.unusedUse'").withColumn("__list", opened).withColumn("__k", F.row_number().over(first)).where("__k = 1")
    item = F.regexp_extract(rest, r"^&?\$\w+", 0)
    comma_after = F.regexp_extract(rest, r"^&?\$\w+(\s*,\s*)", 1)
    comma_before = F.regexp_extract(before, r"(\s*,\s*)$", 1)
    whole = F.regexp_extract(before, r"(\s*use\s*\(\s*)$", 1)
    close = F.regexp_extract(rest, r"^&?\$\w+(\s*,?\s*\))", 1)
    alone = (whole != "") & (close != "")
    start = F.when(alone, F.col("start") - F.length(whole)).when(comma_before != "", F.col("start") - F.length(comma_before)).otherwise(F.col("start"))
    end = F.col("start") + F.length(item) + F.when(alone, F.length(close)).when(comma_before == "", F.length(comma_after)).otherwise(0)
    uses = use.select("path", start.alias("start"), end.alias("end"), F.lit("").alias("text"), F.lit(None).cast("string").alias("tag"))
    return casts.unionByName(uses)


def fix(files: DataFrame, options: Options, rounds: int = ROUNDS) -> DataFrame:
    """``files`` after at most ``rounds`` rounds of repairs."""
    now = written(files)
    for _ in range(rounds):
        e = written(repairs.applicable(repairs.mergeable(edits(Run(now, options), now))))
        if e.isEmpty():
            break
        done = repairs.apply(now, e).select("path", "source")
        now = written(now.drop("source").join(done, "path").select(*now.columns))
    return now
