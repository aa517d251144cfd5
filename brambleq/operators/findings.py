"""Rules that are plain relations, and findings' suppression, baseline and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambleq.operators._tables import written


def duplicate_keys(items: DataFrame, group: list[str]) -> DataFrame:
    """Groups that hold an item more than once, with its number."""
    return items.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1")


def missing_arms(seen: DataFrame, group: str, arm: str, expected: list[str]) -> DataFrame:
    """(group, arm) pairs of ``expected`` cases that the group has no arm for."""
    have = seen.where(F.col(arm).isin(*expected)).groupBy(group).agg(F.collect_set(arm).alias("__have"))
    every = seen.select(group).distinct().join(have, group, "left")
    return every.select(group, F.explode(F.array_except(F.array(*[F.lit(e) for e in expected]), F.coalesce("__have", F.array().cast("array<string>")))).alias(arm))


def unused(members: DataFrame, uses: DataFrame, key: list[str]) -> DataFrame:
    return members.join(uses.select(*key).distinct(), key, "left_anti")


def evidence(calls: DataFrame, target: str, position: str, value: str, order: list[str]) -> DataFrame:
    """Distinct observed values per call target and position, in order of first sight, ``|``-joined."""
    first = calls.groupBy(target, position, value).agg(F.min(F.struct(*order)).alias("__at"))
    listed = F.array_sort(F.collect_list(F.struct("__at", F.col(value).cast("string").alias("__v"))))
    return first.groupBy(target, position).agg(F.array_join(F.transform(listed, lambda s: s["__v"]), "|").alias("types"))


def anchored(message: Column) -> Column:
    """A message as an anchored pattern, as baselines keep it."""
    return F.concat(F.lit("^"), F.regexp_replace(message, r"([.\\+*?\[^\]$(){}=!<>|:\-#/])", r"\\$1"), F.lit("$"))


def build_baseline(findings: DataFrame) -> DataFrame:
    """(``path``, ``message``, ``identifier``, ``count``), the message as an anchored pattern."""
    return findings.groupBy("path", "message", "identifier").agg(F.count("*").alias("count")).withColumn("message", anchored(F.col("message")))


def apply_counts(findings: DataFrame, entries: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Findings beyond what each entry's ``count`` (null: any number) takes, in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    e = entries.select(*key, F.col("count").alias("__n"), F.lit(True).alias("__e"))
    j = findings.withColumn("__rn", F.row_number().over(w)).join(e, key, "left")
    return j.where(F.col("__e").isNull() | (F.col("__rn") > F.col("__n"))).drop("__rn", "__n", "__e")


def settle(pairs: DataFrame) -> DataFrame:
    """(``fid``, ``entry``): the entry that takes each finding, of ``pairs`` (``fid``, ``at``: the finding's
    place in order, ``entry``, ``n``: how many the entry takes, null for any number).

    Findings come in order, and each goes to its first entry that is not full.  That is the only
    stable outcome where every entry prefers earlier findings, so it is reached by proposals: a
    finding that an entry's earlier ones crowd out goes on to its next entry, until none does."""
    pairs = written(pairs.withColumn("k", F.row_number().over(Window.partitionBy("fid").orderBy("entry"))))
    tried = pairs.where("k = 1").select("fid", "k")
    while True:
        place = F.row_number().over(Window.partitionBy("entry").orderBy("at", "fid"))
        # a finding without a next entry is taken by none
        asked = written(pairs.join(tried, ["fid", "k"]).withColumn("full", F.coalesce(place > F.col("n"), F.lit(False))))
        if asked.where("full").isEmpty():
            return asked.select("fid", "entry")
        tried = asked.select("fid", F.when(F.col("full"), F.col("k") + 1).otherwise(F.col("k")).alias("k"))


def unmatched(entries: DataFrame, findings: DataFrame, key: list[str]) -> DataFrame:
    """Entries with fewer matches than expected, and both numbers."""
    got = findings.groupBy(*key).agg(F.count("*").alias("__got"))
    return entries.join(got, key, "left").select(*entries.columns, F.coalesce("__got", F.lit(0)).alias("matched")).where(F.col("matched") < F.coalesce("count", F.lit(1)))


def unmarked(findings: DataFrame, markers: DataFrame) -> DataFrame:
    """Findings on no marked line; ``markers``: (``path``, ``line``, ``identifiers`` or null for all)."""
    f = findings.withColumn("__i", F.col("identifier"))
    m = markers.select(F.col("path").alias("__p"), F.col("line").alias("__l"), F.col("identifiers").alias("__ids"))
    hit = (F.col("path") == F.col("__p")) & (F.col("line") == F.col("__l")) & (F.col("__ids").isNull() | F.array_contains("__ids", F.col("__i")))
    return f.join(m, hit, "left_anti").drop("__i")
