"""Differences between snapshots, what they invalidate, and edits that collide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(``key``, ``change``): added, removed or changed."""
    a, b = old.select(key, F.col(value).alias("__a"), F.lit(1).alias("__o")), new.select(key, F.col(value).alias("__b"), F.lit(1).alias("__n"))
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def invalidated(files: DataFrame, *reasons: tuple[DataFrame, str, DataFrame, str]) -> DataFrame:
    """Keys of ``files`` to work again.  A reason is (dependencies, dependency column,
    changed symbols, symbol column); dependencies hold the files' key."""
    key = files.columns[0]
    parts = [deps.join(changed.select(F.col(sym).alias(dep)).distinct(), dep, "left_semi").select(key) for deps, dep, changed, sym in reasons]
    return reduce(DataFrame.union, parts).distinct()


def overlapping(edits: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Edits (``start``, ``end``) that begin before the end of one before them in their group."""
    w = Window.partitionBy(*group).orderBy("start", *order, "end").rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("__end", F.max("end").over(w)).withColumn("__start", F.max("start").over(w)).where((F.col("__end") > F.col("start")) | (F.col("__start") == F.col("start"))).drop("__end", "__start")


def debounced(changes: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    """Bursts of changes: a gap of that length or more ends one."""
    return changes.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")).drop("w")
