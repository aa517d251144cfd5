"""The symbol index: keyed aggregation of declarations, and joins of references with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(decls: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the declaration that comes first by ``order``.  A partial
    aggregate, so a key of any number of declarations costs a row per task."""
    rest = [c for c in decls.columns if c not in {key, *order}]
    best = decls.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("__d"))
    return best.select(*[F.col(c) if c == key else F.col(f"__d.{c}").alias(c) for c in decls.columns])


def precedence(origin: Column, order: Column) -> Column:
    """Rank of a declaration's origin: the last stub, then the first project file, then builtins."""
    rank = F.when(origin == "stub", 0).when(origin.isin("project", "scan"), 1).otherwise(2)
    return F.struct(rank.alias("rank"), F.when(origin == "stub", -order).otherwise(order).alias("ord"))


def index(decls: DataFrame) -> DataFrame:
    """The winning declaration per (``kind``, ``key``): scan-only rows give way to builtins."""
    builtin = decls.where("origin = 'builtin'").select("kind", "key").distinct()
    rest = decls.where("origin = 'scan'").join(builtin, ["kind", "key"], "left_anti").unionByName(decls.where("origin <> 'scan'"))
    ranked = rest.withColumn("__rank", precedence(F.col("origin"), F.col("ord")))
    columns = [c for c in decls.columns if c not in ("kind", "key")]
    return ranked.groupBy("kind", "key").agg(F.min(F.struct("__rank", *columns)).alias("d")).select("kind", "key", *[F.col(f"d.{c}").alias(c) for c in columns])


def add_aliases(symbols: DataFrame, aliases: DataFrame, key: str = "key") -> DataFrame:
    """Insert where absent."""
    return symbols.unionByName(aliases.join(symbols.select(key), key, "left_anti"))


def redeclared(decls: DataFrame, key: str, source: str, order: str) -> DataFrame:
    """Keys with several sources, and these in order, comma-joined."""
    return decls.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(source).alias("s")))), lambda x: x["s"].cast("string")), ",").alias("sources")).where("n > 1")


def unresolved(refs: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """References without a declaration."""
    return refs.join(symbols.select(key).distinct(), key, "left_anti")


def unresolved_with_fallback(refs: DataFrame, symbols: DataFrame, key: str, fallback: str, symbol_key: str = "key") -> DataFrame:
    """References of which neither the first nor the second candidate is declared."""
    known = symbols.select(F.col(symbol_key).alias("__k")).where("__k is not null").distinct()
    return refs.join(known, F.col(key) == F.col("__k"), "left_anti").join(known, F.col(fallback) == F.col("__k"), "left_anti")
