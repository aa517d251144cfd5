"""Inputs of a run: paths from several sources, their flags and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambleq.functions.text import byte_column, lines, matches_any


def merge_inputs(*sources: DataFrame) -> DataFrame:
    """(``path``, ``analyze``): each path once; analysed if any source says so."""
    return reduce(DataFrame.unionByName, [s.select("path", "analyze") for s in sources]).groupBy("path").agg(F.max("analyze").alias("analyze"))


def exclude(files: DataFrame, patterns: list[str]) -> DataFrame:
    return files.where(~matches_any(F.col("path"), patterns))


def demote(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Paths that are only read for their symbols."""
    return files.withColumn("analyze", F.col("analyze") & ~matches_any(F.col("path"), patterns))


def prune_nested(files: DataFrame, folder: str = "vendor") -> DataFrame:
    """Without a folder of that name below another of that name."""
    return files.where(~F.col("path").rlike(rf"(^|/){folder}/(.*/)?{folder}/"))


def line_index(files: DataFrame, text: str = "source") -> DataFrame:
    """Per file: number of lines, and bytes of the longest."""
    ls = lines(F.col(text))
    return files.select("path", F.size(ls).cast("long").alias("n_lines"), F.array_max(F.transform(ls, lambda x: F.octet_length(x))).cast("long").alias("longest"))


def explode_lines(files: DataFrame, text: str = "source") -> DataFrame:
    return files.select("path", F.posexplode(lines(F.col(text))).alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), "text")


def pattern_findings(files: DataFrame, needle: str, identifier: str, message: str, text: str = "source") -> DataFrame:
    """A finding at the first occurrence of ``needle`` on each line."""
    hit = files.where(F.col(text).contains(needle))  # before lines are made
    return explode_lines(hit, text).where(F.col("text").contains(needle)).select("path", "line", byte_column(F.col("text"), needle).alias("column"), F.lit(identifier).alias("identifier"), F.lit(message).alias("message"))
