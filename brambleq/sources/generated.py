"""Programs written from rows: one construct per line, so that what a run must find
is itself a query over the rows.  Text is made by Spark, in as many files as asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def program(rows: DataFrame, path: Column, order: list[str], line: Column, analyze: bool = True, head: str = "<?php", tail: str = "") -> DataFrame:
    """Files (``path``, ``ord``, ``analyze``, ``stub``, ``source``): after the first line, one line per row in order."""
    parts = rows.select(path.alias("path"), F.struct(*order, line.alias("line")).alias("s")).groupBy("path").agg(F.array_sort(F.collect_list("s")).alias("s"))
    text = F.concat_ws("\n", F.lit(head), F.array_join(F.transform("s", lambda x: x["line"]), "\n"), F.lit(tail))
    return parts.select("path", F.abs(F.hash("path")).alias("ord"), F.lit(analyze).alias("analyze"), F.lit(False).alias("stub"), F.encode(text, "UTF-8").alias("source"))
