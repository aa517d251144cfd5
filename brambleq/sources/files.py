"""Source trees as a table: (``path``, ``ord``, ``analyze``, ``stub``, ``source`` as bytes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambleq.operators.scan import demote, exclude, prune_nested

SCHEMA = "path string, ord int, analyze boolean, stub boolean, source binary"
STUB_ORD = 1 << 30


def read_tree(spark: SparkSession, root: str, pattern: str = "*.php") -> DataFrame:
    """(``path``, ``source``) of all files below ``root``; bytes are kept as they are."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split("://", 1)[-1]
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^{base if base.startswith('/') else '/' + base}/", "")
    return raw.select(path.alias("path"), F.col("content").alias("source"))


def number(files: DataFrame) -> DataFrame:
    """Adds the order of paths.  Ranges of paths are sorted apart and counted, so no
    task holds all of them."""
    sorted_ = files.select("path").distinct().repartitionByRange("path").sortWithinPartitions("path").withColumn("__p", F.spark_partition_id())
    w = Window.partitionBy("__p").orderBy("path")
    inside = sorted_.withColumn("__n", F.row_number().over(w))
    sizes = inside.groupBy("__p").agg(F.count("*").alias("__size"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.__p") < F.col("a.__p"), "left").groupBy(F.col("a.__p").alias("__p")).agg(F.coalesce(F.sum("b.__size"), F.lit(0)).alias("__before"))
    return files.join(inside.join(before, "__p").select("path", (F.col("__n") + F.col("__before") - 1).cast("int").alias("ord")), "path")


def discover(spark: SparkSession, paths: list[str], scan_paths: list[str] = (), stubs: list[str] = (), exclude_globs: list[str] = (), scan_only_globs: list[str] = ()) -> DataFrame:
    """All inputs of a run: analysed trees, trees read for symbols only, stub files.
    A path that several sources name is analysed if one of them says so."""
    parts = [read_tree(spark, p).withColumn("analyze", F.lit(True)) for p in paths] + [read_tree(spark, p).withColumn("analyze", F.lit(False)) for p in scan_paths]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("path").agg(F.max("analyze").alias("analyze"), F.first("source").alias("source"))
    found = number(demote(prune_nested(exclude(found, list(exclude_globs))), list(scan_only_globs))).withColumn("stub", F.lit(False))
    for k, s in enumerate(stubs):
        found = found.unionByName(read_tree(spark, s).select("path", "source", F.lit(False).alias("analyze"), F.lit(STUB_ORD + k).alias("ord"), F.lit(True).alias("stub")))
    return found.select("path", "ord", "analyze", "stub", "source")
