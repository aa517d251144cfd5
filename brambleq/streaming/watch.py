"""Watching a tree: files arrive as a stream, batches keep snapshots and re-analyse what a change touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambleq.operators import changes
from brambleq.operators._tables import written
from brambleq.php.rules_local import Options
from brambleq.plans.analysis import Run


class Session:
    """Findings of the last pass, and what each file's findings rest on."""

    def __init__(self, options: Options = Options()) -> None:
        self.options = options
        self.files: DataFrame | None = None
        self.report: DataFrame | None = None
        self.rows: DataFrame | None = None
        #: Files that the last pass parsed.
        self.parsed: DataFrame | None = None
        self.declared: DataFrame | None = None
        self.used: DataFrame | None = None
        #: Files that the last pass worked again.
        self.touched: DataFrame | None = None

    def update(self, files: DataFrame) -> DataFrame:
        """A full pass the first time; later the findings of files that a change can
        reach are replaced and the others kept.  Equal to a fresh run."""
        hashed = files.withColumn("hash", F.sha2("source", 256))
        rows = None
        self.parsed = files.select("path")
        if self.rows is not None:
            # only what is new or differs is parsed; the rows of all other files stand
            same = written(hashed.select("path", "hash", "ord", "analyze").join(self.files, ["path", "hash", "ord", "analyze"], "left_semi").select("path"))
            rows = self.rows.join(same, "path", "left_semi")
            self.parsed = files.select("path").join(same, "path", "left_anti")
        run = Run(files, self.options, rows=rows, parse=None if rows is None else self.parsed)
        declared = written(run.rows.where("rel in ('decl', 'edge', 'member')").select("path", "key", F.coalesce("owner", "key").alias("symbol"), F.sha2(F.to_json(F.struct("rel", "name", "key", "owner", "res", "alt", F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>"))))), 256).alias("shape")))
        used = written(run.rows.where("rel in ('ref', 'access')").select("path", F.explode(F.array_compact(F.array(F.coalesce("owner", "key"), "alt"))).alias("symbol")).union(run.rows.where("rel in ('edge', 'decl')").select("path", "key")).distinct())
        if self.report is None:
            out = written(run.report())
            self.touched = files.select("path")
        else:
            diff = written(changes.snapshot_diff(self.files.select("path", "hash"), hashed.select("path", "hash")).select("path").union(self.parsed))
            moved = self._moved(declared)
            # what stands below a changed class rests on it too
            below = run.closure.join(moved, F.col("ancestor") == F.col("symbol")).select(F.col("node").alias("symbol"))
            reach = moved.union(below).distinct()
            again = written(diff.select("path").union(used.join(reach, "symbol", "left_semi").select("path")).union(declared.join(reach, "symbol", "left_semi").select("path")).distinct())
            gone = files.select("path")
            kept = self.report.join(again, "path", "left_anti").join(gone, "path", "left_semi")
            run.only = again
            fresh = run.report().join(again, "path", "left_semi")
            out = written(kept.unionByName(fresh))
            self.touched = again
        self.files, self.report, self.declared, self.used, self.rows = written(hashed.select("path", "hash", "ord", "analyze")), out, declared, used, run.rows
        return out

    def _moved(self, now: DataFrame) -> DataFrame:
        """Symbols whose declarations differ between passes, whether gone, new or changed."""
        a = self.declared.groupBy("symbol").agg(F.sort_array(F.collect_list("shape")).alias("hash"))
        b = now.groupBy("symbol").agg(F.sort_array(F.collect_list("shape")).alias("hash"))
        return changes.snapshot_diff(a, b, key="symbol").select("symbol")


def arrivals(spark: SparkSession, root: str, pattern: str = "*.php") -> DataFrame:
    """A stream of the files below ``root`` as they are written: (``path``, ``modified``, ``source``)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return raw.select("path", F.col("modificationTime").alias("modified"), F.col("content").alias("source"))


def watch(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "250 milliseconds"):
    """Start a query that hands each burst of changes to ``each``; ``delay`` debounces."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=delay).start()


def sessions(stream: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of events per key (``key``, ``ts``) with a watermark for late ones."""
    return stream.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("first"), F.col("w.end").alias("closed"), "n")
