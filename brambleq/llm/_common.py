"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent, a temporary folder serves, but only for a
    session whose driver and executors are one process on one machine.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        master = conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="brambleq-")
    return f"{base.rstrip('/')}/brambleq-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> None:
    """Let a folder go when the driver's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Of a query that is run here the shuffle files go when it ends; else they stay until the
    driver's JVM happens to collect its garbage, and those of many rounds add up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage
    ends here, and a lost executor costs a re-read instead of a recomputation.
    The files go at the session's end, or with ``discard``."""
    spark = df.sparkSession
    path = work_dir(spark)
    with no_shuffles_left(spark):
        df.write.options(**options).parquet(path)
    passing(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that no plan needs any more."""
    path = getattr(df, "_written_at", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers live on from stage to stage,
    and what they only keep for later counts with what the others need."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


#: Bytes of rows that ``bound_batches`` lets into one Arrow batch (a larger row is a batch of its own).
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From here on this session's rows go to Python workers ``most`` bytes at a time, or fewer where
    that is set.  Spark's own bounds (10,000 rows, or many times these bytes) let a batch of whole texts
    or blocks grow to tens of MB, and an executor's JVM keeps what its batches have once taken."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= most:
        spark.conf.set(name, str(most))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 byte strings; null becomes empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def quoted(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(taken: list[str], name: str) -> str:
    """``name``, or if a column has it (in any case) the name behind more underscores."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def give_way(docs: DataFrame, *outputs: str) -> DataFrame:
    """``docs`` with its columns that have the name of an output renamed to ``<name>_input``
    (with more underscores before it where that is taken too): outputs keep their names,
    and nothing is lost."""
    wanted = {o.lower() for o in outputs}
    taken = [*docs.columns, *outputs]
    names = []
    for c in docs.columns:
        if c.lower() in wanted:
            c = free_name(taken, f"{c}_input")
            taken.append(c)
        names.append(c)
    return docs if names == docs.columns else docs.toDF(*names)


def aside(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` with every column but the needed ones under a name of our own, so that an
    operator's private columns clash with none; ``back`` restores the names."""
    return docs.toDF(*[c if c in needed else f"__other_{i}" for i, c in enumerate(docs.columns)])


def back(out: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of ``docs`` out of what an operator made of ``aside(docs, *needed)``."""
    return out.select(*[c if c in needed else f"__other_{i}" for i, c in enumerate(docs.columns)]).toDF(*docs.columns)


def extend(docs: DataFrame, run, fields: list, *needed: str) -> DataFrame:
    """``docs`` (its clashing names given way already) plus the columns that ``run`` appends to
    its Arrow batches, in which only the needed columns keep their names."""
    held = aside(docs, *needed)
    return held.mapInArrow(run, T.StructType([*held.schema.fields, *fields])).toDF(*docs.columns, *[f.name for f in fields])
