"""Edits of source text: grouped by anchor, tested for collisions, applied from the back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambleq.operators.changes import overlapping

#: Order of docblock tags at one anchor.
TAG_ORDER = {"param": 0, "return": 1, "var": 2}


def mergeable(edits: DataFrame) -> DataFrame:
    """Edits (``path``, ``start``, ``end``, ``text``, ``tag``): equal ones once, tag lines of one anchor joined in tag order."""
    rank = F.when(F.col("tag") == "param", 0).when(F.col("tag") == "return", 1).when(F.col("tag") == "var", 2).otherwise(3)
    once = edits.withColumn("__r", rank).dropDuplicates(["path", "start", "end", "text", "tag"])
    tags = once.where("tag is not null").groupBy("path", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "text"))), lambda x: x["text"]), "").alias("text"))
    return tags.unionByName(once.where("tag is null").select("path", "start", "end", "text"))


def applicable(edits: DataFrame) -> DataFrame:
    """Edits of files in which none collide; a file with a collision is left alone."""
    bad = overlapping(edits, ["path"], []).select("path").distinct()
    return edits.join(bad, "path", "left_anti")


def apply(files: DataFrame, edits: DataFrame) -> DataFrame:
    """``files`` (``path``, ``source``) after their edits, with ``changed``.  One file's
    edits meet it in a grouped join; positions are bytes."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(zip(right.column("start").to_pylist(), right.column("end").to_pylist(), right.column("text").to_pylist(), strict=True), reverse=True)
        out, changed = [], []
        for source in left.column("source").to_pylist():
            b = bytes(source or b"")
            for s, e, text in rows:
                b = b[:s] + text.encode() + b[e:]
            out.append(b)
            changed.append(bool(rows))
        return pa.table({"path": left.column("path"), "source": pa.array(out, pa.binary()), "changed": pa.array(changed, pa.bool_())})

    e = edits.select("path", "start", "end", "text")
    return files.select("path", F.col("source").cast("binary").alias("source")).groupBy("path").cogroup(e.groupBy("path")).applyInArrow(one, "path string, source binary, changed boolean").where("path is not null")


def write_back(fixed: DataFrame, root: str, seen: dict[str, str] | None = None) -> DataFrame:
    """Write changed files below ``root`` of a folder all executors share.  A file whose
    bytes on disk are not those analysed (``before`` hash) is skipped.  Returns (path, written)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for b in batches:
            done = []
            for path, source, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                at = os.path.join(root, path)
                with open(at, "rb") as f:
                    same = hashlib.sha256(f.read()).hexdigest() == before
                if same:
                    with open(at + ".tmp", "wb") as f:
                        f.write(source)
                    os.replace(at + ".tmp", at)
                done.append(same)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done)], names=["path", "written"])

    return fixed.where("changed").select("path", "source", "before").mapInArrow(run, "path string, written boolean")
