"""Connected components of a graph that no machine could hold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambleq.llm._common import discard, materialise

#: Edges that one task joins in its memory; those of a larger graph go over all tasks in rounds.
FEW = 1 << 17


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of all these edges, and the smallest node of its component."""
    up: dict = {}
    kind = None

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            u, v = find(u), find(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([find(x) for x in up], kind)], names=["node", "root"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(``node``, ``root``): the smallest node of each component, from edges ``u``, ``v``.

    Alternating stars: each round hangs every node's larger neighbours on its
    smallest neighbour, then its smaller ones and itself; the edges end as stars
    around the roots after a number of rounds logarithmic in the size of the
    largest component.  Each round is written out; a node of any degree is an
    aggregate and one side of a join, never a collected list.  At most ``FEW`` edges
    are one task's work instead, as rounds over all tasks would cost many times that
    in small files and in time.
    """
    given = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    if given.count() <= FEW:
        kind = given.schema["u"].dataType.simpleString()
        out = materialise(given.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"))
        discard(given)
        return out
    now = materialise(given.distinct())
    discard(given)
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v")))
        old, now = now, materialise(small.distinct())
        discard(old)
    raise RuntimeError("components did not settle")
