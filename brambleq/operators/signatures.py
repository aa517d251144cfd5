"""Whole-project signature inference: evidence flows along calls until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambleq.operators._tables import written

ROUNDS = 3


def propagate(known: DataFrame, calls: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(``node``, ``types``: sorted distinct types, ``|``-joined) after ``rounds`` of flow.
    ``known`` is (``node``, ``type``); a call (``src``, ``dst``) hands the types of ``src`` to ``dst``."""
    now = written(known.select("node", "type").distinct())
    size = now.count()
    for _ in range(rounds):
        moved = now.join(calls, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "type")
        now = written(now.union(moved).distinct())
        before, size = size, now.count()
        if size == before:
            break
    return now.groupBy("node").agg(F.array_join(F.sort_array(F.collect_set("type")), "|").alias("types"))
