"""Exact top-k inner products by no-random-access aggregation.

Vectors are packed into blocks; a block has one list per dimension, sorted by
component.  For a query each list is read from its better end.  After every
round of sequential reads a vector's score lies between its read part plus the
least, and plus the most, that its unread lists can still give; the k-th best lower
bound rises, and vectors whose upper bound falls below it are out.  When few
remain, their scores are resolved exactly.  Blocks give each query their k best,
and these are merged by a grouped limit.

Query blocks meet vector blocks through a join on the vector block's slot, so
memory holds one pair of blocks, whatever the number of queries.

Components are whole numbers of any size that doubles hold.  Where a block's products
may leave 62 bits its scores are resolved in Python's integers instead of by lists; a
score beyond a long is the nearest long.

Defined results: null vectors, vectors with null or non-finite components and
rows with a null id take no part; vectors of different lengths are padded with
zeros; ties go to the smaller id; every row that asks has ranks of its own, and all
rows but itself are its candidates, repeated rows and rows of its id too; an empty
table gives an empty table; only ``vec_id`` and ``embedding`` are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambleq.llm._common import materialise, shuffle_partitions, table

TOP = 10
SCALE = 1024
BLOCK = 4096
_STEP = 64
#: Bits that a score may have for its sum to be exact in a long.
_SAFE = 62


class Lists:
    """The sorted lists of one block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        by = np.argsort(ids, kind="stable")  # then ties in score are ties in position
        self.ids, self.x, self.place = ids[by], x[by], by
        self.most = float(np.abs(self.x).max(initial=0))
        self.order = np.ascontiguousarray(np.argsort(self.x, axis=0, kind="stable").T)  # ascending, a row per dimension
        self.values = np.take_along_axis(self.x.T, self.order, 1)

    def top(self, q: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
        """The k best (score, id) of the block for a query; ``own``: its place in the block, or -1."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        other = self.place != own
        if n <= 4 * k or not dims.size or self.large(q):
            return self._resolve(np.flatnonzero(other), q, k)
        w = q[dims].astype(np.float64)
        down = w > 0  # such lists are read from their largest value
        order = np.where(down[:, None], self.order[dims, ::-1], self.order[dims])
        gives = np.where(down[:, None], self.values[dims, ::-1], self.values[dims]) * w[:, None]
        least = gives[:, -1]
        read = np.zeros(n)  # sums of what has been read
        seen = np.zeros((n, dims.size), dtype=np.float32)
        out = ~other
        at, step = 0, _STEP
        while at < n:
            e = min(n, at + step)
            part = order[:, at:e]
            read += np.bincount(part.ravel(), weights=gives[:, at:e].ravel(), minlength=n)
            seen[part.ravel(), np.repeat(np.arange(dims.size), e - at)] = 1
            at, step = e, max(_STEP, e // 2)
            edge = gives[:, at - 1]
            known = seen @ np.column_stack((edge, least)).astype(np.float32)
            slack = 1e-3 * (1 + np.abs(edge).sum() + np.abs(least).sum())  # for the product's rounding
            upper = read + (edge.sum() - known[:, 0]) + slack
            lower = read + (least.sum() - known[:, 1]) - slack
            lower[out] = -np.inf
            bar = np.partition(lower, n - k)[n - k]
            out |= upper < bar
            left = np.flatnonzero(~out)
            if left.size <= 4 * k:
                return self._resolve(left, q, k)
        return self._resolve(np.flatnonzero(~out), q, k)

    def large(self, q: np.ndarray) -> bool:
        """Whether a score may have more than _SAFE bits."""
        return self.most * float(np.abs(q).max(initial=0)) * max(1, q.size) >= 2.0**_SAFE

    def _resolve(self, at: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        if self.large(q):
            ints = [int(v) for v in q]
            exact = [sum(int(a) * b for a, b in zip(row, ints, strict=True)) for row in self.x[at]]
            s = np.array([max(-(2**63), min(2**63 - 1, v)) for v in exact], dtype=np.int64)
        else:
            s = self.x[at].astype(np.int64) @ q.astype(np.int64)
        best = np.lexsort((self.ids[at], ~s))[:k]  # ~s falls as s rises, at both ends of a long too
        return list(zip(s[best].tolist(), self.ids[at][best].tolist(), strict=True))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (``vec_id``, ``embedding``, ``asks``)."""
    first, seq = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        for s in range(0, b.num_rows, BLOCK):
            part = b.slice(s, BLOCK)
            col = part.column(1).cast(pa.list_(pa.float64()))
            offsets = col.offsets.to_numpy()
            sizes = np.diff(offsets)
            width = int(sizes.max()) if sizes.size else 0
            x = np.zeros((part.num_rows, width))
            x[np.arange(width)[None, :] < sizes[:, None]] = col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            x = np.floor(SCALE * x)
            kind = "<i4" if np.abs(x).max(initial=0) < 2**31 else "<f8"
            asks = np.flatnonzero(np.asarray(part.column(2).fill_null(False))).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([first + seq], pa.int64()), pa.array([width], pa.int32()), pa.array([kind]), pa.array([part.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()), pa.array([x.astype(kind).tobytes()], pa.binary()), pa.array([asks.tobytes()], pa.binary())], names=["block", "width", "kind", "ids", "data", "asks"])
            seq += 1


_BLOCKS = "block long, width int, kind string, ids binary, data binary, asks binary"


def _unpack(width: int, kind: str, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, dtype="<i8")
    return i, np.frombuffer(data, dtype=kind).reshape(len(i), width)


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the rows that ask, with their places."""
    for b in batches:
        for r in b.to_pylist():
            at = np.frombuffer(r["asks"], dtype="<i4")
            if at.size:
                ids, x = _unpack(r["width"], r["kind"], r["ids"], r["data"])
                yield pa.RecordBatch.from_pylist([{"q_block": r["block"], "q_width": r["width"], "q_kind": r["kind"], "q_ids": ids[at].tobytes(), "q_data": np.ascontiguousarray(x[at]).tobytes(), "q_at": r["asks"]}], _ASKING_ARROW)


_ASKING = "q_block long, q_width int, q_kind string, q_ids binary, q_data binary, q_at binary"
_ASKING_ARROW = pa.schema([("q_block", pa.int64()), ("q_width", pa.int32()), ("q_kind", pa.string()), ("q_ids", pa.binary()), ("q_data", pa.binary()), ("q_at", pa.binary())])


def _pad(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lists = None, None
        for b in batches:
            rows = b.to_pydict()
            for i in range(b.num_rows):
                q_ids, q = _unpack(rows["q_width"][i], rows["q_kind"][i], rows["q_ids"][i], rows["q_data"][i])
                at = np.frombuffer(rows["q_at"][i], dtype="<i4").tolist()
                width = max(q.shape[1], rows["width"][i])
                if held != (rows["block"][i], width):
                    ids, x = _unpack(rows["width"][i], rows["kind"][i], rows["ids"][i], rows["data"][i])
                    held, lists = (rows["block"][i], width), Lists(ids, _pad(x, width))
                q = _pad(q, width)
                here = rows["q_block"][i] == rows["block"][i]
                got = [(rows["q_block"][i], p, own, v, s) for own, p, row in zip(q_ids.tolist(), at, q, strict=True) for s, v in lists.top(row, k, p if here else -1)]
                yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], pa.int64()) for j in range(5)], names=["q_block", "q_at", "query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, asks: Column) -> DataFrame:
    """(``vec_id``, ``embedding`` as doubles, ``asks``) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), asks.alias("asks"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)


def search(vectors: DataFrame, asks: Column, k: int = TOP) -> DataFrame:
    """(``query_id``, ``rank`` from 1, ``vec_id``, ``score``): for each row of ``vectors`` (``vec_id``,
    ``embedding``) that ``asks``, a boolean column, the k best of all other rows."""
    blocks = materialise(usable(vectors, asks).mapInArrow(_pack, _BLOCKS))
    queries = blocks.mapInArrow(_asking, _ASKING)
    # every query block once for each slot of vector blocks
    slots = max(1, min(blocks.count(), 4 * shuffle_partitions(vectors.sparkSession)))
    placed = blocks.drop("asks").withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)))
    dealt = queries.withColumn("slot", F.explode(F.expr(f"sequence(0L, {slots - 1}L)")))
    best = placed.join(dealt, "slot").drop("slot").mapInArrow(_meet(k), "q_block long, q_at long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q_block", "q_at").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (SELECT q.vec_id AS query_id, q.n, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v AS q JOIN v ON q.n <> v.n WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) <= 10
"""
