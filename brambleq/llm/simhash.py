"""SimHash near-duplicates by a byte-position index with count filtering.

A 64-bit fingerprint is eight bytes at eight positions.  Fingerprints that
differ in at most three bits differ in at most three bytes, so they share at
least five bytes at their positions: the guaranteed minimum.  Of the first m + 3
positions such a pair shares m at least, so the index has a posting for every m
of these positions and their bytes; m is 3 as long as that leaves about one
fingerprint to a posting, and grows with their number (every m loses no link).
In a posting the shared positional bytes of each pair are tallied over all eight
positions; pairs that reach the minimum are retained, of all postings that such a
pair shares the first one keeps it, and it is verified by its differing bits.

Copies with one fingerprint are one entry of the index.  A large posting is
divided by further bytes, as long as pairs still owe shared bytes to the minimum;
what remains is worked in tiles.  It yields a spanning forest of its links, at most
one link per entry, not all pairs.  Components join the links; nothing is gathered
on the driver.

Defined results: a text without words, and a null text, has fingerprint zero and
is linked like any other; texts of fewer words than a shingle are one shingle;
a null id is in a component but never names it (null where it is alone); equal
rows share a component; an empty table gives an empty table; ``deduplicate`` carries
columns of any name along, the others read ``doc_id`` and ``text`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brambleq.llm._blocks import BUCKETS_A_PARTITION, by_bucket
from brambleq.llm._common import extend, give_way, materialise, shuffle_partitions, table, text_bytes
from brambleq.llm._graph import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Bytes of eight that fingerprints within MAX_BITS share at least.
MIN_SHARED = 8 - MAX_BITS
#: Entries of the index that one bucket holds, about.
BUCKET_ENTRIES = 2_000_000
#: Side of the squares in which a posting's entries are compared.
_TILE = 1024
#: Entries beyond which a posting is divided by a further byte.
_LARGE = 4096


def width(n: int) -> int:
    """Bytes of a posting for so many fingerprints."""
    return next((m for m in range(MIN_SHARED - 2, MIN_SHARED) if n <= 256**m), MIN_SHARED)


def _postings(m: int) -> list[tuple[int, ...]]:
    return list(combinations(range(m + MAX_BITS), m))


def _masks(m: int) -> np.ndarray:
    return np.array([sum(0xFF << (8 * p) for p in c) for c in _postings(m)], dtype=np.uint64)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the runs of ``shingle`` words, in order; fewer words are one run."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return of_hashes(shingles(text, shingle))


def of_hashes(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n = h.size
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        part = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, out: str = "__fp") -> DataFrame:
    """``docs`` plus the fingerprint, as the long of the same 64 bits."""
    docs = give_way(docs, out)
    k = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in text_bytes(b.column(k))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], names=[*b.schema.names, out])

    return extend(docs, run, [T.StructField(out, T.LongType())], "text")


def _deal(buckets: int, m: int):
    """Each fingerprint's postings, to the buckets of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks(m)
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            to, which, what = [], [], []
            for i, mask in enumerate(masks):
                key = (fps & mask) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i * 0x632BE59BD9B4E019 % 2**64)
                key ^= key >> np.uint64(32)
                to.append(((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(buckets))
                which.append(np.full(fps.size, i, dtype=np.uint8))
                what.append(fps)
            to, which, what = np.concatenate(to), np.concatenate(which), np.concatenate(what)
            order = np.argsort(to, kind="stable")
            to, which, what = to[order], which[order], what[order]
            cuts = np.flatnonzero(np.diff(to, prepend=to[:1] + np.uint64(1)))
            ends = np.append(cuts[1:], to.size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[cuts].astype(np.int32)), pa.array([which[s:e].tobytes() for s, e in zip(cuts, ends, strict=True)], pa.binary()), pa.array([what[s:e].tobytes() for s, e in zip(cuts, ends, strict=True)], pa.binary())],
                names=["bucket", "which", "fps"],
            )

    return run


def _tally(diff: np.ndarray) -> np.ndarray:
    """Positional bytes that XORed pairs share."""
    t = diff | diff >> np.uint64(4)
    t |= t >> np.uint64(2)
    t |= t >> np.uint64(1)
    return 8 - np.bitwise_count(t & np.uint64(0x0101010101010101))


def _first(m: int) -> np.ndarray:
    """By the set of shared positions, the first posting that a pair is in; -1 for none."""
    return np.array([next((i for i, c in enumerate(_postings(m)) if all(b >> p & 1 for p in c)), -1) for b in range(256)], dtype=np.int64)


def _first_shared(diff: np.ndarray, first: np.ndarray) -> np.ndarray:
    shared = diff.view(np.uint8).reshape(-1, 8) == 0
    return first[(shared << np.arange(8)).sum(axis=1)]


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _pairs(fps: np.ndarray, at: np.ndarray, left: tuple[int, ...], owed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries ``at`` that reach the minimum, by tiles; of the positions ``left`` they share
    ``owed`` at least, so the first that a pair shares leaves so many behind it."""
    if owed and at.size > _LARGE:
        for j in range(len(left) - owed + 1):
            byte = (fps[at] >> np.uint64(8 * left[j])) & np.uint64(0xFF)
            order = np.argsort(byte, kind="stable")
            for part in np.split(at[order], np.flatnonzero(np.diff(byte[order])) + 1):
                if part.size > 1:
                    yield from _pairs(fps, part, left[j + 1 :], owed - 1)
        return
    for i in range(0, at.size, _TILE):
        for j in range(i, at.size, _TILE):
            a, b = np.nonzero(_tally(fps[at[i : i + _TILE], None] ^ fps[None, at[j : j + _TILE]]) >= MIN_SHARED)
            a, b = at[a + i], at[b + j]
            fore = a < b
            yield a[fore], b[fore]


def _posting_links(fps: np.ndarray, which: int, m: int, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links that this posting is the first to hold."""
    forest = Forest(fps.size)
    left = tuple(p for p in range(8) if p not in _postings(m)[which])
    for a, b in _pairs(fps, np.arange(fps.size), left, MIN_SHARED - m):
        diff = fps[a] ^ fps[b]
        link = (np.bitwise_count(diff) <= MAX_BITS) & (_first_shared(diff, first) == which)
        for x, y in zip(a[link].tolist(), b[link].tolist(), strict=True):
            if forest.join(x, y):
                yield x, y


def _links(m: int):
    def run(t: pa.Table) -> pa.Table:
        masks, first = _masks(m), _first(m)
        which = np.frombuffer(b"".join(t.column("which").to_pylist()), dtype=np.uint8)
        fps = np.frombuffer(b"".join(t.column("fps").to_pylist()), dtype=np.uint64)
        key = fps & masks[which]
        order = np.lexsort((fps, key, which))
        which, fps, key = which[order], fps[order], key[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (which[1:] != which[:-1]))) if fps.size else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], fps.size)
        size = ends - starts
        us, vs = [], []
        # postings of two, nearly all, at once
        two = starts[size == 2]
        diff = fps[two] ^ fps[two + 1] if two.size else two.astype(np.uint64)
        kept = two[(_tally(diff) >= MIN_SHARED) & (np.bitwise_count(diff) <= MAX_BITS) & (_first_shared(diff, first) == which[two])]
        us += fps[kept].tolist()
        vs += fps[kept + 1].tolist()
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            part = fps[s:e]
            for x, y in _posting_links(part, int(which[s]), m, first):
                us.append(int(part[x]))
                vs.append(int(part[y]))
        return pa.table({"u": pa.array(np.array(us, dtype=np.uint64).view(np.int64)), "v": pa.array(np.array(vs, dtype=np.uint64).view(np.int64))})

    return run


def link_classes(classes: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` that connect all fingerprints (distinct, column ``fp``) within MAX_BITS."""
    n = classes.count()
    m = width(n)
    buckets = max(BUCKETS_A_PARTITION * shuffle_partitions(classes.sparkSession), -(-n * len(_postings(m)) // BUCKET_ENTRIES))
    return by_bucket(classes.select("fp").mapInArrow(_deal(buckets, m), "bucket int, which binary, fps binary"), buckets).applyInArrow(_links(m), "u long, v long")


def cluster(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(``doc_id``, ``__fp``, ``component_id``) of each row of ``docs`` (``doc_id``, ``text``)."""
    prints = materialise(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "__fp"))
    classes = materialise(prints.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("first_doc")))
    roots = components(link_classes(classes))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return prints.join(named.select("fp", "root").join(names, "root").select("fp", "component_id"), F.col("__fp") == F.col("fp")).select("doc_id", "__fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each group that Jaccard similarity of at least 4/5 links: pairs of
    near fingerprints are verified, and what the bits lose is found too: see ``near_copies``."""
    from brambleq.llm import near_copies  # which goes by the fingerprints and links of this module

    return near_copies.deduplicate(docs, shingle)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")
