"""Groups of documents whose sets of word shingles have a Jaccard similarity of at least 4/5.

Documents of one set are one class, which one of them stands for.  SimHash comes first:
each class has the fingerprint of its shingles, the index of ``simhash`` links fingerprints
within its few bits, and classes of equal or linked fingerprints are compared whole.
Fingerprints of 64 bits differ in about ten at that similarity, so bits alone lose links;
an exact join finds the rest, among classes that are not of one component by then.

Two sets of that similarity, each in one order over all
shingles, share one of the first n - ceil(4 n / 5) + 1 of either: a document is
posted under those only.  The order is by how often a slot of shingles is met in
the corpus, then by hash, so passages that many documents hold come last and
postings stay short; any order gives the same result.  Blocks first tell which of their
postings others hold too; only those travel.  In each round every posting compares
its classes with some of its own, the leaders, whose pairs are then settled there;
a posting ends when its classes are all of one component, so a group of copies
costs a row per copy, not per pair.  Leaders grow sixteenfold a round.  Candidates
that differ too much in size, or meet too late in their orders to reach the
similarity, are no copies; of all others one's set goes to the other's block and is
compared whole.

Defined results: texts without words, and null texts, have the empty set and are
one group; texts of fewer words than a shingle are one shingle; of rows with equal
ids the first by a hash of the text stands before the others; rows with a null id
belong to no group and stay; an empty table gives an empty table; columns of any
name are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambleq.llm._blocks import Block, block_rows, bucket_count, key_bits, make_blocks, marked, pack_ints, rolled, shared_keys, totals, unpack_ints
from brambleq.llm._common import aside, discard, materialise, no_shuffles_left, text_bytes
from brambleq.llm._graph import components
from brambleq.llm.simhash import link_classes, of_hashes

#: Least similarity, as a fraction.
LEAST, WHOLE = 4, 5
#: Bits of a slot of shingles that are counted together for the order, and of a part of the slots.
_SLOT_BITS, _PART_BITS = 20, 16
_BASE = 0xA24BAED4963EE407
#: Bytes of text of a block: smaller than elsewhere, as documents keep their texts here.
_BLOCK_BYTES = 2 << 20
#: Tasks over which the rows of one class or group are spread.
_SALTS = 16


def _split(text: bytes) -> list[bytes]:
    return text.lower().split()


class Sets:
    """The shingle sets of a block's documents, as ascending 64-bit hashes."""

    def __init__(self, b: Block, shingle: int) -> None:
        self.w, self.starts, self.sizes, self.shingle = b.hashed(), b.starts, b.sizes, shingle
        self.all = rolled(self.w, shingle, _BASE)

    def of(self, row: int) -> np.ndarray:
        s, n = int(self.starts[row]), int(self.sizes[row])
        if n >= self.shingle:
            return np.unique(self.all[s : s + n - self.shingle + 1])
        return rolled(np.append(self.w[s : s + n], np.uint64(n)), n + 1, _BASE) if n else self.w[:0]


_ROWS = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("id", pa.int64()), ("hash", pa.int64()), ("cls", pa.binary()), ("n", pa.int64()), ("fp", pa.int64())])


def _classes(shingle: int):
    """Each document's class, a digest of its set, and the set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in block_rows(batches):
            sets, docs = Sets(b, shingle), b.docs()
            found = [sets.of(i) for i in range(b.sizes.size)]
            m = len(found)
            text = np.array([xxhash.xxh3_64_intdigest(x) for x in text_bytes(docs.column("text").combine_chunks())], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([b.block] * m, pa.int64()), pa.array(range(m), pa.int32()), docs.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(text), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()), pa.array([x.size for x in found], pa.int64()), pa.array(np.array([of_hashes(x) for x in found], dtype=np.uint64).view(np.int64))], schema=_ROWS)

    return run


def _tally(shingle: int):
    """How often each slot of shingles is met in the classes of one block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        total = np.zeros(1 << _SLOT_BITS, dtype=np.int64)
        for row in left.to_pylist():
            sets = Sets(Block(row), shingle)
            found = [sets.of(i) for i in right.column("row").to_pylist()]
            if found:
                total += np.bincount((np.concatenate(found) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64), minlength=total.size)
        parts = total.reshape(-1, 1 << _PART_BITS)
        return pa.table({"part": pa.array(range(len(parts)), pa.int32()), "counts": pa.array([pack_ints(x) for x in parts], pa.binary())})

    return run


def _sum(t: pa.Table) -> pa.Table:
    total = np.zeros(1 << _PART_BITS, dtype=np.uint64)
    for x in t.column("counts").to_pylist():
        total += unpack_ints(x)
    return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "counts": pa.array([pack_ints(total)], pa.binary())})


class Postings:
    """The postings of a block's classes: shingle, row, and the shingle's place in the row's order."""

    def __init__(self, b: Block, rows: list[int], shingle: int, often: np.ndarray) -> None:
        sets = Sets(b, shingle)
        s, of, place = [], [], []
        for i in rows:
            h = sets.of(i)
            first = h[np.lexsort((h, often[(h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]))][: h.size + LEAST * h.size // -WHOLE + 1] if h.size else h
            s.append(first)
            of.append(np.full(first.size, i, dtype=np.int64))
            place.append(np.arange(first.size))
        self.s = np.concatenate(s) if s else np.zeros(0, np.uint64)
        self.row, self.place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (of, place))

    def keys(self, bits: int) -> np.ndarray:
        return np.unique(self.s >> np.uint64(64 - bits))


_LIVE = pa.schema([("s", pa.int64()), ("cls", pa.binary()), ("n", pa.int64()), ("at", pa.int32())])


def _shared(shingle: int, often, buckets: int, bits: int):
    """Of one block: the postings that another class may hold too."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        held = {r["row"]: r for r in rows if r["marks"] is None}
        parts = []
        for row in left.to_pylist():
            p = Postings(Block(row), sorted(held), shingle, often.value)
            keys, place, times = np.unique(p.s >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
            keep = np.flatnonzero((marked(keys, rows, buckets, bits) | (times > 1))[place]) if keys.size else place
            of = p.row[keep].tolist()
            parts.append(pa.Table.from_arrays([pa.array(p.s[keep].view(np.int64)), pa.array([held[i]["cls"] for i in of], pa.binary()), pa.array([held[i]["n"] for i in of], pa.int64()), pa.array(p.place[keep], pa.int32())], schema=_LIVE))
        return pa.concat_tables(parts) if parts else _LIVE.empty_table()

    return run


def _lend(shingle: int):
    """Of one block: the sets that other blocks are to compare theirs with, once for each such block."""
    schema = pa.schema([("block", pa.int64()), ("u", pa.binary()), ("set", pa.binary()), ("rows", pa.list_(pa.int32())), ("vs", pa.list_(pa.binary()))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        to: dict[tuple[int, bytes, int], list[tuple[int, bytes]]] = {}
        for r in right.to_pylist():
            to.setdefault((r["v_block"], r["u"], r["u_row"]), []).append((r["v_row"], r["v"]))
        out: list[dict] = []
        for row in left.to_pylist() if to else []:
            sets = Sets(Block(row), shingle)
            memo: dict[int, bytes] = {}
            for (block, u, i), vs in to.items():
                if i not in memo:
                    memo[i] = pack_ints(np.diff(sets.of(i), prepend=np.uint64(0)))
                out.append({"block": block, "u": u, "set": memo[i], "rows": [x for x, _ in vs], "vs": [x for _, x in vs]})
        return pa.Table.from_pylist(out, schema)

    return run


def _compare(shingle: int):
    """Of one block: the pairs that reach the similarity."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        for row in left.to_pylist() if right.num_rows else []:
            sets = Sets(Block(row), shingle)
            for r in right.to_pylist():
                p = np.cumsum(unpack_ints(r["set"]))
                for i, v in zip(r["rows"], r["vs"], strict=True):
                    q = sets.of(i)
                    both = np.intersect1d(p, q, assume_unique=True).size
                    if WHOLE * both >= LEAST * (p.size + q.size - both):
                        out.append({"u": r["u"], "v": v})
        return pa.Table.from_pylist(out, schema)

    return run


def _roots(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("cls"), F.col("root").alias("new"))


def _several(live: DataFrame, what: str) -> DataFrame:
    """The rows of ``live`` whose posting has different values of ``what``."""
    many = live.groupBy("s").agg(F.min(what).alias("lo"), F.max(what).alias("hi")).where("lo < hi").select("s")
    return live.join(many, "s")


def _verified(blocks: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """Those of the ``pairs`` (``u``, ``v``: classes) that reach the similarity."""
    whole = blocks.groupBy("block")
    where = [classes.select(F.col("cls").alias(x), F.col("block").alias(f"{x}_block"), F.col("row").alias(f"{x}_row")) for x in "uv"]
    placed = pairs.join(where[0], "u").join(where[1], "v").withColumn("block", F.col("u_block"))
    lent = whole.cogroup(placed.groupBy("block")).applyInArrow(_lend(shingle), "block long, u binary, set binary, rows array<int>, vs array<binary>")
    return whole.cogroup(lent.groupBy("block")).applyInArrow(_compare(shingle), "u binary, v binary")


def _near(n, m):
    return F.least(n, m) * WHOLE >= F.greatest(n, m) * LEAST


def by_fingerprints(blocks: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """Links ``u``, ``v`` between classes of the similarity whose fingerprints are equal or linked;
    ``classes`` as for ``_links``, and ``fp``."""
    first = materialise(classes.groupBy("fp").agg(F.min(F.struct("cls", "n")).alias("c")))
    one, two = (first.select(F.col("fp").alias(x), F.col("c").alias(f"c{x}")) for x in "uv")
    # those of one fingerprint with the first of them, and the first ones of linked fingerprints
    equal = classes.join(first, "fp").select("c", F.struct("cls", "n").alias("d"))
    near = link_classes(first.select("fp")).distinct().join(one, "u").join(two, "v").select(F.col("cu").alias("c"), F.col("cv").alias("d"))
    pairs = equal.unionByName(near).where((F.col("c.cls") != F.col("d.cls")) & _near(F.col("c.n"), F.col("d.n")))
    return _verified(blocks, classes, pairs.select(F.least("c.cls", "d.cls").alias("u"), F.greatest("c.cls", "d.cls").alias("v")), shingle)


def _groups(blocks: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """(``cls``, ``new``): the classes that links of the similarity connect with others, and the smallest
    class of each one's component; ``classes``: ``cls``, ``n``, ``fp``, and ``block`` and ``row`` of
    the document that stands for it."""
    spark = blocks.sparkSession
    links = materialise(by_fingerprints(blocks, classes, shingle))
    roots = _roots(links)
    whole = blocks.groupBy("block")
    n_bytes, n_words = totals(blocks)
    buckets, bits = bucket_count(blocks, n_bytes), key_bits(n_words)
    kind = "part int, counts binary"
    often = np.zeros((1 << _SLOT_BITS >> _PART_BITS, 1 << _PART_BITS), dtype=np.int64)
    with no_shuffles_left(spark):
        for part, counts in whole.cogroup(classes.select("block", "row").groupBy("block")).applyInArrow(_tally(shingle), kind).groupBy("part").applyInArrow(_sum, kind).collect():
            often[part] = unpack_ints(bytes(counts))
    shared = spark.sparkContext.broadcast(often.reshape(-1))
    marks = shared_keys(blocks, lambda b, t: Postings(b, t.column("row").to_pylist(), shingle, shared.value).keys(bits), buckets, bits, classes.select("block", "row"))
    asked = classes.select("block", "row", "cls", "n").unionByName(marks, allowMissingColumns=True)
    posted = whole.cogroup(asked.groupBy("block")).applyInArrow(_shared(shingle, shared, buckets, bits), "s long, cls binary, n long, at int")
    posted = materialise(posted)
    live = materialise(_several(posted.join(roots, "cls", "left").select("s", "cls", "n", "at", F.coalesce("new", "cls").alias("root")), "root"))
    discard(posted)
    leaders = 1
    while not live.isEmpty():
        slot = F.pmod(F.xxhash64("cls", F.lit(leaders)), F.lit(leaders))
        lead = materialise(live.groupBy("s", slot.alias("slot")).agg(F.min(F.struct("cls", "n", "at", "root")).alias("l")).select("s", F.col("l.cls").alias("lead"), F.col("l.n").alias("m"), F.col("l.at").alias("lead_at"), F.col("l.root").alias("base")))
        # at the first shingle that two sets share, no more than what follows it can be shared too
        ahead = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("lead_at")) * (LEAST + WHOLE) >= (F.col("n") + F.col("m")) * LEAST
        pairs = live.join(lead, "s").where((F.col("root") != F.col("base")) & _near("n", "m") & ahead).select(F.least("cls", "lead").alias("u"), F.greatest("cls", "lead").alias("v")).distinct()
        old, links = links, materialise(links.unionByName(_verified(blocks, classes, pairs, shingle)))
        discard(old)
        roots = _roots(links)
        rest = live.join(lead.select("s", F.col("lead").alias("cls")), ["s", "cls"], "left_anti")
        old, live = live, materialise(_several(rest.join(roots, "cls", "left").select("s", "cls", "n", "at", F.coalesce("new", "cls").alias("root")), "root"))
        discard(old)
        discard(lead)
        leaders *= 16
    return roots


def deduplicate(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id, the first by a hash of
    its text among equal ids, one of equal rows; rows with a null id stay.  Columns unchanged."""
    given, docs = docs, aside(docs, "doc_id", "text")
    blocks = make_blocks(docs, _split, _BLOCK_BYTES, keep_text=True)
    rows = materialise(blocks.mapInArrow(_classes(shingle), "block long, row int, id long, hash long, cls binary, n long, fp long").where("id is not null"))
    order = F.struct("id", "hash", "block", "row")
    classes = materialise(rows.groupBy("cls").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.min(order).alias("best")).select("cls", "n", "fp", "best", "best.block", "best.row"))
    words = blocks.select("block", "n_bytes", "n_words", "sizes", "codes", "words", "spans")  # the texts stay where they are
    named = materialise(classes.join(_groups(words, classes, shingle), "cls", "left").select("cls", "best", F.coalesce("new", "cls").alias("root")))
    best = named.groupBy("root").agg(F.min("best").alias("best"))
    salt = F.pmod(F.xxhash64("block", "row"), F.lit(_SALTS))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    kept = named.select("cls", "root").join(best, "root").select("cls", "best", salts)
    gone = rows.withColumn("salt", salt).join(kept, ["cls", "salt"]).where(order != F.col("best")).select("block", "row")
    names = docs.columns

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_pylist():
            t = Block(row).docs()
            keep = np.ones(t.num_rows, dtype=bool)
            keep[right.column("row").to_numpy()] = False
            parts.append(t.filter(pa.array(keep)).select(names))
        return pa.concat_tables(parts)

    return blocks.select("block", "docs", "sizes").groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(drop, docs.schema).toDF(*given.columns)
