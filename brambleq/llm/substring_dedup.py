"""Removal of long repeated word spans, by compaction of a de Bruijn graph.

Every k consecutive words of a document are an edge (the k-mer) from the node of
its first k - 1 words to the node of its last k - 1.  The graph is that of the
*repeated* edges, those that stand in two documents or more; an edge's source
coordinate is its first occurrence in the document with the smallest id.

1. Blocks of documents tell which of their edges other blocks hold too (keys cut
   to a few bytes), and deal those whole, with coordinates, to buckets of the edge
   space; a bucket answers with the source coordinate of each repeated edge.
2. Each source edge gives its nodes to Spark.  In- and out-degrees are sums over a
   node's distinct edges; a node is nonbranching if one edge enters and one leaves.
3. Consecutive source edges joined by nonbranching nodes are segments; a segment
   that ends in a nonbranching node is linked with the one that begins there, and
   joins (pointer doubling) compact linked segments to paths, each with its first
   segment's coordinate as name and every segment's offset in it.  A path that
   closes on itself is cut at its smallest coordinate.
4. Where a document follows repeated edges from sources before it, its span goes
   to the source coordinate, is verified there word by word (a 128-bit digest), and
   returns as pieces of paths.  Words covered by verified pieces are removed; where
   its spans lie, a block has written down when it traced them, so that this last
   pass makes no edges.

A key is 56 bits that deal and sort the edges and a lane of 64 more from another
hash of the words.  Should different k-mers share both (below 1e-11 expected pairs
in 100 TB), the digest tells, and the span stays: nothing unverified is removed.

A block sends one entry per distinct edge, so an edge that a third of all
documents share costs an entry per block, not per document.

Defined results: a null or empty text has no words; documents with a null id
have no order: nothing is removed from them, and they are nobody's source; rows
with equal ids are one document for this purpose, so a copy under the same id is
no copy; only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambleq.llm._blocks import Block, bounds, bucket_count, by_bucket, cuts, frame, key_bits, make_blocks, marked, pack_ints, rolled, shared_keys, squeeze, totals, unframe, unpack_ints, unsqueeze, unzigzag, zigzag
from brambleq.llm._common import materialise, table

K = 13
#: Bits of an edge's key that deal and sort; the lane beside them has 64 more.
KEY_BITS = 56
_KEY, _LANE, _NODE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93

_EDGES = "bucket int, block long, edges binary"
_FOUND = "block long, bucket int, found binary"
#: Nodes of source edges (kind 0: an edge leaves, 2: an edge enters, 1: both), or spans to be verified, or all spans of the block (packed).
_TRACED = "block long, node long, at int, kind int, run int, last int, src_block long, src_at int, length int, digest binary, spans binary"
_PIECES = "src_block long, src_at int, length int, digest binary, pieces array<struct<path_block:long,path_at:int,offset:long,start:int,edges:int>>"
_OUT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, paths array<struct<start:int,length:int,path_block:long,path_at:int,offset:long>>"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = []
    for part in ddl.replace("array<struct<", "(").replace(">>", ")").split(", "):
        name, kind = part.split(" ", 1)
        fields.append((name, kinds[kind] if kind in kinds else pa.list_(pa.struct([(a, kinds[b]) for a, b in (x.split(":") for x in kind[1:-1].split(","))]))))
    return pa.schema(fields)


def _ids(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block's documents, and which are null."""
    ids = b.docs().column("doc_id").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    return np.asarray(ids.fill_null(0)).astype(np.int64), np.asarray(ids.is_null())


def _hashes(words: list[bytes]) -> np.ndarray:
    """Two hashes of each word: of keys, of lanes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=np.uint64).reshape(-1, 2)


def _whole(sizes: np.ndarray, null: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where k words of one document begin, and the document; none in those of null id."""
    edges = np.where(null, 0, np.maximum(sizes - k + 1, 0))
    doc = np.repeat(np.arange(sizes.size), edges)
    away = np.cumsum(sizes) - sizes - (np.cumsum(edges) - edges)
    return np.arange(doc.size) + away[doc], doc


class Edges:
    """The k-mers of a block, its documents taken in order of their ids; a coordinate
    counts words from the block's beginning in that order."""

    def __init__(self, b: Block, k: int, bits: int, keyed: bool = True) -> None:
        ids, null = _ids(b)
        order = np.lexsort((ids, null))
        self.block, self.k = b.block, k
        self.ids, self.null, self.sizes = ids[order], null[order], b.sizes[order]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.codes = b.codes()
        if (np.diff(order) < 0).any():
            moved = np.repeat(b.starts[order] - self.starts, self.sizes)
            self.codes = self.codes[moved + np.arange(moved.size)]
        self.of = b
        if not keyed:
            return
        pairs = _hashes(self.table)
        self.w = np.ascontiguousarray(pairs[:, 0])[self.codes] if self.table else np.zeros(0, np.uint64)
        w2 = np.ascontiguousarray(pairs[:, 1])[self.codes] if self.table else self.w
        #: Of each edge's occurrences the coordinate and the document.
        self.at, self.doc = _whole(self.sizes, self.null, k)
        keys = rolled(self.w, k, _KEY)[self.at] >> np.uint64(64 - bits)
        lanes = rolled(w2, k, _LANE)[self.at]
        del w2, pairs
        order, new = _apart(keys, lanes)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], order.size)[: heads.size] - 1
        #: Distinct edges by key and lane, ascending: the first occurrence of each, and whether a later document has it too.
        self.first = order[heads]
        self.keys, self.lanes = keys[self.first], lanes[self.first]
        self.again = self.ids[self.doc[order[tails]]] > self.ids[self.doc[self.first]] if heads.size else np.zeros(0, bool)
        self.edge_of = np.empty(order.size, dtype=np.int64)
        self.edge_of[order] = np.cumsum(new) - 1

    @cached_property
    def table(self) -> list[bytes]:
        return self.of.words()

    def words(self, at: int, n: int) -> list[bytes]:
        return [self.table[c] for c in self.codes[at : at + n].tolist()]

    def digest(self, at: int, n: int) -> bytes:
        return xxhash.xxh3_128_digest(b" ".join(self.words(at, n)))


def _apart(keys: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key and lane, and where in that order an edge differs from the one before."""
    if not keys.size:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    # one sort of plain numbers: as many leading bits of the key as there is room for, above the place
    low, base = np.uint64(max(1, (keys.size - 1).bit_length())), keys.min()
    away = np.uint64(max(0, int(keys.max() - base).bit_length() + int(low) - 64))
    packed = ((keys - base) >> away << low) | np.arange(keys.size, dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    k, x = keys[order], lanes[order]
    differ = (x[1:] != x[:-1]) | (k[1:] != k[:-1])
    packed >>= low
    if (differ & (packed[1:] == packed[:-1])).any():  # those bits do not tell all edges apart
        order = np.argsort(keys, kind="stable")
        k, x = keys[order], lanes[order]
        if ((k[1:] == k[:-1]) & (x[1:] != x[:-1])).any():
            order = np.lexsort((lanes, keys))
            k, x = keys[order], lanes[order]
        differ = (x[1:] != x[:-1]) | (k[1:] != k[:-1])
    return order, np.concatenate(([True], differ))


def _short(e: Edges, bits: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct shortened keys, and each edge's place among them."""
    t = e.keys >> np.uint64(bits - short)
    new = np.concatenate(([True], t[1:] != t[:-1])) if t.size else np.zeros(0, bool)
    return t[new], np.cumsum(new) - 1


def _short_keys(b: Block, k: int, short: int) -> np.ndarray:
    """The keys of ``_short`` alone, by one sort of short numbers: without lanes and places."""
    ids, null = _ids(b)
    codes = b.codes()
    if codes.size < k:
        return np.zeros(0, np.uint64)
    w = np.ascontiguousarray(_hashes(b.words())[:, 0])[codes]
    t = rolled(w, k, _KEY)[_whole(b.sizes, null, k)[0]] >> np.uint64(64 - short)
    t.sort()
    return t[np.concatenate(([True], t[1:] != t[:-1]))] if t.size else t


def _send(k: int, buckets: int, bits: int, short: int):
    """Of one block: its edges that other blocks may hold too, dealt to the buckets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        for row in left.to_pylist():
            e = Edges(Block(row), k, bits)
            keys, place = _short(e, bits, short)
            which = np.flatnonzero(marked(keys, right.to_pylist(), buckets, short)[place]) if keys.size else place
            at, base = cuts(e.keys[which], buckets, bits), bounds(buckets, bits)
            ids = e.ids[e.doc[e.first[which]]]
            low = ids.min() if ids.size else np.int64(0)
            # subtracted modulo 2**64, so that ids of any spread fit
            away = ids.view(np.uint64) - np.int64(low).view(np.uint64)
            for i in np.flatnonzero(np.diff(at)).tolist():
                s, t = at[i], at[i + 1]
                mine = which[s:t]
                out.append({"bucket": i, "block": e.block, "edges": frame(pack_ints(np.diff(e.keys[mine], prepend=base[i])), e.lanes[mine].tobytes(), np.int64(low).tobytes(), pack_ints(away[s:t]), pack_ints(e.at[e.first[mine]]), squeeze(np.packbits(e.again[mine]).tobytes()), pack_ints(np.diff(mine, prepend=0)))})
        return pa.Table.from_pylist(out, _arrow(_EDGES))

    return run


def _answer(buckets: int, bits: int):
    """Of one bucket: for each block, the source coordinates of its repeated edges."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        base = bounds(buckets, bits)[bucket]
        blocks = t.column("block").to_pylist()
        keys, lanes, ids, at, again, entry, sizes = [], [], [], [], [], [], []
        for x in t.column("edges").to_pylist():
            steps, lane, low, away, p, m, which = unframe(x, 7)
            lanes.append(np.frombuffer(lane, np.uint64))
            n = lanes[-1].size
            sizes.append(n)
            keys.append(np.cumsum(unpack_ints(steps)) + base)
            ids.append((unpack_ints(away) + np.frombuffer(low, np.uint64)).view(np.int64))
            at.append(unpack_ints(p).astype(np.int64))
            again.append(np.unpackbits(np.frombuffer(unsqueeze(m), np.uint8), count=n).astype(bool))
            entry.append(np.cumsum(unpack_ints(which)).astype(np.int64))
        key, lane, idd, pos, more, ent = (np.concatenate(x) for x in (keys, lanes, ids, at, again, entry))
        del keys, lanes, ids, at, again, entry
        owner = np.repeat(np.arange(len(blocks)), sizes)
        order, new = _apart(key, lane)
        edge = np.empty(order.size, dtype=np.int64)
        edge[order] = np.cumsum(new) - 1
        order = np.lexsort((pos, owner, idd, edge))
        heads = np.flatnonzero(np.diff(edge[order], prepend=-1))
        source = order[heads][edge]  # of every entry, the entry that is its edge's source
        repeated = np.zeros(heads.size, dtype=bool)
        np.logical_or.at(repeated, edge, more | (idd > idd[source]))
        told = np.flatnonzero(repeated[edge])  # ascending, so by owner, then entry
        ends = np.searchsorted(owner[told], np.arange(len(blocks) + 1))
        names = np.array(blocks, dtype=np.int64)
        out: list[dict] = []
        for i, block in enumerate(blocks):
            mine = told[ends[i] : ends[i + 1]]
            if mine.size:
                src = source[mine]
                out.append({"block": block, "bucket": bucket, "found": frame(pack_ints(np.diff(ent[mine], prepend=0)), pack_ints(zigzag(idd[src])), pack_ints(pos[src]), pack_ints(zigzag(names[owner[src]])))})
        return pa.Table.from_pylist(out, _arrow(_FOUND))

    return run


class Traced:
    """A block's edges with their sources, and its spans of repeated edges."""

    def __init__(self, e: Edges, answers: list[dict]) -> None:
        n, k = e.first.size, e.k
        self.doc = e.ids[e.doc[e.first]].copy() if n else np.zeros(0, np.int64)
        self.at = e.at[e.first].copy()
        self.block = np.full(n, e.block, dtype=np.int64)
        self.repeated = e.again.copy()
        for r in answers:
            if r["found"] is not None:
                which, d, p, o = unframe(r["found"], 4)
                which = np.cumsum(unpack_ints(which)).astype(np.int64)
                self.doc[which], self.at[which], self.block[which] = unzigzag(unpack_ints(d)), unpack_ints(p).astype(np.int64), unzigzag(unpack_ints(o))
                self.repeated[which] = True
        of = e.edge_of
        hit = np.flatnonzero(self.doc[of] < e.ids[e.doc]) if of.size else of
        at, src, block = e.at[hit], self.at[of[hit]], self.block[of[hit]]
        same = (np.diff(at) == 1) & (np.diff(e.doc[hit]) == 0) & (np.diff(src) == 1) & (np.diff(block) == 0)
        heads = np.flatnonzero(np.concatenate(([True], ~same))) if hit.size else hit
        tails = np.append(heads[1:], hit.size)[: heads.size]
        #: Spans: coordinate, words, source block and coordinate.
        self.spans = list(zip(at[heads].tolist(), (tails - heads + k - 1).tolist(), block[heads].tolist(), src[heads].tolist(), strict=True))


def _trace(k: int, bits: int):
    """Of one block: the nodes of its source edges, and the spans to be verified elsewhere."""
    schema = _arrow(_TRACED)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_pylist():
            e = Edges(Block(row), k, bits)
            t = Traced(e, right.to_pylist())
            mine = t.repeated & (t.block == e.block) & (t.at == e.at[e.first])
            s = np.sort(t.at[mine])
            gap = np.diff(s) != 1
            heads = np.flatnonzero(np.concatenate(([True], gap))) if s.size else s
            n = np.diff(np.append(heads, s.size)) + 1  # nodes of each run
            first = np.cumsum(n) - n
            run = np.repeat(s[heads], n)
            at = run + np.arange(run.size) - np.repeat(first, n)
            kind = np.ones(run.size, dtype=np.int32)
            kind[first] = 0
            kind[first + n - 1] = 2
            # the words of the runs alone, end to end; a run's last node has k - 2 words behind its first
            size = n + k - 2
            starts = np.cumsum(size) - size
            words = e.w[np.arange(size.sum()) + np.repeat(s[heads] - starts, size)]
            node = rolled(words, k - 1, _NODE)[np.arange(at.size) + np.repeat(starts - first, n)].view(np.int64) if at.size else at
            none = pa.nulls
            m = at.size
            parts.append(pa.Table.from_arrays([pa.array(np.full(m, e.block)), pa.array(node, pa.int64()), pa.array(at, pa.int32()), pa.array(kind), pa.array(run, pa.int32()), pa.array(np.repeat(s[heads] + n - 1, n), pa.int32()), none(m, pa.int64()), none(m, pa.int32()), none(m, pa.int32()), none(m, pa.binary()), none(m, pa.binary())], schema=schema))
            digests = [e.digest(a, n) for a, n, _, _ in t.spans]
            asked = {(src, p, n, d) for (_, n, src, p), d in zip(t.spans, digests, strict=True)}
            parts.append(pa.Table.from_pylist([{"block": e.block, "src_block": b, "src_at": p, "length": n, "digest": d} for b, p, n, d in sorted(asked)], schema))
            if digests:
                starts, sizes, blocks, places = (np.array(x, dtype=np.int64) for x in zip(*t.spans, strict=True))
                packed = frame(pack_ints(np.diff(starts, prepend=0)), pack_ints(sizes), pack_ints(zigzag(blocks)), pack_ints(places), b"".join(digests))
                parts.append(pa.Table.from_pylist([{"block": e.block, "spans": packed}], schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def compact(nodes: DataFrame) -> DataFrame:
    """Paths of the graph: (``block``, ``at``, ``end``: a segment's first and last node;
    ``path_block``, ``path_at``, ``offset``: its path, and edges of the path before it), from
    the nodes of all runs of source edges."""
    on = Window.partitionBy("node")
    count = lambda what: F.sum(F.expr(what).cast("int")).over(on)
    degrees = nodes.withColumns({"n": F.count("*").over(on), "enter": count("kind >= 1"), "leave": count("kind <= 1")})
    # a node that one run alone holds is nonbranching, or the end of its path
    seen = materialise(degrees.where("n > 1 or kind = 0"))
    later = F.lead("at").over(Window.partitionBy("block", "run").orderBy("at"))
    segments = materialise(seen.where("kind <= 1").select("block", "at", "last", later.alias("next")).select("block", "at", F.coalesce("next", "last").alias("end")))
    place = F.struct("block", "at")
    links = seen.where("n = 2 and enter = 1 and leave = 1").groupBy("node").agg(F.max(F.when(F.col("kind") == 2, place)).alias("a"), F.max(F.when(F.col("kind") == 0, place)).alias("b"))
    before = links.join(segments, (F.col("a.block") == F.col("block")) & (F.col("a.at") == F.col("end"))).select("b", place.alias("pred"), (F.col("end") - F.col("at")).cast("long").alias("pred_edges"))
    state = segments.withColumn("key", place).join(before, F.col("key") == F.col("b"), "left").select("key", "end", "pred", "pred_edges")
    return _paths(state).select("key.block", "key.at", "end", F.col("ptr.block").alias("path_block"), F.col("ptr.at").alias("path_at"), "offset")


def _paths(state: DataFrame) -> DataFrame:
    """Pointer doubling: every segment's pointer moves to its pointer's pointer until all point
    to the first segments of their paths."""
    head = F.col("pred").isNull()
    now = materialise(state.withColumns({"ptr": F.coalesce("pred", "key"), "offset": F.coalesce("pred_edges", F.lit(0)), "least": F.least("key", F.coalesce("pred", "key")), "done": head}))
    left, rounds, settled = now.where("not done").count(), 0, 1
    # an open path settles a segment a round at least; where none settles, only cycles are left,
    # and their members know the smallest once the pointers span as many segments
    while left and (settled or 2**rounds < left):
        p = now.select(F.col("key").alias("k"), F.col("ptr").alias("p"), F.col("offset").alias("o"), F.col("least").alias("l"), F.col("done").alias("d"))
        now = materialise(now.join(p, F.col("ptr") == F.col("k")).select("key", "end", "pred", "pred_edges", F.col("p").alias("ptr"), F.when(F.col("done"), F.col("offset")).otherwise(F.col("offset") + F.col("o")).alias("offset"), F.least("least", "l").alias("least"), F.col("d").alias("done")))
        before, left = left, now.where("not done").count()
        settled, rounds = before - left, rounds + 1
    if not left:
        return now
    # what is left are cycles, whose smallest segment each member knows by now
    cut = F.col("key") == F.col("least")
    again = now.where("not done").select("key", "end", *[F.when(~cut, F.col(c)).alias(c) for c in ("pred", "pred_edges")])
    return now.where("done").unionByName(_paths(again))


def _verify(k: int):
    """Of one block: the spans whose source lies in it, verified and cut into pieces of paths."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = right.filter(pa.compute.is_valid(right.column("digest"))).to_pylist()
        held = right.filter(pa.compute.is_null(right.column("digest"))).sort_by("src_at")
        at, end, path_at = (held.column(c).to_numpy() for c in ("src_at", "length", "path_at"))
        path_block, offset = (held.column(c).to_numpy() for c in ("path_block", "offset"))
        out: list[dict] = []
        for row in left.to_pylist() if asked else []:
            e = Edges(Block(row), k, 0, keyed=False)
            memo: dict[tuple[int, int], tuple[bytes, list[dict]]] = {}
            for r in asked:
                s, n = r["src_at"], r["length"]
                if (s, n) not in memo:
                    last = s + n - k  # the span's last edge
                    pieces = []
                    i = int(np.searchsorted(at, s, side="right")) - 1
                    while 0 <= i < at.size and at[i] <= last:
                        a, z = max(s, int(at[i])), min(last + 1, int(end[i]))
                        if z > a:
                            pieces.append({"path_block": int(path_block[i]), "path_at": int(path_at[i]), "offset": int(offset[i]) + a - int(at[i]), "start": a - s, "edges": z - a})
                        i += 1
                    memo[s, n] = e.digest(s, n), pieces
                digest, pieces = memo[s, n]
                if digest == r["digest"]:
                    out.append({"src_block": e.block, "src_at": s, "length": n, "digest": digest, "pieces": pieces})
        return pa.Table.from_pylist(out, _arrow(_PIECES))

    import pyarrow.compute  # noqa: F401

    return run


def _spans(packed: bytes) -> list[tuple[int, int, int, int, bytes]]:
    """What ``_trace`` has packed: of each span coordinate, words, source block and coordinate, digest."""
    starts, sizes, blocks, places, digests = unframe(packed, 5)
    columns = np.cumsum(unpack_ints(starts)), unpack_ints(sizes), unzigzag(unpack_ints(blocks)), unpack_ints(places)
    return list(zip(*(c.tolist() for c in columns), [digests[i : i + 16] for i in range(0, len(digests), 16)], strict=True))


def _cut(k: int, keep_text: bool):
    """Of one block: the documents without the words that verified pieces of paths cover."""
    schema = _arrow(_OUT)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        rows = right.to_pylist()
        known = {(r["src_block"], r["src_at"], r["length"], r["digest"]): r["pieces"] for r in rows if r["spans"] is None}
        for row in left.to_pylist():
            b = Block(row)
            e = Edges(b, k, 0, keyed=False)
            cover = np.zeros(e.codes.size + 1, dtype=np.int32)
            paths: dict[int, list[dict]] = {}
            spans = [s for r in rows if r["spans"] is not None for s in _spans(r["spans"])]
            docs = (np.searchsorted(e.starts, [s[0] for s in spans], side="right") - 1).tolist()
            for d, (a, n, src, p, digest) in zip(docs, spans, strict=True):
                for x in known.get((src, p, n, digest), ()):
                    s, words = a + x["start"], x["edges"] + k - 1
                    cover[s] += 1
                    cover[s + words] -= 1
                    paths.setdefault(d, []).append({"start": s - int(e.starts[d]), "length": words, "path_block": x["path_block"], "path_at": x["path_at"], "offset": x["offset"]})
            stays = np.cumsum(cover)[:-1] == 0
            held = np.concatenate(([0], np.cumsum(stays)))
            at = held[np.append(e.starts, e.codes.size)]  # each document's kept words
            text = b.spaced().take(pa.array(e.codes[stays]))
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1][at].tolist() if len(text) else [0] * at.size
            data = memoryview(text.buffers()[2] or b"")
            removed = (e.sizes - np.diff(at)).tolist()
            for i, n in enumerate(e.sizes.tolist()):
                kept = data[ends[i] : max(ends[i], ends[i + 1] - 1)]  # without the last space
                out.append({"doc_id": None if e.null[i] else int(e.ids[i]), "n_words": n, "n_removed": removed[i], "kept": bytes(kept).decode() if keep_text else None, "kept_sha256": hashlib.sha256(kept).hexdigest(), "paths": paths.get(i, [])})
        return pa.Table.from_pylist(out, schema)

    return run


def remove_repeats(docs: DataFrame, k: int = K, keep_text: bool = True, bits: int = KEY_BITS) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_words``, ``n_removed``,
    ``kept`` (kept words joined by a space; null unless ``keep_text``), ``kept_sha256`` and
    ``paths`` (verified repeated spans in words, with the path each follows); ``k`` is 2 or more."""
    blocks = make_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), None)
    n_bytes, n_words = totals(blocks)
    buckets = bucket_count(blocks, n_bytes)
    short = min(bits, key_bits(n_words))
    whole = blocks.groupBy("block")
    marks = shared_keys(blocks, lambda b: _short_keys(b, k, short), buckets, short)
    sent = whole.cogroup(marks.groupBy("block")).applyInArrow(_send(k, buckets, bits, short), _EDGES)
    found = materialise(by_bucket(sent, buckets).applyInArrow(_answer(buckets, bits), _FOUND))
    traced = materialise(whole.cogroup(found.groupBy("block")).applyInArrow(_trace(k, bits), _TRACED))
    paths = compact(traced.where("node is not null").select("block", "node", "at", "kind", "run", "last"))
    asked = traced.where("digest is not null").select("block", "src_block", "src_at", "length", "digest")
    once = asked.select(F.col("src_block").alias("block"), "src_at", "length", "digest").distinct()  # verified once, however many blocks ask
    held = once.unionByName(paths.select("block", F.col("at").alias("src_at"), F.col("end").alias("length"), "path_block", "path_at", "offset"), allowMissingColumns=True)
    pieces = asked.join(whole.cogroup(held.groupBy("block")).applyInArrow(_verify(k), _PIECES), ["src_block", "src_at", "length", "digest"])
    spans = traced.where("spans is not null").select("block", "spans")
    return whole.cogroup(spans.unionByName(pieces, allowMissingColumns=True).groupBy("block")).applyInArrow(_cut(k, keep_text), _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), m AS (SELECT s, min(doc_id) AS first_doc FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (s) WHERE first_doc < doc_id),
r AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[p] FOR p IN range(1, len(w) + 1) IF NOT list_contains(gone, p)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
