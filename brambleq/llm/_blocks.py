"""Blocks: documents packed, a bounded number of bytes at a time, into rows.

Operators that look every word of the corpus up in a corpus-wide table would
shuffle one row per word if written as plain joins.  Here a *block* of
documents holds its words once, as numbers into a table of its distinct words, so
that each later pass reads numbers instead of splitting text again.  It sends each
bucket of a key space one packed row, gets one packed row back, and its documents
stay where they are.  Blocks are written to the shared folder once, so every later
pass sees the same blocks whatever is lost.

``shared_keys`` finds which keys of a block other blocks hold too, at two to three
bytes a key: only these need to travel whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambleq.llm._common import give_back, passing, shuffle_partitions, text_bytes, work_dir

#: Bytes of text after which a block is closed (one longer text is a block of its own).
BLOCK_BYTES = 4 << 20
#: Bytes of text that one bucket of a key space answers for.
BUCKET_BYTES = 64 << 20
#: Buckets of a key space per shuffle partition, so that partitions hold about equal shares.
BUCKETS_A_PARTITION = 4
BLOCKS = "block long, n_docs long, n_bytes long, n_words long, docs binary, sizes binary, codes binary, words binary, spans binary"


def pack_table(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def unpack_table(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def squeeze(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + (pa.compress(b, codec="zstd", asbytes=True) if b else b"")


def unsqueeze(b: bytes) -> bytes:
    n = int.from_bytes(b[:8], "little")
    return pa.decompress(b[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def pack_ints(a: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, high planes apart from low ones, so
    that an entropy coder finds the zeros; zstd, preceded by length and width."""
    a = np.ascontiguousarray(a, dtype=np.uint64)
    top = int(a.max()) if a.size else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    body = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
    return np.array([a.size, width], dtype=np.uint64).tobytes() + body


def unpack_ints(b: bytes) -> np.ndarray:
    n, width = (int(x) for x in np.frombuffer(b[:16], dtype=np.uint64))
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        planes = pa.decompress(b[16:], decompressed_size=n * width, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def frame(*parts: bytes) -> bytes:
    """Byte strings laid end to end behind their lengths."""
    return np.array([len(p) for p in parts], dtype=np.uint64).tobytes() + b"".join(parts)


def unframe(b: bytes, n: int) -> list[bytes]:
    out, at = [], 8 * n
    for size in np.frombuffer(b[: 8 * n], dtype=np.uint64).tolist():
        out.append(b[at : at + size])
        at += size
    return out


def zigzag(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.int64)
    return ((a << 1) ^ (a >> 63)).view(np.uint64)


def unzigzag(a: np.ndarray) -> np.ndarray:
    return (a >> np.uint64(1)).view(np.int64) ^ -(a & np.uint64(1)).view(np.int64)


class _Numbers(dict):
    """Each new key gets the next number."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


class Block:
    """One row of blocks: the documents' other columns, and their words as numbers
    (the more frequent in the block, the smaller)."""

    def __init__(self, row: dict) -> None:
        give_back()  # the block before it is done with
        self.row = row
        self.block: int = row["block"]
        self.sizes = unpack_ints(row["sizes"]).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def docs(self) -> pa.Table:
        return unpack_table(self.row["docs"])

    def codes(self) -> np.ndarray:
        return unpack_ints(self.row["codes"]).astype(np.int64)

    def words(self) -> list[bytes]:
        """The distinct words, by number."""
        blob = unsqueeze(self.row["words"])
        ends = np.cumsum(unpack_ints(self.row["spans"])).tolist()
        return [blob[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []

    def spaced(self) -> pa.Array:
        """The distinct words by number, each with a space behind it."""
        import pyarrow.compute as pc

        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(unpack_ints(self.row["spans"])).astype(np.int64)))
        words = pa.Array.from_buffers(pa.large_binary(), ends.size - 1, [None, pa.py_buffer(ends), pa.py_buffer(unsqueeze(self.row["words"]))])
        return pc.binary_join_element_wise(words, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))

    def hashed(self, seed: int = 0) -> np.ndarray:
        """A hash of each word of the block's documents, in order."""
        h = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words()], dtype=np.uint64)
        c = self.codes()
        return h[c] if c.size else np.zeros(0, np.uint64)

    def doc_of(self) -> np.ndarray:
        """The row of each word's document."""
        return np.repeat(np.arange(self.sizes.size), self.sizes)


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for i in range(b.num_rows):
            yield Block(b.slice(i, 1).to_pylist()[0])
    give_back()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(w: np.ndarray, k: int, base: int) -> np.ndarray:
    """A hash of each ``k`` words in succession, from the words' hashes."""
    if k > w.size:
        return np.zeros(0, dtype=np.uint64)
    # a polynomial in the base: spans of 1, 2, 4, ... words, of which those that add up to k are joined
    h, done, part, n = None, 0, w, 1
    while True:
        if k & n:
            h = part if h is None else h[: w.size - done - n + 1] * np.uint64(pow(base, n, 1 << 64)) + part[done:]
            done += n
        if done == k:
            return mix(h)
        part = part[:-n] * np.uint64(pow(base, n, 1 << 64)) + part[n:]
        n *= 2


#: Of each byte whether it parts words, as bytes.split has it.
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])


def white_words(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Of texts (columns of strings; null is empty) in a row, cut into words at white space: the number
    of words of each, all words as numbers (the more frequent, the smaller), and the distinct words
    by number, end to end, with their lengths."""
    import pyarrow.compute as pc

    held = pa.concat_arrays([pc.fill_null(x.cast(pa.large_binary()), b"") for x in texts])
    off = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    buf = np.frombuffer(held.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    white = _WHITE[buf]
    in_word = ~white
    begin, end = in_word.copy(), in_word.copy()
    begin[1:] &= white[:-1]
    end[:-1] &= white[1:]
    heads = off[:-1][np.diff(off) > 0]  # a word ends where its text does
    begin[heads] = in_word[heads]
    end[heads[1:] - 1] = in_word[heads[1:] - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sizes = np.diff(np.searchsorted(begin, off))
    if not begin.size:
        return sizes, begin, b"", begin
    ends = np.concatenate(([0], np.cumsum(end - begin)))
    coded = pa.Array.from_buffers(pa.large_binary(), begin.size, [None, pa.py_buffer(ends), pa.py_buffer(buf[in_word])]).dictionary_encode()
    codes = np.asarray(coded.indices)
    rank = np.argsort(-np.bincount(codes), kind="stable")
    place = np.empty(rank.size, dtype=np.int64)
    place[rank] = np.arange(rank.size)
    words = coded.dictionary.take(pa.array(rank))
    spans = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return sizes, place[codes], words.buffers()[2].to_pybytes()[spans[0] : spans[-1]], np.diff(spans)


def make_blocks(docs: DataFrame, split: Callable[[bytes], list[bytes] | list[str]] | None, block_bytes: int = BLOCK_BYTES, keep_text: bool = False, mark: tuple[str, Callable[[bytes], bytes]] | None = None) -> DataFrame:
    """A written table of blocks of ``docs`` (a ``text`` among its columns, which the block's
    documents keep only with ``keep_text``); ``split`` cuts a text into words (bytes, or strings
    that are encoded once each), or is None for words between white space; ``mark`` names a
    binary column to add to the documents, and what makes it of a text."""
    held = docs if keep_text else docs.drop("text")
    names = held.columns
    k = docs.columns.index("text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        first = TaskContext.get().partitionId() << 32
        parts: list[pa.RecordBatch] = []
        whole: list[pa.Array] = []
        index, codes, sizes = _Numbers(), [], []
        size, seq = 0, 0

        def take(b: pa.RecordBatch) -> None:
            texts = text_bytes(b.column(k)) if split or mark else []
            part = b.select(names)
            parts.append(part if mark is None else pa.RecordBatch.from_arrays([*part.columns, pa.array([mark[1](x) for x in texts], pa.binary())], names=[*names, mark[0]]))
            if split is None:
                whole.append(b.column(k))
                return
            for text in texts:
                ws = split(text)
                sizes.append(len(ws))
                codes.append(np.fromiter(map(index.__getitem__, ws), dtype=np.int32, count=len(ws)))

        def numbered() -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            rank = np.argsort(-np.bincount(flat, minlength=len(index)), kind="stable")
            place = np.empty(rank.size, dtype=np.int64)
            place[rank] = np.arange(rank.size)
            words = list(index)
            words = [words[i] if isinstance(words[i], bytes) else words[i].encode() for i in rank.tolist()]
            return np.array(sizes, dtype=np.int64), place[flat], b"".join(words), np.array([len(w) for w in words], dtype=np.int64)

        def close() -> pa.RecordBatch:
            nonlocal parts, whole, index, codes, sizes, size, seq
            counts, flat, words, spans = white_words(whole) if split is None else numbered()
            row = {
                "block": first + seq,
                "n_docs": counts.size,
                "n_bytes": size,
                "n_words": flat.size,
                "docs": pack_table(pa.Table.from_batches(parts)),
                "sizes": pack_ints(counts),
                "codes": pack_ints(flat),
                "words": squeeze(words),
                "spans": pack_ints(spans),
            }
            parts, whole, index, codes, sizes, size, seq = [], [], _Numbers(), [], [], 0, seq + 1
            give_back()
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for b in batches:
            lengths = np.asarray(pc.fill_null(pc.binary_length(b.column(k)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            for i, n in enumerate(lengths.tolist()):
                size += n + 16
                if size >= block_bytes:
                    take(b.slice(start, i + 1 - start))
                    yield close()
                    start = i + 1
            if start < b.num_rows:
                take(b.slice(start))
        if parts:
            yield close()

    return _bucketed(docs.mapInArrow(pack, BLOCKS))


_ARROW = pa.schema([(c, pa.binary() if c in ("docs", "sizes", "codes", "words", "spans") else pa.int64()) for c in (x.split()[0] for x in BLOCKS.split(", "))])


def _bucketed(blocks: DataFrame) -> DataFrame:
    """Written to the shared folder in buckets by block, so that what comes back for
    the blocks joins them where they lie: the documents are never shuffled.  The
    table's name goes at once; its files stay, and the plan knows them."""
    spark = blocks.sparkSession
    name = f"brambleq_{uuid.uuid4().hex}"
    path = work_dir(spark)
    options = {"path": path, "compression": "none", "parquet.block.size": str(32 << 20)}
    blocks.write.format("parquet").options(**options).bucketBy(shuffle_partitions(spark), "block").saveAsTable(name)
    passing(spark, path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def totals(blocks: DataFrame) -> tuple[int, int]:
    """Bytes of text, and words."""
    row = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def bucket_count(blocks: DataFrame, n_bytes: int) -> int:
    """Buckets of a key space: some for each shuffle partition, or as many more as
    keep one bucket's share of the text within BUCKET_BYTES."""
    return max(BUCKETS_A_PARTITION * shuffle_partitions(blocks.sparkSession), -(-n_bytes // BUCKET_BYTES), 1)


def by_bucket(rows: DataFrame, buckets: int):
    """``rows`` grouped by ``bucket``; the number of tasks grows with the buckets."""
    spark = rows.sparkSession
    return rows.repartition(max(shuffle_partitions(spark), -(-buckets // BUCKETS_A_PARTITION)), "bucket").groupBy("bucket")


def bounds(buckets: int, bits: int) -> np.ndarray:
    """Where the buckets of a key space of so many bits begin, and its last key."""
    return np.array([(b << bits) // buckets for b in range(buckets)] + [(1 << bits) - 1], dtype=np.uint64)


def cuts(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's keys begin among ascending keys, and the end."""
    at = np.searchsorted(keys, bounds(buckets, bits)[:-1])
    return np.append(at, keys.size)


def key_bits(words: int, spare: int = 6) -> int:
    """Bits of a key that tell so many words apart but for one in 2**spare, about."""
    return min(56, max(16, int(words).bit_length() + spare))


def shared_keys(blocks: DataFrame, keys_of: Callable[[Block], np.ndarray], buckets: int, bits: int, more: DataFrame | None = None) -> DataFrame:
    """(``block``, ``bucket``, ``marks``): for each block which of its keys another block holds too.
    ``keys_of`` gives a block's distinct keys below 2**bits, ascending; with ``more`` (rows by
    ``block``) it is called with the block and the Arrow table of its rows there."""

    def rows_of(b: Block, keys: np.ndarray) -> list[dict]:
        at, base = cuts(keys, buckets, bits), bounds(buckets, bits)
        return [{"bucket": i, "block": b.block, "n": int(at[i + 1] - at[i]), "keys": pack_ints(np.diff(keys[at[i] : at[i + 1]], prepend=base[i]))} for i in np.flatnonzero(np.diff(at)).tolist()]

    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in block_rows(batches):
            yield pa.RecordBatch.from_pylist(rows_of(b, keys_of(b)), schema)

    def send_with(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        for row in left.to_pylist():
            b = Block(row)
            out += rows_of(b, keys_of(b, right))
        return pa.Table.from_pylist(out, schema)

    def find(t: pa.Table) -> pa.Table:
        give_back()
        owner = t.column("block").to_pylist()
        sizes = t.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(unpack_ints(x)) for x in t.column("keys").to_pylist()])
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        mark = np.zeros(keys.size, dtype=bool)
        mark[order[1:]] |= same
        mark[order[:-1]] |= same
        ends = np.cumsum(sizes)
        marks = [mark[e - n : e] for e, n in zip(ends.tolist(), sizes, strict=True)]
        keep = [i for i, m in enumerate(marks) if m.any()]
        return pa.table({"block": pa.array([owner[i] for i in keep], pa.int64()), "bucket": pa.array([t.column("bucket")[0].as_py()] * len(keep), pa.int32()), "marks": pa.array([squeeze(np.packbits(marks[i]).tobytes()) for i in keep], pa.binary())})

    kind = "bucket int, block long, n long, keys binary"
    sent = blocks.mapInArrow(send, kind) if more is None else blocks.groupBy("block").cogroup(more.groupBy("block")).applyInArrow(send_with, kind)
    return by_bucket(sent, buckets).applyInArrow(find, "block long, bucket int, marks binary")


def marked(keys: np.ndarray, answers: list[dict], buckets: int, bits: int) -> np.ndarray:
    """Which of a block's keys ``shared_keys`` has marked; ``answers``: the block's rows."""
    at = cuts(keys, buckets, bits)
    out = np.zeros(keys.size, dtype=bool)
    for r in answers:
        if r["marks"] is not None:
            i = r["bucket"]
            n = int(at[i + 1] - at[i])
            out[at[i] : at[i + 1]] = np.unpackbits(np.frombuffer(unsqueeze(r["marks"]), np.uint8), count=n).astype(bool)
    return out
