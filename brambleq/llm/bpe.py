"""Byte-pair encoding and decoding through one table of distinct words.

Documents are split into words by the tokenizer's own pattern and kept as blocks of
numbered words.  Every block deals its distinct words to buckets of the word space;
the bucket's words are the table: the merge algorithm gets each distinct word of the
corpus once, and each block the ids of its words.  There ids are joined to the
documents by position, with array gathers.  Decoding joins ids with the table of
pieces, whose size is the vocabulary's, and concatenates bytes.

A word costs an entry per block, so a word that every document holds is no hot key,
and documents stay where they are.

Text is exact: special tokens standing in a text are taken as the library takes
them, and texts with characters on which Unicode versions may disagree are split
by the library's own splitter.

Defined results: a null or empty text has no ids and decodes to the empty text;
null ids decode to null; a text of any length is encoded whole; rows that repeat
are encoded alike; an empty table gives an empty table; extra columns are kept, and
one that has an output's name is renamed to ``<name>_input``.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brambleq.llm._blocks import BLOCK_BYTES, Block, block_rows, bucket_count, by_bucket, frame, make_blocks, pack_ints, squeeze, totals, unframe, unpack_ints, unsqueeze
from brambleq.llm._common import aside, extend, free_name, give_back, give_way, table

#: The splitting pattern of byte-level tokenizers of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that every Unicode version classes alike.
_SETTLED = regex.compile(r"[\x00-ɀ‐-‧‰-⁞€]*")
#: Words handed to the merge algorithm at once.
BATCH_WORDS = 20_000
#: Bytes of ids that are decoded at once.
CHUNK_BYTES = 1 << 22
#: Bytes of text of a block whose documents come back with texts and ids.
_WIDE_BYTES = 2 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _unbyte() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes
    stand for themselves, the others follow from U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A tokenizer file: its splitting, its merges, and its table of pieces."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        letters = _unbyte()
        size = max([*self.tokenizer.get_vocab().values(), 0]) + 1
        pieces = [b""] * size
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            pieces[i] = bytes(letters[c] for c in piece)
        for piece, i in self.special.items():
            pieces[i] = piece.encode()
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.piece_size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size

    def split(self, text: str) -> list[str]:
        if self.cut and any(s in text for s in self.special):
            return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if text.isascii() or _SETTLED.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        out: list[list[int]] = []
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # the same ids, without offsets
        for i in range(0, len(words), BATCH_WORDS):
            out += [e.ids for e in run(words[i : i + BATCH_WORDS], add_special_tokens=False)]
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.piece_bytes[_gather(self.piece_at[ids], self.piece_size[ids])].tobytes().decode("utf-8", "replace")


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs laid end to end."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


@lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """One codec for all tasks of a worker."""
    return Codec(path)


class Splitter:
    """Words of a text, by a tokenizer that is read where it is first used."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, text: bytes) -> list[str]:
        return codec_of(self.path).split(text.decode())


def _by_bucket(words: list[bytes], buckets: int) -> list[tuple[int, list[int]]]:
    """Words' numbers by bucket, in the words' order."""
    to: dict[int, list[int]] = {}
    for i in sorted(range(len(words)), key=words.__getitem__):
        to.setdefault(xxhash.xxh3_64_intdigest(words[i]) % buckets, []).append(i)
    return sorted(to.items())


def _send(buckets: int):
    """Each block's distinct words, to the buckets of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in block_rows(batches):
            words = b.words()
            rows = [{"bucket": k, "block": b.block, "words": frame(squeeze(b"".join(words[i] for i in at)), pack_ints(np.array([len(words[i]) for i in at])))} for k, at in _by_bucket(words, buckets)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary())]))

    return run


def _encode(path: str):
    """Of one bucket: every distinct word encoded once, and its ids for the blocks that hold it."""

    def run(t: pa.Table) -> pa.Table:
        give_back()
        asked, table_ = [], {}
        for x in t.column("words").to_pylist():
            blob, sizes = unframe(x, 2)
            blob, ends = unsqueeze(blob), np.cumsum(unpack_ints(sizes)).tolist()
            asked.append([table_.setdefault(blob[a:b], len(table_)) for a, b in zip([0, *ends[:-1]], ends, strict=True)])
        ids = codec_of(path).encode([w.decode() for w in table_])
        size = np.array([len(x) for x in ids], dtype=np.int64)
        flat, starts = np.array([i for x in ids for i in x], dtype=np.int64), np.cumsum(size) - size
        out = [frame(pack_ints(size[k]), pack_ints(flat[_gather(starts[k], size[k])])) for k in (np.array(x, dtype=np.int64) for x in asked)]
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "ids": pa.array(out, pa.binary())})

    return run


def _joined(path: str, buckets: int, null: str, finish: Callable[[pa.Table, pa.Array, Codec, Callable[[], pa.Array]], pa.Table]):
    """Of one block: the ids of its words joined to its documents by position."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        codec = codec_of(path)
        found = dict(zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist(), strict=True))
        parts = []
        for row in left.to_pylist():
            b = Block(row)
            words, codes = b.words(), b.codes()
            size, start, flats, base = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
            for k, at in _by_bucket(words, buckets):
                n, flat = (unpack_ints(x).astype(np.int64) for x in unframe(found[k], 2))
                size[at], start[at] = n, base + np.cumsum(n) - n
                flats.append(flat)
                base += flat.size
            flat = np.concatenate(flats) if flats else np.zeros(0, np.int64)
            per_word = size[codes]
            ids = flat[_gather(start[codes], per_word)].astype(np.int32)
            before = np.concatenate(([0], np.cumsum(per_word)))
            offsets = before[np.append(b.starts, codes.size)]
            docs = b.docs()
            empty = docs.column(null).to_pylist()

            def texts(b: Block = b, words: list[bytes] = words, codes: np.ndarray = codes, empty: list[bool] = empty) -> pa.Array:
                """The texts again: a splitter's words are the whole text."""
                parts = [b"".join([words[c] for c in codes[s : s + n].tolist()]).decode() for s, n in zip(b.starts.tolist(), b.sizes.tolist(), strict=True)]
                return pa.array([None if e else x for e, x in zip(empty, parts, strict=True)], pa.string())

            parts.append(finish(docs, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), codec, texts))
        return pa.concat_tables(parts)

    return run


def _decoded(ids: pa.ListArray, codec: Codec) -> list[str | None]:
    flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    return [codec.decode(flat[offsets[i] : offsets[i + 1]]) if ok else None for i, ok in enumerate(ids.is_valid().to_pylist())]


def _code(docs: DataFrame, path: str | None, finish, schema, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    path = path or default_path()
    null = free_name(docs.columns, "null")
    blocks = make_blocks(docs.withColumn(null, F.col("text").isNull()), Splitter(path), block_bytes)
    buckets = bucket_count(blocks, totals(blocks)[0])
    answers = by_bucket(blocks.mapInArrow(_send(buckets), "bucket int, block long, words binary"), buckets).applyInArrow(_encode(path), "block long, bucket int, ids binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_joined(path, buckets, null, finish), schema)


def round_trip(docs: DataFrame, path: str | None = None, ids: str = "ids", out: str | None = "decoded") -> DataFrame:
    """``docs`` plus ``ids``, the ids of ``text`` as an array of int, and ``out``, the text decoded from them."""
    docs = give_way(docs, ids, *([out] if out else []))
    held_as = aside(docs, "text")
    names = held_as.columns
    kinds = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(out, T.StringType())] if out else [])]

    def finish(held: pa.Table, coded: pa.Array, codec: Codec, texts) -> pa.Table:
        columns = [texts() if c == "text" else held.column(c) for c in names]
        return pa.Table.from_arrays([*columns, coded, *([pa.array(_decoded(coded, codec), pa.string())] if out else [])], names=[*names, ids, *([out] if out else [])])

    return _code(held_as, path, finish, T.StructType([*held_as.schema.fields, *kinds]), _WIDE_BYTES).toDF(*docs.columns, *[f.name for f in kinds])


def encode(docs: DataFrame, path: str | None = None, out: str = "ids") -> DataFrame:
    """``docs`` plus ``out``: the ids of ``text`` as an array of int."""
    return round_trip(docs, path, out, None)


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` plus ``out``: the text of the ids."""
    path = path or default_path()
    docs = give_way(docs, out)
    k = docs.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for b in batches:
            for s, e in _slices(b.column(k)):
                part = b.slice(s, e - s)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_decoded(part.column(k), codec), pa.string())], names=[*b.schema.names, out])

    return extend(docs, run, [T.StructField(out, T.StringType())], ids)


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of a batch in slices of about CHUNK_BYTES of ids."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.multiply(pc.list_value_length(column), 4), 0))
    start, run = 0, 0
    for i, n in enumerate(sizes.tolist()):
        run += n
        if run >= CHUNK_BYTES:
            yield start, i + 1
            start, run = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(held: pa.Table, coded: pa.Array, codec: Codec, texts) -> pa.Table:
    flat, offsets = coded.values.to_numpy(zero_copy_only=False).astype("<u4"), coded.offsets.to_numpy()
    cuts = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    ids = [hashlib.sha256(flat[s:e].tobytes()).hexdigest() for s, e in cuts]
    text = [hashlib.sha256(t.encode()).hexdigest() for t in _decoded(coded, codec)]
    return pa.table({"doc_id": held.column("doc_id"), "n_tokens": pa.array([e - s for s, e in cuts], pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(text, pa.string())})


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): the number of ids, and digests of the ids and of the decoded text."""
    return _code(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, _digests, _DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
