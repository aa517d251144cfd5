"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton is built from the normalised benchmark items; document words are
streamed through it, and at every word it knows the longest run of words that
ends there and occurs in some item.  A run of ``window`` words or more hits the
last ``window`` words; an item of fewer words is hit as a whole.

Items are loaded a bounded number of words at a time (``MAX_ITEM_WORDS``, a longer
item in parts that share a window's words less one): each load becomes one broadcast
automaton and one pass, and what a pass found is written before the next load's, so a
benchmark of any size costs passes, not memory, and nothing is shuffled.

Defined results: a null or empty text has no words and is clean; rows with a
null item id are no items; rows of an item that is listed twice are one item with
both texts; duplicate document rows are judged alike; an empty table gives an empty
table; extra columns are kept, and one that has an output's name is renamed to
``<name>_input`` (``clean`` has no outputs of its own).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brambleq.llm._common import aside, back, give_back, give_way, materialise, table, text_bytes

WINDOW = 10
#: Words of benchmark items in one automaton (about 300 bytes each once built).
MAX_ITEM_WORDS = 300_000
#: A document with a larger share of hit words is dropped by ``clean``.
MAX_COVERAGE = 0.5

_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        coded = []
        for item, words in items:
            codes = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            coded.append((item, codes))
            last = 0
            for c in codes:
                last = self._extend(last, c)
        n = len(self.link)
        #: The state of the suffix of ``window`` words of each state's strings.
        self.at: list[int] = list(range(n))
        order = sorted(range(n), key=self.length.__getitem__)
        for v in order:
            if v and self.length[self.link[v]] >= window:
                self.at[v] = self.at[self.link[v]]
        self.items: dict[int, set[str]] = {}
        ends: dict[int, list[tuple[int, str]]] = {}
        shortest = window
        for item, codes in coded:
            v = 0
            for i, c in enumerate(codes):
                v = self.next[v][c]
                if i + 1 >= window:
                    self.items.setdefault(self.at[v], set()).add(item)
            if 0 < len(codes) < window:
                ends.setdefault(v, []).append((len(codes), item))
                shortest = min(shortest, len(codes))
        self.shortest = shortest
        #: Whole short items that end in a state or in one of its suffixes.
        self.ends: dict[int, tuple[list[tuple[int, str]], int]] = {}
        above = [0] * n
        for v in order:
            if v:
                up = self.link[v]
                above[v] = up if up in ends else above[up]
                if v in ends or above[v]:
                    self.ends[v] = (ends.get(v, []), above[v])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return cur

    def _split(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans of word positions, end exclusive, and the items hit."""
        nxt, link, length, window, shortest, ends = self.next, self.link, self.length, self.window, self.shortest, self.ends
        v = run = 0
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        items: set[str] = set()
        for i, c in enumerate(map(self.vocab.get, words)):
            if c is None:
                v = run = 0
                continue
            t = nxt[v].get(c)
            while t is None and v:
                v = link[v]
                run = length[v]
                t = nxt[v].get(c)
            if t is None:
                continue
            v = t
            run += 1
            if run < shortest:
                continue
            if run >= window:
                spans.append((i + 1 - window, i + 1))
                states.add(self.at[v])
            if v in ends:
                u = v
                while u:
                    here, u = ends[u] if u in ends else ([], 0)
                    for n, item in here:
                        if n <= run:
                            spans.append((i + 1 - n, i + 1))
                            items.add(item)
        for s in states:
            items |= self.items[s]
        return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(items: DataFrame, window: int, max_words: int) -> Iterator[Automaton]:
    """Automata over successive loads of items; the driver holds one load at a time."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0  # an empty benchmark yields one empty automaton
    for row in items.select(F.col("item_id").cast("string").alias("i"), "text").where("item_id is not null and text is not null").toLocalIterator():
        whole = words_of(row[1].encode("utf-8"))
        step = max(max_words, window)
        for s in range(0, max(1, len(whole) - window + 1), step) if whole else ():
            words = whole[s : s + step + window - 1]
            if held and size + len(words) > max_words:
                yield Automaton(held, window)
                held, size = [], 0
            held.append((row[0], words))
            size += len(words)
    if held or not size:
        yield Automaton(held, window)


HIT = "__hit_spans"
ITEMS = "__hit_items"
COUNT = "__hit_words"


def match(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """``docs`` plus ``__hit_words`` (number of words), ``__hit_spans`` (merged spans of
    hit word positions) and ``__hit_items`` (ids of the items that occur, sorted)."""
    docs = give_way(docs, COUNT, HIT, ITEMS)
    return _match(aside(docs, "text"), items, window, max_item_words, False).toDF(*docs.columns, COUNT, HIT, ITEMS)


def _match(docs: DataFrame, items: DataFrame, window: int, max_item_words: int, cut: bool) -> DataFrame:
    """``cut``: the pass of the last load also cuts the hit spans from the text."""
    spark = docs.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out = docs.withColumn(COUNT, F.lit(None).cast("long")).withColumn(HIT, F.lit(None).cast(span)).withColumn(ITEMS, F.lit(None).cast("array<string>"))
    schema = out.schema
    loads = automata(items, window, max_item_words)
    now = next(loads)
    while now is not None:
        after = next(loads, None)
        shared = spark.sparkContext.broadcast(now)
        out = out.mapInArrow(_pass(shared, cut and after is None), schema)
        if after is not None:
            out = materialise(out)
            shared.destroy()
        now = after
    return out


def _pass(shared, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for b in batches:
            names = b.schema.names
            n_words, spans, items = [], [], []
            before = zip(b.column(names.index(HIT)).to_pylist(), b.column(names.index(ITEMS)).to_pylist(), strict=True)
            for text, (old_spans, old_items) in zip(text_bytes(b.column(names.index("text"))), before, strict=True):
                words = words_of(text)
                got, ids = a.scan(words)
                if old_spans:
                    got = merge(got + [(s["start"], s["end"]) for s in old_spans])
                n_words.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in got])
                items.append(sorted(ids | set(old_items or ())))
            columns = list(b.columns)
            if cut:
                k = names.index("text")
                texts = columns[k].to_pylist()
                for i, found in enumerate(spans):
                    if found:
                        texts[i] = cut_spans(texts[i].encode("utf-8"), [(x["start"], x["end"]) for x in found]).decode("utf-8")
                columns[k] = pa.array(texts, b.schema.field(k).type)
            for name, values in ((COUNT, n_words), (HIT, spans), (ITEMS, items)):
                k = names.index(name)
                columns[k] = pa.array(values, b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)
        give_back()

    return run


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """``docs`` without contamination, columns unchanged: hit spans are cut from the
    text (with what separates their words), documents whose share of hit words
    exceeds ``max_coverage`` are dropped, and ``n_chars`` follows where present."""
    found = _match(aside(docs, "text", "n_chars"), items, window, max_item_words, True)
    hit = F.aggregate(HIT, F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    out = found.where(hit <= F.col(COUNT) * F.lit(max_coverage))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(HIT) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(out, docs, "text", "n_chars")


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : at[s][0]])
        last = at[e][0] if e < len(at) else len(text)
    return b"".join([*out, text[last:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(HIT, F.lit(0), lambda acc, s: acc + s["end"] - s["start"]).cast("long")
    return found.select(
        "doc_id",
        F.col(COUNT).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ITEMS), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
