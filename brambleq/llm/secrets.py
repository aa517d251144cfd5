"""Secret scan: fixed patterns, plus windows of high entropy.

Patterns give the base spans: credentials that are assigned, access keys, long
hexadecimal runs.  The entropy scan adds spans of kind ``entropy``: candidate
strings are cut into runs of one character class (hexadecimal digits, letters and
digits, base64 characters); a window slides over each run with Shannon entropy
kept by incremental counts, and the windows at or above the class's threshold
join into spans.  Strings on the allow list (dates, numbers, identifiers in a fixed
format, words) are suppressed.

Defined results: a null or empty text has no spans; a text of any length is
scanned whole; spans may overlap across kinds, and all are reported; rows that
repeat are scanned alike; an empty table gives an empty table; extra columns are kept, and
one that has an output's name is renamed to ``<name>_input`` (``redact`` has no outputs of
its own).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brambleq.llm._common import aside, back, extend, give_way, table

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Characters of the sliding window.
WINDOW = 20
#: Classes from narrow to wide: characters, and bits a character that a window must reach.
CLASSES = (("hex", re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}"), 3.0), ("alnum", re.compile(r"[A-Za-z0-9]{20,}"), 3.7), ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.9))
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Strings that are no secrets: numbers, dates, dotted or dashed identifiers of
#: fixed format, paths, and strings of letters in at most one case change.
ALLOWED = (
    re.compile(r"[0-9_-]+"),
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"\d{4}-\d{2}-\d{2}(?:[T_-][0-9-]+Z?)?"),
    re.compile(r"[A-Z]?[a-z]+(?:[-_/][A-Z]?[a-z]+)*[-_/=]*|[A-Z]+(?:[-_/][A-Z]+)*"),
    re.compile(r"(.{1,4})\1{4,}.{0,4}"),
)


def windows(run: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of ``run`` covered by windows whose entropy is at least ``least`` bits a
    character.  With counts c, entropy is log2(n) - sum(c * log2(c)) / n; one step of
    the window changes two terms of the sum."""
    n = window
    if len(run) < n:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, n + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    most = (math.log2(n) - least) * n + 1e-9
    out: list[tuple[int, int]] = []
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
        if i >= n:
            old = run[i - n]
            c = counts[old]
            total += term[c - 1] - term[c]
            counts[old] = c - 1
        if i >= n - 1 and total <= most:
            s, e = i - n + 1, i + 1
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], e)
            else:
                out.append((s, e))
    return out


def prose(part: str) -> bool:
    """Digits alone are a number; letters alone are words run together, unless their case
    changes so often that the words would have fewer than three letters on average."""
    return part.isdigit() or (part.isalpha() and len(part) >= 3 * len(_WORD.findall(part)))


def entropy_spans(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for m in _CANDIDATE.finditer(text):
        s = m.group()
        if any(a.fullmatch(s) for a in ALLOWED):
            continue
        found: list[tuple[int, int]] = []
        for _, shape, least in CLASSES:
            for r in shape.finditer(s):
                part = r.group()
                if prose(part):
                    continue
                found += [(a + r.start(), b + r.start()) for a, b in windows(part, least)]
        found.sort()
        for a, b in found:
            a, b = a + m.start(), b + m.start()
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), by start, then kind."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(c in low for c in _CUES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + [(a, 3, b) for a, b in entropy_spans(text)])


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``__base`` and ``__spans``: arrays of (kind, start, end) in code points, end exclusive."""
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    docs = give_way(docs, "__base", "__spans")
    k = docs.columns.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [find(x) for x in b.column(k).to_pylist()]
            cols = [pa.array([[{"kind": KINDS[c], "start": s, "end": e} for s, c, e in spans[i]] for spans in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "__base", "__spans"])

    return extend(docs, run, [T.StructField("__base", span), T.StructField("__spans", span)], "text")


def redact(docs: DataFrame, mask: str = "<secret>") -> DataFrame:
    """``docs`` with each maximal run of overlapping spans replaced by ``mask``; columns unchanged."""
    found = scan(aside(docs, "text"))
    k = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, spans in zip(b.column(k).to_pylist(), b.column(b.schema.names.index("__spans")).to_pylist(), strict=True):
                out, last = [], 0
                for s in spans:
                    if s["start"] >= last:
                        out += [text[last : s["start"]], mask]
                    last = max(last, s["end"])
                texts.append(text if not spans else "".join([*out, text[last:]]))
            columns = list(b.columns)
            columns[k] = pa.array(texts, b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return back(found.mapInArrow(run, found.schema), docs, "text")


def joined(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined("__base").cast("binary"), 256).alias("base_sha256"), joined("__spans").alias("spans"))


def brute_base(text: str) -> str:
    """The base spans' digest by the definition alone, for tests."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)).encode()).hexdigest()
