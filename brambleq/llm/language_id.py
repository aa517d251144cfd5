"""Language identification with a byte convolutional network.

Fixed-length windows of a text's bytes pass filters of several widths, a max
pool over positions and a softmax.  The network is trained in numpy on windows of
labelled documents: at most ``DOCS_PER_LANGUAGE`` documents of each of the
``MAX_LANGUAGES`` most frequent languages, those with the smallest hashes of their ids,
and ``WINDOWS_PER_DOC`` windows of each.  A text of any length is cut into windows that cover it wholly, classified
in batches, and the windows' log-probabilities are averaged.

With one filter bank, the products of embeddings and filters depend on two
neighbouring bytes at a time, so classification reads them from tables.

Defined results: a text that is null or has no letter is ``und`` with score 0;
without any labelled row all texts are ``und``; ties go to the first language in
alphabetical order; a null id is in no training set and not held out; rows that repeat
are judged alike, and of those that repeat an id all may be learnt from; an empty table
gives an empty table; extra columns are kept, and one that has an output's name is renamed
to ``<name>_input`` (``keep`` has no outputs of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brambleq.llm._common import aside, back, extend, fold, give_back, give_way, table, text_bytes

WINDOW = 96
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
DOCS_PER_LANGUAGE = 500
WINDOWS_PER_DOC = 6
MAX_LANGUAGES = 400
MAX_DOCS = 20_000
EPOCHS = 6
#: ``keep`` rejects documents below this score, and those without a letter.
MIN_SCORE = 0.4
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_BATCH = 512
# A-Z to a-z, digits to one digit, white space to a blank: no language differs in these.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c < 32 else c for c in range(256)], dtype=np.uint8)


def windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """The bytes of ``text`` as rows of ``size``; the last row ends with the text, a short text is padded."""
    b = _FOLD[np.frombuffer(text, dtype=np.uint8)]
    if b.size < size:
        return np.pad(b, (0, size - b.size))[None, :]
    n = b.size // size
    rows = b[: n * size].reshape(n, size)
    return rows if b.size % size == 0 else np.concatenate((rows, b[-size:][None, :]))


class Network:
    def __init__(self, langs: list[str], seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.langs = langs
        self.embed = (r.standard_normal((256, EMBED)) * 0.5).astype(np.float32)
        self.filters = [(r.standard_normal((w * EMBED, FILTERS)) / np.sqrt(w * EMBED)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (r.standard_normal((FILTERS * len(WIDTHS), len(langs))) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)
        self.tables: list[np.ndarray] | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> Network:
        """Adam on cross-entropy, batches of 128."""
        r = np.random.default_rng(seed)
        params = [self.embed, *self.filters, *self.bias, self.out, self.out_bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(order), 128):
                k = order[i : i + 128]
                grads = self._grads(x[k], y[k])
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _grads(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, length = x.shape
        e = self.embed[x]
        cols, pooled, tops = [], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            c = np.concatenate([e[:, j : length - w + 1 + j] for j in range(w)], axis=2)
            a = c @ f + b
            top = a.argmax(axis=1)
            cols.append(c)
            tops.append(top)
            pooled.append(np.take_along_axis(a, top[:, None, :], 1)[:, 0])
        h = np.concatenate(pooled, axis=1)
        act = np.maximum(h, 0)
        z = act @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        g_out, g_ob = act.T @ p, p.sum(axis=0)
        gh = (p @ self.out.T) * (h > 0)
        g_embed = np.zeros_like(self.embed)
        g_f, g_b = [], []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = gh[:, i * FILTERS : (i + 1) * FILTERS]
            rows = np.arange(n)[:, None]
            hit = cols[i][rows, tops[i]]  # of each filter, the columns where its maximum stood
            g_f.append(np.einsum("nkd,nk->dk", hit, g))
            g_b.append(g.sum(axis=0))
            back = (g[:, :, None] * f.T[None]).reshape(n, FILTERS, w, EMBED)
            at = x[rows[:, :, None], tops[i][:, :, None] + np.arange(w)]
            np.add.at(g_embed, at.reshape(-1), back.reshape(-1, EMBED))
        return [g_embed, *g_f, *g_b, g_out, g_ob]

    def prepare(self) -> Network:
        """Tables of the filters' responses to two neighbouring bytes, and to one."""
        e = self.embed
        pair = lambda f, j: ((e @ f[j * EMBED : (j + 1) * EMBED])[:, None, :] + (e @ f[(j + 1) * EMBED : (j + 2) * EMBED])[None, :, :]).reshape(65536, FILTERS)
        one = lambda f, j: e @ f[j * EMBED : (j + 1) * EMBED]
        f2, f3, f4 = self.filters
        b2, b3, b4 = self.bias
        self.tables = [np.ascontiguousarray(np.concatenate((pair(f2, 0) + b2, pair(f3, 0) + b3, pair(f4, 0) + b4), axis=1)), np.ascontiguousarray(one(f3, 2)), np.ascontiguousarray(pair(f4, 2))]
        return self

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log-softmax of each window (rows of bytes)."""
        if self.tables is None:
            self.prepare()
        head, third, tail = self.tables
        out = np.empty((len(x), len(self.langs)), np.float32)
        for i in range(0, len(x), _BATCH):
            b = x[i : i + _BATCH].astype(np.int32)
            pairs = b[:, :-1] * 256 + b[:, 1:]
            a = head[pairs]
            two = a[:, :, :FILTERS].max(axis=1)
            three = (a[:, :-1, FILTERS : 2 * FILTERS] + third[b[:, 2:]]).max(axis=1)
            four = (a[:, :-2, 2 * FILTERS :] + tail[pairs[:, 2:]]).max(axis=1)
            z = np.maximum(np.concatenate((two, three, four), axis=1), 0) @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            out[i : i + _BATCH] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Network | None:
    """A network fitted on a bounded sample of ``labelled``: see the module's text."""
    ids = labelled.select(F.col(key).alias("__k"), F.col(lang).alias("__l")).where("__k is not null and __l is not null").withColumn("__o", F.xxhash64("__k"))
    # below such a hash stand about twice as many documents of a language as are wanted; one task need not see more
    counts = ids.groupBy("__l").agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), "__l").limit(MAX_LANGUAGES)
    share = F.least(F.lit(1.0), F.lit(2.0 * DOCS_PER_LANGUAGE + 100) / F.col("__n"))
    least = F.broadcast(counts.select("__l", share.alias("__share")))
    small = ids.join(least, "__l").where((F.col("__o") / F.lit(2.0**64) + 0.5) <= F.col("__share"))
    rank = F.row_number().over(Window.partitionBy("__l").orderBy("__o", "__k"))
    chosen = small.withColumn("__r", rank).where(F.col("__r") <= DOCS_PER_LANGUAGE).orderBy("__r", "__l", "__o").limit(MAX_DOCS).select("__k").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, rows = [], []
            for t, name, k in zip(text_bytes(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = windows(t)
                pick = np.random.default_rng(abs(hash(k)) if isinstance(k, int) else 0).permutation(len(w))[:WINDOWS_PER_DOC]
                for i in sorted(pick.tolist()):
                    langs.append(name)
                    rows.append(w[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["lang", "window"])

    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k")).where("l is not null and t is not null").join(F.broadcast(chosen), F.col("k") == F.col("__k"), "left_semi").select("t", "l", "k")
    got = rows.mapInArrow(cut, "lang string, window binary").toArrow().to_pydict()
    if not got["lang"]:
        return None
    langs = sorted(set(got["lang"]))
    order = sorted(range(len(got["lang"])), key=lambda i: (got["lang"][i], got["window"][i]))
    x = np.stack([np.frombuffer(got["window"][i], np.uint8) for i in order])
    y = np.array([langs.index(got["lang"][i]) for i in order])
    return Network(langs).fit(x, y)


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``docs`` plus ``__lang`` and ``__score`` (the windows' geometric mean probability)."""
    docs = give_way(docs, "__lang", "__score")
    k = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        if net:
            net.prepare()
        for b in batches:
            langs: list[str] = []
            scores: list[float] = []
            held: list[np.ndarray] = []
            marks: list[int] = []

            def flush() -> None:
                if held:
                    sizes = np.array([len(w) for w in held])
                    p = net.log_probs(np.concatenate(held)).astype(np.float64)
                    mean = np.add.reduceat(p, np.cumsum(sizes) - sizes) / sizes[:, None]
                    mean = np.exp(mean)
                    mean /= mean.sum(axis=1, keepdims=True)
                    for i, row in zip(marks, mean, strict=True):
                        langs[i], scores[i] = net.langs[int(row.argmax())], float(row.max())
                    held.clear()
                    marks.clear()

            size = 0
            for i, t in enumerate(b.column(k).to_pylist()):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                if net and t and _LETTER.search(t):
                    held.append(windows(t.encode()))
                    marks.append(i)
                    size += len(held[-1])
                    if size > 8 * _BATCH:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs), pa.array(scores, pa.float64())], names=[*b.schema.names, "__lang", "__score"])
        give_back()

    return extend(docs, run, [T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())], text)


def keep(docs: DataFrame, network: Network | None, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those that are undetermined or score below ``min_score``."""
    kept = predict(aside(docs, "text"), network).where((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= min_score))
    return back(kept, docs, "text")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id", 3) != 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = train(training_rows(docs.select("doc_id", "text", "lang")))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return predict(docs.select("doc_id", "text"), network).select("doc_id", held.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
