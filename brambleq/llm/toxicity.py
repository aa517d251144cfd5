"""Toxic passages by maximum-scoring segments.

Tokens get log-odds between toxic and clean text under an informative Dirichlet
prior (each token's prior is its share of the whole sample), shrunk by the evidence
of the documents that hold them: odds of z standard errors keep 1 - (MIN_Z / z)**2
of themselves, and nothing below MIN_Z.  Words are tokens, and so are their
beginnings of four to six letters, the strongest of which counts for a word; odds for
clean text count against a passage as odds for toxic text count for it, and a small
drift keeps the mean word of clean text below zero.  One pass over a document finds
all its maximal scoring segments.  Scores of such segments follow an extreme-value
law, exp(-K n exp(-lambda S)): lambda solves sum(p exp(lambda s)) = 1 over the scores of
clean words, and K is the likeliest under the best segments of clean documents.  The law
turns segments into surprise, in nats, and keeps those that are significant in a
document of that length.  A logistic curve over the best segment's and all significant
segments' surprise gives the document's score.

The model is fitted on at most ``MAX_PER_CLASS`` labelled documents of each class,
chosen by the order of a hash of their ids; equal texts count once.  The law and the
curve are fitted on documents under a lexicon that other documents chose (``FOLDS``).

Defined results: a null or empty text has no segment and gets the lowest score of
its model; without labelled rows of both classes every score is 0; of several
labels of a document the highest counts, null labels are no labels; rows that
repeat score alike; an empty table gives an empty table; extra columns are kept, and one
that has an output's name is renamed to ``<name>_input``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brambleq.llm._common import extend, fold, give_way, materialise, table

MAX_PER_CLASS = 6000
BEGINNINGS = (4, 5, 6)
#: Sum of the prior's counts, as a share of the sample's.
PRIOR = 0.05
MIN_Z = 3.0
FOLDS = 4
#: What the mean word of clean text must score below zero at least.
DRIFT = 0.05
#: Nats from which a segment is significant.
MIN_NATS = 1.0
THRESHOLD = 0.7
#: Width of the bins in which scores of clean words are counted.
_BIN = 0.02
_WORD = re.compile(r"[^\W_]+")
_MEMO = 200_000


def tokens(word: str) -> Iterator[str]:
    yield word
    for n in BEGINNINGS:
        if len(word) > n:
            yield word[:n] + "*"


def lexicon(counts: dict[str, np.ndarray], docs: np.ndarray) -> dict[str, float]:
    """Shrunk log-odds of tokens; ``counts``: words (clean, toxic) and documents (clean, toxic)
    that hold each; ``docs``: documents of both classes."""
    names = list(counts)
    c = np.array([counts[t] for t in names], dtype=float).reshape(-1, 4)
    words, held = c[:, :2], c[:, 2:]
    total = words.sum(axis=0)
    if not names or not total.all() or not docs.all():
        return {}
    a = PRIOR * words.sum(axis=1) * (total / total.sum())[:, None]  # a row for each class
    n = words.T + a
    odds = np.log(n / (total[:, None] * (1 + PRIOR) - n))
    odds = odds[1] - odds[0]
    share = PRIOR * held.sum(axis=1) * (docs / docs.sum())[:, None]
    z = np.abs(odds) / np.sqrt((1 / (held.T + share)).sum(axis=0))
    keep = np.flatnonzero(z > MIN_Z)
    return {names[i]: float(odds[i] * (1 - (MIN_Z / z[i]) ** 2)) for i in keep}


class Model:
    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.drift, self.decay, self.k = DRIFT, 1.0, 1.0
        self.curve = np.array([-4.0, 1.0, 0.5])
        self.memo: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def score(self, word: str) -> float:
        s = self.memo.get(word)
        if s is None:
            if len(self.memo) > _MEMO:
                self.memo.clear()
            get = self.weights.get
            s = self.memo[word] = max((get(t, 0.0) for t in tokens(word)), key=abs) - self.drift
        return s

    def fit_scores(self, bins: dict[int, int]) -> None:
        """Drift and lambda from the scores of clean words, without drift, by bins."""
        at = np.array(sorted(bins), dtype=float) * _BIN
        p = np.array([bins[i] for i in sorted(bins)], dtype=float)
        if not p.size:
            return
        p /= p.sum()
        self.drift = max(DRIFT, float(p @ at) + DRIFT)
        self.memo.clear()
        self.decay = decay(at - self.drift, p)

    def fit_best(self, best: np.ndarray, n: np.ndarray) -> None:
        """K, the likeliest for the best segments of clean documents of n words."""
        heard = n > 0
        total = float((n[heard] * np.exp(-self.decay * best[heard])).sum())
        self.k = heard.sum() / total if total else 1.0

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """All maximal scoring segments (first character, end, score), and the number of words.

        Linear time: candidates are kept with the cumulative score before and after
        them, and merged with the latest one that starts lower (Ruzzo and Tompa)."""
        kept: list[list[float]] = []  # [left sum, right sum, start, end, index of the latest candidate with a lower left sum]
        total, n = 0.0, 0
        score = self.score
        for m in _WORD.finditer(text.lower() if text else ""):
            n += 1
            s = score(m.group())
            left, total = total, total + s
            if s <= 0:
                continue
            cand = [left, total, m.start(), m.end(), -1]
            while True:
                j = len(kept) - 1
                while j >= 0 and kept[j][0] >= cand[0]:
                    j = int(kept[j][4])
                cand[4] = j
                if j < 0 or kept[j][1] >= cand[1]:
                    kept.append(cand)
                    break
                cand = [kept[j][0], cand[1], kept[j][2], cand[3], -1]
                del kept[j:]
        return [(int(a), int(b), r - p) for p, r, a, b, _ in kept], n

    def nats(self, score: float, n: int) -> float:
        """-log of the chance that clean text of n words holds a segment of this score."""
        e = self.decay * score - math.log(self.k * max(n, 1))
        return e if e > 20 else -math.log(-math.expm1(-math.exp(-e)) or 1e-300)

    def features(self, text: str | None) -> tuple[float, float, list[tuple[int, int, float]]]:
        found, n = self.segments(text)
        best, total, passages = 0.0, 0.0, []
        for a, b, s in found:
            x = self.nats(s, n)
            best = max(best, x)
            if x >= MIN_NATS:
                total += x
                passages.append((a, b, x))
        return best, total, passages

    def probability(self, best: float, total: float) -> float:
        z = float(self.curve @ np.array([1.0, math.log1p(best), math.log1p(total)]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def fit_curve(self, x: np.ndarray, y: np.ndarray) -> Model:
        """Logistic regression by Newton's method, with a little ridge; slopes are not below zero."""
        a = np.column_stack([np.ones(len(x)), np.log1p(x)])
        w = np.zeros(3)
        ridge = np.diag([1e-3, 0.05, 0.05])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = a.T @ (a * (p * (1 - p))[:, None]) + ridge
            w = w - 0.7 * np.linalg.solve(h, a.T @ (p - y) + ridge @ w)
        for j in (1, 2):
            if w[j] < 0:
                keep = [0, 3 - j]
                w = np.zeros(3)
                b = a[:, keep]
                for _ in range(60):
                    p = 1 / (1 + np.exp(-np.clip(b @ w[keep], -30, 30)))
                    w[keep] -= 0.7 * np.linalg.solve(b.T @ (b * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), b.T @ (p - y))
        self.curve = w
        return self


def decay(scores: np.ndarray, p: np.ndarray) -> float:
    """lambda > 0 with sum(p exp(lambda s)) = 1; the mean score is below zero."""
    if scores.max() <= 0:
        return 1.0
    f = lambda x: float(p @ np.exp(np.minimum(700.0, x * scores))) - 1
    high = 1.0
    while f(high) < 0:
        high *= 2
    low = high
    while f(low) >= 0 and low > 1e-9:
        low /= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def _part(text: str | None) -> int:
    """The fold of a text."""
    return xxhash.xxh3_64_intdigest((text or "").encode(), 1) % FOLDS


def _sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(``text``, ``y``): the labelled documents that the model is fitted on."""
    known = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.max(F.col(label)).alias("__y"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_PER_CLASS)
        chosen = part if chosen is None else chosen.unionAll(part)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("__id"), "__y"))
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("__id"))
    return materialise(texts.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("__y").alias("y")).select("text", F.col("y").cast("int").alias("y")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and documents of both classes by token and fold; the empty token counts all documents."""
    seen: dict[tuple[int, str], list[int]] = {}
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            k = _part(text)
            held: Counter[str] = Counter({"": 0})
            for w, n in Counter(_WORD.findall((text or "").lower())).items():
                for t in tokens(w):
                    held[t] += n
            for t, n in held.items():
                row = seen.setdefault((k, t), [0, 0, 0, 0])
                row[y] += n
                row[2 + y] += 1
    yield pa.RecordBatch.from_arrays([pa.array([t for _, t in seen], pa.string()), pa.array([k for k, _ in seen], pa.int32()), *[pa.array([r[i] for r in seen.values()], pa.int64()) for i in range(4)]], names=["token", "fold", *_COUNTS])


_COUNTS = ("w0", "w1", "d0", "d1")


def _scores(shared):
    """Bins of the scores of clean words, each document under the model of its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: Counter[int] = Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = shared.value[_part(text)]
                if not y:
                    bins.update(round((m.score(w) + m.drift) / _BIN) for w in _WORD.findall((text or "").lower()))
        yield pa.RecordBatch.from_arrays([pa.array(list(bins), pa.int64()), pa.array(list(bins.values()), pa.int64())], names=["bin", "n"])

    return run


def _best(shared):
    """The best segment's score and the words of each document, and its features under the law so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = shared.value[_part(text)]
                found, n = m.segments(text)
                rows.append((max((s for *_, s in found), default=0.0), n, *m.features(text)[:2], y))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(5)], names=["best", "n", "one", "all", "y"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model | None:
    """A model from labelled documents (``doc_id``, ``text`` and ``doc_id``, ``label``)."""
    rows = _sample(docs, labels, label)
    context = docs.sparkSession.sparkContext
    counts = rows.mapInArrow(_count, "token string, fold int, w0 long, w1 long, d0 long, d1 long").groupBy("token", "fold").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    few = F.sum(F.col("d0") + F.col("d1"))
    got = counts.groupBy("token").agg(few.alias("held"), F.collect_list(F.struct("fold", *_COUNTS)).alias("folds")).where("held >= 3 or token = ''").toArrow()
    by_fold: dict[str, np.ndarray] = {}
    for t, parts in zip(got.column("token").to_pylist(), got.column("folds").to_pylist(), strict=True):
        x = by_fold[t] = np.zeros((FOLDS, 4), dtype=np.int64)
        for r in parts:
            x[r["fold"]] = [r[c] for c in _COUNTS]
    held = by_fold.pop("", np.zeros((FOLDS, 4), dtype=np.int64))[:, 2:]
    if not held.sum(axis=0).all():
        return None
    by_fold = dict(sorted(by_fold.items()))
    model = Model(lexicon({t: x.sum(axis=0) for t, x in by_fold.items()}, held.sum(axis=0)))
    others = [Model(lexicon({t: x.sum(axis=0) - x[k] for t, x in by_fold.items()}, held.sum(axis=0) - held[k])) for k in range(FOLDS)]

    bins = rows.mapInArrow(_scores(context.broadcast(others)), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    for m in (model, *others):
        m.fit_scores({r["bin"]: r["n"] for r in bins})

    def measure() -> dict[str, np.ndarray]:
        t = rows.mapInArrow(_best(context.broadcast(others)), "best double, n double, one double, all double, y double").toArrow()
        x = {c: t.column(c).to_numpy() for c in ("best", "n", "one", "all", "y")}
        order = np.lexsort((x["n"], x["best"], x["y"]))
        return {c: v[order] for c, v in x.items()}

    found = measure()
    clean = found["y"] == 0
    for m in (model, *others):
        m.fit_best(found["best"][clean], found["n"][clean])
    found = measure()
    return model.fit_curve(np.column_stack([found["one"], found["all"]]), found["y"])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` plus ``__score`` and ``__passages``: (start, end, nats) in characters of the lower-cased text."""
    passage = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("nats", T.DoubleType())]))
    docs = give_way(docs, "__score", "__passages")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = docs.columns.index("text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("nats", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores, passages = [], []
            for t in b.column(k).to_pylist():
                best, total, found = m.features(t) if m else (0.0, 0.0, [])
                scores.append(m.probability(best, total) if m else 0.0)
                passages.append([{"start": s, "end": e, "nats": x} for s, e, x in found])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(passages, kind)], names=[*b.schema.names, "__score", "__passages"])

    return extend(docs, run, [T.StructField("__score", T.DoubleType()), T.StructField("__passages", passage)], "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(fold("doc_id", 3) != 1), table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
