"""Scores under a log-bilinear language model, beside an add-one unigram.

Statistics cover every training token.  Blocks of documents send their distinct
words with counts to buckets of the word space, and get the corpus-wide counts
back, so a word costs an entry per block.  The most frequent words (more of them
the larger the corpus) become classes of the model.  Every other word falls into a
class by the kind of documents that hold it and by its ending: kinds are the
``KINDS`` centres that all training documents' byte-pair profiles gather around
(Lloyd's rounds, each a sum over all documents), which tells languages apart; a word
that no training document holds takes the kind nearest to its own profile.

The model predicts a word's class from its two predecessors', each through a matrix
of its own, and then the word within its class by add-one counts, an unseen word
taking the place of one more word, so every word of the corpus has a probability.
It is trained in numpy with noise-contrastive estimation (a step's tokens share its
draws of noise, so their scores are one matrix product), on all blocks at once: in
each of ``ROUNDS`` every task passes over a share of its blocks' training tokens, from the
parameters that the round before left, and the rounds' shares make up every training token
(in small inputs further steps take draws); the tasks' parameters are averaged, weighted by
their steps.  No token is left out, and nothing that grows with the corpus is gathered.  Scoring uses matrix products over a block's
distinct contexts and normalises exactly over all classes.

Memory: one block and the model in a worker; a bucket answers for a bounded share of
the text; the driver holds the frequent words and the parameters.

Defined results: a null or empty text is its end alone; without training rows all
counts are zero and the model is uniform; rows with a null id are scored, not
learnt from and not held out; rows that repeat are learnt from and scored each; an
empty table gives an empty table; only ``doc_id``, ``text`` and the two given columns are
read, so other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambleq.llm._blocks import Block, block_rows, bucket_count, by_bucket, make_blocks, pack_ints, squeeze, totals, unpack_ints, unsqueeze
from brambleq.llm._common import fold, materialise, table

#: Classes of frequent words for each doubling of the training tokens, and at most.
TOP_A_DOUBLING, MAX_TOP = 8, 512
#: A word of a smaller share of all words than one in so many is not among the frequent ones.
RAREST_TOP = 20_000
#: Kinds of documents, and classes by ending within a kind.
KINDS, ENDINGS = 8, 8
RARE_CLASSES = KINDS * ENDINGS
#: Places of a profile, Lloyd's rounds, and documents among which their first centres are chosen.
PROFILE, LLOYD, SEEDS = 64, 6, 2000
CONTEXT = 2
DIMENSIONS = 24
#: Draws of noise for a step, shared by its tokens, so that their scores are a matrix product.
NOISE = 64
ROUNDS = 3
#: Steps at least for each block and round, and for each task and round: where the tokens are fewer, draws follow.
STEPS, LEAST_STEPS = 80, 300
BATCH = 1024
END = b""  # no word is empty


def _split(text: bytes) -> list[bytes]:
    """Lower-cased words, and the end."""
    return [*text.lower().split(), END]


def profile(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs."""
    b = np.frombuffer(text.lower(), dtype=np.uint8).astype(np.int64)
    n = np.bincount((b[:-1] * 257 + b[1:]) * 0x9E3779B1 >> 12 & PROFILE - 1, minlength=PROFILE) if b.size > 1 else np.zeros(PROFILE)
    return np.sqrt(n / max(1, n.sum())).astype(np.float32)


def _profile(text: bytes) -> bytes:
    return np.round(profile(text) * 255).astype(np.uint8).tobytes()


def nearest(profiles: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * profiles @ centres.T).argmin(axis=1)


class Docs:
    """A block's documents without their words."""

    def __init__(self, b: Block) -> None:
        t = b.docs()
        self.ids = t.column("doc_id").to_pylist()
        self.train = np.array([bool(x) for x in t.column("train").to_pylist()], dtype=bool)
        self.held = t.column("held").to_pylist()
        self.profiles = np.frombuffer(b"".join(t.column("profile").to_pylist()), dtype=np.uint8).reshape(-1, PROFILE).astype(np.float32) / 255


def kinds(blocks: DataFrame) -> np.ndarray:
    """The centres of the training documents' profiles."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in block_rows(batches):
            d = Docs(b)
            at = np.flatnonzero(d.train)[:16]
            yield pa.RecordBatch.from_pydict({"h": pa.array([xxhash.xxh3_64_intdigest(str((b.block, i)).encode()) >> 1 for i in at.tolist()], pa.int64()), "p": pa.array([d.profiles[i].tobytes() for i in at.tolist()], pa.binary())})

    held = blocks.select("block", "docs", "sizes")
    first = held.mapInArrow(some, "h long, p binary").orderBy("h", "p").limit(SEEDS).collect()
    if not first:
        return np.zeros((KINDS, PROFILE), np.float32)
    x = np.stack([np.frombuffer(bytes(r["p"]), dtype=np.float32) for r in first])
    chosen = [x.mean(axis=0)]
    for _ in range(KINDS):  # each next centre far from all before
        d = np.min([((x - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        chosen.append(x[int(np.argsort(d, kind="stable")[int(0.98 * (len(x) - 1))])])
    centres = np.stack(chosen[1:])
    for _ in range(LLOYD):

        def gather(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((KINDS, PROFILE)), np.zeros(KINDS, np.int64)
            for b in block_rows(batches):
                d = Docs(b)
                p = d.profiles[d.train]
                near = nearest(p, centres)
                np.add.at(total, near, p)
                n += np.bincount(near, minlength=KINDS)
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(KINDS), pa.int32()), "n": pa.array(n), "total": pa.array(list(total), pa.list_(pa.float64()))})

        sums = held.mapInArrow(gather, "k int, n long, total array<double>").groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(PROFILE)]).collect()
        centres = centres.copy()
        for r in sums:
            if r["n"]:
                # rounded, so that the order of a sum does not show
                centres[r["k"]] = np.round([r[f"t{i}"] / r["n"] for i in range(PROFILE)], 6)
    return centres.astype(np.float32)


def _by_bucket(words: list[bytes], buckets: int) -> list[tuple[int, list[int]]]:
    """Words' numbers by bucket, in the words' order."""
    to: dict[int, list[int]] = {}
    for i in sorted(range(len(words)), key=words.__getitem__):
        to.setdefault(xxhash.xxh3_64_intdigest(words[i]) % buckets, []).append(i)
    return sorted(to.items())


def _send(buckets: int, centres: np.ndarray):
    """Each block's distinct words with their training counts, and the kind of most of them (KINDS: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in block_rows(batches):
            d, words, codes = Docs(b), b.words(), b.codes()
            learn = np.repeat(d.train, b.sizes)
            kind = np.repeat(nearest(d.profiles, centres), b.sizes)[learn]
            codes = codes[learn]
            votes = np.bincount(codes * KINDS + kind, minlength=len(words) * KINDS).reshape(-1, KINDS)
            counts = votes.sum(axis=1)
            most = np.where(counts > 0, votes.argmax(axis=1), KINDS)
            rows = _by_bucket(words, buckets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in rows], pa.int32()),
                    pa.array([b.block] * len(rows), pa.int64()),
                    pa.array([squeeze(b" ".join(words[i] for i in at)) for _, at in rows], pa.binary()),
                    pa.array([pack_ints(counts[at]) for _, at in rows], pa.binary()),
                    pa.array([pack_ints(most[at]) for _, at in rows], pa.binary()),
                ],
                names=["bucket", "block", "words", "counts", "kinds"],
            )

    return run


_COUNTED = "block long, bucket int, counts binary, kinds binary, tokens long, words long, rare_tokens array<long>, rare_words array<long>, top_words array<binary>, top_counts array<long>, top_rare array<long>"
_COUNTED_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("kinds", pa.binary()), ("tokens", pa.int64()), ("words", pa.int64()), ("rare_tokens", pa.list_(pa.int64())), ("rare_words", pa.list_(pa.int64())), ("top_words", pa.list_(pa.binary())), ("top_counts", pa.list_(pa.int64())), ("top_rare", pa.list_(pa.int64()))])


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def _count(centres: np.ndarray, n_words: int):
    """Of one bucket: corpus-wide counts and kinds for each block, and a row of totals without a block."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        index: dict[bytes, int] = {}
        asked, at, counts, near = [], [], [], []
        for block, words, n, k in zip(t.column("block").to_pylist(), t.column("words").to_pylist(), t.column("counts").to_pylist(), t.column("kinds").to_pylist(), strict=True):
            at.append(np.array([index.setdefault(w, len(index)) for w in unsqueeze(words).split(b" ")], dtype=np.int64))
            asked.append(block)
            counts.append(unpack_ints(n).astype(np.int64))
            near.append(unpack_ints(k).astype(np.int64))
        votes = np.zeros((len(index), KINDS + 1), dtype=np.int64)
        np.add.at(votes, (np.concatenate(at), np.concatenate(near)), np.concatenate(counts))
        total, names = votes.sum(axis=1), list(index)
        kind = votes[:, :KINDS].argmax(axis=1)
        new = np.flatnonzero(total == 0)
        if new.size:
            kind[new] = nearest(np.stack([profile(b" " + names[i] + b" ") for i in new.tolist()]), centres)
        rows = [{"block": block, "bucket": bucket, "counts": pack_ints(total[i]), "kinds": pack_ints(kind[i])} for block, i in zip(asked, at, strict=True)]
        known = np.flatnonzero(total)
        rare = kind[known] * ENDINGS + np.array([_ending(names[i]) for i in known.tolist()], dtype=np.int64)
        tokens = np.zeros(RARE_CLASSES, np.int64)
        np.add.at(tokens, rare, total[known])
        often = total[known] * RAREST_TOP >= n_words
        top = sorted(((-int(total[i]), names[i], int(r)) for i, r in zip(known[often].tolist(), rare[often].tolist(), strict=True)))[:MAX_TOP]
        rows.append({"block": None, "bucket": bucket, "tokens": int(total.sum()), "words": int(known.size), "rare_tokens": tokens.tolist(), "rare_words": np.bincount(rare, minlength=RARE_CLASSES).tolist(), "top_words": [w for _, w, _ in top], "top_counts": [-c for c, _, _ in top], "top_rare": [r for *_, r in top]})
        return pa.Table.from_pylist(rows, _COUNTED_ARROW)

    return run


class Vocabulary:
    """The frequent words, and what the other classes hold."""

    def __init__(self, counted: DataFrame) -> None:
        sums = counted.where("block is null")
        self.tokens, self.words = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        size = min(MAX_TOP, TOP_A_DOUBLING * max(1, int(self.tokens).bit_length()))
        top = sums.select(F.explode(F.arrays_zip("top_words", "top_counts", "top_rare")).alias("t")).select("t.*").orderBy(F.desc("top_counts"), "top_words").limit(size).collect()
        best = [(bytes(r[0]), r[1], r[2]) for r in top]
        if END not in [w for w, *_ in best]:
            best = [*best[: size - 1], (END, 0, 0)]
        self.top = {w: i for i, (w, *_) in enumerate(best)}
        self.size = len(best)  # classes of frequent words
        rare = sums.select(F.posexplode(F.arrays_zip("rare_tokens", "rare_words")).alias("i", "r")).groupBy("i").agg(F.sum("r.rare_tokens"), F.sum("r.rare_words")).collect()
        self.rare_tokens, self.rare_words = np.zeros(RARE_CLASSES, np.int64), np.zeros(RARE_CLASSES, np.int64)
        for i, a, b in rare:
            self.rare_tokens[i], self.rare_words[i] = a, b
        for _, c, r in best:
            if c:
                self.rare_tokens[r] -= c
                self.rare_words[r] -= 1
        counts = np.concatenate(([c for _, c, _ in best], self.rare_tokens))
        #: Class shares, none of them zero.
        self.unigram = (counts + 1e-6 * max(1, counts.sum())) / (counts.sum() + 1e-6 * max(1, counts.sum()) * counts.size)

    def classes(self, words: list[bytes], kind: np.ndarray) -> np.ndarray:
        top, base = self.top, self.size
        return np.array([top[w] if w in top else base + k * ENDINGS + _ending(w) for w, k in zip(words, kind.tolist(), strict=True)], dtype=np.int64)


_CODED = "block long, docs binary, sizes binary, codes binary, counts binary, classes binary"
_CODED_ARROW = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("docs", "sizes", "codes", "counts", "classes")]])


def _code(vocabulary, buckets: int):
    """Of one block: its documents as numbers, with each number's count and class instead of its word."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {r["bucket"]: r for r in right.to_pylist()}
        out = []
        for row in left.to_pylist():
            b = Block(row)
            words = b.words()
            counts, kind = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for k, at in _by_bucket(words, buckets):
                counts[at], kind[at] = unpack_ints(found[k]["counts"]), unpack_ints(found[k]["kinds"])
            out.append({c: row[c] for c in ("block", "docs", "sizes", "codes")} | {"counts": pack_ints(counts), "classes": pack_ints(vocabulary.value.classes(words, kind))})
        return pa.Table.from_pylist(out, _CODED_ARROW)

    return run


def _contexts(b: Block, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token, and its context's code; before a text stands its predecessor's end."""
    c = unpack_ints(b.row["classes"]).astype(np.int64)
    c = c[b.codes()] if c.size else c
    end = c[-1] if c.size else 0
    one = np.concatenate(([end], c[:-1]))
    two = np.concatenate(([end, end], c[:-2])) if c.size > 1 else np.full(c.size, end)
    two[b.starts] = end  # the word before the last belongs to another text
    return c, (two * classes + one)[: c.size]


class LogBilinear:
    """P(c | a, b) in proportion to exp(q_c . (A r_a + B r_b) + bias_c)."""

    def __init__(self, unigram: np.ndarray, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        n = self.classes = unigram.size
        self.unigram = unigram
        self.read = (0.1 * r.standard_normal((n, DIMENSIONS))).astype(np.float32)
        self.target = (0.1 * r.standard_normal((n, DIMENSIONS))).astype(np.float32)
        self.mix = [np.eye(DIMENSIONS, dtype=np.float32) * 0.5 for _ in range(CONTEXT)]
        self.bias = np.log(unigram).astype(np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.read, self.target, *self.mix, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params()])

    def _views(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([p.size for p in self.params()])
        return [part.reshape(p.shape) for part, p in zip(np.split(flat, ends[:-1]), self.params(), strict=True)]

    def load(self, flat: np.ndarray) -> LogBilinear:
        for p, part in zip(self.params(), self._views(flat), strict=True):
            p[...] = part
        return self

    def fit(self, contexts: np.ndarray, classes: np.ndarray, steps: int, seed: int = 5, rate: float = 0.02, order: np.ndarray | None = None) -> LogBilinear:
        """Noise-contrastive estimation on the tokens and their contexts: ``one_pass`` steps take those
        of the order (all, shuffled), steps beyond take draws from all.  Noise is drawn by class
        frequency, for each step anew, one draw in each of NOISE equal shares; each of the step's tokens
        is told from all of it."""
        if not classes.size:
            return self
        r = np.random.default_rng(seed)
        n = self.classes
        log_noise = np.log(NOISE * self.unigram).astype(np.float32)
        cum_noise = np.cumsum(self.unigram)
        strata = np.arange(NOISE)
        small = np.min_scalar_type(n)  # of 16 bits, which sort by radix
        flat = self.flat()  # all parameters and gradients lie in one array each, so a step updates them at once
        self.read, self.target, *self.mix, self.bias = self._views(flat)
        d, first, second = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
        grads = self._views(d)
        order = r.permutation(classes.size) if order is None else order
        for step in range(1, steps + 1):
            k = order[(step - 1) * BATCH : step * BATCH]
            k = np.concatenate((k, r.integers(0, classes.size, BATCH - k.size)))
            y, b, a = classes[k].astype(small), (contexts[k] % n).astype(small), (contexts[k] // n).astype(small)
            noise = np.minimum(np.searchsorted(cum_noise, (strata + r.random(NOISE)) / NOISE), n - 1).astype(small)
            ra, rb = self.read[a], self.read[b]
            h = ra @ self.mix[0] + rb @ self.mix[1]
            q, qn = self.target[y], self.target[noise]
            s = np.einsum("nd,nd->n", q, h) + self.bias[y] - log_noise[y]
            sn = h @ qn.T + (self.bias[noise] - log_noise[noise])
            g, gn = (1 / (1 + np.exp(-s)) - 1) / BATCH, 1 / (1 + np.exp(-sn)) / BATCH
            gh = g[:, None] * q + gn @ qn
            d.fill(0)
            grads[2][...], grads[3][...] = ra.T @ gh, rb.T @ gh
            grads[4][...] = np.bincount(np.concatenate((y, noise)), weights=np.concatenate((g, gn.sum(axis=0))), minlength=n)
            _scatter(grads[0], np.concatenate((a, b)), np.concatenate((gh @ self.mix[0].T, gh @ self.mix[1].T)))
            _scatter(grads[1], np.concatenate((y, noise)), np.concatenate((g[:, None] * h, gn.T @ h)))
            now = rate * (1 - 0.8 * step / (steps + 1))
            first += 0.1 * (d - first)
            second += 0.001 * (d * d - second)
            flat -= now * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        return self

    def log10(self, contexts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each class after its context; one matrix product per batch of distinct contexts."""
        keys, at = np.unique(contexts, return_inverse=True)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(0, keys.size + 2048, 2048))
        out = np.empty(contexts.size)
        for i in range(0, keys.size, 2048):
            k = keys[i : i + 2048]
            s = (self.read[k // self.classes] @ self.mix[0] + self.read[k % self.classes] @ self.mix[1]) @ self.target.T + self.bias
            s -= s.max(axis=1, keepdims=True)
            s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
            mine = order[ends[i // 2048] : ends[i // 2048 + 1]]
            out[mine] = s[at[mine] - i, classes[mine]]
        return out / math.log(10)


def _scatter(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    at = at[order]
    heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out[at[heads]] += np.add.reduceat(rows[order], heads)


def one_pass(tokens: int) -> int:
    """Steps that take each of so many tokens."""
    return -(-tokens // BATCH)


def _learn(model: LogBilinear, round_: int):
    """Of one task's blocks: parameters after passing over the round's share of their training
    tokens from the model's, times the number of steps; one row a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copy import deepcopy

        m, taken, first = deepcopy(model), 0, None
        for b in block_rows(batches):
            c, contexts = _contexts(b, m.classes)
            learn = np.repeat(Docs(b).train, b.sizes)
            if learn.any():
                first = (contexts[learn], c[learn], b.block) if first is None else first
                # the rounds' shares, dealt by one shuffled order, make up all tokens
                mine = np.random.default_rng(b.block).permutation(int(learn.sum()))[round_::ROUNDS]
                steps = max(STEPS, one_pass(mine.size))
                m.fit(contexts[learn], c[learn], steps, seed=(b.block * 7 + round_) % 2**32, rate=0.02 / (1 + round_), order=mine)
                taken += steps
        if first is not None and taken < LEAST_STEPS:
            m.fit(first[0], first[1], LEAST_STEPS - taken, seed=(first[2] * 7 + round_ + 1000) % 2**32, rate=0.02 / (1 + round_))
            taken = LEAST_STEPS
        if taken:
            flat = m.flat().astype(np.float64) * taken
            for i in range(0, flat.size, _PART):
                yield pa.RecordBatch.from_pydict({"part": pa.array([i // _PART], pa.int32()), "task": pa.array([TaskContext.get().partitionId()], pa.int32()), "steps": pa.array([taken], pa.int64()), "sums": pa.array([flat[i : i + _PART].tobytes()], pa.binary())})

    return run


#: Parameters in one row of a task's.
_PART = 2048


def _average(t: pa.Table) -> pa.Table:
    """Of one part: the mean over tasks, in their order."""
    t = t.sort_by("task")
    total = np.sum([np.frombuffer(x, dtype=np.float64) for x in t.column("sums").to_pylist()], axis=0) / sum(t.column("steps").to_pylist())
    return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "mean": pa.array([total.tobytes()], pa.binary())})


def train(coded: DataFrame, vocabulary: Vocabulary) -> LogBilinear:
    model = LogBilinear(vocabulary.unigram)
    for i in range(ROUNDS if vocabulary.tokens else 0):
        parts = coded.mapInArrow(_learn(model, i), "part int, task int, steps long, sums binary").groupBy("part").applyInArrow(_average, "part int, mean binary").collect()
        if parts:
            model.load(np.concatenate([np.frombuffer(bytes(r["mean"]), dtype=np.float64) for r in sorted(parts, key=lambda r: r["part"])]))
    return model


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared.value
        for b in block_rows(batches):
            d, codes = Docs(b), b.codes()
            counts, classes = unpack_ints(b.row["counts"]).astype(np.float64), unpack_ints(b.row["classes"]).astype(np.int64)
            base = np.log10((counts + 1) / (vocabulary.tokens + vocabulary.words + 1))
            rare = np.maximum(classes - vocabulary.size, 0)
            inside = np.where(classes < vocabulary.size, 0.0, np.log10((counts + 1) / (vocabulary.rare_tokens[rare] + vocabulary.rare_words[rare] + 1)))
            c, contexts = _contexts(b, model.classes)
            lm = model.log10(contexts, c) + inside[codes]
            add = lambda x: np.add.reduceat(x, b.starts)  # noqa: B023, E731  every document has its end
            n = len(d.ids)
            yield pa.RecordBatch.from_arrays([pa.array(d.ids, pa.int64()), pa.array(d.held, pa.bool_()), pa.array(b.sizes), pa.array(add((counts > 0).astype(np.int64)[codes])), pa.array([vocabulary.tokens] * n, pa.int64()), pa.array(add(base[codes])), pa.array(add(lm))], schema=_SCORES_ARROW)

    return run


def score(docs: DataFrame, training, held_out) -> DataFrame:
    """(``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``) of
    each row of ``docs``; ``training`` and ``held_out`` are boolean columns over ``docs``."""
    spark = docs.sparkSession
    false = F.lit(False)
    blocks = make_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(training, false).alias("train"), F.coalesce(held_out, false).alias("held")), _split, mark=("profile", _profile))
    n_bytes, n_words = totals(blocks)
    buckets = bucket_count(blocks, n_bytes)
    centres = kinds(blocks)
    sent = blocks.mapInArrow(_send(buckets, centres), "bucket int, block long, words binary, counts binary, kinds binary")
    counted = materialise(by_bucket(sent, buckets).applyInArrow(_count(centres, n_words), _COUNTED))
    vocabulary = Vocabulary(counted)
    answers = counted.where("block is not null").select("block", "bucket", "counts", "kinds")
    coded = materialise(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_code(spark.sparkContext.broadcast(vocabulary), buckets), _CODED), compression="none")
    shared = spark.sparkContext.broadcast((vocabulary, train(coded, vocabulary)))
    return coded.mapInArrow(_score(shared), _SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fold("doc_id", 7) != 2, fold("doc_id", 7) == 2)


def brute_base(texts: list[tuple[int, str | None, bool]]) -> dict[int, tuple[int, int, int, float]]:
    """Per id: tokens, known tokens, training tokens and base score by the definition alone, for tests."""
    words = {i: [*(t or "").encode().lower().split(), END] for i, t, _ in texts}
    c = Counter(w for i, _, train in texts if train for w in words[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words.items()}
