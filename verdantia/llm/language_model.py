"""Scores of texts under a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are words (runs of characters other than x20 and x09-x0D, A-Z lower-cased) and one end after each text. A token's
class is itself for the ``OWN`` most frequent tokens and else the group of its first two bytes; within a group, words
share the group's mass by their smoothed counts, unseen words included, so that the probabilities of all words sum to one:

    log P(token | context) = log softmax(q . r + b)[class] + log((c + 0.1) / (N_group + 0.1 (V_group + 1)))

with q the sum of each context class' vector times that position's matrix. The softmax is over all classes: one matrix
product for a batch of tokens gives all normalised log-probabilities.

What is gathered from the corpus: counts of every word of every training text; and the parameters, which each task fits by
noise-contrastive estimation to its training texts, are averaged by weight over all tasks, ``ROUNDS`` times. Every token is
a target in exactly one round, by its place in its text. Frequent words (at most ``HEAD``) go to the tasks with their counts; the others' counts are joined.

Defined cases: null and empty texts are one end token; null ids count as the empty text in the split; repeated rows each
get the score of one; without training rows the parameters stay at their start, and every count is 0; an empty table gives
an empty one; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, ragged, stored, table
from .scan import Cut, HashIndex, by_bytes, head, piece_counts, words

HEAD = 1 << 17
OWN = 383  # and the end
GROUPS = 128
ORDER = 4
WIDTH = 24
NOISE = 64
ROUNDS = 2
BATCH = 512
RATE = 0.15


def held_out(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


# ---------------------------------------------------------------- the model
@dataclass
class Model:
    context: np.ndarray  # (classes + 1, WIDTH): the last row stands before the text
    target: np.ndarray  # (classes, WIDTH)
    place: np.ndarray  # (ORDER, WIDTH, WIDTH)
    bias: np.ndarray  # (classes,)

    @classmethod
    def start(cls, shares: np.ndarray) -> Model:
        rng, n = np.random.default_rng(7), len(shares)
        eye = np.stack([np.eye(WIDTH) * (0.9**k) for k in range(ORDER)])
        parts = (rng.normal(0, 0.3, (n + 1, WIDTH)), rng.normal(0, 0.03, (n, WIDTH)), eye, np.log(shares))
        return cls(*(x.astype(np.float32) for x in parts))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.context.ravel(), self.target.ravel(), self.place.ravel(), self.bias])

    @classmethod
    def of(cls, flat: np.ndarray, classes: int) -> Model:
        at = np.cumsum([(classes + 1) * WIDTH, classes * WIDTH, ORDER * WIDTH * WIDTH])
        a, b, c, d = np.split(flat.astype(np.float32), at)
        return cls(a.reshape(-1, WIDTH), b.reshape(-1, WIDTH), c.reshape(ORDER, WIDTH, WIDTH), d)

    def log_probs(self, classes: np.ndarray, context: np.ndarray, batch: int = 256) -> np.ndarray:
        """Normalised natural log-probabilities of the classes, given (n, ORDER) context classes.

        The exponential of a sum over places is a product of one row a place, so that exponentials are taken once for each
        context class and place, and not for each token; where that product is too small for its type, they are.
        """
        parts = np.stack([self.context @ m @ self.target.T for m in self.place])
        parts[0] += self.bias
        most = parts.max(axis=2)
        rows = np.exp(parts - most[:, :, None])
        mine, top = np.zeros(len(classes)), np.zeros(len(classes))
        for k in range(ORDER):
            mine += parts[k][context[:, k], classes]
            top += most[k][context[:, k]]
        total = np.empty(len(classes), np.float32)
        made, taken = np.empty((2, batch, self.target.shape[0]), np.float32)
        for at in range(0, len(classes), batch):
            ctx = context[at : at + batch]
            x, y = made[: len(ctx)], taken[: len(ctx)]
            np.take(rows[0], ctx[:, 0], axis=0, out=x, mode="clip")
            for k in range(1, ORDER):
                np.take(rows[k], ctx[:, k], axis=0, out=y, mode="clip")
                if k < ORDER - 1:
                    x *= y
            np.einsum("ij,ij->i", x, y, out=total[at : at + batch])
        low = np.flatnonzero(~(total > 1e-20))
        out = mine - top - np.log(np.maximum(total, 1e-20).astype(np.float64))
        for at in range(0, len(low), batch):
            here = low[at : at + batch]
            s = sum(parts[k][context[here, k]].astype(np.float64) for k in range(ORDER))
            peak = s.max(axis=1)
            out[here] = mine[here] - peak - np.log(np.exp(s - peak[:, None]).sum(axis=1))
        return out


def _cells(rows: int, width: int) -> np.ndarray:
    """The places of each row's values in a flat matrix."""
    return np.arange(rows * width).reshape(rows, width)


def _rows_sum(rows: np.ndarray, values: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """For each row of a matrix with these ``cells``, the sum of its values."""
    out = np.zeros(cells.size, np.float32)
    np.add.at(out, cells.take(rows, axis=0).ravel(), values.ravel())
    return out.reshape(cells.shape)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(np.minimum(x, 30, out=x), out=x)
    return np.divide(x, x + 1, out=x)


class Trainer:
    """Noise-contrastive estimation with Adagrad; a batch shares its noise classes."""

    def __init__(self, model: Model, shares: np.ndarray, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.size, self.cdf = len(shares), np.cumsum(shares) / np.sum(shares)
        self.log_noise = (np.log(shares) + math.log(NOISE)).astype(np.float32)
        self.cells = _cells(self.size, WIDTH + 1), _cells(self.size + 1, WIDTH)
        self.past = [np.full(x.shape, 0.1, np.float32) for x in (model.context, model.target, model.place, model.bias)]

    def _move(self, which: int, parameter: np.ndarray, gradient: np.ndarray) -> None:
        past = self.past[which]
        past += gradient * gradient
        parameter -= RATE * gradient / np.sqrt(past)

    def step(self, classes: np.ndarray, context: np.ndarray) -> None:
        m, n = self.m, len(classes)
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE), "right"), self.size - 1)
        place = m.place.reshape(ORDER * WIDTH, WIDTH)
        vectors = m.context.take(context.ravel(), axis=0).reshape(n, ORDER * WIDTH)
        q = vectors @ place
        target, against = m.target.take(classes, axis=0), m.target.take(noise, axis=0)
        real = np.einsum("ij,ij->i", target, q) + m.bias[classes] - self.log_noise[classes]
        other = q @ against.T
        other += m.bias[noise] - self.log_noise[noise]
        a = (_sigmoid(real) - 1)[:, None] * (8 / n)
        b = _sigmoid(other)
        b *= 8 / n
        dq = a * target + b @ against
        both = np.empty((n + NOISE, WIDTH + 1), np.float32)  # what moves the targets, and the bias
        np.multiply(a, q, out=both[:n, :-1])
        both[:n, -1:] = a
        np.matmul(b.T, q, out=both[n:, :-1])
        both[n:, -1] = b.sum(axis=0)
        g = _rows_sum(np.concatenate([classes, noise]), both, self.cells[0])
        self._move(1, m.target, g[:, :-1])
        self._move(3, m.bias, g[:, -1])
        g = _rows_sum(context.ravel(), dq @ place.T, self.cells[1])
        self._move(2, m.place, (vectors.T @ dq).reshape(ORDER, WIDTH, WIDTH))
        self._move(0, m.context, g)


# ---------------------------------------------------------------- tokens
@dataclass
class Vocabulary:
    index: HashIndex  # frequent words -> row
    counts: np.ndarray  # of the rows
    classes: np.ndarray  # of the rows, and one more, where row -1 points
    group: np.ndarray  # of two bytes: class
    log_mass: np.ndarray  # of a class: log10 of what its words' smoothed counts sum to; 0 for tokens of their own class
    own: int  # classes from here on are groups; the one before is the end

    @property
    def end(self) -> int:
        return self.own - 1

    @property
    def size(self) -> int:
        return len(self.log_mass)

    def tokens(self, cut: Cut, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each word or -1, class of each token with ends, (tokens, ORDER) context classes); hashes: of the words, if they are known"""
        rows = self.index.find(cut.hashes() if hashes is None else hashes)
        kind = self.classes[rows]
        rare = np.flatnonzero(rows < 0)
        start, end = cut.start[rare], cut.end[rare]
        second = np.where(end - start > 1, cut.data[np.minimum(start + 1, max(len(cut.data) - 1, 0))], 0)
        kind[rare] = self.group[cut.data[start].astype(np.int64) * 256 + second]
        kind = np.insert(kind, cut.first[1:], self.end)
        counts = cut.counts() + 1
        begin = np.cumsum(counts) - counts
        context = np.empty((len(kind), ORDER), np.int64)
        for k in range(ORDER):
            context[k + 1 :, k] = kind[: max(len(kind) - k - 1, 0)]
            for j in range(k + 1):  # the first tokens of a text have nothing that far before them
                context[begin[counts > j] + j, k] = self.size
        return rows, kind, context


def vocabulary(counts: DataFrame, texts: int, most: int = HEAD) -> tuple[Vocabulary, np.ndarray, int, int, int]:
    """(vocabulary, shares of the classes, all tokens, distinct tokens, the least count that all frequent words have)"""
    first = F.conv(F.hex(F.rpad(F.substring("piece", 1, 2), 2, F.lit(b"\0"))), 16, 10).cast("int")
    groups = {r.g: (r.n, r.v) for r in counts.groupBy(first.alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # at most 65,536
    tab = head(counts, most).select("piece", "n").toArrow()  # at most `most` rows
    n = tab.column("n").to_numpy().astype(np.int64)
    pieces = tab.column("piece").to_pylist()
    order = sorted(range(len(n)), key=lambda k: (-n[k], pieces[k]))
    pieces, n = [pieces[k] for k in order], n[order]
    own = min(OWN, len(pieces))
    named = sorted(groups, key=lambda g: (-groups[g][0], g))[: GROUPS - 1]
    group = np.full(65536, own + 1 + len(named), np.int64)
    group[named] = own + 1 + np.arange(len(named))
    size = own + 2 + len(named)
    total, kinds = np.zeros(size), np.zeros(size)
    for g, (k, v) in groups.items():
        total[group[g]] += k
        kinds[group[g]] += v
    two = np.array([(x[0] << 8) | (x[1] if len(x) > 1 else 0) for x in pieces], np.int64)
    np.subtract.at(total, group[two[:own]], n[:own])
    np.subtract.at(kinds, group[two[:own]], 1)
    total[:own], total[own] = n[:own], texts
    mass = np.zeros(size)
    mass[own + 1 :] = np.log10(total[own + 1 :] + 0.1 * (kinds[own + 1 :] + 1))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(x) for x in pieces]).astype(np.int64)
    cut = Cut(data, np.array([0, len(data)]), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
    index = HashIndex()
    if len(pieces):
        index.add(cut.hashes(), np.arange(len(pieces), dtype=np.int32))
    held = Vocabulary(index, n, np.concatenate([np.arange(own), group[two[own:]], [own]]), group, mass, own + 1)
    shares = (total + 1) / (total + 1).sum()
    everything = sum(k for k, _ in groups.values()) + texts
    return held, shares, everything, sum(v for _, v in groups.values()) + (texts > 0), int(n.min()) if len(n) else 1


def turn_of(cut: Cut) -> np.ndarray:
    """The round in which each token, ends included, is a target."""
    counts = cut.counts() + 1
    return ragged(np.zeros(len(counts), np.int64), counts) % ROUNDS


def train(docs: DataFrame, held: Vocabulary, shares: np.ndarray, text: str = "text") -> Model:
    """Averages, weighted by tokens, of what the tasks have fitted."""
    spark, model = docs.sparkSession, Model.start(shares)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((held, shares, model.flat()))

        def fit(batches, turn=turn, sent=sent):
            held, shares, flat = sent.value
            trainer, n, kept = Trainer(Model.of(flat, len(shares)), shares, turn), 0, []
            for batch in by_bytes(batches, 0):
                cut = words(batch.column(0))
                _, kind, context = held.tokens(cut)
                own = np.flatnonzero(turn_of(cut) == turn)
                kept.append((kind.take(own), context.take(own, axis=0)))
                if sum(len(k) for k, _ in kept) >= 16 * BATCH:
                    n += _steps(trainer, kept)
                    kept = []
            if kept:
                n += _steps(trainer, kept)
            if n:
                flat = trainer.m.flat().astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * n), pa.array(np.full(len(flat), n, np.int64))], names=["i", "v", "n"])

        got = docs.select(column(text).cast("string")).mapInArrow(fit, "i int, v double, n long").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
        if got.num_rows:
            flat = np.zeros(got.num_rows)
            flat[got.column("i").to_numpy()] = got.column("v").to_numpy()
            model = Model.of(flat, len(shares))
    return model


def _steps(trainer: Trainer, kept: list) -> int:
    kind, context = np.concatenate([k for k, _ in kept]), np.concatenate([c for _, c in kept])
    order = trainer.rng.permutation(len(kind))
    kind, context = kind.take(order), context.take(order, axis=0)
    for at in range(0, len(kind), BATCH):
        trainer.step(kind[at : at + BATCH], context[at : at + BATCH])
    return len(kind)


# ---------------------------------------------------------------- scoring
_SCORED = "struct<n_tokens:bigint,n_known:bigint,base:double,score:double,rare:array<struct<h:bigint,n:int>>>"
_TYPE = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())])))])


def _scored(texts: pa.Array, held: Vocabulary, model: Model, ends: int) -> pa.Array:
    cut = words(texts)
    hashes = cut.hashes()
    rows, kind, context = held.tokens(cut, hashes)
    n = cut.counts() + 1
    first = np.concatenate([[0], np.cumsum(n)])
    value = model.log_probs(kind, context) / math.log(10) - held.log_mass[kind]
    smooth = np.append(np.log10(held.counts + 0.1), 0.0)[rows]  # 0 for rare words: their counts are joined
    grouped = np.where(rows >= 0, held.classes[rows] >= held.own, False)
    own = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[cut.first])
    known = own((rows >= 0).astype(np.float64)).astype(np.int64) + (1 if ends else 0)
    base = own(smooth) + math.log10(ends + 0.1)
    score = np.diff(np.concatenate([[0.0], np.cumsum(value)])[first]) + own(np.where(grouped, smooth, 0.0))
    rare = np.flatnonzero(rows < 0)
    pairs = np.stack([cut.owner()[rare].astype(np.uint64), hashes[rare]], axis=1) if len(rare) else np.empty((0, 2), np.uint64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    new = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))) if len(pairs) else np.empty(0, np.int64)
    times = np.diff(np.append(new, len(pairs)))
    edge = np.searchsorted(pairs[new, 0], np.arange(len(n) + 1).astype(np.uint64)).astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array(pairs[new, 1].view(np.int64)), pa.array(times.astype(np.int32))], names=["h", "n"])
    arrays = [pa.array(n), pa.array(known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(edge), struct)]
    return pa.StructArray.from_arrays(arrays, fields=list(_TYPE))


def _hashed(pieces: pa.Array) -> pa.Array:
    from .scan import raw

    data, edges = raw(pieces)
    return pa.array(Cut(data, edges, edges[:-1], edges[1:]).hashes().view(np.int64))


def score(docs: DataFrame, train_where: Column, *, doc_id: str = "doc_id", text: str = "text", most: int = HEAD) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from those with ``train_where``."""
    spark = docs.sparkSession
    learned = docs.filter(train_where).select(column(text).cast("string").alias("text"))
    counts = stored(piece_counts(learned, words, "text"), "words")
    texts = learned.count()
    held, shares, total, kinds, least = vocabulary(counts, texts, most)
    model = train(learned, held, shares)
    sent = spark.sparkContext.broadcast((held, model))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held, model = sent.value
        for texts_here in columns:
            batch = pa.RecordBatch.from_arrays([texts_here], names=["x"])
            parts = [_scored(s.column(0), held, model, texts) for s in by_bytes([batch], 0)]
            yield pa.concat_arrays(parts) if parts else pa.array([], _TYPE)

    def hashed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pieces in columns:
            yield _hashed(pieces)

    body = column(text).cast("string")
    part = docs.select(column(doc_id).alias("key"), F.xxhash64(body).alias("t"), F.arrow_udf(run, _SCORED).asNondeterministic()(body).alias("s"))
    part = stored(part.select("key", "t", "s.*"), "scored")
    pairs = part.select("key", "t", F.explode("rare").alias("r"))
    rare = counts.filter(F.col("n") <= least).select(F.arrow_udf(hashed, "bigint")("piece").alias("h"), F.col("n").alias("c"))
    found = pairs.select("key", "t", "r.h", "r.n").join(rare, "h", "left")
    sums = found.select("key", "t", (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("v"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("k"), F.lit(0).alias("copies"))
    # Rows with one key and text share their sums, which count each of them.
    marks = part.select("key", "t", F.lit(0.0).alias("v"), F.lit(0).alias("k"), F.lit(1).alias("copies"))
    sums = sums.unionAll(marks).groupBy("key", "t").agg(F.sum("v").alias("v"), F.sum("k").alias("k"), F.sum("copies").alias("copies"))
    both = part.select("key", "t", "n_tokens", "n_known", "base", "score").alias("a").join(sums.alias("b"), (F.col("a.t") == F.col("b.t")) & F.col("a.key").eqNullSafe(F.col("b.key")))
    rest = F.col("v") / F.col("copies")
    return both.select(
        F.col("a.key").alias("key"),
        "n_tokens",
        (F.col("n_known") + F.col("k") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * math.log10(total + 0.1 * (kinds + 1))).alias("base_score"),
        (F.col("score") + rest).alias("score"),
    )


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 10)
    scored = score(docs, ~out)
    return scored.select(F.col("key").alias("doc_id"), held_out(F.col("key"), 10).alias("held_out"), *[c for c in scored.columns if c != "key"])
