"""Language of texts by a byte convolutional network trained in numpy.

Filters of several widths run over a window's bytes (a filter's value is a sum of one weight a byte and place, so looked
up, not multiplied), are max-pooled over the window, pass a rectifier and a softmax. A text is cut into windows of
``WINDOW`` bytes that overlap by the widest filter less one, so that every run of bytes is seen; its language is the one
of the highest mean log-probability over all its windows.

Training takes all windows of a sample of labelled rows: at most about ``SAMPLE`` rows in all, as many of each language, chosen
by hash. That bound is fixed; the classifier does not grow with the corpus. Rows of more than ``LONGEST`` bytes are not chosen,
so that the bound on rows bounds the windows as well.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without labelled rows every text is ``und``;
null ids count as the empty text in the split; repeated rows are judged alike; an empty table gives an empty one; a column
that has the output's name is replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, table
from .scan import by_bytes, raw

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE = 6000
LONGEST = 1 << 14
STEPS = 700
BATCH = 128
RATE = 0.004
_OVERLAP = max(WIDTHS) - 1


def windows(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW) bytes of all texts' windows, zeros after a text's end; and each window's text."""
    size = np.diff(edges)
    n = np.maximum(1, -(-(size - _OVERLAP) // (WINDOW - _OVERLAP)))
    owner = np.repeat(np.arange(len(size)), n)
    at = edges[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * (WINDOW - _OVERLAP)
    place = at[:, None] + np.arange(WINDOW)
    inside = place < edges[1:][owner][:, None]
    if not len(data):
        return np.zeros(place.shape, np.uint8), owner
    return np.where(inside, data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8), owner


class Network:
    def __init__(self, labels: list[str]):
        rng = np.random.default_rng(3)
        self.labels = labels
        self.filters = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        n = FILTERS * len(WIDTHS)
        self.out, self.bias = rng.normal(0, 0.2, (n, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32)

    def pooled(self, x: np.ndarray, where: bool = False):
        """Max over the places of each filter, and with ``where`` also the places."""
        best, place = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            s = np.take(self.filters[w][0], x[:, :n], axis=0)
            for k in range(1, w):
                s += np.take(self.filters[w][k], x[:, k : k + n], axis=0)
            if where:
                p = s.argmax(axis=1)
                place.append(p)
                best.append(np.take_along_axis(s, p[:, None, :], axis=1)[:, 0])
            else:
                best.append(s.max(axis=1))
        return (np.concatenate(best, axis=1), place) if where else np.concatenate(best, axis=1)

    def log_probs(self, x: np.ndarray, batch: int = 64) -> np.ndarray:
        out = [self._soft(np.maximum(self.pooled(x[at : at + batch]), 0) @ self.out + self.bias) for at in range(0, len(x), batch)]
        return np.concatenate(out) if out else np.empty((0, len(self.labels)), np.float32)

    @staticmethod
    def _soft(s: np.ndarray) -> np.ndarray:
        s = s - s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> None:
        """Adam on the cross-entropy; only a filter's best place passes a gradient on."""
        rng = np.random.default_rng(5)
        params = [*self.filters.values(), self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            at = rng.integers(0, len(x), BATCH)
            bx, by = x[at], y[at]
            raw, place = self.pooled(bx, True)
            hidden = np.maximum(raw, 0)
            g = np.exp(self._soft(hidden @ self.out + self.bias))
            g[np.arange(BATCH), by] -= 1
            g /= BATCH
            back = (g @ self.out.T) * (raw > 0)
            grads = []
            for j, w in enumerate(WIDTHS):
                part, d = back[:, j * FILTERS : (j + 1) * FILTERS], np.zeros_like(self.filters[w])
                for k in range(w):
                    seen = np.take_along_axis(bx, place[j] + k, axis=1)
                    np.add.at(d[k], (seen, np.arange(FILTERS)[None, :]), part)
                grads.append(d)
            grads += [hidden.T @ g, g.sum(axis=0)]
            for p, d, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Network | None:
    """A network for the non-null values of ``lang``; None without any."""
    rows = labelled.select(column(text).cast("string").alias("x"), column(lang).cast("string").alias("y")).filter(f"y is not null and octet_length(x) <= {LONGEST}")
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    each, steps = max(1, sample // len(counts)), 1 << 30
    share = F.create_map(*[F.lit(v) for y, n in counts.items() for v in (y, min(steps, each * steps // n))])
    chosen = rows.filter(F.pmod(F.xxhash64("x", F.lit(11)), F.lit(steps)) < F.element_at(share, F.col("y"))).distinct()  # copies of one text are chosen together

    def cut(batches):
        for batch in by_bytes(batches, 0):
            x, owner = windows(*raw(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).take(pa.array(owner))], names=["w", "y"])

    got = chosen.mapInArrow(cut, "w binary, y string").orderBy("y", "w").toArrow()  # at most sample * LONGEST bytes, and in fact the mean length
    labels = sorted(counts)
    network = Network(labels)
    y = np.array([labels.index(v) for v in got.column("y").to_pylist()], np.int64)
    x = np.frombuffer(b"".join(got.column("w").to_pylist()), np.uint8).reshape(-1, WINDOW)
    if len(x):
        even = np.random.default_rng(1)
        pick = np.concatenate([even.choice(np.flatnonzero(y == k), max(1, len(x) // len(labels))) for k in np.unique(y)])
        network.train(x[pick], y[pick])
    return network


_KIND = "struct<lang:string,score:double>"
_TYPE = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, network: Network | None, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct: lang and score, the softmax of the mean log-probabilities."""
    body = column(text).cast("string")
    none = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    names = [c for c in docs.columns if c != out]
    if network is None:
        return docs.select(*map(column, names), none.alias(out))
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        network = sent.value
        for texts in columns:
            parts = [_slice(network, s.column(0)) for s in by_bytes([pa.RecordBatch.from_arrays([texts], names=["x"])], 0, 1 << 20)]
            yield pa.concat_arrays(parts) if parts else pa.array([], _TYPE)

    judged = docs.select(*map(column, names), F.arrow_udf(judge, _KIND).asNondeterministic()(body).alias(out))
    return judged.withColumn(out, F.when(body.rlike(r"\p{L}"), column(out)).otherwise(none))


def _slice(network: Network, texts: pa.Array) -> pa.Array:
    x, owner = windows(*raw(texts))
    logs = network.log_probs(x).astype(np.float64)
    n = np.bincount(owner, minlength=len(texts))
    mean = np.add.reduceat(logs, np.cumsum(n) - n, axis=0) / n[:, None]
    mean -= mean.max(axis=1, keepdims=True)
    share = np.exp(mean)
    share /= share.sum(axis=1, keepdims=True)
    return pa.StructArray.from_arrays([pa.array([network.labels[k] for k in share.argmax(axis=1)]), pa.array(np.clip(share.max(axis=1), 0, 1))], fields=list(_TYPE))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = fit(docs.filter(~held_out(F.col("doc_id"))))
    judged = identify(docs.drop("lang"), network)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
