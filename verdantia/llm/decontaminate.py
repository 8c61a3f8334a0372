"""Benchmark decontamination: a prefix-filtered set join with exact verification over item-sized windows.

An item's windows are its runs of ``WIDTH`` words (a shorter item is one window). A window holds shingles of ``SHINGLE``
words; containment of the whole window needs every shingle, so its rarest one is the only necessary prefix token:

1. the shingles of the items are counted over all documents, and each window is indexed by its rarest shingle;
2. a document's shingles are looked up in that index; the shingle's place in the window and in the document gives the
   only place where the window can lie (positional bound), which must fit into the document (length bound);
3. the window's words are compared there, all of them; the words of a match are hit.

The items are a stated query set: they are taken in blocks of at most ``BLOCK_BYTES`` of text, each sent to the tasks.

Defined cases: null texts have no words; items without words have no effect; the words of items with null item_id are hit, but
such items are not listed; items with equal item_id count once; repeated documents are judged alike; empty tables give an empty result or no hits; a column that has
the output's name is replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, ragged, shingle_hashes, table
from .scan import ALNUM, Cut, HashIndex, by_bytes, words

WIDTH = 10
SHINGLE = 3
BLOCK_BYTES = 32 << 20
_KIND = "struct<n_words:bigint,runs:array<struct<start:int,stop:int>>,items:array<string>>"


def _shingles(cut: Cut, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of all runs of ``width`` words within one text."""
    if len(hashes) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    room = np.repeat(cut.first[1:], cut.counts()) - np.arange(len(hashes))
    at = np.flatnonzero(room >= width)
    return shingle_hashes(hashes, width)[at], at


class Windows:
    """The windows of one block of items, indexed by their rarest shingle."""

    def __init__(self, items: list[tuple[str | None, str]]):
        cut = words(pa.array([x for _, x in items], pa.string()), ALNUM)
        hashes = cut.hashes()
        self.item_ids = sorted({k for k, _ in items if k is not None})
        number = {k: n for n, k in enumerate(self.item_ids)}
        seen: dict[tuple[int, ...], set[int]] = {}
        for k, (item, _) in enumerate(items):
            own = hashes[cut.first[k] : cut.first[k + 1]].tolist()
            for at in range(max(1, len(own) - WIDTH + 1) if own else 0):
                of = seen.setdefault(tuple(own[at : at + WIDTH]), set())
                if item is not None:
                    of.add(number[item])
        self.windows = [np.array(w, np.uint64) for w in seen]
        self.items = list(seen.values())
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.tokens = []  # of each window: (width, hashes of its shingles)
        for w in self.windows:
            width = min(SHINGLE, len(w))
            self.tokens.append((width, shingle_hashes(w, width)))
        self.counts: dict[int, int] = {}

    def vocabulary(self) -> dict[int, np.ndarray]:
        """Distinct shingles by width."""
        return {n: np.unique(np.concatenate([t for m, t in self.tokens if m == n])) for n in sorted({m for m, _ in self.tokens})}

    def index(self, rarity: dict[int, dict[int, int]]) -> None:
        """Chooses each window's rarest shingle (ties: the smallest hash)."""
        rows: dict[int, list] = {}
        for w, (width, tokens) in enumerate(self.tokens):
            known = rarity.get(width, {})
            best = min(range(len(tokens)), key=lambda k: (known.get(int(tokens[k]), 0), int(tokens[k])))
            rows.setdefault(width, []).append((int(tokens[best]), w, best))
        self.by_width = {}
        for width, entries in rows.items():
            entries.sort()
            token = np.array([e[0] for e in entries], np.uint64)
            distinct, first, n = np.unique(token, return_index=True, return_counts=True)
            index = HashIndex()
            index.add(distinct, np.arange(len(distinct), dtype=np.int32))
            self.by_width[width] = (index, first, n, np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries], np.int64))
        self.flat = np.concatenate(self.windows) if self.windows else np.empty(0, np.uint64)
        self.start = np.cumsum(self.length) - self.length
        del self.tokens

    def matches(self, cut: Cut, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, window) of every occurrence."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        owner = cut.owner()
        for width, (index, first, n, window, place) in self.by_width.items():
            token, at = _shingles(cut, hashes, width)
            rows = index.find(token)
            hit = np.flatnonzero(rows >= 0)
            rows, at = rows[hit], at[hit]
            entry = ragged(first[rows], n[rows])
            begin = np.repeat(at, n[rows]) - place[entry]
            text, which = np.repeat(owner[at], n[rows]), window[entry]
            fits = (begin >= cut.first[text]) & (begin + self.length[which] <= cut.first[text + 1])
            begin, which = begin[fits], which[fits]
            size = self.length[which]
            same = hashes[ragged(begin, size)] == self.flat[ragged(self.start[which], size)]
            whole = np.add.reduceat(same, np.cumsum(size) - size) == size if len(size) else np.empty(0, bool)
            found.append((begin[whole], which[whole]))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _rarity(docs: DataFrame, text: str, vocabulary: dict[int, np.ndarray]) -> dict[int, dict[int, int]]:
    """Occurrences of the items' shingles over all documents."""
    indexes = {}
    for width, tokens in vocabulary.items():
        indexes[width] = HashIndex()
        indexes[width].add(tokens, np.arange(len(tokens), dtype=np.int32))
    sent = docs.sparkSession.sparkContext.broadcast(indexes)

    def run(batches):
        counts = {w: np.zeros(x.n, np.int64) for w, x in sent.value.items()}
        for batch in by_bytes(batches, 0):
            cut = words(batch.column(0), ALNUM)
            hashes = cut.hashes()
            for width, index in sent.value.items():
                rows = index.find(_shingles(cut, hashes, width)[0])
                counts[width] += np.bincount(rows[rows >= 0], minlength=index.n)
        for width, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), width, np.int32)), pa.array(some), pa.array(n[some])], names=["width", "token", "n"])

    out: dict[int, dict[int, int]] = {}
    counted = docs.select(column(text).cast("string")).mapInArrow(run, "width int, token long, n long").groupBy("width", "token").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # at most the block's shingles
        out.setdefault(r.width, {})[int(vocabulary[r.width][r.token])] = r.n
    return out


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union; starts ascend."""
    if not len(start):
        return start, stop
    reach = np.maximum.accumulate(stop)
    new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return start[new], np.append(reach[new[1:] - 1], reach[-1])


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "contamination", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct: n_words, runs (words hit, as [start, stop)), items (ids as strings, sorted, of those with occurring windows)."""
    spark = docs.sparkSession
    items = benchmark.select(column(item_id).cast("string").alias("k"), column(item_text).cast("string").alias("x")).filter("x is not null")
    total = items.agg(F.sum(F.octet_length("x")).alias("n")).head().n or 0
    blocks = max(1, -(-total // block_bytes))
    names = [c for c in docs.columns if c != out]
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("x"), F.lit(blocks)) == block) if blocks > 1 else items
        index = Windows([(r.k, r.x) for r in part.distinct().collect()])  # about block_bytes
        index.index(_rarity(docs, text, index.vocabulary()))
        docs = docs.select(*map(column, names), _judge(spark, index)(column(text).cast("string"), column(out) if block else F.lit(None).cast(_KIND)).alias(out))
    return docs


def _judge(spark: SparkSession, index: Windows):
    sent = spark.sparkContext.broadcast(index)

    def judge(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = sent.value
        for texts, before in columns:
            batch = pa.RecordBatch.from_arrays([texts, before], names=["x", "b"])
            parts = [_slice(index, s.column(0), s.column(1)) for s in by_bytes([batch], 0)]
            yield pa.concat_arrays(parts) if parts else pa.array([], _TYPE)

    return F.arrow_udf(judge, _KIND).asNondeterministic()  # so that it runs once a row


_TYPE = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _slice(index: Windows, texts: pa.Array, before: pa.Array) -> pa.Array:
    cut = words(texts, ALNUM)
    begin, window = index.matches(cut, cut.hashes())
    owner = np.searchsorted(cut.first, begin, "right") - 1
    out = [{"n_words": int(n), "runs": [], "items": []} for n in cut.counts()]
    for k, old in enumerate(before.to_pylist() if before.null_count < len(before) else []):
        if old:
            out[k] = old
    for k in np.unique(owner):
        own = owner == k
        row = out[k]
        start, stop = begin[own] - cut.first[k], begin[own] + index.length[window[own]] - cut.first[k]
        start = np.concatenate([start, np.array([r["start"] for r in row["runs"]], np.int64)])
        stop = np.concatenate([stop, np.array([r["stop"] for r in row["runs"]], np.int64)])
        order = np.argsort(start, kind="stable")
        row["runs"] = [{"start": int(a), "stop": int(b)} for a, b in zip(*_merged(start[order], stop[order]), strict=True)]
        row["items"] = sorted({index.item_ids[i] for w in np.unique(window[own]) for i in index.items[w]} | set(row["items"]))
    return pa.array(out, _TYPE)


def hit_words(out: str = "contamination") -> Column:
    return F.aggregate(column(out)["runs"], F.lit(0).cast("long"), lambda n, r: n + (r["stop"] - r["start"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows without a hit, with the columns of ``docs``."""
    judged = contamination(docs, benchmark, text=text, out="__contamination")
    return judged.filter(F.size(column("__contamination")["runs"]) == 0).select(*map(column, docs.columns))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.col("contamination.items")
    return judged.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("contamination.runs") > 0).alias("contaminated"),
    )


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_W}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{_W}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS n, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS x
  FROM b, unnest(range(1, greatest(len(w) - {WIDTH} + 1, 1) + 1)) AS u(i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, l.n, i, array_to_string(w[i:i + l.n - 1], ' ') AS x
  FROM d, lens AS l, unnest(range(1, greatest(len(w) - l.n + 2, 1))) AS u(i)
), m AS (SELECT doc_id, n, i, item_id FROM dwin JOIN win USING (n, x)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(0, n)) AS v(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
