"""Removal of byte strings of ``LENGTH`` bytes that start at two or more places of the corpus, exactly.

1. Every window of LENGTH bytes has an anchor, its least ``GRAM``-byte gram by hash (leftmost of equals), so equal windows have
   equal anchors at equal places. Consecutive windows of one anchor form a region. Anchors met once are settled.
2. Regions that are equal to another as a whole are repeated in all their windows.
3. The others are compared among the regions of their anchor (classes of windows that share a core first, see
   compare_regions). A task concatenates what is left, sorts its suffixes,
   and expands intervals of the Burrows-Wheeler transform breadth first: an interval of strings of length l,
   extended backward by each byte before it, sets the common prefix at its end to l where none is set yet, and only
   intervals that set one go on. So common prefixes come in increasing order, and the expansion stops at LENGTH: what is
   not set by then is at least LENGTH. Neighbouring suffixes with such a prefix are repeated windows.
4. An anchor with more than ``GROUP`` different regions (a passage that very many texts share meets as many contexts) is
   split before it reaches a task: its regions are cut into classes of ``STEPS[0]`` places of the anchor, whose windows all
   hold one longer core. Classes of one core are a group of their own, to which 2. and 3. apply; a group that is still too
   large is cut into finer classes, down to those of one window, which are equal if they share their core. So no task holds
   more than GROUP different regions of one anchor or core, and few of these are left where a passage ends.

A byte is removed if a repeated window covers it. Anchors, cores, regions and classes are equal if their 64-bit hashes are.

Defined cases: null and empty texts, and those of fewer bytes than LENGTH, keep all they have; repeated rows repeat each
other; null ids are ids like others; an empty table gives an empty one; a column that has the output's name is replaced, all
others stay. Texts of any length are cut into windows ``SLICE`` bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, dropped, give_back, mix64, ragged, shuffle_partitions, stored, table
from .scan import _powers, by_bytes, raw

LENGTH = 200
GRAM = 48
GROUP = 1000  # different regions of one anchor, or classes of one core, that a task compares
STEPS = (48, 12, 3, 1)  # places of the anchor in a class, each a multiple of the next
BATCH = 1 << 18  # bytes of regions compared at once
SLICE = 1 << 19  # bytes of texts whose windows are hashed at once
STEP = 47  # places of a class of windows within a task
_PLACE = 24  # bits of a place within a slice


class Hashes:
    """Hashes of any substrings of a byte array, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.inverse[start])


def window_slices(batches: Iterable[pa.RecordBatch], text: int, length: int, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, pa.Array, int]]:
    """(rows, their texts, bytes before them): slices of whole texts, or a piece of a long one; each window lies in one slice."""
    for batch in by_bytes(batches, text, most):
        texts = batch.column(text)
        data, edges = raw(texts)
        if len(data) <= most:
            yield batch, texts, 0
            continue
        for at in range(0, max(1, len(data) - length + 1), most):  # one long text
            yield batch, pa.array([data[at : at + most + length - 1].tobytes()], pa.binary()), at


def regions(texts: pa.Array, length: int = LENGTH, gram: int | None = None) -> tuple[np.ndarray, ...]:
    """For each region: text, first and last window (bytes from the text's start), anchor's hash, region's hash, anchor's place from the first window; and the bytes and edges."""
    data, edges = raw(texts)
    gram = min(gram or GRAM, length)
    n = len(data) - length + 1
    none = np.empty(0, np.int64)
    empty = none, none, none, none.view(np.uint64), none.view(np.uint64), none, data, edges
    if n <= 0:
        return empty
    hashes = Hashes(data)
    grams = mix64((hashes.sums[gram:] - hashes.sums[:-gram]) * hashes.inverse[: len(data) - gram + 1])
    low = np.uint64((1 << _PLACE) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, wide = length - gram + 1, 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[:n], least[span - wide : span - wide + n])
    size = np.maximum(np.diff(edges) - length + 1, 0)
    at = ragged(edges[:-1], size)
    if not len(at):
        return empty
    owner = np.repeat(np.arange(len(size)), size)
    anchor = (least[at] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    first, last = at[heads], at[np.append(heads[1:], len(at)) - 1]
    own, place = owner[heads], anchor[heads]
    whole = _whole(hashes, first, last, place, length)
    return own, first - edges[own], last - edges[own], grams[place], whole, place - first, data, edges


def _whole(hashes: Hashes, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """Of the bytes of windows ``first`` to ``last``, their number, and where the anchor lies in them."""
    return mix64(mix64(hashes.of(first, last + length) + (last - first).astype(np.uint64)) + (anchor - first).astype(np.uint64))


def narrowed(parts: pa.Array, place: np.ndarray, key: np.ndarray, step: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(part, first and last window, core's hash, class' hash) of the classes of ``step`` places of the anchor.

    place: the anchor's place in each part; key: of the anchor or core that the parts share. A class holds the windows with
    the anchor step * k to step * k + step - 1 bytes behind their start; its core is what all of these have in common.
    """
    data, edges = raw(parts)
    step = min(step, length - min(GRAM, length) + 1)
    hashes, most = Hashes(data), np.diff(edges) - length  # the last window of each part
    low = np.maximum(place - most, 0) // step
    own = np.repeat(np.arange(len(place)), place // step - low + 1)
    k = ragged(low, place // step - low + 1)
    first, last = np.maximum(place[own] - step * k - step + 1, 0), np.minimum(most[own], place[own] - step * k)
    at, anchor = edges[own], place[own]
    core = mix64(hashes.of(at + anchor - step * k, at + anchor - step * k - step + 1 + length) + mix64(key.view(np.uint64))[own] + k.astype(np.uint64))
    return own, first, last, core, _whole(hashes, at + first, at + last, at + anchor, length)


# ---------------------------------------------------------------- the transform
def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part: its places from which ``length`` bytes also start at another place of any part."""
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # a separator follows each part; strings that hold one are of no interest
    n = int(ends[-1]) + 1 if len(parts) else 0
    if not n:
        return []
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
    text[ends] = 0
    order, rank = _sorted_suffixes(text)
    before = text[order - 1]  # the transform; the text is taken as a ring
    step = rank[order - 1]  # where the suffix one place longer stands
    common = _common_prefixes(before, step, length)
    same = np.flatnonzero(common[:n] < 0)
    same = same[same > 0]
    starts = np.unique(np.concatenate([order[same], order[same - 1]]))
    part = np.searchsorted(ends, starts)
    starts -= (ends - sizes)[part]
    inside = starts <= sizes[part] - length
    starts, part = starts[inside], part[inside]
    cuts = np.searchsorted(part, np.arange(len(parts) + 1))
    return [starts[cuts[k] : cuts[k + 1]] for k in range(len(parts))]


def _sorted_suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, and its inverse, by prefix doubling from seven symbols on."""
    n, wide = len(text), 7
    padded = np.concatenate([text, np.zeros(wide, np.int64)])
    key = padded[:n].copy()
    for k in range(1, wide):
        key = (key << 9) | padded[k : k + n]
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(ranked[1:] != ranked[:-1])
        if rank[order[-1]] == n - 1:
            return order, rank
        key = rank * (n + 1)
        if wide < n:
            key[: n - wide] += rank[wide:] + 1
        wide *= 2


def _common_prefixes(before: np.ndarray, step: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, where it is below ``length``; else -1. (Strings with a separator but at their end are left out.)"""
    n = len(before)
    common = np.full(n + 1, -1, np.int64)
    common[0] = common[n] = 0
    low, high = np.array([0]), np.array([n])
    for depth in range(length):
        if not len(low):
            break
        size = high - low
        at = ragged(low, size)
        key = (np.repeat(np.arange(len(low)) << 9, size) | before[at]) << 28 | step[at]
        if depth:
            key = key[(key >> 28) & 511 > 0]
        if not len(key):
            break
        key.sort()
        group = key >> 28
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        tails = np.append(heads[1:], len(key)) - 1
        mask = (1 << 28) - 1
        low, high = key[heads] & mask, (key[tails] & mask) + 1  # backward extensions
        fresh = np.flatnonzero(common[high] < 0)
        _, first = np.unique(high[fresh], return_index=True)
        fresh = fresh[first]
        common[high[fresh]] = depth
        low, high = low[fresh], high[fresh]
    return common


def compare_regions(parts: list[bytes], anchor: np.ndarray, place: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, first, last) of repeated windows among different regions, given each part's anchor and its anchor's place.

    The windows of one anchor are taken in classes of STEP places. All windows of a class hold its core, at one place from the
    anchor: a class whose core no other region has, holds no repeated window; one that is equal to another region's as
    a whole, only such. The transform is made of what remains, once for each different class.
    """
    held = pa.array(parts, pa.large_binary())
    own, first, last, core, whole = narrowed(held, place, anchor, STEP, length)
    _, which, n = np.unique(core, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(n[which] > 1)
    own, first, last, core, whole = (x[keep] for x in (own, first, last, core, whole))
    _, one, which, n = np.unique(whole + core, return_index=True, return_inverse=True, return_counts=True)
    equal = n[which] > 1
    _, of, kinds = np.unique(core[one], return_inverse=True, return_counts=True)
    one = one[kinds[of] > 1]
    found = [(own[equal], first[equal], last[equal])]
    held = [parts[own[k]][first[k] : last[k] + length] for k in one.tolist()]
    for k, starts in zip(one.tolist(), repeated_starts(held, length), strict=True):
        if len(starts):
            new = np.flatnonzero(np.append(True, np.diff(starts) > 1))
            end = starts[np.append(new[1:], len(starts)) - 1]
            found.append((np.full(len(new), own[k]), first[k] + starts[new], first[k] + end))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---------------------------------------------------------------- the operator
def _bits(keys: DataFrame, name: str) -> np.ndarray:
    """A bitmap of the keys' low bits, sized by their number up to 2 ** 27 bits; it only saves work."""
    bits = 16
    n = keys.count()
    while bits < 27 and 32 * n > 1 << bits:
        bits += 1
    bit = f"pmod({name}, {1 << bits}L)"
    marks = keys.groupBy(F.expr(f"shiftright({bit}, 6)").alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({name}, 64) as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[marks.column("i").to_numpy()] = marks.column("b").to_numpy().view(np.uint64)
    return out


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & np.uint64(64 * len(bits) - 1)
    return ((bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def _packed(first: Column, last: Column, length: int) -> Column:
    """A span as one number: start and stop, 32 bits each."""
    return (F.shiftleft(first.cast("long"), 32) + last.cast("long") + length).alias("span")


def _counted(seen: DataFrame, length: int, name: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Of rows (doc_id, t, first, last, key, whole, ...): spans of those that are equal to another as a whole; one row of each whole of the keys that hold several, of which one is alone, with m, their number; and the tables that both read."""
    distinct = stored(seen.groupBy("key", "whole").agg(F.count("*").alias("n")), f"distinct-{name}")
    again = distinct.filter("n > 1").select("key", "whole")
    settled = seen.join(again, ["key", "whole"]).select("doc_id", "t", _packed(F.col("first"), F.col("last"), length))
    several = distinct.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select("key", "m")
    several = stored(several, f"several-{name}")  # a table of its own, so that Spark can split a frequent key's rows in the join
    rest = [c for c in seen.columns if c not in ("key", "whole")]
    # Grouped by a hash of both, as by the key alone the join's own rows would do, which Spark could then not split.
    some = seen.join(several, "key").groupBy(F.xxhash64("key", "whole").alias("__kw")).agg(*(F.first(c).alias(c) for c in ["key", "whole", *rest, "m"])).drop("__kw")
    return settled, some, [distinct, several]


def _compared(held: DataFrame, kind: str, length: int) -> DataFrame:
    """Spans of repeated windows within the groups (key) of ``held``: doc_id, t, key, whole, first, place, bytes."""

    def run(batches):
        parts: list = []
        size, at, last, types = 0, None, None, None

        def found():
            k, x, y = compare_regions([p[4] for p in parts], np.array([p[0] for p in parts], np.int64), np.array([p[3] for p in parts], np.int64), length)
            own = [parts[i] for i in k.tolist()]
            first = np.array([p[5] for p in own], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([p[1] for p in own], types[0]), pa.array([p[2] for p in own], types[1]), pa.array(((first + x) << 32) + first + y + length)], names=["doc_id", "t", "span"])

        for batch in batches:
            types = [batch.schema.field(c).type for c in ("doc_id", "t")]
            for key, whole, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "whole", "doc_id", "t", "place", "bytes", "first")), strict=True):
                if (key, whole) == last:  # from a row that is there twice
                    continue
                if key != at and size >= BATCH:
                    yield found()
                    parts, size = [], 0
                at, last = key, (key, whole)
                parts.append([key, *row])
                size += len(row[3])
        if parts:
            yield found()
        give_back()

    parts = shuffle_partitions(held.sparkSession)
    return held.repartition(parts, "key").sortWithinPartitions("key", "whole").mapInArrow(run, f"doc_id {kind}, t long, span long")


def _fetched(docs: DataFrame, rows: DataFrame, kind: str, length: int) -> DataFrame:
    """``rows`` (doc_id, t, first, last, ...) with ``bytes``, those of their windows, from the texts."""
    other = ("key", "whole", "first", "last", "place", "m")
    wanted = stored(rows.groupBy(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).agg(*(F.collect_list(c).alias(c) for c in other)), "wanted")
    both = docs.join(wanted, (F.col("t") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "t", "text", *other)

    def cut(batches):
        for batch in by_bytes(batches, 2, SLICE):
            data, edges = raw(batch.column(2))
            own = pc.list_parent_indices(batch.column(3))
            cols = {c: pc.list_flatten(batch.column(k + 3)) for k, c in enumerate(other)}
            begin = edges[own.to_numpy()] + cols["first"].to_numpy()
            size = cols["last"].to_numpy() - cols["first"].to_numpy() + length
            for at in range(0, len(begin), 4096):  # a text may be asked for very many regions
                held = [data[x : x + n].tobytes() for x, n in zip(begin[at : at + 4096].tolist(), size[at : at + 4096].tolist(), strict=True)]
                who = own.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), *(cols[c].slice(at, 4096) for c in other), pa.array(held, pa.binary())], names=["doc_id", "t", *other, "bytes"])

    got = stored(both.mapInArrow(cut, f"doc_id {kind}, t long, key long, whole long, first long, last long, place long, m long, bytes binary"), "contexts")
    dropped(wanted)
    return got


def repeated_spans(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(doc_id, t, spans array<bigint>): bytes that repeated windows cover, unmerged, of the texts that have any. docs: doc_id, t (a hash of id and text), text."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def anchors(batches):
        for _, texts, _ in window_slices(batches, 0, length):
            yield pa.RecordBatch.from_arrays([pa.array(regions(texts, length)[3].view(np.int64))], names=["a"])

    twice = stored(docs.select("text").mapInArrow(anchors, "a long").groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "anchors")
    shared = spark.sparkContext.broadcast(_bits(twice, "a"))  # at most 16 MB
    dropped(twice)

    def occurrences(batches):
        for batch, texts, before in window_slices(batches, 2, length):
            own, first, last, a, r, place, _, _ = regions(texts, length)
            k = np.flatnonzero(_in(shared.value, a))
            who = pa.array(own[k])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(first[k] + before), pa.array(last[k] + before), pa.array(place[k]), pa.array(a[k].view(np.int64)), pa.array(r[k].view(np.int64))], names=["doc_id", "t", "first", "last", "place", "key", "whole"])

    seen = stored(docs.select("doc_id", "t", "text").mapInArrow(occurrences, f"doc_id {kind}, t long, first long, last long, place long, key long, whole long"), "regions")
    out, some, read = _counted(seen, length, "regions")
    held = _fetched(docs, some, kind, length)
    read += [seen, held]
    for step in STEPS:
        large = held.filter(F.col("m") > group)
        if large.isEmpty():
            break
        out = out.unionByName(_compared(held.filter(F.col("m") <= group), kind, length))

        def classes(batches, step=step):
            for batch in by_bytes(batches, 5, SLICE):
                place = batch.column(4).to_numpy()
                own, first, last, core, whole = narrowed(batch.column(5), place, batch.column(3).to_numpy(), step, length)
                data, edges = raw(batch.column(5))
                begin, who, start = edges[own] + first, pa.array(own), batch.column(2).to_numpy()[own]
                cut = [data[x:y].tobytes() for x, y in zip(begin.tolist(), (begin + last - first + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(start + first), pa.array(start + last), pa.array(place[own] - first), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(cut, pa.binary())], names=["doc_id", "t", "first", "last", "place", "key", "whole", "bytes"])

        rows = large.select("doc_id", "t", "first", "key", "place", "bytes").mapInArrow(classes, f"doc_id {kind}, t long, first long, last long, place long, key long, whole long, bytes binary")
        seen = stored(rows, f"classes-{step}")
        settled, some, more = _counted(seen, length, f"classes-{step}")
        out, held = out.unionByName(settled), stored(some, "contexts")
        read += [seen, held, *more]
    spans = stored(out.unionByName(_compared(held, kind, length)).groupBy("doc_id", "t").agg(F.collect_set("span").alias("spans")), "spans")
    dropped(*read)
    return spans


# ---------------------------------------------------------------- cutting out
def _cut_out(texts: pa.Array, spans: pa.Array, words: bool) -> pa.StructArray:
    """n_bytes, n_removed, n_spans and what is left (``words``: as text, without characters of which only a part is left)."""
    data, edges = raw(texts)
    size = np.diff(edges)
    packed = pc.list_flatten(spans).to_numpy(zero_copy_only=False).astype(np.int64)
    at = edges[:-1][pc.list_parent_indices(spans).to_numpy(zero_copy_only=False)]
    depth = np.bincount(at + (packed >> 32), minlength=len(data) + 1)[: len(data) + 1] - np.bincount(at + (packed & 0xFFFFFFFF), minlength=len(data) + 1)[: len(data) + 1]
    gone = np.cumsum(depth)[:-1] > 0
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[edges])
    new = gone.copy()
    new[1:] &= ~gone[:-1]
    own = edges[:-1][size > 0]
    new[own] = gone[own]
    runs = np.diff(np.concatenate([[0], np.cumsum(new)])[edges])
    left = data[~gone]
    stops = np.concatenate([[0], np.cumsum(size - removed)]).astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(left.tobytes())])
    if words:
        kept = pa.array([x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string())
    return pa.StructArray.from_arrays([pa.array(size), pa.array(removed), pa.array(runs), kept], names=["n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, out: str = "repeats", words: bool = False, group: int = GROUP) -> DataFrame:
    """``docs`` with a struct: n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes; ``words``: as text, without characters of which only a part remains)."""
    body = column(text).cast("string")
    keyed = docs.select(column(doc_id).alias("doc_id"), F.xxhash64(column(doc_id), body).alias("t"), body.alias("text"))
    spans = repeated_spans(keyed, length, group)
    names = [c for c in docs.columns if c != out]
    left, right = docs.select(*map(column, names)).withColumn("__t", F.xxhash64(column(doc_id), body)), spans.select(F.col("doc_id").alias("__id"), F.col("t").alias("__u"), F.col("spans").alias("__spans"))
    both = left.join(right, (F.col("__t") == F.col("__u")) & column(doc_id).eqNullSafe(F.col("__id")), "left")

    def cut(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in columns:
            rows = pa.RecordBatch.from_arrays([texts, spans], names=["text", "spans"])
            parts = [_cut_out(s.column(0), pc.fill_null(s.column(1), pa.scalar([], spans.type)), words) for s in by_bytes([rows], 0, SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    kept = ("string", pa.string()) if words else ("binary", pa.binary())
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", kept[1])])
    cutter = F.arrow_udf(cut, f"struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:{kept[0]}>").asNondeterministic()
    return both.select(*map(column, names), cutter(body, F.col("__spans")).alias(out))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2(F.col("repeats.kept"), 256).alias("kept_sha256"))
