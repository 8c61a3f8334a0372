"""Exact Jaccard self-join of word n-gram sets, to components; set relations save the work on similar sets.

1. Texts with equal sets form one class. A class' shingles are ordered by rarity (counts from a hash sample of the texts;
   any order gives right results) and its first ``n - ceil(t n) + 1`` go into index lists, with their positions. Lists
   of one class go, and lists with the same members are one.
2. Answers first for pivots: of each list, the class that shares most lists is compared with all others, exactly.
3. Then every list is read in blocks ordered by size and position; a block that no set of another block can reach (length
   and positional bounds) is skipped. Pairs of different components remain, and their answer is derived from the pivot's
   where that decides: with o(x, p) and o(y, p) computed, o(x, y) is at least o(x, p) + o(y, p) - |p| and at most
   o(x, p) + |y| - o(y, p). What that leaves open is compared exactly.
   Before sets travel for a comparison, their parity bitmaps bound the answer: sets whose bitmaps differ in d bits have at
   least d elements that are not in both, so share (|x| + |y| - d) / 2 at most. The lists' members carry their bitmaps
   folded to about a bit a shingle (within ``FOLDED``), so that a pair which those rule out never becomes a row; the whole
   bitmaps judge the rest.
4. Links are contracted to components, and classes give each row its component's smallest id.

Two sets link when ``den * |both| >= num * |either|``. Shingles and sets are held as 64-bit hashes.

Defined cases: null, empty and blank texts have the empty set and link with nothing (their component is their own id);
a text of fewer words than a shingle has is one shingle; rows of one id are judged each by itself, and a null id is in its
component without naming it; an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, dropped, mix64, ragged, shingle_hashes, shuffle_partitions, stored, table
from .scan import HashIndex, by_bytes, words

SAMPLE = 16  # one text in so many gives the rarity order
SEEN = 6  # times in the sample from which a shingle counts as common
COMMON = 1 << 19  # common shingles sent to the tasks, the most frequent ones; all others count as rare
MERGE = 4096  # members up to which a list is held to merge it with equal ones; a longer one is named by its shingle
LIST = 512  # members of a list in one task; two parts of a longer one meet in a task of their own
BLOCK = 64
PARTNERS = 512  # of a pivot in one task
BITS = 23  # of the filter of classes to compare
PARITY = (1024, 1 << 20)  # least and most bits of a set's parity bitmap
FOLDED = (1024, 4096)  # of the one that a member of a list carries


def sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, ascending and distinct within each text; edges; class of each text)"""
    cut = words(texts)
    hashes, counts, n = cut.hashes(), cut.counts(), len(texts)
    room = np.repeat(cut.first[1:], counts) - np.arange(len(hashes))
    at = np.flatnonzero(room >= width)
    shingles = shingle_hashes(hashes, width)[at] if len(hashes) >= width else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), counts)[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.concatenate([shingle_hashes(hashes[cut.first[k] : cut.first[k + 1]], width) for k in short])
        shingles, owner = np.concatenate([shingles, whole]), np.concatenate([owner, short])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[new], owner[new]
    edges = np.searchsorted(owner, np.arange(n + 1))
    sums = np.zeros(n, np.uint64)
    if len(shingles):
        filled = np.flatnonzero(np.diff(edges))
        sums[filled] = np.add.reduceat(mix64(shingles + np.uint64(0x632BE59BD9B4E019)), edges[filled])
    return shingles, edges, mix64(sums + np.diff(edges).astype(np.uint64)).view(np.int64)


def parities(shingles: np.ndarray, edges: np.ndarray) -> pa.ListArray:
    """The parity bitmap of each set, as longs: bit k is the parity of the number of its shingles with hash k modulo the bitmap's bits.

    A set of n has the power of two from 4 n on, within PARITY; a bitmap's halves give the one of half as many bits.
    """
    n = np.diff(edges)
    bits = 1 << np.ceil(np.log2(np.clip(4 * n, *PARITY))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(base[:-1], n) + (shingles & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(base[-1])) & 1
    longs = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array((base // 64).astype(np.int32)), pa.array(longs))


def _halved(bits: F.Column) -> F.Column:
    half = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _folded(bits: F.Column) -> F.Column:
    """The bitmap with a quarter of its bits, within FOLDED."""
    longs = F.least(F.greatest(F.floor(F.size(bits) / 4).cast("int"), F.lit(FOLDED[0] // 64)), F.lit(FOLDED[1] // 64))
    return F.transform(F.sequence(F.lit(0), longs - 1), lambda k: F.aggregate(F.sequence(k, F.size(bits) - 1, longs), F.lit(0).cast("long"), lambda s, i: s.bitwiseXOR(F.get(bits, i))))


def _by_size(bits: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(longs of each bitmap; for each such size the bitmaps of that size and, halved, of twice it, and the row of each member there or -1)"""
    size = np.fromiter(map(len, bits), np.int64, len(bits))
    held = {k: np.stack(bits[size == k]).view(np.uint64) for k in np.unique(size).tolist()}
    out = {}
    for k, own in held.items():
        at = np.full(len(bits), -1)
        at[size == k] = np.arange(len(own))
        if (twice := held.get(2 * k)) is not None:
            at[size == 2 * k] = len(own) + np.arange(len(twice))
            own = np.concatenate([own, twice[:, :k] ^ twice[:, k:]])
        out[k] = own, at
    return size, out


def _near(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps do not rule out (of sizes that differ by less than two, so that one halving makes them alike). marks: cls, n, bits."""
    a, b = (marks.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
    x = F.when(F.size("bitsa") > F.size("bitsb"), _halved(F.col("bitsa"))).otherwise(F.col("bitsa"))
    y = F.when(F.size("bitsb") > F.size("bitsa"), _halved(F.col("bitsb"))).otherwise(F.col("bitsb"))
    differ = F.aggregate(F.zip_with(x, y, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    both = F.col("na") + F.col("nb")
    return pairs.join(a, "a").join(b, "b").filter((both - differ) * (num + den) >= 2 * num * both).select("a", "b")


def _least(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles that sets of these sizes must share."""
    return -(-(num * (n + m)) // (num + den))


def _runs(batches, key: int = 0) -> Iterator[list[np.ndarray]]:
    """Runs of equal keys of sorted batches, as column arrays."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cuts = np.flatnonzero(np.diff(cols[key])) + 1
        if held and held[-1][key][-1] != cols[key][0]:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        begin = 0
        for c in cuts:
            held.append([x[begin:c] for x in cols])
            yield [np.concatenate(x) for x in zip(*held, strict=True)] if len(held) > 1 else held[0]
            held, begin = [], c
        held.append([x[begin:] for x in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


# ---------------------------------------------------------------- the steps
def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that are frequent in the sample, their counts)"""

    def run(batches):
        for batch in by_bytes(batches, 0):
            shingles, _, _ = sets(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64))], names=["h"])

    sample = docs.filter(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(SAMPLE)) == 0).select("text")
    seen = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN)
    got = seen.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    return got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()


def _lists(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(list, cls, n, place): members of the index lists that hold more than one class."""
    spark = docs.sparkSession
    index, (common, counts) = HashIndex(), _common(docs, width)
    index.add(common, np.arange(len(common), dtype=np.int32))
    sent = spark.sparkContext.broadcast((index, np.append(counts, 0)))

    def prefixes(batches):
        index, counts = sent.value
        for batch in by_bytes(batches, 0):
            shingles, edges, cls = sets(batch.column(0), width)
            n = np.diff(edges)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((shingles, counts[index.find(shingles)], owner))
            keep = np.where(n > 0, n + (-num * n // den) + 1, 0)  # n - ceil(num n / den) + 1
            place = ragged(np.zeros(len(n), np.int64), keep)
            which = np.repeat(np.arange(len(n)), keep)
            at = order[edges[which] + place]
            yield pa.RecordBatch.from_arrays([pa.array(shingles[at].view(np.int64)), pa.array(cls[which]), pa.array(n[which].astype(np.int32)), pa.array(place.astype(np.int32))], names=["h", "cls", "n", "place"])

    def merged(batches):
        held, long = None, None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if len(cols[0]) - last > MERGE:  # too long to hold: the shingle itself names the list, here and in what follows
                long, last = cols[0][-1], len(cols[0])
            held = [x[last:] for x in cols]
            yield _merged(*(x[:last] for x in cols), long, num, den)
        if held:
            yield _merged(*held, long, num, den)

    rows = docs.select("text").mapInArrow(prefixes, "h long, cls long, n int, place int")
    placed = rows.repartition(shuffle_partitions(spark), "h").sortWithinPartitions("h")
    return placed.mapInArrow(merged, "list long, cls long, n int, place int").groupBy("list", "cls").agg(F.min("n").alias("n"), F.min("place").alias("place"))


def _merged(h: np.ndarray, cls: np.ndarray, n: np.ndarray, place: np.ndarray, long: int | None, num: int, den: int) -> pa.RecordBatch:
    """Lists of whole runs of ``h``: members that no other member can reach are left out, equal lists get one name."""
    several = np.zeros(len(h), bool)
    same = h[1:] == h[:-1]
    several[1:] |= same
    several[:-1] |= same
    if long is not None:
        several |= h == long
    h, cls, n, place = (x[several] for x in (h, cls, n, place))
    order = np.lexsort((place, cls, h))
    h, cls, n, place = (x[order] for x in (h, cls, n.astype(np.int64), place.astype(np.int64)))
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
    h, cls, n, place = (x[first] for x in (h, cls, n, place))
    starts = np.flatnonzero(np.diff(h, prepend=h[0] - 1 if len(h) else 0) != 0) if len(h) else np.empty(0, np.int64)
    size = np.diff(np.append(starts, len(h)))

    def fit(x, y):
        return (den * n[x] >= num * n[y]) & (den * n[y] >= num * n[x]) & (np.minimum(n[x] - place[x], n[y] - place[y]) >= _least(n[x], n[y], num, den))

    keep = np.repeat(size > BLOCK, size)
    if long is not None:
        keep |= h == long
    two = starts[size == 2]
    keep[two] |= fit(two, two + 1)
    keep[two + 1] |= keep[two]
    for at, k in zip(starts[(size > 2) & (size <= BLOCK)].tolist(), size[(size > 2) & (size <= BLOCK)].tolist(), strict=True):
        x = np.arange(at, at + k)
        good = fit(x[:, None], x[None, :])
        np.fill_diagonal(good, False)
        keep[x] |= good.any(axis=1)
    h, cls, n, place = (x[keep] for x in (h, cls, n, place))
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    size = np.diff(np.append(starts, len(h)))
    name = h.copy()
    if len(h):
        sums = mix64(np.add.reduceat(mix64(cls.view(np.uint64)), starts) + size.astype(np.uint64)).view(np.int64)
        name = np.repeat(np.where((size > MERGE) | (h[starts] == long if long is not None else False), h[starts], sums), size)
    return pa.RecordBatch.from_arrays([pa.array(name), pa.array(cls), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], names=["list", "cls", "n", "place"])


def _sets_of(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(cls, shingles binary) of these classes. A filter of fixed size lets most others not reach the shuffle."""
    spark = docs.sparkSession
    bit = F.pmod(F.col("cls"), F.lit(1 << BITS))
    marks = classes.groupBy(F.shiftright(bit, 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(cls, 64) as int))")).alias("b"))
    got = marks.toArrow()  # at most 2 ** (BITS - 6) rows
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[got.column("i").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(bits)

    def run(batches):
        bits = sent.value
        for batch in by_bytes(batches, 0):
            shingles, edges, cls = sets(batch.column(0), width)
            bit = cls.view(np.uint64) & np.uint64((1 << BITS) - 1)
            maybe = np.flatnonzero((bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) & (np.diff(edges) > 0).astype(np.uint64))
            maybe = maybe[np.unique(cls[maybe], return_index=True)[1]]
            raw = [shingles[edges[k] : edges[k + 1]].tobytes() for k in maybe]
            yield pa.RecordBatch.from_arrays([pa.array(cls[maybe]), pa.array(raw, pa.binary())], names=["cls", "shingles"])

    return docs.select("text").mapInArrow(run, "cls long, shingles binary").dropDuplicates(["cls"])


def _overlaps(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(a, b, both): exact overlaps of distinct pairs (a, b). The set of ``a`` travels once, each ``b``'s once a pair."""
    spark = pairs.sparkSession
    held = _sets_of(docs, pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), width)
    selves = pairs.select("a").distinct().select("a", F.col("a").alias("b"))
    rows = pairs.select("a", "b").unionByName(selves).join(held.withColumnRenamed("cls", "b"), "b").select("a", "b", "shingles", (F.col("a") != F.col("b")).alias("other"))

    def count(batches):
        own, of = None, None
        for batch in batches:
            a, b, other = (batch.column(c).to_pylist() for c in ("a", "b", "other"))
            out = []
            for k, raw in enumerate(batch.column("shingles")):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                if not other[k]:
                    of, own = a[k], x
                    continue
                if of != a[k]:
                    raise ValueError("a pair without its first set")
                at = np.searchsorted(own, x)
                out.append((a[k], b[k], int((own[np.minimum(at, len(own) - 1)] == x).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32())], names=["a", "b", "both"])

    # A pivot with very many partners has them dealt over parts, each with the pivot's set.
    some = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    some = some.filter("parts > 1")
    salted = rows.join(some, "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.sequence(F.lit(0), F.col("parts") - 1)
    salted = salted.withColumn("part", F.explode(F.when(F.col("other"), F.array(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))).otherwise(own))).drop("parts")
    placed = salted.repartition(shuffle_partitions(spark), "a", "part").sortWithinPartitions("a", "part", "other")
    return placed.mapInArrow(count, "a long, b long, both int")


def _open_pairs(members: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) of lists' pairs in different components, but those that the pivot's answers or the folded bitmaps rule out. members: list, cls, n, place, comp, both (with the pivot), pivot_n; marks: cls, n, bits.

    Lists within one component go before they reach a task. A list of more than LIST members is dealt into parts, and a task
    compares two of them (or one with itself), so that no task gets a whole long list.
    """

    def run(batches):
        for _, cls, n, place, comp, both, pivot_n, part, cross, bits in _runs(batches):
            if (comp == comp[0]).all():
                continue
            order = np.lexsort((place, n))
            cls, n, place, comp, both, pivot_n, part = (x[order].astype(np.int64) for x in (cls, n, place, comp, both, pivot_n, part))
            longs, maps = _by_size(bits[order])
            starts = np.arange(0, len(cls), BLOCK)
            low_n = n[starts]
            low_place = np.minimum.reduceat(place, starts)
            one = np.maximum.reduceat(comp, starts) == np.minimum.reduceat(comp, starts)
            for x in range(len(cls) - 1):
                if x and cls[x] == cls[x - 1]:
                    continue
                need = -(-num * n[x] // den)
                first = x // BLOCK
                # The sizes of later blocks ascend; a block is skipped if all of it is too long, too late in its sets, or of x's component.
                last = first + np.searchsorted(low_n[first:], den * n[x] // num, "right")
                blocks = np.arange(first, last)
                top_n = n[np.minimum(starts[blocks] + BLOCK, len(cls)) - 1]
                reach = np.minimum(n[x] - place[x], top_n - low_place[blocks])
                blocks = blocks[(reach >= need) & ~(one[blocks] & (comp[starts[blocks]] == comp[x]))]
                if not len(blocks):
                    continue
                y = ragged(starts[blocks], np.minimum(BLOCK, len(cls) - starts[blocks]))
                y = y[(y > x) & (comp[y] != comp[x])]
                if cross[0]:
                    y = y[part[y] != part[x]]
                least = _least(n[x], n[y], num, den)
                fits = (den * n[x] >= num * n[y]) & (np.minimum(n[x] - place[x], n[y] - place[y]) >= least)
                # No answer with the pivot (both < 0): nothing to derive from.
                derived = (both[x] >= 0) & (both[y] >= 0)
                most = np.minimum(both[x] + n[y] - both[y], both[y] + n[x] - both[x])
                fits &= ~derived | (most >= least)
                sure = derived & (both[x] + both[y] - pivot_n[x] >= least)
                y, sure = y[fits], sure[fits]
                maps_x, at = maps[longs[x]]
                differ = np.where(at[y] < 0, 0, np.bitwise_count(maps_x[at[x]] ^ maps_x[at[y]]).sum(axis=1, dtype=np.int64))
                near = (n[x] + n[y] - differ) * (num + den) >= 2 * num * (n[x] + n[y])
                y, sure = y[near], sure[near]
                if len(y):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[x], cls[y])), pa.array(np.maximum(cls[x], cls[y])), pa.array(sure)], names=["a", "b", "linked"])

    sizes = members.groupBy("list").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    sizes = stored(sizes.filter("m > 2 and low < high").select("list", F.ceil(F.col("m") / LIST).cast("int").alias("parts")), "open-lists")
    dealt = stored(members.join(sizes, "list"), "open-members")
    bits = marks.join(dealt.select("cls").distinct(), "cls", "left_semi").select("cls", _folded(F.col("bits")).alias("bits"))
    dealt = dealt.join(bits, "cls").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.xxhash64("list", F.least("part", "other"), F.greatest("part", "other"))
    dealt = dealt.select(key.alias("key"), "cls", "n", "place", "comp", "both", "pivot_n", "part", (F.col("part") != F.col("other")).cast("int").alias("cross"), "bits")
    placed = dealt.repartition(shuffle_partitions(members.sparkSession), "key").sortWithinPartitions("key", "cross")
    return placed.mapInArrow(run, "a long, b long, linked boolean").groupBy("a", "b").agg(F.bool_or("linked").alias("linked"))


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp) of every node of (a, b): each adopts its smallest neighbour, edges are contracted, until none is left."""
    edges = stored(edges.select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "step")
        if labels is None:
            labels = step.select(F.col("a").alias("cls"), F.col("to").alias("comp"))
        else:
            labels = labels.join(step.withColumnRenamed("a", "comp"), "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp"))
        labels = stored(labels, "labels")
        moved = edges.join(step.select("a", F.col("to").alias("x")), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = stored(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("cls"), F.col("b").alias("comp"))


def linked(docs: DataFrame, marks: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b): links between classes of ``docs`` (text; marks: their cls, n, bits), enough of them to connect every component."""
    lists = stored(_lists(docs, width, num, den), "lists")
    # What is joined by list is a table of its own each time, so that Spark can split the rows of a long list.
    counts = stored(lists.groupBy("list").agg(F.count("*").alias("m")), "counts")
    score = lists.join(counts, "list").groupBy("cls").agg(F.sum("m").alias("score"))
    pivots = lists.join(score, "cls").groupBy("list").agg(F.max(F.struct("score", "cls", "n")).alias("p"))
    pivots = stored(pivots.select("list", F.col("p.cls").alias("pivot"), F.col("p.n").alias("pivot_n")), "pivots")
    members = stored(lists.join(pivots, "list"), "members")
    dropped(counts, pivots)
    fits = (F.col("n") * den >= F.col("pivot_n") * num) & (F.col("pivot_n") * den >= F.col("n") * num)
    first = members.filter((F.col("pivot") != F.col("cls")) & fits).select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct()
    answers = stored(_overlaps(stored(_near(first, marks, num, den), "first"), docs, width), "answers")
    sizes = lists.select("cls", "n").distinct()
    enough = lambda df: df.join(sizes.select(F.col("cls").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("cls").alias("b"), F.col("n").alias("nb")), "b").filter(F.col("both") * (num + den) >= (F.col("na") + F.col("nb")) * num)
    links = stored(enough(answers).select("a", "b"), "links")
    labels = components(links)
    rows = members.join(labels, "cls", "left").join(answers.select(F.col("a").alias("pivot"), F.col("b").alias("cls"), "both"), ["pivot", "cls"], "left")
    rows = rows.select("list", "cls", "n", "place", F.coalesce("comp", "cls").alias("comp"), F.when(F.col("pivot") == F.col("cls"), F.col("n")).otherwise(F.coalesce("both", F.lit(-1))).alias("both"), "pivot_n")
    open_pairs = stored(_open_pairs(rows, marks, num, den), "pairs")
    done = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(_near(open_pairs.filter("not linked").select("a", "b").join(done, ["a", "b"], "left_anti"), marks, num, den), "rest")
    return links.unionByName(open_pairs.filter("linked").select("a", "b")).unionByName(enough(_overlaps(rest, docs, width)).select("a", "b"))


def _row(doc_id: str, text: str) -> F.Column:
    """What a row is known by: equal for rows with equal id and text only."""
    return F.xxhash64(column(doc_id), column(text).cast("string"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, row, comp) of every row; row: a hash of id and text, comp: names the component (null for the empty set)."""
    rows = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text"), _row(doc_id, text).alias("row"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def classes(batches):
        for batch in by_bytes(batches, 1):
            shingles, edges, cls = sets(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(edges)), pa.array(cls), parities(shingles, edges)], names=["doc_id", "row", "n", "cls", "bits"])

    whole = stored(rows.mapInArrow(classes, f"doc_id {kind}, row long, n long, cls long, bits array<bigint>"), "classes")
    known = whole
    marks = stored(known.filter("n > 0").dropDuplicates(["cls"]).select("cls", "n", "bits"), "marks")
    known = known.drop("bits")
    full = known.filter("n > 0")
    named = full.groupBy("cls").agg(F.min("doc_id").alias("first")).join(components(linked(rows.drop("row"), marks, width, num, den)), "cls", "left")
    named = stored(named.select("cls", F.coalesce("comp", "cls").alias("comp"), "first"), "named")
    smallest = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    parts = 16
    of_class = named.join(smallest, "comp").select("cls", "comp", "component_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = full.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).join(of_class, ["cls", "part"])
    empty = known.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "row", F.lit(None).cast("long").alias("comp"))
    dropped(marks)
    return dealt.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "row", "comp").unionByName(empty)


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Exactly one row of each component stays, with the columns of ``docs``: that of the smallest id (of equal ids, that of the
    smallest hash; of equal rows, any one; rows without an id come last). Rows of the empty set stay."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, width=width, num=num, den=den).filter("comp is not null")
    each = stored(found.groupBy("comp", "doc_id", "row").agg(F.count("*").alias("copies")), "rows")
    first = each.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("f")).select("comp", F.col("f.row").alias("kept"))
    each = each.join(first, "comp").select("row", (F.col("row") == F.col("kept")).alias("kept"), "copies")
    several = stored(each.filter("not kept or copies > 1"), "gone")
    own = docs.withColumn("__row", _row(doc_id, text))
    alone = own.join(several.select(F.col("row").alias("__row")), "__row", "left_anti")
    one = own.join(several.filter("kept").select(F.col("row").alias("__row")), "__row", "left_semi").dropDuplicates(["__row"])
    return alone.unionByName(one).select(*map(column, docs.columns))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, num=85, den=100).drop("row", "comp")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b USING (x) JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY a) AS m USING (doc_id)
"""
