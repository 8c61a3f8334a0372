"""Texts of an Arrow column cut into words or tokenizer pieces with numpy, and the pieces' 64-bit hashes.

No Python object a word: a slice's UTF-8 bytes are classified through tables, boundaries are found by comparing
neighbours, and hashes of all pieces come from one prefix sum.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back, mix64, ragged

#: Text bytes of a slice, unless one text alone is longer.
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inverse)):
            _POWERS[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n + n // 4, b, np.uint64))])
    return _POWERS[0], _POWERS[1]


def by_bytes(batches: Iterable[pa.RecordBatch], text: int, most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` text bytes (or one row) and ``rows`` rows."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            stop = min(max(stop, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (nulls are empty) and their edges, n + 1 offsets."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]] if len(texts) and texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, edges - edges[0]


#: Lower case for A-Z only; and which bytes are in a word.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
NOT_SPACE = np.array([c not in b" \t\n\x0b\x0c\r" for c in range(256)])
ALNUM = np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])


class Cut:
    """Pieces of a slice: ``data`` (bytes as hashed), ``start``, ``end``, and ``first`` (n + 1: index of each text's first piece)."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.edges, self.start, self.end = data, edges, start, end
        self.first = np.searchsorted(start, edges)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edges) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """Never 0; equal bytes, equal hash."""
        power, inverse = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=sums[1:])
        out = mix64((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        return np.maximum(out, np.uint64(1))

    def piece(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()

    def pieces(self, which: np.ndarray) -> list[bytes]:
        size = self.end[which] - self.start[which]
        held, edge = self.data[ragged(self.start[which], size)].tobytes(), np.concatenate([[0], np.cumsum(size)]).tolist()
        return [held[edge[k] : edge[k + 1]] for k in range(len(which))]


def words(texts: pa.Array, within: np.ndarray = NOT_SPACE) -> Cut:
    """Runs of bytes that ``within`` allows, after lower-casing A-Z; never across texts."""
    data, edges = raw(texts)
    data = LOWER[data]
    inside = within[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    own = edges[:-1][edges[:-1] < len(data)]
    start[own] = inside[own]
    last = edges[1:][edges[1:] > 0] - 1
    end[last] = inside[last]
    return Cut(data, edges, np.flatnonzero(start), np.flatnonzero(end) + 1)


# ---------------------------------------------------------------- tokenizer patterns, up to U+017F
_SPACES = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
_CLASS = np.array([0 if c in _SPACES else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(0x180)], np.uint8)
_SMALL = np.array([ord(chr(c).lower()) if c != 0x130 else c for c in range(0x180)], np.int64)
_AFTER = {b"s", b"t", b"m", b"d"}


def _classes(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, class of each byte's character)"""
    data = data.copy()
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
    lead = lead[lead + 1 < len(data)]
    point = ((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
    kind = _CLASS[np.minimum(data, 127)]
    if lower:
        data = LOWER[data]
        point = _SMALL[point]
        data[lead], data[lead + 1] = 0xC0 | (point >> 6), 0x80 | (point & 0x3F)
    kind[lead] = kind[lead + 1] = _CLASS[point]
    return data, kind


def odd_texts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which texts hold a character beyond U+017F, or U+0130."""
    odd = data >= 0xC6
    odd[1:] |= (data[1:] == 0xB0) & (data[:-1] == 0xC4)
    return np.diff(np.concatenate([[0], np.cumsum(odd)])[edges]) > 0


def _contractions(data: np.ndarray, kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes ``at``: those that begin 's 't 're 've 'm 'll 'd, and how many letters follow."""
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b = padded[at + 1], padded[at + 2]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = (b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l"))
    n = np.where(one, 1, np.where(two, 2, 0))
    return at[n > 0], n[n > 0]


def _joined(data: np.ndarray, kind: np.ndarray, begins: np.ndarray, start: np.ndarray, lone: np.ndarray) -> None:
    """Moves the starts after contractions: the letters that belong to one start no piece, the rest of the word does."""
    at, n = _contractions(data, kind, lone)
    inside = (at + n < len(data)) & (np.searchsorted(begins, at, "right") == np.searchsorted(begins, np.minimum(at + n, len(data) - 1), "right"))
    at, n = at[inside], n[inside]
    start[at + 1] = False
    after = at + n + 1
    after = after[after < len(data)]
    start[after] |= kind[after] == 1


def word_bpe_pieces(texts: pa.Array) -> tuple[Cut, np.ndarray]:
    """Lower-cased pieces of ``'s|'t|'re|'ve|'m|'ll|'d|[letters]+|[number]|[other]+``; and which texts it must not be used for."""
    data, edges = raw(texts)
    odd = odd_texts(data, edges)
    data, kind = _classes(data, True)
    begins = edges[:-1][np.diff(edges) > 0]
    start = np.ones(len(data), bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= (kind == 2) & ((data & 0xC0) != 0x80)
    start[begins] = True
    _joined(data, kind, begins, start, np.flatnonzero((data == ord("'")) & start))
    start &= kind > 0
    stop = start | (kind == 0)
    stop[begins] = True
    stops = np.append(np.flatnonzero(stop), len(data))
    at = np.flatnonzero(start)
    return Cut(data, edges, at, stops[np.searchsorted(stops, at, "right")]), odd


def byte_bpe_pieces(texts: pa.Array) -> tuple[Cut, np.ndarray]:
    """Pieces of ``'s|'t|'re|'ve|'m|'ll|'d| ?letters+| ?numbers+| ?other+|\\s+(?!\\S)|\\s+``; and which texts it must not be used for."""
    data, edges = raw(texts)
    odd = odd_texts(data, edges)
    data, kind = _classes(data, False)
    begins, n = edges[:-1][np.diff(edges) > 0], len(data)
    lead = (data & 0xC0) != 0x80
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change[begins] = True
    start = change.copy()
    fresh = change.copy()  # runs that no blank is joined to
    # The last blank before a run of another kind in the same text goes with that run, if it is U+0020, or else alone.
    heads = np.flatnonzero(change & (kind > 0))
    heads = heads[heads > 0]
    heads = heads[(kind[heads - 1] == 0) & ~np.isin(heads, begins)]
    blank = data[heads - 1] == 32
    start[heads[blank]] = False
    fresh[heads[blank]] = False
    last = heads - 1
    last = np.where(lead[last], last, last - 1)
    start[last] = True
    _joined(data, kind, begins, start, np.flatnonzero((data == ord("'")) & fresh & (kind == 3)))
    at = np.flatnonzero(start)
    return Cut(data, edges, at, np.append(at[1:], n)), odd


class HashIndex:
    """uint64 hash -> int, both ways in numpy: open addressing with linear probing."""

    def __init__(self, bits: int = 12):
        self.n, self.keys, self.values = 0, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Values, or -1."""
        out, todo, mask = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), np.uint64(len(self.keys) - 1)
        slot, left = hashes & mask, hashes
        while len(todo):
            held = self.keys[slot]
            hit = held == left
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held != 0)
            todo, left, slot = todo[on], left[on], (slot[on] + np.uint64(1)) & mask
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """New and distinct hashes."""
        if 2 * (self.n + len(hashes)) > len(self.keys):
            kept = self.keys != 0
            old, size = (self.keys[kept], self.values[kept]), len(self.keys)
            while 2 * (self.n + len(hashes)) > size:
                size *= 2
            self.n, self.keys, self.values = 0, np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self.add(*old)
        self.n += len(hashes)
        mask = np.uint64(len(self.keys) - 1)
        slot = hashes & mask
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            done = self.keys[slot] == hashes
            self.values[slot[done]] = values[done]
            on = ~done
            hashes, values, slot = hashes[on], values[on], (slot[on] + np.uint64(1)) & mask


class PieceIds:
    """Ids of pieces, each distinct piece encoded once: ``encode`` takes pieces and returns (ids, number for each)."""

    def __init__(self, encode, dtype=np.uint16, most: int = 1_500_000):
        self.encode, self.dtype, self.most = encode, dtype, most
        self.clear()

    def clear(self) -> None:
        self.index = HashIndex()
        self.flat, self.start, self.size = [np.empty(0, self.dtype)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        self.n = self.used = 0

    def _one(self, parts: list) -> np.ndarray:
        if len(parts) > 1:
            parts[:] = [np.concatenate(parts)]
        return parts[0]

    def learn(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        self.index.add(hashes, self.n + np.arange(len(hashes)))
        self.start.append(self.used + np.cumsum(size) - size)
        self.size.append(size.astype(np.int32))
        self.flat.append(ids.astype(self.dtype))
        self.n, self.used = self.n + len(hashes), self.used + len(ids)

    def rows(self, cut: Cut) -> np.ndarray:
        """The row of every piece."""
        hashes = cut.hashes()
        if self.n > self.most:
            self.clear()
        rows = self.index.find(hashes)
        if len(missing := np.flatnonzero(rows < 0)):
            new, first = np.unique(hashes[missing], return_index=True)
            self.learn(new, *self.encode(cut.pieces(missing[first])))
            rows[missing] = self.index.find(hashes[missing])
        return rows

    def ids(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and their number for each text."""
        rows = self.rows(cut)
        size = self._one(self.size)[rows].astype(np.int64)
        ids = self._one(self.flat)[ragged(self._one(self.start)[rows], size)]
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[cut.first])


class PieceCounts:
    """Counts of distinct pieces, by hash; ``drain`` hands them out as Arrow batches (piece binary, n long)."""

    def __init__(self):
        self.index, self.pieces, self.counts = HashIndex(), [], np.zeros(0, np.int64)

    def add(self, cut: Cut, which: np.ndarray | None = None) -> None:
        hashes = cut.hashes()
        at = np.arange(len(hashes)) if which is None else which
        hashes = hashes[at]
        rows = self.index.find(hashes)
        if len(missing := np.flatnonzero(rows < 0)):
            new, first = np.unique(hashes[missing], return_index=True)
            self.index.add(new, len(self.pieces) + np.arange(len(new)))
            self.pieces += cut.pieces(at[missing[first]])
            self.counts = np.concatenate([self.counts, np.zeros(len(new), np.int64)])
            rows[missing] = self.index.find(hashes[missing])
        self.counts += np.bincount(rows, minlength=len(self.counts))

    def drain(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.pieces), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(self.pieces[at : at + 50_000], pa.binary()), pa.array(self.counts[at : at + 50_000])], names=["piece", "n"])
        self.__init__()


def piece_counts(docs, cut, text: str = "text", most: int = 500_000):
    """(piece binary, n long) over all rows: summed in each task before the shuffle. ``cut``: texts -> Cut."""
    from pyspark.sql import functions as F

    from .common import column

    def run(batches):
        held = PieceCounts()
        for batch in by_bytes(batches, 0):
            held.add(cut(batch.column(0)))
            if len(held.pieces) > most:
                yield from held.drain()
        yield from held.drain()

    return docs.select(column(text).cast("string")).mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def head(counts, most: int):
    """The rows of (piece, n) with the highest counts, at most ``most`` of them: all with n of at least the lowest bound that allows it."""
    from pyspark.sql import functions as F

    # Counts down to their ten leading bits: some 30,000 different ones at most.
    bits = "greatest(length(bin(n)) - 10, 0)"
    low = F.expr(f"shiftleft(shiftright(n, {bits}), {bits})")
    steps = sorted((r.n, r.k) for r in counts.groupBy(low.alias("n")).agg(F.count("*").alias("k")).collect())
    bound, total = (steps[-1][0] + 1 if steps else 1), 0
    for n, k in reversed(steps):
        if (total := total + k) > most:
            break
        bound = n
    return counts.filter(F.col("n") >= bound)
