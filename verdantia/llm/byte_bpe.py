"""Byte-level BPE, encoding and decoding.

1. Every match of the tokenizer's pattern is a piece; the corpus' distinct pieces are counted.
2. Every distinct piece is encoded once, by Spark higher-order functions: a fold over the piece's bytes merges the adjacent pair
   of lowest rank until none has one; the ranks of pairs are arrays of a broadcast row. (A piece of more than ``LONG`` bytes, for which
   a fold that copies arrays is quadratic, is merged by a heap of its pairs.)
3. The ids come back to the texts in two ways: those of the most frequent pieces (at most ``HEAD``) are
   sent to all tasks; the others are joined by the pieces' 64-bit hashes, once for each text that has them.
4. Decoding concatenates the ids' binary pieces in Spark.

Defined cases: null and empty texts have no ids and decode to nothing; repeated rows and ties stay as they are; an empty
table gives an empty one; only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, dropped, ragged, shuffle_partitions, stored, table
from .scan import Cut, HashIndex, by_bytes, byte_bpe_pieces, head, piece_counts, raw

#: Most frequent pieces, whose ids are sent to all tasks; bounds that broadcast (some 25 MB).
HEAD = 1 << 19
#: Bytes of a piece beyond which folds of arrays take too many rounds: a heap of pairs merges it.
LONG = 512
#: Pieces of one row of folds, which holds the ranks once for all of them.
TOGETHER = 1024


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


# ---------------------------------------------------------------- Spark's fold
_NONE = 1 << 32  # above all numbers of pairs that may merge
_TYPES = {"held": "array<bigint>", "shift": "array<bigint>", "two": "array<bigint>", "one": "array<int>"}


def rank_tables(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """What a fold looks up: ``one``, ids of single bytes; ``two``, numbers of two single bytes; ``held`` and ``shift``, all pairs.

    A pair may merge if its joined bytes are a token, however that token is split. Its number is at ``held[shift[left] + right]``,
    where the pairs of a left part lie between those of others: left * 2 ** 32 + (what they become) * 65536.
    """
    one = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    two = np.repeat(one.astype(np.int64), 256) + _NONE
    pairs: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        if len(token) == 2:
            two[token[0] * 256 + token[1]] += (rank << 16) - _NONE
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                pairs.setdefault(left, []).append((right, rank))
    shift, free, held = np.zeros(1 << 16, np.int64), np.ones(1 << 18, bool), np.full(1 << 18, 1 << 48)
    for left in sorted(pairs, key=lambda k: -len(pairs[k])):
        right, rank = np.array(pairs[left], np.int64).T
        at = left * 40503 % (1 << 18)  # spread, so that a free place is near
        while True:
            while at + 1024 + (1 << 16) > len(free):
                free, held = np.append(free, np.ones(1 << 16, bool)), np.append(held, np.full(1 << 16, 1 << 48))
            fits = free[at + right[0] : at + right[0] + 1024].copy()
            for k in right[1:].tolist():
                fits &= free[at + k : at + k + 1024]
            if fits.any():
                break
            at += 1024
        at += int(fits.argmax())
        shift[left], free[at + right], held[at + right] = at, False, (left << 32) + (rank << 16)
    return {"held": held[: int(shift.max()) + (1 << 16)], "shift": shift, "two": two, "one": one}


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _fold(piece: str) -> str:
    """SQL of the ids of one binary piece of at least two bytes, where the names of ``rank_tables`` are bound: array<int>.

    The state is an array of one number a part: its id, and above 16 bits the rank of the pair that it begins. The least
    number is the pair to merge (the first of equals); its parts become one, and the pairs beside it get new ranks. Written
    as SQL, as its trees are evaluated faster than those of the column functions.
    """

    def part(left: str, right: str) -> str:  # a pair that another left part holds keeps bits above 32
        return f"get(held, get(shift, {left}) + {right}) ^ {left} * {_NONE + 1}L"

    last, made = f"{_NONE}L", "shiftright(m, 16)"
    before, own = part("(get(s, p - 2) & 65535L)", made), f"coalesce({part(made, '(get(s, p + 1) & 65535L)')}, {last} + {made})"
    after = "slice(s, p + 2, size(s))"
    merged = _let("int(array_position(s, m))", "p", f"if(p > 1, concat(slice(s, 1, p - 2), array({before}, {own}), {after}), concat(array({own}), {after}))")
    step = f"(s, x) -> {_let('array_min(s)', 'm', f'if(m >= {last}, s, {merged})')}"
    start = f"concat(zip_with(slice(i, 1, size(i) - 1), slice(i, 2, size(i)), (a, b) -> get(two, a * 256 + b)), array({last} + get(one, element_at(i, -1))))"
    fold = f"aggregate(sequence(2, size(i)), {start}, {step}, s -> transform(s, e -> int(e & 65535L)))"
    single = f"transform(split(decode({piece}, 'ISO-8859-1'), ''), c -> ascii(c))"
    return _let(single, "i", fold)


def fold_merges(piece: str, ranks: dict[bytes, int]) -> Column:
    """Ids of one binary piece (a column's name) of at least two bytes: array<int>; the ranks are a literal, for few rows."""
    sql = _fold(piece)
    for name, values in rank_tables(ranks).items():
        sql = _let(f"from_json('{json.dumps(values.tolist(), separators=(',', ':'))}', '{_TYPES[name]}')", name, sql)
    return F.expr(sql)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One long piece: the pairs in a heap by (rank, place), the parts in a linked list."""
    import heapq

    after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    parts: list = [piece[k : k + 1] for k in range(len(piece))]
    heap: list = []

    def put(k: int) -> None:
        if k >= 0 and (n := after[k]) < len(parts) and (r := ranks.get(parts[k] + parts[n])) is not None:
            heapq.heappush(heap, (r, k, parts[k], parts[n]))

    for k in range(len(parts) - 1):
        put(k)
    while heap:
        _, k, a, b = heapq.heappop(heap)
        if parts[k] is not a or (n := after[k]) >= len(parts) or parts[n] is not b:
            continue
        parts[k], parts[n], after[k] = a + b, None, after[n]
        if after[n] < len(parts):
            before[after[n]] = k
        put(before[k])
        put(k)
    return [ranks[x] for x in parts if x is not None]


# ---------------------------------------------------------------- texts to pieces
def cut_texts(texts: pa.Array) -> Cut:
    """Every match of the pattern as a piece; texts beyond Latin Extended-A by the regex library."""
    cut, odd = byte_bpe_pieces(texts)
    if odd.any():
        sizes, edges = [], cut.edges
        size = cut.end - cut.start
        for k in range(len(edges) - 1):
            own = size[cut.first[k] : cut.first[k + 1]]
            sizes.append(np.array([len(x.encode()) for x in _pattern().findall(texts[k].as_py())], np.int64) if odd[k] else own)
        size = np.concatenate(sizes)
        end = np.cumsum(size)
        return Cut(cut.data, edges, end - size, end)
    return cut


@functools.lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def _in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, n, id) as one row for ``TOGETHER`` pieces, with their hashes."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            piece, n, own = batch.slice(at, TOGETHER).columns
            data, edges = raw(piece)
            h = pa.array(Cut(data, edges, edges[:-1], edges[1:]).hashes().view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(h)], pa.int32()), pa.StructArray.from_arrays([h, n, piece, own], names=["h", "n", "piece", "id"]))], names=["pieces"])


def encode_pieces(counts: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(h, n, ids array<int>) of distinct pieces (piece, n) of at most LONG bytes; a piece that is a token is its own id, all others are folded.

    The ranks come to the folds as a broadcast row: a literal of them would stand in each text that Spark's driver makes of the plan.
    """
    spark = counts.sparkSession
    whole = spark.createDataFrame(pa.table({"piece": pa.array(list(ranks), pa.binary()), "id": pa.array(list(ranks.values()), pa.int32())}))  # the vocabulary
    tables = spark.createDataFrame(pa.table({k: pa.array([v]) for k, v in rank_tables(ranks).items()}))
    rows = counts.filter(F.length("piece") <= LONG).repartition(shuffle_partitions(spark), "piece")  # few bytes, much work
    known = rows.select("piece", F.col("n").cast("long")).join(F.broadcast(whole), "piece", "left")
    lists = known.mapInArrow(_in_lists, "pieces array<struct<h:bigint,n:bigint,piece:binary,id:int>>").crossJoin(F.broadcast(tables))
    sql = f"transform(pieces, x -> named_struct('h', x.h, 'n', x.n, 'ids', if(x.id is null, {_fold('x.piece')}, array(x.id))))"
    for name in _TYPES:
        sql = _let(name, name, sql)
    return lists.select(F.inline(F.expr(sql)))


def _rest(cut: Cut, hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """The pieces that are not known (row < 0) and not long; each text's distinct hashes of them, in order, and where these begin; and which of them each piece wants."""
    miss = np.flatnonzero((rows < 0) & (cut.end - cut.start <= LONG))
    owner, wanted = cut.owner()[miss], hashes[miss]
    order = np.lexsort((wanted, owner))
    owner, wanted = owner[order], wanted[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (wanted[1:] != wanted[:-1])
    many = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1 - many[owner]
    return miss, wanted[new], many, which


@functools.lru_cache(maxsize=1)
def _long_ranks(path: str) -> dict[bytes, int]:
    return load_ranks(path)


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", most: int = HEAD) -> DataFrame:
    """(doc_id, ids array<int>) of every row: each match of the pattern encoded by itself, no special tokens.

    ``path``: a ``.tiktoken`` file of at most 65,536 ranks that hold every single byte, readable wherever tasks run.
    """
    spark = docs.sparkSession
    counts = stored(piece_counts(docs, cut_texts, text), "pieces")
    folded = stored(encode_pieces(counts, load_ranks(path)), "folded")
    dropped(counts)
    frequent = head(folded, most)
    top = frequent.select("h", "ids").toArrow()  # at most `most` rows
    index = HashIndex()
    index.add(top.column("h").to_numpy().view(np.uint64), np.arange(top.num_rows, dtype=np.int32))
    held = pc.list_flatten(top.column("ids").combine_chunks()).to_numpy().astype(np.uint16)
    size = pc.list_value_length(top.column("ids").combine_chunks()).to_numpy().astype(np.int32)
    sent = spark.sparkContext.broadcast((index, held, (np.cumsum(size) - size).astype(np.int32), size))
    del top

    def known(batches):
        index, held, start, size = sent.value
        for batch in by_bytes(batches, 2):
            cut = cut_texts(batch.column(2))
            hashes, length = cut.hashes(), cut.end - cut.start
            rows = index.find(hashes)
            hit, over = np.flatnonzero(rows >= 0), np.flatnonzero((rows < 0) & (length > LONG))
            n = np.ones(len(rows), np.int64)
            n[hit] = size[rows[hit]]
            long = [merge_long(cut.piece(k), _long_ranks(path)) for k in over.tolist()]
            n[over] = [len(x) for x in long]
            end = np.concatenate([[0], np.cumsum(n)])
            ids = np.zeros(int(end[-1]), np.uint16)
            ids[ragged(end[hit], n[hit])] = held[ragged(start[rows[hit]], n[hit])]
            ids[ragged(end[over], n[over])] = np.array([i for x in long for i in x], np.uint16)
            miss, _, many, which = _rest(cut, hashes, rows, batch.num_rows)
            edge = end[cut.first]
            place = end[miss] - edge[cut.owner()[miss]]
            times = np.concatenate([[0], np.cumsum(np.bincount(cut.owner()[miss], minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                batch.column(1),
                pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((2 * edge).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())]),
                pa.ListArray.from_arrays(pa.array(times.astype(np.int32)), pa.array((place << 24) | which)),
            ], names=["doc_id", "row", "ids", "places"])

    def asking(batches):
        index = sent.value[0]
        for batch in by_bytes(batches, 1):
            cut = cut_texts(batch.column(1))
            hashes = cut.hashes()
            _, wanted, many, _ = _rest(cut, hashes, index.find(hashes), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(many.astype(np.int32)), pa.array(wanted.view(np.int64)))], names=["row", "rare"])

    kind = docs.select(column(doc_id)).schema[0].dataType.simpleString()
    body = column(text).cast("string")
    rows = docs.select(column(doc_id).alias("doc_id"), F.xxhash64(column(doc_id), body).alias("row"), body.alias("text"))
    # Texts are looked up twice, as their ids, kept from the first time on, would take more disk than the texts.
    asked = rows.select("row", "text").mapInArrow(asking, "row long, rare array<bigint>").select("row", F.posexplode("rare").alias("k", "h"))
    asked = asked.join(folded.select("h", "ids"), "h")
    found = stored(asked.groupBy("row").agg(F.collect_set(F.concat(F.array("k"), "ids")).alias("found")), "rare")
    dropped(folded)
    part = rows.mapInArrow(known, f"doc_id {kind}, row long, ids binary, places array<bigint>")
    both = part.join(found, "row", "left")

    def filled(batches):
        for batch in by_bytes(batches, 1):
            data, edges = raw(batch.column(1))
            ids, edges = data.view("<u2"), edges // 2
            places, found = pc.list_flatten(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(3)
            at = edges[:-1][pc.list_parent_indices(batch.column(2)).to_numpy(zero_copy_only=False)] + (places >> 24)
            # A text's pieces: which of its rare ones, then its ids.
            owner, flat = pc.list_parent_indices(found).to_numpy(zero_copy_only=False), pc.list_flatten(found)
            length = pc.list_value_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
            value = pc.list_flatten(flat).to_numpy(zero_copy_only=False)
            begin = np.cumsum(length) - length
            order = np.lexsort((value[begin] if len(begin) else begin, owner))
            first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))])
            piece = order[first[pc.list_parent_indices(batch.column(2)).to_numpy(zero_copy_only=False)] + (places & 0xFFFFFF)]
            n = np.ones(len(ids), np.int64)
            n[at] = length[piece] - 1
            end = np.concatenate([[0], np.cumsum(n)])
            out = np.empty(int(end[-1]), np.int32)
            plain = np.ones(len(ids), bool)
            plain[at] = False
            out[end[:-1][plain]] = ids[plain]
            out[ragged(end[at], n[at])] = value[ragged(begin[piece] + 1, n[at])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(end[edges].astype(np.int32)), pa.array(out))], names=["doc_id", "ids"])

    return both.select("doc_id", "ids", "places", "found").mapInArrow(filled, f"doc_id {kind}, ids array<int>")


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The binary text of an id array: its binary pieces, one after the other (as characters of one byte each until the end)."""
    held = [""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        held[v] = k.decode("latin-1")
    literal = F.from_json(F.lit(json.dumps(held, separators=(",", ":"))), "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""), "ISO-8859-1")


def digests(ids: DataFrame, path: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of rows with ``ids``."""
    return ids.select(
        *[c for c in ids.columns if c != "ids"],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.replace(F.btrim(F.col("ids").cast("string"), F.lit("[]")), F.lit(", "), F.lit(",")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), load_ranks(path)), 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(encode(table(spark, sf_dir, "documents"), path), path)
