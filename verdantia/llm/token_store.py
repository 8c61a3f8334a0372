"""Token ids on disk: canonical length-limited Huffman codes in independent blocks with bit-offset checkpoints.

File format: a Spark table (Parquet) of blocks, so that any store Spark writes to will do. A row is
``(bucket int, block int, rel_start long, blob binary)``; blocks ascend with (bucket, block), and so do the documents.
A blob holds, little endian: magic ``HTB1``, documents n, checkpoint step k; n document ids (int64, with a null flag byte
each), n id counts (uint32), n payload bytes (uint32), all checkpoints (uint32, bits from the payload's start, one per k
ids of a document, in document order), then the payload: each document's codes from a byte boundary, most significant
bit first. The code lengths of all ids (one byte each) are the table's only shared state: canonical codes follow.

Defined cases: null and empty texts hold the end id alone; rows with equal doc_id all stay, in the order of their
codes (rows with equal codes are equal); null doc_ids come first; doc_ids must be whole numbers; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, ragged, shared_dir, shuffle_partitions, sliced, stored, table
from .scan import PieceIds, by_bytes, raw, word_bpe_pieces

LIMIT = 20  # bits of the longest code: decoding tables have 2 ** LIMIT entries
STEP = 128  # ids between checkpoints
BLOCK = 1 << 20  # payload bytes after which a block ends
END_ID = 1


# ---------------------------------------------------------------- codes
def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for symbols that never occur."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(symbols) <= 1:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << limit:
        raise ValueError("more symbols than codes")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[order].astype(np.float64)
    m, levels, merged = len(order), [], leaves
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        levels.append(at < m)
        merged = both[at]
    depth, take = np.zeros(m, np.int64), 2 * m - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        depth[:chosen] += 1
        take = 2 * (take - chosen)
    depth[:take] += 1
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol), each the successor of the one before."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[lengths[order] > 0]:
        n = int(lengths[s])
        code <<= n - last
        codes[s], last = code, n
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For every ``limit`` next bits: symbol * 32 + length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    out = np.repeat(order.astype(np.int64) * 32 + lengths[order], 1 << (limit - lengths[order].astype(np.int64)))
    return np.concatenate([out, np.full((1 << limit) - len(out), 1, np.int64)]).astype(np.int32)


def pack(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The codes of documents' ids, each document from a byte boundary: payload, bytes of each, checkpoints (bits from its document's start), their number for each."""
    n = len(counts)
    size = lengths[ids].astype(np.int64)
    edge = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(size)])
    bits = before[edge[1:]] - before[edge[:-1]]
    held = (bits + 7) // 8
    first = np.concatenate([[0], np.cumsum(held)[:-1]]) * 8 if n else np.empty(0, np.int64)
    start = before[:-1] + np.repeat(first - before[edge[:-1]], counts)
    out = np.zeros(int(held.sum()) // 8 + 2, np.uint64)
    if len(ids):
        code, word = codes[ids], start >> 6
        shift = 64 - (start & 63) - size
        fits = shift >= 0
        here = np.where(fits, code << np.where(fits, shift, 0).astype(np.uint64), code >> np.where(fits, 0, -shift).astype(np.uint64))
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[heads]] = np.add.reduceat(here, heads)
        over = np.flatnonzero(~fits)
        out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    marks = (counts + step - 1) // step
    at = ragged(np.zeros(n, np.int64), marks) * step + np.repeat(edge[:-1], marks)
    return out.astype(">u8").tobytes()[: int(held.sum())], held, (start[at] - np.repeat(first, marks)).astype(np.uint32), marks


def unpack(payload: bytes, marks: np.ndarray, left: np.ndarray, lookup: np.ndarray, step: int = STEP, limit: int = LIMIT) -> np.ndarray:
    """Decodes every checkpoint's run (``left`` ids, at most ``step``) side by side; ids in order."""
    lanes = len(marks)
    if not lanes:
        return np.empty(0, np.int32)
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8)
    peek = (raw[:-3].astype(np.uint32) << 24) | (raw[1:-2].astype(np.uint32) << 16) | (raw[2:-1].astype(np.uint32) << 8) | raw[3:]
    got = np.zeros((step, lanes), np.int32)
    bit, last = marks.astype(np.int64), len(peek) - 1
    for k in range(int(left.max())):
        x = lookup[(peek[np.minimum(bit >> 3, last)] << (bit & 7).astype(np.uint32)) >> np.uint32(32 - limit)]
        got[k] = x >> 5
        bit += x & 31
    whole = got.T
    return whole.ravel() if (left == step).all() else whole[np.arange(step)[None, :] < left[:, None]]


# ---------------------------------------------------------------- blobs
def _blob(docs: list[int | None], counts: list[int], held: list[int], marks: list[np.ndarray], payload: list[bytes], step: int) -> bytes:
    base = np.concatenate([[0], np.cumsum(held)[:-1]]).astype(np.int64) * 8
    points = np.concatenate([m.astype(np.int64) + b for m, b in zip(marks, base, strict=True)]) if marks else np.empty(0)
    return b"".join([
        struct.pack("<4sII", b"HTB1", len(docs), step),
        bytes(d is None for d in docs),
        np.array([d or 0 for d in docs], "<i8").tobytes(),
        np.array(counts, "<u4").tobytes(),
        np.array(held, "<u4").tobytes(),
        points.astype("<u4").tobytes(),
        *payload,
    ])


def read_blob(blob: bytes, lookup: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their id counts, and all ids one after the other."""
    magic, n, step = struct.unpack_from("<4sII", blob)
    if magic != b"HTB1":
        raise ValueError("not a token block")
    at = 12
    null = np.frombuffer(blob, np.uint8, n, at)
    docs = np.frombuffer(blob, "<i8", n, at + n)
    counts = np.frombuffer(blob, "<u4", n, at + 9 * n).astype(np.int64)
    at += 17 * n
    lanes = (counts + step - 1) // step
    total = int(lanes.sum())
    marks = np.frombuffer(blob, "<u4", total, at)
    left = np.minimum(step, np.repeat(counts, lanes) - ragged(np.zeros(n, np.int64), lanes) * step)
    return [None if z else int(d) for d, z in zip(docs, null, strict=True)], counts, unpack(blob[at + 4 * total :], marks, left, lookup, step)


# ---------------------------------------------------------------- encoding by a public vocabulary
class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece of them encoded once.

    Texts within Latin-1 and Latin Extended-A are cut in numpy by the tokenizer's own pattern (there NFC changes nothing
    and lower-casing maps one character to one), and their distinct pieces go through the library's model; any other
    text goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = Tokenizer(self.whole.model)
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in printed)}
        self.pieces = PieceIds(self._learn)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        shown = [x.decode("latin-1").translate(self.letters) for x in pieces]  # the byte-level alphabet
        got = self.model.encode(shown, is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, np.uint16), np.bincount(np.array(got.word_ids, np.int64), minlength=len(pieces))

    def encode(self, texts: pa.Array, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids with an end id after each text, and their number for each."""
        cut, odd = word_bpe_pieces(texts)
        if odd.any():
            cut, _ = word_bpe_pieces(pc.if_else(pa.array(odd), pa.scalar(""), texts.cast(pa.string())))
        ids, counts = self.pieces.ids(cut)
        ids, counts = np.insert(ids, np.cumsum(counts), end), counts + 1
        if odd.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(odd):
                parts[k] = np.array([*self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids, end], np.uint16)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, counts.astype(np.int64)


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(maxsize=1)
def _lookup(lengths: bytes) -> np.ndarray:
    return decoding_table(np.frombuffer(lengths, np.uint8))


def write_tokens(docs: DataFrame, path: str, out: str, *, doc_id: str = "doc_id", text: str = "text", vocab: int = 49_408, docs_a_bucket: int = 8192, most_buckets: int = 100_000) -> np.ndarray:
    """Encodes every whole text and writes the blocks to ``out`` in ascending order of the document ids; returns the code lengths.

    Texts are tokenised once: the ids go to the shared folder as 16-bit numbers, their counts give the codes, and what
    is shuffled into order are the documents' coded bits.
    """
    spark = docs.sparkSession
    key = column(doc_id).cast("long")
    total = docs.count()
    buckets = max(1, min(most_buckets, total // docs_a_bucket))
    cuts = docs.agg(F.percentile_approx(key, [k / buckets for k in range(1, buckets)] or [0.5], 10_000).alias("c")).head().c or []
    cuts = np.array(sorted(set(cuts)) if buckets > 1 else [], np.int64)

    def tokenise(batches):
        for batch in by_bytes(batches, 1):
            ids, counts = _encoder(path).encode(batch.column(1))
            held = ids.astype("<u2").tobytes()
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts) * 2]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets.buffers()[1], pa.py_buffer(held)])], names=["doc_id", "ids"])

    def count(batches):
        counts = np.zeros(vocab, np.int64)
        for batch in batches:
            counts += np.bincount(raw(batch.column(0))[0].view("<u2"), minlength=vocab)
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(counts[ids])], names=["id", "n"])

    ids = stored(docs.select(key.alias("doc_id"), column(text).alias("text")).mapInArrow(tokenise, "doc_id long, ids binary"), "ids")
    counts = np.zeros(vocab, np.int64)
    for r in ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most vocab rows
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    sent = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def encode(batches):
        lengths, codes = sent.value
        for batch in by_bytes(batches, 1):
            data, edges = raw(batch.column(1))
            counts = np.diff(edges) // 2
            payload, held, marks, lanes = pack(data.view("<u2"), counts, codes, lengths)
            end, mark = np.concatenate([[0], np.cumsum(held)]), np.concatenate([[0], np.cumsum(lanes)]) * 4
            points, keys = marks.astype("<u4").tobytes(), batch.column(0).to_pylist()
            where = [0 if k is None else int(np.searchsorted(cuts, k, "left")) for k in keys]
            yield pa.RecordBatch.from_arrays([
                pa.array(where, pa.int32()),
                pa.array(keys, pa.int64()),
                pa.array(counts),
                pa.array([points[mark[k] : mark[k + 1]] for k in range(len(keys))], pa.binary()),
                pa.array([payload[end[k] : end[k + 1]] for k in range(len(keys))], pa.binary()),
            ], names=["bucket", "doc_id", "n", "marks", "payload"])

    def assemble(batches):
        held: list = []
        at, block, start, size = None, 0, 0, 0

        def flush():
            nonlocal held, size, block, start
            blob = _blob([r[0] for r in held], [r[1] for r in held], [len(r[3]) for r in held], [np.frombuffer(r[2], "<u4") for r in held], [r[3] for r in held], STEP)
            out = pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([block], pa.int32()), pa.array([start]), pa.array([blob], pa.binary()), pa.array([sum(r[1] for r in held)])], names=["bucket", "block", "rel_start", "blob", "n_ids"])
            start += sum(r[1] for r in held)
            held, size, block = [], 0, block + 1
            return out

        for batch in sliced(batches, 1024):
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (bucket != at or size >= BLOCK):
                    yield flush()
                if bucket != at:
                    at, block, start = bucket, 0, 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush()

    rows = ids.mapInArrow(encode, "bucket int, doc_id long, n long, marks binary, payload binary")
    n = max(1, min(buckets, shuffle_partitions(spark)))
    placed = rows.repartition(n, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "n", F.xxhash64("payload"), "payload")
    placed.mapInArrow(assemble, "bucket int, block int, rel_start long, blob binary, n_ids long").write.option("compression", "uncompressed").parquet(out)
    return lengths


def read_tokens(spark: SparkSession, out: str, lengths: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone (and the code lengths)."""
    blocks = spark.read.parquet(out)
    totals = sorted((r.bucket, r.n) for r in blocks.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect())  # at most most_buckets rows
    base, at = {}, 0
    for bucket, n in totals:
        base[bucket] = at
        at += n
    sent = spark.sparkContext.broadcast((lengths.tobytes(), base))

    def decode(batches):
        raw, base = sent.value
        for batch in sliced(batches, 1):
            docs, counts, ids = read_blob(batch.column("blob")[0].as_py(), _lookup(raw))
            start = base[batch.column("bucket")[0].as_py()] + batch.column("rel_start")[0].as_py() + np.cumsum(counts) - counts
            edge, data = np.concatenate([[0], np.cumsum(counts)]) * 4, memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[edge[k] : edge[k + 1]]) for k in range(len(docs))]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("bucket", "rel_start", "blob").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    lengths = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    return read_tokens(spark, out, lengths)
