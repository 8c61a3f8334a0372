"""Shared pieces of the training-data operators: tables, spill folders, words."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow function handles at once; texts of one slice are the only ones held as Python objects.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that a Python worker gets at once, unless the session asks for less.
ARROW_BYTES = 8 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of ``ARROW_BYTES`` at most (or one row), so that long texts do not add up in a worker."""
    held = spark.conf.get(_ARROW, None)
    if held is None or int(held.rstrip("b")) > ARROW_BYTES:
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session of one machine (tests) gets a temporary one; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="verdantia-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_LEFT: dict[str, SparkSession] = {}  # folders written by stored() and not yet removed


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and rereads it, so that a lost executor costs no recomputation.

    Spark removes the shuffle files of the plan once it has run. ``dropped`` removes the folder; what still stands when the
    driver ends, as a result may read it until then, is removed at that point.
    """
    spark = bounded(df.sparkSession)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        # No mark of success is read here. (Spark's local file system forks the driver to set each such file's permissions.)
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if not _LEFT:
        atexit.register(_drop_left)
    _LEFT[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    give_back()  # the driver's own memory
    return out


def dropped(*frames: DataFrame) -> None:
    """Removes the folders of frames from ``stored`` that nothing reads any more."""
    for df in frames:
        _remove(df.stored_at)


def _remove(path: str) -> None:
    spark = _LEFT.pop(path, None)
    if spark is not None:  # Spark has no public call that deletes a folder
        jvm = spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def _drop_left() -> None:
    for path in list(_LEFT):
        with contextlib.suppress(Exception):  # the session may have ended
            _remove(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Hands freed memory back to the system: Python workers outlive their tasks and stand beside the next stage's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def sliced(batches: Iterable[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
    give_back()


def in_arrow(df: DataFrame, make: Callable[[], Callable], schema: str, *columns: str) -> DataFrame:
    """``mapInArrow`` of the named columns only; ``make`` gives the function of (an iterator of) slices."""
    return df.select(*columns).mapInArrow(lambda batches: make()(sliced(batches)), schema)


def ascii_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the ASCII white space (x20, x09-x0D), which is what bytes.split() splits at; null has none."""
    return [] if text is None else text.encode("utf-8", "replace").lower().split()


#: Lower case for A-Z; a blank for every other ASCII character that is no digit or lower-case letter.
_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of digits, lower-cased letters a-z and non-ASCII characters; null has none."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_ALNUM).split()


def column(name: str) -> F.Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class WordHashes(dict):
    """bytes -> 64-bit hash, kept for the words met most recently (at most ``most`` of them)."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of every run of ``width`` words, or of the whole sequence if it is shorter (and not empty)."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    width_here = min(width, n)
    out = np.zeros(n - width_here + 1, np.uint64)
    for k in range(width_here):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix64(word_hashes[k : n - width_here + 1 + k] + np.uint64(k + 1))
    return mix64(out + np.uint64(width_here))


def counted_words(docs: DataFrame, text: str, words: Callable[[str | None], list[bytes]], where: str | None = None) -> DataFrame:
    """(word binary, n long): counts over all rows, summed in each task before the shuffle. ``where``: a boolean column to keep by."""

    def make():
        from collections import Counter

        def run(slices):
            schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
            counts: Counter = Counter()

            def rows():
                got = list(counts.items())
                counts.clear()
                for at in range(0, len(got), 50_000):
                    part = got[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.binary()), pa.array([x[1] for x in part], pa.int64())], schema=schema)

            for batch in slices:
                counts.update(itertools.chain.from_iterable(map(words, batch.column(0).to_pylist())))
                if len(counts) > 400_000:
                    yield from rows()
            yield from rows()

        return run

    kept = docs if where is None else docs.filter(where)
    return in_arrow(kept.select(column(text).alias("text")), make, "word binary, n long", "text").groupBy("word").agg(F.sum("n").alias("n"))
