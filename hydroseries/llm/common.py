"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but blanks; the six ASCII blanks are the only separators.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of one Arrow batch, about.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Keys that join_hot may broadcast.
HOT = 1000
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, else the one that the context has, else, in local mode only, a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="hydroseries-"))
    return path


#: Temporary folders of local sessions without spark.checkpoint.dir.
_local: dict[str, str] = {}
#: The tables of each open scope, the innermost last.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def intermediates(spark: SparkSession):
    """Tables written inside are deleted at the end. Results that are read from them must be written or consumed before.

    Outside of any scope they stay until the shared folder is cleared, for a lazy result can be read at any time.
    """
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        for path in mine:
            delete(spark, path)


@contextlib.contextmanager
def remembered():
    """Gives the list of the tables written inside; they stay."""
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield mine
    finally:
        _scopes.remove(mine)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def new_table(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which the open scope deletes at its end."""
    path = f"{shared_dir(spark)}/hydroseries/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def write_shared(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As write_shared, but in buckets of the column key: later joins on it shuffle the other side only."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Buckets are written by the partitions that hash to them, one file each. Only a catalog knows of buckets, so the files have a name there for a moment.
    known = f"hydroseries_{name}_{uuid.uuid4().hex}"
    try:
        df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", new_table(spark, name)).saveAsTable(known)
        table = spark.table(known)
        table.schema  # resolved now
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {known}")  # the files stay
    return table


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, count: str, n: int) -> DataFrame:
    """The inner join of rows with keyed (one row a key; count: how many of the n rows have it) on a key that may be very hot.

    Keys with more than 1 / HOT of all rows are HOT at most, so they are broadcast, and their rows stay where they are; only the
    others' rows are shuffled.
    """
    hot = keyed.where(F.col(count) > n / HOT)
    cold = keyed.where(F.col(count) <= n / HOT)
    apart = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(apart)


def release_memory() -> None:
    """Gives freed memory back to the system: a Python worker outlives its task, and what it holds adds to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _tidied(run):
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def bound_batches(spark: SparkSession) -> None:
    """Where the session has Spark's own limit to the bytes of an Arrow batch, it gets a lower one; whatever else was set stays."""
    if spark.conf.get(BATCH_LIMIT) == "67108864b":
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def map_pandas(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInPandas over batches bounded in bytes, and the worker's memory is released after each task."""
    bound_batches(df.sparkSession)
    return df.mapInPandas(_tidied(run), schema)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """As map_pandas, by mapInArrow."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(_tidied(run), schema)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def ascii_lower(col):
    """Lower-cases A-Z only, whatever the locale or script."""
    return F.translate(col, _UPPER, _LOWER)


def held_out(doc_id, folds: int, fold: int):
    """True where crc32(doc_id as text) mod folds is fold; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def hash_sample(df: DataFrame, most: int, n: int, *columns: str) -> DataFrame:
    """About 0.9 * most of the n rows of df, all if there are no more than that: those whose hash of columns is low. No shuffle."""
    if n <= 0.9 * most:
        return df
    return df.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) < F.lit(int(0.9 * most / n * (1 << 40))))


def parts(data: bytes, size: int):
    """data in parts of about size bytes, each cut before a space, so that no word is split."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


class FlatWords:
    """Words of many texts in one byte buffer, each with a 64-bit hash.

    text k holds the words first[k]:first[k + 1]; word i is the bytes start[i]:end[i]. Each text is its words joined by single spaces.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)
    #: Bytes that are hashed at once.
    CHUNK = 1 << 19

    def __init__(self, joined: list[bytes], chunk: int = CHUNK):
        self.buffer = b"\n".join(joined) + b"\n"
        raw = np.frombuffer(self.buffer, np.uint8)
        space = np.flatnonzero((raw == 32) | (raw == 10))
        begin = np.concatenate(([0], space[:-1] + 1))
        real = space > begin  # an empty text has no word
        self.start, self.end = begin[real], space[real]
        lengths = np.fromiter((len(x) for x in joined), np.int64, len(joined))
        self.first = np.searchsorted(self.start, np.concatenate(([0], np.cumsum(lengths + 1))))
        self.hash = np.empty(len(self.start), np.uint64)
        cut = [0, *(np.flatnonzero(np.diff(self.end // chunk)) + 1).tolist(), len(self.start)]
        for a, b in zip(cut, cut[1:], strict=False):
            if a < b:
                self.hash[a:b] = self._hashed(raw[self.start[a] : self.end[b - 1]], self.start[a:b] - self.start[a], self.end[a:b] - self.start[a:b])

    def _hashed(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of each word, the sum of its bytes (plus one) times powers of BASE by their place in it: a difference of sums over all of raw, moved back to the word's beginning."""
        power, inverse = _powers(len(raw).bit_length()) if len(raw) <= 2 * self.CHUNK else _powers.__wrapped__(len(raw).bit_length())
        with np.errstate(over="ignore"):
            # What follows a word, a space or the end of its text, counts as zero, so that a word's hash is that of its bytes alone.
            total = np.cumsum(_VALUE[raw] * power[: len(raw)])
            return mix((total[start + length - 1] - np.where(start > 0, total[start - 1], 0)) * inverse[start])

    def grams(self, n: int) -> np.ndarray:
        """A mixed 64-bit hash of each n consecutive words; equal words have equal hashes."""
        count = max(len(self.hash) - n + 1, 0)
        out = np.zeros(count, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = out * self.BASE + self.hash[k : k + count]
        return mix(out)


#: What a byte adds to its word's hash; blanks nothing.
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[[10, 32]] = 0


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2 ** bits powers of FlatWords.BASE and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (int(FlatWords.BASE), pow(int(FlatWords.BASE), -1, 1 << 64)):
        powers = np.full(1 << bits, np.uint64(base))
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))
