"""Importance resampling: documents are drawn so that their word runs are spread as a target's are.

1. One scan of each text keeps a ring of running zlib states, one for each of the last `order` starts. A new word, with the space before
   it, extends each state, and starts one of its own; each state is then the CRC of one run of words, and its bucket is emitted. No run
   is ever put together as text. The buckets of each document go once into a table in the shared folder.
2. Buckets are counted over all documents and over all targets: each task sums its own, then one number a bucket and task is shuffled.
   The gain of a bucket is the logarithm of its smoothed share in the targets over that in the documents. Gains are one number a
   bucket (BUCKETS, a parameter), whatever the input, so they travel with the tasks.
3. A document's weight is the mean gain of its runs. With a Gumbel number from a hash of its id added, the highest scores are a draw
   without replacement in proportion to the weights.
4. Ranks are global: scores are dealt by range and sorted in their partitions, and a partition's ranks start after the rows of those
   before it. Equal scores and ids are told apart by a row number, so no score or id makes a partition large.

Defined cases: a null or empty text, or one without words, has no runs and the weight 0; a null doc_id is hashed as empty text and comes
after all others at equal scores; repeated rows are documents of their own, with equal scores and ranks in a row; an empty table of targets
leaves the weights to the documents' shares alone; an empty table of documents gives no rows; further columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, parts, write_shared

BUCKETS = 10_000
ORDER = 2
#: A-Z become a-z; letters, digits and all bytes of other code points stay; the rest separates words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of text whose words are held at once.
PART = 1 << 16
_SCALE = 1000


def ring_buckets(text: bytes, order: int, buckets: int, part: int = PART) -> tuple[int, np.ndarray]:
    """The number of words of a text (UTF-8), and the bucket of each run of 1 to order consecutive words."""
    n_words, ring, out = 0, [], []
    for piece in parts(text.translate(_BYTES), part):
        words, emitted = piece.split(), []
        for word in words:
            if len(ring) == order:
                del ring[0]
            spaced = b" " + word
            ring = [crc32(spaced, state) for state in ring]
            ring.append(crc32(word))
            emitted += ring
        n_words += len(words)
        out.append((np.array(emitted, np.int64) % buckets).astype(np.int32))
    return n_words, np.concatenate(out) if out else np.zeros(0, np.int32)


def bucket_table(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """n_words and buckets (of all runs, in order of their ends) of each row of texts, and its columns but text."""
    keep = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, sizes = [], [], [0]
            for text in batch.column("text").cast(pa.binary()):
                n, b = ring_buckets(text.as_py() or b"", order, buckets)
                counts.append(n)
                found.append(b)
                sizes.append(len(b))
            lists = pa.ListArray.from_arrays(np.cumsum(sizes).astype(np.int32), np.concatenate([*found, np.zeros(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(counts, pa.int64()), lists], [*keep, "n_words", "buckets"])

    return map_arrow(texts.select(*keep, "text"), run, _schema(texts, keep).add("n_words", "long").add("buckets", T.ArrayType(T.IntegerType())))


def _schema(df: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([df.schema[c] for c in names])


def bucket_counts(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all rows are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("buckets").flatten().to_numpy(), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "seen"])

    summed = map_arrow(table.select("buckets"), run, "bucket int, seen long").groupBy("bucket").agg(F.sum("seen").alias("seen"))
    counts = np.zeros(buckets, np.int64)
    for row in summed.collect():  # at most one row a bucket
        counts[row.bucket] = row.seen
    return counts


def gains(documents: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """For each bucket, 1000 times the logarithm of its share in the targets over its share in the documents, one run added to each, rounded down."""
    size = len(documents)
    above, below = float(documents.sum() + size), float(targets.sum() + size)
    return np.array([math.floor(_SCALE * math.log(float(t + 1) * above / (float(s + 1) * below))) for s, t in zip(documents.tolist(), targets.tolist(), strict=True)], np.int64)


def weights(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """n_features and weight (mean gain, rounded down) of each row of a bucket_table, and its columns but buckets."""
    keep = [c for c in table.columns if c != "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            ends = lists.offsets.to_numpy()
            sums = np.concatenate(([0], np.cumsum(gain[lists.values.to_numpy()[ends[0] : ends[-1]]])))
            n = np.diff(ends).astype(np.int64)
            mean = np.where(n > 0, np.diff(sums[ends - ends[0]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(n), pa.array(mean)], [*keep, "n_features", "weight"])

    return map_arrow(table, run, _schema(table, keep).add("n_features", "long").add("weight", "long"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel number from a hash of seed and doc_id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))
    return F.floor(-_SCALE * F.log(-F.log(u)))


def ranked(rows: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """rows with a column rank, from 1 in the given order, and how many they are. Ties go by a row number; rows has no column _tie or _at."""
    spark = rows.sparkSession
    order = (*order, F.col("_tie"))
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    table = write_shared(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")  # a partition's number, then 33 bits of the row's place in it
    part = F.shiftright("_at", 33)
    before, starts = 0, []
    for row in table.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a partition
        starts.append((row.part, before))
        before += row["count"]
    if not starts:
        return table.withColumn("rank", F.col("_at")).drop("_at"), 0
    offsets = spark.createDataFrame(starts, "_part long, _before long")
    placed = table.join(F.broadcast(offsets), part == F.col("_part"))
    return placed.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before"), before


def draw(docs: DataFrame, targets: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """n_words, n_features, weight, score and rank of each row of docs (doc_id, text), and its columns but text.

    Of the documents of at least least_words words, share per cent, rounded down, are drawn, and have a rank; for all others it is null.
    targets has a column text.
    """
    table = write_shared(bucket_table(docs, order, buckets), "buckets")
    gain = gains(bucket_counts(table, buckets), bucket_counts(bucket_table(targets.select("text"), order, buckets), buckets))
    scored = write_shared(weights(table, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")
    inside = F.col("n_words") >= least_words
    placed, n = ranked(scored.where(inside), F.desc("score"), F.asc_nulls_last("doc_id"))
    outside = scored.where(~inside).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", F.when(F.col("rank") <= share * n // 100, F.col("rank"))).unionByName(outside)


def resample(docs: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """The rows of docs that draw(docs, targets, **how) draws, with all their columns. Rows alike in doc_id and text go together: one drawn brings the others."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    drawn = draw(docs.select("doc_id", "text", digest.alias("_digest")), targets, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("_id"), "_digest").distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["_id"]) & (digest == drawn["_digest"]), "left_semi")
