"""Document fingerprints by randomised edit embedding.

A shared random walk reads a text: at step t it stands on one character, and a random bit of (t, character) tells if it goes on to the
next. Two texts that walk alike stay aligned, and after an edit the walks soon meet again, so edit distance becomes Hamming distance
of the characters stood on. A fingerprint samples BITS steps of the walk and keeps one random bit of the character at each.
Step samples are consistent: each slot has one fixed falling chain of random steps and takes the first below the walk's length, so
texts of like length sample the same steps. Near copies are found by bands of sampled bits and verified on the whole fingerprints.

Defined cases: a null text is empty; an empty text has the fingerprint of zeros; equal texts have equal fingerprints; rows are ordered
by doc_id, ties by a hash of the text and the text, null ids last; repeated rows follow each other; one row follows itself; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, map_pandas, mix, write_shared
from .simhash import BkForest, components, merged

BITS = 256
#: Fingerprints whose bands are made at once.
ROWS = 4096
#: The random bits repeat after PERIOD steps, and characters share CLASSES rows of them; both only add chance agreement.
PERIOD, CLASSES = 1024, 251
CHAIN = 96
#: Bands that are searched before the others.
FIRST_BANDS = 3


@functools.lru_cache(1)
def _walk() -> tuple[list[list[int]], np.ndarray]:
    """rows[class][t mod PERIOD]: steps until the walk leaves a character of that class; chain[slot]: falling steps to sample."""
    rng = np.random.default_rng(20240601)
    bits = rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.int64)
    bits[:, -1] |= bits.sum(1) == 0
    rows = np.empty((CLASSES, PERIOD), np.int64)
    for c in range(CLASSES):
        ones = np.flatnonzero(np.tile(bits[c], 2))
        rows[c] = ones[np.searchsorted(ones, np.arange(PERIOD))] - np.arange(PERIOD) + 1
    chain = np.empty((BITS, CHAIN), np.int64)
    top = np.full(BITS, float(1 << 40))
    for k in range(CHAIN):
        top = np.floor(rng.random(BITS) * top)
        chain[:, k] = top
    return rows.tolist(), chain


def classes(text: str) -> tuple[np.ndarray, bytes]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, (codes % CLASSES).astype(np.uint8).tobytes()


def walk(read: bytes, t: int = 0) -> list[int]:
    """The step at which each character is left, begun at step t."""
    rows, _ = _walk()
    out = []
    add = out.append
    for c in read:
        t += rows[c][t & (PERIOD - 1)]
        add(t)
    return out


def sampled(codes: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The fingerprint's bits, from each character and the step at which it is left."""
    if not len(codes):
        return np.zeros(BITS, np.uint8)
    chain = _walk()[1]
    step = chain[np.arange(BITS), (chain < left[-1]).argmax(1)]
    stood = codes[np.searchsorted(left, step, side="right")].astype(np.uint64)
    with np.errstate(over="ignore"):
        return (mix(stood * np.uint64(BITS) + np.arange(BITS, dtype=np.uint64)) >> np.uint64(33)).astype(np.uint8) & 1


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Equal bits beyond the half that chance gives: 0 to 1."""
    return float(max(0.0, 2.0 * np.mean(a == b) - 1.0))


def to_hex(bits: np.ndarray) -> str:
    return np.packbits(bits).tobytes().hex()


class Text:
    """A text with its walk and fingerprint."""

    def __init__(self, text: str):
        self.text = text
        self.codes, self.read = classes(text)
        self.left = walk(self.read)
        self.bits = sampled(self.codes, np.array(self.left, np.int64))

    def edited(self, following: Text) -> tuple[str, np.ndarray]:
        """This text with its last third replaced by the beginning of the following one, and its fingerprint; the shared walk is kept."""
        n = len(self.codes)
        k = n // 3
        head = n - k
        new = following.text[:k]
        left = self.left[:head]
        left += walk(following.read[:k], left[-1] if left else 0)
        return self.text[:head] + new, sampled(np.concatenate((self.codes[:head], following.codes[:k])), np.array(left, np.int64))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column fingerprint (lowercase hex); no shuffle."""

    @F.pandas_udf("string")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series([to_hex(Text(t or "").bits) for t in column], dtype=object)

    return docs.withColumn("fingerprint", of(F.col(text)))


def with_following(docs: DataFrame, buckets: int) -> DataFrame:
    """Each row beside the next in descending order, after the last the first, as sorted runs: columns bucket, lent, doc_id, text.

    doc_ids are cut into ranges at quantiles; the first row of each range is lent to the range above as well, so a range is
    complete in itself. Whole texts are shuffled once, and nothing else is. To the driver come one id and hash a range.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted(set(base.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets)))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series([0 if pd.isna(x) else 1 + bisect.bisect_right(cuts, x) for x in ids], dtype="int32")

    base = base.select(bucket_of(F.col("doc_id")).alias("bucket"), "doc_id", F.xxhash64("text").alias("h"), "text")
    heads = base.groupBy("bucket").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "h")).alias("top")).orderBy("bucket").collect()
    if not heads:
        return base.select("bucket", F.lit(0).alias("lent"), "doc_id", "h", "text")
    lends = F.create_map(*[x for a, b in zip(heads, [*heads[1:], heads[0]], strict=True) for x in (F.lit(a["bucket"]), F.struct(F.lit(b["bucket"]).alias("to"), F.lit(a["top"]["doc_id"]).cast("bigint").alias("doc_id"), F.lit(a["top"]["h"]).cast("bigint").alias("h")))])
    top = F.element_at(lends, F.col("bucket"))
    is_top = (F.coalesce("doc_id", F.lit(0)) == top["doc_id"]) & (F.col("h") == top["h"])
    places = F.array_compact(F.array(F.struct("bucket", F.lit(0).alias("lent")), F.when(is_top, F.struct(top["to"].alias("bucket"), F.lit(1).alias("lent")))))
    return base.select(F.explode(places).alias("at"), "doc_id", "h", "text").select("at.bucket", "at.lent", "doc_id", "h", "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edited(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints each text and its edited text (see Text.edited, with the next document), with the likenesses to both."""
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        last = None  # the row before, which waits for its next

        for pdf in batches:
            out = []
            for bucket, lent, doc_id, text in zip(pdf["bucket"], pdf["lent"], pdf["doc_id"], pdf["text"], strict=True):
                if lent and (last is None or last[0] != bucket):
                    continue  # a further lent row
                now = Text(text)
                if last is not None and last[0] == bucket:
                    before = last[2]
                    edited, bits = before.edited(now)
                    out.append((last[1], len(before.codes), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(before.bits), to_hex(bits), likeness(before.bits, bits), likeness(before.bits, now.bits)))
                last = None if lent else (bucket, None if pd.isna(doc_id) else int(doc_id), now)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in EDITED.split(", ")]).astype({"doc_id": "Int64"})

    runs = with_following(docs, n).repartition(F.col("bucket")).sortWithinPartitions("bucket", "lent", F.col("doc_id").desc_nulls_last(), F.desc("h"), F.desc("text"))
    return map_pandas(runs.select("bucket", "lent", "doc_id", "text"), run, EDITED)


def band_keys(fingerprint_bits: np.ndarray, bands: int, width: int, first: int = 0) -> np.ndarray:
    """bands hashes of width sampled bits each, from the first one on, for each fingerprint (the last axis)."""
    rng = np.random.default_rng(7)
    weights = np.uint64(257) ** np.arange((width + 7) // 8, dtype=np.uint64)
    with np.errstate(over="ignore"):
        samples = [rng.permutation(BITS)[:width] for _ in range(bands)][first:]
        keys = [np.packbits(fingerprint_bits[..., sample], axis=-1).astype(np.uint64) @ weights for sample in samples]
        return mix(np.stack(keys, -1) * np.uint64(64) + np.arange(first, bands, dtype=np.uint64))


def bands_for(radius: int, width: int, recall: float) -> int:
    """Bands of width bits, so that two fingerprints at the radius share one with probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - radius / BITS) ** width))


def near_pairs(docs: DataFrame, radius: int = 40, bands: int | None = None, width: int = 16, recall: float = 0.95) -> DataFrame:
    """near_fingerprints of the texts of docs; bands follow from the recall at the radius if they are not given."""
    return near_fingerprints(fingerprint(docs).select("fingerprint").distinct(), radius, bands or bands_for(radius, width, recall), width)


def near_fingerprints(distinct: DataFrame, radius: int, bands: int, width: int) -> DataFrame:
    """a, b: pairs of different fingerprints that link near copies, a spanning forest in each band's bucket; a has the smaller text.

    Copies are one fingerprint. Buckets meet by band, links are verified on whole fingerprints, and no bucket gives out all pairs.
    """
    return part_links(distinct.withColumn("part", F.col("fingerprint")), radius, bands, width)


def part_links(distinct: DataFrame, radius: int, bands: int, width: int, first: int = 0) -> DataFrame:
    """a < b: links between parts of fingerprint and part, a spanning forest in each bucket of the bands from the first one on. Every link within the radius counts."""
    of = distinct.schema["part"].dataType.simpleString()

    def band(batches):
        for pdf in batches:
            for a in range(0, len(pdf), ROWS):
                some = pdf.iloc[a : a + ROWS]
                names = some["fingerprint"].to_numpy()
                bits = np.unpackbits(np.frombuffer(bytes.fromhex("".join(names)), np.uint8).reshape(len(names), BITS // 8), axis=1)
                keys = band_keys(bits, bands, width, first)
                yield pd.DataFrame({"key": keys.ravel().view(np.int64), "fingerprint": np.repeat(names, bands - first), "part": np.repeat(some["part"].to_numpy(), bands - first)})

    def link(batches):
        held = pd.DataFrame({"key": [], "fingerprint": [], "part": []})
        for pdf in [*batches, None]:
            whole = held if pdf is None else pd.concat((held, pdf), ignore_index=True) if len(held) else pdf
            cut = len(whole) if pdf is None or not len(whole) else int(np.searchsorted(whole["key"].to_numpy(), whole["key"].iat[-1]))
            done, held = whole[:cut], whole[cut:]
            if not len(done):
                continue
            key = done["key"].to_numpy().astype(np.int64)
            part, each = pd.factorize(done["part"], sort=True)
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            several = np.repeat(np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts), np.diff([*starts, len(key)]))
            if several.any():
                key, part, names = key[several], part[several], done["fingerprint"].to_numpy()[several]
                lanes = np.frombuffer(bytes.fromhex("".join(names)), np.uint64).reshape(len(names), BITS // 64)
                label, least = BkForest(lanes, key).components(radius), part.copy()
                np.minimum.at(least, label, part)
                a, b = least[label], part
                each = np.asarray(each)
                yield pd.DataFrame({"a": each[a[a != b]], "b": each[b[a != b]]}).drop_duplicates()

    rows = map_pandas(distinct.select("fingerprint", "part"), band, f"key long, fingerprint string, part {of}").repartition(F.col("key")).sortWithinPartitions("key", "fingerprint")
    return map_pandas(rows, link, f"a {of}, b {of}").distinct()


def near_groups(rows: DataFrame, radius: int = 40, width: int = 16, recall: float = 0.95) -> DataFrame:
    """rows (with fingerprint) and near_group: the least fingerprint that verified links lead to, the row's own if it has none.

    Links are of fingerprints within the radius that share a band; two at the radius share one with probability recall, nearer ones more
    surely, and a fingerprint that misses one link of its group is in it by any other. A few bands are searched first, the others for links
    between the groups that these give: a large group is gone through once, not once a band. Copies are one fingerprint. rows is read
    several times, so it should be written; it is not shuffled for common fingerprints.
    """
    counts = write_shared(rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("rows")), "fingerprints")
    node = F.xxhash64("fingerprint")
    bands = bands_for(radius, width, recall)
    begun = min(FIRST_BANDS, bands)
    label = components(write_shared(part_links(counts.select("fingerprint", node.alias("part")), radius, begun, width), "near-pairs"))
    if begun < bands:
        parts = counts.select("fingerprint", node.alias("node")).join(label, "node", "left").select("fingerprint", F.coalesce("label", "node").alias("part"))
        found = write_shared(part_links(parts, radius, bands, width, begun), "near-pairs")
        label = label if found.isEmpty() else merged(label, found)
    linked = counts.select("fingerprint", node.alias("node")).join(label, "node")
    least = linked.groupBy("label").agg(F.min("fingerprint").alias("near_group"))
    told = counts.join(linked.join(least, "label").select("fingerprint", "near_group"), "fingerprint", "left")
    told = write_shared(told.select("fingerprint", "rows", F.coalesce("near_group", "fingerprint").alias("near_group")), "near-groups")
    return join_hot(rows, told, "fingerprint", "rows", rows.count()).drop("rows")
