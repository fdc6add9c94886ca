"""Substring deduplication: words covered by a passage that also starts in an earlier document are removed.

1. Whole texts go once by a row number into a bucketed table; later joins with it shuffle only the other side. Exact copies of an
   earlier text are found by a digest of their words and need no further search.
2. A prefilter tells which stretches can repeat at all: each window of `window` words has a minimiser, the least hash of the GRAM-word
   grams in it, and equal windows have equal minimisers. Only stretches whose minimiser occurs in two documents go on, most of a corpus
   does not. A stretch has STRETCH windows at most; longer ones are cut, with the words of a window less one in common.
3. Stretches meet by minimiser in shards. Those of a shard's distinct stretches that hold a window whose hash occurs twice there form a
   compressed FM-index (no other can repeat a window of one), and each is streamed through it from right to left: backward search over the
   wavelet matrix gives its matching statistics against the documents earlier than its own earliest one, and the intervals that reach
   the window's length are reported. A later document with the same stretch repeats all of it. Minimisers that are very frequent are cut into single windows, dealt by the window itself, so no shard grows with one passage.

Shards hold about SHARD_WORDS words whatever the input. Nothing but counts comes to the driver.

Defined cases: a null or blank text has no words; a text shorter than a window keeps all; a null doc_id comes after all others,
and null ids are not before each other; repeated rows have equal doc_ids, so none is before the other; an empty table gives no rows;
remove_repeats keeps all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FlatWords, bound_batches, join_hot, map_pandas, release_memory, write_bucketed, write_shared
from .fm_index import FmIndex

GRAM = 4
SHARD_WORDS = 250_000
#: A minimiser in more stretches than this is dealt window by window.
FREQUENT = 5_000
#: Windows of one stretch.
STRETCH = 64
#: Characters of text that are worked on at once.
BLOCK = 1 << 19
LAST = (1 << 63) - 1


def _words_table(docs: DataFrame, keep: list[str]) -> DataFrame:
    """uid, ord, text, digest (of its words) and the columns keep, bucketed by uid in the shared folder."""
    body = F.trim(F.regexp_replace("text", r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "))  # single spaces are right as they are
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    return write_bucketed(rows.withColumn("digest", F.md5(body)), "uid", "words")


#: The six ASCII blanks become spaces.
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)


def _joined(text: str) -> bytes:
    """Its words, with single spaces. Bytes are split at the six ASCII blanks only."""
    data = text.encode().translate(_SPACES)
    single = b"  " not in data and data[:1] != b" " and data[-1:] != b" "
    return data if single else b" ".join(data.split())


class _Windows:
    """The minimiser runs of some texts: stretches of consecutive windows of one text that share a minimiser, of longest windows at most."""

    def __init__(self, texts: list[str], window: int, longest: int):
        self.words = w = FlatWords([_joined(t) for t in texts])
        n = np.diff(w.first)
        grams = len(w.start) - GRAM + 1
        self.run_text = self.run_start = self.run_length = self.run_hash = np.zeros(0, np.int64)
        if grams < window - GRAM + 1 or not (n >= window).any():
            return
        least = w.grams(GRAM).view(np.int64)
        reach = 1
        span = window - GRAM + 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
        # A run ends where the minimiser changes, at the end of a text, and at its last windows, which would reach into the next text.
        new = np.concatenate(([True], least[1:] != least[:-1]))
        edges = np.concatenate((w.first, np.maximum(w.first[1:] - window + 1, w.first[:-1])))
        new[edges[edges < len(new)]] = True
        first = np.flatnonzero(new)
        length = np.diff(np.concatenate((first, [len(new)])))
        text = np.searchsorted(w.first, first, side="right") - 1
        inside = first + window <= w.first[text + 1]
        first, length, text = first[inside], length[inside], text[inside]
        pieces = -(-length // longest)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.run_text, self.run_start = np.repeat(text, pieces), np.repeat(first, pieces) + nth * longest
        self.run_hash = least[self.run_start]
        self.run_length = np.minimum(np.repeat(length, pieces) - nth * longest, longest)

    def stretches(self, i: np.ndarray, j: np.ndarray) -> list[str]:
        """Words i to j of all texts, both included."""
        return [self.words.buffer[a:b].decode() for a, b in zip(self.words.start[i].tolist(), self.words.end[j].tolist(), strict=True)]


def _blocks(pdf: pd.DataFrame, block: int):
    """Parts of a batch with about block characters."""
    size = pdf["text"].str.len().cumsum().to_numpy()
    cut = np.flatnonzero(np.diff(size // block)) + 1
    for a, b in zip([0, *cut], [*cut, len(pdf)], strict=True):
        if b > a:
            yield pdf.iloc[a:b]


def _minimisers(table: DataFrame, window: int) -> DataFrame:
    """h, uid, ord: the distinct minimisers of each text."""
    block, longest = BLOCK, STRETCH

    def run(batches):
        for batch in batches:
            for pdf in _blocks(batch, block):
                w = _Windows(pdf["text"].tolist(), window, longest)
                order = np.lexsort((w.run_hash, w.run_text))
                text, h = w.run_text[order], w.run_hash[order]
                new = np.concatenate(([True], (np.diff(text) != 0) | (np.diff(h) != 0))) if len(h) else np.zeros(0, bool)
                yield pd.DataFrame({"h": h[new], "uid": pdf["uid"].to_numpy()[text[new]], "ord": pdf["ord"].to_numpy()[text[new]]})

    return map_pandas(table.select("uid", "ord", "text"), run, "h long, uid long, ord long")


def _stretches(flagged: DataFrame, window: int) -> DataFrame:
    """h, seg, uid, ord, at: candidate stretches and the word at which each starts in its text. flagged: uid, ord, text, hs, frequent."""
    block, longest = BLOCK, STRETCH

    def run(batches):
        for batch in batches:
            for pdf in _blocks(batch, block):
                w = _Windows(pdf["text"].tolist(), window, longest)
                # A minimiser that is shared is so in every text.
                run = np.flatnonzero(np.isin(w.run_hash, np.concatenate(pdf["hs"].tolist())))
                often = np.isin(w.run_hash[run], np.concatenate(pdf["frequent"].tolist()))
                each = np.where(often, w.run_length[run], 1)  # very frequent ones go window by window
                run, often, nth = np.repeat(run, each), np.repeat(often, each), np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                text, at, h = w.run_text[run], w.run_start[run] + nth, w.run_hash[run]
                if often.any():
                    h = np.where(often, w.words.grams(window).view(np.int64)[at], h)
                seg = w.stretches(at, at + np.where(often, 1, w.run_length[run]) + window - 2)
                yield pd.DataFrame({"h": h, "seg": pd.Series(seg, dtype=object), "uid": pdf["uid"].to_numpy()[text], "ord": pdf["ord"].to_numpy()[text], "at": at - w.words.first[text]})

    return map_pandas(flagged.select("uid", "ord", "text", "hs", "frequent"), run, "h long, seg string, uid long, ord long, at int")


def _repeating(segs: pd.Series, window: int) -> np.ndarray:
    """Of each stretch: does it hold a window whose hash stands elsewhere too? Equal windows have equal hashes, so others hold no passage of another stretch."""
    words = FlatWords([s.encode() for s in segs])
    n = np.diff(words.first) - window + 1
    owner = np.repeat(np.arange(len(n)), n)
    _, of, count = np.unique(words.grams(window)[np.arange(len(owner)) + (window - 1) * owner], return_inverse=True, return_counts=True)
    out = np.zeros(len(n), bool)
    out[owner[count[of] > 1]] = True
    return out


def _matches(segments: DataFrame, shards: int, window: int) -> DataFrame:
    """h, seg, least, begins, ends: in each distinct stretch, the intervals of words that documents earlier than its earliest one (least) have.

    segments: h, seg, least, most. Stretches without an interval, and with no later document, are left out.
    """

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        again = _repeating(pdf["seg"], window)
        apart = pdf[~again & (pdf["most"] > pdf["least"]).to_numpy()]  # no window for the index, but a later document has all of it
        pdf = pdf[again]
        words = [s.split(" ") for s in pdf["seg"]]
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat, _ = pd.factorize(np.array([x for s in words for x in s], dtype=object))
        tokens = np.zeros(n.sum() + len(n), np.int64)  # 0 ends each stretch
        inside = np.ones(len(tokens), bool)
        end = np.cumsum(n + 1) - 1
        inside[end] = False
        tokens[inside] = flat + 1
        rank = np.unique(pdf["least"].to_numpy(), return_inverse=True)[1]
        reach = FmIndex(tokens, window).matching_statistics(np.repeat(rank, n + 1), end - n, end, rank)
        hit = np.concatenate(([False], reach >= window, [False]))
        first, after = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
        owner = np.searchsorted(end, first)
        cut = np.searchsorted(owner, np.arange(len(n) + 1))
        begins, ends = first - (end - n)[owner], after - 1 + window - (end - n)[owner]
        told = np.flatnonzero((np.diff(cut) > 0) | (pdf["most"].to_numpy() > pdf["least"].to_numpy()))
        rows = pd.concat([pdf.iloc[told], apart], ignore_index=True)[["h", "seg", "least"]]
        each = lambda x: pd.Series([x[cut[k] : cut[k + 1]] for k in told.tolist()] + [x[:0]] * len(apart), dtype=object)
        return rows.assign(begins=each(begins), ends=each(ends))

    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(lambda pdf: search(pdf), "h long, seg string, least long, begins array<int>, ends array<int>")


def covered(docs: DataFrame, window: int, keep: list[str]) -> DataFrame:
    """text, copy (true: an earlier document has the same words), begins, ends (of word intervals to remove) and the columns keep, for each row of docs."""
    table = _words_table(docs, keep)
    first = write_shared(table.groupBy("digest").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "digests")
    copies = join_hot(table.select("uid", "ord", "digest"), first, "digest", "rows", table.count()).where("ord > first")
    copies = write_shared(copies.select("uid", F.lit(True).alias("copy")), "copies")
    own = table.join(copies, "uid", "left_anti")

    grams = _minimisers(own, window)
    shared = grams.groupBy("h").agg(F.min("ord").alias("low"), F.max("ord").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("h", (F.col("n") > FREQUENT).alias("often"))
    flags = grams.select("h", "uid").join(shared, "h").groupBy("uid").agg(F.collect_list("h").alias("hs"), F.collect_list(F.when(F.col("often"), F.col("h"))).alias("frequent"))
    found = write_shared(_stretches(table.select("uid", "ord", "text").join(flags, "uid"), window), "stretches")

    size = found.agg(F.sum(F.size(F.split("seg", " "))).alias("words")).first()["words"] or 0
    distinct = found.groupBy("h", "seg").agg(F.min("ord").alias("least"), F.max("ord").alias("most"))
    matches = _matches(distinct, max(1, -(-size // SHARD_WORDS)), window)
    later = F.col("ord") > F.col("least")
    shifted = lambda c: F.transform(c, lambda x: F.col("at") + x)
    whole = F.when(later, F.array(F.col("at") + F.size(F.split("seg", " "))))
    hits = found.join(matches, ["h", "seg"]).select("uid", F.when(later, F.array("at")).otherwise(shifted("begins")).alias("begins"), F.coalesce(whole, shifted("ends")).alias("ends")).where(F.size("begins") > 0)
    hits = write_shared(hits.groupBy("uid").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends")), "hits")

    none = F.array().cast("array<int>")
    out = table.join(copies, "uid", "left").join(hits, "uid", "left")
    return out.select("text", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("begins", none).alias("begins"), F.coalesce("ends", none).alias("ends"), *keep)


def _keep_words(text: Column, copy: Column, begins: Column, ends: Column, window: int) -> Column:
    """struct(kept: the kept words joined by single spaces, n_words, n_removed)."""

    @F.pandas_udf("kept string, n_words long, n_removed long")
    def keep(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        try:
            for batch in batches:
                out = []
                for t, same, a, b in zip(*batch, strict=True):
                    kept = _joined(t)
                    n = left = kept.count(b" ") + 1 if kept else 0
                    if same and n >= window:
                        kept, left = b"", 0
                    elif len(a):
                        # Both lists are collected in one order; their sums do not depend on it.
                        depth = np.zeros(n + 1, np.int64)
                        np.add.at(depth, a, 1)
                        np.subtract.at(depth, b, 1)
                        words, stay = kept.split(b" "), np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()
                        kept, left = b" ".join([words[i] for i in stay]), len(stay)
                    out.append((kept.decode(), n, n - left))
                yield pd.DataFrame(out, columns=["kept", "n_words", "n_removed"])
        finally:
            release_memory()

    return keep(text, copy, begins, ends)


def _kept(docs: DataFrame, window: int, keep: list[str]) -> DataFrame:
    bound_batches(docs.sparkSession)
    rows = covered(docs, window, keep)
    return rows.withColumn("out", _keep_words(F.col("text"), F.col("copy"), F.col("begins"), F.col("ends"), window))


def deduplicate(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space) of each row."""
    rows = _kept(docs.select("doc_id", "text"), window, ["doc_id"])
    return rows.select("doc_id", "out.n_words", "out.n_removed", "out.kept")


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """docs, with the repeated words of each text removed; a text that loses nothing is unchanged, one that loses all goes."""
    others = [c for c in docs.columns if c.lower() != "text"]
    inner = {c: f"_keep{i}" for i, c in enumerate(others)}
    renamed = docs.select("doc_id", "text", F.col("text").isNull().alias("_null"), *[F.col(f"`{c}`").alias(x) for c, x in inner.items()])
    rows = _kept(renamed, window, ["_null", *inner.values()])
    rows = rows.where((F.col("out.n_removed") == 0) | (F.col("out.kept") != ""))
    text = F.when(F.col("_null"), F.lit(None)).when(F.col("out.n_removed") == 0, F.col("text")).otherwise(F.col("out.kept"))
    return rows.select(*[(text if c.lower() == "text" else F.col(inner[c])).alias(c) for c in docs.columns])
