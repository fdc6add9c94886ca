"""Spelling variants: words that differ by one inserted, deleted or replaced character, and the form that each rare one stands for.

1. Words are counted over all texts: each task counts its own first.
2. One edit leaves one half of the shorter word whole (either, of equal lengths): its first half as the longer one's beginning, or its second half as its end.
   Both halves of every word are held by automata (Aho-Corasick), in shards by the halves' outer letters, and every word is scanned by
   the two shards that hold the halves which its own beginning and end can match.
3. A hit counts if it stands at its offset (the beginning, or the end) and the word's length is its owner's or one more. Then the distance is verified on the
   other half: of all owners of a half and all words that hit it, those meet whose other halves are alike without one character, told by
   rolling hashes and compared character by character. No pair is tried that is not near, so a common half costs no square.
4. Shards give a row for each word with near ones: their number and the best one. Pairs are not given out.

A shard holds about SHARD characters. A key of more (a very common beginning) is dealt in blocks: parts of its automaton by parts of the
words to scan, each of SHARD characters. A word has few near ones (a bound by its length and alphabet), so forms and roots have no hot key.

Defined cases: a null text has no words; a null doc_id counts as empty text where ids are hashed; repeated rows count each; an empty table
gives no rows; of near words that occur equally often the first in code-point order is the form; further columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pandas, parts, write_shared

#: Characters of the words in one automaton.
SHARD = 1 << 19
#: Halves are in automata by this many outer characters at most; longer rests are compared one by one, as hashes without each of their characters would take too long.
LONG = 64
#: A-Z become a-z, those and U+00C0 to U+00FF are letters in Latin-1; the rest, and what Latin-1 lacks, separates words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
PART = 1 << 18
#: Distinct words that a task counts before it gives them out.
HELD = 200_000


def count_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, misspell: int | None = None) -> DataFrame:
    """word, n: the words of docs (doc_id, text) of least_length or more characters that occur least_count times or more.

    misspell: of each run of letters whose hash with its doc_id this number divides, one character, told by the hash, is left out first.
    """

    def counted(total: Counter[bytes]) -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series([w.decode("latin-1") for w in total], dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                state = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for part in parts((text or "").encode("latin-1", "replace").translate(_BYTES), PART):
                    for word, n in Counter(part.split()).items():
                        if misspell:
                            h = crc32(word if word.isascii() else word.decode("latin-1").encode(), state)
                            if h % misspell == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                        if len(word) >= least_length:
                            total[word] += n
                    if len(total) > HELD:
                        yield counted(total)
                        total.clear()
        yield counted(total)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return map_pandas(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _meet(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all equal numbers in left and right."""
    order = np.argsort(left, kind="stable")
    low, high = np.searchsorted(left[order], right, "left"), np.searchsorted(left[order], right, "right")
    n = high - low
    j = np.repeat(np.arange(len(right)), n)
    return order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(j))], j


def near_rests(group: np.ndarray, owners: list[str], hit: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) where words[j] has owners[i], of the same group, with one character replaced, or inserted if words are longer by one.

    All owners have one length, so have all words.
    """
    if not owners or not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    longer, width = len(words[0]) - len(owners[0]), len(words[0])
    if width > LONG:
        members = defaultdict(list)
        for i, g in enumerate(group.tolist()):
            members[g].append(i)
        pairs = [(i, j) for j, g in enumerate(hit.tolist()) for i in members[g] if _one_edit(owners[i], words[j])]
        return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)
    a, b = _codes(owners), _codes(words)
    c = np.random.default_rng(width).integers(1 << 62, size=width + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        hash_a = (a * c[: a.shape[1]]).sum(1, dtype=np.uint64) + group.astype(np.uint64) * c[-1]
        # Of b without its character at p: those before p keep their places, those after move down by one if they must.
        before = np.concatenate((np.zeros((len(b), 1), np.uint64), np.cumsum(b * c[:width], 1, dtype=np.uint64)), 1)
        moved = b[:, 1:] * c[: width - 1] if longer else b[:, 1:] * c[1:width]
        after = np.concatenate((np.cumsum(moved[:, ::-1], 1, dtype=np.uint64)[:, ::-1], np.zeros((len(b), 1), np.uint64)), 1)
        hash_b = hit.astype(np.uint64) * c[-1]
        found = []
        for p in range(width):
            i, j = _meet(hash_a if longer else hash_a - a[:, p] * c[p], hash_b + before[:, p] + after[:, p])
            kept = np.delete(b[j], p, 1)
            alike = (a[i] == kept).all(1) if longer else (np.delete(a[i], p, 1) == kept).all(1) & (a[i, p] != b[j, p])
            alike &= group[i] == hit[j]
            found.append(i[alike] * len(words) + j[alike])
    pair = np.unique(np.concatenate(found))  # one of equal characters in a row can go in several ways
    return pair // len(words), pair % len(words)


def _one_edit(u: str, v: str) -> bool:
    """Has v just one character of u replaced (equal lengths), or one more than u?"""
    p = next((p for p, (x, y) in enumerate(zip(u, v, strict=False)) if x != y), len(u))
    return u[p + (len(u) == len(v)) :] == v[p + 1 :] and u != v


def search_block(words: list[str], n: np.ndarray, owner: np.ndarray, scanned: np.ndarray, last: np.ndarray) -> pd.DataFrame:
    """word, n_near, best_n, best: for words of one block, how many near ones they meet in it and the best of these.

    owner: the word's half is in the automaton; scanned: the word is looked for; last: by its second half, else by its first.
    """
    halves: dict[str, int] = {}
    owners = defaultdict(list)  # of a half and side, by length
    for k in np.flatnonzero(owner).tolist():
        w, s = words[k], bool(last[k])
        half = w[len(w) // 2 :][-LONG:] if s else w[: len(w) // 2][:LONG]
        owners[halves.setdefault(half, len(halves)), s, len(w)].append(k)
    automaton = ahocorasick.Automaton()
    for half, g in halves.items():
        automaton.add_word(half, (g, len(half)))
    hits = defaultdict(list)  # by side and lengths: (half, word)
    if halves:
        automaton.make_automaton()
        for k in np.flatnonzero(scanned).tolist():
            w, s = words[k], bool(last[k])
            size, seen = len(w), w[-LONG:] if s else w[:LONG]
            for end, (g, length) in automaton.iter(seen):
                if end == len(seen) - 1 if s else end == length - 1:
                    for own in (size - 1, size):
                        if length == min(own - own // 2 if s else own // 2, LONG):
                            hits[s, own, size].append((g, k))
    by_length = defaultdict(lambda: ([], []))
    for (g, s, size), ks in owners.items():
        by_length[s, size][0].extend([g] * len(ks))
        by_length[s, size][1].extend(ks)

    who, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for (s, own, size), pairs in hits.items():
        groups, ks = by_length.get((s, own), ([], []))
        if own - own // 2 > LONG:  # the automaton has part of the half, so whole words are compared
            rest = lambda w: w
        else:
            rest = (lambda w, own=own: w[: len(w) - (own - own // 2)]) if s else (lambda w, own=own: w[own // 2 :])
        hit, js = np.array(pairs, np.int64).T
        ks = np.array(ks, np.int64)
        i, j = near_rests(np.array(groups, np.int64), [rest(words[k]) for k in ks.tolist()], hit, [rest(words[k]) for k in js.tolist()])
        i, j = ks[i], js[j]
        # The first half tells, where it is whole: each pair is met once.
        once = np.array([words[y].startswith(words[x][: own // 2]) != s for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
        i, j = i[once], j[once]
        who.append(j)
        other.append(i)
        if size > own:  # words of equal length find each other, a shorter one is found only
            who.append(i)
            other.append(j)
    who, other = np.concatenate(who), np.concatenate(other)
    place = np.argsort(np.argsort(np.array(words, dtype=object), kind="stable"), kind="stable")
    order = np.lexsort((place[other], -n[other], who))
    who, other = who[order], other[order]
    first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.zeros(0, np.int64)
    named = lambda ks: pd.Series([words[k] for k in ks.tolist()], dtype=object)
    return pd.DataFrame({"word": named(who[first]), "n_near": np.diff(np.append(first, len(who))), "best_n": n[other[first]], "best": named(other[first])})


def near_words(vocabulary: DataFrame, least_length: int = 7) -> DataFrame:
    """word, n_near, best_n, best: rows to be summed by word. vocabulary: word (distinct, of least_length or more characters) and n."""
    size = F.char_length("word")
    total = vocabulary.agg(F.sum(size)).first()[0] or 0
    outer = max(1, least_length // 2)
    sides = F.explode(F.array(F.struct(F.lit(False).alias("last"), F.substring("word", 1, outer).alias("key")), F.struct(F.lit(True).alias("last"), F.substring("word", -outer, outer).alias("key"))))
    rows = vocabulary.select("word", "n", sides.alias("side")).select("word", "n", "side.last", "side.key")
    # Keys of more than SHARD characters: 2 * total / SHARD at most, a millionth of the vocabulary or so.
    large = rows.groupBy("last", "key").agg(F.ceil(F.sum(size) / SHARD).cast("int").alias("parts")).where("parts > 1")
    dealt = rows.join(F.broadcast(large), ["last", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own, every = F.pmod(F.xxhash64("word", F.lit(1)), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    block = lambda i, j, owner, scanned: F.struct(i.alias("i"), j.alias("j"), owner.alias("owner"), scanned.alias("scanned"))
    holding = F.transform(every, lambda x: block(own, x, F.lit(True), x == own))
    looking = F.transform(F.filter(every, lambda x: x != own), lambda x: block(x, own, F.lit(False), F.lit(True)))
    alone = F.col("parts") == 1
    shard = F.when(alone, F.pmod(F.xxhash64("last", "key"), F.lit(-(-2 * total // SHARD) or 1)))
    blocks = dealt.select("word", "n", "last", shard.alias("shard"), F.when(~alone, F.col("key")).alias("key"), F.when(~alone, F.col("last")).alias("side"), F.explode(F.concat(holding, looking)).alias("b"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return search_block(pdf["word"].tolist(), pdf["n"].to_numpy(), pdf["owner"].to_numpy(bool), pdf["scanned"].to_numpy(bool), pdf["last"].to_numpy(bool))

    return blocks.select("shard", "key", "side", "word", "n", "last", "b.*").groupBy("shard", "key", "side", "i", "j").applyInPandas(search, "word string, n_near long, best_n long, best string")


def roots(links: DataFrame) -> DataFrame:
    """word, root: where each chain of links (word, form; one a word, without cycles) ends. Each round doubles what a link spans."""
    links = write_shared(links.select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = write_shared(links.join(onward, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "links")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def group_variants(vocabulary: DataFrame, ratio: int = 10, least_length: int = 7) -> DataFrame:
    """word, n, n_near (words at an edit distance of 1), form, form_n and root of each word of vocabulary (word, n).

    form: the near word that occurs most often, if at least ratio times as often as the word (ratio > 1, so that chains end); root: the last form of its chain, or the word itself.
    """
    if ratio <= 1:
        raise ValueError("ratio must be greater than 1")
    vocabulary = write_shared(vocabulary.select("word", "n"), "vocabulary")
    near = near_words(vocabulary, least_length).select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("form")).alias("best"))
    own = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<minus: long, form: string>").alias("best"))
    joined = own.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    far = -F.col("best.minus") >= ratio * F.col("n")
    formed = write_shared(joined.select("word", "n", "n_near", F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.minus")).alias("form_n")), "forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))

