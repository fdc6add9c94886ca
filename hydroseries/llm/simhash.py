"""SimHash near-duplicates: word-shingle fingerprints, linked within a Hamming radius by BK-trees, one tree a shard.

A fingerprint bit is 1 where over half of the shingles' hashes have it set. Copies share a fingerprint and are one class; only
distinct fingerprints are linked. (drop_near_copies takes distinct shingles; there a class is one set of them, and links are verified.)
A shard holds the fingerprints that agree on one key; its BK-tree files each under its parent by integer Hamming distance, and a search
follows only edges within the radius of its own distance. Keys are either all pairs of radius + 2 blocks (any two fingerprints within
the radius agree on two blocks: nothing is missed), or, for wide radii, tables of sampled bits with a stated recall. Trees of many
small shards are built and searched together, level by level, in numpy. A shard gives a spanning forest of its links, never all pairs;
components come from the forests by label propagation over tables in the shared folder.

Defined cases: a null or blank text has the fingerprint zero and links like any other; fewer words than a shingle are one shingle; a
null doc_id takes part but names no component unless the whole one is null; repeated rows are copies; an empty table gives no
rows; further columns are ignored, or kept by drop_near_copies. drop_near_copies keeps the row with the least (doc_id, hash of the text) of each
group, so rows of one doc_id with texts that are no near copies all stay; of rows alike in both one stays, and rows with a null doc_id stay.
"""

from __future__ import annotations

import dataclasses
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_hot, map_pandas, mix, write_bucketed, write_shared

SEED = 42
#: Rows that are worked on at once in a task: fingerprints, and pairs of query and node.
ROWS, PAIRS = 1 << 16, 1 << 17
#: Characters of text that are worked on at once.
CHARACTERS = 1 << 20
#: Rows of a shard among which a row's nearest ones are sought, and how many of these it names there, where not all links are asked for.
NEAR, NEAREST = 1024, 2
#: Tables of sampled bits are searched in so many passes; each pass seeks outside of the components that those before it have found.
PASSES = 3
#: Shards of more rows are grown one by one.
LARGE = 64
#: Shingles of a block of a class, about, and sets that are worked on at once, about.
BLOCK, SETS = 1 << 18, 1024
#: Sets of so many shingles or fewer are linked without fingerprints, whose distance tells little of them.
SHORT = 24


@dataclass(frozen=True)
class Blocks:
    """Exact keys: radius + 2 blocks of bits, a key for each pair of blocks. For 64 bits or fewer."""

    radius: int
    bits: int = 64

    def keys(self, lanes: np.ndarray) -> np.ndarray:
        n = self.radius + 2
        edges = [self.bits * i // n for i in range(n + 1)]
        masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
        both = [x | y for x, y in itertools.combinations(masks, 2)]
        out = [mix((lanes[:, 0] & np.uint64(m)) ^ mix(np.full(1, k + 1, np.uint64))) for k, m in enumerate(both)]
        return np.stack(out, 1).view(np.int64)


@dataclass(frozen=True)
class Sampled:
    """tables keys of width random bits each: two fingerprints at the radius share one with probability recall. chosen: the tables that are used, if not all."""

    radius: int
    bits: int
    width: int
    tables: int
    chosen: tuple[int, ...] | None = None

    def passes(self, n: int) -> list[Sampled]:
        """The tables in n parts or fewer."""
        return [dataclasses.replace(self, chosen=tuple(part.tolist())) for part in np.array_split(np.arange(self.tables), n) if len(part)]

    def growing(self, n: int) -> list[Sampled]:
        """The tables in n parts or fewer, each about four times as large as the one before."""
        cut = sorted({min(self.tables, math.ceil(self.tables / 4**k)) for k in range(n)})
        return [dataclasses.replace(self, chosen=tuple(range(a, b))) for a, b in zip([0, *cut], cut, strict=False)]

    @classmethod
    def of(cls, radius: int, bits: int, n: int, recall: float = 0.95) -> Sampled:
        """The width grows with the logarithm of n, so that chance meetings stay few; the tables grow to keep the recall."""
        width = max(16, math.ceil(math.log2(max(n, 2))) - 4)
        return cls(radius, bits, width, math.ceil(math.log(1 - recall) / math.log(1 - (1 - radius / bits) ** width)))

    @classmethod
    def at(cls, similarity: float, bits: int, n: int, recall: float = 0.98) -> Sampled:
        """For candidates: a pair of that similarity is within the radius and shares a key with probability recall, over the spread of its distance."""
        radius, p = radius_for(similarity, bits, 3.0), bit_difference(similarity)
        width = cls.of(radius, bits, n).width
        d = np.arange(radius + 1)
        chance = np.exp([math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(p) + (bits - k) * math.log(1 - p) for k in d])
        recall = min(recall, 0.99 * chance.sum())
        miss = 1 - (1 - d / bits) ** width
        return cls(radius, bits, width, next(t for t in itertools.count(1) if (chance * (1 - miss**t)).sum() >= recall))

    def keys(self, lanes: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        bit = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(len(lanes), -1), axis=1, bitorder="little")
        which = [rng.permutation(self.bits)[: self.width] for _ in range(self.tables)]
        tables = range(self.tables) if self.chosen is None else self.chosen
        return np.stack([bit[:, which[t]].astype(np.int64) @ (1 << np.arange(self.width)) + (t << self.width) for t in tables], 1)


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, A-Z lower-cased, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length) - 1
    start = end - length + 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start[: -shingle + 1 or None].tolist(), end[shingle - 1 :].tolist(), strict=True)], np.uint64)


def simhash(text: str, shingle: int, bits: int = 64) -> np.ndarray:
    return fold(shingle_hashes(text, shingle), bits)


def fold(h: np.ndarray, bits: int) -> np.ndarray:
    """bits / 64 lanes; further lanes come from remixed hashes."""
    lanes = np.zeros(bits // 64, np.uint64)
    for k in range(len(lanes) if len(h) else 0):
        with np.errstate(over="ignore"):
            x = h if k == 0 else mix(h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))
        ones = sum(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32).astype(np.int64) for part in np.array_split(x, len(x) // ROWS + 1))
        lanes[k] = np.packbits((2 * ones > len(x)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
    return lanes


def lane_id(lanes: np.ndarray) -> np.ndarray:
    """One integer a fingerprint: itself if it has one lane, else a 64-bit hash."""
    out = lanes[:, 0].copy()
    for k in range(1, lanes.shape[1]):
        out = mix(out) ^ lanes[:, k]
    return (mix(out) if lanes.shape[1] > 1 else out).view(np.int64)


def _text_parts(batches):
    """Frames of about CHARACTERS characters of the column text."""
    for pdf in batches:
        size = pdf["text"].str.len().fillna(0).astype(np.int64).cumsum().to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(size // CHARACTERS)) + 1).tolist(), len(pdf)]
        for a, b in itertools.pairwise(cut):
            if b > a:
                yield pdf.iloc[a:b]


def fingerprints(docs: DataFrame, shingle: int, bits: int = 64) -> DataFrame:
    """doc_id, fp_id and lanes of each row of docs; no shuffle."""

    def run(batches):
        for pdf in _text_parts(batches):
            lanes = np.array([simhash(t or "", shingle, bits) for t in pdf["text"]], np.uint64).reshape(len(pdf), bits // 64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp_id": lane_id(lanes), "lanes": pd.Series(list(lanes.view(np.int64)), index=pdf.index, dtype=object)})

    return map_pandas(docs.select("doc_id", "text"), run, "doc_id long, fp_id long, lanes array<long>")


def shingle_sets(rows: DataFrame, shingle: int, bits: int, most: int | None = None) -> DataFrame:
    """uid, fp_id (a hash of the set), lanes and sorted distinct shingles of the texts of rows (uid, text); no shuffle. Sets of more than `most` shingles are left null."""

    def run(batches):
        for pdf in _text_parts(batches):
            sets = [np.unique(shingle_hashes(t or "", shingle)) for t in pdf["text"]]
            yield pd.DataFrame({
                "uid": pdf["uid"].to_numpy(), "fp_id": np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64),
                "lanes": [fold(s, bits).view(np.int64) for s in sets], "shingles": [s.view(np.int64) if most is None or len(s) <= most else None for s in sets],
            })

    return map_pandas(rows.select("uid", "text"), run, "uid long, fp_id long, lanes array<long>, shingles array<long>")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class BkForest:
    """One BK-tree for each shard; rows of a shard are consecutive, and its first row is the root."""

    def __init__(self, lanes: np.ndarray, shard: np.ndarray):
        self.lanes = lanes
        self.span = lanes.shape[1] * 64 + 1
        self.first = first = np.flatnonzero(np.concatenate(([True], np.diff(shard) != 0)))
        self.size = np.diff(np.concatenate((first, [len(shard)])))
        self.root = np.repeat(first, self.size)
        rest = np.setdiff1d(np.arange(len(shard)), first, assume_unique=True)
        at = self.root[rest]
        keys, nodes = [], []
        while len(rest):
            key = at * self.span + _distance(lanes[rest], lanes[at])
            edge, child, where = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            nodes.append(rest[child])
            settled = np.zeros(len(rest), bool)
            settled[child] = True
            rest, at = rest[~settled], rest[child][where][~settled]
        order = np.argsort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        self.edge = np.concatenate(keys)[order] if keys else np.zeros(0, np.int64)
        self.node = np.concatenate(nodes)[order] if nodes else np.zeros(0, np.int64)

    def search(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query row and another row of its shard within the radius."""
        q, at = query, self.root[query]
        found = []
        while len(q):
            d = _distance(self.lanes[q], self.lanes[at])
            hit = (d <= radius) & (q != at)
            found.append((q[hit], at[hit]))
            low = np.searchsorted(self.edge, at * self.span + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edge, at * self.span + np.minimum(d + radius, self.span - 1), side="right")
            n = high - low
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, at = np.repeat(q, n), self.node[np.repeat(low, n) + step]
        return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))

    def components(self, radius: int) -> np.ndarray:
        """For each row, the first row of its component within its shard."""
        label = np.arange(len(self.root))
        block = np.cumsum(np.repeat(self.size, self.size)) // PAIRS
        for rows in np.split(label.copy(), np.flatnonzero(np.diff(block)) + 1):
            begin = self.root[rows[0]]
            size = int(self.size[np.searchsorted(self.first, begin)])
            # A part of one large shard: once all of the shard is one component, further links change nothing. The block can go on into other shards.
            if size > len(rows) and (label[begin : begin + size] == label[begin]).all():
                rows = rows[self.root[rows] != begin]
            a, b = self.search(rows, radius)
            while len(a):
                x, y = label[a], label[b]
                apart = x != y
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label != label[label]).any():
                    label = label[label]
        return label


def _whole_keys(batches, rows: int = ROWS):
    """Frames sorted by key, of about `rows` rows, cut so that the rows of a key stay together; keys of one row are left out."""
    done: list[pd.DataFrame] = []  # of keys that are complete
    last: list[pd.DataFrame] = []  # of the key that may go on
    n = 0

    def several(frames: list[pd.DataFrame]):
        frame = pd.concat(frames, ignore_index=True)
        key = frame["key"].to_numpy()
        apart = key[1:] != key[:-1]
        return frame[~(np.concatenate(([True], apart)) & np.concatenate((apart, [True])))]

    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf["key"].to_numpy()
        if last and last[0]["key"].iat[0] != key[-1]:
            done += last
            n += sum(map(len, last))
            last = []
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            done.append(pdf[:cut])
            n += cut
        last.append(pdf[cut:])
        if n >= rows:
            yield several(done)
            done, n = [], 0
    if done or last:
        yield several(done + last)


def _shards(distinct: DataFrame, scheme: Blocks | Sampled, carried: list[str]) -> DataFrame:
    """key, the lanes l0 and on, and the carried columns: a row for each key of a fingerprint.

    Rows are dealt by a hash of the key, so shards spread over all tasks; a shard's rows stream in sorted order and small shards are
    worked on together.
    """
    width = scheme.bits // 64

    def shard(batches):
        for pdf in batches:
            lanes = np.array(pdf["lanes"].tolist(), np.int64).reshape(len(pdf), width).view(np.uint64)
            keys = scheme.keys(lanes)
            for part in np.array_split(np.arange(keys.size), keys.size // ROWS + 1):
                row = part // keys.shape[1]
                yield pd.DataFrame({"key": keys.ravel()[part]} | {f"l{k}": lanes[row, k].view(np.int64) for k in range(width)} | {c: pdf[c].to_numpy()[row] for c in carried})

    names = ["key", *[f"l{k}" for k in range(width)], *carried]
    rows = map_pandas(distinct.select("lanes", *carried), shard, ", ".join(f"{c} long" for c in names))
    return rows.repartition(F.col("key")).sortWithinPartitions("key")


def _lanes_of(frame: pd.DataFrame, scheme: Blocks | Sampled) -> np.ndarray:
    return np.stack([frame[f"l{k}"].to_numpy() for k in range(scheme.bits // 64)], 1).view(np.uint64)


def _forest(label: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """a, b: the smallest node stands for its component, so that the same nodes stand for it in many shards."""
    least = ids.copy()
    np.minimum.at(least, label, ids)
    linked = np.flatnonzero(least[label] != ids)
    return pd.DataFrame({"a": least[label[linked]], "b": ids[linked]})


def links(distinct: DataFrame, scheme: Blocks | Sampled) -> DataFrame:
    """a, b: a spanning forest of the links in each shard, from fp_id (as of lane_id) and lanes of distinct fingerprints."""

    def run(batches):
        for frame in _whole_keys(batches):
            if len(frame):
                lanes = _lanes_of(frame, scheme)
                yield _forest(BkForest(lanes, frame["key"].to_numpy()).components(scheme.radius), lane_id(lanes))

    return map_pandas(_shards(distinct, scheme, []), run, "a long, b long").distinct()


def grown(part: np.ndarray, near) -> np.ndarray:
    """For each row, the first row of its component; near(k, left) tells which of the rows left are linked to row k. Rows of one part are linked.

    Rows that have been reached are not asked about again, so a dense group costs few comparisons a row.
    """
    label = np.arange(len(part))
    left = label.copy()
    while len(left):
        first, asking, reached = left[0], [], part[left] == part[left[0]]
        while True:
            label[left[reached]] = first
            asking += left[reached].tolist()
            left = left[~reached]
            if not asking or not len(left):
                break
            reached = near(asking.pop(), left)
            if reached.any():
                reached = np.isin(part[left], part[left[reached]])
    return label


def _linked(lanes: np.ndarray, key: np.ndarray, radius: int) -> np.ndarray:
    """For each row, the first row of its component within its shard (rows of one key): large shards are grown, small ones searched together."""
    size = np.diff(np.concatenate((at := np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), [len(key)])))
    large = np.repeat(size > LARGE, size)
    label = np.arange(len(key))
    small = np.flatnonzero(~large)
    if len(small):
        label[small] = small[BkForest(lanes[small], key[small]).components(radius)]
    for a, n in zip(at[size > LARGE].tolist(), size[size > LARGE].tolist(), strict=True):
        mine = lanes[a : a + n]
        label[a : a + n] = a + grown(np.arange(n), lambda k, left, mine=mine: _distance(mine[left], mine[k]) <= radius)
    return label


def part_links(distinct: DataFrame, scheme: Sampled) -> DataFrame:
    """a, b: links between parts, a spanning forest in each shard, from lanes and part. Every link within the radius counts; a shard gives fewer rows than it holds parts."""

    def run(batches):
        for frame in _whole_keys(batches):
            if not len(frame):
                continue
            key, part = frame["key"].to_numpy(), frame["part"].to_numpy()
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            several = np.repeat(np.minimum.reduceat(part, first) != np.maximum.reduceat(part, first), np.diff([*first, len(key)]))
            if several.any():
                yield _forest(_linked(_lanes_of(frame[several], scheme), key[several], scheme.radius), part[several]).drop_duplicates()

    return map_pandas(_shards(distinct, scheme, ["part"]), run, "a long, b long").distinct()


def nearest_links(distinct: DataFrame, scheme: Sampled, nearest: int) -> DataFrame:
    """src, dst, d: for each fingerprint and shard, the nearest others of another part within the radius, so many, ties to the smaller id, from fp_id, lanes and part.

    A shard of more than NEAR rows is sorted by its fingerprints and searched in runs of NEAR rows, so work and output grow with the
    rows, however many near copies one shard holds; the same two meet in other tables again. part_links and class_links lose none of the rest.
    """

    def run(batches):
        for frame in _whole_keys(batches):
            if not len(frame):
                continue
            lanes, key = _lanes_of(frame, scheme), frame["key"].to_numpy()
            order = np.lexsort((*lanes.T[::-1], key))
            lanes, key, ids, part = lanes[order], key[order], frame["fp_id"].to_numpy()[order], frame["part"].to_numpy()[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            place = np.arange(len(key)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            forest = BkForest(lanes, np.cumsum(new | (place % NEAR == 0)))
            work = np.cumsum(forest.size[np.searchsorted(forest.first, forest.root)])
            for rows in np.split(np.arange(len(key)), np.flatnonzero(np.diff(work // PAIRS)) + 1):
                a, b = forest.search(rows, scheme.radius)
                apart = part[a] != part[b]
                a, b = a[apart], b[apart]
                d = _distance(lanes[a], lanes[b])
                best = np.lexsort((ids[b], d, a))
                best = best[np.arange(len(best)) - np.searchsorted(a[best], a[best]) < nearest]  # of each asking row the first few
                yield pd.DataFrame({"src": ids[a[best]], "dst": ids[b[best]], "d": d[best]})

    return map_pandas(_shards(distinct, scheme, ["fp_id", "part"]), run, "src long, dst long, d long").distinct()


def _needed(similarity: float, n: int) -> int:
    """Shingles that a set of n shares with any set that similar, at least."""
    return math.ceil(similarity * n - 1e-9)


def set_components(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set, the first one of its component by links of at least that Jaccard similarity; exact."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    there = np.arange(n.max()) < n[:, None]
    cells = np.zeros(there.shape, np.uint64)
    cells[there] = np.concatenate(sets)
    label = np.arange(len(sets))
    left = label.copy()
    while len(left):
        first, left, asking = left[0], left[1:], [left[0]]
        while asking and len(left):
            k = asking.pop()
            shared = (np.isin(cells[left], sets[k]) & there[left]).sum(1)
            near = shared >= similarity * (n[left] + n[k] - shared) - 1e-9
            label[left[near]] = first
            asking += left[near].tolist()
            left = left[~near]
    return label


def _longest_met(similarity: float) -> int:
    """Shingles that a set similar to one of SHORT shingles has at most."""
    return int(SHORT / similarity + 1e-9)


def short_links(sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: a spanning forest, in each shard, of all links of a set of SHORT shingles or fewer, from fp_id and shingles. Exact.

    Sets that similar share one of the first shingles of each, so a shard is a shingle; its sets come along and are compared there.
    """
    most = _longest_met(similarity)

    def keys(batches):
        for pdf in batches:
            rows = []
            for i, s in zip(pdf["fp_id"], pdf["shingles"], strict=True):
                if _needed(similarity, len(s)) < len(s) or _needed(similarity, len(s) + 1) <= len(s):
                    rows += [(k, i, s) for k in s[: len(s) - _needed(similarity, len(s)) + 1].tolist()]
            yield pd.DataFrame(rows, columns=["key", "fp_id", "shingles"])

    def run(batches):
        for frame in _whole_keys(batches):
            key, ids = frame["key"].to_numpy(), frame["fp_id"].to_numpy()
            sets = [np.asarray(s, np.int64).view(np.uint64) for s in frame["shingles"]]
            label = np.arange(len(key))
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            for a, b in zip(cut, [*cut[1:], len(key)], strict=True) if len(key) else ():
                label[a:b] = a + set_components(sets[a:b], similarity)
            yield _forest(label, ids)

    short = map_pandas(one_each(sets.where(F.size("shingles").between(1, most))), keys, "key long, fp_id long, shingles array<long>")
    return map_pandas(short.repartition(F.col("key")).sortWithinPartitions("key"), run, "a long, b long").distinct()


def similar_sets(sets: list[np.ndarray], part: np.ndarray, side: np.ndarray, similarity: float) -> np.ndarray:
    """For each set, the first one of its component by links of at least that Jaccard similarity; exact. Sets of one part are linked; where there are two sides, only sets of different ones are compared."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(n) - n
    there, full = np.zeros(len(names), np.int32), n > 0
    across = (side != side[0]).any()

    def near(k: int, left: np.ndarray) -> np.ndarray:
        mine = at[start[k] : start[k] + n[k]]
        there[mine] = 1
        shared = np.zeros(len(left), np.int64)
        if 8 * len(left) < len(sets):
            shared[:] = [there[at[start[i] : start[i] + n[i]]].sum() for i in left.tolist()]
        elif full.any():
            whole = np.zeros(len(sets), np.int64)
            whole[full] = np.add.reduceat(there[at], start[full])
            shared = whole[left]
        there[mine] = 0
        hit = shared >= similarity * (n[left] + n[k] - shared) - 1e-9
        return hit & (side[left] != side[k]) if across else hit

    return grown(part, near)


def class_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: a spanning forest of all links of at least that Jaccard similarity between sets of one class, from members (fp_id, class, part) and sets (fp_id, shingles); exact.

    A class of more than BLOCK shingles is dealt into blocks, and each two of them meet in a task of their own: no task holds more than two blocks,
    and a pair of blocks gives fewer rows than it has sets.
    """
    sized = members.join(sets.select("fp_id", F.size("shingles").alias("n")), "fp_id").groupBy("class").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    side = F.pmod(F.xxhash64("fp_id"), F.col("blocks")).alias("side")
    dealt = members.join(F.broadcast(sized.where("blocks > 1")), "class", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint"))).select("*", side)
    met = dealt.select("fp_id", "class", "part", "side", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    keyed = met.select(F.xxhash64("class", F.least("side", "other"), F.greatest("side", "other")).alias("key"), "fp_id", "part", "side")

    def run(batches):
        for frame in _whole_keys(batches, SETS):
            key, ids, part, side = (frame[c].to_numpy() for c in ("key", "fp_id", "part", "side"))
            sets_, label = [np.asarray(s, np.int64) for s in frame["shingles"]], np.arange(len(key))
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else []
            for a, b in zip(cut, [*cut[1:], len(key)], strict=True) if len(key) else ():
                label[a:b] = a + similar_sets(sets_[a:b], part[a:b], side[a:b], similarity)
            yield _forest(label, ids)

    rows = keyed.join(sets, "fp_id").repartition(F.col("key")).sortWithinPartitions("key")
    return map_pandas(rows.select("key", "fp_id", "part", "side", "shingles"), run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component, for all nodes that have a link. edges: a, b; a node is b in a few rows at most.

    Each round takes the least label among neighbours and then the label's own label; every round is written to the shared folder.
    """
    # First each node keeps one edge, to the least a it is linked to, and its other a's are linked to that one: of these there are few.
    least = edges.groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("others"))
    star = write_shared(least, "edges")
    others = star.select("a", F.explode(F.filter("others", lambda x: x != F.col("a"))).alias("b")).distinct()
    star = star.select("a", "b").union(others)
    both = write_shared(star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = write_shared(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = label.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = write_shared(least.join(jump, "label").select("node", F.least("label", "next").alias("label"), (F.col("was") != F.least("label", "next")).alias("moved")), "labels")
        label = new.select("node", "label")
        if new.where("moved").isEmpty():
            return label


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, label: the smallest node) with further links a, b between nodes. Only the components that links join are gone through, each as one node."""
    of = {end: label.select(F.col("node").alias(end), F.col("label").alias(f"{end}_part")) for end in ("a", "b")}
    parts = links.join(of["a"], "a", "left").join(of["b"], "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")).where("a <> b")
    joined = components(parts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    onward = joined.select(F.col("node").alias("label"), F.col("label").alias("next"))
    moved = label.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return write_shared(moved.unionByName(joined.join(label, "node", "left_anti")), "labels")


def classes(fps: DataFrame, scheme: Blocks | Sampled) -> DataFrame:
    """fp_id, component_id (the smallest doc_id of the component), rows, for each distinct fingerprint. fps: doc_id, fp_id, lanes."""
    distinct = write_shared(fps.groupBy("fp_id").agg(F.any_value("lanes").alias("lanes"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "fingerprints")
    return class_ids(distinct, components(links(distinct, scheme)))


def class_ids(distinct: DataFrame, label: DataFrame) -> DataFrame:
    """fp_id, component_id, rows of each fingerprint, from its smallest id (least) and the labels of linked nodes."""
    linked = distinct.select(F.col("fp_id").alias("node"), "least").join(label, "node")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    joined = linked.join(least, "label").select(F.col("node").alias("fp_id"), "component_id")
    return distinct.select("fp_id", "least", "rows").join(joined, "fp_id", "left").select("fp_id", F.coalesce("component_id", "least").alias("component_id"), "rows")


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of each row, all links within the radius followed; exact."""
    fps = write_shared(fingerprints(docs, shingle), "doc-fingerprints")
    found = write_shared(classes(fps, Blocks(radius)), "classes")
    joined = join_hot(fps.select("doc_id", "fp_id"), found, "fp_id", "rows", fps.count())
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp_id"), 16, "0")).alias("fingerprint"), "component_id")


def bit_difference(similarity: float) -> float:
    """Share of bits in which two sets of that Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_for(similarity: float, bits: int, deviations: float = 1.0) -> int:
    """Hamming radius: the mean distance of pairs of that Jaccard similarity, and so many standard deviations."""
    p = bit_difference(similarity)
    return round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def one_each(sets: DataFrame) -> DataFrame:
    """fp_id, shingles: of copies one row, summed up before the shuffle."""
    return sets.groupBy("fp_id").agg(F.any_value("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets (fp_id, shingles; one row a set) have at least that Jaccard similarity; exact."""
    both = pairs.join(sets.select(F.col("fp_id").alias("a"), F.col("shingles").alias("_a")), "a").join(sets.select(F.col("fp_id").alias("b"), F.col("shingles").alias("_b")), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.where(shared >= similarity * (F.size("_a") + F.size("_b") - shared) - 1e-9).select("a", "b")


def _parts(distinct: DataFrame, label: DataFrame) -> DataFrame:
    """fp_id, lanes and part: the label of a linked node, else the fingerprint itself."""
    return distinct.select("fp_id", "lanes").join(label.withColumnRenamed("node", "fp_id"), "fp_id", "left").withColumn("part", F.coalesce("label", "fp_id"))


def _sets_of(distinct: DataFrame, ends: DataFrame, texts: DataFrame, shingle: int, bits: int) -> DataFrame:
    """fp_id and shingles of those distinct sets that are in ends (fp_id), made anew from one text each."""
    one = distinct.join(ends, "fp_id", "left_semi").select("least.uid")
    return write_shared(shingle_sets(texts.join(one, "uid", "left_semi"), shingle, bits).select("fp_id", "shingles"), "shingle-sets")


def similar_classes(fps: DataFrame, texts: DataFrame, similarity: float, shingle: int, bits: int, nearest: int | None = None) -> DataFrame:
    """fp_id, component_id: the smallest (doc_id, text_id, uid) of the component by verified links, and rows, for each distinct set.

    fps: uid, doc_id, text_id, fp_id, lanes, shingles (of short sets); texts: uid, text, bucketed by uid, from which the sets of candidates
    are made anew, one text a set. Fingerprints within the radius that meet in a table are in one class, whatever leads from one to the other;
    within a class all sets are compared. The tables are searched in PASSES, of which the first, small one joins most: later ones seek between classes only.
    With `nearest`, see _nearest_classes.
    """
    distinct = write_shared(fps.groupBy("fp_id").agg(F.any_value("lanes").alias("lanes"), F.min(F.struct("doc_id", "text_id", "uid")).alias("least"), F.count(F.lit(1)).alias("rows")), "fingerprints")
    label = components(short_links(fps.where(F.col("shingles").isNotNull()).select("fp_id", "shingles"), similarity))
    scheme = Sampled.at(similarity, bits, distinct.count())
    if nearest:
        return class_ids(distinct, _nearest_classes(distinct, label, texts, similarity, shingle, bits, scheme, nearest))
    wide = label
    for tables in scheme.growing(PASSES):
        found = write_shared(part_links(_parts(distinct, wide), tables), "class-links")
        if not found.isEmpty():
            wide = merged(wide, found)
    of = label.select(F.col("node").alias("fp_id"), F.col("label").alias("part"))
    members = wide.select(F.col("node").alias("fp_id"), F.col("label").alias("class")).join(of, "fp_id", "left").select("fp_id", "class", F.coalesce("part", "fp_id").alias("part"))
    # Classes that short sets have linked already have nothing to compare.
    several = members.groupBy("class").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q")
    members = write_shared(members.join(several, "class", "left_semi"), "members")
    found = write_shared(class_links(members, _sets_of(distinct, members, texts, shingle, bits), similarity), "verified")
    return class_ids(distinct, label if found.isEmpty() else merged(label, found))


def _nearest_classes(distinct: DataFrame, label: DataFrame, texts: DataFrame, similarity: float, shingle: int, bits: int, scheme: Sampled, nearest: int) -> DataFrame:
    """The labels with further links between each set and its nearest candidates only, so many in each of its shards: bounded work, which can miss links.

    The tables are searched in PASSES, each outside of the components so far. In the rounds of a pass, each set tries its nearest candidates that are
    not in its component yet: one, then two, four and so on, until every candidate is verified, refused, or joined by others.
    """
    refused = None
    for tables in scheme.passes(PASSES):
        left = nearest_links(_parts(distinct, label), tables, nearest).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "src", "dst", "d")
        if refused is not None:
            left = left.join(refused, ["a", "b"], "left_anti")
        left = write_shared(left.drop("a", "b"), "candidates")
        sets = _sets_of(distinct, left.select(F.explode(F.array("src", "dst")).alias("fp_id")).distinct(), texts, shingle, bits)
        most = 1
        while not left.isEmpty():
            of = {end: label.select(F.col("node").alias(end), F.col("label").alias(f"{end}_part")) for end in ("src", "dst")}
            apart = left.join(of["src"], "src", "left").join(of["dst"], "dst", "left").where(F.coalesce("src_part", "src") != F.coalesce("dst_part", "dst"))
            # A set has at most nearest candidates a table.
            ranked = write_shared(apart.select("src", "dst", "d", (F.row_number().over(W.partitionBy("src").orderBy("d", "dst")) <= most).alias("now")), "candidates")
            pairs = write_shared(ranked.where("now").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "pairs")
            found = write_shared(verified(pairs, sets, similarity), "verified")
            if not found.isEmpty():
                label = merged(label, found)
            wrong = pairs.join(found, ["a", "b"], "left_anti")
            refused = wrong if refused is None else refused.unionByName(wrong)
            left, most = ranked.where("NOT now").select("src", "dst", "d"), 2 * most
    return label


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bits: int = 256, nearest: int | None = None) -> DataFrame:
    """docs with one row of each group of near copies, the one with the smallest (doc_id, hash of the text); rows with a null doc_id stay.

    Near copies have sets of distinct shingles of at least that Jaccard similarity. Fingerprints and short texts' shingles give classes, within
    which all whole sets are compared, or with `nearest` so many candidates of each text in each shard; each link is verified on whole sets. Texts are shuffled once, by row number, and sets of classes with several texts once more.
    """
    rows = write_bucketed(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("doc")), "uid", "documents")
    texts = rows.where(F.col("doc.doc_id").isNotNull()).select("uid", "doc.doc_id", "doc.text")
    made = shingle_sets(texts, shingle, bits, _longest_met(similarity))
    fps = write_shared(made.join(texts.select("uid", "doc_id", F.xxhash64("text").alias("text_id")), "uid"), "doc-fingerprints")
    found = write_shared(similar_classes(fps, texts.select("uid", "text"), similarity, shingle, bits, nearest), "classes")
    dropped = join_hot(fps.select("uid", "fp_id"), found, "fp_id", "rows", fps.count()).where(F.col("uid") != F.col("component_id.uid")).select("uid")
    return rows.join(dropped, "uid", "left_anti").select("doc.*")
