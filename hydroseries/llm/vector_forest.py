"""Approximate nearest neighbours: a forest of random-projection trees, searched through one shared priority queue, then exact reranking.

The trees are grown on a bounded sample; every vector is then filed in its leaf of each tree. A query walks all trees at once: one
queue holds the branches not taken, least squared distance to the planes crossed first, and gives the leaves to visit until that gap
exceeds a bound. The bound is fitted to a recall: of PROBES vectors of the sample, the share `recall` of their true nearest ones in it lies
in leaves within it. So clustered vectors take few visits, and those without clusters as many as they need, at any size. Leaves and queries
meet by leaf, and candidates are reranked by exact cosine in double precision on the original vectors.

Copies of a vector are one entry: with ties going to the smaller id, only the k + 1 smallest ids of a vector can be among k nearest.

Defined cases: a vector that is null, zero, empty, of another length than most, or that holds null or non-finite components takes no part;
a query with fewer candidates gets all; equal scores go to the smaller id; a repeated id is one vector only if the vector is the same;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_pandas, write_shared

#: Vectors that the trees are grown on, at most.
SAMPLE = 100_000
#: Vectors of the sample whose nearest ones are sought exactly, to fit the bound.
PROBES = 256


@dataclass
class Tree:
    """Inner node i splits by normal[i] at offset[i]; children: an inner node's number, or ~leaf."""

    normal: np.ndarray
    offset: np.ndarray
    child: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.offset) else np.full(len(x), -1)
        going = np.flatnonzero(at >= 0)
        while len(going):
            n = at[going]
            side = ((x[going] * self.normal[n]).sum(1) > self.offset[n]).astype(np.int64)
            at[going] = self.child[n, side]
            going = going[at[going] >= 0]
        return ~at


def grow(x: np.ndarray, leaf: float, rng: np.random.Generator) -> Tree:
    """Splits at the median along random directions until a node holds at most leaf rows of the sample x."""
    normal, offset, child = [], [], []
    leaves = 0
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        direction = rng.standard_normal(x.shape[1])
        direction /= np.linalg.norm(direction)
        along = x[rows] @ direction
        middle = float(np.median(along)) if len(rows) else 0.0
        right = along > middle
        if len(rows) <= leaf or not right.any():
            me, leaves = ~leaves, leaves + 1
        else:
            me = len(offset)
            normal.append(direction)
            offset.append(middle)
            child.append([0, 0])
            todo += [(rows[right], me, 1), (rows[~right], me, 0)]
        if parent >= 0:
            child[parent][side] = me
    return Tree(np.array(normal).reshape(-1, x.shape[1]), np.array(offset), np.array(child, np.int64).reshape(-1, 2))


def search_leaves(trees: list[Tree], x: np.ndarray, bound: float) -> list[tuple[int, int]]:
    """(tree, leaf) of all leaves over all trees in one queue, least squared distance to the planes crossed first, until it exceeds the bound."""
    at = [t.normal @ x - t.offset for t in trees]
    queue = [(0.0, k, 0 if len(t.offset) else -1) for k, t in enumerate(trees)]
    heapq.heapify(queue)
    out = []
    while queue and queue[0][0] <= bound:
        gap, k, node = heapq.heappop(queue)
        while node >= 0:
            d = at[k][node]
            side = int(d > 0)
            if gap + d * d <= bound:
                heapq.heappush(queue, (gap + d * d, k, int(trees[k].child[node, 1 - side])))
            node = int(trees[k].child[node, side])
        out.append((k, ~node))
    return out


def leaf_gaps(tree: Tree, x: np.ndarray) -> np.ndarray:
    """For each row of x and each leaf, the squared distance to the planes crossed on the way to it."""
    out = np.zeros((len(tree.offset) + 1, len(x)))
    gap = np.zeros((len(tree.offset), len(x)))
    for i, (normal, offset, child) in enumerate(zip(tree.normal, tree.offset, tree.child.tolist(), strict=True)):  # a node comes before its children
        d = x @ normal - offset
        for side, c in enumerate(child):
            way = gap[i] + np.where((d > 0) == bool(side), 0.0, d * d)
            if c >= 0:
                gap[c] = way
            else:
                out[~c] = way
    return out.T


def fitted_bound(trees: list[Tree], sample: np.ndarray, k: int, recall: float) -> float:
    """The gap within which the share recall of the k nearest others of some rows of the sample lie, in the best tree for each."""
    n = len(sample)
    probes = np.unique(np.linspace(0, n - 1, min(PROBES, n)).astype(np.int64))
    k = min(k, n - 1)
    if k < 1:
        return 0.0
    nearest = []
    for part in np.array_split(probes, len(probes) // 32 + 1):
        near = sample[part] @ sample.T
        near[np.arange(len(part)), part] = -np.inf
        nearest.append(np.argpartition(-near, k - 1, axis=1)[:, :k])
    nearest = np.concatenate(nearest)
    gaps = [leaf_gaps(t, sample[probes])[np.arange(len(probes))[:, None], t.leaf_of(sample)[nearest]] for t in trees]
    return float(np.quantile(np.minimum.reduce(gaps), recall, method="higher"))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array<double>): the vectors that take part, of the most frequent length."""
    v = F.col(vec_col).cast("array<double>")
    clean = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(
        F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    )
    lengths = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return clean.join(F.broadcast(lengths.select("n")), F.size("v") == F.col("n"), "left_semi")


def unit_rows(v) -> np.ndarray:
    """Rows of length 1; scaling by the largest component first keeps squares in range."""
    x = np.array(list(v), np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


class _Tops:
    """The best entries of each query that a task has met, given out when many queries are held."""

    HELD = 100_000

    def __init__(self, k: int):
        self.k = k
        self.best: dict[int, dict[int, float]] = {}

    def add(self, queries: np.ndarray, q: np.ndarray, entries: np.ndarray, e: np.ndarray) -> None:
        k = min(self.k, len(entries))
        for part in np.array_split(np.arange(len(queries)), len(queries) * len(entries) // (1 << 21) + 1):
            near = q[part] @ e.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(entries) else np.tile(np.arange(k), (len(part), 1))
            # The product above only chooses; a pair's score is the same sum wherever it is met.
            score = (q[part][:, None, :] * e[top]).sum(2)
            for i, ids, values in zip(queries[part].tolist(), entries[top].tolist(), score.tolist(), strict=True):
                held = self.best.setdefault(i, {})
                held.update(zip(ids, values, strict=True))
                if len(held) > 4 * self.k:
                    self.best[i] = dict(sorted(held.items(), key=lambda x: (-x[1], x[0]))[: self.k])

    def rows(self) -> pd.DataFrame:
        out = [(i, e, s) for i, held in self.best.items() for e, s in sorted(held.items(), key=lambda x: (-x[1], x[0]))[: self.k]]
        self.best = {}
        return pd.DataFrame(out, columns=["query", "entry", "score"])


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = 4, recall: float = 0.96, seed: int = 11) -> DataFrame:
    """query_id, rank, id, score: the k vectors found nearest by cosine to each query; is_query: a condition on the id as a column `id`.

    A tree has about as many leaves as a leaf has vectors, the root of the table's size, so a leaf fits in a task at any size.
    recall is what the bound to a query's walk is fitted to. A query meets a leaf's vectors where the leaf is, and a task gives out only its best k + 1 for each query.
    Only the sample (SAMPLE vectors) and counts come to the driver.
    """
    spark = vectors.sparkSession
    own = usable(vectors, id_col, vec_col).dropDuplicates(["id", "v"])
    distinct = write_shared(own.groupBy("v").agg(F.min("id").alias("entry"), F.max(is_query).alias("asks")), "vectors")
    n = distinct.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    chosen = distinct.where(F.pmod(F.xxhash64("entry", "v"), F.lit(1 << 30)) <= int(min(1.0, SAMPLE / n) * (1 << 30))).limit(SAMPLE)
    sample = unit_rows(chosen.select("v").toPandas()["v"]) if n > SAMPLE else unit_rows(distinct.select("v").toPandas()["v"])
    rng = np.random.default_rng(seed)
    leaf = max(32.0, math.sqrt(n)) * len(sample) / n
    grown = [grow(sample, max(1.0, leaf), rng) for _ in range(trees)]
    forest = spark.sparkContext.broadcast(grown)
    bound = fitted_bound(grown, sample, k, recall)
    filed = "tree long, leaf long, asks boolean, entry long, v array<double>"

    def file(batches):
        for pdf in batches:
            if len(pdf):
                x = unit_rows(pdf["v"])
                for t, tree in enumerate(forest.value):
                    yield pd.DataFrame({"tree": t, "leaf": tree.leaf_of(x), "asks": False, "entry": pdf["entry"], "v": list(x)})

    def visit(batches):
        for pdf in batches:
            for entry, x in zip(pdf["entry"], unit_rows(pdf["v"]) if len(pdf) else (), strict=True):
                found = search_leaves(forest.value, x, bound)
                yield pd.DataFrame({"tree": [a for a, _ in found], "leaf": [b for _, b in found], "asks": True, "entry": entry, "v": [x] * len(found)})

    def score(batches):
        tops = _Tops(k + 1)
        leaf_at, ids, held = None, [], []
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["v"].tolist(), np.float64)
            entry, asks = pdf["entry"].to_numpy(), pdf["asks"].to_numpy()
            place = pdf["tree"].to_numpy() * (1 << 40) + pdf["leaf"].to_numpy()
            cut = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1), len(pdf)]
            for a, b in zip(cut, cut[1:], strict=False):
                if place[a] != leaf_at:
                    leaf_at, ids, held = place[a], [], []
                if not asks[a]:
                    ids.append(entry[a:b])
                    held.append(x[a:b])
                elif ids:
                    tops.add(entry[a:b], x[a:b], np.concatenate(ids), np.concatenate(held))
            if len(tops.best) > _Tops.HELD:
                yield tops.rows()
        yield tops.rows()

    placed = map_pandas(distinct.select("v", "entry"), file, filed).union(map_pandas(distinct.where("asks").select("v", "entry"), visit, filed))
    placed = placed.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "asks")
    scored = map_pandas(placed, score, "query long, entry long, score double").dropDuplicates(["query", "entry"])
    # The k + 1 best entries of a query hold its k best other vectors, for one of the entries may be the query alone.
    best = scored.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "entry"))).where(F.col("r") <= k + 1).drop("r")
    first = own.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1).drop("r").join(distinct.select("v", "entry"), "v").select("entry", "id")
    asked = own.where(is_query).withColumnRenamed("id", "query_id").join(distinct.select("v", F.col("entry").alias("query")), "v").select("query_id", "query")
    members = asked.join(best, "query").join(first, "entry").where(F.col("id") != F.col("query_id"))
    ranked = members.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
