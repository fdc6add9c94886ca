"""Connected cells of rasters of any size: tiles are labelled in tasks, small ones many at once, and labels meet along the borders of tiles.

A label is the first cell of its component in reading order, as one number. Of a tile, only cells on its border take part in
what follows: where two of them touch across a border, their labels are linked; linked labels take the least one, over tables in the
shared folder, in rounds that each double how far a label has seen. So no task holds more than one tile of TILE by TILE cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.sources.shared import write_shared

TILE = 512
#: Rows are the high half of a cell's number, columns, made positive, the low one: numbers stand in reading order.
HALF = 1 << 31


def label_cells(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For each cell, the first index of its component; cells touch by their sides."""
    if not len(row):
        return np.zeros(0, np.int64)
    width = int(col.max()) - int(col.min()) + 3
    return _label_places((row - row.min() + 1).astype(np.int64) * width + (col - col.min() + 1), width)


def _label_places(place: np.ndarray, width: int) -> np.ndarray:
    """label_cells of cells by their places in rows of width, the last of which no cell has."""
    order = np.argsort(place, kind="stable")
    where = place[order]
    pairs = []
    for step in (1, width):
        at = np.searchsorted(where, place + step)
        hit = (at < len(where)) & (where[np.minimum(at, len(where) - 1)] == place + step)
        pairs.append((np.flatnonzero(hit), order[at[hit]]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    label = np.arange(len(place))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    return label


def _label_tiles(owner: np.ndarray, row: np.ndarray, col: np.ndarray, tile: int) -> np.ndarray:
    """label_cells of many tiles at once. owner: each cell's tile, as a number from 0; row, col: its place in the tile."""
    side = tile + 1
    return _label_places((owner.astype(np.int64) * side + row) * side + col, side)


def _number(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    return row.astype(np.int64) * (2 * HALF) + (col.astype(np.int64) + HALF)


def _tile_of(tile: int) -> list[Column]:
    return [F.floor(F.col(c) / tile).cast("int").alias(name) for c, name in (("row", "_tr"), ("col", "_tc"))]


def tile_labels(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """raster_id, row, col and node (the first cell of its part of the component) of each distinct cell.

    Tiles stand behind one another in sorted partitions; a task holds one tile, or several small ones that are labelled at once.
    """
    keys = ["raster_id", "_tr", "_tc"]

    def label(*frames: pd.DataFrame) -> pd.DataFrame:
        pdf = pd.concat(frames, ignore_index=True)
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        first = _label_tiles(np.cumsum(begins(pdf)), row % tile, col % tile, tile)
        return pd.DataFrame({"raster_id": pdf["raster_id"], "row": row, "col": col, "node": _number(row, col)[first]})

    def begins(pdf: pd.DataFrame) -> np.ndarray:
        """Does another tile begin at a row? The first row counts as none."""
        code = np.stack([pd.factorize(pdf["raster_id"])[0], pdf["_tr"], pdf["_tc"]])
        return np.concatenate(([False], (code[:, 1:] != code[:, :-1]).any(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of one tile
        for pdf in batches:
            if not len(pdf):
                continue
            if held and begins(pd.concat((held[0].iloc[:1], pdf.iloc[:1])))[1]:
                yield label(*held)
                held = []
            cut = np.flatnonzero(begins(pdf))
            if len(cut):
                yield label(*held, pdf.iloc[: cut[-1]])
                held = [pdf.iloc[cut[-1] :]]
            else:
                held.append(pdf)
        if held:
            yield label(*held)

    placed = cells.select("raster_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).select("*", *_tile_of(tile))
    sorted_ = placed.repartition(*[F.col(k) for k in keys]).distinct().sortWithinPartitions(*keys, "row", "col")
    return sorted_.mapInPandas(run, "raster_id string, row int, col int, node long")


def border_links(edge: DataFrame, tile: int) -> DataFrame:
    """raster_id, a, b: the nodes of cells that touch across a border of tiles. edge: raster_id, row, col, node of border cells, or of all cells."""
    found = []
    for along, across in (("row", "col"), ("col", "row")):
        last = edge.where(F.pmod(F.col(across), F.lit(tile)) == tile - 1).select("raster_id", along, (F.col(across) + 1).alias(across), F.col("node").alias("a"))
        first = edge.where(F.pmod(F.col(across), F.lit(tile)) == 0).select("raster_id", along, across, F.col("node").alias("b"))
        found.append(last.join(first, ["raster_id", along, across]).select("raster_id", "a", "b"))
    return found[0].union(found[1]).distinct()


def least_nodes(links: DataFrame) -> DataFrame:
    """raster_id, node, root: the least node that links lead to, for each linked node. Each round takes the least root of neighbours, then the root's own root."""
    links = write_shared(links, "links")
    if links.isEmpty():
        return links.select("raster_id", F.col("a").alias("node"), F.col("b").alias("root"))
    both = write_shared(links.union(links.select("raster_id", "b", "a")), "links")
    root = write_shared(both.groupBy("raster_id", F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(root.withColumnRenamed("node", "b"), ["raster_id", "b"]).groupBy("raster_id", F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = root.join(near, ["raster_id", "node"]).select("raster_id", "node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        onward = root.select("raster_id", F.col("node").alias("root"), F.col("root").alias("next"))
        met = least.join(onward, ["raster_id", "root"]).select("raster_id", "node", F.least("root", "next").alias("root"), "was")
        new = write_shared(met.withColumn("moved", F.col("root") != F.col("was")), "roots")
        root = new.select("raster_id", "node", "root")
        if new.where("moved").isEmpty():
            return root


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with root: the node itself where it has no link."""
    return nodes.join(least_nodes(links), ["raster_id", "node"], "left").withColumn("root", F.coalesce("root", "node"))


def connected(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """raster_id, row, col, root (the first cell of the component, as a number that stands in reading order) of each distinct cell."""
    labelled = write_shared(tile_labels(cells, tile), "labels")
    return _rooted(labelled, border_links(labelled, tile)).select("raster_id", "row", "col", "root")


def enclosed(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """raster_id, hole_cells: how many cells that are not given have no way around the given ones to the outside.

    Tiles are counted from a raster's own box, one cell around the given ones, so a small raster is one tile; many of these are labelled at once.
    """
    box = cells.groupBy("raster_id").agg(*[f(c).cast("long").alias(f"{name}_{c}") for c in ("row", "col") for name, f in (("least", F.min), ("most", F.max))])
    box = box.select("raster_id", *[(F.col(f"least_{c}") - 1).alias(f"{c}0") for c in ("row", "col")], *[(F.col(f"most_{c}") - F.col(f"least_{c}") + 3).alias(n) for c, n in (("row", "height"), ("col", "width"))])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / tile).cast("int")))
    tiles = box.withColumn("_tr", every("height")).withColumn("_tc", every("width")).drop("row0", "col0")
    own = cells.join(box.select("raster_id", "row0", "col0"), "raster_id").select("raster_id", (F.col("row") - F.col("row0")).alias("row"), (F.col("col") - F.col("col0")).alias("col"))
    place = (F.col("row") % tile * tile + F.col("col") % tile).cast("int")
    taken = own.select("raster_id", *_tile_of(tile), place.alias("p")).groupBy("raster_id", "_tr", "_tc").agg(F.collect_set("p").alias("taken"))  # at most TILE * TILE

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = pdf["_tr"].to_numpy(np.int64) * tile, pdf["_tc"].to_numpy(np.int64) * tile
        bottom, right = pdf["height"].to_numpy(), pdf["width"].to_numpy()
        high, wide = np.minimum(bottom - top, tile), np.minimum(right - left, tile)
        start = np.cumsum(high * wide) - high * wide
        free = np.ones(int((high * wide).sum()), bool)
        given = [np.zeros(0, np.int64) if t is None else np.asarray(t, np.int64) for t in pdf["taken"]]
        p, of = np.concatenate(given), np.repeat(np.arange(len(pdf)), [len(g) for g in given])
        free[start[of] + p // tile * wide[of] + p % tile] = False
        owner = np.repeat(np.arange(len(pdf)), high * wide)[free]
        at = np.flatnonzero(free) - start[owner]
        r, c = at // wide[owner], at % wide[owner]
        node, part = np.unique(_label_tiles(owner, r, c, tile), return_inverse=True)
        row, col = r + top[owner], c + left[owner]
        rim = (row == 0) | (row == bottom[owner] - 1) | (col == 0) | (col == right[owner] - 1)
        names, number = pdf["raster_id"].to_numpy(), _number(row, col)
        parts = pd.DataFrame({"raster_id": names[owner[node]], "node": number[node], "size": np.bincount(part), "outside": np.bincount(part, weights=rim) > 0})
        border = ((r == 0) & (row > 0)) | ((r == tile - 1) & (row < bottom[owner] - 1)) | ((c == 0) & (col > 0)) | ((c == tile - 1) & (col < right[owner] - 1))
        edge = pd.DataFrame({"raster_id": names[owner[border]], "node": number[node[part[border]]], "row": row[border], "col": col[border]})
        return pd.concat((parts.astype({"size": "Int64", "outside": "boolean"}), edge.astype({"row": "Int64", "col": "Int64"})), ignore_index=True)[["raster_id", "node", "size", "outside", "row", "col"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells_ = np.minimum(pdf["height"] - pdf["_tr"] * tile, tile) * np.minimum(pdf["width"] - pdf["_tc"] * tile, tile)
            for _, some in pdf.groupby(np.cumsum(cells_.to_numpy(np.int64)) // (TILE * TILE), sort=False):
                yield label(some)

    found = tiles.join(taken, ["raster_id", "_tr", "_tc"], "left").select("raster_id", "_tr", "_tc", "height", "width", "taken")
    parts = write_shared(found.mapInPandas(run, "raster_id string, node long, size long, outside boolean, row long, col long"), "holes")
    edge = parts.where(F.col("row").isNotNull()).select("raster_id", "node", "row", "col")
    whole = _rooted(parts.where(F.col("row").isNull()).select("raster_id", "node", "size", "outside"), border_links(edge, tile)).groupBy("raster_id", "root").agg(F.sum("size").alias("size"), F.max("outside").alias("outside"))
    return whole.groupBy("raster_id").agg(F.sum(F.when(F.col("outside"), 0).otherwise(F.col("size"))).cast("long").alias("hole_cells"))
