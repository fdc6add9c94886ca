"""Components and holes over tiles against labelling a whole raster in one task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroseries.operators import continuity, tiles


def table(spark, rasters):
    return spark.createDataFrame([(k, r, c) for k, cells in rasters.items() for r, c in cells], "raster_id string, row int, col int")


def plain_components(cells):
    """{cell: number of its component}, numbered by first cells in reading order."""
    left, out, number = set(cells), {}, 0
    for cell in sorted(left):
        if cell in out:
            continue
        number += 1
        todo = [cell]
        out[cell] = number
        while todo:
            r, c = todo.pop()
            for near in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if near in left and near not in out:
                    out[near] = number
                    todo.append(near)
    return out


def plain_holes(cells):
    cells = set(cells)
    rows, cols = [r for r, _ in cells], [c for _, c in cells]
    box = {(r, c) for r in range(min(rows) - 1, max(rows) + 2) for c in range(min(cols) - 1, max(cols) + 2)}
    labels = plain_components(box - cells)
    return sum(n != labels[(min(rows) - 1, min(cols) - 1)] for n in labels.values())


def snake(n=9):
    """A way through all 3 x 3 tiles of side n / 3 and back, one cell wide, with rings inside."""
    cells = []
    for r in range(0, n, 2):
        cells += [(r, c) for c in range(n)]
        if r + 2 < n:
            cells.append((r + 1, n - 1 if r % 4 == 0 else 0))
    return cells


@pytest.fixture(scope="module")
def rasters():
    rng = random.Random(6)
    noise = {f"noise{p}": [(r, c) for r in range(-7, 12) for c in range(-5, 14) if rng.random() < p] for p in (0.3, 0.5, 0.62, 0.8)}
    ring = [(r, c) for r in range(20) for c in range(20) if r in (0, 19) or c in (0, 19)]
    return noise | {"snake": snake(), "ring": ring, "nested": [*ring, *[(r + 5, c + 5) for r, c in ring if r < 9 and c < 9], (7, 8)], "one": [(-3, -4)], "far": [(0, 0), (0, 40), (40, 0)]}


@pytest.mark.parametrize("tile", [3, 5, 512])
def test_components_equal_plain_ones(spark, rasters, tile):
    cells = table(spark, {k: [*v, *v[:3]] for k, v in rasters.items()}).repartition(4)
    got = {}
    for r in continuity.components(cells, tile).collect():
        assert (r.row, r.col) not in got.setdefault(r.raster_id, {})
        got[r.raster_id][r.row, r.col] = r.component
    assert got == {k: plain_components(v) for k, v in rasters.items()}


@pytest.mark.parametrize("tile", [4, 512])
def test_holes_equal_plain_ones(spark, rasters, tile):
    cells = table(spark, rasters)
    got = {r.raster_id: r.hole_cells for r in tiles.enclosed(cells, tile).collect()}
    assert got == {k: plain_holes(v) for k, v in rasters.items()} and got["ring"] == 18 * 18
    whole = {r.raster_id: r for r in continuity.continuity(cells, tile=tile).collect()}
    for k, v in rasters.items():
        labels = list(plain_components(v).values())
        sizes = sorted((labels.count(n) for n in set(labels)), reverse=True)
        assert whole[k].largest == sizes[:5] and whole[k].n_components == len(sizes) and whole[k].largest_share == sizes[0] / len(labels)


def test_a_task_holds_one_tile(spark):
    """One component that winds through 3 x 3 tiles: each grouped task gets the cells of one tile."""
    cells = table(spark, {"snake": snake()})
    labelled = tiles.tile_labels(cells, 3)
    parts = labelled.groupBy(F.floor(F.col("row") / 3), F.floor(F.col("col") / 3)).agg(F.count("*").alias("n"), F.count_distinct("node").alias("labels")).collect()
    assert len(parts) == 9 and all(p.n <= 9 for p in parts) and sum(p.labels for p in parts) > 9
    assert continuity.components(cells, 3).select("component").distinct().count() == 1
    links = tiles.border_links(labelled, 3)
    assert links.count() >= 8 and tiles.least_nodes(links).select("root").distinct().count() == 1


def test_no_cells(spark):
    none = table(spark, {"a": [(0, 0)]}).limit(0)
    assert continuity.components(none).count() == 0 and tiles.enclosed(none).count() == 0 and continuity.continuity(none).count() == 0


def test_labels_of_extreme_cells():
    rows, cols = np.array([-(1 << 31), 0, (1 << 31) - 1]), np.array([-(1 << 31), 0, (1 << 31) - 1])
    n = tiles._number(rows, cols)
    assert n[0] < n[1] < n[2] and tiles._number(np.array([5]), np.array([9]))[0] > tiles._number(np.array([5]), np.array([-9]))[0]


def test_small_rasters_are_labelled_together(spark, rasters, monkeypatch):
    """No task or tile of its own for a small raster, and no links between tiles; batches may end anywhere in a tile."""
    many = {f"{k}-{i}": v for k, v in rasters.items() for i in range(3)}
    cells = table(spark, many)
    links, write = [], tiles.write_shared

    def seen(df, name):
        out = write(df, name)
        links.extend([out.count()] if name == "links" else [])
        return out

    monkeypatch.setattr(tiles, "write_shared", seen)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            labelled = tiles.tile_labels(cells)
            assert "FlatMapGroups" not in labelled._jdf.queryExecution().executedPlan().toString()
            got = {}
            for r in labelled.collect():
                got.setdefault(r.raster_id, {}).setdefault((r.row < 0, r.col < 0, r.node), set()).add((r.row, r.col))
            for k, v in many.items():
                quarters = [{c for c in v if (c[0] < 0, c[1] < 0) == q} for q in ((a, b) for a in (False, True) for b in (False, True))]
                want = sorted(sorted(c for c in plain if plain[c] == n) for plain in map(plain_components, quarters) for n in set(plain.values()))
                assert sorted(map(sorted, got[k].values())) == want
            assert {r.raster_id: r.hole_cells for r in tiles.enclosed(cells).collect()} == {k: plain_holes(v) for k, v in many.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert links and not any(links)
