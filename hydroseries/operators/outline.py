"""Outlines of pixel masks: the cell sides that belong to one cell only, chained into rings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def outline_edges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys and r0, c0, r1, c1: the corners of each boundary side, the cell on its right. Inner sides occur twice and cancel."""
    r, c = F.col("row"), F.col("col")
    sides = [(r, c, r, c + 1), (r, c + 1, r + 1, c + 1), (r + 1, c + 1, r + 1, c), (r + 1, c, r, c)]
    ends = F.array(*[F.struct(*[v.cast("int").alias(n) for v, n in zip(s, ("r0", "c0", "r1", "c1"), strict=True)]) for s in sides])
    each = cells.select(*keys, "row", "col").distinct().select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*")
    undirected = [F.least("r0", "r1").alias("_ra"), F.least("c0", "c1").alias("_ca"), F.greatest("r0", "r1").alias("_rb"), F.greatest("c0", "c1").alias("_cb")]
    once = each.groupBy(*keys, *undirected).agg(F.count(F.lit(1)).alias("_n"), *[F.min(x).alias(x) for x in ("r0", "c0", "r1", "c1")]).where("_n = 1")
    return once.select(*keys, "r0", "c0", "r1", "c1")


def chain(edges: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings of directed sides; where two meet in a corner, the way turns right, so that touching cells stay apart."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r0, c0, r1, c1 in sorted(edges):
        out.setdefault((r0, c0), []).append((r1, c1))
    rings = []
    while out:
        start = min(out)
        ring, at, came = [start], start, None
        while True:
            ways = out[at]
            if came is not None and len(ways) > 1:
                dr, dc = at[0] - came[0], at[1] - came[1]
                right = (at[0] + dc, at[1] - dr)
                follow = right if right in ways else ways[0]
            else:
                follow = ways[0]
            ways.remove(follow)
            if not ways:
                del out[at]
            came, at = at, follow
            ring.append(at)
            if at == start:
                break
        # Corners on a straight line go.
        body = ring[:-1]
        keep = [p for k, p in enumerate(body) if (body[k - 1][0] - p[0]) * (p[1] - body[(k + 1) % len(body)][1]) != (body[k - 1][1] - p[1]) * (p[0] - body[(k + 1) % len(body)][0])]
        rings.append([*keep, keep[0]])
    return rings


def outlines(cells: DataFrame, key: str, minx: float = 0.0, maxy: float = 0.0, res: float = 100.0) -> DataFrame:
    """key and rings: outlines clockwise on the map, holes the other way. Only boundary sides come to the task, not pixels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = chain(list(pdf[["r0", "c0", "r1", "c1"]].itertuples(index=False, name=None)))
        shaped = [[{"x": minx + c * res, "y": maxy - r * res} for r, c in ring] for ring in rings]
        return pd.DataFrame({key: [pdf[key].iat[0]], "rings": [shaped]})

    return outline_edges(cells.withColumn(key, F.col(key).cast("string")), [key]).groupBy(key).applyInPandas(run, f"{key} string, rings {RINGS}")


def rings_to_wkt(rings):
    """MULTIPOLYGON text with a part for each ring."""
    ring = lambda points: F.concat(F.lit("(("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit("))"))
    return F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))
