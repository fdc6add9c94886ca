"""Spatial continuity: connected components of valid pixels, fill ratios, holes, and which raw files to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroseries.operators.tiles import TILE, connected, enclosed
from hydroseries.sources.shared import write_shared

VERSIONS = ("PIC0", "PIC2", "PID0", "PGC0")


def first_files(granules: DataFrame, passes: list[str], lon: float, lat: float, k: int = 3) -> DataFrame:
    """The first k files by name of each version that belong to one of the passes and whose box holds the point."""
    version = F.regexp_extract("filename", "(" + "|".join(VERSIONS) + ")", 1)
    held = F.lit(lon).between(F.col("lon_min"), F.col("lon_max")) & F.lit(lat).between(F.col("lat_min"), F.col("lat_max"))
    there = granules.withColumn("file_version", version).where((F.col("file_version") != "") & F.col("pass").isin(*passes) & held)
    order = W.partitionBy("file_version").orderBy("filename")
    return there.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def version_families(files: DataFrame) -> DataFrame:
    """C and D versions in one table; the PGC0 files are left out."""
    c = files.where(F.col("file_version").isin("PIC0", "PIC2")).withColumn("family", F.lit("C"))
    return c.unionByName(files.where(F.col("file_version") == "PID0").withColumn("family", F.lit("D")))


def components(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """raster_id, row, col, component: 1 for the first component in reading order, and so on. cells: the valid ones.

    A raster may be of any size: it is labelled by tiles (see tiles).
    """
    joined = connected(cells, tile)
    first = joined.select("raster_id", "root").distinct()
    numbers = first.withColumn("component", F.row_number().over(W.partitionBy("raster_id").orderBy("root")))
    return joined.join(numbers, ["raster_id", "root"]).select(F.col("raster_id").cast("string").alias("raster_id"), "row", "col", "component")


def component_sizes(labelled: DataFrame) -> DataFrame:
    """raster_id, component, size, rank: the largest first, ties by number."""
    sizes = labelled.groupBy("raster_id", "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("rank", F.row_number().over(W.partitionBy("raster_id").orderBy(F.desc("size"), "component")))


def fill_ratio(cells: DataFrame) -> DataFrame:
    """n_valid, the box of the valid cells and the share of it that is valid."""
    box = cells.groupBy("raster_id").agg(F.count(F.lit(1)).alias("n_valid"), (F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width"))
    return box.withColumn("fill_ratio", F.col("n_valid") / (F.col("height") * F.col("width")))


def continuity(cells: DataFrame, top: int = 5, tile: int = TILE) -> DataFrame:
    """n_components, the largest sizes, the largest one's share and holes (invalid cells that it encloses), of each raster."""
    labelled = write_shared(components(cells, tile), "components")
    sizes = component_sizes(labelled)
    best = sizes.groupBy("raster_id").agg(F.count(F.lit(1)).alias("n_components"), F.sum("size").alias("n_valid"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "size")))), lambda x: x["size"]).alias("largest"))
    main = labelled.join(sizes.where("rank = 1").select("raster_id", "component"), ["raster_id", "component"])
    return best.join(enclosed(main.select("raster_id", "row", "col"), tile), "raster_id").withColumn("largest_share", F.col("largest")[0] / F.col("n_valid"))
