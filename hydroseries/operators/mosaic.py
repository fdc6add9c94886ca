"""Mosaics of overlapping granules: whole-granule alignment, plain means, and inverse-variance means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def grid_offsets(granules: DataFrame, group: str = "group_id") -> DataFrame:
    """Adds each granule's offset in its group's grid and the grid's size. Granules are snapped as a whole, half to even, never pixel by pixel.

    The resolution is that of the group's first granule. This touches one row a granule.
    """
    w = W.partitionBy(group)
    first = w.orderBy("granule_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = granules.withColumns({
        "grid_minx": F.min("minx").over(w), "grid_maxy": F.max("maxy").over(w), "grid_maxx": F.max("maxx").over(w), "grid_miny": F.min("miny").over(w),
        "grid_res_x": F.first(F.coalesce("res_x", F.lit(100.0))).over(first), "grid_res_y": F.first(F.coalesce("res_y", F.lit(100.0))).over(first),
    })
    return out.withColumns({
        "col_off": F.rint((F.col("minx") - F.col("grid_minx")) / F.col("grid_res_x")).cast("int"),
        "row_off": F.rint((F.col("grid_maxy") - F.col("maxy")) / F.col("grid_res_y")).cast("int"),
        "width": F.ceil((F.col("grid_maxx") - F.col("grid_minx")) / F.col("grid_res_x")).cast("int"),
        "height": F.ceil((F.col("grid_maxy") - F.col("grid_miny")) / F.col("grid_res_y")).cast("int"),
    })


def place_pixels(pixels: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds cell_row and cell_col; cells outside the grid are cut. offsets has one row a granule, with row 0 in the north."""
    placed = pixels.join(offsets.select("granule_id", "group_id", "row_off", "col_off", "width", "height"), "granule_id")
    placed = placed.withColumns({"cell_row": F.col("row") + F.col("row_off"), "cell_col": F.col("col") + F.col("col_off")})
    return placed.where((F.col("cell_row") >= 0) & (F.col("cell_row") < F.col("height")) & (F.col("cell_col") >= 0) & (F.col("cell_col") < F.col("width"))).drop("row_off", "col_off", "width", "height")


def weight(wse: str = "wse", uncert: str = "wse_uncert") -> Column:
    """1 / sigma^2 where wse and a positive sigma are there."""
    return F.when(F.col(wse).isNotNull() & (F.col(uncert) > 0), 1.0 / (F.col(uncert) * F.col(uncert)))


def inverse_variance(wse: str = "wse", uncert: str = "wse_uncert") -> tuple[Column, Column]:
    """Aggregates: the weighted mean and its sigma; NULL where nothing has a weight. The sums are partial on each side of the shuffle."""
    w = weight(wse, uncert)
    return F.try_divide(F.sum(F.col(wse) * w), F.sum(w)), F.try_divide(F.lit(1.0), F.sqrt(F.sum(w)))


def mosaic_mean(pixels: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """The mean of each variable's values in a cell, flags included."""
    return pixels.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in variables])


def mosaic(pixels: DataFrame, group: str = "group_id", source: str = "granule_id", cell: tuple[str, str] = ("cell_row", "cell_col"), others: list[str] | None = None) -> DataFrame:
    """One row a cell: wse and wse_uncert by inverse variance, others by mean. A group with one source passes through as it is.

    Sources are counted in the same aggregate: a cell cannot tell its group's count, so that is a second, small table, joined by group.
    """
    wse, sigma = inverse_variance()
    others = others or []
    sources = pixels.groupBy(group).agg(F.count_distinct(source).alias("_sources"))
    cells = pixels.groupBy(group, *cell).agg(
        wse.alias("_wse"), sigma.alias("_sigma"), F.min_by("wse", source).alias("_wse1"), F.min_by("wse_uncert", source).alias("_sigma1"), *[F.avg(v).alias(v) for v in others]
    )
    alone = F.col("_sources") == 1
    return cells.join(sources, group).select(
        group, *cell, F.when(alone, F.col("_wse1")).otherwise(F.col("_wse")).alias("wse"), F.when(alone, F.col("_sigma1")).otherwise(F.col("_sigma")).alias("wse_uncert"), *others
    )


def merged_stats(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population deviation and count of valid wse; keys without any give no row."""
    return cells.groupBy(*keys).agg(F.avg("wse").alias("mean"), F.stddev_pop("wse").alias("std"), F.count("wse").alias("count")).where("count > 0")
