"""Median-absolute-deviation pixel filter over lake rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroseries.config import FilterConfig
from hydroseries.operators.selection import beside, percentiles
from hydroseries.operators.timeseries import DAY, MAD_SCALE
from hydroseries.sources.shared import write_shared


BOUNDS = ("wse_median", "wse_lower", "wse_upper", "scaled_mad", "valid_pixels_orig")


def mad_bounds(pixels: DataFrame, keys: list[str] = DAY, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """wse_median, wse_lower, wse_upper, scaled_mad and valid_pixels_orig of each key; a spread of zero gives bounds at the median.

    Both medians are selected (see selection), so a key may have any number of pixels.
    """
    v = F.col("wse").cast("double")
    middle = write_shared(percentiles(pixels, keys, v, {"wse_median": 0.5}, count="valid_pixels_orig"), "medians")
    off = beside(pixels.select(*keys, v.alias("_v")), middle, keys)
    both = beside(middle, percentiles(off, keys, F.abs(F.col("_v") - F.col("wse_median")), {"_mad": 0.5}), keys).withColumn("scaled_mad", MAD_SCALE * F.col("_mad"))
    half = F.when(F.col("scaled_mad") == 0, 0.0).otherwise(F.least((cfg.mad_k or FilterConfig.mad_k) * F.col("scaled_mad"), F.lit(cfg.max_half_range)))
    return both.withColumns({"wse_lower": F.col("wse_median") - half, "wse_upper": F.col("wse_median") + half}).select(*keys, *BOUNDS)


def mad_keep(pixels: DataFrame, keys: list[str] = DAY, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """Pixels with wse and water_frac only where wse is within bounds; keys with too few valid pixels go."""
    return _within(pixels, mad_bounds(pixels, keys, cfg), keys, cfg)


def _within(pixels: DataFrame, bounds: DataFrame, keys: list[str], cfg: FilterConfig) -> DataFrame:
    near = beside(pixels, bounds.where(F.col("valid_pixels_orig") >= cfg.min_pixels), keys)
    kept = F.col("wse").between(F.col("wse_lower"), F.col("wse_upper"))
    return near.withColumns({c: F.when(kept, F.col(c)) for c in ("water_frac", "wse") if c in pixels.columns})


def mad_filter(pixels: DataFrame, keys: list[str] = DAY, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """One row for each key that has enough pixels before and after: the median of what is kept, the bounds and the retention."""
    bounds = write_shared(mad_bounds(pixels, keys, cfg), "bounds")
    kept = _within(pixels, bounds, keys, cfg)
    middle = percentiles(kept.select(*keys, "wse"), keys, F.col("wse"), {"wse_filtered": 0.5}, count="valid_pixels_filtered").where(F.col("valid_pixels_filtered") >= cfg.min_pixels)
    both = beside(middle, bounds, keys).select(*keys, "wse_filtered", *BOUNDS[1:], "valid_pixels_filtered")
    return both.withColumn("filter_retention", F.bround(F.col("valid_pixels_filtered") * 100.0 / F.col("valid_pixels_orig"), 1))


def with_summary(filtered: DataFrame, series: DataFrame) -> DataFrame:
    """The series' columns first, for the first row of each lake and date; a filtered row without one keeps NULLs."""
    order = W.partitionBy("lake_id", "date").orderBy("granule_id", "wse")
    once = series.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r").withColumnRenamed("date", "obs_date")
    own = [c for c in filtered.columns if c not in DAY]
    joined = filtered.join(once.select(*DAY, *[c for c in once.columns if c not in (*own, *DAY)]), DAY, "left")
    return joined.select("lake_id", F.col("obs_date").alias("date"), *[c for c in once.columns if c not in (*own, *DAY)], *own)


def mean_retention(filtered: DataFrame) -> DataFrame:
    return filtered.agg(F.count(F.lit(1)).alias("n_filtered"), F.avg("filter_retention").alias("mean_retention"))
