"""Streaming extension: same-day inverse-variance lake levels, given out once a day is past the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.config import QualityConfig
from hydroseries.operators.mosaic import inverse_variance
from hydroseries.operators.quality import apply_quality


def daily_levels(pixels: DataFrame, cfg: QualityConfig = QualityConfig(), ts: str = "obs_ts", late: str = "1 day") -> DataFrame:
    """lake_id, day, wse, wse_uncert and valid_pixels from a stream (or a table) of raw lake pixels. The state of a lake and day is a few sums."""
    wse, sigma = inverse_variance()
    day = F.window(ts, "1 day")
    clean = apply_quality(pixels, cfg).withWatermark(ts, late)
    sums = clean.groupBy("lake_id", day.alias("w")).agg(wse.alias("wse"), sigma.alias("wse_uncert"), F.count("wse").alias("valid_pixels"))
    return sums.select("lake_id", F.col("w.start").cast("date").alias("day"), "wse", "wse_uncert", "valid_pixels")
