"""Per-pixel quality control: one mask from independent tests, applied to four variables, and its statistics."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.config import UINT8_FILL, QualityConfig

MASKED = ("wse", "wse_uncert", "water_area", "water_frac")
ABSURD = 1e10


def quality_tests(columns: list[str], cfg: QualityConfig = QualityConfig()) -> dict[str, Column]:
    """The tests that apply to a table with these columns. A test of a NULL fails; a missing variable is not tested."""
    c = {x: F.col(x) for x in columns}
    tests: dict[str, Column] = {}
    for name, most in (("wse_qual", cfg.wse_qual_max), ("water_area_qual", cfg.water_area_qual_max)):
        if name in c:
            tests[name] = (c[name] <= most) & (c[name] < UINT8_FILL)
    if "cross_track" in c:
        # The upper bound is what fails NaN, which Spark orders above all numbers.
        tests["cross_track"] = (F.abs("cross_track") >= cfg.cross_track_min) & (F.abs("cross_track") < ABSURD)
    if "water_frac" in c and cfg.water_frac_min > 0:
        tests["water_frac"] = c["water_frac"].between(cfg.water_frac_min, 1.0)
    if not cfg.skip_ice_filter:
        tests |= {name: c[name].isin(*cfg.ice_valid) for name in ("ice_clim_flag", "ice_dyn_flag") if name in c}
    if "wse_uncert" in c and cfg.wse_uncert_max > 0:
        tests["wse_uncert"] = (c["wse_uncert"] <= cfg.wse_uncert_max) & (c["wse_uncert"] < ABSURD)
    return {k: F.coalesce(v, F.lit(False)) for k, v in tests.items()}


def quality_mask(columns: list[str], cfg: QualityConfig = QualityConfig()) -> Column:
    return functools.reduce(operator.and_, quality_tests(columns, cfg).values(), F.lit(True))


def apply_quality(df: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """Adds quality_mask and keeps the masked variables only where it holds; flags stay."""
    df = df.withColumn("quality_mask", quality_mask(df.columns, cfg))
    return df.withColumns({v: F.when(F.col("quality_mask"), F.col(v)) for v in MASKED if v in df.columns})


def quality_stats(df: DataFrame, keys: list[str], cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """Counts for each key, in one pass over raw rows: the counts of single tests are independent, not cumulative.

    final counts the mask whether wse is there or not, so the retention can exceed 100 percent.
    """
    tests = quality_tests(df.columns, cfg)
    mask = quality_mask(df.columns, cfg)
    counted = {f"after_{k}": F.count_if(tests[k]) for k in ("wse_qual", "water_area_qual", "cross_track") if k in tests}
    return df.groupBy(*keys).agg(
        F.count("wse").alias("initial"), *[v.alias(k) for k, v in counted.items()],
        F.lit(0).cast("bigint").alias("after_water_frac"), F.lit(0).cast("bigint").alias("after_ice_filter"),
        F.count_if(mask).alias("final"), F.avg(F.when(mask, F.col("wse"))).alias("final_wse_mean"),
    ).withColumn("retention", F.col("final") * 100.0 / F.greatest(F.col("initial"), F.lit(1)))


def summary_text(stats: dict) -> str:
    """A readable account of one row of quality_stats; the steps subtract the independent counts one after the other."""
    before = stats["initial"]
    lines = [f"initial pixels: {before}"]
    for name in ("wse_qual", "water_area_qual", "cross_track"):
        now = stats.get(f"after_{name}")
        if now is not None:
            lines.append(f"after {name}: {now} (removed {before - now})")
            before = now
    return "\n".join([*lines, f"final pixels: {stats['final']} ({stats['retention']:.1f}%)"])


def scene_stats(df: DataFrame, keys: list[str], cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """Mean, population deviation and count of wse before and after quality control, for each scene."""
    mask = quality_mask(df.columns, cfg)
    after = F.when(mask, F.col("wse"))
    return df.groupBy(*keys).agg(
        F.avg("wse").alias("pre_mean"), F.stddev_pop("wse").alias("pre_std"), F.count("wse").alias("pre_count"), F.avg(after).alias("post_mean"), F.count(after).alias("post_count")
    ).withColumn("retention", F.col("post_count") * 100.0 / F.greatest(F.col("pre_count"), F.lit(1)))
