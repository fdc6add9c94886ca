"""The vector product: quality and ice filter, weighted means, assignment and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.operators.mosaic import inverse_variance

QUALITY_MAX = 2
ICE_VALID = (0, -999)


def usable(obs: DataFrame) -> DataFrame:
    return obs.where((F.col("quality_f") <= QUALITY_MAX) & F.col("ice_clim_f").isin(*ICE_VALID))


def weighted_mean(obs: DataFrame, keys: tuple[str, ...] = ("lake_id", "obs_date", "pass")) -> DataFrame:
    wse, sigma = inverse_variance("wse", "uncertainty")
    return obs.groupBy(*keys).agg(wse.alias("wse"), sigma.alias("uncertainty"), F.count(F.lit(1)).alias("n_features"), F.avg("area").alias("area"))


def split_assigned(obs: DataFrame) -> DataFrame:
    """How many observations carry a lake id."""
    return obs.groupBy(F.when(F.col("lake_id").isNull(), "unassigned").otherwise("assigned").alias("assignment")).agg(F.count(F.lit(1)).alias("n"))


def observations_per_lake(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("lake_id").isNotNull()).groupBy("lake_id").agg(F.count(F.lit(1)).alias("n_obs"), F.count_distinct("obs_date").alias("n_dates"))
