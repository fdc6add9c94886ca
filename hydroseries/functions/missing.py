"""Missing values: every encoding of "no data" becomes NULL once, where data is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroseries.config import FLOAT_FILL, NODATA, NODATA_BELOW, UINT8_FILL, UINT32_FILL

FLOAT_VARIABLES = ("wse", "wse_uncert", "water_area", "water_frac", "cross_track", "layover_impact")


def is_valid(name: str, dtype: T.DataType) -> Column:
    """Is the value of a column data and not fill? Decided by its type; integers that are neither uint8 nor uint32 are valid unless 0."""
    c = F.col(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        test = ~F.isnan(c) & (c < FLOAT_FILL * (1 - 1e-7))
    elif isinstance(dtype, (T.ShortType, T.ByteType)):
        test = c != UINT8_FILL
    elif isinstance(dtype, T.LongType):
        test = c != UINT32_FILL
    elif isinstance(dtype, T.IntegerType):
        test = c != 0
    else:
        test = F.lit(True)
    return F.coalesce(c.isNotNull() & test, F.lit(False))


def with_valid_mask(df: DataFrame, variable: str = "wse") -> DataFrame:
    if variable not in df.columns:
        raise ValueError(f"no variable {variable}")
    return df.withColumn("valid_mask", is_valid(variable, df.schema[variable].dataType))


def fill_to_null(df: DataFrame, variables=FLOAT_VARIABLES) -> DataFrame:
    """Float fill and NaN become NULL; integer variables stay as they are."""
    there = [v for v in variables if v in df.columns]
    return df.withColumns({v: F.when(is_valid(v, df.schema[v].dataType), F.col(v)) for v in there})


def nodata_to_null(c: Column) -> Column:
    """-9999 marks no data in stored rasters; nothing real is that low."""
    return F.when((c != NODATA) & (c >= NODATA_BELOW), c)
