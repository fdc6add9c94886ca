"""Writers: partitioned pixel tables, series as CSV and JSON, outlines as GeoJSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGED_BANDS = ("wse", "water_frac", "wse_uncert")


def write_pixels(cells: DataFrame, path: str, bands=MERGED_BANDS, partition: str = "obs_date") -> None:
    """Cells as float bands, one folder a date."""
    there = [b for b in bands if b in cells.columns]
    if not there:
        raise ValueError("no band to write")
    keys = [c for c in cells.columns if c not in bands]
    cells.select(*keys, *[F.col(b).cast("float").alias(b) for b in there]).write.partitionBy(partition).parquet(path)


def write_csv(df: DataFrame, path: str, files: int | None = 1) -> None:
    """CSV with a header: one file by default, as a series has one row a lake and day; files=None leaves Spark's own parts."""
    (df if files is None else df.coalesce(files)).write.option("header", True).csv(path)


def typed_lake_id(df: DataFrame) -> DataFrame:
    """lake_id as a number where all ids are whole numbers, else as it is."""
    numbers = df.agg(F.count_if(F.col("lake_id").isNotNull() & F.col("lake_id").try_cast("bigint").isNull()).alias("n")).first()["n"] == 0
    return df.withColumn("lake_id", F.col("lake_id").cast("bigint")) if numbers else df


def statistics_json(series: DataFrame) -> DataFrame:
    """One row of JSON a lake, with its records in order: nothing is gathered beyond a lake."""
    records = F.array_sort(F.collect_list(F.struct("date", *[c for c in series.columns if c not in ("lake_id", "date")])))
    per_lake = series.groupBy("lake_id").agg(F.count(F.lit(1)).alias("total_observations"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), records.alias("records"))
    return per_lake.select(F.to_json(F.struct("*")).alias("value"))


def global_statistics(series: DataFrame) -> DataFrame:
    """One row of JSON: observations, lakes, first and last date of the whole series."""
    whole = series.agg(F.count(F.lit(1)).alias("total_observations"), F.count_distinct("lake_id").alias("n_lakes"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg("wse").alias("mean_wse"), F.avg("water_area").alias("mean_water_area"))
    return whole.select(F.to_json(F.struct(F.lit("all").alias("scope"), "*")).alias("value"))


def write_statistics(series: DataFrame, path: str) -> None:
    """Lines of JSON: one record of the whole series, then one a lake."""
    global_statistics(series).unionByName(statistics_json(series)).write.text(path)


def write_curves(curves: DataFrame, path: str) -> None:
    write_csv(curves.drop("candidates"), f"{path}/area_wse_curves.csv")
    curves.write.json(f"{path}/area_wse_curves.json")


def outlines_geojson(outlines: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature a row."""
    points = F.transform("rings", lambda ring: F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), points.alias("coordinates"))
    return outlines.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_outlines(outlines: DataFrame, path: str, properties: list[str]) -> None:
    outlines_geojson(outlines.where(F.size("rings") > 0), properties).write.text(path)
