"""Command line: how the valid pixels of chosen raw rasters hang together over a lake, by product version."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries.functions.missing import fill_to_null
from hydroseries.functions.naming import parse_filename
from hydroseries.operators.clip import window_clip
from hydroseries.operators.continuity import continuity, fill_ratio, first_files


def report(pixels: DataFrame, granules: DataFrame, passes: list[str], lon: float, lat: float, box, k: int = 3, res: float = 100.0) -> DataFrame:
    """raster_id, file_version and the figures of continuity and fill_ratio, of the first k files of each version that hold the point, cut to a box in their projection."""
    named = parse_filename(granules).withColumn("filename", F.substring_index("path", "/", -1))
    files = first_files(named, passes, lon, lat, k)
    held = window_clip(fill_to_null(pixels).join(files.select("granule_id"), "granule_id", "left_semi"), files, box, res)
    cells = held.where(F.col("wse").isNotNull()).select(F.col("granule_id").alias("raster_id"), "row", "col")
    return files.select(F.col("granule_id").alias("raster_id"), "file_version").join(continuity(cells), "raster_id").join(fill_ratio(cells).drop("n_valid"), "raster_id")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Continuity of valid pixels")
    p.add_argument("--raster", "-r", required=True, help="folder with pixels/ and granules/")
    p.add_argument("--passes", nargs="+", required=True)
    p.add_argument("--point", nargs=2, type=float, required=True, metavar=("LON", "LAT"))
    p.add_argument("--box", nargs=4, type=float, required=True, metavar=("MINX", "MINY", "MAXX", "MAXY"))
    p.add_argument("--files", "-k", type=int, default=3, help="files of each version")
    p.add_argument("--output", "-o", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("connectivity").getOrCreate()
    report(spark.read.parquet(f"{a.raster}/pixels"), spark.read.parquet(f"{a.raster}/granules"), a.passes, *a.point, a.box, a.files).write.json(a.output)


if __name__ == "__main__":
    main()
