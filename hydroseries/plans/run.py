"""The pipeline by stages, and its command line: merge, clip, filter, curve, or all."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries.config import TARGET_SRID, Config
from hydroseries.functions.missing import fill_to_null
from hydroseries.functions.naming import is_malformed, parse_filename
from hydroseries.operators.clip import clip_to_lakes, enough_pixels, granules_in_area, with_lake_ids
from hydroseries.operators.curve import area_level_curves, plot_series
from hydroseries.operators.mosaic import grid_offsets, mosaic, place_pixels
from hydroseries.operators.outline import outlines
from hydroseries.operators.quality import apply_quality, quality_stats
from hydroseries.operators.reproject import in_target, lakes_in_target, reproject_nearest, split_unprojected, with_srid
from hydroseries.operators.timeseries import DAY, day_series, merge_same_day
from hydroseries.operators.wse_filter import mad_filter, mad_keep, mean_retention, with_summary
from hydroseries.sources.netcdf import read_granule_table
from hydroseries.sources.raster import write_rasters
from hydroseries.sources.readers import lakes_to_read, read_lakes, read_netcdf, read_series
from hydroseries.sources.shapefile import write_shapefiles
from hydroseries.sources.writers import MERGED_BANDS, typed_lake_id, write_csv, write_curves, write_outlines, write_pixels, write_statistics

STAGES = ("all", "merge", "clip", "filter", "curve")


def split_malformed(granules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good granules, and errors for those whose names tell no group or time."""
    named = parse_filename(granules)
    return named.where(~is_malformed()), named.where(is_malformed()).select("path", F.lit("malformed file name").alias("error"))


def merge(pixels: DataFrame, granules: DataFrame, lakes: DataFrame, cfg: Config = Config(), max_groups: int | None = None, target_srid: int = TARGET_SRID) -> DataFrame:
    """Raw pixels and granules to merged cells in the target zone: group_id, obs_date, cell_row, cell_col, x, y, wse, wse_uncert, water_frac.

    granules are in UTM zones (see with_srid and split_unprojected), lakes in the target zone. Granules of other zones are reprojected before
    quality control, so all that is merged shares one grid.
    """
    there = in_target(granules, target_srid)
    near = granules_in_area(there, lakes)
    if max_groups is not None:
        near = near.join(near.select("group_id").distinct().orderBy("group_id").limit(max_groups), "group_id", "left_semi")
    moved = reproject_nearest(fill_to_null(pixels), granules.join(near.select("granule_id"), "granule_id", "left_semi"), target_srid)
    placed = place_pixels(apply_quality(moved, cfg.quality), grid_offsets(near))
    cells = mosaic(placed, others=["water_frac"])
    grids = grid_offsets(near).groupBy("group_id").agg(F.min("obs_date").alias("obs_date"), F.min("grid_minx").alias("gx"), F.max("grid_maxy").alias("gy"), F.first("grid_res_x").alias("rx"), F.first("grid_res_y").alias("ry"))
    return cells.join(grids, "group_id").withColumns({"x": F.col("gx") + (F.col("cell_col") + 0.5) * F.col("rx"), "y": F.col("gy") - (F.col("cell_row") + 0.5) * F.col("ry")}).drop("gx", "gy", "rx", "ry")


def clip(merged: DataFrame, lakes: DataFrame, cfg: Config = Config(), res: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """Merged cells to same-day lake pixels and the lake series."""
    held = enough_pixels(clip_to_lakes(merged, lakes), ["lake_id", "group_id"], cfg.quality.min_valid_pixels)
    # One grid for all passes: a cell is where its centre falls.
    snapped = held.withColumns({"cell_row": F.floor(F.col("y") / res).cast("int"), "cell_col": F.floor(F.col("x") / res).cast("int")})
    day = merge_same_day(snapped)
    return day, day_series(day, res, res)


def day_outlines(day: DataFrame, figures: DataFrame, res: float = 100.0) -> DataFrame:
    """rings of the valid cells of each lake and date, beside the figures (lake_id, date and more) of that day."""
    key = F.concat_ws("|", "lake_id", F.col("obs_date").cast("string"))
    # Cell rows count northward from the origin of the projection, and outlines southward from their top.
    cells = day.where(F.col("wse").isNotNull()).select(key.alias("lake_day"), (-F.col("cell_row") - 1).alias("row"), F.col("cell_col").alias("col"))
    shapes = outlines(cells, "lake_day", 0.0, 0.0, res)
    return figures.withColumn("lake_day", F.concat_ws("|", "lake_id", F.col("date").cast("string"))).join(shapes, "lake_day").drop("lake_day")


def merged_rasters(merged: DataFrame, srid: int, res: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """Cells and grids of merged groups, for write_rasters; a raster is a group and a day."""
    key = F.concat_ws("_", "group_id", F.coalesce(F.col("obs_date").cast("string"), F.lit("unknown")))
    cells = merged.select(key.alias("raster_id"), F.col("cell_row").alias("row"), F.col("cell_col").alias("col"), "x", "y", "wse", "water_frac", "wse_uncert", "group_id", "obs_date")
    ends = cells.groupBy("raster_id").agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"), F.min(F.col("x") - (F.col("col") + 0.5) * res).alias("minx"), F.max(F.col("y") + (F.col("row") + 0.5) * res).alias("maxy"), F.any_value("group_id").alias("group_id"), F.any_value("obs_date").alias("obs_date"))
    return cells, _grids(ends, srid, res, "group_id")


def lake_rasters(day: DataFrame, srid: int, res: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """Cells and grids of same-day lake pixels, for write_rasters; a raster is a lake and a day. Cell rows count northward there."""
    ends = day.groupBy("lake_id", "obs_date").agg(*[f(c).alias(n) for c, n, f in (("cell_row", "low", F.min), ("cell_row", "top", F.max), ("cell_col", "left", F.min), ("cell_col", "right", F.max))], F.any_value("sources").alias("sources"))
    ends = ends.withColumn("raster_id", F.concat_ws("_", "lake_id", F.col("obs_date").cast("string")))
    cells = day.join(ends.select("lake_id", "obs_date", "raster_id", "top", "left"), ["lake_id", "obs_date"]).select("raster_id", (F.col("top") - F.col("cell_row")).alias("row"), (F.col("cell_col") - F.col("left")).alias("col"), "wse", "water_frac", "wse_uncert")
    sized = ends.select("raster_id", "lake_id", "obs_date", "sources", (F.col("right") - F.col("left") + 1).alias("width"), (F.col("top") - F.col("low") + 1).alias("height"), (F.col("left") * res).alias("minx"), ((F.col("top") + 1) * res).alias("maxy"))
    return cells, _grids(sized, srid, res, "lake_id", "sources")


def _grids(sized: DataFrame, srid: int, res: float, *told: str) -> DataFrame:
    attributes = F.create_map(F.lit("date"), F.coalesce(F.col("obs_date").cast("string"), F.lit("unknown")), *[x for c in told for x in (F.lit(c), F.col(c).cast("string"))])
    return sized.select("raster_id", "width", "height", "minx", "maxy", F.lit(res).alias("res_x"), F.lit(res).alias("res_y"), F.lit(srid).alias("srid"), attributes.alias("attributes"))


def write_files(spark: SparkSession, output: str, stages: tuple[str, ...], srid: int) -> None:
    """What the stages have written as tables, as GeoTIFF files and shapefiles too: rasters/merged, rasters/lakes, rasters/filtered, shapes/lakes and shapes/filtered."""
    bands = list(MERGED_BANDS)
    if "merge" in stages:
        write_rasters(*merged_rasters(spark.read.parquet(f"{output}/merged"), srid), f"{output}/rasters/merged", bands)
    for stage, pixels, figures, name in (("clip", "lake_pixels", "lake_timeseries", "lakes"), ("filter", "lake_pixels_filtered", "lake_timeseries_filtered", "filtered")):
        if stage not in stages:
            continue
        day = spark.read.parquet(f"{output}/{pixels}")
        write_rasters(*lake_rasters(day, srid), f"{output}/rasters/{name}", bands)
        told = spark.read.option("header", True).option("inferSchema", True).csv(f"{output}/summary/{figures}.csv").withColumn("lake_id", F.col("lake_id").cast("string"))
        shapes = day_outlines(day, told)
        write_shapefiles(shapes.where(F.size("rings") > 0), f"{output}/shapes/{name}", [c for c in told.columns], crs=f"EPSG:{srid}")


def run(spark: SparkSession, stage: str, prior: str, raster: str, output: str, cfg: Config = Config(), max_groups: int | None = None, lake_ids: list[str] | None = None, max_lakes: int | None = None, target_srid: int = TARGET_SRID, files: bool = False, netcdf: bool = False) -> None:
    """Reads tables (or, with netcdf, raw NetCDF granules under raster), writes tables, series and outlines; with files, also rasters and shapefiles, to an output that is a local path for driver and executors alike. raster holds pixels/ and granules/; prior is a lake table, GeoJSON or shapefiles.

    Granules whose name or projection is not told go to errors/, and are not merged. statistics/ has a row for each stage and figure.
    """
    if stage not in STAGES:
        raise ValueError(f"no stage {stage}")
    lakes = lakes_in_target(with_lake_ids(read_lakes(spark, prior)), target_srid)
    if lake_ids is not None or max_lakes is not None:
        lakes = lakes.join(lakes_to_read(lakes, lake_ids, max_lakes), "lake_id", "left_semi")
    figures = []

    def tell(step: str, **counts: DataFrame) -> None:
        figures.extend([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("stage"), F.lit(name).alias("figure"), F.col("n").cast("double").alias("value")) for name, df in counts.items()])

    if stage in ("all", "merge"):
        raw = read_granule_table(spark, raster).drop("dims", "attributes") if netcdf else spark.read.parquet(f"{raster}/granules")
        raw = raw.drop("granule_id", "group_id", "obs_date")
        named, unnamed = split_malformed(raw)
        good, unprojected = split_unprojected(with_srid(named))
        pixels = read_netcdf(spark, raster) if netcdf else spark.read.parquet(f"{raster}/pixels")
        write_pixels(merge(pixels, good, lakes, cfg, max_groups, target_srid), f"{output}/merged")
        unnamed.unionByName(unprojected).write.json(f"{output}/errors")
        quality_stats(fill_to_null(pixels), ["granule_id"], cfg.quality).write.parquet(f"{output}/quality")
        tell("merge", granules=raw, malformed=unnamed, unprojected=unprojected, merged_groups=spark.read.parquet(f"{output}/merged").select("group_id").distinct())
    if stage in ("all", "clip"):
        day, series = clip(spark.read.parquet(f"{output}/merged"), lakes, cfg)
        write_pixels(day, f"{output}/lake_pixels")
        write_csv(typed_lake_id(series), f"{output}/summary/lake_timeseries.csv")
        written = read_series(spark, f"{output}/summary/lake_timeseries.csv")
        write_statistics(written, f"{output}/summary/statistics.json")
        write_outlines(day_outlines(spark.read.parquet(f"{output}/lake_pixels"), written), f"{output}/outlines", written.columns)
        tell("clip", lakes=lakes.select("lake_id").distinct(), lakes_with_series=written.select("lake_id").distinct(), observations=written)
    if stage in ("all", "filter"):
        pixels = spark.read.parquet(f"{output}/lake_pixels")
        filtered = with_summary(mad_filter(pixels, cfg=cfg.filter), read_series(spark, f"{output}/summary/lake_timeseries.csv"))
        write_csv(typed_lake_id(filtered), f"{output}/summary/lake_timeseries_filtered.csv")
        kept = mad_keep(pixels, cfg=cfg.filter)
        kept = kept.join(filtered.select("lake_id", F.col("date").alias("obs_date")), DAY, "left_semi")
        write_pixels(kept, f"{output}/lake_pixels_filtered")
        write_outlines(day_outlines(spark.read.parquet(f"{output}/lake_pixels_filtered"), filtered), f"{output}/outlines_filtered", filtered.columns)
        tell("filter", filtered=filtered)
        figures.append(mean_retention(filtered).select(F.lit("filter").alias("stage"), F.lit("mean_retention").alias("figure"), F.col("mean_retention").alias("value")))
    if stage in ("all", "curve"):
        series = read_series(spark, f"{output}/summary/lake_timeseries.csv")
        curves = area_level_curves(series, cfg.curve)
        write_curves(curves, f"{output}/curves")
        plot_series(series, spark.read.schema(curves.schema).json(f"{output}/curves/area_wse_curves.json"), cfg.curve).write.parquet(f"{output}/curves/plots")
        tell("curve", lakes=curves)
    if files:
        write_files(spark, output, STAGES[1:] if stage == "all" else (stage,), target_srid)
    whole = figures[0]
    for more in figures[1:]:
        whole = whole.unionByName(more)
    whole.coalesce(1).write.mode("append").parquet(f"{output}/statistics")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Lake levels and areas from water-surface rasters")
    p.add_argument("--prior", "-p", required=True, help="lakes: Parquet, .geojson, .shp or a folder of shapefiles")
    p.add_argument("--raster", "-r", default="data/raw")
    p.add_argument("--output", "-o", default="output")
    p.add_argument("--max-files", "-m", type=int, help="time groups, in order of their ids")
    p.add_argument("--lakes", nargs="*", help="ids of the lakes to take")
    p.add_argument("--max-lakes", type=int, help="lakes, in order of their ids")
    p.add_argument("--target-srid", type=int, default=TARGET_SRID)
    p.add_argument("--test", "-t", action="store_true", help="three time groups and five lakes only")
    p.add_argument("--stage", "-s", choices=STAGES, default="all")
    p.add_argument("--netcdf", action="store_true", help="the raster folder holds raw NetCDF granules")
    p.add_argument("--files", action="store_true", help="write GeoTIFF rasters and shapefiles too")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("hydroseries").getOrCreate()
    run(spark, a.stage, a.prior, a.raster, a.output, max_groups=3 if a.test else a.max_files, lake_ids=a.lakes, max_lakes=5 if a.test else a.max_lakes, target_srid=a.target_srid, files=a.files, netcdf=a.netcdf)


if __name__ == "__main__":
    main()
