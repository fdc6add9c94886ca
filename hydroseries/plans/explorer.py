"""Command line: files, variables and their values, as a Markdown report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hydroseries.operators.audit import full_profile, granule_metadata, profile_report
from hydroseries.sources.readers import scan_files, select_variables


def explore(spark: SparkSession, pixels: str, files: str | None = None, samples: int | None = None) -> str:
    """The report on a pixel table, and on a folder of raw files if it is named. samples: only so many granules, in order of their ids."""
    table = select_variables(spark.read.parquet(pixels))
    if samples is not None:
        table = table.join(table.select("granule_id").distinct().orderBy("granule_id").limit(samples), "granule_id", "left_semi")
    keys = ("granule_id", "group_id", "obs_date", "row", "col")
    profile = full_profile(table, [c for c in table.columns if c not in keys])
    extent = profile.first()
    lines = [profile_report(profile, "Pixel variables"), f"granules: {extent.n_granules}, rows: {extent.n_rows}, columns: {extent.n_cols}", ""]
    if files is not None:
        found = granule_metadata(scan_files(spark, files)).agg(F.count(F.lit(1)).alias("n"), F.sum("size_mb").alias("mb"), F.count_distinct("group_id").alias("groups"), F.min("obs_date").alias("first"), F.max("obs_date").alias("last")).first()
        lines += [f"files: {found.n}, {found.mb or 0.0:.1f} MB, groups: {found.groups}, from {found['first']} to {found['last']}", ""]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="What a pixel table holds")
    p.add_argument("--pixels", "-p", required=True)
    p.add_argument("--files", "-f", help="folder of raw files")
    p.add_argument("--samples", "-n", type=int)
    p.add_argument("--output", "-o", help="folder for the report")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("explorer").getOrCreate()
    report = explore(spark, a.pixels, a.files, a.samples)
    print(report)
    if a.output:
        spark.range(1).select(F.lit(report).alias("value")).coalesce(1).write.text(a.output)


if __name__ == "__main__":
    main()
