"""Command line: which projections the granules have, by name and by content, and whether each time group shares one."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries.functions.naming import parse_filename
from hydroseries.operators.audit import projection_document, projection_text, with_zones


def examine(granules: DataFrame, max_files: int | None = None, sample_groups: int | None = None) -> dict:
    """granules: path and CRS texts. max_files: only so many, in order of their paths; sample_groups: so many groups, in order of their ids."""
    if max_files is not None:
        granules = granules.orderBy("path").limit(max_files)
    zoned = with_zones(parse_filename(granules))
    document = projection_document(zoned)
    if sample_groups is not None:
        some = zoned.select("group_id").distinct().orderBy("group_id").limit(sample_groups)
        document["group_analysis"] = projection_document(zoned.join(some, "group_id", "left_semi"))["group_analysis"]
    return document


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Projections of granules")
    p.add_argument("--dir", "-d", required=True, help="a Parquet table of granules: path and crs_wkt")
    p.add_argument("--output", "-o", help="folder for the report as JSON")
    p.add_argument("--max-files", "-m", type=int)
    p.add_argument("--sample-groups", "-s", type=int)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("projection").getOrCreate()
    document = examine(spark.read.parquet(a.dir), a.max_files, a.sample_groups)
    print(projection_text(document))
    if a.output:
        spark.range(1).select(F.lit(json.dumps(document)).alias("value")).coalesce(1).write.text(a.output)


if __name__ == "__main__":
    main()
