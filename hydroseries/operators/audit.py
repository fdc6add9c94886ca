"""Audits: variable profiles, granule metadata, projection zones, and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroseries.config import FLOAT_FILL, UINT8_FILL, UINT32_FILL
from hydroseries.functions.missing import is_valid
from hydroseries.functions.naming import epsg_of_zone, parse_filename, utm_zone_of_name, utm_zone_of_text


def variable_profile(df: DataFrame, variables: list[str]) -> DataFrame:
    """variable, valid_count, fill_count, min, max, mean, std (population): one pass over the table, then one row a variable.

    Variables that are not numbers have counts only.
    """
    aggs, rows = [], []
    for v in variables:
        dtype = df.schema[v].dataType
        ok = is_valid(v, dtype)
        number = isinstance(dtype, T.NumericType)
        x = F.when(ok, F.col(v).cast("double")) if number else F.lit(None).cast("double")
        aggs += [F.count_if(ok).alias(f"{v}_valid"), F.count_if(~ok).alias(f"{v}_fill"), F.min(x).alias(f"{v}_min"), F.max(x).alias(f"{v}_max"), F.avg(x).alias(f"{v}_mean"), F.stddev_pop(x).alias(f"{v}_std")]
        rows.append(F.struct(F.lit(v).alias("variable"), *[F.col(f"{v}_{k}").alias(n) for k, n in (("valid", "valid_count"), ("fill", "fill_count"), ("min", "min"), ("max", "max"), ("mean", "mean"), ("std", "std"))]))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def variable_attributes(df: DataFrame, variables: list[str]) -> DataFrame:
    """variable, dtype, fill (as text; NULL if its type has none) of each variable, from the schema alone."""
    fills = {T.FloatType: str(FLOAT_FILL), T.DoubleType: str(FLOAT_FILL), T.ShortType: str(UINT8_FILL), T.ByteType: str(UINT8_FILL), T.LongType: str(UINT32_FILL)}
    rows = [(v, df.schema[v].dataType.simpleString(), fills.get(type(df.schema[v].dataType))) for v in variables]
    return df.sparkSession.createDataFrame(rows, "variable string, dtype string, fill string")


def full_profile(df: DataFrame, variables: list[str], key: str = "granule_id") -> DataFrame:
    """variable_profile with dtype, fill, valid_ratio, and n_granules and the largest rows and columns of any granule."""
    profile = variable_profile(df, variables).join(F.broadcast(variable_attributes(df, variables)), "variable")
    shape = [F.max(c).alias(n) if c in df.columns else F.lit(None).cast("int").alias(n) for c, n in (("row", "_rows"), ("col", "_cols"))]
    extent = df.agg(*[(F.count_distinct(key) if key in df.columns else F.lit(None)).cast("bigint").alias("n_granules"), *shape])
    whole = F.col("valid_count") + F.col("fill_count")
    return profile.crossJoin(F.broadcast(extent)).withColumns({"valid_ratio": F.try_divide("valid_count", whole), "n_rows": F.col("_rows") + 1, "n_cols": F.col("_cols") + 1}).drop("_rows", "_cols")


def granule_metadata(files: DataFrame) -> DataFrame:
    """Files of a binaryFile source: name, size in MB, and what the name tells; their content is never read."""
    return parse_filename(files.select("path", F.substring_index("path", "/", -1).alias("filename"), (F.col("length") / 1048576).alias("size_mb"), "modificationTime"))


def with_zones(granules: DataFrame) -> DataFrame:
    """Adds name_zone and content_zone; the CRS text is the first that is there."""
    texts = [c for c in ("crs_wkt", "spatial_ref_wkt", "grid_mapping_wkt") if c in granules.columns]
    zone = utm_zone_of_text(F.coalesce(*texts))
    return granules.withColumns({"name_zone": utm_zone_of_name(F.col("granule_id")), "content_zone": zone, "content_srid": epsg_of_zone(zone), "crs_error": F.when(F.coalesce(*texts).isNull(), "no CRS text").when(zone.isNull(), "no UTM zone in the CRS text")})


def zone_histogram(granules: DataFrame, zone: str) -> DataFrame:
    return granules.groupBy(zone).count().orderBy(F.asc_nulls_first(zone))


def zone_mismatches(granules: DataFrame) -> DataFrame:
    """Granules with both zones, where they differ."""
    return granules.where(F.col("name_zone").isNotNull() & F.col("content_zone").isNotNull() & (F.col("name_zone") != F.col("content_zone")))


def crs_consistency(granules: DataFrame, most_files: int = 5) -> DataFrame:
    """For each group: its granules, known zones, whether there is at most one, and up to most_files names; single-granule groups are told apart."""
    return granules.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_granules"), F.count_distinct("content_zone").alias("n_zones"), F.array_sort(F.collect_set("content_zone")).alias("zones"),
        F.slice(F.array_sort(F.collect_list("granule_id")), 1, most_files).alias("files"),
    ).withColumns({"single": F.col("n_granules") == 1, "consistent": F.col("n_zones") <= 1})


def group_counts_by_date(granules: DataFrame) -> DataFrame:
    return granules.groupBy("obs_date").agg(F.count_distinct("group_id").alias("n_groups"), F.count(F.lit(1)).alias("n_granules"))


def run_stats(steps: DataFrame) -> DataFrame:
    """success, skipped and success_rate in percent, from rows with the boolean column ok."""
    return steps.agg(F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("skipped")).withColumn("success_rate", F.try_divide(F.col("success") * 100.0, F.col("success") + F.col("skipped")))


def profile_report(profile: DataFrame, title: str) -> str:
    """A Markdown table of a variable profile, one row a variable."""
    head = ["| variable | valid | fill | min | max | mean | std |", "| --- | ---: | ---: | ---: | ---: | ---: | ---: |"]
    show = lambda x: "" if x is None else f"{x:.6g}"
    return "\n".join([f"# {title}", "", *head, *[f"| {r.variable} | {r.valid_count} | {r.fill_count} | {show(r.min)} | {show(r.max)} | {show(r.mean)} | {show(r.std)} |" for r in profile.orderBy("variable").collect()], ""])


def projection_report(groups: DataFrame, most: int = 10) -> str:
    """A text on the consistency of groups with several granules, with up to `most` that are not consistent."""
    n = groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if("single").alias("single"), F.count_if(~F.col("single") & F.col("consistent")).alias("good"), F.count_if(~F.col("consistent")).alias("bad")).first()
    bad = groups.where(~F.col("consistent")).orderBy("group_id").limit(most).collect()
    return "\n".join([f"groups: {n['groups']}, single: {n['single']}, consistent: {n['good']}, inconsistent: {n['bad']}", *[f"  {r.group_id}: {', '.join(r.zones)}" for r in bad], ""])


def projection_document(granules: DataFrame, most: int = 10, details: int = 5) -> dict:
    """What projection_json holds, as a dictionary: zone histograms, mismatches, errors and the groups' consistency. granules: with zones.

    Only counts, and lists cut at most and details, come to the driver.
    """
    groups = crs_consistency(granules.where(F.col("content_zone").isNotNull()))
    count = lambda c: {str(r[c]): r["count"] for r in zone_histogram(granules, c).collect()}
    wrong, failed = zone_mismatches(granules), granules.where(F.col("crs_error").isNotNull())
    n = groups.agg(F.count(F.lit(1)).alias("total_groups"), F.count_if("single").alias("single_granule_groups"), F.count_if(~F.col("single") & F.col("consistent")).alias("consistent_groups"), F.count_if(~F.col("consistent")).alias("inconsistent_groups")).first().asDict()
    bad = groups.where(~F.col("consistent")).orderBy("group_id").limit(details).collect()
    return {
        "utm_analysis": {
            "total_files": granules.count(), "utm_zone_by_filename": count("name_zone"), "utm_zone_by_content": count("content_zone"), "mismatch_count": wrong.count(), "error_count": failed.count(),
            "mismatches": [r.asDict() for r in wrong.select("granule_id", "name_zone", "content_zone", "content_srid").orderBy("granule_id").limit(most).collect()],
            "errors": [r.asDict() for r in failed.select("granule_id", "crs_error").orderBy("granule_id").limit(most).collect()],
        },
        "group_analysis": n | {"inconsistent_details": [{"group_id": r.group_id, "zones": list(r.zones), "n_granules": r.n_granules, "files": list(r.files)} for r in bad]},
    }


def projection_text(document: dict) -> str:
    """A readable account of a projection_document."""
    zones, groups = document["utm_analysis"], document["group_analysis"]
    lines = ["# Projections", "", f"files: {zones['total_files']}", "", "## Zones by name"]
    lines += [f"  {k}: {n}" for k, n in zones["utm_zone_by_filename"].items()] + ["", "## Zones by content"] + [f"  {k}: {n}" for k, n in zones["utm_zone_by_content"].items()]
    lines += ["", f"## Names and contents that differ: {zones['mismatch_count']}"] + [f"  {m['granule_id']}: {m['name_zone']}, {m['content_zone']}" for m in zones["mismatches"]]
    lines += ["", f"## Files without a zone: {zones['error_count']}"] + [f"  {m['granule_id']}: {m['crs_error']}" for m in zones["errors"]]
    lines += ["", "## Groups", f"  all: {groups['total_groups']}, single: {groups['single_granule_groups']}, consistent: {groups['consistent_groups']}, inconsistent: {groups['inconsistent_groups']}"]
    lines += [f"  {g['group_id']} ({g['n_granules']}): {', '.join(g['zones'])}: {', '.join(g['files'])}" for g in groups["inconsistent_details"]]
    need = "granules must be reprojected before they are merged" if groups["inconsistent_groups"] else "no group needs reprojection"
    return "\n".join([*lines, "", need, ""])
