"""Reprojection of granules (nearest neighbour, by inverse mapping) and of lakes (point by point)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.config import LONLAT_SRID
from hydroseries.functions.geo import from_utm, is_utm, to_utm, utm_forward, utm_inverse
from hydroseries.functions.naming import epsg_of_zone, utm_zone_of_text

CRS_TEXTS = ("crs_wkt", "spatial_ref_wkt", "grid_mapping_wkt")


def with_srid(granules: DataFrame) -> DataFrame:
    """Adds srid where it is not there: of the first CRS text that tells a UTM zone; NULL if none does."""
    told = [F.col("srid").cast("int")] if "srid" in granules.columns else []
    told += [epsg_of_zone(utm_zone_of_text(F.col(c))) for c in CRS_TEXTS if c in granules.columns]
    return granules.withColumn("srid", F.coalesce(*told) if told else F.lit(None).cast("int"))


def split_unprojected(granules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Granules in a UTM zone, and errors for those whose projection is not told or is another."""
    other = granules.where(~is_utm(F.col("srid")))
    return granules.where(is_utm(F.col("srid"))), other.select("path", F.concat(F.lit("no UTM projection: "), F.coalesce(F.col("srid").cast("string"), F.lit("unknown"))).alias("error"))


def in_target(granules: DataFrame, target_srid: int) -> DataFrame:
    """Granules with srid and box in the target zone; those in another zone get the box of their corners and edge middles there."""
    other = granules.where(F.col("srid") != target_srid)
    target = F.lit(target_srid)
    edges = [[F.col(a), (F.col(a) + F.col(b)) / 2, F.col(b)] for a, b in (("minx", "maxx"), ("miny", "maxy"))]
    ring = other.select("granule_id", "srid", F.explode(F.array(*[F.struct(x.alias("px"), y.alias("py")) for x in edges[0] for y in edges[1]])).alias("p")).select("granule_id", "srid", "p.px", "p.py")
    ring = to_utm(from_utm(ring, "px", "py", F.col("srid"), "_lon", "_lat"), "_lon", "_lat", target, "tx", "ty")
    frame = ring.groupBy("granule_id").agg(F.min("tx").alias("t_minx"), F.max("tx").alias("t_maxx"), F.min("ty").alias("t_miny"), F.max("ty").alias("t_maxy"))
    moved = granules.join(frame, "granule_id", "left")
    return moved.withColumns({c: F.coalesce(f"t_{c}", c) for c in ("minx", "miny", "maxx", "maxy")} | {"srid": target}).select(granules.columns)


def lakes_in_target(lakes: DataFrame, target_srid: int) -> DataFrame:
    """Lakes with rings and box in the target zone, from lon/lat or any UTM zone; a missing srid is lon/lat, another fails the job."""
    srid = F.coalesce(F.col("srid").cast("int"), F.lit(LONLAT_SRID)) if "srid" in lakes.columns else F.lit(LONLAT_SRID)
    target = F.lit(target_srid)

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    def moved(each):
        return F.transform("rings", lambda ring: F.transform(ring, each))

    from_lonlat = moved(lambda p: point(*utm_forward(p["x"], p["y"], target)))
    lonlat = moved(lambda p: point(*utm_inverse(p["x"], p["y"], srid)))
    unknown = F.raise_error(F.concat(F.lit("a lake has an unknown projection: "), srid.cast("string")))
    same = F.when(srid == target_srid, F.col("rings")).when(srid == LONLAT_SRID, from_lonlat).when(is_utm(srid), F.transform(lonlat, lambda ring: F.transform(ring, lambda p: point(*utm_forward(p["x"], p["y"], target))))).otherwise(unknown)
    flat = F.flatten("rings")
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return lakes.withColumn("rings", same).withColumns({"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys), "srid": target})


def reproject_nearest(pixels: DataFrame, granules: DataFrame, target_srid: int) -> DataFrame:
    """Pixels of UTM granules on a grid of the target zone: row, col, x, y and the source pixel's variables.

    Each target cell is mapped back to its source and takes the pixel it falls in, by an equi-join on (granule, row, col), so there
    are no gaps and no doubles. A granule already in the target zone passes unchanged. The target grid covers the granule's four
    corners and edge middles (see in_target) at the source's resolution; its origin is the north-west corner.
    """
    same = granules.where(F.col("srid") == target_srid)
    other = granules.where(F.col("srid") != target_srid)
    target = F.lit(target_srid)
    frame = in_target(other, target_srid).select("granule_id", *[F.col(c).alias(f"t_{c}") for c in ("minx", "miny", "maxx", "maxy")])
    grid = other.join(frame, "granule_id")
    rows = F.ceil((F.col("t_maxy") - F.col("t_miny")) / F.col("res_y")).cast("int")
    cols = F.ceil((F.col("t_maxx") - F.col("t_minx")) / F.col("res_x")).cast("int")
    cells = grid.withColumn("t_row", F.explode(F.sequence(F.lit(0), rows - 1))).withColumn("t_col", F.explode(F.sequence(F.lit(0), cols - 1)))
    cells = cells.withColumns({"t_x": F.col("t_minx") + (F.col("t_col") + 0.5) * F.col("res_x"), "t_y": F.col("t_maxy") - (F.col("t_row") + 0.5) * F.col("res_y")})
    cells = to_utm(from_utm(cells, "t_x", "t_y", target, "_lon", "_lat"), "_lon", "_lat", F.col("srid"), "_sx", "_sy")
    # The source cell is never NULL for Spark, else it would test the whole projection for NULL below the join.
    at = {"row": (F.col("maxy") - F.col("_sy")) / F.col("res_y"), "col": (F.col("_sx") - F.col("minx")) / F.col("res_x")}
    cells = cells.select("granule_id", *[F.coalesce(F.floor(c).cast("int"), F.lit(-1)).alias(n) for n, c in at.items()], "t_row", "t_col", "t_x", "t_y")
    variables = [c for c in pixels.columns if c not in ("granule_id", "row", "col", "x", "y", "longitude", "latitude")]
    # Pixels are many whatever Spark takes them for (it does not see that an explode makes rows): they are never sent to all.
    moved = cells.join(pixels.hint("merge"), ["granule_id", "row", "col"]).select("granule_id", F.col("t_row").alias("row"), F.col("t_col").alias("col"), F.col("t_x").alias("x"), F.col("t_y").alias("y"), *variables)
    # A pixel's centre, where the table does not have it.
    place = {"x": F.col("_minx") + (F.col("col") + 0.5) * F.col("_rx"), "y": F.col("_maxy") - (F.col("row") + 0.5) * F.col("_ry")}
    missing = {k: x for k, x in place.items() if k not in pixels.columns}
    frames = same.select("granule_id", F.col("minx").alias("_minx"), F.col("maxy").alias("_maxy"), F.col("res_x").alias("_rx"), F.col("res_y").alias("_ry"))
    kept = pixels.join(frames, "granule_id") if missing else pixels.join(frames.select("granule_id"), "granule_id", "left_semi")
    kept = kept.withColumns(missing).select("granule_id", "row", "col", "x", "y", *variables)
    both = from_utm(kept.unionByName(moved), "x", "y", target, "longitude", "latitude")
    return both.withColumns({"longitude": F.col("longitude").cast("float"), "latitude": F.col("latitude").cast("float")})
