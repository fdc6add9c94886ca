"""Readers: pixel, granule and lake tables, raw files, series, and shapefiles."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries.config import LONLAT_SRID
from hydroseries.functions.naming import epsg_of_zone, utm_zone_of_text
from hydroseries.sources.netcdf import read_granules

RINGS = "array<array<struct<x:double,y:double>>>"
TIMESERIES_SCHEMA = "lake_id string, date date, wse double, wse_med double, wse_std double, wse_uncert double, water_area double, valid_pixels bigint, granule_id string"
#: The pixel variables that are read if none are named, in the data product's own order.
DEFAULT_VARIABLES = (
    "x", "y", "longitude", "latitude", "wse", "wse_qual", "wse_qual_bitwise", "wse_uncert", "water_area", "water_area_qual", "water_frac", "cross_track", "illumination_time", "n_wse_pix", "ice_clim_flag", "ice_dyn_flag", "layover_impact",
)


def scan_files(spark: SparkSession, path: str, pattern: str = "*.nc", recursive: bool = True) -> DataFrame:
    """path, length and modificationTime of the files; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "length", "modificationTime")


def select_variables(df: DataFrame, variables=None, strict: bool = False) -> DataFrame:
    """The variables that are there among those asked for, with the keys; an error if none is (or, if strict, if one is missing)."""
    wanted = list(variables or DEFAULT_VARIABLES)
    there = [v for v in wanted if v in df.columns]
    if not there or (strict and len(there) < len(wanted)):
        raise ValueError(f"none of these variables is there: {', '.join(v for v in wanted if v not in df.columns)}")
    keys = [k for k in ("granule_id", "group_id", "obs_date", "row", "col") if k in df.columns and k not in there]
    return df.select(*keys, *there)


def read_pixels(spark: SparkSession, path: str, variables=None) -> DataFrame:
    """Pixels in Parquet; only the chosen variables are read."""
    return select_variables(spark.read.parquet(path), variables)


def read_netcdf(spark: SparkSession, path: str, variables=DEFAULT_VARIABLES) -> DataFrame:
    """Pixels of raw granules (see netcdf), with the asked variables only."""
    return read_granules(spark, path, list(variables))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMESERIES_SCHEMA).option("header", True).csv(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """A merged pixel table with date, the observation's day as text; where it is not known, date is 'unknown'."""
    return spark.read.parquet(path).withColumn("date", F.coalesce(F.col("obs_date").cast("string"), F.lit("unknown")))


def lakes_to_read(lakes: DataFrame, ids: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Distinct lake ids in text order, those allowed, the first `most`."""
    out = lakes.select(F.col("lake_id").cast("string").alias("lake_id")).distinct()
    if ids is not None:
        out = out.where(F.col("lake_id").isin(*ids))
    out = out.orderBy("lake_id")
    return out.limit(most) if most is not None else out


def read_lakes_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections: properties' lake id, rings, srid 4326 and box."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type:string, coordinates:string>>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.from_json(text, "array<array<array<double>>>")
    many = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    points = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    rings = F.transform(points, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).cast(RINGS)
    ident = F.coalesce(F.col("f.properties")["lake_id"], F.col("f.properties")["id_unified"])
    return with_box(raw.select(ident.alias("lake_id"), rings.alias("rings"))).withColumn("srid", F.lit(LONLAT_SRID))


def with_box(lakes: DataFrame) -> DataFrame:
    """Adds the box of the rings."""
    flat = F.flatten("rings")
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return lakes.withColumns({"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)})


def parse_shp(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """The rings of each record of a shapefile's polygons; other shapes give none."""
    out, at = [], 100
    while at + 12 <= len(data):
        length = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + length]
        kind = struct.unpack("<i", body[:4])[0]
        rings = []
        if kind in (5, 15, 25):
            n_parts, n_points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
            xy = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
            rings = [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
        out.append(rings)
        at += 8 + length
    return out


def parse_dbf(data: bytes) -> list[dict[str, str]]:
    """The records of a dBASE table as text."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while at < head - 1 and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    out = []
    for i in range(n):
        row, place, cells = data[head + i * size : head + (i + 1) * size], 1, {}
        for name, width in fields:
            cells[name] = row[place : place + width].decode("utf-8", "replace").strip()
            place += width
        out.append(cells)
    return out


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """source, attributes (map), rings, srid and box of each feature. A file and its table meet by name; each pair is parsed in one task."""
    load = lambda ext: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("path", r"\.[^.]*$", "").alias("source"), F.col("content").alias(ext))
    pairs = load("shp").join(load("dbf"), "source", "left").join(load("prj"), "source", "left")

    def run(batches):
        for pdf in batches:
            for source, shp, dbf, prj in zip(pdf["source"], pdf["shp"], pdf["dbf"], pdf["prj"], strict=True):
                shapes = parse_shp(shp)
                rows = parse_dbf(dbf) if dbf is not None else [{}] * len(shapes)
                yield pd.DataFrame({"source": source, "attributes": rows, "rings": [[[{"x": x, "y": y} for x, y in ring] for ring in rings] for rings in shapes], "crs_wkt": None if prj is None else prj.decode("utf-8", "replace")})

    parsed = pairs.mapInPandas(run, f"source string, attributes map<string,string>, rings {RINGS}, crs_wkt string")
    return with_box(parsed).withColumn("srid", srid_of_text(F.col("crs_wkt")))


def srid_of_text(crs: Column) -> Column:
    """The code of a CRS text: a UTM zone, lon/lat for a geographic one and for none at all, else NULL."""
    geographic = F.regexp_like(F.upper(crs), F.lit(r"^\s*GEOG")) | (F.regexp_extract(crs, r"^\s*EPSG:(\d+)\s*$", 1) == str(LONLAT_SRID))
    return F.when(crs.isNull() | geographic, LONLAT_SRID).otherwise(epsg_of_zone(utm_zone_of_text(crs)))


def read_lakes(spark: SparkSession, path: str) -> DataFrame:
    """Lakes with lake_id, rings, srid and box, by the path's ending: .geojson and .json, .shp or a folder of shapefiles (shp/), else Parquet."""
    if path.endswith((".geojson", ".json")):
        return read_lakes_geojson(spark, path)
    if path.endswith((".shp", "shp", "shp/")):
        shapes = read_shapefiles(spark, path.rsplit("/", 1)[0] if path.endswith(".shp") else path)
        if path.endswith(".shp"):
            shapes = shapes.where(F.endswith("source", F.lit(path.rsplit("/", 1)[-1].removesuffix(".shp"))))
        ident = F.coalesce(F.col("attributes")["lake_id"], F.col("attributes")["id_unified"])
        return shapes.select(ident.alias("lake_id"), "rings", "minx", "miny", "maxx", "maxy", "srid")
    return spark.read.parquet(path)


#: Names of the attributes in the vector product, by the column that takes them.
VECTOR_ATTRIBUTES = {"lake_id": "lake_id", "wse": "wse", "uncertainty": "wse_u", "area": "area_total", "quality_f": "quality_f", "ice_clim_f": "ice_clim_f"}


def vector_observations(shapes: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """lake_id, obs_date, pass, wse, uncertainty, area, quality_f, ice_clim_f from features of read_shapefiles (attributes, source).

    names: the attributes by column, where they differ from VECTOR_ATTRIBUTES. The day and the pass are told by the file's name: the first run of
    eight digits, and the first run of three between underscores. An id of no lake is NULL; attributes that are not there or no numbers are NULL.
    """
    told = VECTOR_ATTRIBUTES | (names or {})
    value = lambda c, kind: F.col("attributes")[told[c]].try_cast(kind).alias(c)
    name = F.substring_index("source", "/", -1)
    ident = F.trim(F.col("attributes")[told["lake_id"]])
    return shapes.select(
        F.when(~ident.isin("", "no_data", "None", "-999"), ident).alias("lake_id"), F.try_to_timestamp(F.regexp_extract(name, r"(\d{8})", 1), F.lit("yyyyMMdd")).cast("date").alias("obs_date"), F.nullif(F.regexp_extract(name, r"_(\d{3})_", 1), F.lit("")).alias("pass"),
        *[value(c, "double") for c in ("wse", "uncertainty", "area")], value("quality_f", "smallint"), value("ice_clim_f", "int"),
    )
