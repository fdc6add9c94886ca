"""Granule names, groups, dates, and projection zones told by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of the fields in a file name that is split at underscores, as the data product names its files.
FIELDS = {"resolution": 4, "grid": 5, "overlap": 6, "cycle": 10, "pass": 11, "scene": 12, "start_time": 13, "end_time": 14, "crid": 15, "version": 16}


def _once(value: Column, use) -> Column:
    """use(value), with value computed once: expressions that name a parsed text several times would grow beyond what generated code may hold."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.nc$", "")


def parse_filename(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds the fields of a granule's name, NULL where the name is too short, its group and its time."""
    parts = F.split(stem(F.col(path)), "_")
    df = df.withColumns({"granule_id": stem(F.col(path)), "product": F.concat_ws("_", F.slice(parts, 1, 4))} | {name: F.get(parts, F.lit(i)) for name, i in FIELDS.items()})
    obs_ts = F.try_to_timestamp("start_time", F.lit("yyyyMMdd'T'HHmmss"))
    return df.withColumns({"group_id": group_id(), "obs_ts": obs_ts, "obs_date": obs_ts.cast("date")})


def group_id() -> Column:
    """cycle_pass_crid; a missing part reads None, and is_malformed tells such names apart."""
    return F.concat_ws("_", *[F.coalesce(F.col(c), F.lit("None")) for c in ("cycle", "pass", "crid")])


def is_malformed() -> Column:
    return F.col("cycle").isNull() | F.col("pass").isNull() | F.col("crid").isNull() | F.col("obs_ts").isNull()


def group_granules(granules: DataFrame) -> DataFrame:
    """group_id, its paths in order, how many, and the date of its earliest granule."""
    return granules.groupBy("group_id").agg(F.array_sort(F.collect_list("path")).alias("paths"), F.count(F.lit(1)).alias("n_granules"), F.min("obs_date").alias("obs_date"))


def utm_grid(grid: Column) -> tuple[Column, Column]:
    """Zone and band of a grid name such as UTM01C; NULL for other names."""
    return tuple(F.nullif(F.regexp_extract(grid, r"^UTM(..)(.)", i), F.lit("")) for i in (1, 2))


def epsg_of_grid(grid: Column) -> Column:
    """Always north, as the grid's bands are not hemispheres."""
    return F.concat(F.lit("EPSG:326"), utm_grid(grid)[0])


def utm_zone_of_text(crs: Column) -> Column:
    """46N from a CRS text: what follows its words "UTM zone", in any case and spacing, else the last part of its first EPSG code, if that is a UTM zone's."""
    words = F.split(F.regexp_replace(F.upper(crs), r"[^A-Z0-9]+", ""), "UTMZONE", 2)
    after = F.regexp_extract(F.get(words, F.lit(1)), "^([0-9]+)([NS])", 0)
    number = lambda a: F.try_to_number(F.nullif(F.rtrim(a, F.lit("NS")), F.lit("")), F.lit("99")).cast("int").cast("string")
    code = F.regexp_extract(F.get(F.split(F.upper(crs), "EPSG", 2), F.lit(1)), "^[^A-Z0-9]*([0-9]+)", 1)
    srid = F.try_to_number(F.nullif(code, F.lit("")), F.lit("9999999999")).cast("int")
    return F.coalesce(_once(after, lambda a: F.concat(number(a), F.right(a, F.lit(1)))), _once(srid, zone_of_epsg))


def zone_of_epsg(srid: Column) -> Column:
    """46N from 32646; NULL for other projections."""
    zone = srid % 100
    half = F.when(F.floor(srid / 100) == 326, "N").when(F.floor(srid / 100) == 327, "S")
    return F.when(zone.between(1, 60), F.concat(zone.cast("string"), half))


def epsg_of_zone(zone: Column) -> Column:
    """32646 from 46N; NULL for anything else."""
    def code(z: Column) -> Column:
        number = F.try_to_number(F.nullif(F.regexp_extract(z, "^([0-9]{1,2})[NS]$", 1), F.lit("")), F.lit("99")).cast("int")
        return _once(number, lambda n: F.when(n.between(1, 60), n + F.when(F.endswith(z, F.lit("S")), 32700).otherwise(32600)))

    return _once(zone, code)


def utm_epsg_of_bounds(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The EPSG code of the UTM zone at the centre of a lon/lat box; longitude 180 gives zone 61."""
    lon, lat = (minx + maxx) / 2, (miny + maxy) / 2
    return F.when(lat >= 0, 32600).otherwise(32700) + (((lon + 180) / 6).cast("int") + 1)


def utm_zone_of_name(granule: Column) -> Column:
    """The zone in a granule's name, without its UTM prefix."""
    return F.nullif(F.regexp_extract(F.get(F.split(granule, "_"), F.lit(5)), r"^UTM(.*)$", 1), F.lit(""))
