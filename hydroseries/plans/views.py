"""Pixel, granule, lake and series views over generic tables, by whole-number arithmetic, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries.config import FLOAT_FILL
from hydroseries.functions.missing import fill_to_null
from hydroseries.operators.quality import apply_quality


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with fill values, from events."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 20).cast("string").alias("lake_id"), F.col("ts").cast("date").alias("obs_date"), F.concat(F.lit("g"), e % 3).alias("group_id"),
        F.when(F.col("user_id") % 20 < 5, F.lit("s0")).otherwise(F.concat(F.lit("s"), e % 4)).alias("granule_id"),
        (e % 6).cast("int").alias("cell_row"), (F.floor(e / 6.0) % 6).cast("int").alias("cell_col"),
        F.when(e % 97 == 0, FLOAT_FILL).otherwise(F.col("value")).alias("wse"), F.when(e % 89 == 0, FLOAT_FILL).otherwise(0.05 + (e % 41) * 0.05).alias("wse_uncert"),
        (F.col("value") * 100.0).alias("water_area"), ((e % 101) / 100.0).alias("water_frac"), F.when(e % 53 == 0, 255).otherwise(e % 4).cast("short").alias("wse_qual"), (e % 5).cast("short").alias("water_area_qual"),
        ((e * 7919) % 120000 - 60000).cast("double").alias("cross_track"), F.when(e % 61 == 0, 4294967295).otherwise(e % 50).cast("long").alias("n_wse_pix"), "event_type",
    )


PX = """px AS (
  SELECT event_id, (user_id % 20)::VARCHAR AS lake_id, ts::DATE AS obs_date, 'g' || (event_id % 3) AS group_id, CASE WHEN user_id % 20 < 5 THEN 's0' ELSE 's' || (event_id % 4) END AS granule_id,
    (event_id % 6)::INT AS cell_row, (floor(event_id / 6.0::DOUBLE)::BIGINT % 6)::INT AS cell_col,
    CASE WHEN event_id % 97 = 0 THEN 9.96921e36::DOUBLE ELSE value END AS wse, CASE WHEN event_id % 89 = 0 THEN 9.96921e36::DOUBLE ELSE 0.05::DOUBLE + (event_id % 41) * 0.05::DOUBLE END AS wse_uncert,
    value * 100.0::DOUBLE AS water_area, (event_id % 101) / 100.0::DOUBLE AS water_frac, CASE WHEN event_id % 53 = 0 THEN 255 ELSE event_id % 4 END AS wse_qual, event_id % 5 AS water_area_qual,
    ((event_id * 7919) % 120000 - 60000)::DOUBLE AS cross_track, CASE WHEN event_id % 61 = 0 THEN 4294967295 ELSE event_id % 50 END AS n_wse_pix, event_type
  FROM events
), pc AS (
  SELECT * REPLACE (CASE WHEN wse < 9e36 THEN wse END AS wse, CASE WHEN wse_uncert < 9e36 THEN wse_uncert END AS wse_uncert) FROM px
), pm AS (
  SELECT *, wse_qual <= 2 AS t_wse, water_area_qual <= 2 AS t_area, abs(cross_track) >= 10000 AS t_cross, coalesce(wse_uncert <= 2.0::DOUBLE, false) AS t_sigma FROM pc
), pq AS (
  SELECT * REPLACE (CASE WHEN m THEN wse END AS wse, CASE WHEN m THEN wse_uncert END AS wse_uncert, CASE WHEN m THEN water_area END AS water_area, CASE WHEN m THEN water_frac END AS water_frac)
  FROM (SELECT *, t_wse AND t_area AND t_cross AND t_sigma AS m FROM pm)
)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_to_null(raw_pixels(spark, sf_dir))


def good_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality(pixels(spark, sf_dir))


def source_cells(df: DataFrame) -> DataFrame:
    """One row for each cell of a source, as a granule has."""
    return df.groupBy("lake_id", "obs_date", "group_id", "cell_row", "cell_col").agg(F.max("wse").alias("wse"), F.max("wse_uncert").alias("wse_uncert"), F.max("water_frac").alias("water_frac"))


CELLS = ", sc AS (SELECT lake_id, obs_date, group_id, cell_row, cell_col, max(wse) AS wse, max(wse_uncert) AS wse_uncert, max(water_frac) AS water_frac FROM pq GROUP BY ALL)"


def granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path: file names built from events; some are cut short, some have a bad time."""
    e = F.col("event_id")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    start = F.when(e % 77 == 0, "2025XX18T000000").otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss"))
    crid = F.element_at(F.array(*[F.lit(x) for x in ("PIC0", "PIC2", "PID0", "PGC0")]), (e % 4 + 1).cast("int"))
    head = F.concat(F.lit("/data/raw/SAT_L2_HR_Raster_100m_UTM"), pad(1 + e % 60, 2), F.when(e % 2 == 0, "N").otherwise("C"), F.lit("_N_x_x_x_"), pad(e % 40, 3))
    rest = F.concat(F.lit("_"), pad(F.floor(e / 40.0) % 30, 3), F.lit("_"), pad(e % 100, 3), F.lit("F_"), start, F.lit("_"), start, F.lit("_"), crid, F.lit("_01.nc"))
    crs = F.when(e % 5 == 0, F.lit(None)).when(e % 5 == 1, F.concat(F.lit("WGS 84 / UTM zone "), (1 + e % 60).cast("string"), F.lit("N"))).when(e % 5 == 2, F.concat(F.lit("EPSG:"), (32700 + 1 + e % 60).cast("string"))).when(e % 5 == 3, F.lit("EPSG:4326")).otherwise(F.concat(F.lit("EPSG: "), (32601 + e % 60).cast("string")))
    x = (e % 360).cast("double") - 180.0
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 50 == 0, head).otherwise(F.concat(head, rest)).alias("path"), crs.alias("crs_wkt"), x.alias("lon_min"), (x + 2.0).alias("lon_max"), ((e % 120).cast("double") - 60.0).alias("lat_min"), ((e % 120).cast("double") - 58.0).alias("lat_max")
    )


GRANULES = """gr AS (
  SELECT event_id, CASE WHEN event_id % 50 = 0 THEN head ELSE head || '_' || lpad((floor(event_id / 40.0::DOUBLE)::BIGINT % 30)::VARCHAR, 3, '0') || '_' || lpad((event_id % 100)::VARCHAR, 3, '0') || 'F_' || start || '_' || start || '_' || crid || '_01.nc' END AS path, crs_wkt,
    lon_min, lon_min + 2.0::DOUBLE AS lon_max, (event_id % 120)::DOUBLE - 60.0::DOUBLE AS lat_min, (event_id % 120)::DOUBLE - 58.0::DOUBLE AS lat_max
  FROM (SELECT event_id, '/data/raw/SAT_L2_HR_Raster_100m_UTM' || lpad((1 + event_id % 60)::VARCHAR, 2, '0') || CASE WHEN event_id % 2 = 0 THEN 'N' ELSE 'C' END || '_N_x_x_x_' || lpad((event_id % 40)::VARCHAR, 3, '0') AS head,
    CASE WHEN event_id % 77 = 0 THEN '2025XX18T000000' ELSE strftime(ts, '%Y%m%dT%H%M%S') END AS start, ['PIC0', 'PIC2', 'PID0', 'PGC0'][event_id % 4 + 1] AS crid,
    CASE event_id % 5 WHEN 1 THEN 'WGS 84 / UTM zone ' || (1 + event_id % 60) || 'N' WHEN 2 THEN 'EPSG:' || (32701 + event_id % 60) WHEN 3 THEN 'EPSG:4326' WHEN 4 THEN 'EPSG: ' || (32601 + event_id % 60) END AS crs_wkt, (event_id % 360)::DOUBLE - 180.0::DOUBLE AS lon_min FROM events)
), gs AS (SELECT *, string_split(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.nc$', ''), '_') AS p FROM gr),
gp AS (
  SELECT *, array_to_string(p, '_') AS granule_id, p[6] AS grid, p[11] AS cycle, p[12] AS pass, p[13] AS scene, p[14] AS start_time, p[16] AS crid, p[17] AS version,
    coalesce(p[11], 'None') || '_' || coalesce(p[12], 'None') || '_' || coalesce(p[16], 'None') AS group_id, try_strptime(p[14], '%Y%m%dT%H%M%S')::DATE AS obs_date FROM gs
)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lake series from lineitem: lake_id, date, wse, wse_uncert, water_area."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 20).cast("string").alias("lake_id"), F.col("l_shipdate").cast("date").alias("date"),
        F.when(key % 41 == 0, -9999.0).when(key % 43 == 0, 0.0).otherwise(100.0 + F.col("l_quantity") / 10.0).alias("wse"),
        F.when(F.col("l_linenumber") == 7, -1.0).otherwise(F.col("l_linenumber") * 0.05).alias("wse_uncert"), (F.col("l_extendedprice") * 1000.0 + F.col("l_quantity") * 2000000.0).alias("water_area"),
    )


SERIES = """ls AS (
  SELECT (l_suppkey % 20)::VARCHAR AS lake_id, l_shipdate::DATE AS date,
    CASE WHEN (l_orderkey * 8 + l_linenumber) % 41 = 0 THEN -9999.0::DOUBLE WHEN (l_orderkey * 8 + l_linenumber) % 43 = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE + l_quantity / 10.0::DOUBLE END AS wse,
    CASE WHEN l_linenumber = 7 THEN -1.0::DOUBLE ELSE l_linenumber * 0.05::DOUBLE END AS wse_uncert, l_extendedprice * 1000.0::DOUBLE + l_quantity * 2000000.0::DOUBLE AS water_area FROM lineitem
), ci AS (SELECT *, water_area / 1000000.0::DOUBLE AS area FROM ls WHERE wse <> -9999 AND wse > 0),
iq AS (SELECT lake_id, quantile_cont(area, 0.25) AS q1, quantile_cont(area, 0.75) AS q3 FROM ci GROUP BY lake_id),
cl AS (SELECT ci.* FROM ci JOIN iq USING (lake_id) WHERE q3 - q1 = 0 OR area BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)),
sg AS (SELECT cl.*, coalesce(CASE WHEN wse_uncert > 0 THEN wse_uncert END, md, 1.0::DOUBLE) AS sigma FROM cl JOIN (SELECT lake_id, median(CASE WHEN wse_uncert > 0 THEN wse_uncert END) AS md FROM cl GROUP BY lake_id) USING (lake_id))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """granule_id and box, from customers."""
    k = F.col("c_custkey")
    x, y, h = (k * 37 % 1000).cast("double"), (k * 91 % 1000).cast("double"), (1 + k % 20).cast("double")
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("granule_id"), (x - h).alias("minx"), (y - h).alias("miny"), (x + h).alias("maxx"), (y + h).alias("maxy"))


def lakes(spark: SparkSession, sf_dir: str, square: bool = False) -> DataFrame:
    """lake_id, rings and box, from suppliers: diamonds, or squares."""
    k = F.col("s_suppkey")
    x, y, h = (k * 53 % 1000).cast("double"), (k * 29 % 1000).cast("double"), (5 + k % 10) + 0.25
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)] if square else [(-1, 0), (0, -1), (1, 0), (0, 1)]
    ring = F.array(*[F.struct((x + a * h).alias("x"), (y + b * h).alias("y")) for a, b in corners])
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("lake_id"), F.array(ring).alias("rings"), (x - h).alias("minx"), (y - h).alias("miny"), (x + h).alias("maxx"), (y + h).alias("maxy"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y, from orders."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("point_id"), ((k * 17 % 1000) + 0.5).alias("x"), ((F.floor(k / 3.0) * 31 % 1000) + 0.5).alias("y"))


SPACE = """bx AS (SELECT c_custkey::VARCHAR AS granule_id, (c_custkey * 37 % 1000)::DOUBLE - (1 + c_custkey % 20) AS minx, (c_custkey * 91 % 1000)::DOUBLE - (1 + c_custkey % 20) AS miny, (c_custkey * 37 % 1000)::DOUBLE + (1 + c_custkey % 20) AS maxx, (c_custkey * 91 % 1000)::DOUBLE + (1 + c_custkey % 20) AS maxy FROM customer),
lk AS (SELECT s_suppkey::VARCHAR AS lake_id, (s_suppkey * 53 % 1000)::DOUBLE AS cx, (s_suppkey * 29 % 1000)::DOUBLE AS cy, (5 + s_suppkey % 10) + 0.25::DOUBLE AS h FROM supplier),
pt AS (SELECT o_orderkey AS point_id, (o_orderkey * 17 % 1000) + 0.5::DOUBLE AS x, (floor(o_orderkey / 3.0::DOUBLE)::BIGINT * 31 % 1000) + 0.5::DOUBLE AS y FROM orders)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raster_id, row, col: valid cells of rasters of 12 by 12, from events. Each event sees a cell; a cell is valid if one that sees it is a valid observation."""
    e = F.col("event_id")
    seen = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("raster_id"), (e % 12).cast("int").alias("row"), (F.floor(F.col("value") * 7) % 12).cast("int").alias("col"), (e % 3 == 0).alias("valid"))
    return seen.groupBy("raster_id", "row", "col").agg(F.max("valid").alias("valid")).where("valid").drop("valid")


CELL = """ce AS (SELECT raster_id, row, col FROM (SELECT user_id::VARCHAR AS raster_id, (event_id % 12)::INT AS row, (floor(value * 7)::BIGINT % 12)::INT AS col, event_id % 3 = 0 AS valid FROM events)
  GROUP BY raster_id, row, col HAVING bool_or(valid))"""


def vector_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of the vector product, from events."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 11 != 0, (F.col("user_id") % 20).cast("string")).alias("lake_id"), F.col("ts").cast("date").alias("obs_date"), F.lpad((e % 9).cast("string"), 3, "0").alias("pass"), F.col("value").alias("wse"),
        (0.1 + (e % 7) * 0.1).alias("uncertainty"), (F.col("value") * 10.0).alias("area"), (e % 5).cast("short").alias("quality_f"), F.element_at(F.array(F.lit(0), F.lit(-999), F.lit(1)), (F.floor(e / 5.0) % 3 + 1).cast("int")).alias("ice_clim_f"),
    )


VECTOR = """vo AS (SELECT CASE WHEN user_id % 11 <> 0 THEN (user_id % 20)::VARCHAR END AS lake_id, ts::DATE AS obs_date, lpad((event_id % 9)::VARCHAR, 3, '0') AS pass, value AS wse, 0.1::DOUBLE + (event_id % 7) * 0.1::DOUBLE AS uncertainty, value * 10.0::DOUBLE AS area,
  event_id % 5 AS quality_f, [0, -999, 1][floor(event_id / 5.0::DOUBLE)::BIGINT % 3 + 1] AS ice_clim_f FROM events),
vu AS (SELECT * FROM vo WHERE quality_f <= 2 AND ice_clim_f IN (0, -999))"""
