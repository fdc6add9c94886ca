"""Registered queries of the water-surface operators, each with the same query in SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries.config import FilterConfig, QualityConfig
from hydroseries.functions import geo, naming
from hydroseries.operators import audit, clip, continuity, curve, lakesp, mosaic, outline, quality, reproject, timeseries, wse_filter
from hydroseries.plans import views as v
from hydroseries.streaming.daily import daily_levels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The values of the pixel view spread over hundreds, so the filter's cap is wide here.
WIDE = FilterConfig(max_half_range=20.0)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name or c)


# Quality control.


@query(f"WITH {v.PX} SELECT event_id, m AS quality_mask, round(wse, 6) AS wse, round(wse_uncert, 6) AS wse_uncert, round(water_frac, 6) AS water_frac FROM pq")
def qc_filter(spark, sf_dir):
    return v.good_pixels(spark, sf_dir).select("event_id", "quality_mask", r6("wse"), r6("wse_uncert"), r6("water_frac"))


@query(f"""WITH {v.PX}, pf AS (SELECT *, t_wse AND t_area AND t_cross AND t_sigma AS m FROM pm)
SELECT lake_id, count(wse) AS initial, count(*) FILTER (t_wse) AS after_wse_qual, count(*) FILTER (t_area) AS after_water_area_qual, count(*) FILTER (t_cross) AS after_cross_track, 0::BIGINT AS after_water_frac, 0::BIGINT AS after_ice_filter,
  count(*) FILTER (m) AS final, round(avg(wse) FILTER (m), 6) AS final_wse_mean, round(count(*) FILTER (m) * 100.0::DOUBLE / greatest(count(wse), 1), 6) AS retention FROM pf GROUP BY lake_id""")
def qc_stage_stats(spark, sf_dir):
    out = quality.quality_stats(v.pixels(spark, sf_dir), ["lake_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("final_wse_mean", "retention")})


@query(f"""WITH {v.PX}, pf AS (SELECT *, t_wse AND t_area AND t_cross AND t_sigma AS m FROM pm)
SELECT group_id, obs_date, round(avg(wse), 6) AS pre_mean, round(stddev_pop(wse), 6) AS pre_std, count(wse) AS pre_count, round(avg(wse) FILTER (m), 6) AS post_mean, count(wse) FILTER (m) AS post_count,
  round(count(wse) FILTER (m) * 100.0::DOUBLE / greatest(count(wse), 1), 6) AS retention FROM pf GROUP BY group_id, obs_date""")
def qc_retention(spark, sf_dir):
    out = quality.scene_stats(v.pixels(spark, sf_dir), ["group_id", "obs_date"])
    return out.withColumns({c: F.round(c, 6) for c in ("pre_mean", "pre_std", "post_mean", "retention")})


PROFILE = [("wse", "wse < 9e36", "wse"), ("wse_uncert", "wse_uncert < 9e36", "wse_uncert"), ("wse_qual", "wse_qual <> 255", "wse_qual"), ("n_wse_pix", "n_wse_pix <> 4294967295", "n_wse_pix"), ("cell_row", "cell_row <> 0", "cell_row"), ("event_type", "true", "NULL")]


@query(f"WITH {v.PX} " + " UNION ALL ".join(f"SELECT '{n}' AS variable, count(*) FILTER ({ok}) AS valid_count, count(*) FILTER (NOT ({ok})) AS fill_count, round(count(*) FILTER ({ok}) * 1.0::DOUBLE / count(*), 6) AS valid_ratio FROM px" for n, ok, _ in PROFILE))
def valid_value_profile(spark, sf_dir):
    out = audit.variable_profile(v.raw_pixels(spark, sf_dir), [n for n, _, _ in PROFILE])
    return out.select("variable", "valid_count", "fill_count", r6(F.col("valid_count") / (F.col("valid_count") + F.col("fill_count")), "valid_ratio"))


@query(f"WITH {v.PX} " + " UNION ALL ".join(f"SELECT '{n}' AS variable, count(*) FILTER ({ok}) AS valid_count, count(*) FILTER (NOT ({ok})) AS fill_count, round(min({x}::DOUBLE) FILTER ({ok}), 6) AS min, round(max({x}::DOUBLE) FILTER ({ok}), 6) AS max, round(avg({x}::DOUBLE) FILTER ({ok}), 6) AS mean, round(stddev_pop({x}::DOUBLE) FILTER ({ok}), 6) AS std FROM px" for n, ok, x in PROFILE))
def variable_profile(spark, sf_dir):
    out = audit.variable_profile(v.raw_pixels(spark, sf_dir), [n for n, _, _ in PROFILE])
    return out.withColumns({c: F.round(c, 6) for c in ("min", "max", "mean", "std")})


# Mosaics.

CELL = "lake_id, obs_date, cell_row, cell_col"
IV = "sum(wse / (wse_uncert * wse_uncert)) FILTER (wse IS NOT NULL AND wse_uncert > 0) / sum(1.0::DOUBLE / (wse_uncert * wse_uncert)) FILTER (wse IS NOT NULL AND wse_uncert > 0)"
IS = "1.0::DOUBLE / sqrt(sum(1.0::DOUBLE / (wse_uncert * wse_uncert)) FILTER (wse IS NOT NULL AND wse_uncert > 0))"


@query(f"WITH {v.PX} SELECT {CELL}, round(avg(wse), 6) AS wse, round(avg(water_frac), 6) AS water_frac, round(avg(wse_qual), 6) AS wse_qual FROM pc GROUP BY ALL")
def mosaic_mean(spark, sf_dir):
    names = ["wse", "water_frac", "wse_qual"]
    return mosaic.mosaic_mean(v.pixels(spark, sf_dir), CELL.split(", "), names).withColumns({c: F.round(c, 6) for c in names})


@query(f"WITH {v.PX} SELECT {CELL}, round({IV}, 6) AS wse, round({IS}, 6) AS wse_uncert FROM pq GROUP BY ALL")
def mosaic_inverse_variance(spark, sf_dir):
    wse, sigma = mosaic.inverse_variance()
    return v.good_pixels(spark, sf_dir).groupBy(*CELL.split(", ")).agg(r6(wse, "wse"), r6(sigma, "wse_uncert"))


@query(f"""WITH {v.PX}, one AS (SELECT lake_id, granule_id, cell_row, cell_col, max(wse) AS wse, max(wse_uncert) AS wse_uncert, max(water_frac) AS water_frac FROM pq GROUP BY ALL), n AS (SELECT lake_id, count(DISTINCT granule_id) AS n FROM one GROUP BY lake_id)
SELECT lake_id AS group_id, cell_row, cell_col, round(CASE WHEN any_value(n) = 1 THEN max(wse) ELSE {IV} END, 6) AS wse, round(CASE WHEN any_value(n) = 1 THEN max(wse_uncert) ELSE {IS} END, 6) AS wse_uncert, round(avg(water_frac), 6) AS water_frac
FROM one JOIN n USING (lake_id) GROUP BY lake_id, cell_row, cell_col""")
def mosaic_single_source_passthrough(spark, sf_dir):
    one = v.good_pixels(spark, sf_dir).groupBy(F.col("lake_id").alias("group_id"), "granule_id", "cell_row", "cell_col").agg(*[F.max(c).alias(c) for c in ("wse", "wse_uncert", "water_frac")])
    return mosaic.mosaic(one, others=["water_frac"]).withColumns({c: F.round(c, 6) for c in ("wse", "wse_uncert", "water_frac")})


@query(f"WITH {v.PX}{v.CELLS} SELECT lake_id, round(avg(wse), 6) AS mean, round(stddev_pop(wse), 6) AS std, count(wse) AS count FROM sc GROUP BY lake_id HAVING count(wse) > 0")
def merged_stats(spark, sf_dir):
    return mosaic.merged_stats(v.source_cells(v.good_pixels(spark, sf_dir)), ["lake_id"]).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(f"""WITH {v.SPACE}, g AS (SELECT granule_id, granule_id::BIGINT % 50 AS k, minx + (granule_id::BIGINT % 7) * 0.1::DOUBLE AS minx, miny, maxx + (granule_id::BIGINT % 7) * 0.1::DOUBLE AS maxx, maxy FROM bx),
b AS (SELECT k, min(minx) AS gx, max(maxy) AS gy, max(maxx) AS gxx, min(miny) AS gyy FROM g GROUP BY k)
SELECT granule_id, g.k::VARCHAR AS group_id, round_even((minx - gx) / 2.0::DOUBLE, 0)::INT AS col_off, round_even((gy - maxy) / 2.0::DOUBLE, 0)::INT AS row_off, ceil((gxx - gx) / 2.0::DOUBLE)::INT AS width, ceil((gy - gyy) / 2.0::DOUBLE)::INT AS height FROM g JOIN b USING (k)""")
def grid_alignment(spark, sf_dir):
    k = F.col("granule_id").cast("bigint")
    g = v.boxes(spark, sf_dir).withColumns({"group_id": (k % 50).cast("string"), "minx": F.col("minx") + (k % 7) * 0.1, "maxx": F.col("maxx") + (k % 7) * 0.1, "res_x": F.lit(2.0), "res_y": F.lit(2.0)})
    return mosaic.grid_offsets(g).select("granule_id", "group_id", "col_off", "row_off", "width", "height")


# Lakes by day.

DAY_MERGE = f"""dn AS (SELECT lake_id, obs_date, count(DISTINCT group_id) AS n_sources, string_agg(DISTINCT group_id, ',' ORDER BY group_id) AS sources FROM {{src}} GROUP BY ALL),
dm AS (SELECT {CELL}, n_sources, sources, (CASE WHEN n_sources = 1 THEN max(wse) ELSE {IV} END)::FLOAT AS wse, (CASE WHEN n_sources = 1 THEN max(wse_uncert) ELSE {IS} END)::FLOAT AS wse_uncert,
  (CASE WHEN n_sources = 1 THEN max(water_frac) ELSE avg(water_frac) FILTER (wse IS NOT NULL) END)::FLOAT AS water_frac FROM {{src}} JOIN dn USING (lake_id, obs_date) GROUP BY {CELL}, n_sources, sources)"""


@query(f"WITH {v.PX}{v.CELLS}, {DAY_MERGE.format(src='sc')} SELECT {CELL}, n_sources, sources, round(wse::DOUBLE, 3) AS wse, round(wse_uncert::DOUBLE, 3) AS wse_uncert, round(water_frac::DOUBLE, 3) AS water_frac FROM dm")
def lake_day_merge(spark, sf_dir):
    merged = timeseries.merge_same_day(v.source_cells(v.good_pixels(spark, sf_dir)))
    return merged.withColumns({c: F.round(F.col(c).cast("double"), 3) for c in ("wse", "wse_uncert", "water_frac")})


STATS = """w1 AS (SELECT {keys}, median(wse::DOUBLE) AS wse_med, stddev_pop(wse::DOUBLE) AS std_all, stddev_pop(wse::DOUBLE) FILTER (wse_uncert > 0 AND wse_uncert < 1000) AS std_good,
  sum(wse::DOUBLE / (wse_uncert::DOUBLE * wse_uncert::DOUBLE)) FILTER (wse IS NOT NULL AND wse_uncert > 0 AND wse_uncert < 1000) AS wv, sum(1.0::DOUBLE / (wse_uncert::DOUBLE * wse_uncert::DOUBLE)) FILTER (wse IS NOT NULL AND wse_uncert > 0 AND wse_uncert < 1000) AS w, count(wse) AS valid_pixels FROM {src} GROUP BY {keys}),
w2 AS (SELECT {keys}, 1.482::DOUBLE * median(abs(wse::DOUBLE - wse_med)) AS mad FROM {src} JOIN w1 USING ({keys}) GROUP BY {keys}),
st AS (SELECT {keys}, CASE WHEN w IS NULL THEN wse_med ELSE wv / w END AS wse, wse_med, CASE WHEN w IS NULL THEN std_all ELSE std_good END AS wse_std, CASE WHEN w IS NULL THEN mad ELSE sqrt(1.0::DOUBLE / w) END AS wse_uncert, valid_pixels FROM w1 JOIN w2 USING ({keys}))"""
STAT_COLUMNS = ("wse", "wse_med", "wse_std", "wse_uncert")
ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in STAT_COLUMNS)


def _rounded(df: DataFrame, names=STAT_COLUMNS, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


@query(f"WITH {v.PX}, {STATS.format(keys='lake_id, obs_date', src='pq')} SELECT lake_id, obs_date, {ROUNDED}, valid_pixels FROM st")
def lake_wse_stats(spark, sf_dir):
    return _rounded(timeseries.lake_statistics(v.good_pixels(spark, sf_dir)))


@query(f"WITH {v.PX}, nu AS (SELECT * REPLACE (CASE WHEN lake_id::INT % 2 = 1 THEN wse_uncert END AS wse_uncert) FROM pq), {STATS.format(keys='lake_id, obs_date', src='nu')} SELECT lake_id, obs_date, round(wse, 4) AS wse, round(wse_med, 4) AS wse_med, round(wse_std, 4) AS wse_std, round(wse_uncert, 6) AS wse_uncert, valid_pixels FROM st")
def lake_wse_stats_mad_fallback(spark, sf_dir):
    odd = F.when(F.col("lake_id").cast("int") % 2 == 1, F.col("wse_uncert"))
    stats = timeseries.lake_statistics(v.good_pixels(spark, sf_dir).withColumn("wse_uncert", odd))
    return _rounded(stats, STAT_COLUMNS[:3]).withColumn("wse_uncert", F.round("wse_uncert", 6))


@query(f"WITH {v.PX} SELECT lake_id, obs_date, count(wse) * 10000.0::DOUBLE AS water_area FROM pq GROUP BY ALL")
def lake_water_area(spark, sf_dir):
    return timeseries.water_area(v.good_pixels(spark, sf_dir))


TIMES = f"""WITH {v.PX}, pr AS (SELECT lake_id, obs_date, group_id, cell_row, cell_col, max(wse) AS wse, max(wse_uncert) AS wse_uncert, max(water_frac) AS water_frac FROM pq GROUP BY ALL),
en AS (SELECT lake_id, obs_date, group_id FROM pr GROUP BY ALL HAVING count(wse) >= 2), sc AS (SELECT pr.* FROM pr SEMI JOIN en USING (lake_id, obs_date, group_id)),
{DAY_MERGE.format(src='sc')}, {STATS.format(keys='lake_id, obs_date', src='dm')},
ts AS (SELECT lake_id, obs_date AS date, {ROUNDED}, valid_pixels * 10000.0::DOUBLE AS water_area, valid_pixels, sources AS granule_id FROM st JOIN dn USING (lake_id, obs_date) WHERE valid_pixels > 0) """


def _timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels have passed quality control, so the pipeline's own control runs on what those tests would keep."""
    cells = v.source_cells(v.good_pixels(spark, sf_dir))
    return timeseries.lake_timeseries(cells, QualityConfig(wse_uncert_max=0.0, min_valid_pixels=2))


@query(TIMES + "SELECT * FROM ts")
def lake_timeseries(spark, sf_dir):
    return _rounded(_timeseries(spark, sf_dir))


@query(TIMES + "SELECT count(*) AS total_observations, count(DISTINCT lake_id) AS n_lakes, min(date) AS first_date, max(date) AS last_date FROM ts")
def timeseries_summary(spark, sf_dir):
    return timeseries.summarise(_timeseries(spark, sf_dir))


@query(f"WITH {v.PX} SELECT lake_id, obs_date AS day, round({IV}, 4) AS wse, round({IS}, 4) AS wse_uncert, count(wse) AS valid_pixels FROM pq GROUP BY ALL")
def daily_levels_batch(spark, sf_dir):
    return _rounded(daily_levels(v.pixels(spark, sf_dir).withColumn("obs_ts", F.col("obs_date").cast("timestamp_ntz"))), ("wse", "wse_uncert"))


# Names and projections.


@query(f"WITH {v.GRANULES} SELECT path, granule_id, grid, cycle, pass, scene, crid, version, group_id, obs_date FROM gp")
def parse_filename(spark, sf_dir):
    return naming.parse_filename(v.granules(spark, sf_dir)).select("path", "granule_id", "grid", "cycle", "pass", "scene", "crid", "version", "group_id", "obs_date")


@query(f"WITH {v.GRANULES} SELECT group_id, count(*) AS n_granules, min(obs_date) AS obs_date, string_agg(path, '|' ORDER BY path) AS paths FROM gp WHERE cycle IS NOT NULL AND pass IS NOT NULL AND crid IS NOT NULL AND obs_date IS NOT NULL GROUP BY group_id")
def group_granules(spark, sf_dir):
    g = naming.parse_filename(v.granules(spark, sf_dir)).where(~naming.is_malformed())
    return naming.group_granules(g).withColumn("paths", F.array_join("paths", "|"))


@query(f"WITH {v.GRANULES} SELECT event_id, group_id FROM gp WHERE pass IS NULL OR crid IS NULL OR cycle IS NULL OR obs_date IS NULL")
def malformed_filenames(spark, sf_dir):
    return naming.parse_filename(v.granules(spark, sf_dir)).where(naming.is_malformed()).select("event_id", "group_id")


@query(f"WITH {v.GRANULES} SELECT obs_date, count(DISTINCT group_id) AS n_groups, count(*) AS n_granules FROM gp WHERE obs_date IS NOT NULL GROUP BY obs_date")
def group_counts_by_date(spark, sf_dir):
    return audit.group_counts_by_date(naming.parse_filename(v.granules(spark, sf_dir)).where(F.col("obs_date").isNotNull()))


ZONE = r"""CASE WHEN regexp_matches(upper(crs_wkt), 'UTM\s*ZONE\s*\d{1,2}[NS]') THEN regexp_extract(upper(crs_wkt), 'UTM\s*ZONE\s*(\d{1,2})([NS])', 1)::INT || regexp_extract(upper(crs_wkt), 'UTM\s*ZONE\s*(\d{1,2})([NS])', 2)
  WHEN code BETWEEN 32601 AND 32660 THEN (code - 32600) || 'N' WHEN code BETWEEN 32701 AND 32760 THEN (code - 32700) || 'S' END"""
ZONES = f"""WITH {v.GRANULES}, zc AS (SELECT *, TRY_CAST(nullif(regexp_extract(upper(crs_wkt), 'EPSG[:\\s]*(\\d+)', 1), '') AS INT) AS code FROM gp),
zn AS (SELECT *, {ZONE} AS content_zone, nullif(regexp_extract(grid, '^UTM(.*)$', 1), '') AS name_zone FROM zc) """


@query(ZONES + "SELECT event_id, content_zone AS zone FROM zn")
def utm_zone_from_text(spark, sf_dir):
    return v.granules(spark, sf_dir).select("event_id", naming.utm_zone_of_text(F.col("crs_wkt")).alias("zone"))


@query(f"WITH {v.GRANULES} SELECT event_id, CASE WHEN (lat_min + lat_max) / 2 >= 0 THEN 32600 ELSE 32700 END + trunc(((lon_min + lon_max) / 2 + 180) / 6)::INT + 1 AS epsg FROM gr")
def utm_zone_from_bounds(spark, sf_dir):
    box = [F.col(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max")]
    return v.granules(spark, sf_dir).select("event_id", naming.utm_epsg_of_bounds(*box).alias("epsg"))


def _zoned(spark, sf_dir):
    return audit.with_zones(naming.parse_filename(v.granules(spark, sf_dir)))


@query(f"WITH {v.GRANULES} SELECT event_id, nullif(regexp_extract(grid, '^UTM(..)(.)', 1), '') AS zone, nullif(regexp_extract(grid, '^UTM(..)(.)', 2), '') AS band, 'EPSG:326' || nullif(regexp_extract(grid, '^UTM(..)(.)', 1), '') AS epsg FROM gp")
def utm_grid_names(spark, sf_dir):
    g = naming.parse_filename(v.granules(spark, sf_dir))
    zone, band = naming.utm_grid(F.col("grid"))
    return g.select("event_id", zone.alias("zone"), band.alias("band"), naming.epsg_of_grid(F.col("grid")).alias("epsg"))


@query(ZONES + "SELECT content_zone, count(*) AS count FROM zn GROUP BY content_zone")
def zone_histogram(spark, sf_dir):
    return audit.zone_histogram(_zoned(spark, sf_dir), "content_zone")


@query(ZONES + "SELECT event_id, name_zone, content_zone FROM zn WHERE name_zone <> content_zone")
def zone_mismatch(spark, sf_dir):
    return audit.zone_mismatches(_zoned(spark, sf_dir)).select("event_id", "name_zone", "content_zone")


@query(ZONES + "SELECT group_id, count(*) AS n_granules, count(DISTINCT content_zone) AS n_zones, coalesce(string_agg(DISTINCT content_zone, ',' ORDER BY content_zone), '') AS zones, count(*) = 1 AS single, count(DISTINCT content_zone) <= 1 AS consistent FROM zn GROUP BY group_id")
def group_crs_consistency(spark, sf_dir):
    return audit.crs_consistency(_zoned(spark, sf_dir)).drop("files").withColumn("zones", F.array_join("zones", ","))


# Boxes, clips and projections.


@query(f"WITH {v.SPACE}, ar AS (SELECT min(cx - h) / 2 AS x0, min(cy - h) / 2 AS y0, max(cx + h) / 2 AS x1, max(cy + h) / 2 AS y1 FROM lk) SELECT granule_id FROM bx, ar WHERE NOT (maxx < x0 OR minx > x1 OR maxy < y0 OR miny > y1)")
def bbox_overlap_semi(spark, sf_dir):
    half = v.lakes(spark, sf_dir).withColumns({c: F.col(c) / 2 for c in clip.BOX})
    return clip.granules_in_area(v.boxes(spark, sf_dir), half).select("granule_id")


@query(f"WITH {v.SPACE}, ar AS (SELECT min(cx - h) / 2 AS x0, min(cy - h) / 2 AS y0, max(cx + h) / 2 AS x1, max(cy + h) / 2 AS y1 FROM lk) SELECT granule_id FROM bx, ar WHERE maxx < x0 OR minx > x1 OR maxy < y0 OR miny > y1")
def bbox_anti(spark, sf_dir):
    half = v.lakes(spark, sf_dir).withColumns({c: F.col(c) / 2 for c in clip.BOX})
    return clip.granules_in_area(v.boxes(spark, sf_dir), half, keep=False).select("granule_id")


@query(f"WITH {v.SPACE} SELECT point_id, x, y FROM pt WHERE x BETWEEN 100 AND 400 AND y BETWEEN 200 AND 300")
def point_in_bbox(spark, sf_dir):
    return v.points(spark, sf_dir).where(geo.point_in_box(F.col("x"), F.col("y"), (100, 200, 400, 300)))


@query(f"WITH {v.SPACE} SELECT point_id, granule_id FROM pt JOIN bx ON x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy")
def bbox_tile_join(spark, sf_dir):
    return clip.points_in_boxes(v.points(spark, sf_dir), v.boxes(spark, sf_dir), tile=25.0).select("point_id", "granule_id")


@query(f"WITH {v.SPACE} SELECT point_id, lake_id FROM pt JOIN lk ON abs(x - cx) + abs(y - cy) < h")
def point_in_polygon_clip(spark, sf_dir):
    return clip.clip_to_lakes(v.points(spark, sf_dir).withColumn("row", F.col("point_id")), v.lakes(spark, sf_dir), tile=25.0).select("point_id", "lake_id")


@query(f"WITH {v.SPACE} SELECT point_id, lake_id FROM pt JOIN lk ON sqrt(pow(greatest(abs(x - cx) - h, 0.0::DOUBLE), 2) + pow(greatest(abs(y - cy) - h, 0.0::DOUBLE), 2)) <= 2.3::DOUBLE")
def buffered_clip(spark, sf_dir):
    return clip.clip_to_lakes(v.points(spark, sf_dir).withColumn("row", F.col("point_id")), v.lakes(spark, sf_dir, square=True), buffer_meters=2.3, tile=25.0).select("point_id", "lake_id")


@query(f"""WITH {v.PX}, ll AS (SELECT event_id, group_id, event_id % 50 AS r, (event_id * 7) % 60 AS c, 90.0::DOUBLE + ((event_id * 7) % 60) * 0.01::DOUBLE + (event_id % 50) * 0.001::DOUBLE AS lon, 30.0::DOUBLE + (event_id % 50) * 0.01::DOUBLE AS lat FROM px),
sp AS (SELECT group_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM ll WHERE lon BETWEEN 90.1 - 0.02::DOUBLE AND 90.2 + 0.02::DOUBLE AND lat BETWEEN 30.1 - 0.02::DOUBLE AND 30.15 + 0.02::DOUBLE GROUP BY group_id)
SELECT event_id, r::INT AS row, c::INT AS col FROM ll JOIN sp USING (group_id) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1""")
def lonlat_window_clip(spark, sf_dir):
    r, c = F.col("event_id") % 50, F.col("event_id") * 7 % 60
    px = v.raw_pixels(spark, sf_dir).select("event_id", "group_id", r.cast("int").alias("row"), c.cast("int").alias("col"), (90.0 + c * 0.01 + r * 0.001).alias("longitude"), (30.0 + r * 0.01).alias("latitude"))
    return clip.lonlat_window(px, (90.1, 30.1, 90.2, 30.15), keys=("group_id",)).select("event_id", "row", "col")


@query(f"WITH {v.PX} SELECT lake_id, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM (SELECT lake_id, CASE WHEN ok THEN lon END AS lon, CASE WHEN ok THEN lat END AS lat FROM (SELECT *, lon <= 180 AND lat <= 90 AS ok FROM (SELECT lake_id, (event_id % 400)::DOUBLE - 180 AS lon, (event_id % 200)::DOUBLE - 90 AS lat FROM px))) GROUP BY lake_id")
def spatial_bounds(spark, sf_dir):
    e = F.col("event_id")
    return geo.bounds(v.raw_pixels(spark, sf_dir).select("lake_id", ((e % 400).cast("double") - 180).alias("longitude"), ((e % 200).cast("double") - 90).alias("latitude")), ["lake_id"])


def _lonlat(spark, sf_dir):
    k = F.col("c_custkey")
    return v.table(spark, sf_dir, "customer").select(k.alias("point_id"), (84.0 + (k * 7 % 1800) / 100.0).alias("lon"), (25.0 + (k * 13 % 1500) / 100.0).alias("lat"))


@query("""SELECT c_custkey AS point_id FROM customer WHERE 84.0::DOUBLE + (c_custkey * 7 % 1800) / 100.0::DOUBLE BETWEEN 88.004 AND 95.506 AND 25.0::DOUBLE + (c_custkey * 13 % 1500) / 100.0::DOUBLE BETWEEN 28.503 AND 36.207""")
def lonlat_box_filter(spark, sf_dir):
    """Points that are given in a zone, by a lon/lat box."""
    placed = geo.to_utm(_lonlat(spark, sf_dir), "lon", "lat", F.lit(32646), "x", "y").select("point_id", "x", "y")
    return geo.filter_lonlat_box(placed, (88.004, 28.503, 95.506, 36.207), 32646).select("point_id")


_K = geo.SCALE * geo.RADIUS
_SUM = {f: " + ".join(f"{a!r} * {t.format(j=2 * j)}" for j, a in enumerate(geo.FORWARD, 1)) for f, t in (("e", "cos({j} * xi) * sinh({j} * eta)"), ("n", "sin({j} * xi) * cosh({j} * eta)"))}


@query(f"""WITH ll AS (SELECT c_custkey AS point_id, radians(84.0::DOUBLE + (c_custkey * 7 % 1800) / 100.0::DOUBLE - 93) AS lam, radians(25.0::DOUBLE + (c_custkey * 13 % 1500) / 100.0::DOUBLE) AS phi FROM customer),
a AS (SELECT *, sinh(atanh(sin(phi)) - {geo.ECC!r} * atanh({geo.ECC!r} * sin(phi))) AS t FROM ll), b AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM a)
SELECT point_id, round({_K!r} * (eta + {_SUM['e']}) + 500000, 3) AS x, round({_K!r} * (xi + {_SUM['n']}), 3) AS y FROM b""")
def utm_forward(spark, sf_dir):
    x, y = geo.utm_forward(F.col("lon"), F.col("lat"), F.lit(32646))
    return _lonlat(spark, sf_dir).select("point_id", r6(x, "x", 3), r6(y, "y", 3))


@query("SELECT c_custkey AS point_id, round(84.0::DOUBLE + (c_custkey * 7 % 1800) / 100.0::DOUBLE, 6) AS lon, round(25.0::DOUBLE + (c_custkey * 13 % 1500) / 100.0::DOUBLE, 6) AS lat FROM customer")
def utm_round_trip(spark, sf_dir):
    there = geo.to_utm(_lonlat(spark, sf_dir), "lon", "lat", F.lit(32646), "x", "y").select("point_id", "x", "y")
    return geo.from_utm(there, "x", "y", F.lit(32646), "lon", "lat").select("point_id", r6("lon"), r6("lat"))


def _sql_series(terms, a: str, b: str, sign: int) -> tuple[str, str]:
    """Krueger's sums in SQL: northward and eastward, from the columns a and b."""
    north = " + ".join(f"{c!r} * sin({2 * j} * {a}) * cosh({2 * j} * {b})" for j, c in enumerate(terms, 1))
    east = " + ".join(f"{c!r} * cos({2 * j} * {a}) * sinh({2 * j} * {b})" for j, c in enumerate(terms, 1))
    return f"({a} + {sign} * ({north}))", f"({b} + {sign} * ({east}))"


def _sql_from_utm(src: str, out: str, x: str, y: str, srid: str) -> str:
    """CTEs that add lon and lat (degrees) to src, from northern UTM coordinates."""
    n, e = _sql_series(geo.INVERSE, "i0", "i1", -1)
    c = [2 * geo.N - 2 * geo.N**2 / 3 - 2 * geo.N**3 + 116 * geo.N**4 / 45, 7 * geo.N**2 / 3 - 8 * geo.N**3 / 5 - 227 * geo.N**4 / 45, 56 * geo.N**3 / 15 - 136 * geo.N**4 / 35, 4279 * geo.N**4 / 630]
    lat = " + ".join(f"{v!r} * sin({2 * j} * i4)" for j, v in enumerate(c, 1))
    return f"""{out}_a AS (SELECT *, {y} / {_K!r} AS i0, ({x} - 500000) / {_K!r} AS i1 FROM {src}), {out}_b AS (SELECT *, {n} AS i2, {e} AS i3 FROM {out}_a), {out}_c AS (SELECT *, asin(sin(i2) / cosh(i3)) AS i4 FROM {out}_b),
{out} AS (SELECT * EXCLUDE (i0, i1, i2, i3, i4), degrees(atan2(sinh(i3), cos(i2))) + (({srid}) % 100) * 6 - 183 AS lon, degrees(i4 + {lat}) AS lat FROM {out}_c)"""


def _sql_to_utm(src: str, out: str, srid: str) -> str:
    """CTEs that add ux and uy to src, from lon and lat, which go."""
    n, e = _sql_series(geo.FORWARD, "f2", "f3", 1)
    return f"""{out}_a AS (SELECT *, radians(lon - (({srid}) % 100) * 6 + 183) AS f0, sinh(atanh(sin(radians(lat))) - {geo.ECC!r} * atanh({geo.ECC!r} * sin(radians(lat)))) AS f1 FROM {src}), {out}_b AS (SELECT *, atan2(f1, cos(f0)) AS f2, atanh(sin(f0) / sqrt(1 + f1 * f1)) AS f3 FROM {out}_a),
{out} AS (SELECT * EXCLUDE (f0, f1, f2, f3, lon, lat), {_K!r} * {e} + 500000 AS ux, {_K!r} * {n} AS uy FROM {out}_b)"""


REPROJECT = f"""WITH gr AS (SELECT c_custkey::VARCHAR AS granule_id, CASE WHEN c_custkey % 2 = 1 THEN 32645 ELSE 32646 END AS srid, 700000.0::DOUBLE + c_custkey % 50 * 1000 AS minx, 3300000.0::DOUBLE + c_custkey % 70 * 1000 AS miny FROM customer),
px AS (SELECT granule_id, srid, r::INT AS row, c::INT AS col, minx + (c + 0.5::DOUBLE) * 100 AS x, miny + 1200 - (r + 0.5::DOUBLE) * 100 AS y, (r * 100 + c)::DOUBLE AS wse FROM gr, range(12) a(r), range(10) b(c)),
ot AS (SELECT * FROM gr WHERE srid <> 32646), rp AS (SELECT granule_id, srid, minx + i * 500.0::DOUBLE AS qx, miny + j * 600.0::DOUBLE AS qy FROM ot, range(3) a(i), range(3) b(j)),
{_sql_from_utm("rp", "rl", "qx", "qy", "srid")}, {_sql_to_utm("rl", "rt", "32646")}, fr AS (SELECT granule_id, min(ux) AS x0, max(ux) AS x1, min(uy) AS y0, max(uy) AS y1 FROM rt GROUP BY granule_id),
ce AS (SELECT ot.*, r::INT AS t_row, c::INT AS t_col, x0 + (c + 0.5::DOUBLE) * 100 AS tx, y1 - (r + 0.5::DOUBLE) * 100 AS ty FROM ot JOIN fr USING (granule_id), range(40) a(r), range(40) b(c) WHERE r < ceil((y1 - y0) / 100) AND c < ceil((x1 - x0) / 100)),
{_sql_from_utm("ce", "cl", "tx", "ty", "32646")}, {_sql_to_utm("cl", "cs", "srid")}, mv AS (SELECT cs.granule_id, t_row AS row, t_col AS col, tx AS x, ty AS y, wse FROM cs JOIN px ON px.granule_id = cs.granule_id AND px.row = floor((miny + 1200 - uy) / 100) AND px.col = floor((ux - minx) / 100)),
al AS (SELECT granule_id, row, col, x, y, wse FROM px WHERE srid = 32646 UNION ALL SELECT * FROM mv), {_sql_from_utm("al", "an", "x", "y", "32646")}
SELECT granule_id, row, col, round(x, 3) AS x, round(y, 3) AS y, wse, round(lon::FLOAT::DOUBLE, 4) AS longitude, round(lat::FLOAT::DOUBLE, 4) AS latitude FROM an"""


@query(REPROJECT)
def reproject_nearest(spark, sf_dir):
    n = F.col("c_custkey")
    granules = v.table(spark, sf_dir, "customer").select(n.cast("string").alias("granule_id"), F.when(n % 2 == 1, 32645).otherwise(32646).alias("srid"), (700000.0 + n % 50 * 1000).alias("minx"), (3300000.0 + n % 70 * 1000).alias("miny")).withColumns({"maxx": F.col("minx") + 1000, "maxy": F.col("miny") + 1200, "res_x": F.lit(100.0), "res_y": F.lit(100.0)})
    px = granules.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(9))))
    px = px.select("granule_id", "row", "col", (F.col("minx") + (F.col("col") + 0.5) * 100).alias("x"), (F.col("maxy") - (F.col("row") + 0.5) * 100).alias("y"), (F.col("row") * 100 + F.col("col")).cast("double").alias("wse"))
    out = reproject.reproject_nearest(px, granules, 32646)
    return out.select("granule_id", "row", "col", r6("x", digits=3), r6("y", digits=3), "wse", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("longitude", "latitude")])


def _sql_albers(lon: str, lat: str) -> tuple[str, str]:
    """Equal-area coordinates of degrees in SQL."""
    q = lambda s: f"({1 - geo.E2!r} * ({s} / (1 - {geo.E2!r} * {s} * {s}) + atanh({geo.ECC!r} * {s}) / {geo.ECC!r}))"
    at = {k: math.sin(math.radians(x)) for k, x in geo.ALBERS.items()}
    q_at = {k: (1 - geo.E2) * (s / (1 - geo.E2 * s * s) + math.atanh(geo.ECC * s) / geo.ECC) for k, s in at.items()}
    m2 = {k: (1 - s * s) / (1 - geo.E2 * s * s) for k, s in at.items()}
    n = (m2["lat_1"] - m2["lat_2"]) / (q_at["lat_2"] - q_at["lat_1"])
    c = m2["lat_1"] + n * q_at["lat_1"]
    rho0 = geo.A * math.sqrt(c - n * q_at["lat_0"]) / n
    rho, theta = f"({geo.A!r} * sqrt({c!r} - {n!r} * {q(f'sin(radians({lat}))')}) / {n!r})", f"({n!r} * radians({lon} - {geo.ALBERS['lon_0']!r}))"
    return f"{rho} * sin({theta})", f"{rho0!r} - {rho} * cos({theta})"


_CORNERS = [_sql_albers(f"(lon + {a!r}::DOUBLE)", f"(lat + {b!r}::DOUBLE)") for a, b in ((0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1))]


@query(f"""WITH ll AS (SELECT c_custkey AS point_id, 84.0::DOUBLE + (c_custkey * 7 % 1800) / 100.0::DOUBLE AS lon, 25.0::DOUBLE + (c_custkey * 13 % 1500) / 100.0::DOUBLE AS lat FROM customer),
xy AS (SELECT point_id, {', '.join(f'{x} AS x{i}, {y} AS y{i}' for i, (x, y) in enumerate(_CORNERS))} FROM ll)
SELECT point_id, round(abs({' + '.join(f'(x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i})' for i in range(4))}) / 2 / 1000000.0::DOUBLE, 4) AS area_km2 FROM xy""")
def albers_area(spark, sf_dir):
    p = _lonlat(spark, sf_dir)
    return p.select("point_id", r6(geo.equal_area(geo.box_polygon(F.col("lon"), F.col("lat"), F.col("lon") + 0.1, F.col("lat") + 0.1)) / 1e6, "area_km2", 4))


# Pixel filter.

MAD = f"""md AS (SELECT lake_id, obs_date, median(wse) AS wse_median, count(wse) AS valid_pixels_orig FROM pq GROUP BY ALL), ms AS (SELECT lake_id, obs_date, 1.482::DOUBLE * median(abs(wse - wse_median)) AS scaled_mad FROM pq JOIN md USING (lake_id, obs_date) GROUP BY ALL),
mb AS (SELECT *, wse_median - half AS wse_lower, wse_median + half AS wse_upper FROM (SELECT *, CASE WHEN scaled_mad = 0 THEN 0.0::DOUBLE ELSE least(scaled_mad, 20.0::DOUBLE) END AS half FROM md JOIN ms USING (lake_id, obs_date)) WHERE valid_pixels_orig > 0),
mf AS (SELECT lake_id, obs_date, median(wse) AS wse_filtered, any_value(wse_lower) AS wse_lower, any_value(wse_upper) AS wse_upper, any_value(scaled_mad) AS scaled_mad, any_value(valid_pixels_orig) AS valid_pixels_orig, count(wse) AS valid_pixels_filtered
  FROM pq JOIN mb USING (lake_id, obs_date) WHERE valid_pixels_orig >= 3 AND wse BETWEEN wse_lower AND wse_upper GROUP BY ALL HAVING count(wse) >= 3)"""
FEW = FilterConfig(max_half_range=20.0, min_pixels=3)
MAD_COLUMNS = ("wse_lower", "wse_upper", "scaled_mad")


@query(f"WITH {v.PX}, {MAD} SELECT lake_id, obs_date, round(wse_median, 6) AS wse_median, round(wse_lower, 6) AS wse_lower, round(wse_upper, 6) AS wse_upper, round(scaled_mad, 6) AS scaled_mad, valid_pixels_orig FROM mb")
def mad_bounds(spark, sf_dir):
    return _rounded(wse_filter.mad_bounds(v.good_pixels(spark, sf_dir), cfg=WIDE), ("wse_median", *MAD_COLUMNS), 6)


MAD_OUT = "round(wse_filtered, 6) AS wse_filtered, round(wse_lower, 6) AS wse_lower, round(wse_upper, 6) AS wse_upper, round(scaled_mad, 6) AS scaled_mad, valid_pixels_orig, valid_pixels_filtered, round_even(valid_pixels_filtered * 100.0::DOUBLE / valid_pixels_orig, 1) AS filter_retention"


@query(f"WITH {v.PX}, {MAD} SELECT lake_id, obs_date, {MAD_OUT} FROM mf")
def mad_filter(spark, sf_dir):
    return _rounded(wse_filter.mad_filter(v.good_pixels(spark, sf_dir), cfg=FEW), ("wse_filtered", *MAD_COLUMNS), 6)


@query(TIMES.rstrip() + f", {MAD} SELECT mf.lake_id, mf.obs_date AS date, ts.wse, ts.wse_med, ts.wse_std, ts.wse_uncert, ts.water_area, ts.valid_pixels, ts.granule_id, {MAD_OUT} FROM mf LEFT JOIN ts ON mf.lake_id = ts.lake_id AND mf.obs_date = ts.date")
def mad_filter_join_summary(spark, sf_dir):
    filtered = wse_filter.mad_filter(v.good_pixels(spark, sf_dir), cfg=FEW)
    return _rounded(_rounded(wse_filter.with_summary(filtered, _timeseries(spark, sf_dir))), ("wse_filtered", *MAD_COLUMNS), 6)


# Curves.


def _points(spark, sf_dir):
    return curve.iqr_clean(curve.curve_input(v.series(spark, sf_dir)).withColumn("area", F.col("water_area") / 1e6), ["lake_id"], "area")


@query(f"WITH {v.SERIES} SELECT lake_id, count(*) AS n, round(min(wse), 6) AS low, round(max(wse), 6) AS high FROM ci GROUP BY lake_id")
def curve_input_filter(spark, sf_dir):
    return curve.curve_input(v.series(spark, sf_dir)).groupBy("lake_id").agg(F.count("*").alias("n"), r6(F.min("wse"), "low"), r6(F.max("wse"), "high"))


@query(f"WITH {v.SERIES} SELECT lake_id, date, wse, round(area, 6) AS area FROM cl")
def iqr_outlier_clean(spark, sf_dir):
    return _points(spark, sf_dir).select("lake_id", "date", "wse", r6("area"))


POLY = f"""{v.SERIES}, hm AS (SELECT lake_id, avg(wse) AS h_mean FROM sg GROUP BY lake_id),
sm AS (SELECT lake_id, h_mean, count(*) AS n, {', '.join(f'sum(w * pow(d, {p})) AS s{p}' for p in range(5))}, {', '.join(f'sum(w * area * pow(d, {p})) AS t{p}' for p in range(3))} FROM (SELECT lake_id, h_mean, area, wse - h_mean AS d, 1.0::DOUBLE / (sigma * sigma) AS w FROM sg JOIN hm USING (lake_id)) GROUP BY lake_id, h_mean),
li AS (SELECT *, (t0 * s2 - s1 * t1) / (s0 * s2 - s1 * s1) AS l0, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS l1, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS d3 FROM sm)"""


def _fits(spark, sf_dir):
    points = curve.with_sigma(_points(spark, sf_dir), ["lake_id"])
    return points, curve.fit_polynomials(points, ["lake_id"])


@query(f"WITH {POLY} SELECT lake_id, n, round(h_mean, 4) AS h_mean, round(l0, 4) AS l0, round(l1, 4) AS l1 FROM li")
def fit_linear(spark, sf_dir):
    return _rounded(_fits(spark, sf_dir)[1].select("lake_id", "n", "h_mean", "l0", "l1"), ("h_mean", "l0", "l1"))


@query(f"""WITH {POLY} SELECT lake_id, n, round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / d3, 4) AS q0, round((s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / d3, 4) AS q1,
  round((s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / d3, 4) AS q2 FROM li""")
def fit_quadratic(spark, sf_dir):
    return _rounded(_fits(spark, sf_dir)[1].select("lake_id", "n", "q0", "q1", "q2"), ("q0", "q1", "q2"))


METRICS = f"""{POLY}, mt AS (SELECT lake_id, count(*) AS n, sum(pow(area - (l0 + l1 * (wse - h_mean)), 2)) AS rss, any_value(tot) AS tot, any_value(l1) AS l1, max(wse) - min(wse) AS wse_range
  FROM sg JOIN (SELECT lake_id, h_mean, l0, l1 FROM li) USING (lake_id) JOIN (SELECT lake_id, count(*) * var_pop(area) AS tot FROM sg GROUP BY lake_id) USING (lake_id) GROUP BY lake_id),
me AS (SELECT lake_id, n, rss, 1 - rss / tot AS r_squared, n * ln(rss / n) + 2 * ln(n) AS bic, sqrt(rss / n) AS rmse, wse_range, l1 FROM mt)"""


def _metrics(spark, sf_dir):
    points, fits = _fits(spark, sf_dir)
    both = points.join(fits.select("lake_id", "h_mean", "l0", "l1"), "lake_id")
    return both, curve.fit_metrics(both, ["lake_id"], F.col("l0") + F.col("l1") * (F.col("wse") - F.col("h_mean")), 2)


@query(f"WITH {METRICS} SELECT lake_id, n, round(rss, 2) AS rss, round(r_squared, 6) AS r_squared, round(bic, 3) AS bic, round(rmse, 5) AS rmse FROM me")
def fit_metrics(spark, sf_dir):
    m = _metrics(spark, sf_dir)[1]
    return m.select("lake_id", "n", r6("rss", digits=2), r6("r_squared"), r6("bic", digits=3), r6("rmse", digits=5))


@query(f"WITH {METRICS} SELECT lake_id, CASE WHEN r_squared > 0.7 AND n >= 5 AND wse_range > 1.0 AND l1 >= 0 THEN 'reliable' WHEN r_squared > 0.5 AND n >= 3 AND l1 >= 0 THEN 'acceptable' ELSE 'unreliable' END AS quality FROM me")
def curve_quality(spark, sf_dir):
    both, m = _metrics(spark, sf_dir)
    shape = both.groupBy("lake_id").agg((F.max("wse") - F.min("wse")).alias("wse_range"), F.min("wse").alias("low"), F.max("wse").alias("high"), F.any_value("l0").alias("l0"), F.any_value("l1").alias("l1"), F.any_value("h_mean").alias("h_mean"))
    samples = curve.curve_samples(F.col("low"), F.col("high"), lambda h: F.col("l0") + F.col("l1") * (h - F.col("h_mean")))
    return m.join(shape, "lake_id").select("lake_id", curve.grade(F.col("r_squared"), F.col("n"), F.col("wse_range"), curve.is_monotone(samples)).alias("quality"))


@query("""WITH k AS (SELECT p_partkey, (p_partkey % 50 - 25) / 10.0::DOUBLE AS a FROM part), s AS (SELECT p_partkey, i, a * (i * 10.0::DOUBLE / 199.0::DOUBLE) * (i * 10.0::DOUBLE / 199.0::DOUBLE) + 7.5::DOUBLE * (i * 10.0::DOUBLE / 199.0::DOUBLE) AS y FROM k, generate_series(0, 199) t(i))
SELECT p_partkey, bool_and(coalesce(step >= -1e-10, true)) AS monotonic FROM (SELECT p_partkey, y - lag(y) OVER (PARTITION BY p_partkey ORDER BY i) AS step FROM s) GROUP BY p_partkey""")
def monotonic_check(spark, sf_dir):
    a = (F.col("p_partkey") % 50 - 25) / 10.0
    samples = curve.curve_samples(F.lit(0.0), F.lit(10.0), lambda h: a * h * h + 7.5 * h)
    parts = v.table(spark, sf_dir, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)  # small rows, much work on each
    return parts.select("p_partkey", curve.is_monotone(samples).alias("monotonic"))


def _candidates(spark, sf_dir):
    return curve.fit_candidates(curve.with_sigma(_points(spark, sf_dir), ["lake_id"]))


@query()
def fit_nonlinear(spark, sf_dir):
    return _candidates(spark, sf_dir).where("reg_idx >= 2").select("lake_id", "function_type", "params", "param_errors", "r_squared", "bic", "rmse", "monotonic", "fitted")


CANDIDATES = """WITH c AS (SELECT (l_orderkey % 500)::VARCHAR AS lake_id, (l_linenumber - 1)::INT AS reg_idx, min(CASE WHEN l_quantity > 45 THEN 10.0::DOUBLE ELSE floor(l_extendedprice / 1000) END) AS bic, min(l_orderkey) % 3 = 0 AS monotonic, min(l_orderkey) % 7 <> 0 AS fitted FROM lineitem GROUP BY 1, 2)"""


@query(CANDIDATES + " SELECT lake_id, reg_idx, bic, monotonic, fitted FROM (SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY fitted DESC, fitted AND monotonic DESC, bic, reg_idx) AS r FROM c) WHERE r = 1")
def best_model(spark, sf_dir):
    """Of candidates as the fits give them, here from lineitem: with ties, and with lakes where none is monotone or fitted."""
    bic = F.when(F.col("l_quantity") > 45, 10.0).otherwise(F.floor(F.col("l_extendedprice") / 1000).cast("double"))
    rows = v.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 500).cast("string").alias("lake_id"), (F.col("l_linenumber") - 1).cast("int").alias("reg_idx"))
    candidates = rows.agg(F.min(bic).alias("bic"), (F.min("l_orderkey") % 3 == 0).alias("monotonic"), (F.min("l_orderkey") % 7 != 0).alias("fitted"))
    return curve.best_model(candidates, ["lake_id"])


@query(CANDIDATES + " SELECT lake_id, reg_idx, bic, monotonic, fitted FROM (SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY fitted DESC, fitted AND monotonic DESC, bic, reg_idx) AS r FROM c) WHERE r = 1")
def best_of_models(spark, sf_dir):
    """The same choice from one array a lake, as the curves make it."""
    bic = F.when(F.col("l_quantity") > 45, 10.0).otherwise(F.floor(F.col("l_extendedprice") / 1000).cast("double"))
    rows = v.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 500).cast("string").alias("lake_id"), (F.col("l_linenumber") - 1).cast("int").alias("reg_idx"))
    candidates = rows.agg(F.min(bic).alias("bic"), (F.min("l_orderkey") % 3 == 0).alias("monotonic"), (F.min("l_orderkey") % 7 != 0).alias("fitted"))
    models = candidates.groupBy("lake_id").agg(F.collect_list(F.struct("reg_idx", "bic", "monotonic", "fitted")).alias("models"))
    return models.select("lake_id", curve.best_of(F.col("models")).alias("m")).select("lake_id", "m.*")


@query()
def area_wse_curves(spark, sf_dir):
    return curve.area_level_curves(v.series(spark, sf_dir))


@query("""WITH c AS (SELECT CASE WHEN c_acctbal > 5000 THEN 'reliable' WHEN c_custkey % 3 = 0 THEN 'acceptable' ELSE 'none at all' END AS quality, c_mktsegment AS function_type FROM customer)
SELECT 'quality' AS kind, g AS value, count(quality) AS n FROM (VALUES ('reliable'), ('acceptable'), ('unreliable')) t(g) LEFT JOIN c ON quality = g GROUP BY g UNION ALL SELECT 'function', function_type, count(*) FROM c GROUP BY function_type""")
def curve_run_summary(spark, sf_dir):
    """Of a table of curves, here from customer, in which one grade does not occur."""
    quality = F.when(F.col("c_acctbal") > 5000, "reliable").when(F.col("c_custkey") % 3 == 0, "acceptable").otherwise("none at all")
    return curve.run_summary(v.table(spark, sf_dir, "customer").select(quality.alias("quality"), F.col("c_mktsegment").alias("function_type")))


# Continuity and outlines.


def _files(spark, sf_dir):
    g = naming.parse_filename(v.granules(spark, sf_dir)).withColumn("filename", F.substring_index("path", "/", -1))
    return continuity.first_files(g, ["003", "004", "005"], 10.0, 10.0)


FIRST = f"""WITH {v.GRANULES}, f1 AS (SELECT *, regexp_extract(path, '[^/]*$') AS filename, regexp_extract(path, '(PIC0|PIC2|PID0|PGC0)', 1) AS file_version FROM gp WHERE pass IN ('003', '004', '005') AND 10 BETWEEN lon_min AND lon_max AND 10 BETWEEN lat_min AND lat_max),
f2 AS (SELECT *, row_number() OVER (PARTITION BY file_version ORDER BY filename) AS rank FROM f1 WHERE file_version <> '' QUALIFY rank <= 3) """


@query(FIRST + "SELECT filename, file_version, rank::INT AS rank FROM f2")
def first_k_per_version(spark, sf_dir):
    return _files(spark, sf_dir).select("filename", "file_version", "rank")


@query(FIRST + "SELECT filename, file_version, CASE WHEN file_version = 'PID0' THEN 'D' ELSE 'C' END AS family FROM f2 WHERE file_version <> 'PGC0'")
def version_union(spark, sf_dir):
    return continuity.version_families(_files(spark, sf_dir)).select("filename", "file_version", "family")


REACH = f"""WITH RECURSIVE {v.CELL}, rc AS (SELECT raster_id, row, col, row * 100 + col AS seed FROM ce UNION SELECT c.raster_id, c.row, c.col, r.seed FROM rc r JOIN ce c ON c.raster_id = r.raster_id AND abs(c.row - r.row) + abs(c.col - r.col) = 1),
lb AS (SELECT raster_id, row, col, min(seed) AS s FROM rc GROUP BY ALL), cc AS (SELECT raster_id, row, col, dense_rank() OVER (PARTITION BY raster_id ORDER BY s)::INT AS component FROM lb) """


@query(REACH + "SELECT * FROM cc")
def connected_components(spark, sf_dir):
    return continuity.components(v.cells(spark, sf_dir))


@query(REACH + "SELECT raster_id, component, count(*) AS size, row_number() OVER (PARTITION BY raster_id ORDER BY count(*) DESC, component)::INT AS rank FROM cc GROUP BY raster_id, component")
def component_stats(spark, sf_dir):
    return continuity.component_sizes(continuity.components(v.cells(spark, sf_dir)))


@query(f"WITH {v.CELL} SELECT raster_id, count(*) AS n_valid, (max(row) - min(row) + 1)::INT AS height, (max(col) - min(col) + 1)::INT AS width, round(count(*) / ((max(row) - min(row) + 1) * (max(col) - min(col) + 1)), 6) AS fill_ratio FROM ce GROUP BY raster_id")
def fill_ratio(spark, sf_dir):
    return continuity.fill_ratio(v.cells(spark, sf_dir)).withColumn("fill_ratio", F.round("fill_ratio", 6))


HOLES = """, zs AS (SELECT raster_id, component, count(*) AS size FROM cc GROUP BY ALL), zr AS (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY size DESC, component) AS k FROM zs),
zb AS (SELECT raster_id, count(*) AS n_components, sum(size)::BIGINT AS n_valid, list(size ORDER BY k) FILTER (k <= 5) AS largest FROM zr GROUP BY raster_id), zm AS (SELECT cc.raster_id, row, col FROM cc JOIN zr ON zr.raster_id = cc.raster_id AND zr.component = cc.component AND k = 1),
zx AS (SELECT raster_id, min(row) - 1 AS r0, max(row) + 1 AS r1, min(col) - 1 AS c0, max(col) + 1 AS c1 FROM zm GROUP BY raster_id), zf AS (SELECT zx.raster_id, r::INT AS row, c::INT AS col, r = r0 AND c = c0 AS corner FROM zx, range(-1, 14) a(r), range(-1, 14) b(c) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 AND NOT EXISTS (SELECT 1 FROM zm WHERE zm.raster_id = zx.raster_id AND zm.row = r AND zm.col = c)),
zo AS (SELECT raster_id, row, col FROM zf WHERE corner UNION SELECT f.raster_id, f.row, f.col FROM zo o JOIN zf f ON f.raster_id = o.raster_id AND abs(f.row - o.row) + abs(f.col - o.col) = 1)
SELECT zb.raster_id, n_components, n_valid, largest, (SELECT count(*) FROM zf WHERE zf.raster_id = zb.raster_id) - (SELECT count(*) FROM zo WHERE zo.raster_id = zb.raster_id) AS hole_cells, round(largest[1] / n_valid, 6) AS largest_share FROM zb"""


@query(REACH.rstrip() + HOLES)
def continuity_report(spark, sf_dir):
    return continuity.continuity(v.cells(spark, sf_dir)).withColumn("largest_share", F.round("largest_share", 6))


@query(f"""WITH {v.CELL}, ed AS (SELECT raster_id, row AS r0, col AS c0, row AS r1, col + 1 AS c1 FROM ce UNION ALL SELECT raster_id, row, col + 1, row + 1, col + 1 FROM ce UNION ALL SELECT raster_id, row + 1, col + 1, row + 1, col FROM ce UNION ALL SELECT raster_id, row + 1, col, row, col FROM ce)
SELECT raster_id, min(r0) AS r0, min(c0) AS c0, min(r1) AS r1, min(c1) AS c1 FROM ed GROUP BY raster_id, least(r0, r1), least(c0, c1), greatest(r0, r1), greatest(c0, c1) HAVING count(*) = 1""")
def outline_edges(spark, sf_dir):
    return outline.outline_edges(v.cells(spark, sf_dir), ["raster_id"])


@query(f"WITH {v.CELL} SELECT raster_id, count(*) * 10000.0::DOUBLE AS area FROM ce GROUP BY raster_id")
def outline_areas(spark, sf_dir):
    rings = outline.outlines(v.cells(spark, sf_dir), "raster_id", 0.0, 1200.0)
    return rings.select("raster_id", F.round(geo.polygon_area(F.col("rings")), 6).alias("area"))


# Vector product.


@query(f"WITH {v.VECTOR} SELECT quality_f::SMALLINT AS quality_f, ice_clim_f::INT AS ice_clim_f, count(*) AS n FROM vu GROUP BY ALL")
def lakesp_quality_ice(spark, sf_dir):
    return lakesp.usable(v.vector_obs(spark, sf_dir)).groupBy("quality_f", "ice_clim_f").agg(F.count("*").alias("n"))


@query(f"WITH {v.VECTOR} SELECT lake_id, obs_date, pass, round(sum(wse / (uncertainty * uncertainty)) / sum(1.0::DOUBLE / (uncertainty * uncertainty)), 4) AS wse, round(1.0::DOUBLE / sqrt(sum(1.0::DOUBLE / (uncertainty * uncertainty))), 4) AS uncertainty, count(*) AS n_features, round(avg(area), 4) AS area FROM vu GROUP BY ALL")
def lakesp_weighted_mean(spark, sf_dir):
    return _rounded(lakesp.weighted_mean(lakesp.usable(v.vector_obs(spark, sf_dir))), ("wse", "uncertainty", "area"))


@query(f"WITH {v.VECTOR} SELECT lake_id, count(*) AS n_obs, count(DISTINCT obs_date) AS n_dates FROM vu WHERE lake_id IS NOT NULL GROUP BY lake_id")
def lakesp_counts(spark, sf_dir):
    return lakesp.observations_per_lake(lakesp.usable(v.vector_obs(spark, sf_dir)))


@query(f"WITH {v.VECTOR} SELECT CASE WHEN lake_id IS NULL THEN 'unassigned' ELSE 'assigned' END AS assignment, count(*) AS n FROM vu GROUP BY 1")
def lakesp_split(spark, sf_dir):
    return lakesp.split_assigned(lakesp.usable(v.vector_obs(spark, sf_dir)))


@query(f"WITH {v.PX}, s AS (SELECT lake_id, obs_date, count(wse) > 5 AS ok FROM pq GROUP BY ALL) SELECT count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS skipped, round(count(*) FILTER (ok) * 100.0::DOUBLE / count(*), 6) AS success_rate FROM s")
def run_statistics(spark, sf_dir):
    steps = v.good_pixels(spark, sf_dir).groupBy("lake_id", "obs_date").agg((F.count("wse") > 5).alias("ok"))
    return audit.run_stats(steps).withColumn("success_rate", F.round("success_rate", 6))
