"""Operators on hand-made tables; each odd rule that decides results is pinned by one test."""

import json
import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hydroseries.config import FLOAT_FILL, CurveConfig, FilterConfig, QualityConfig
from hydroseries.functions import geo, naming
from hydroseries.functions.missing import fill_to_null, nodata_to_null, with_valid_mask
from hydroseries.operators import audit, clip, continuity, curve, lakesp, mosaic, outline, quality, reproject, timeseries, wse_filter
from hydroseries.plans import connectivity, explorer, projection
from hydroseries.plans.queries import QUERIES
from hydroseries.plans.run import merge, run, split_malformed
from hydroseries.sources import readers, writers
from hydroseries.streaming.daily import daily_levels

NAN = float("nan")


def test_fill_and_nan_become_null(spark):
    df = spark.createDataFrame([(1.0,), (FLOAT_FILL,), (NAN,), (None,)], "wse double")
    assert [r.wse for r in fill_to_null(df).collect()] == [1.0, None, None, None]
    floats = spark.createDataFrame([(1.0,), (9.96921e36,)], "wse float")
    assert [r.wse for r in fill_to_null(floats).collect()] == [1.0, None]
    assert [r.v for r in spark.createDataFrame([(5.0,), (-9999.0,), (-9995.0,)], "x double").select(nodata_to_null(F.col("x")).alias("v")).collect()] == [5.0, None, None]


def test_valid_mask_by_type(spark):
    for kind, values, want in (("short", [0, 255], [True, False]), ("bigint", [0, 4294967295], [True, False]), ("int", [0, 3], [False, True]), ("string", ["", None], [True, False])):
        df = spark.createDataFrame([(v,) for v in values], f"wse {kind}")
        assert [r.valid_mask for r in with_valid_mask(df).collect()] == want
    with pytest.raises(ValueError):
        with_valid_mask(spark.range(1))


def test_quality_edges(spark):
    base = dict(wse_qual=0, water_area_qual=0, cross_track=20000.0, wse_uncert=1.0, ice_clim_flag=0)
    cases = [
        ({}, True), ({"wse_qual": 2}, True), ({"wse_qual": 3}, False), ({"wse_qual": 255}, False), ({"wse_qual": None}, False), ({"cross_track": 10000.0}, True), ({"cross_track": -10000.0}, True), ({"cross_track": 9999.9}, False),
        ({"cross_track": NAN}, False), ({"cross_track": 1e10}, False), ({"cross_track": None}, False), ({"wse_uncert": 2.0}, True), ({"wse_uncert": 2.0001}, False), ({"wse_uncert": -0.1}, True), ({"wse_uncert": None}, False), ({"ice_clim_flag": 1}, True),
    ]
    rows = [tuple({**base, **c}.values()) for c, _ in cases]
    df = spark.createDataFrame(rows, "wse_qual short, water_area_qual short, cross_track double, wse_uncert double, ice_clim_flag short").withColumn("wse", F.lit(5.0))
    assert [r.quality_mask for r in quality.apply_quality(df).collect()] == [k for _, k in cases]
    strict = quality.apply_quality(df, QualityConfig(skip_ice_filter=False)).collect()
    assert not strict[-1].quality_mask and strict[0].quality_mask
    once = quality.apply_quality(df)
    assert quality.apply_quality(once).select("wse").collect() == once.select("wse").collect()


def test_quality_statistics_are_independent_and_may_pass_100_percent(spark):
    df = spark.createDataFrame([(None, 0, 0), (1.0, 0, 3), (2.0, 3, 0)], "wse double, wse_qual short, water_area_qual short").withColumn("k", F.lit(1))
    row = quality.quality_stats(df, ["k"]).first()
    assert (row.initial, row.after_wse_qual, row.after_water_area_qual, row.final, row.final_wse_mean) == (2, 2, 2, 1, None)
    all_null = quality.quality_stats(df.where("wse IS NULL"), ["k"]).first()
    assert all_null.retention == 100.0 and "initial pixels: 0" in quality.summary_text(all_null.asDict())


def mosaic_of(spark, rows):
    df = spark.createDataFrame([("g", s, 0, 0, w, u) for s, w, u in rows], "group_id string, granule_id string, cell_row int, cell_col int, wse double, wse_uncert double")
    return mosaic.mosaic(df).first()


def test_mosaic_cases(spark):
    r = mosaic_of(spark, [("a", 10.0, 1.0), ("b", 12.0, 1.0)])
    assert r.wse == pytest.approx(11.0) and r.wse_uncert == pytest.approx(0.7071067811)
    r = mosaic_of(spark, [("a", 10.0, 1.0), ("b", 12.0, 2.0)])
    assert r.wse == pytest.approx(10.4) and r.wse_uncert == pytest.approx(0.894427191)
    r = mosaic_of(spark, [("a", 10.0, 1.0), ("b", None, 1.0)])
    assert (r.wse, r.wse_uncert) == (10.0, 1.0)
    r = mosaic_of(spark, [("a", 10.0, 0.0), ("b", 11.0, None)])
    assert (r.wse, r.wse_uncert) == (None, None)
    r = mosaic_of(spark, [("a", 10.0, -1.0)])  # one source passes through, whatever its sigma
    assert (r.wse, r.wse_uncert) == (10.0, -1.0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(-100, 100), st.floats(0.01, 2)), min_size=2, max_size=5), st.randoms())
def test_mosaic_is_a_mean_in_any_order(spark, values, random):
    rows = [(str(i), a, b) for i, (a, b) in enumerate(values)]
    one = mosaic_of(spark, rows)
    random.shuffle(rows)
    two = mosaic_of(spark, rows)
    assert one.wse == pytest.approx(two.wse, abs=1e-9)
    assert min(a for a, _ in values) - 1e-9 <= one.wse <= max(a for a, _ in values) + 1e-9
    assert one.wse_uncert <= min(b for _, b in values) + 1e-12


def test_offsets_snap_half_to_even(spark):
    rows = [("g", f"{i}", 100.0 * x, 0.0, 100.0 * x + 200, 200.0, 100.0, 100.0) for i, x in enumerate((0, 0.4, 0.5, 0.6, 1.5))]
    out = mosaic.grid_offsets(spark.createDataFrame(rows, "group_id string, granule_id string, minx double, miny double, maxx double, maxy double, res_x double, res_y double")).orderBy("granule_id").collect()
    assert [r.col_off for r in out] == [0, 0, 0, 1, 2] and out[0].width == 4 and out[0].height == 2


def test_same_day_single_source_passes_through_and_names_are_sorted(spark):
    schema = "lake_id string, obs_date string, group_id string, cell_row int, cell_col int, wse double, wse_uncert double, water_frac double"
    df = spark.createDataFrame([("1", "d", "b", 0, 0, 10.0, 1.0, 0.5), ("1", "d", "a", 0, 0, 12.0, 1.0, 0.7), ("1", "d", "a", 0, 1, None, 1.0, 0.9), ("2", "d", "a", 0, 0, 9.0, 0.0, 0.1)], schema)
    out = {(r.lake_id, r.cell_col): r for r in timeseries.merge_same_day(df).collect()}
    assert out["1", 0].wse == pytest.approx(11.0) and out["1", 0].water_frac == pytest.approx(0.6) and out["1", 0].sources == "a,b"
    assert out["1", 1].water_frac is None  # water_frac counts only where wse is there
    assert (out["2", 0].wse, out["2", 0].wse_uncert) == (9.0, 0.0)


def test_statistics_rules(spark):
    rows = [("1", "d", 10.0, 1.0), ("1", "d", 12.0, 1.0), ("1", "d", 50.0, 1000.0), ("2", "d", 1.0, None), ("2", "d", 2.0, 0.0), ("2", "d", 6.0, None)]
    out = {r.lake_id: r for r in timeseries.lake_statistics(spark.createDataFrame(rows, "lake_id string, obs_date string, wse double, wse_uncert double")).collect()}
    a, b = out["1"], out["2"]
    assert (a.wse, a.wse_med, a.wse_std, a.valid_pixels) == (11.0, 12.0, 1.0, 3) and a.wse_uncert == pytest.approx(math.sqrt(0.5))
    assert (b.wse, b.wse_med) == (2.0, 2.0) and b.wse_uncert == pytest.approx(1.482) and b.wse_std == pytest.approx(np.std([1, 2, 6]))


def lake_days(spark, values, day="d"):
    return spark.createDataFrame([("1", day, v, 0.5) for v in values], "lake_id string, obs_date string, wse double, water_frac double")


def test_mad_filter(spark):
    same = wse_filter.mad_filter(lake_days(spark, [5.0] * 12)).first()
    assert (same.scaled_mad, same.wse_lower, same.wse_upper, same.valid_pixels_filtered) == (0.0, 5.0, 5.0, 12)
    assert not wse_filter.mad_filter(lake_days(spark, [5.0] * 9)).collect()
    assert not wse_filter.mad_filter(lake_days(spark, [float(i) for i in range(12)])).collect()  # too few left within half a metre
    wide = wse_filter.mad_bounds(lake_days(spark, [float(i) for i in range(12)])).first()
    assert wide.wse_upper - wide.wse_lower == 1.0
    zero_k = wse_filter.mad_bounds(lake_days(spark, [0.0, 0.1, 0.2]), cfg=FilterConfig(mad_k=0.0)).first()
    assert zero_k.wse_upper > zero_k.wse_median
    series = spark.createDataFrame([("1", "d", 1.0, "b"), ("1", "d", 2.0, "a")], "lake_id string, date string, wse double, granule_id string")
    joined = wse_filter.with_summary(wse_filter.mad_filter(lake_days(spark, [5.0] * 12)), series).first()
    assert (joined.wse, joined.granule_id) == (2.0, "a") and joined.filter_retention == 100.0


def test_names(spark):
    good = "/x/SAT_L2_HR_Raster_100m_UTM01C_N_x_x_x_034_287_002F_20250618T233535_20250618T233556_PID0_01.nc"
    bad_time = good.replace("20250618T233535", "2025XX18T000000")
    df = spark.createDataFrame([(good,), (bad_time,), ("/x/SAT_L2_HR.nc",)], "path string")
    a, b, c = naming.parse_filename(df).collect()
    assert (a.product, a.cycle, a["pass"], a.scene, a.crid, a.version, a.group_id, str(a.obs_date)) == ("SAT_L2_HR_Raster", "034", "287", "002F", "PID0", "01", "034_287_PID0", "2025-06-18")
    assert b.obs_date is None and b.group_id == "034_287_PID0"
    assert (c.cycle, c.group_id) == (None, "None_None_None")
    ok, errors = split_malformed(df)
    assert ok.count() == 1 and errors.count() == 2


def test_zone_texts(spark):
    texts = ["WGS 84 / UTM zone 46N", "EPSG:32646", "epsg 32701", "EPSG:4326", None, "UTM ZONE 01S"]
    out = [r.z for r in spark.createDataFrame([(t,) for t in texts], "t string").select(naming.utm_zone_of_text(F.col("t")).alias("z")).collect()]
    assert out == ["46N", "46N", "1S", None, None, "1S"]
    boxes = spark.createDataFrame([(179.0, 1.0, 181.0, 3.0), (90.0, -3.0, 92.0, -1.0)], "a double, b double, c double, d double")
    assert [r.e for r in boxes.select(naming.utm_epsg_of_bounds(*[F.col(c) for c in "abcd"]).alias("e")).collect()] == [32661, 32746]
    short = spark.createDataFrame([("UTM01",), ("UTM46R",), ("LL01C",)], "g string").select(naming.utm_grid(F.col("g"))[0].alias("z"), naming.epsg_of_grid(F.col("g")).alias("e")).collect()
    assert [tuple(r) for r in short] == [(None, None), ("46", "EPSG:32646"), (None, None)]


def test_projection_known_point_and_round_trip(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "lon double, lat double")
    x, y = geo.utm_forward(F.col("lon"), F.col("lat"), F.lit(32631))
    r = df.select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(166021.443, abs=1e-3) and r.y == pytest.approx(0.0, abs=1e-6)
    pts = spark.createDataFrame([(lon / 1.0, lat / 1.0) for lon in range(84, 103, 3) for lat in (-30, 25, 33, 40)], "lon double, lat double").withColumn("s", F.when(F.col("lat") < 0, 32746).otherwise(32646))
    back = geo.from_utm(geo.to_utm(pts, "lon", "lat", F.col("s"), "x", "y"), "x", "y", F.col("s"), "lon2", "lat2").collect()
    assert all(abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8 for r in back)
    box = spark.createDataFrame([(91.0, 30.0, 92.0, 31.0)], "a double, b double, c double, d double").select(geo.transform_box([F.col(c) for c in "abcd"], F.lit(32646)).alias("b")).first().b
    assert box.minx < 310000 and 400000 < box.maxx < 405000 and box.miny < box.maxy


def test_lonlat_box_reaches_the_scan(spark, tmp_path):
    """The scan gets four comparisons; what stays is just what is in the box, points close to its curved edges too."""
    rng = np.random.default_rng(4)
    box = (85.0, 40.0, 101.0, 55.0)
    near = [(float(x), float(y)) for x in rng.uniform(85.0, 101.0, 300) for y in (40.0 + 1e-7, 40.0 - 1e-7, 55.0 - 1e-7, 55.0 + 1e-7)] + [(float(a), float(y)) for y in rng.uniform(40.0, 55.0, 300) for a in (85.0 + 1e-7, 85.0 - 1e-7, 101.0 - 1e-7, 101.0 + 1e-7)]
    points = geo.to_utm(spark.createDataFrame(near, "lon double, lat double"), "lon", "lat", F.lit(32646), "x", "y")
    points.write.parquet(f"{tmp_path}/points")
    out = geo.filter_lonlat_box(spark.read.parquet(f"{tmp_path}/points"), box, 32646)
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    pushed = out._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1].split("]")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(f"{c}(x," in pushed and f"{c}(y," in pushed for c in ("GreaterThanOrEqual", "LessThanOrEqual"))
    got = {(r.lon, r.lat) for r in out.collect()}
    assert got == {(a, b) for a, b in near if 85.0 <= a <= 101.0 and 40.0 <= b <= 55.0} and len(got) == 1200


def test_equal_area_of_a_degree_cell(spark):
    lon, lat = 95.0, 40.0
    got = spark.range(1).select(geo.equal_area(geo.box_polygon(F.lit(lon), F.lit(lat), F.lit(lon + 0.01), F.lit(lat + 0.01))).alias("a")).first().a
    s = math.sin(math.radians(lat + 0.005))
    m = geo.A * (1 - geo.E2) / (1 - geo.E2 * s * s) ** 1.5
    n = geo.A / math.sqrt(1 - geo.E2 * s * s) * math.cos(math.radians(lat + 0.005))
    assert got == pytest.approx(m * n * math.radians(0.01) ** 2, rel=1e-5)


SQUARE = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
HOLED = [*SQUARE, [(4.0, 4.0), (4.0, 6.0), (6.0, 6.0), (6.0, 4.0)]]


def lakes_of(spark, rows):
    shaped = [(i, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for i, rings in rows]
    return readers.with_box(spark.createDataFrame(shaped, f"lake_id string, rings {readers.RINGS}"))


def test_clip(spark):
    points = spark.createDataFrame([(1, 0, 5.0, 5.0), (2, 0, 1.0, 1.0), (3, 0, 11.0, 5.0), (4, 0, 105.0, 5.0)], "row int, col int, x double, y double")
    parts = [("a", SQUARE), ("a", [[(100.0, 0.0), (110.0, 0.0), (110.0, 10.0)]]), ("h", HOLED), ("far", [[(1e6, 1e6), (1e6 + 1, 1e6), (1e6, 1e6 + 1)]])]
    out = sorted((r.lake_id, r.row) for r in clip.clip_to_lakes(points, lakes_of(spark, parts), tile=7.0).collect())
    assert out == [("a", 1), ("a", 2), ("a", 4), ("h", 2)]
    near = sorted((r.lake_id, r.row) for r in clip.clip_to_lakes(points, lakes_of(spark, [("h", HOLED)]), buffer_meters=1.0, tile=7.0).collect())
    assert near == [("h", 1), ("h", 2), ("h", 3)]
    twice = clip.clip_to_lakes(points, lakes_of(spark, [("a", SQUARE), ("a", SQUARE)]))
    assert twice.count() == 2


def test_boxes_that_touch_overlap(spark):
    granules = spark.createDataFrame([("t", 10.0, 0.0, 20.0, 10.0), ("far", 10.1, 0.0, 20.0, 10.0)], "granule_id string, minx double, miny double, maxx double, maxy double")
    assert [r.granule_id for r in clip.granules_in_area(granules, lakes_of(spark, [("a", SQUARE)])).collect()] == ["t"]
    ids = clip.with_lake_ids(lakes_of(spark, [("a", SQUARE), ("b", HOLED)]).drop("lake_id"))
    assert sorted(r.lake_id for r in ids.collect()) == ["lake_0", "lake_1"]


def cells_of(spark, cells, name="r"):
    return spark.createDataFrame([(name, r, c) for r, c in cells], "raster_id string, row int, col int")


def test_components_and_outlines(spark):
    ring = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    row = continuity.continuity(cells_of(spark, ring)).first()
    assert (row.n_components, row.n_valid, row.hole_cells, row.largest) == (1, 8, 1, [8])
    assert continuity.fill_ratio(cells_of(spark, ring)).first().fill_ratio == pytest.approx(8 / 9)
    diagonal = cells_of(spark, [(0, 0), (1, 1)])
    assert continuity.continuity(diagonal).first().n_components == 2
    assert outline.outline_edges(cells_of(spark, [(0, 0)]), ["raster_id"]).count() == 4
    assert outline.outline_edges(cells_of(spark, [(0, 0), (1, 0), (1, 1)]), ["raster_id"]).count() == 8
    shapes = outline.outlines(cells_of(spark, ring), "raster_id", 0.0, 300.0)
    got = shapes.select(geo.polygon_area(F.col("rings")).alias("a"), F.size("rings").alias("n"), outline.rings_to_wkt(F.col("rings")).alias("w")).first()
    assert (got.a, got.n) == (80000.0, 2) and got.w.startswith("MULTIPOLYGON (((")
    assert len(outline.outlines(diagonal, "raster_id").first().rings) == 2
    assert continuity.components(cells_of(spark, [])).count() == 0


def curve_table(spark, h, area, sigma=0.1):
    return spark.createDataFrame([("1", float(a), sigma, float(b) * 1e6) for a, b in zip(h, area, strict=True)], "lake_id string, wse double, wse_uncert double, water_area double")


def test_curves(spark):
    h = np.linspace(4800, 4805, 30)
    line = curve.area_level_curves(curve_table(spark, h, 3 * (h - 4790))).first()
    assert (line.function_type, line.quality, line.n_cleaned) == ("linear", "reliable", 30) and line.r_squared == pytest.approx(1.0)
    bent = curve.area_level_curves(curve_table(spark, h, (h - 4790) ** 2)).first()
    assert bent.function_type in ("quadratic", "power") and bent.quality == "reliable"
    falling = curve.area_level_curves(curve_table(spark, h, 100 - 3 * (h - 4790))).first()
    assert falling.quality == "unreliable"
    few = curve.area_level_curves(curve_table(spark, [4800, 4801], [1, 2])).first()
    assert (few.function_type, few.params_json, few.quality, few.wse_range) == ("none", "{}", "unreliable", 0.0)
    flat = curve.area_level_curves(curve_table(spark, h, np.full(30, 5.0))).first()
    assert flat.r_squared == 0.0
    spoilt = curve_table(spark, [*h, -9999.0, 0.0, -5.0], [*(3 * (h - 4790)), 1, 1, 1])
    assert curve.area_level_curves(spoilt).first().n_obs == 30


def test_strict_grades_and_model_choice(spark):
    g = spark.createDataFrame([(0.7, 9, 2.0, True), (0.71, 9, 1.0, True), (0.71, 5, 1.1, True), (0.9, 9, 9.0, False)], "r double, n int, w double, m boolean").select(curve.grade(F.col("r"), F.col("n"), F.col("w"), F.col("m")).alias("g")).collect()
    assert [r.g for r in g] == ["acceptable", "acceptable", "reliable", "unreliable"]
    c = spark.createDataFrame([("a", 1.0, False, True, 0), ("a", 2.0, True, True, 1), ("a", 2.0, True, True, 2), ("b", 5.0, False, True, 0), ("b", 4.0, False, True, 1)], "k string, bic double, monotonic boolean, fitted boolean, reg_idx int")
    assert {r.k: r.reg_idx for r in curve.best_model(c, ["k"]).collect()} == {"a": 1, "b": 1}


def test_iqr_keeps_all_without_spread(spark):
    df = spark.createDataFrame([("1", v) for v in (1.0, 1.0, 1.0, 1.0, 99.0)], "lake_id string, area double")
    assert curve.iqr_clean(df, ["lake_id"], "area").count() == 5
    df = spark.createDataFrame([("1", float(v)) for v in (1, 2, 3, 4, 99)], "lake_id string, area double")
    assert curve.iqr_clean(df, ["lake_id"], "area").count() == 4


def test_reprojection_moves_pixels_by_less_than_a_pixel(spark):
    granule = spark.createDataFrame([("g", 32645, 700000.0, 3300000.0, 700500.0, 3300500.0, 100.0, 100.0)], "granule_id string, srid int, minx double, miny double, maxx double, maxy double, res_x double, res_y double")
    px = spark.createDataFrame([("g", r, c, 700050.0 + 100 * c, 3300450.0 - 100 * r, float(10 * r + c)) for r in range(5) for c in range(5)], "granule_id string, row int, col int, x double, y double, wse double")
    out = reproject.reproject_nearest(px, granule, 32646)
    assert {r.wse for r in out.collect()} == {float(10 * r + c) for r in range(5) for c in range(5)}
    back = geo.to_utm(out, "longitude", "latitude", F.lit(32645), "bx", "by").join(px.select("wse", F.col("x").alias("ox"), F.col("y").alias("oy")), "wse")
    assert all(abs(r.bx - r.ox) < 80 and abs(r.by - r.oy) < 80 for r in back.collect())
    same = reproject.reproject_nearest(px, granule, 32645)
    assert same.count() == 25


def test_every_customer_is_reprojected(spark, tmp_path):
    spark.range(1, 8).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    out = QUERIES["reproject_nearest"](spark, f"file://{tmp_path}")
    found = {r.granule_id: r["count"] for r in out.groupBy("granule_id").count().collect()}
    assert set(found) == {str(k) for k in range(1, 8)} and all(found[str(k)] == 120 for k in (2, 4, 6)) and all(110 < found[str(k)] < 130 for k in (1, 3, 5, 7))


def test_vector_product(spark):
    rows = [("1", "d", "p", 10.0, 1.0, 5.0, 2, 0), ("1", "d", "p", 12.0, 1.0, 7.0, 0, -999), ("1", "d", "p", 99.0, 1.0, 7.0, 3, 0), (None, "d", "p", 1.0, 1.0, 1.0, 0, 0), ("1", "d", "p", 9.0, 1.0, 7.0, 0, 1)]
    obs = lakesp.usable(spark.createDataFrame(rows, "lake_id string, obs_date string, pass string, wse double, uncertainty double, area double, quality_f short, ice_clim_f int"))
    assert {(r.lake_id, r.wse) for r in lakesp.weighted_mean(obs).collect()} == {("1", 11.0), (None, 1.0)}
    assert {(r.assignment, r.n) for r in lakesp.split_assigned(obs).collect()} == {("assigned", 2), ("unassigned", 1)}
    assert lakesp.observations_per_lake(obs).first().n_obs == 2


def test_reports(spark):
    df = spark.createDataFrame([("a", "g", "46N"), ("b", "g", "45N"), ("c", "h", None)], "granule_id string, group_id string, content_zone string")
    groups = audit.crs_consistency(df)
    assert "inconsistent: 1" in audit.projection_report(groups) and "g: 45N, 46N" in audit.projection_report(groups)
    profile = audit.variable_profile(spark.createDataFrame([(1.0, "x"), (NAN, None)], "wse double, name string"), ["wse", "name"])
    assert "| wse | 1 | 1 | 1 | 1 | 1 | 0 |" in audit.profile_report(profile, "t")


def test_sources_and_sinks(spark, tmp_path):
    import struct

    shp = bytearray(100)
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i", 5, 0, 0, 1, 1, 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    shp += struct.pack(">2i", 1, len(body) // 2) + body
    dbf = bytearray(struct.pack("<4BIHH20x", 3, 25, 1, 1, 1, 65, 8)) + b"lake_id\0\0\0\0C" + bytes(4) + bytes([7]) + bytes(15) + b"\x0d" + b" 42     "
    (tmp_path / "shapes").mkdir()
    (tmp_path / "shapes/l.shp").write_bytes(bytes(shp))
    (tmp_path / "shapes/l.dbf").write_bytes(bytes(dbf))
    row = readers.read_shapefiles(spark, f"file://{tmp_path}/shapes").first()
    assert row.attributes == {"lake_id": "42"} and (row.maxx, row.srid) == (1.0, 4326) and len(row.rings[0]) == 4
    (tmp_path / "lakes.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id_unified":"7"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,0]]]]}}]}')
    lake = readers.read_lakes_geojson(spark, f"file://{tmp_path}/lakes.json").first()
    assert (lake.lake_id, lake.maxy) == ("7", 2.0)
    assert readers.scan_files(spark, f"file://{tmp_path}/shapes", "*.shp").count() == 1
    series = spark.createDataFrame([("1", "2024-01-02", 5.0), ("1", "2024-01-01", 4.0)], "lake_id string, date string, wse double")
    assert '"total_observations":2' in writers.statistics_json(series).first().value
    assert readers.lakes_to_read(spark.createDataFrame([("10",), ("2",), ("2",)], "lake_id string"), most=1).first().lake_id == "10"
    with pytest.raises(ValueError):
        readers.select_variables(spark.range(1), ["wse"])
    shapes = outline.outlines(cells_of(spark, [(0, 0)]), "raster_id")
    assert '"type":"MultiPolygon"' in writers.outlines_geojson(shapes, ["raster_id"]).first().value


def test_pipeline_end_to_end(spark, tmp_path):
    name = "SAT_L2_HR_Raster_100m_UTM46N_N_x_x_x_034_287_{}F_20250618T233535_20250618T233556_PID0_01"
    granules = [(f"/d/{name.format(i)}.nc", 0.0 + 500 * k, 0.0, 1000.0 + 500 * k, 1000.0, 100.0, 100.0) for k, i in enumerate(("001", "002"))]
    unknown = (f"/d/{name.format('003')}.nc", 0.0, 0.0, 1000.0, 1000.0, 100.0, 100.0)
    table = spark.createDataFrame([*granules, ("/d/bad.nc", 0.0, 0.0, 1.0, 1.0, 100.0, 100.0), unknown], "path string, minx double, miny double, maxx double, maxy double, res_x double, res_y double")
    table.withColumn("crs_wkt", F.when(~F.col("path").contains("003F"), "EPSG:32646")).write.parquet(f"{tmp_path}/raw/granules")
    px = [(name.format(i), r, c, 10.0 + k, 1.0, 0.5, 0, 0, 20000.0) for k, i in enumerate(("001", "002")) for r in range(10) for c in range(10)]
    spark.createDataFrame(px, "granule_id string, row int, col int, wse double, wse_uncert double, water_frac double, wse_qual short, water_area_qual short, cross_track double").write.parquet(f"{tmp_path}/raw/pixels")
    lakes_of(spark, [("1", [[(0.0, 0.0), (1500.0, 0.0), (1500.0, 1000.0), (0.0, 1000.0)]])]).withColumn("srid", F.lit(32646)).write.parquet(f"{tmp_path}/lakes")
    run(spark, "all", f"{tmp_path}/lakes", f"{tmp_path}/raw", f"{tmp_path}/out")
    row = readers.read_series(spark, f"{tmp_path}/out/summary/lake_timeseries.csv").first()
    assert (row.lake_id, row.valid_pixels, row.water_area, row.granule_id) == ("1", 150, 1.5e6, "034_287_PID0")
    assert row.wse == pytest.approx((50 * 10 + 50 * 2 * 10.5 + 50 * 11) / 200)
    errors = {r.error for r in spark.read.json(f"{tmp_path}/out/errors").collect()}
    assert errors == {"malformed file name", "no UTM projection: unknown"}
    out = f"{tmp_path}/out"
    figures = {(r.stage, r.figure): r.value for r in spark.read.parquet(f"{out}/statistics").collect()}
    assert figures["merge", "granules"] == 4 and figures["merge", "merged_groups"] == figures["clip", "lakes_with_series"] == figures["filter", "filtered"] == 1 and figures["filter", "mean_retention"] > 0
    shape = json.loads(spark.read.text(f"{out}/outlines").first().value)
    assert shape["properties"]["lake_id"] == "1" and sorted({tuple(p) for p in shape["geometry"]["coordinates"][0][0]}) == [(0.0, 0.0), (0.0, 1000.0), (1500.0, 0.0), (1500.0, 1000.0)]
    kept = spark.read.parquet(f"{out}/lake_pixels_filtered")
    assert kept.where("wse IS NOT NULL").count() == spark.read.option("header", True).csv(f"{out}/summary/lake_timeseries_filtered.csv").select(F.col("valid_pixels_filtered").cast("int")).first()[0]
    assert spark.read.text(f"{out}/outlines_filtered").count() == 1 and {r.kind for r in spark.read.parquet(f"{out}/curves/plots").select("kind").distinct().collect()} == {"raw", "cleaned"}
    scopes = [json.loads(r.value) for r in spark.read.text(f"{out}/summary/statistics.json").collect()]
    assert {"all"} == {x["scope"] for x in scopes if "scope" in x} and len(scopes) == 2
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/summary/lake_timeseries_filtered.csv").count() == 1
    with pytest.raises(ValueError):
        run(spark, "none", "", "", "")
    assert merge is not None


def test_zones_and_lonlat_lakes_meet(spark, tmp_path):
    """Two granules of one pass in zones 45 and 46 see one lake that is given in degrees."""
    west, east, south, north = 90.02, 90.05, 30.0, 30.02
    name = "SAT_L2_HR_Raster_100m_UTM{}N_N_x_x_x_034_287_00{}F_20250618T233535_20250618T233556_PID0_01"
    granules, px = [], []
    for k, (zone, level) in enumerate(((45, 10.0), (46, 12.0))):
        x, y = geo.utm_forward(F.lit((west + east) / 2), F.lit((south + north) / 2), F.lit(32600 + zone))
        at = spark.range(1).select(F.floor(x / 100), F.floor(y / 100)).first()
        minx, miny = (at[0] - 30) * 100.0, (at[1] - 30) * 100.0
        granules.append((f"/d/{name.format(zone, k)}.nc", minx, miny, minx + 6000, miny + 6000, 100.0, 100.0, f"WGS 84 / UTM zone {zone}N"))
        px += [(name.format(zone, k), r, c, minx + (c + 0.5) * 100, miny + 6000 - (r + 0.5) * 100, level, 1.0, 0.5, 0, 0, 20000.0) for r in range(60) for c in range(60)]
    spark.createDataFrame(granules, "path string, minx double, miny double, maxx double, maxy double, res_x double, res_y double, crs_wkt string").write.parquet(f"{tmp_path}/raw/granules")
    spark.createDataFrame(px, "granule_id string, row int, col int, x double, y double, wse double, wse_uncert double, water_frac double, wse_qual short, water_area_qual short, cross_track double").write.parquet(f"{tmp_path}/raw/pixels")
    ring = [[west, south], [west, north], [east, north], [east, south], [west, south]]
    (tmp_path / "lakes.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"lake_id": i}, "geometry": {"type": "Polygon", "coordinates": [[[x + d, y] for x, y in ring]]}} for i, d in (("7", 0.0), ("8", 5.0))]}))
    run(spark, "all", f"file://{tmp_path}/lakes.geojson", f"{tmp_path}/raw", f"{tmp_path}/out", lake_ids=["7"])
    rows = readers.read_series(spark, f"{tmp_path}/out/summary/lake_timeseries.csv").collect()
    km2 = spark.range(1).select(geo.equal_area(geo.box_polygon(F.lit(west), F.lit(south), F.lit(east), F.lit(north))) / 1e6).first()[0]
    assert [r.lake_id for r in rows] == ["7"] and rows[0].valid_pixels == pytest.approx(km2 * 100, rel=0.03)
    assert rows[0].wse == pytest.approx(11.0, abs=1e-6) and rows[0].wse_med == pytest.approx(11.0)
    merged = spark.read.parquet(f"{tmp_path}/out/merged").where(F.col("wse").isNotNull())
    assert {round(r.wse, 3) for r in merged.select("wse").distinct().collect()} == {10.0, 11.0, 12.0}
    lakes = reproject.lakes_in_target(spark.createDataFrame([("1", [[(600000.0, 3300000.0)]], 99)], "lake_id string, rings array<array<struct<x:double,y:double>>>, srid int"), 32646)
    with pytest.raises(Exception, match="unknown projection"):
        lakes.collect()


def test_lakes_of_another_zone_move(spark):
    ring = [[(200000.0, 3300000.0), (210000.0, 3300000.0), (210000.0, 3310000.0)]]
    there = reproject.lakes_in_target(spark.createDataFrame([("1", ring, 32646)], "lake_id string, rings array<array<struct<x:double,y:double>>>, srid int"), 32645)
    back = reproject.lakes_in_target(there, 32646).first()
    assert [(round(p.x, 3), round(p.y, 3)) for p in back.rings[0]] == ring[0] and there.first().minx > 700000


def executed(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[0] if "== Final Plan ==" in text else text


def test_same_day_merge_sums_before_the_shuffle(spark, monkeypatch):
    """One scan of the pixels, and the plan as executed has a partial aggregate below each exchange, of raw pixels too; a day is no key of an exchange of cells."""
    plans, write = [], timeseries.write_shared
    monkeypatch.setattr(timeseries, "write_shared", lambda df, name: plans.append((name, executed(df))) or write(df, name))
    rows = [("1", "d", "g%d" % (i % 3), i % 7, i % 5, float(i), 0.1, 0.5, 0, 0, 20000.0) for i in range(200)]
    pixels = spark.createDataFrame(rows, "lake_id string, obs_date string, group_id string, cell_row int, cell_col int, wse double, wse_uncert double, water_frac double, wse_qual int, water_area_qual int, cross_track double")
    assert timeseries.lake_timeseries(pixels).count() == 1
    cells = dict(plans)["pass_cells"]
    assert cells.count("Scan") == 1 and cells.count("Exchange") == 1
    exchange = cells.index("Exchange hashpartitioning")
    assert "cell_row" in cells[exchange : cells.index("\n", exchange)] and "partial_sum" in cells[exchange:]
    day = dict(plans)["day_cells"]
    for line in day.split("\n"):
        assert "Exchange hashpartitioning(lake_id" not in line or "cell_row" in line or "source" in line or "obs_date" in line
    assert day.count("Window") == 0 and "Python" not in day


def test_gate_and_merge_equal_plain_version(spark):
    """Passes of few valid pixels go; others meet by inverse variance; a day of one source passes through."""
    rng = np.random.default_rng(5)
    rows = []
    for lake, day, passes in (("1", "a", 3), ("1", "b", 1), (None, "a", 2), ("2", None, 2)):
        for g in range(passes):
            for cell in range(12 if g < 2 else 4):
                rows.append((lake, day, f"g{g}", cell // 4, cell % 4, float(rng.normal(10, 1)) if rng.random() > 0.2 else None, float(rng.uniform(0.01, 1)), 0.5))
    cells = spark.createDataFrame(rows, "lake_id string, obs_date string, group_id string, cell_row int, cell_col int, wse double, wse_uncert double, water_frac double")
    got = {(r.lake_id, r.obs_date, r.cell_row, r.cell_col): r for r in timeseries._merged(timeseries.enough_in_pass(timeseries.pass_cells(cells), 5)).collect()}
    kept = {}
    for r in rows:
        valid = sum(x[5] is not None for x in rows if x[:3] == r[:3])
        if valid >= 5:
            kept.setdefault((*r[:2], *r[3:5]), []).append(r)
    assert set(got) == set(kept)
    for key, parts in kept.items():
        sources = sorted({x[2] for x in rows if x[:2] == key[:2] and sum(y[5] is not None for y in rows if y[:3] == x[:3]) >= 5})
        v = [(x[5], x[6]) for x in parts if x[5] is not None]
        want = parts[0][5] if len(sources) == 1 else sum(a / b**2 for a, b in v) / sum(1 / b**2 for _, b in v) if v else None
        assert got[key].sources == ",".join(sources) and got[key].n_sources == len(sources)
        assert got[key].wse == (None if want is None else pytest.approx(want, rel=1e-6))


def test_command_lines(spark, tmp_path, capsys):
    name = "SAT_L2_HR_Raster_100m_UTM{}N_N_x_x_x_034_287_00{}F_20250618T233535_20250618T233556_PIC0_01"
    rows = [(f"/d/{name.format(46, 1)}.nc", "EPSG:32646"), (f"/d/{name.format(46, 2)}.nc", "EPSG:32645"), (f"/d/{name.format(46, 3)}.nc", None)]
    table = spark.createDataFrame(rows, "path string, crs_wkt string").withColumns({"minx": F.lit(0.0), "miny": F.lit(0.0), "maxx": F.lit(1000.0), "maxy": F.lit(1000.0), "lon_min": F.lit(90.0), "lat_min": F.lit(30.0), "lon_max": F.lit(91.0), "lat_max": F.lit(31.0)})
    table.write.parquet(f"{tmp_path}/raw/granules")
    px = [(name.format(46, i), r, c, 9.96921e36 if (r, c) == (3, 3) else 5.0, float(r)) for i in (1, 2) for r in range(10) for c in range(10)]
    spark.createDataFrame(px, "granule_id string, row int, col int, wse double, cross_track double").write.parquet(f"{tmp_path}/raw/pixels")
    projection.main(["-d", f"{tmp_path}/raw/granules", "-o", f"{tmp_path}/projection"])
    document = json.loads(spark.read.text(f"{tmp_path}/projection").first().value)
    assert document["utm_analysis"]["utm_zone_by_content"] == {"None": 1, "45N": 1, "46N": 1} and document["utm_analysis"]["mismatch_count"] == 1 and document["utm_analysis"]["error_count"] == 1
    assert document["group_analysis"]["inconsistent_groups"] == 1 and "must be reprojected" in capsys.readouterr().out
    assert projection.examine(spark.read.parquet(f"{tmp_path}/raw/granules"), max_files=1, sample_groups=1)["utm_analysis"]["total_files"] == 1
    explorer.main(["-p", f"{tmp_path}/raw/pixels", "-n", "1", "-o", f"{tmp_path}/explored"])
    assert "| wse | 99 | 1 |" in capsys.readouterr().out
    connectivity.main(["-r", f"{tmp_path}/raw", "--passes", "287", "--point", "90.5", "30.5", "--box", "101", "101", "899", "899", "-o", f"{tmp_path}/continuity"])
    out = spark.read.json(f"{tmp_path}/continuity").orderBy("raster_id").collect()
    assert [(r.file_version, r.n_components, r.hole_cells, r.height, r.width) for r in out] == [("PIC0", 1, 1, 8, 8)] * 2


def test_plot_series(spark):
    rows = [("1", float(h), 0.1, h * 1e6) for h in range(1, 11)] + [("1", 5.0, 0.1, 9e9)]
    series = spark.createDataFrame(rows, "lake_id string, wse double, wse_uncert double, water_area double")
    plot = curve.plot_series(series, curve.area_level_curves(series), n=10)
    n = {r.kind: r["count"] for r in plot.groupBy("kind").count().collect()}
    assert n == {"raw": 11, "cleaned": 10, "curve": 10}
    assert all(r.area == pytest.approx(r.wse, abs=1e-3) for r in plot.where("kind = 'curve'").collect())
    assert plot.where("kind = 'cleaned'").agg(F.min("shown_sigma")).first()[0] == pytest.approx(0.135)


def test_numbered_lakes(spark):
    n = {r.lake_id: r.minx for r in clip.with_lake_ids(spark.range(50).select((F.col("id") * 7 % 50).cast("double").alias("minx"), *[F.lit(1.0).alias(c) for c in ("miny", "maxx", "maxy")])).collect()}
    assert n == {f"lake_{i}": float(i) for i in range(50)}
    assert clip.with_lake_ids(spark.range(0).select(*[F.lit(1.0).alias(c) for c in ("minx", "miny", "maxx", "maxy")])).count() == 0


def test_vector_observations(spark):
    rows = [("/d/LakeSP_123_20240102", {"lake_id": "7", "wse": "5.5", "wse_u": "0.1", "area_total": "x", "quality_f": "1", "ice_clim_f": "0"}), ("/d/other", {"lake_id": "no_data"})]
    shapes = spark.createDataFrame(rows, "source string, attributes map<string,string>")
    a, b = readers.vector_observations(shapes).collect()
    assert (a.lake_id, str(a.obs_date), a["pass"], a.wse, a.area, a.quality_f) == ("7", "2024-01-02", "123", 5.5, None, 1) and (b.lake_id, b.obs_date, b["pass"]) == (None, None, None)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("1", f"2024-01-0{d} 0{h}:00:00", 10.0 + h, 1.0) for d in (1, 2, 3) for h in range(3)]
    batch = spark.createDataFrame(rows, "lake_id string, t string, wse double, wse_uncert double").select("lake_id", F.col("t").cast("timestamp").alias("obs_ts"), "wse", "wse_uncert")
    batch.write.parquet(f"{tmp_path}/in")
    q = daily_levels(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("levels").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    done = {(r.lake_id, str(r.day)): r.wse for r in spark.table("levels").collect()}
    whole = {(r.lake_id, str(r.day)): r.wse for r in daily_levels(batch).collect()}
    assert done and all(whole[k] == v for k, v in done.items()) and len(whole) == 3
