"""What must not grow: plans, what the driver holds, work that one task does, pairs that are tested."""

from pyspark.sql import functions as F

from hydroseries.functions import geo
from hydroseries.operators import clip, curve, reproject
from hydroseries.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_filter_on_projected_points_does_not_multiply_their_expressions(spark):
    there = geo.to_utm(spark.createDataFrame([(1, 93.0, 30.0), (2, None, 30.0), (3, 80.0, 30.0)], "id int, lon double, lat double"), "lon", "lat", F.lit(32646), "x", "y")
    back = geo.from_utm(there.drop("lon", "lat"), "x", "y", F.lit(32646), "lon", "lat")
    near = back.where(F.col("lon").between(92.0, 94.0) & F.col("lat").between(29.0, 31.0))
    assert len(near._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    assert [r.id for r in near.collect()] == [1] and back.count() == 3  # a missing coordinate stays a row
    assert len(QUERIES["lonlat_box_filter"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()) < 10_000


def test_exploded_pixels_are_not_sent_to_all_tasks(spark):
    granules = spark.createDataFrame([("a", 32646, 7e5, 3.3e6, 7e5 + 300, 3.3e6 + 300, 100.0, 100.0), ("b", 32645, 7e5, 3.3e6, 7e5 + 300, 3.3e6 + 300, 100.0, 100.0)], "granule_id string, srid int, minx double, miny double, maxx double, maxy double, res_x double, res_y double")
    cells = granules.select("granule_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col")).withColumn("wse", F.col("row") * 1.0)
    placed = cells.join(granules.select("granule_id", "minx", "maxy"), "granule_id").select("granule_id", "row", "col", (F.col("minx") + F.col("col") * 100 + 50).alias("x"), (F.col("maxy") - F.col("row") * 100 - 50).alias("y"), "wse")
    for pixels in (cells, placed):
        plan = executed(reproject.reproject_nearest(pixels, granules, 32646))
        assert "SortMergeJoin [granule_id" in plan and not [line for line in plan.split("\n") if "BroadcastHashJoin" in line and "row#" in line]
    one, other = ({(r.granule_id, r.row, r.col): r for r in reproject.reproject_nearest(p, granules, 32646).collect()} for p in (cells, placed))
    assert one == other and len([k for k in one if k[0] == "a"]) == 9


def test_monotone_goes_through_samples_once(spark):
    rows = [([1.0, 2.0, 2.0],), ([1.0, 0.5],), ([3.0],), ([],), ([1.0, None, 2.0],), ([2.0, 1.0, None],), (None,), ([1.0, 1.0 - 1e-11],)]
    df = spark.createDataFrame(rows, "s array<double>").select(curve.is_monotone(F.col("s")).alias("m"))
    assert [r.m for r in df.collect()] == [True, False, True, True, None, False, None, True]
    query = QUERIES["monotonic_check"](spark, SF)
    assert query._jdf.queryExecution().optimizedPlan().toString().count("sequence(0, 199") <= 1 and query.rdd.getNumPartitions() > 1


def test_a_place_and_an_outline_are_tested_once(spark):
    """Many points on few places, many boxes and lakes alike: the tests see places and outlines, the rows come by equi-joins."""
    points = spark.range(2000).select("id", (F.col("id") % 2 * 50.0 + 5.0).alias("x"), F.lit(5.0).alias("y"))
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))])
    boxes = spark.range(300).select(F.col("id").cast("string").alias("lake_id"), F.array(ring).alias("rings"), *[F.lit(v).alias(c) for c, v in zip(clip.BOX, (0.0, 0.0, 10.0, 10.0), strict=True)])
    met = clip._places_met(points, boxes.select(*clip.BOX).distinct(), 7.0, "x", "y")
    assert met.count() == 1
    held = clip.points_in_boxes(points, boxes.drop("rings"), 7.0)
    assert held.columns == ["id", "x", "y", "lake_id", *clip.BOX] and held.count() == held.distinct().count() == 1000 * 300
    lakes = clip.clip_to_lakes(points.withColumnRenamed("id", "row"), boxes.unionByName(boxes), tile=7.0)
    assert lakes.count() == lakes.select("row", "lake_id").distinct().count() == 1000 * 300


def test_points_and_boxes_meet_in_parts(spark, monkeypatch):
    """Parts of few rows: all pairs, each as often as its point and its box occur, and nothing of places or boxes that are missing."""
    monkeypatch.setattr(clip, "POINTS", 4)
    monkeypatch.setattr(clip, "BOXES", 3)
    places = [(i % 40, float(i % 5), float(i % 3)) for i in range(90)] + [(7, None, 1.0), (8, -0.0, 0.0), (9, 50.0, 50.0)]
    shapes = [(f"b{i % 17}", float(i % 2), 0.0, 2.0 + i % 2, 1.0) for i in range(43)] + [("n", None, 0.0, 9.0, 9.0), ("m", 0.0, 0.0, -0.0, 9.0), ("far", 90.0, 90.0, 99.0, 99.0)]
    points = spark.createDataFrame(places, "id long, x double, y double")
    boxes = spark.createDataFrame(shapes, "name string, minx double, miny double, maxx double, maxy double")
    held = clip.points_in_boxes(points, boxes, 2.0)
    want = sorted((p[0], b[0]) for p in places for b in shapes if None not in (p[1], b[1]) and b[1] <= p[1] <= b[3] and b[2] <= p[2] <= b[4])
    assert sorted((r.id, r.name) for r in held.collect()) == want
    assert clip.points_in_boxes(points, boxes.drop("name"), 2.0).count() == len(want)
    assert clip.points_in_boxes(points.where("id < 0"), boxes, 2.0).count() == clip.points_in_boxes(points, boxes.where("minx < -1"), 2.0).count() == 0


def test_points_in_boxes_take_few_bytes_when_written(spark, tmp_path):
    """The rows grow with the product of points and boxes, so their order decides how much disk a written result needs."""
    points = spark.range(4000).select("id", (F.col("id") * 7 % 40 * 10.0).alias("x"), F.lit(0.0).alias("y"))
    boxes = spark.range(12800).select(F.concat(F.lit("granule"), "id").alias("name"), (F.col("id") % 40 * 10.0 - 1).alias("minx"), F.lit(-1.0).alias("miny"), (F.col("id") % 40 * 10.0 + 1).alias("maxx"), F.lit(1.0).alias("maxy"))
    held = clip.points_in_boxes(points, boxes, 25.0).select("id", "name")
    held.write.parquet(f"{tmp_path}/held")
    assert spark.read.parquet(f"{tmp_path}/held").count() == 4000 * 320
    assert sum(f.stat().st_size for f in (tmp_path / "held").glob("*.parquet")) < 4000 * 320
