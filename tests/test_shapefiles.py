"""Shapefiles written by tasks are read back; a failed task leaves nothing."""

import datetime
import os
import struct

import pytest

from hydroseries.sources import readers, shapefile

RING = [[{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 2.5}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]]
HOLED = [[{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 9.0}, {"x": 9.0, "y": 9.0}, {"x": 9.0, "y": 0.0}, {"x": 0.0, "y": 0.0}], [{"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 1.0}, {"x": 1.0, "y": 2.0}, {"x": 1.0, "y": 1.0}]]
SCHEMA = f"lake_id string, date date, wse double, valid_pixels long, valid_pixels_orig long, good boolean, rings {readers.RINGS}"


def outlines(spark):
    rows = [(f"lake é {i}", datetime.date(2024, 1, 1 + i), 1 / 3 + i, i, -i, i % 2 == 0, HOLED if i % 3 else RING) for i in range(12)]
    return spark.createDataFrame([*rows, (None, None, None, None, None, None, []), ("1e300", None, -1.7976931348623157e308, 9223372036854775807, 0, True, RING)], SCHEMA)


def test_round_trip(spark, tmp_path):
    df = outlines(spark)
    shapefile.write_shapefiles(df.repartition(3), f"file://{tmp_path}/out", ["lake_id", "date", "wse", "valid_pixels", "valid_pixels_orig", "good"], crs="EPSG:4326")
    files = os.listdir(tmp_path / "out")
    assert sorted({f.rsplit(".")[-1] for f in files}) == ["cpg", "dbf", "prj", "shp", "shx"] and not any("temporary" in f for f in files)
    back = readers.read_shapefiles(spark, f"file://{tmp_path}/out").collect()
    key = lambda r: (r[0], r[1])
    got = sorted((r.attributes["lake_id"], r.attributes["date"], r.attributes["wse"], r.attributes["valid_pixe"], r.attributes["valid_pi_1"], r.attributes["good"], [[tuple(p) for p in ring] for ring in r.rings]) for r in back)
    text = lambda x: "" if x is None else x.strftime("%Y%m%d") if isinstance(x, datetime.date) else ("T" if x else "F") if isinstance(x, bool) else repr(x) if isinstance(x, float) else str(x)
    want = sorted((*map(text, r[:6]), [[(p["x"], p["y"]) for p in ring] for ring in r.rings]) for r in df.collect())
    assert sorted(got, key=key) == sorted(want, key=key) and {r.srid for r in back} == {4326}
    for f in files:
        if f.endswith(".shx"):
            index, shapes = ((tmp_path / "out" / f.replace(".shx", e)).read_bytes() for e in (".shx", ".shp"))
            assert struct.unpack(">i", shapes[24:28])[0] * 2 == len(shapes) and struct.unpack(">i", index[24:28])[0] * 2 == len(index)
            for k in range((len(index) - 100) // 8):
                at, length = struct.unpack(">2i", index[100 + 8 * k : 108 + 8 * k])
                assert struct.unpack(">2i", shapes[2 * at : 2 * at + 8]) == (k + 1, length)


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    good = outlines(spark).limit(3)
    shapefile.write_shapefiles(good, str(tmp_path / "out"), ["lake_id"])
    before = sorted(os.listdir(tmp_path / "out"))
    bad = spark.createDataFrame([("x" * 300, RING)], f"lake_id string, rings {readers.RINGS}").unionByName(good.select("lake_id", "rings"))
    with pytest.raises(Exception, match="the format holds"):
        shapefile.write_shapefiles(bad, str(tmp_path / "out"), ["lake_id"])
    assert sorted(os.listdir(tmp_path / "out")) == before
    shapefile.write_shapefiles(good.limit(1).coalesce(1), str(tmp_path / "out"), ["lake_id"], mode="overwrite")
    assert readers.read_shapefiles(spark, f"file://{tmp_path}/out").count() == 1 and not set(os.listdir(tmp_path / "out")) & set(before)


def test_names():
    assert shapefile.field_names(["valid_pixels", "valid_pixels_orig", "Valid_pixels2", "x"]) == ["valid_pixe", "valid_pi_1", "Valid_pi_2", "x"]
