"""Rasters written by tasks and read back; other layouts are read too; a failed task leaves nothing."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroseries.sources import raster

GRIDS = "raster_id string, width int, height int, minx double, maxy double, res_x double, res_y double, srid int, attributes map<string,string>"


def grids(spark):
    return spark.createDataFrame([("lake 1/2024-01-02", 40, 25, 500000.0, 3400000.0, 100.0, 100.0, 32646, {"date": "2024-01-02", "sources": "a,b"}), ("é", 5, 3, 0.0, 2.0, 0.5, 0.25, 4326, None), ("empty", 7, 7, 0.0, 0.0, 1.0, 1.0, None, None)], GRIDS)


def cells(spark):
    rng = np.random.default_rng(3)
    rows = [("lake 1/2024-01-02", r, c, float(np.float32(rng.normal())), float(np.float32(0.5)) if c % 3 else None) for r in range(25) for c in range(40) if rng.random() < 0.6 and not (r < 16 and c < 16)]
    rows += [("é", 2, 4, 7.25, None), ("é", 0, 0, None, 1.5), ("é", 1, 1, None, None), ("é", 3, 0, 1.0, 1.0), ("é", -1, 0, 1.0, 1.0), ("unknown", 0, 0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "raster_id string, row int, col int, wse float, wse_uncert float")


@pytest.mark.parametrize("tile", [16, 256])
def test_round_trip(spark, tmp_path, tile):
    path = f"{tmp_path}/out"
    raster.write_rasters(cells(spark).repartition(3), grids(spark), f"file://{path}", ["wse", "wse_uncert"], tile=tile)
    assert sorted(os.listdir(path)) == sorted(["lake%201%2F2024-01-02.tif", "lake%201%2F2024-01-02.json", "%C3%A9.tif", "%C3%A9.json", "empty.tif", "empty.json"])
    back = raster.read_rasters(spark, f"file://{path}", ["wse_uncert", "wse", "gone"])
    got = {(r.raster_id, r.row, r.col): (r.wse, r.wse_uncert, r.gone) for r in back.collect()}
    known = {"lake 1/2024-01-02", "é"}
    want = {(r.raster_id, r.row, r.col): (r.wse, r.wse_uncert, None) for r in cells(spark).collect() if r.raster_id in known and 0 <= r.row < (3 if r.raster_id == "é" else 25) and (r.wse is not None or r.wse_uncert is not None)}
    assert got == want and len(got) > 400
    corner = back.where("raster_id = 'é' AND row = 2").first()
    assert (corner.x, corner.y) == (2.25, 1.375)
    table = {r.raster_id: r for r in raster.read_raster_table(spark, f"file://{path}").collect()}
    for g in grids(spark).collect():
        r = table[g.raster_id]
        assert [r[k] for k in ("width", "height", "minx", "maxy", "res_x", "res_y", "srid")] == [g[k] for k in ("width", "height", "minx", "maxy", "res_x", "res_y", "srid")]
        assert (r.bands, r.nodata) == (["wse", "wse_uncert"], -9999.0)
    side = {r.raster_id: r for r in raster.read_sidecars(spark, f"file://{path}").collect()}
    assert side["lake 1/2024-01-02"].attributes == {"date": "2024-01-02", "sources": "a,b"} and side["é"].bands == ["wse", "wse_uncert"] and side["empty"].srid is None
    if tile == 16:  # tiles without a cell take no place: two bands of five tiles of six are there
        file = raster.Tiff(open(f"{path}/lake%201%2F2024-01-02.tif", "rb").read())
        assert len(file.tags[raster.TILE_COUNTS]) == 12 and sum(n > 0 for n in file.tags[raster.TILE_COUNTS]) == 10


def plain_tiff(values, order="<", rows_per_strip=2, deflate=False, nodata=b"255\0"):
    """Strips of one file with 32-bit offsets, bands together, 8-bit numbers."""
    h, w, n = values.shape
    strips = [values[r : r + rows_per_strip].astype("u1").tobytes() for r in range(0, h, rows_per_strip)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    out, places = bytearray(8), []
    for s in strips:
        places.append(len(out))
        out += s
    tags = {256: (3, [w]), 257: (3, [h]), 258: (3, [8] * n), 259: (3, [8 if deflate else 1]), 262: (3, [1]), 273: (4, places), 277: (3, [n]), 278: (3, [rows_per_strip]), 279: (4, [len(s) for s in strips]), 42113: (2, nodata)}
    entries = b""
    for tag, (kind, v) in sorted(tags.items()):
        raw = v if kind == 2 else struct.pack(f"{order}{len(v)}{'H' if kind == 3 else 'I'}", *v)
        if len(raw) > 4:
            where = struct.pack(order + "I", len(out))
            out += raw
        else:
            where = raw.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, kind, len(v)) + where
    out[:8] = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, len(out))
    return bytes(out + struct.pack(order + "H", len(tags)) + entries + bytes(4))


@pytest.mark.parametrize("order,deflate", [("<", False), (">", True)])
def test_other_layouts(spark, tmp_path, order, deflate):
    values = np.arange(5 * 3 * 2).reshape(5, 3, 2) * 8 % 256
    values[4, 2] = 255
    (tmp_path / "a.tif").write_bytes(plain_tiff(values, order, deflate=deflate))
    got = {(r.row, r.col): (r.band_1, r.band_2) for r in raster.read_rasters(spark, f"file://{tmp_path}", ["band_1", "band_2"]).collect()}
    assert got == {(r, c): tuple(float(x) for x in values[r, c]) for r in range(5) for c in range(3) if (r, c) != (4, 2)}
    (tmp_path / "b.tif").write_bytes(b"no raster at all")
    with pytest.raises(Exception, match="b.tif"):
        raster.read_rasters(spark, f"file://{tmp_path}", ["band_1"]).collect()


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = f"{tmp_path}/out"
    raster.write_rasters(cells(spark), grids(spark).where("raster_id = 'é'"), path, ["wse"])
    before = sorted(os.listdir(path))
    broken = F.udf(lambda x: 1 / 0 if x > 20 else x, "int")
    with pytest.raises(Exception):  # noqa: B017
        raster.write_rasters(cells(spark).withColumn("row", broken("row")), grids(spark), path, ["wse"])
    assert sorted(os.listdir(path)) == before
