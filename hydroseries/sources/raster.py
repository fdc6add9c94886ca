"""Rasters as GeoTIFF files: tiled 32-bit float bands, one file a raster, with its grid, projection, no-data value and band names, and a sidecar.

Writing: cells become tiles in grouped tasks of one tile each; tiles are dealt by raster and sorted, and stream into their raster's file, whose directory
comes last. So a task holds one tile, whatever the raster's size; tiles without a valid cell take no place. Files have 64-bit offsets.
Reading: files come through Spark's own file system; strips or tiles, plain or deflated, bands together or apart, 32- or 64-bit offsets.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from hydroseries.config import NODATA
from hydroseries.sources.sinks import TwoPhaseWriter, sink

TILE = 256
META = "raster_id string, width int, height int, minx double, maxy double, res_x double, res_y double, srid int"
#: Tags of the format, and the bytes of its types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, EXTRA, FORMAT = 322, 323, 324, 325, 338, 339
SCALE, TIEPOINT, GEO_KEYS, METADATA, NO_DATA = 33550, 33922, 34735, 42112, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PROJECTED, GEOGRAPHIC = 3072, 2048


# Writing.


def raster_tiles(cells: DataFrame, bands: list[str], tile: int = TILE) -> DataFrame:
    """raster_id, tile_row, tile_col and data (deflated tiles of the bands) of each tile that holds a cell. cells: raster_id, row, col (from 0, row 0 in the north) and the bands."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = (pdf["row"].to_numpy() % tile, pdf["col"].to_numpy() % tile)
        blobs = []
        for band in bands:
            values = np.full((tile, tile), NODATA, "<f4")
            v = pdf[band].to_numpy(np.float64)
            values[place] = np.where(np.isnan(v), NODATA, v)
            blobs.append(zlib.compress(values.tobytes()))
        return pd.DataFrame({"raster_id": [pdf["raster_id"].iat[0]], "tile_row": [int(pdf["tile_row"].iat[0])], "tile_col": [int(pdf["tile_col"].iat[0])], "data": [blobs]})

    # One value a cell, the least, so that a tile is bounded.
    once = cells.groupBy("raster_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(*[F.min(b).cast("float").alias(b) for b in bands])
    dealt = once.select("*", *[F.floor(F.col(c) / tile).cast("int").alias(f"tile_{c}") for c in ("row", "col")])
    return dealt.groupBy("raster_id", "tile_row", "tile_col").applyInPandas(run, "raster_id string, tile_row int, tile_col int, data array<binary>")


def file_name(raster_id: str) -> str:
    """Letters, digits, dots, underscores and hyphens stay; other bytes are told by their number."""
    return re.sub(rb"[^A-Za-z0-9._-]", lambda m: b"%%%02X" % m.group()[0], raster_id.encode()).decode() + ".tif"


class RasterWriter(TwoPhaseWriter):
    """Rows are tiles (see raster_tiles) beside their raster's grid, sorted by raster."""

    def write_files(self, rows: Iterator[Row], folder: str) -> None:
        bands, tile = self.options["bands"].split(","), int(self.options["tile"])
        current, file = None, None
        for row in rows:
            if row["raster_id"] != current:
                self._finish(file)
                current = row["raster_id"]
                file = {"out": open(f"{folder}/{file_name(current)}", "wb"), "meta": row, "at": {}, "bands": bands, "tile": tile, "folder": folder}  # noqa: SIM115
                file["out"].write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
            if row["data"] is not None:
                for band, blob in enumerate(row["data"]):
                    file["at"][band, row["tile_row"], row["tile_col"]] = (file["out"].tell(), len(blob))
                    file["out"].write(bytes(blob))
        self._finish(file)

    def _finish(self, file: dict | None) -> None:
        if file is None:
            return
        out, meta, bands, tile = file["out"], file["meta"], file["bands"], file["tile"]
        down, across = -(-meta["height"] // tile), -(-meta["width"] // tile)
        places = [file["at"].get((b, r, c), (0, 0)) for b in range(len(bands)) for r in range(down) for c in range(across)]
        names = "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{b}</Item>' for k, b in enumerate(bands))
        keys = [1, 1, 0, 3, 1024, 0, 1, 2 if meta["srid"] == 4326 else 1, 1025, 0, 1, 1, GEOGRAPHIC if meta["srid"] == 4326 else PROJECTED, 0, 1, meta["srid"] or 32767]
        tags = {
            WIDTH: (4, [meta["width"]]), HEIGHT: (4, [meta["height"]]), BITS: (3, [32] * len(bands)), COMPRESSION: (3, [8]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [len(bands)]), PLANAR: (3, [2]),
            TILE_WIDTH: (4, [tile]), TILE_LENGTH: (4, [tile]), TILE_OFFSETS: (16, [p for p, _ in places]), TILE_COUNTS: (16, [n for _, n in places]), FORMAT: (3, [3] * len(bands)),
            SCALE: (12, [meta["res_x"], meta["res_y"], 0.0]), TIEPOINT: (12, [0.0, 0.0, 0.0, meta["minx"], meta["maxy"], 0.0]), GEO_KEYS: (3, keys),
            METADATA: (2, f"<GDALMetadata>{names}</GDALMetadata>".encode() + b"\0"), NO_DATA: (2, f"{NODATA:g}".encode() + b"\0"),
        }
        if len(bands) > 1:
            tags[EXTRA] = (3, [0] * (len(bands) - 1))
        entries = []
        for tag, (kind, values) in sorted(tags.items()):
            raw = values if kind == 2 else struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(raw) > 8:
                out.write(bytes(-out.tell() % 8))
                where = struct.pack("<Q", out.tell())
                out.write(raw)
            else:
                where = raw.ljust(8, b"\0")
            entries.append(struct.pack("<HHQ", tag, kind, len(values)) + where)
        out.write(bytes(-out.tell() % 8))
        directory = out.tell()
        out.write(struct.pack("<Q", len(entries)) + b"".join(entries) + bytes(8))
        out.seek(8)
        out.write(struct.pack("<Q", directory))
        out.close()
        with open(f"{file['folder']}/{file_name(meta['raster_id'])[:-4]}.json", "w") as side:
            json.dump({k: meta[k] for k in ("raster_id", "width", "height", "minx", "maxy", "res_x", "res_y", "srid")} | {"bands": bands, "nodata": NODATA, "attributes": dict(meta["attributes"] or {})}, side)


Rasters = sink("tiled_rasters", RasterWriter)


def write_rasters(cells: DataFrame, grids: DataFrame, path: str, bands: list[str], mode: str = "append", tile: int = TILE) -> None:
    """A file and a sidecar for each row of grids: raster_id, width, height, minx, maxy, res_x, res_y, srid and, if they are to go to the sidecar, attributes (map of text).

    cells: raster_id, row, col and the bands, as floats; NULL is no data. A raster without cells is a file without tiles; cells of
    rasters that are not in grids, or outside of theirs, are left out.
    """
    spark = cells.sparkSession
    spark.dataSource.register(Rasters)
    meta = grids.select(F.col("raster_id").cast("string").alias("raster_id"), *[F.col(c) for c in ("width", "height", "minx", "maxy", "res_x", "res_y", "srid")], (F.col("attributes") if "attributes" in grids.columns else F.lit(None)).cast("map<string,string>").alias("attributes"))
    named = cells.select(F.col("raster_id").cast("string").alias("raster_id"), "row", "col", *bands)
    inside = named.join(meta.select("raster_id", "width", "height"), "raster_id").where("row >= 0 AND row < height AND col >= 0 AND col < width").drop("width", "height")
    rows = meta.join(raster_tiles(inside, bands, tile), "raster_id", "left")
    rows.repartition("raster_id").sortWithinPartitions("raster_id", "tile_row", "tile_col").write.format("tiled_rasters").mode(mode).options(path=path, bands=",".join(bands), tile=str(tile)).save()


# Reading.


class Tiff:
    """The first image of a file in memory: tags, grid, and blocks of its bands."""

    def __init__(self, data: bytes):
        self.data = data
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None or struct.unpack_from(order + "H", data, 2)[0] not in (42, 43):
            raise ValueError("no TIFF file")
        self.order, big = order, struct.unpack_from(order + "H", data, 2)[0] == 43
        at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
        count, entry, size = ("Q", "HHQ", 8) if big else ("H", "HHI", 4)
        n = struct.unpack_from(order + count, data, at)[0]
        at += struct.calcsize("=" + count)
        self.tags = {}
        for _ in range(n):
            tag, kind, length = struct.unpack_from(order + entry, data, at)
            place = at + struct.calcsize("=" + entry)
            letters = TYPES.get(kind, "B")
            bytes_ = struct.calcsize("=" + letters) * length
            if bytes_ > size:
                place = struct.unpack_from(order + ("Q" if big else "I"), data, place)[0]
            self.tags[tag] = data[place : place + length] if kind == 2 else struct.unpack_from(order + letters * length if len(letters) > 1 else f"{order}{length}{letters}", data, place)
            at += struct.calcsize("=" + entry) + size
        one = lambda tag, default: (self.tags.get(tag) or (default,))[0]
        self.width, self.height, self.samples, self.apart = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(PLANAR, 1) == 2
        self.tiled = TILE_OFFSETS in self.tags
        self.block = (one(TILE_LENGTH, 0), one(TILE_WIDTH, 0)) if self.tiled else (min(one(ROWS_PER_STRIP, self.height), self.height), self.width)
        self.compression = one(COMPRESSION, 1)
        if self.compression not in (1, 8, 32946) or one(317, 1) != 1:
            raise ValueError(f"compression {self.compression} or its predictor is not read")
        self.dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(FORMAT, 1)] }{one(BITS, 1) // 8}")
        text = self.tags.get(NO_DATA, b"").split(b"\0")[0].strip()
        self.nodata = float(text) if text else None
        found = re.findall(r'name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)<', self.tags.get(METADATA, b"").decode("utf-8", "replace"))
        self.bands = [dict(found).get(str(k), f"band_{k + 1}") for k in range(self.samples)]
        scale, tie = self.tags.get(SCALE, (1.0, 1.0, 0.0)), self.tags.get(TIEPOINT, (0.0,) * 6)
        self.res_x, self.res_y, self.minx, self.maxy = scale[0], scale[1], tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
        keys = self.tags.get(GEO_KEYS, ())
        told = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4) if keys[k + 1] == 0}
        self.srid = next((told[k] for k in (PROJECTED, GEOGRAPHIC) if told.get(k, 32767) != 32767), None)

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, first column, values of all bands as doubles, NaN for no data) of each block that is there."""
        offsets, counts = (self.tags[t] for t in ((TILE_OFFSETS, TILE_COUNTS) if self.tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
        (tall, wide), per_band = self.block, -(-self.height // self.block[0]) * -(-self.width // self.block[1])
        for k in range(per_band):
            r, c = k // -(-self.width // wide) * tall, k % -(-self.width // wide) * wide
            rows, cols = min(tall, self.height - r), min(wide, self.width - c)
            read = [self._block(offsets[j], counts[j], tall if self.tiled else rows, wide, 1 if self.apart else self.samples) for j in ([k + b * per_band for b in range(self.samples)] if self.apart else [k])]
            if all(x is None for x in read):
                continue
            empty = np.full((tall, wide, 1), np.nan)
            values = np.concatenate([empty if x is None else x for x in read], 2) if self.apart else read[0]
            yield r, c, values[:rows, :cols]

    def _block(self, offset: int, count: int, tall: int, wide: int, samples: int) -> np.ndarray | None:
        if not count:
            return None
        raw = self.data[offset : offset + count]
        raw = raw if self.compression == 1 else zlib.decompress(raw)
        out = np.frombuffer(raw, self.dtype, tall * wide * samples).reshape(tall, wide, samples).astype(float)
        return out if self.nodata is None else np.where(out == self.nodata, np.nan, out)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _id(path: str) -> str:
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m.group(1), 16)]), stem.encode()).decode("utf-8", "replace")


def read_rasters(spark: SparkSession, path: str, bands: list[str], pattern: str = "*.tif") -> DataFrame:
    """raster_id, row, col, x, y (of the cell's centre) and the bands (NULL for no data), of cells where one of them is there. A band that a file lacks is NULL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    file = Tiff(content)
                    for r, c, values in file.blocks():
                        there = [values[..., file.bands.index(b)] if b in file.bands else np.full(values.shape[:2], np.nan) for b in bands]
                        y, x = np.nonzero(~np.isnan(np.stack(there)).all(0))
                        row, col = (y + r).astype(np.int32), (x + c).astype(np.int32)
                        yield pd.DataFrame({"raster_id": pd.Series([_id(name)] * len(row), dtype=object), "row": row, "col": col, "x": file.minx + (col + 0.5) * file.res_x, "y": file.maxy - (row + 0.5) * file.res_y} | {b: v[y, x] for b, v in zip(bands, there, strict=True)})
                except Exception as e:
                    raise ValueError(f"{name}: {e}") from e

    cells = _files(spark, path, pattern).mapInPandas(run, "raster_id string, row int, col int, x double, y double, " + ", ".join(f"`{b}` double" for b in bands))
    return cells.select("raster_id", "row", "col", "x", "y", *[F.nanvl(F.col(f"`{b}`"), F.lit(None).cast("double")).alias(b) for b in bands])


def read_raster_table(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """One row a file: its grid (raster_id, width, height, minx, maxy, res_x, res_y, srid), its bands and no-data value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            files = [Tiff(c) for c in pdf["content"]]
            told = {k: [getattr(f, k) for f in files] for k in ("width", "height", "minx", "maxy", "res_x", "res_y")}
            yield pd.DataFrame({"raster_id": [_id(p) for p in pdf["path"]]} | told | {"srid": pd.array([f.srid for f in files], "Int32"), "bands": [f.bands for f in files], "nodata": pd.array([f.nodata for f in files], "Float64")})

    return _files(spark, path, pattern).mapInPandas(run, f"{META}, bands array<string>, nodata double")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """What sidecars tell: the grid, bands, nodata and attributes of each raster."""
    return spark.read.schema(f"{META}, bands array<string>, nodata double, attributes map<string,string>").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path)
