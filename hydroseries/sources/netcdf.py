"""NetCDF granules as pixel rows: files come through Spark's own file system, and of each only the asked variables are decoded.

The classic formats (versions 1, 2 and 5) are read here, from their published layout: a header of dimensions, attributes and variables,
then big-endian arrays, with variables along the unlimited dimension interleaved record by record. Files in the HDF5-based format need the netCDF4 library.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types by their code.
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
#: Pixels of one batch of rows.
BATCH = 1 << 18


@dataclass(frozen=True)
class Variable:
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: np.dtype
    attributes: dict
    begin: int
    record: bool


class Classic:
    """A file of the classic format in memory: dims, attributes, variables, and read(name)."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 4
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("no NetCDF file of the classic format")
        self.size, self.offset = (">q", ">q") if data[3] == 5 else (">i", ">q" if data[3] == 2 else ">i")
        records = self._number(self.size)
        lengths = [(self._name(), self._number(self.size)) for _ in range(self._list())]
        self.attributes = self._attributes()
        self.variables, self.step, found = {}, 0, []
        for _ in range(self._list()):
            name = self._name()
            ids = [self._number(self.size) for _ in range(self._number(self.size))]
            attributes, kind = self._attributes(), np.dtype(_TYPES[self._number(">i")])
            self._number(self.size)  # the variable's size, which its shape tells
            found.append((name, ids, attributes, kind, self._number(self.offset)))
        of_records = [f for f in found if f[1] and lengths[f[1][0]][1] == 0]
        for name, ids, attributes, kind, begin in found:
            record = bool(ids) and lengths[ids[0]][1] == 0
            each = tuple(lengths[i][1] for i in (ids[1:] if record else ids))
            if record:
                size = int(np.prod(each, dtype=np.int64)) * kind.itemsize
                self.step += size if len(of_records) == 1 else -(-size // 4) * 4
            self.variables[name] = Variable(tuple(lengths[i][0] for i in ids), each, kind, attributes, begin, record)
        if records < 0:  # not told while the file was written
            starts = [v.begin for v in self.variables.values() if v.record]
            records = (len(data) - min(starts)) // self.step if starts and self.step else 0
        self.records = records
        self.dims = {n: records if length == 0 else length for n, length in lengths}

    def _number(self, kind: str) -> int:
        (x,) = struct.unpack_from(kind, self.data, self.at)
        self.at += struct.calcsize(kind)
        return x

    def _list(self) -> int:
        """The length of a list, after its tag."""
        self._number(">i")
        return self._number(self.size)

    def _name(self) -> str:
        n = self._number(self.size)
        name = self.data[self.at : self.at + n].decode("utf-8")
        self.at += -(-n // 4) * 4
        return name

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list()):
            name, kind, n = self._name(), self._number(">i"), self._number(self.size)
            dtype = np.dtype(_TYPES[kind])
            raw = self.data[self.at : self.at + n * dtype.itemsize]
            self.at += -(-len(raw) // 4) * 4
            out[name] = raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, dtype).tolist()
        return out

    def read(self, name: str) -> np.ndarray:
        """A view of the file's bytes, in the shape of the variable."""
        v = self.variables[name]
        n = int(np.prod(v.shape, dtype=np.int64))
        if not v.record:
            return np.frombuffer(self.data, v.dtype, n, v.begin).reshape(v.shape)
        inner = tuple(np.cumprod((v.dtype.itemsize, *v.shape[:0:-1]))[::-1].tolist()) if v.shape else ()
        return np.ndarray((self.records, *v.shape), v.dtype, self.data, v.begin, (self.step, *inner))


def _open(data: bytes):
    """(attributes, names of variables, their attributes and dimensions, read) of a file of any of the formats."""
    if data[:3] == b"CDF":
        file = Classic(data)
        return file.attributes, {n: (v.dims, v.attributes) for n, v in file.variables.items()}, file.read
    import netCDF4

    file = netCDF4.Dataset("granule", memory=data)
    file.set_auto_maskandscale(False)
    return ({n: file.getncattr(n) for n in file.ncattrs()}, {n: (v.dimensions, {a: v.getncattr(a) for a in v.ncattrs()}) for n, v in file.variables.items()}, lambda n: file.variables[n][:])


def _decoded(raw: np.ndarray, attributes: dict) -> np.ndarray:
    """As numbers; scaled and shifted as its attributes say, fill values as NaN."""
    one = lambda name: (np.ravel(attributes[name]).tolist() or [None])[0] if name in attributes else None
    out = raw.astype(float)
    for name in ("_FillValue", "missing_value"):
        if one(name) is not None and not isinstance(one(name), str):
            out[raw == raw.dtype.type(one(name))] = np.nan
    scale, shift = one("scale_factor"), one("add_offset")
    return out if scale is None and shift is None else out * (1.0 if scale is None else scale) + (0.0 if shift is None else shift)


def _granule_id(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def read_granules(spark: SparkSession, path: str, variables: Sequence[str], pattern: str = "*.nc") -> DataFrame:
    """granule_id, row, col and the variables, as doubles (fills are NULL), of each pixel of the files under path, one task a file or more.

    The grid is that of the asked variables with two dimensions; one along only one of those is repeated over the other; a variable
    that a file lacks, or of another shape, is NULL there. Rows count from the north: where the coordinate y grows with the rows, they are turned. A file that is damaged or holds none of the variables fails the job, with its name.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    _, there, read = _open(content)
                    grid = next((there[v][0] for v in variables if v in there and len(there[v][0]) == 2), None)
                    if grid is None:
                        raise ValueError("none of the variables has two dimensions")
                    decoded = {v: _decoded(np.asarray(read(v)), there[v][1]) for v in variables if v in there and there[v][0] in (grid, grid[:1], grid[1:])}
                except Exception as e:
                    raise ValueError(f"{name}: {e}") from e
                height, width = next(x.shape for x in decoded.values() if x.ndim == 2)
                up = _decoded(np.asarray(read("y")), there["y"][1]) if "y" in there and there["y"][0] == grid[:1] else np.zeros(0)
                turned = len(up) > 1 and up[-1] > up[0]
                at_once = max(1, BATCH // max(width, 1))
                for r in range(0, height, at_once):
                    rows = np.arange(r, min(r + at_once, height))
                    out = {"granule_id": _granule_id(name), "row": np.repeat(height - 1 - rows if turned else rows, width).astype(np.int32), "col": np.tile(np.arange(width, dtype=np.int32), len(rows))}
                    for v in variables:
                        x = decoded.get(v)
                        if x is None:
                            out[v] = np.full(len(rows) * width, np.nan)
                        elif x.ndim == 2:
                            out[v] = x[rows].ravel()
                        else:
                            out[v] = np.repeat(x[rows], width) if there[v][0] == grid[:1] else np.tile(x, len(rows))
                    yield pd.DataFrame(out)

    pixels = files.mapInPandas(run, "granule_id string, row int, col int, " + ", ".join(f"`{v}` double" for v in variables))
    return pixels.select("granule_id", "row", "col", *[F.nanvl(F.col(f"`{v}`"), F.lit(None).cast("double")).alias(v) for v in variables])


def read_granule_table(spark: SparkSession, path: str, pattern: str = "*.nc") -> DataFrame:
    """One row a file: granule_id, path, dims and attributes (text), crs_wkt (of the variable that holds one), the box of x and y, and res_x and res_y.

    Where a file has no coordinate x or y, its box is NULL. The box reaches half a pixel beyond the outer centres.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    attributes, there, read = _open(content)
                    dims = {d: int(n) for v in there for d, n in zip(there[v][0], np.shape(read(v)), strict=True)}
                    wkt = next((str(a[k]) for _, a in there.values() for k in ("crs_wkt", "spatial_ref") if k in a), None)
                    ends = {}
                    for axis in ("x", "y"):
                        values = _decoded(np.asarray(read(axis)), there[axis][1]) if axis in there else np.zeros(0)
                        res = abs(float(values[1] - values[0])) if len(values) > 1 else None
                        ends[axis] = (None, None, None) if res is None else (float(values.min()) - res / 2, float(values.max()) + res / 2, res)
                except Exception as e:
                    raise ValueError(f"{name}: {e}") from e
                (minx, maxx, res_x), (miny, maxy, res_y) = ends["x"], ends["y"]
                row = {"granule_id": _granule_id(name), "path": name, "dims": dims, "attributes": {k: str(v) for k, v in attributes.items()}, "crs_wkt": wkt, "minx": minx, "miny": miny, "maxx": maxx, "maxy": maxy, "res_x": res_x, "res_y": res_y}
                yield pd.DataFrame({k: pd.Series([v], dtype=object if k in ("dims", "attributes", "granule_id", "path", "crs_wkt") else "float64") for k, v in row.items()})

    return files.mapInPandas(run, "granule_id string, path string, dims map<string,long>, attributes map<string,string>, crs_wkt string, minx double, miny double, maxx double, maxy double, res_x double, res_y double")
