"""A sink of polygon shapefiles: shapes, their index, the attribute table and the projection, one set of files a task."""

from __future__ import annotations

import datetime
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T

from hydroseries.sources.sinks import TwoPhaseWriter, sink

POLYGON = 5
TEXT_WIDTH, NUMBER_WIDTH = 254, 25


def field_names(names: list[str]) -> list[str]:
    """Ten bytes are all that the format has: longer names are cut, and numbered where that makes them alike."""
    out: list[str] = []
    for name in names:
        short, k = name.encode("ascii", "replace")[:10].decode(), 1
        while short.lower() in (x.lower() for x in out):
            short = f"{name.encode('ascii', 'replace')[: 9 - len(str(k))].decode()}_{k}"
            k += 1
        out.append(short)
    return out


def _field(kind: T.DataType) -> tuple[bytes, int, int]:
    """Letter, width and decimals; numbers are written as text that reads back as the same number."""
    if isinstance(kind, T.DateType):
        return b"D", 8, 0
    if isinstance(kind, T.BooleanType):
        return b"L", 1, 0
    if isinstance(kind, (T.IntegralType,)):
        return b"N", 20, 0
    return (b"F", NUMBER_WIDTH, 15) if isinstance(kind, (T.FractionalType,)) else (b"C", TEXT_WIDTH, 0)


def _cell(value, letter: bytes, width: int, name: str) -> bytes:
    if value is None:
        return b" " * width
    if letter == b"D":
        return value.strftime("%Y%m%d").encode()
    if letter == b"L":
        return b"T" if value else b"F"
    raw = (repr(float(value)) if letter == b"F" else str(value)).encode()
    if len(raw) > width:
        raise ValueError(f"{name}: {len(raw)} bytes, the format holds {width}")
    return raw.ljust(width) if letter == b"C" else raw.rjust(width)


def polygon(rings: list[list[tuple[float, float]]]) -> bytes:
    """The content of a record; no rings give a null shape."""
    if not rings:
        return struct.pack("<i", 0)
    points = [p for ring in rings for p in ring]
    xs, ys = [x for x, _ in points], [y for _, y in points]
    starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
    head = struct.pack("<i4d2i", POLYGON, min(xs), min(ys), max(xs), max(ys), len(rings), len(points))
    return head + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def _header(length: int, box: list[float]) -> bytes:
    """length: bytes of the whole file."""
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, length // 2) + struct.pack("<2i", 1000, POLYGON) + struct.pack("<4d", *box) + bytes(32)


class ShapefileWriter(TwoPhaseWriter):
    """Rows stream into the files; headers, which need counts and the box, are written last."""

    def write_files(self, rows: Iterator[Row], folder: str) -> None:
        stem = f"{folder}/part-{uuid.uuid4().hex}"
        fields = [f for f in self.schema.fields if f.name != "rings"]
        shapes = list(zip(field_names([f.name for f in fields]), [_field(f.dataType) for f in fields], strict=True))
        width = 1 + sum(w for _, (_, w, _) in shapes)
        n, box = 0, [float("inf"), float("inf"), float("-inf"), float("-inf")]
        with open(f"{stem}.shp", "wb") as shp, open(f"{stem}.shx", "wb") as shx, open(f"{stem}.dbf", "wb") as dbf:
            for file in (shp, shx):
                file.write(bytes(100))
            head = 32 + 32 * len(shapes) + 1
            dbf.write(bytes(head))
            for row in rows:
                n += 1
                rings = [[(p["x"], p["y"]) for p in ring] for ring in row["rings"] or []]
                body = polygon(rings)
                shx.write(struct.pack(">2i", shp.tell() // 2, len(body) // 2))
                shp.write(struct.pack(">2i", n, len(body) // 2) + body)
                dbf.write(b" " + b"".join(_cell(row[f.name], letter, w, f.name) for f, (_, (letter, w, _)) in zip(fields, shapes, strict=True)))
                for ring in rings:
                    for x, y in ring:
                        box = [min(box[0], x), min(box[1], y), max(box[2], x), max(box[3], y)]
            dbf.write(b"\x1a")
            box = box if n and box[0] <= box[2] else [0.0] * 4
            for file in (shp, shx):
                length = file.tell()
                file.seek(0)
                file.write(_header(length, box))
            today = datetime.date.today()
            dbf.seek(0)
            dbf.write(struct.pack("<4BIHH20x", 3, today.year - 1900, today.month, today.day, n, head, width))
            for name, (letter, w, decimals) in shapes:
                dbf.write(name.encode().ljust(11, b"\0") + letter + bytes(4) + bytes([w, decimals]) + bytes(14))
            dbf.write(b"\r")
        with open(f"{stem}.cpg", "w") as cpg:
            cpg.write("UTF-8")
        if self.options.get("crs"):
            with open(f"{stem}.prj", "w") as prj:
                prj.write(self.options["crs"])


Shapefiles = sink("shapefiles", ShapefileWriter)


def write_shapefiles(outlines: DataFrame, path: str, properties: list[str], crs: str | None = None, mode: str = "append") -> None:
    """Features with rings, and properties (numbers, texts of up to TEXT_WIDTH bytes, dates, booleans) as attributes; nulls are blank.

    crs: the text of the projection, for all files. Each task writes a set of files of its own; coalesce outlines for fewer.
    """
    outlines.sparkSession.dataSource.register(Shapefiles)
    kept = outlines.select("rings", *properties)
    kept.write.format("shapefiles").mode(mode).options(path=path, **({"crs": crs} if crs else {})).save()
