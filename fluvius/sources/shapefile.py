"""Lines of zipped shapefiles with the standard library and numpy, staged as Parquet with their bounds so that a box reads few rows."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_TYPES = (3, 13, 23)  # with z or m: these follow the points and are not read
GEOMETRY = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
SCHEMA = "river long, ORD_STRA int, UPLAND_SKM double, DIS_AV_CMS double, minx double, miny double, maxx double, maxy double, geometry array<struct<lon:double,lat:double>>"


def _table(data: bytes, wanted: list[str]) -> tuple[int, dict[str, list]]:
    """Number columns of a dBASE table by name; empty cells are None."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    at, fields = 1, []
    for i in range(32, head - 1, 32):
        if data[i] == 0x0D:
            break
        fields.append((data[i : i + 11].split(b"\0")[0].decode("latin-1"), at, data[i + 16]))
        at += data[i + 16]
    out = {}
    for name, start, width in fields:
        if name in wanted:
            cells = [data[head + k * size + start : head + k * size + start + width].strip(b" \0*") for k in range(n)]
            out[name] = [float(c) if c else None for c in cells]
    return n, out


def _shapes(data: bytes) -> Iterator[list[np.ndarray]]:
    """The parts of each record's line; none for records of other types."""
    at = 100
    while at + 8 <= len(data):
        words = struct.unpack(">I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if struct.unpack("<i", body[:4])[0] not in LINE_TYPES:
            yield []
            continue
        parts, points = struct.unpack("<ii", body[36:44])
        begins = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
        yield [xy[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]


def decode(archive: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of the first shapefile of an archive, one for each part of a line, in batches."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        name = next(n for n in z.namelist() if n.lower().endswith(".shp"))
        columns = ["ORD_STRA", "UPLAND_SKM", "DIS_AV_CMS"]
        table = next(n for n in z.namelist() if n.lower() == name[:-4].lower() + ".dbf")
        _, values = _table(z.read(table), columns)
        rows = []

        def batch() -> pa.RecordBatch:
            lines = [r[1] for r in rows]
            get = lambda c, r: values[c][r] if c in values else None
            arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array([None if get(columns[0], r[0]) is None else int(get(columns[0], r[0])) for r in rows], pa.int32()), *[pa.array([get(c, r[0]) for r in rows], pa.float64()) for c in columns[1:]]]
            arrays += [pa.array([f(p[:, k]) for p in lines], pa.float64()) for f, k in ((np.min, 0), (np.min, 1), (np.max, 0), (np.max, 1))]
            flat = np.concatenate(lines)
            ends = np.cumsum([0, *map(len, lines)]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["lon", "lat"])))
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(", ")[:8]] + ["geometry"])

        for i, parts in enumerate(_shapes(z.read(name))):
            rows += [(i, p) for p in parts if len(p) > 1]
            if len(rows) >= 20_000:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


def rivers(spark: SparkSession, path: str) -> DataFrame:
    """river (the record), ORD_STRA, UPLAND_SKM, DIS_AV_CMS, bounds and geometry of zipped shapefiles; an archive is a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(0):
                yield from decode(body.as_buffer().to_pybytes())

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def within(staged: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rivers (river, strahler, upland, discharge, geometry) whose bounds meet a box in degrees: the bounds are pushed to the scan."""
    west, south, east, north = map(float, box)
    meet = (F.col("minx") <= east) & (F.col("maxx") >= west) & (F.col("miny") <= north) & (F.col("maxy") >= south)
    return staged.where(meet).select("river", F.col("ORD_STRA").alias("strahler"), F.col("UPLAND_SKM").alias("upland"), F.col("DIS_AV_CMS").alias("discharge"), "geometry")
