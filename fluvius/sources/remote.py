"""Remote services as Spark data sources: requests that are tried again, paged features, catalogues, and tiles of terrain.

Requests run in the tasks of a Python data source, one partition for each request or tile, so a lost executor costs that request
only. Answers are JSON or GeoTIFF; everything after the answer is DataFrame code.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fluvius.sources import geotiff, osm

TRIES, WAIT = 4, 2.0
MIRROR_TRIES, MIRROR_WAIT = 6, 3.0
PAGE = 2000
LAYERS = {"flowline": 3, "area": 8, "waterbody": 9}
NO_DATA = -999_998.0  # at or below: no terrain
LEAST_VALID = 0.98
COPERNICUS = "https://copernicus-dem-30m.s3.amazonaws.com"


class FetchError(RuntimeError):
    """A request that failed for good."""


def get(url: str, params: dict | None = None, kind: str | None = None, tries: int = TRIES, wait: float = WAIT, data: bytes | None = None, missing: bool = False) -> bytes | None:
    """The body of an answer of status 200 (and of a content type that holds ``kind``), tried again with growing pauses. The message
    of an error document is that of the error. With ``missing`` an answer of status 404 is None."""
    full = url + ("?" + urllib.parse.urlencode(params) if params else "")
    said = ""
    for n in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(full, data), timeout=300) as r:
                body, given = r.read(), r.headers.get("Content-Type", "")
            if kind is None or kind in given:
                return body
            said = f"content type {given}"
            if "json" in given:
                said = str(json.loads(body).get("error", said))
        except urllib.error.HTTPError as e:
            if e.code == 404 and missing:
                return None
            said = f"HTTP {e.code}"
        except (urllib.error.URLError, OSError, ValueError) as e:
            said = str(e)
        if n + 1 < tries:
            time.sleep(wait * (n + 1))
    raise FetchError(f"{url}: {said}")


def mirrored(urls: list[str], text: str, tries: int = MIRROR_TRIES, wait: float = MIRROR_WAIT) -> bytes:
    """The answer to a query, asked of mirrors in turn until one gives a document with elements."""
    said = ""
    for n in range(tries):
        try:
            body = get(urls[n % len(urls)], tries=1, data=urllib.parse.urlencode({"data": text}).encode())
            if "elements" in json.loads(body):
                return body
            said = "no elements"
        except (FetchError, ValueError) as e:
            said = str(e)
        if n + 1 < tries:
            time.sleep(wait * (n + 1))
    raise FetchError(f"{urls[0]}: {said}")


class _Request(InputPartition):
    def __init__(self, options: dict):
        super().__init__(options)


class _Documents(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Request(o) for o in json.loads(self.options["requests"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = partition.value
        wait = float(o.get("wait", WAIT))
        if "mirrors" in o:
            yield o.get("key", ""), 0, mirrored(o["mirrors"], o["query"], wait=wait).decode()
            return
        if not o.get("paged"):
            yield o.get("key", ""), 0, get(o["url"], o.get("params"), "json", wait=wait).decode()
            return
        at = page = 0
        while True:
            params = {**o.get("params", {}), "resultOffset": at, "resultRecordCount": int(o.get("page", PAGE)), "f": "geojson"}
            body = get(o["url"], params, "json", wait=wait)
            found = json.loads(body)
            n = len(found.get("features", []))
            if n:
                yield o.get("key", ""), page, body.decode()
            more = found.get("exceededTransferLimit") or found.get("properties", {}).get("exceededTransferLimit")
            if not more or not n:
                return
            at, page = at + n, page + 1


class Documents(DataSource):
    """key, page, body of JSON requests (option ``requests``: a JSON list of url, params, key, paged, or mirrors and query)."""

    @classmethod
    def name(cls) -> str:
        return "json_requests"

    def schema(self) -> str:
        return "key string, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Documents(self.options)


def documents(spark: SparkSession, requests: list[dict]) -> DataFrame:
    spark.dataSource.register(Documents)
    return spark.read.format("json_requests").option("requests", json.dumps(requests)).load()


def envelope(west: float, south: float, east: float, north: float) -> dict:
    """Parameters of a query by a box in degrees."""
    box = f"{west:.6f},{south:.6f},{east:.6f},{north:.6f}"
    return {"geometry": box, "geometryType": "esriGeometryEnvelope", "inSR": 4326, "outSR": 4326, "spatialRel": "esriSpatialRelIntersects"}


def catalogue(docs: DataFrame, lat: float) -> DataFrame:
    """One row, finest_ground_m, finest_name, datasets: of a catalogue's answers the footprints of category 1, the finest by its
    resolution at this latitude. Without any an error."""
    kind = "struct<features:array<struct<attributes:struct<Name:string,Category:int,LowPS:double>>>>"
    f = docs.select(F.explode(F.from_json("body", kind)["features"]).alias("f")).select("f.attributes.*").where("Category = 1")
    ground = F.bround(F.min("LowPS") * F.cos(F.radians(F.lit(lat))), 2)
    g = f.agg(ground.alias("finest_ground_m"), F.min(F.struct("LowPS", "Name"))["Name"].alias("finest_name"), F.array_sort(F.collect_set("Name")).alias("datasets"))
    none = F.raise_error(F.lit("the catalogue has no terrain here")).cast("double")
    return g.withColumn("finest_ground_m", F.coalesce("finest_ground_m", none))


def covers(docs: DataFrame) -> bool:
    """Whether a catalogue has terrain; any failure of the request counts as none."""
    try:
        kind = "struct<features:array<struct<attributes:struct<Category:int>>>>"
        return not docs.select(F.explode(F.from_json("body", kind)["features"]).alias("f")).where("f.attributes.Category = 1").isEmpty()
    except Exception as e:  # the request failed in a task: the service is as good as absent
        if "FetchError" in str(e):
            return False
        raise


def features(docs: DataFrame, properties: str) -> DataFrame:
    """Rows of GeoJSON answers: the properties (a struct type, names in lower case) and geometry (type and coordinates as JSON)."""
    kind = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
    f = docs.select(F.explode(F.from_json("body", kind)["features"]).alias("f"))
    lowered = F.transform_keys(F.col("f.properties"), lambda k, v: F.lower(k))
    cols = [c.strip().split(":") for c in properties.removeprefix("struct<").removesuffix(">").split(",")]
    return f.select(*[F.try_element_at(lowered, F.lit(n)).cast(t).alias(n) for n, t in cols], F.col("f.geometry.type").alias("shape"), F.col("f.geometry.coordinates").alias("coordinates"))


def lines(found: DataFrame) -> DataFrame:
    """Features of lines with ``geometry``, an array of lon, lat, a row for each part of a line."""
    one = F.when(F.col("shape") == "MultiLineString", F.from_json("coordinates", "array<array<array<double>>>")).when(F.col("shape") == "LineString", F.array(F.from_json("coordinates", "array<array<double>>")))
    parts = found.withColumn("_part", F.explode(one))
    return parts.withColumn("geometry", F.transform("_part", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))).drop("_part", "shape", "coordinates")


def polygons(found: DataFrame) -> DataFrame:
    """Features of polygons with ``rings``, arrays of lon, lat, a row for each part of a multipolygon."""
    one = F.when(F.col("shape") == "MultiPolygon", F.from_json("coordinates", "array<array<array<array<double>>>>")).when(F.col("shape") == "Polygon", F.array(F.from_json("coordinates", "array<array<array<double>>>")))
    parts = found.withColumn("_part", F.explode(one))
    return parts.withColumn("rings", F.transform("_part", lambda g: F.transform(g, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))).drop("_part", "shape", "coordinates")


def layer(spark: SparkSession, service: str, name: str, box: tuple, where: str = "1=1", fields: str = "*", required: bool = False, wait: float = WAIT) -> DataFrame:
    """Pages of one layer of a national service that meet a box in degrees; none where some are required is an error."""
    params = {"where": where, "outFields": fields, **envelope(*box)}
    docs = documents(spark, [{"url": f"{service}/{LAYERS[name]}/query", "params": params, "paged": True, "key": name, "wait": wait}])
    if required and docs.isEmpty():
        raise FetchError(f"the layer {name} has nothing in the extent")
    return docs


def elements(spark: SparkSession, mirrors: list[str], box: tuple, wait: float = MIRROR_WAIT) -> DataFrame:
    """Mapped elements of a box (west, south, east, north) in degrees, as rows of ``osm``."""
    west, south, east, north = box
    docs = documents(spark, [{"mirrors": mirrors, "query": osm.query_text(south, west, north, east), "wait": wait}])
    return docs.select(F.explode(F.from_json("body", f"struct<elements:array<{osm.ELEMENT}>>")["elements"]).alias("e")).select("e.*")


class _Tiles(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Request(o) for o in json.loads(self.options["tiles"])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import numpy as np

        o = partition.value
        body = get(o["url"], o.get("params"), "tiff" if o.get("typed") else None, wait=float(o.get("wait", WAIT)), missing=bool(o.get("missing")))
        names = ["tile", "west", "north", "mpp", "r", "c", "z"]
        if body is None:  # no tile: open ocean
            yield pa.RecordBatch.from_arrays([pa.array([o["tile"]]), *[pa.nulls(1, pa.float64())] * 3, *[pa.nulls(1, pa.int32())] * 2, pa.nulls(1, pa.float64())], names)
            return
        got = geotiff.decode(body)
        if "shape" in o and list(got.z.shape) != list(o["shape"]):
            raise FetchError(f"{o['tile']}: {got.z.shape} pixels instead of {o['shape']}")
        h, w = got.z.shape
        for r0 in range(0, h, 256):
            z = got.z[r0 : r0 + 256]
            r, c = np.indices(z.shape, np.int32)
            flat = z.ravel()
            yield pa.RecordBatch.from_arrays([pa.array([o["tile"]] * len(flat)), *[pa.array(np.full(len(flat), v)) for v in (got.west, got.north, got.mpp)], pa.array((r + r0).ravel()), pa.array(c.ravel()), pa.array(flat, pa.float64(), mask=np.isnan(flat))], names)


class Tiles(DataSource):
    """Pixels of terrain tiles (option ``tiles``: a JSON list of tile, url, params, shape, missing)."""

    @classmethod
    def name(cls) -> str:
        return "terrain_tiles"

    def schema(self) -> str:
        return "tile string, west double, north double, mpp double, r int, c int, z double"

    def reader(self, schema) -> DataSourceReader:
        return _Tiles(self.options)


def tiles(spark: SparkSession, wanted: list[dict]) -> DataFrame:
    spark.dataSource.register(Tiles)
    return spark.read.format("terrain_tiles").option("tiles", json.dumps(wanted)).load()


def export_tiles(service: str, grid: list, epsg: int, mpp: float, most: int = 8000) -> list[dict]:
    """Requests for the tiles of ``geo.tile_grid`` rows: floats, bilinear, in the zone's metres."""
    out = []
    for t in grid:
        if max(t.th, t.tw) > most:
            raise FetchError(f"a tile of more than {most} pixels")
        box = f"{t.x0},{t.y0 - t.th * mpp},{t.x0 + t.tw * mpp},{t.y0}"
        params = {"bbox": box, "bboxSR": epsg, "imageSR": epsg, "size": f"{t.tw},{t.th}", "format": "tiff", "pixelType": "F32", "interpolation": "RSP_BilinearInterpolation", "noData": -999999, "f": "image"}
        out.append({"tile": f"{t.r0},{t.c0}", "url": f"{service}/exportImage", "params": params, "shape": [t.th, t.tw], "typed": True})
    return out


def copernicus_tiles(names: list[str], service: str = COPERNICUS) -> list[dict]:
    """Requests for named one-degree tiles; those that do not exist are ocean."""
    return [{"tile": n, "url": f"{service}/{n}/{n}.tif", "missing": True} for n in names]


def known(z: Column) -> Column:
    """Terrain, NULL where a value stands for none."""
    return F.when((z > NO_DATA) & (z >= -1e4) & (z <= 1e5), z)


def placed(pixels: DataFrame) -> DataFrame:
    """r, c, z of the raster that tiles named by their first row and column make up."""
    at = F.split("tile", ",")
    return pixels.select((at[0].cast("int") + F.col("r")).alias("r"), (at[1].cast("int") + F.col("c")).alias("c"), known(F.col("z")).alias("z"))


def valid_share(dem: DataFrame) -> DataFrame:
    """One row, share and warn (below ``LEAST_VALID``); terrain without any valid pixel is an error."""
    share = F.avg(F.col("z").isNotNull().cast("double")).alias("share")
    d = dem.agg(share)
    none = F.raise_error(F.lit("the terrain is entirely nodata")).cast("double")
    return d.select(F.when(F.coalesce("share", F.lit(0.0)) == 0, none).otherwise(F.col("share")).alias("share"), (F.col("share") < LEAST_VALID).alias("warn"))
