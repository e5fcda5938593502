"""Nested OSM JSON documents and GeoJSON as typed frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<lat:double,lon:double>"
ELEMENT = f"struct<type:string,id:bigint,tags:map<string,string>,geometry:array<{POINT}>,members:array<struct<type:string,role:string,geometry:array<{POINT}>>>>"
#: Waterway classes that are lines, and feature types of water polygons (fixed values).
CLASSES = ("river", "stream", "canal", "drain", "ditch")
POLYGON_TYPES = {"river": 460, "stream": 460, "canal": 336, "reservoir": 436, "lagoon": 493, "lake": 390, "pond": 390}
FLOWING = ("river", "canal", "stream")  # water that is an area, not a body
TAG_ORDERS = {"river": 3, "canal": 2}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Elements of response documents; a damaged document gives no rows."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<elements:array<{ELEMENT}>>").alias("d"))
    return docs.select(F.explode("d.elements").alias("e")).select("e.*")


def _tag(key: str) -> Column:
    return F.try_element_at("tags", F.lit(key))


def waterways(elements: DataFrame) -> DataFrame:
    """Lines with the attributes that follow from tags."""
    yes = lambda c, *v: F.coalesce(c.isin(*v), F.lit(False))
    kind = _tag("waterway")
    culvert = yes(_tag("tunnel"), "culvert", "yes") | yes(_tag("culvert"), "yes") | yes(_tag("covered"), "yes")
    order = F.when(kind == "river", TAG_ORDERS["river"]).when(kind == "canal", TAG_ORDERS["canal"]).otherwise(1)
    dry = yes(_tag("intermittent"), "yes")
    return elements.where((F.col("type") == "way") & kind.isNotNull() & (F.size("geometry") >= 2)).select(
        F.col("id").alias("line"), F.concat(F.lit("osm-w"), "id").alias("id"), clean_name(_tag("name")).alias("name"), culvert.alias("culvert"), dry.alias("intermittent"), order.alias("tag_order"),
        F.when(kind == "canal", 336).otherwise(460).alias("ftype"), F.when(dry, 46003).otherwise(46006).alias("fcode"), "geometry")


def clean_name(name: Column) -> Column:
    """A name, NULL where it says that there is none."""
    return F.when(~name.isin("nan", "None", ""), name)


def _water(rows: DataFrame) -> DataFrame:
    """Adds flowing (an area, not a body) and ftype by the kind of water."""
    types = F.create_map(*[F.lit(x) for kv in POLYGON_TYPES.items() for x in kv])
    flowing = F.coalesce(_tag("water").isin(*FLOWING), F.lit(False))
    return rows.withColumns({"flowing": flowing, "ftype": F.coalesce(F.try_element_at(types, _tag("water")), F.when(flowing, 460).otherwise(390))})


def water_polygons(elements: DataFrame) -> DataFrame:
    """Closed ways of water: at least four points, the last the first."""
    closed = (F.size("geometry") >= 4) & (F.element_at("geometry", 1) == F.element_at("geometry", -1))
    ways = elements.where((F.col("type") == "way") & (_tag("natural") == "water") & _tag("waterway").isNull() & closed)
    return _water(ways).select("id", clean_name(_tag("name")).alias("name"), "flowing", "ftype", "geometry")


def water_relations(elements: DataFrame) -> DataFrame:
    """The member ways of relations of water, in order: inner ones by their role, all others are outer."""
    rel = _water(elements.where((F.col("type") == "relation") & (_tag("natural") == "water")))
    m = rel.select("id", clean_name(_tag("name")).alias("name"), "flowing", "ftype", F.posexplode("members").alias("way", "m"))
    use = (F.col("m.type") == "way") & (F.size("m.geometry") >= 2)
    return m.where(use).select("id", "name", "flowing", "ftype", F.when(F.col("m.role") == "inner", "inner").otherwise("outer").alias("role"), "way", F.col("m.geometry").alias("geometry"))


def coastlines(elements: DataFrame) -> DataFrame:
    return elements.where((F.col("type") == "way") & (_tag("natural") == "coastline") & _tag("waterway").isNull()).select("id")


def query_text(south: float, west: float, north: float, east: float) -> str:
    """The request for a bounding box: water lines and areas, and the coastline."""
    box = f"{south:.5f},{west:.5f},{north:.5f},{east:.5f}"
    lines = "|".join(CLASSES)
    return f'[out:json][timeout:180];(way["waterway"~"^({lines})$"]({box});way["natural"="water"]({box});relation["natural"="water"]({box});way["natural"="coastline"]({box}););out geom;'
