"""Rasters, lines, points and run histories derived from the given tables, with the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c, z, kind: events as pixels of a raster 100 wide."""
    e = table(spark, sf_dir, "events")
    return e.select(F.expr(f"cast(event_id div {WIDTH} as int)").alias("r"), (F.col("event_id") % WIDTH).cast("int").alias("c"), F.col("value").alias("z"), F.col("event_type").alias("kind"))


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster with nodata (NULL) at one kind of event."""
    return raster(spark, sf_dir).select("r", "c", F.when(F.col("kind") != "error", F.col("z")).alias("z"), (F.col("kind") == "view").alias("m"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, seq (from 1), x, y: an order's items are the vertices of a line."""
    t = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return t.select(F.col("l_orderkey").alias("line"), F.row_number().over(order).alias("seq"), F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"))


def segments(v: DataFrame) -> DataFrame:
    """line, seq, x1, y1, x2, y2 of consecutive vertices."""
    w = Window.partitionBy("line").orderBy("seq")
    return v.select("line", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")


RAS = f"ras as (select cast(event_id // {WIDTH} as int) r, cast(event_id % {WIDTH} as int) c, value z, event_type kind from events)"
HOLES = RAS + ", holes as (select r, c, case when kind <> 'error' then z end z, kind = 'view' m from ras)"
VERT = "vert as (select l_orderkey line, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) as int) seq, cast(l_partkey as double) x, cast(l_suppkey as double) y from lineitem)"
SEG = VERT + ", seg as (select * from (select line, seq, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from vert window w as (partition by line order by seq)) where x2 is not null)"
