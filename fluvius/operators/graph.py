"""Connected components and hop levels of graphs held as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvius.session import drop_table, write_table


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node above has one edge and is below no other: every component is then a star around its smallest node."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("low")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up + low > 1 and up > 0").isEmpty()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge, by alternating large and small stars.

    A round is two group-by minima and two joins on plain columns, so a hub is pre-aggregated before it is shuffled and a
    skewed join can be split; no neighbourhood is ever collected. Rounds end when all that is left are stars. Each round
    is a table in the shared folder. Null ends, loops and repeated edges are ignored.
    """
    a, b = F.col(src), F.col(dst)
    edges = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = write_table(edges.distinct(), "edges")
    while not _is_stars(now):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = write_table(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = write_table(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        drop_table(large)
        drop_table(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def snap_edges(lines: DataFrame, cell: float) -> DataFrame:
    """Directed edges (src above, dst below) of lines (line, x1, y1 first vertex, x2, y2 last) whose ends snap to the same cell."""
    key = lambda x, y: F.struct(F.rint(F.col(x) / cell).cast("long").alias("x"), F.rint(F.col(y) / cell).cast("long").alias("y"))
    a = lines.select(F.col("line").alias("src"), key("x2", "y2").alias("k"))
    b = lines.select(F.col("line").alias("dst"), key("x1", "y1").alias("k"))
    return a.join(b, "k").where("src <> dst").select("src", "dst")


def touch_edges(lines: DataFrame, cell: float) -> DataFrame:
    """Undirected links between lines that share an end cell, as a star around the cell's first line."""
    key = lambda x, y: F.struct(F.rint(F.col(x) / cell).cast("long").alias("x"), F.rint(F.col(y) / cell).cast("long").alias("y"))
    ends = lines.select("line", key("x1", "y1").alias("k")).unionAll(lines.select("line", key("x2", "y2").alias("k")))
    least = ends.groupBy("k").agg(F.min("line").alias("dst"))
    return ends.join(least, "k").where("line <> dst").select(F.col("line").alias("src"), "dst").distinct()


def upstream_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, raw): hops from the nearest outlet (a node without a way down is 1), going up; raw is 0 where no outlet is
    reached, level then 1. One join per hop over written tables."""
    outlets = nodes.select("node").distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti")
    seen = write_table(outlets.withColumn("raw", F.lit(1)), "levels")
    front, level = seen, 1
    while True:
        level += 1
        up = front.join(edges, front["node"] == edges["dst"]).select(F.col("src").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = write_table(up.withColumn("raw", F.lit(level)), "front")
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return nodes.select("node").distinct().join(seen, "node", "left").select("node", F.coalesce("raw", F.lit(1)).alias("level"), F.coalesce("raw", F.lit(0)).alias("raw"))


def network_flags(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds down (the least raw level below, else 0), start (nothing above) and terminal (nothing below) to levels."""
    below = edges.join(levels.select(F.col("node").alias("dst"), F.col("raw").alias("d")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("d").alias("down"))
    above = edges.select(F.col("dst").alias("node")).distinct().withColumn("a", F.lit(1))
    out = levels.join(below, "node", "left").join(above, "node", "left")
    return out.select("node", "level", F.coalesce("down", F.lit(0)).alias("down"), F.when(F.col("a").isNull(), 1).otherwise(0).alias("start"), F.when(F.col("down").isNull(), 1).otherwise(0).alias("terminal"))
