"""Proposals of placements on a small map whose results are known by hand."""

import pytest
from pyspark.sql import functions as F

from fluvius.operators import proposal

LINE = "line int, path int, ord int, name string, drainage double, hydroseq int, startflag int, flowdir int, culvert boolean"
SEGMENT = "line int, seq int, x1 double, y1 double, x2 double, y2 double"
BORDER = proposal.Border((0, 0, 10_000, 10_000), 100.0, 100)


def ring(poly, *points):
    return [(poly, *map(float, (*a, *b))) for a, b in zip(points, (*points[1:], points[0]), strict=True)]


def square(poly, x, y, side):
    return ring(poly, (x, y), (x + side, y), (x + side, y + side), (x, y + side))


@pytest.fixture(scope="module")
def got(spark):
    lines = [
        (1, 10, 6, "Great", 500.0, 1, 0, 1, False),  # from the west border to the east border
        (2, 20, 6, None, 400.0, 1, 0, 0, False),  # an arm 200 m beside it: the named one stays
        (3, 30, 7, "Under", 900.0, 1, 0, 1, True),  # in a culvert
        (4, 40, 7, "Nick", 800.0, 1, 0, 1, False),  # crosses the south border out and in, 100 m apart
        (5, 50, 4, "Spring", 40.0, 1, 1, 1, False),  # starts inside
        (6, 60, 5, None, 10.0, 1, 0, 1, None),  # enters at the north border
        (7, 10, 4, "Side", 99.0, 9, 1, 1, False),  # on the great river's path
        (8, 80, 4, "Outside", 99.0, 9, 1, 1, False),
        (9, 90, 5, "Late", 4.0, 1, 0, 1, False),  # starts inside, without a flag
    ]
    segments = [
        (1, 1, -500.0, 5000.0, 10500.0, 5000.0),
        (2, 1, -500.0, 5200.0, 10500.0, 5200.0),
        (3, 1, -500.0, 8000.0, 10500.0, 8000.0),
        (4, 1, 3000.0, 500.0, 3000.0, -50.0),
        (4, 2, 3000.0, -50.0, 3100.0, -50.0),
        (4, 3, 3100.0, -50.0, 3100.0, 500.0),
        (5, 1, 2050.0, 2050.0, 2050.0, 4000.0),
        (6, 1, 7000.0, 10500.0, 7000.0, 6000.0),
        (7, 1, 6000.0, 6000.0, 6000.0, 5500.0),
        (8, 1, 20000.0, 20000.0, 20000.0, 21000.0),
        (9, 1, 9000.0, 1000.0, 9500.0, 1000.0),
    ]
    polygons = [(1, 390, "Tarn", True), (2, 390, "Weir", True), (3, 390, "Pond", True), (4, 445, None, False), (5, 390, "Far", True), (6, 460, None, False)]
    edges = square(1, 4000, 2000, 1000) + square(2, 4000, 4500, 1000) + square(3, 1000, 1000, 500) + ring(4, (9000, 7000), (12000, 7000), (12000, 8000), (9000, 8000)) + square(5, 9500, 500, 1000) + square(6, 7000, 2000, 2000)
    spark_edges = spark.createDataFrame(edges, "poly int, x1 double, y1 double, x2 double, y2 double")
    polygons = spark.createDataFrame(polygons, "poly int, ftype int, name string, body boolean")
    i = F.col("id")
    pixels = spark.range(10_000).select((i / 100).cast("int").alias("r"), (i % 100).cast("int").alias("c"))
    pixels = pixels.select("r", "c", F.col("c").cast("double").alias("z"), F.when(F.col("r") < 60, 7.04).alias("surface"), (F.col("r") < 60).alias("water"))
    args = spark.createDataFrame(lines, LINE), spark.createDataFrame(segments, SEGMENT), polygons, spark_edges, pixels
    return {r.key.split("-")[0] + ":" + r.label: r for r in proposal.propose(*args, BORDER).collect()}


def test_rivers_cross_once_per_direction_and_bends_not_at_all(got):
    rivers = [r for k, r in got.items() if k.startswith("river:")]
    assert sorted((r.kind, r.label, r.c, r.r) for r in rivers) == [
        ("water.border_river_in", "Great inflow (W edge)", 0, 50),
        ("water.border_river_out", "Great outflow (E edge)", 99, 50),
    ]
    assert all(r.level == 7.0 and r.confidence == "high" and r.drainage == 500.0 for r in rivers)


def test_streams_start_at_springs_edges_and_upstream_ends(got):
    want = {"Spring": ("headwater", 20, 79, 1.0, "large", 8.0), "unnamed order-5 stream (N edge)": ("edge", 70, 0, 0.25, "medium", 7.0), "Late": ("upstream end", 90, 90, 0.1, "small", 78.0)}
    assert {k.split(":")[1]: (r.entry, r.c, r.r, r.rate, r["size"], r.level) for k, r in got.items() if r.kind == "water.stream"} == want


def test_lakes_inside_without_great_rivers_and_seas_on_the_border(got):
    lakes = {r.label: (r.area_km2, r.c, r.r) for r in got.values() if r.kind == "water.lake"}
    assert lakes == {"Tarn": (1.0, 45, 75), "unnamed lake": (4.0, 80, 70)}
    (sea,) = [r for r in got.values() if r.kind == "water.border_sea"]
    assert (sea.label, sea.c, sea.r, sea.edge_km) == ("sea (E edge)", 99, 25, 1.0)


def test_empty_tables_propose_nothing(spark):
    none = lambda s: spark.createDataFrame([], s)
    pixels = none("r int, c int, z double, surface double, water boolean")
    args = none(LINE), none(SEGMENT), none("poly int, ftype int, name string, body boolean"), none("poly int, x1 double, y1 double, x2 double, y2 double"), pixels
    assert proposal.propose(*args, BORDER).count() == 0
