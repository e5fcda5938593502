"""Rings from the member ways of multipolygon relations."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def stitch(ways: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings of ways joined at equal ends, either way round; of several that fit the first goes on. What does not close is dropped."""
    rings = [w for w in ways if len(w) > 3 and w[0] == w[-1]]
    left = {i: w for i, w in enumerate(ways) if len(w) > 1 and w[0] != w[-1]}
    at = defaultdict(set)
    for i, w in left.items():
        at[w[0]].add(i)
        at[w[-1]].add(i)
    while left:
        i = next(iter(left))
        line = list(left.pop(i))
        while line[0] != line[-1]:
            fits = [j for j in at[line[-1]] if j in left]
            if not fits:
                break
            on = left.pop(min(fits))
            line += on[1:] if on[0] == line[-1] else on[-2::-1]
        if len(line) > 3 and line[0] == line[-1]:
            rings.append(line)
    return rings


def assemble(members: DataFrame) -> DataFrame:
    """(rel, role, ring, points) of members (rel, role, way, points). A group is one relation's ways of one role."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        ways = [[(p["x"], p["y"]) for p in w] for w in g.sort_values("way")["points"]]
        rings = stitch(ways)
        points = pd.Series([[{"x": x, "y": y} for x, y in r] for r in rings], dtype=object)
        return pd.DataFrame({"rel": key[0], "role": key[1], "ring": np.arange(len(rings)), "points": points})

    rel = members.schema["rel"].dataType.simpleString()
    return members.groupBy("rel", "role").applyInPandas(run, f"rel {rel}, role string, ring long, points {POINTS}")


def area(points: Column) -> Column:
    """Area that a closed ring holds, without sign."""
    step = F.zip_with(points, F.slice(points, 2, F.size(points)), lambda a, b: F.coalesce(a["x"] * b["y"] - b["x"] * a["y"], F.lit(0.0)))
    return F.abs(F.aggregate(step, F.lit(0.0), lambda s, v: s + v)) / 2


def polygon_areas(rings: DataFrame, least: float = 500.0) -> DataFrame:
    """(rel, area): outer rings less the inner ones, of relations of at least ``least`` square metres."""
    a = area(F.col("points"))
    total = rings.groupBy("rel").agg(F.sum(F.when(F.col("role") == "inner", -a).otherwise(a)).alias("area"))
    return total.where(F.col("area") >= least)
