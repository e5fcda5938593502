"""Resampling, mosaic and water-layer queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvius.operators import resample, water
from fluvius.plans.fixtures import RAS, raster
from fluvius.plans.rasters import _mirror, _r

QUERIES, ORACLE = {}, {}
_RAS = "ras as (select event_id // 100 r, event_id % 100 c, value z, event_type kind from events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _weight(t: str, k: str) -> str:
    return f"case {k} when -1 then (1 - {t}) ** 3 / 6 when 0 then (3 * {t} ** 3 - 6 * {t} ** 2 + 4) / 6 when 1 then (-3 * {t} ** 3 + 3 * {t} ** 2 + 3 * {t} + 1) / 6 else {t} ** 3 / 6 end"


@query(f"""with {_RAS}, p as (select r pr, c pc, c + (r * 7 + c * 3) % 10 / 10.0::double x, r + (r * 3 + c) % 10 / 10.0::double y from ras),
n as (select pr, pc, floor(x)::bigint + j.j c, floor(y)::bigint + i.i r, ({_weight("(x - floor(x))", "j.j")}) * ({_weight("(y - floor(y))", "i.i")}) w from p, range(-1, 3) i(i), range(-1, 3) j(j))
select pr, pc, round(sum(z * w) / sum(w), 6) z from n join ras using (r, c) where kind <> 'error' and w > 1e-9::double group by pr, pc""")
def resample_cubic(spark: SparkSession, d: str) -> DataFrame:
    """A point in every pixel, at a place of its own in it."""
    ras = raster(spark, d)
    r, c = F.col("pr"), F.col("pc")
    points = ras.select(F.col("r").alias("pr"), F.col("c").alias("pc"))
    return resample.cubic_spline(ras.where("kind <> 'error'"), c + (r * 7 + c * 3) % 10 / 10.0 + 0.5, r + (r * 3 + c) % 10 / 10.0 + 0.5, points).select("pr", "pc", _r("z"))


@query(f"with {_RAS} select floor((r + 0.5) / 2.5)::int r, floor((c + 0.5) / 2.5)::int c, round(avg(z), 6) z from ras group by all")
def resample_average(spark: SparkSession, d: str) -> DataFrame:
    return resample.area_mean(raster(spark, d), 2.5).select("r", "c", _r("z"))


@query(f"""with {_RAS}, tiles as (select case kind when 'view' then 2 when 'click' then 1 else 3 end ord, r // 2 r, c // 2 c, case when kind <> 'error' then z end z from ras),
one as (select r, c, ord, max(z) z from tiles group by all)
select r, c, coalesce(arg_min(z, ord) filter (z is not null), 0) z from one group by r, c""")
def mosaic_first_valid(spark: SparkSession, d: str) -> DataFrame:
    ras = raster(spark, d)
    ord_ = F.when(F.col("kind") == "view", 2).when(F.col("kind") == "click", 1).otherwise(3)
    tiles = ras.select(ord_.alias("ord"), F.expr("cast(r div 2 as int)").alias("r"), F.expr("cast(c div 2 as int)").alias("c"), F.when(F.col("kind") != "error", F.col("z")).alias("z"))
    return resample.mosaic(tiles.groupBy("ord", "r", "c").agg(F.max("z").alias("z")), 0.0)


_WATER = f"""{RAS}, kinds as (select r, c, z, (r // 10) % 3 = 0 and (c // 10) % 3 = 0 p, r % 40 = 15 l from ras),
src as (select r, c, case when p then z else 0 end v, case when p then 1.0::double else 0 end n from kinds), {_mirror('src', 'f', 'v, n', 4)},
a as (select r, c, sum(v) over w v, sum(n) over w n from f_m window w as (partition by r order by c range between 4 preceding and 4 following)),
b as (select r, c, sum(v) over w v, sum(n) over w n from a window w as (partition by c order by r range between 4 preceding and 4 following)),
sm as (select r, c, v / n mean from b where n > 0),
bank as (select k.r, k.c, sqrt(min((k.r - o.r) * (k.r - o.r) + (k.c - o.c) * (k.c - o.c))) d from kinds k, kinds o where k.p and not o.p group by 1, 2),
shore as (select k.r, k.c, sqrt(min((k.r - o.r) * (k.r - o.r) + (k.c - o.c) * (k.c - o.c))) d from kinds k, kinds o where k.l and not k.p and not (o.p or o.l) group by 1, 2)"""


@query(f"""with {_WATER} select k.r, k.c, p polygon, p or l mask, round(case when p then 2 * sqrt(least(coalesce(bank.d, 1e9) * 14 / 60, 1)) when l then 1.5::double * greatest(sqrt(least(coalesce(shore.d, 1e9) / 2, 1)), 0.7) else 0 end, 6) depth,
round(case when p then least(z, mean) when l then z end, 6) surface from kinds k left join sm on sm.r = k.r and sm.c = k.c left join bank on bank.r = k.r and bank.c = k.c left join shore on shore.r = k.r and shore.c = k.c""")
def water_layers(spark: SparkSession, d: str) -> DataFrame:
    """Polygon pixels where the raster's blocks say so, lines along every fortieth row."""
    ras = raster(spark, d)
    polygons = ras.where("(r div 10) % 3 = 0 and (c div 10) % 3 = 0").select("r", "c", F.lit(2.0).alias("depth"))
    lines = ras.where("r % 40 = 15").select("r", "c", F.lit(1.5).alias("depth"), F.lit(2.0).alias("half"))
    return water.layers(ras, polygons, lines, 14.0).select("r", "c", "polygon", "mask", _r("depth"), _r("surface"))
