"""Raster queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvius.operators import grid as G
from fluvius.plans.fixtures import HOLES, RAS, holes, raster

MPP = 3.5


def _r(c: str, n: int = 6):
    return F.round(F.col(c), n).alias(c)


QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"with {RAS} select cast(r // 4 as int) r, cast(c // 4 as int) c, round(avg(z), 6) z from ras group by all")
def block_mean(spark: SparkSession, d: str) -> DataFrame:
    return G.block_mean(raster(spark, d), 4).select("r", "c", _r("z"))


@query(f"with {HOLES} select cast(r // 4 as int) r, cast(c // 4 as int) c, round(avg(z), 6) z from holes group by all")
def block_mean_nodata(spark: SparkSession, d: str) -> DataFrame:
    return G.block_mean(holes(spark, d), 4).select("r", "c", _r("z"))


@query(f"with {RAS}, n as (select max(r) + 1 h, max(c) + 1 w from ras) select cast(r // 7 as int) r, cast(c // 7 as int) c, round(avg(z), 6) z from ras, n where r < h - h % 7 and c < w - w % 7 group by 1, 2")
def block_display(spark: SparkSession, d: str) -> DataFrame:
    return G.block_display(raster(spark, d), 7).select("r", "c", _r("z"))


@query(f"with {RAS} select cast(r // 4 as int) r, cast(c // 4 as int) c, cast(round_even(avg(cast(round_even(z, 0) as int)), 0) as int) z from ras group by 1, 2")
def rint_downsample(spark: SparkSession, d: str) -> DataFrame:
    return G.block_mean(raster(spark, d).withColumn("z", F.rint("z").cast("int")), 4).select("r", "c", F.rint("z").cast("int").alias("z"))


_MINMAX = "a as (select r, c, z, min(z) over w lo, max(z) over w hi from ras window w as (partition by r order by c range between 3 preceding and 3 following)), f as (select r, c, z, min(lo) over w lo, max(hi) over w hi from a window w as (partition by c order by r range between 3 preceding and 3 following))"


@query(f"with {RAS}, {_MINMAX} select r, c, lo, hi from f")
def focal_min_max(spark: SparkSession, d: str) -> DataFrame:
    return G.focal_min_max(raster(spark, d), 7).select("r", "c", "lo", "hi")


def _mirror(src: str, out: str, cols: str, half: int) -> str:
    return f"""{out}_n as (select max(r) + 1 h, max(c) + 1 w from {src}),
{out}_r as (select r, c, {cols} from {src} union all select -1 - r, c, {cols} from {src} where r < {half} union all select 2 * h - 1 - r, c, {cols} from {src}, {out}_n where r >= h - {half}),
{out}_m as (select r, c, {cols} from {out}_r union all select r, -1 - c, {cols} from {out}_r where c < {half} union all select r, 2 * w - 1 - c, {cols} from {out}_r, {out}_n where c >= w - {half})"""


def _mean(src: str, out: str, extra: str = "") -> str:
    cols = "z" + extra
    return f"""{_mirror(src, out, cols, 3)},
{out}_1 as (select r, c, {cols}, avg(z) over (partition by r order by c range between 3 preceding and 3 following) p from {out}_m),
{out}_2 as (select r, c, {cols}, avg(p) over (partition by c order by r range between 3 preceding and 3 following) mean from {out}_1),
{out} as (select * from {out}_2, {out}_n where r >= 0 and c >= 0 and r < h and c < w)"""


@query(f"with {RAS}, {_mean('ras', 'f')} select r, c, round(mean, 6) mean from f")
def focal_mean_reflect(spark: SparkSession, d: str) -> DataFrame:
    return G.focal_mean(raster(spark, d).select("r", "c", "z"), 7).select("r", "c", _r("mean"))


def _soft(spark: SparkSession, d: str) -> DataFrame:
    """A gentle raster with terraces: integer heights that rise slowly."""
    return raster(spark, d).select("r", "c", F.rint(F.col("r") * 0.17 + F.col("c") * 0.3 + F.col("z") / 500).alias("z"))


_SOFT = RAS + ", soft as (select r, c, round_even(r * 0.17::double + c * 0.3::double + z / 500, 0) z from ras)"
_FLAT = _MINMAX.replace("from ras", "from soft") + ", g as (select r, c, z, hi - lo <= 2.5 flat from f)"


@query(f"with {_SOFT}, {_FLAT}, {_mean('g', 'p', ', flat')}, g2 as (select r, c, case when flat then mean else z end z, flat from p), {_mean('g2', 'q', ', flat')} select r, c, round(case when flat then mean else z end, 6) z from q")
def deterrace(spark: SparkSession, d: str) -> DataFrame:
    return G.deterrace(_soft(spark, d)).select("r", "c", _r("z"))


@query(f"""with {HOLES}, src as (select r, c, case when m then z else 0 end v, case when m then 1.0::double else 0 end n from (select r, c, coalesce(z, 0) z, m from holes)),
{_mirror('src', 'f', 'v, n', 4)},
a as (select r, c, sum(v) over w v, sum(n) over w n from f_m window w as (partition by r order by c range between 4 preceding and 4 following)),
b as (select r, c, sum(v) over w v, sum(n) over w n from a window w as (partition by c order by r range between 4 preceding and 4 following))
select r, c, case when n > 0 then round(v / n, 6) end mean from b, f_n where r >= 0 and c >= 0 and r < h and c < w""")
def masked_mean(spark: SparkSession, d: str) -> DataFrame:
    return G.masked_mean(holes(spark, d).withColumn("z", F.coalesce("z", F.lit(0.0))), 9).select("r", "c", _r("mean"))


def _grad(src: str, mpp: float = MPP) -> str:
    e = lambda w: f"coalesce((lead(z) over {w} - lag(z) over {w}) / (2 * {mpp}::double), (lead(z) over {w} - z) / {mpp}::double, (z - lag(z) over {w}) / {mpp}::double, 0)"
    return f"grad as (select *, {e('wc')} dx, {e('wr')} dy from {src} window wc as (partition by r order by c), wr as (partition by c order by r)), slope as (select *, sqrt(dx * dx + dy * dy) * 100 slope from grad)"


@query(f"with {RAS}, {_grad('ras')} select r, c, round(slope, 6) slope from slope")
def slope_pct(spark: SparkSession, d: str) -> DataFrame:
    return G.slope_percent(raster(spark, d), MPP).select("r", "c", _r("slope"))


@query(f"with {_SOFT}, {_grad('soft')} select coalesce(avg(case when slope < 10 then 1.0 else 0 end), 0)::double buildable from slope")
def buildable_fraction(spark: SparkSession, d: str) -> DataFrame:
    return G.buildable(G.slope_percent(_soft(spark, d), MPP))


_BIN = " ".join(f"when slope >= {e} then {i}" for i, e in reversed(list(enumerate(G.SLOPE_EDGES[:-1]))))


@query(f"with {_SOFT}, {_grad('soft')}, k as (select case {_BIN} else 0 end bin, count(*) n from slope where slope is not null group by 1) select cast(b.range as int) bin, coalesce(n, 0) n, round(coalesce(n, 0)::double / greatest((select sum(n) from k), 1), 4) share from range(10) b left join k on k.bin = b.range")
def slope_histogram(spark: SparkSession, d: str) -> DataFrame:
    return G.slope_bins(G.slope_percent(_soft(spark, d), MPP))


@query(f"with {RAS}, {_grad('ras')} select r, c, case when kind = 'view' then -1 else (slope >= 5)::int + (slope >= 10)::int + (slope >= 20)::int end cls from slope")
def slope_class(spark: SparkSession, d: str) -> DataFrame:
    s = G.slope_percent(raster(spark, d), MPP)
    return s.select("r", "c", F.when(F.col("kind") == "view", -1).otherwise(G.slope_class(F.col("slope"))).cast("int").alias("cls"))


@query(f"""with {_SOFT}, {_grad('soft')}, l as (select cos(radians(90 - 315)) * cos(radians(45)) lx, sin(radians(90 - 315)) * cos(radians(45)) ly, sin(radians(45)) lz)
select r, c, round(greatest(0, (-dx * 2 * lx + dy * 2 * ly + lz) / sqrt(dx * 2 * dx * 2 + dy * 2 * dy * 2 + 1)), 6) shade from grad, l""")
def hillshade(spark: SparkSession, d: str) -> DataFrame:
    return G.hillshade(_soft(spark, d), MPP).select("r", "c", _r("shade"))


@query(f"with {HOLES} select coalesce(avg(case when abs(z - round_even(z, 0)) < 0.01 then 1.0::double else 0 end), 0) terracing from holes where z is not null and z <> 0")
def terracing_fraction(spark: SparkSession, d: str) -> DataFrame:
    return G.terracing(holes(spark, d))


@query(f"with {HOLES} select min(z) lo, max(z) hi, max(z) - min(z) relief, avg(case when z is null then 1.0::double else 0 end) nodata from holes")
def relief_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.relief(holes(spark, d))


@query(f"with {RAS} select kind, round(quantile_cont(z, 0.1), 2) p10, round(quantile_cont(z, 0.9), 2) p90, round(median(z), 2) p50, count(*) n from ras group by kind")
def zonal_percentile(spark: SparkSession, d: str) -> DataFrame:
    p = F.percentile("z", F.array(F.lit(0.1), F.lit(0.9), F.lit(0.5)))
    return raster(spark, d).groupBy("kind").agg(p.alias("p"), F.count("*").alias("n")).select("kind", F.round(F.col("p")[0], 2).alias("p10"), F.round(F.col("p")[1], 2).alias("p90"), F.round(F.col("p")[2], 2).alias("p50"), "n")


@query(f"with {HOLES}, p as (select s_suppkey k, cast(s_suppkey * 13 % h as int) pr, cast(s_suppkey * 7 % 100 as int) pc from supplier, (select max(r) + 1 h from holes)) select k, round(coalesce(median(case when m then z end), min(z)), 6) lvl from p join holes on r between pr - 12 and pr + 12 and c between pc - 12 and pc + 12 group by k")
def median_window_sample(spark: SparkSession, d: str) -> DataFrame:
    """Level at a point: the median of water pixels in its 25 x 25 window, else the lowest pixel; a place's level is taken once."""
    rows = F.broadcast(holes(spark, d).agg((F.max("r") + 1).alias("h")))
    p = spark.read.parquet(f"{d}/supplier.parquet").crossJoin(rows).select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 13 % F.col("h")).cast("int").alias("pr"), (F.col("s_suppkey") * 7 % 100).cast("int").alias("pc"))
    return p.distinct().join(G.window_level(holes(spark, d), p, 12).hint("merge"), ["pr", "pc"]).select("k", _r("lvl"))


_PLAN = """s as (select min(z) lo, max(z) hi, quantile_cont(z, 0.1) ws from ras), p1 as (select *, ceil((ws - lo) + 5)::double sea from s), p2 as (select *, sea - ws off, hi + sea - ws u_max, lo + sea - ws u_min from p1), plan as (select *, greatest(ceil(u_max * 1.02::double / 10) * 10.0, 200.0)::double scale from p2)"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return G.plan_vertical(raster(spark, d).agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.percentile("z", F.lit(0.1)).alias("ws")))


@query(f"with {RAS}, {_PLAN} select round(lo, 6) lo, round(hi, 6) hi, round(ws, 6) ws, sea, round(off, 6) \"offset\", round(u_min, 6) u_min, round(u_max, 6) u_max, scale, round(scale / 65535, 9) m_per_level from plan")
def plan_vertical(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).select(_r("lo"), _r("hi"), _r("ws"), "sea", _r("offset"), _r("u_min"), _r("u_max"), "scale", _r("m_per_level", 9))


@query(f"with {RAS}, {_PLAN} select r, c, cast(greatest(0, least(65535, round_even((z + off) / scale * 65535, 0))) as int) lvl from ras, plan")
def quantize_u16(spark: SparkSession, d: str) -> DataFrame:
    return raster(spark, d).crossJoin(F.broadcast(_plan(spark, d).select("offset", "scale"))).select("r", "c", G.quantise(F.col("z") + F.col("offset"), F.col("scale")).alias("lvl"))


_CENTRE = "small as (select r // 4 + 3 r, c // 4 + 40 c, round_even(avg(z), 0) p from ras group by 1, 2), o as (select ras.r, ras.c, coalesce(p, z) z, z before, p from ras left join small on small.r = ras.r and small.c = ras.c)"


@query(f"with {RAS}, {_CENTRE} select r, c, z from o")
def centre_overwrite(spark: SparkSession, d: str) -> DataFrame:
    ras = raster(spark, d)
    return G.centre_overwrite(ras, ras, 4, 3, 40).select("r", "c", "z")


@query(f"with {RAS}, {_CENTRE} select round(avg(abs(before - p)), 6) mean_diff, round(max(abs(before - p)), 6) max_diff from o where p is not null")
def seam_diff(spark: SparkSession, d: str) -> DataFrame:
    ras = raster(spark, d)
    diff = F.abs(F.col("before") - F.col("p"))
    return G.centre_overwrite(ras, ras, 4, 3, 40).where("p is not null").agg(F.round(F.avg(diff), 6).alias("mean_diff"), F.round(F.max(diff), 6).alias("max_diff"))


@query(f"with {HOLES} select r, c, case when m and z is not null then least(z, 200 - 12.0::double) else z end z from holes")
def burn_channels(spark: SparkSession, d: str) -> DataFrame:
    return holes(spark, d).select("r", "c", G.burn(F.col("z"), F.col("m"), F.when(F.col("z").isNotNull(), F.lit(200.0)), F.lit(12.0)).alias("z"))


_NEAR = "(h.r - a.r) * (h.r - a.r) + (h.c - a.c) * (h.c - a.c)"


@query(f"with {HOLES}, t as (select h.r, h.c, min({_NEAR})::bigint d2 from holes h join (select * from holes where not m) a on true group by 1, 2) select r, c, d2, round(sqrt(least(sqrt(d2) * 3.5::double / 60, 1)), 6) taper from t")
def edt_taper(spark: SparkSession, d: str) -> DataFrame:
    """Squared distance to the nearest pixel off the mask, and the bank profile."""
    t = holes(spark, d).withColumn("off", ~F.col("m"))
    return G.nearest_distance(t, "off").select("r", "c", "d2", F.round(G.taper(F.col("d2"), MPP, 60.0), 6).alias("taper"))


def _fill(src: str) -> str:
    return f"select h.r, h.c, coalesce(h.z, min_by(a.z, ({_NEAR}) * 1000000000::bigint + a.r * 100 + a.c)) z, h.z is null filled from {src} h left join (select * from {src} where z is not null) a on h.z is null group by h.r, h.c, h.z"


@query(f"with {HOLES} {_fill('holes')}")
def fill_nearest(spark: SparkSession, d: str) -> DataFrame:
    return G.fill_nodata(holes(spark, d))


_VOID = HOLES + ", void as (select r, c, m, case when r % 97 > 4 and c between 8 and 88 then null else z end z from holes)"


def _void(spark: SparkSession, d: str) -> DataFrame:
    """The raster with voids of 81 columns and 92 rows."""
    return holes(spark, d).withColumn("z", F.when((F.col("r") % 97 > 4) & F.col("c").between(8, 88), F.lit(None)).otherwise(F.col("z")))


@query(f"with {_VOID} {_fill('void')}")
def fill_wide_void(spark: SparkSession, d: str) -> DataFrame:
    return G.fill_nodata(_void(spark, d))


@query(f"with {_VOID}, f as ({_fill('void')}) select round(avg(filled::int), 9) \"share\" from f")
def filled_share(spark: SparkSession, d: str) -> DataFrame:
    return G.filled_share(G.fill_nodata(_void(spark, d))).select(_r("share", 9))


@query(f"with {_VOID}, t as (select h.r, h.c, min({_NEAR})::bigint d2 from void h join (select * from void where z is not null) a on true group by 1, 2) select * from t")
def distance_wide(spark: SparkSession, d: str) -> DataFrame:
    """Squared distances to the nearest valid pixel across wide voids."""
    return G.nearest_distance(_void(spark, d).withColumn("ok", F.col("z").isNotNull()), "ok").select("r", "c", "d2")


@query(f"""with recursive {HOLES}, n as (select r * 100 + c id from holes where m), e as (select a.id a, b.id b from n a join n b on b.id = a.id + 100 or (b.id = a.id + 1 and b.id % 100 <> 0)), s as (select a, b from e union all select b, a from e),
g(id, k) as (select id, id from n union select s.b, g.k from g join s on s.a = g.id where s.b > g.k)
select cast(id // 100 as int) r, cast(id % 100 as int) c, cast((min(k) // 100) as bigint) * 2147483648 + min(k) % 100 component from g group by id""")
def raster_components(spark: SparkSession, d: str) -> DataFrame:
    return G.raster_components(holes(spark, d), "m")


@query(f"with {RAS} select r, c, z from ras where r % 8 = 0 and c % 8 = 0")
def strided_subsample(spark: SparkSession, d: str) -> DataFrame:
    return G.subsample(raster(spark, d), 8).select("r", "c", "z")


@query(f"with {RAS} select r, c, z from ras where c = 48")
def cross_section(spark: SparkSession, d: str) -> DataFrame:
    return G.cross_section(raster(spark, d), "c", 48).select("r", "c", "z")


@query(f"with {RAS}, p as (select k, x, y, x - 0.5 fx, y - 0.5 fy from (select s_suppkey k, (s_suppkey * 0.731::double) % 98 + 1 x, (s_suppkey * 13.377::double) % (h - 2) + 1 y from supplier, (select max(r) + 1 h from ras))), q as (select *, floor(fx)::int c0, floor(fy)::int r0 from p) select k, round(sum(z * (case when c = c0 then 1 - (fx - c0) else fx - c0 end) * (case when r = r0 then 1 - (fy - r0) else fy - r0 end)) / sum((case when c = c0 then 1 - (fx - c0) else fx - c0 end) * (case when r = r0 then 1 - (fy - r0) else fy - r0 end)), 6) z from q join ras on r in (r0, r0 + 1) and c in (c0, c0 + 1) group by k")
def resample_bilinear(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = F.broadcast(raster(spark, d).agg((F.max("r") + 1).alias("h")))
    p = spark.read.parquet(f"{d}/supplier.parquet").crossJoin(rows).select(k.alias("k"), (k * 0.731 % 98 + 1).alias("x"), (k * 13.377 % (F.col("h") - 2) + 1).alias("y"))
    return G.bilinear(raster(spark, d), F.col("x"), F.col("y"), p).select("k", _r("z"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Block means, the planned vertical, slope and the histogram with its buildable share, in one plan."""
    blocks = G.block_mean(holes(spark, d), 4)
    plan = G.plan_vertical(blocks.agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.percentile("z", F.lit(0.1)).alias("ws")))
    game = blocks.crossJoin(F.broadcast(plan.select("offset", "scale"))).select("r", "c", (F.col("z") + F.col("offset")).alias("z"), "scale")
    slopes = G.slope_percent(game, MPP * 4).withColumn("lvl", G.quantise(F.col("z"), F.col("scale")))
    return G.slope_bins(slopes).crossJoin(F.broadcast(G.buildable(slopes)))
