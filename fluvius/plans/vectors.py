"""Geography and vector queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvius.operators import geo
from fluvius.operators import vector as V
from fluvius.plans.fixtures import RAS, SEG, VERT, raster, segments, table, vertices
from fluvius.plans.rasters import _r

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), (k * 37 % 3600 / 10 - 180).alias("lon"), (k * 53 % 1700 / 10 - 85).alias("lat"))


_PLACES = "places as (select c_custkey k, (c_custkey * 37 % 3600) / 10::double - 180 lon, (c_custkey * 53 % 1700) / 10::double - 85 lat from customer)"
_ZONE = _PLACES + """, zone as (select *, case when lat between -80 and 84 then case when lat >= 0 then 32600 else 32700 end + least(60, case when lat >= 56 and lat < 64 and lon >= 3 and lon < 12 then 32
when lat >= 72 and lat < 84 and lon >= 0 and lon < 42 then case when lon < 9 then 31 when lon < 21 then 33 when lon < 33 then 35 else 37 end else floor((lon + 180) / 6)::int + 1 end) end epsg from places)"""


@query(f"with {_ZONE} select k, epsg from zone")
def utm_zone(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("k", geo.utm_zone(F.col("lon"), F.col("lat")).alias("epsg"))


_E = 2 * geo._N**0.5 / (1 + geo._N)
_SUM = lambda f, h, cs: " + ".join(f"{f}(xi * {2 * j}) * {h}(eta * {2 * j}) * {c!r}" for j, c in enumerate(cs, 1))


@query(f"""with {_ZONE}, a as (select k, epsg, radians(lat) phi, radians(lon - ((epsg % 100) * 6 - 183)) lam from zone where epsg is not null),
b as (select *, sinh(atanh(sin(phi)) - atanh(sin(phi) * {_E!r}::double) * {_E!r}::double) t from a), g as (select *, atan2(t, cos(lam)) xi, atanh(sin(lam) / sqrt(t * t + 1)) eta from b)
select k, round((eta + {_SUM('cos', 'sinh', geo._ALPHA)}) * {geo._K0 * geo._A!r}::double + 500000, 3) x, round((xi + {_SUM('sin', 'cosh', geo._ALPHA)}) * {geo._K0 * geo._A!r}::double + case when epsg >= 32700 then 10000000 else 0 end, 3) y from g""")
def utm_project(spark: SparkSession, d: str) -> DataFrame:
    p = _places(spark, d).withColumn("epsg", geo.utm_zone(F.col("lon"), F.col("lat"))).where("epsg is not null")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    return p.select("k", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"with {_ZONE} select k, round(lon, 6) lon, round(lat, 6) lat from zone where epsg is not null")
def utm_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Projecting and back gives the place again."""
    p = _places(spark, d).withColumn("epsg", geo.utm_zone(F.col("lon"), F.col("lat"))).where("epsg is not null")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    lon, lat = geo.from_utm(F.col("x"), F.col("y"), F.col("epsg"))
    return p.withColumns({"x": x, "y": y}).select("k", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_PIX = "px as (select c_custkey k, greatest(0, least(4095, floor((c_acctbal * 2) / 3.5::double)::int)) c, greatest(0, least(4095, floor((14336 - c_custkey * 9.5::double) / 3.5::double)::int)) r from customer)"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    c, r = geo.pixel(F.col("c_acctbal") * 2, F.col("c_custkey") * 9.5, F.lit(0.0), F.lit(14336.0), 3.5)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), c.alias("c"), r.alias("r"))


@query(f"with {_PIX} select k, c, r from px")
def pixel_index(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d)


@query(f"with {_PIX}, l as (select *, least(c, 4095 - c, r, 4095 - r) m from px), e as (select *, case when c = m then 'W' when 4095 - c = m then 'E' when r = m then 'N' else 'S' end edge from l) select k, edge, case edge when 'W' then 0 when 'E' then 4095 else c end c, case edge when 'N' then 0 when 'S' then 4095 else r end r from e")
def snap_edge(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select("k", geo.snap_edge(F.col("c"), F.col("r")).alias("e")).select("k", "e.*")


@query(f"with {_PIX} select k, c * 3.5::double x, (4095 - r) * 3.5::double y, round(c * 3.5::double - 7168, 1) x_mid, round((4095 - r) * 3.5::double - 7168, 1) y_mid from px")
def placement_xy(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("c") * 3.5, (4095 - F.col("r")) * 3.5
    return _pixels(spark, d).select("k", x.alias("x"), y.alias("y"), F.round(x - 7168, 1).alias("x_mid"), F.round(y - 7168, 1).alias("y_mid"))


_STEPS = " ".join(f"when a < {s} then {i}" for i, s in enumerate(geo.AREA_STEPS, 1))


@query(f"select o_orderkey k, case {_STEPS} else 9 end ord from (select o_orderkey, o_totalprice / 10 a from orders)")
def order_from_area(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), geo.order_from_area(F.col("o_totalprice") / 10).alias("ord"))


_TAB = lambda t: " ".join(f"when {k} then {v}::double" for k, v in t.items())


@query(f"""with a as (select p_partkey k, cast(p_size % 14 as int) o, case when p_size % 3 = 0 then p_retailprice / 100 end q, p_size % 5 = 0 i from part), b as (select *, greatest(2, least(10, o)) g from a),
e as (select *, case when q > 0 then greatest(3.0::double, sqrt(q) * 4.8::double) else case g {_TAB(geo.WIDTHS)} end end w, case when q > 0 then greatest(0.5::double, pow(q, 0.3::double) * 0.35::double) else case g {_TAB(geo.DEPTHS)} end end dp from b)
select k, round_even(w, 0) width, round_even((case when i then dp * 0.5::double else dp end) * 10, 0) / 10 depth from e""")
def channel_geometry(spark: SparkSession, d: str) -> DataFrame:
    w, depth = geo.channel((F.col("p_size") % 14).cast("int"), F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice") / 100), F.col("p_size") % 5 == 0)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), w.alias("width"), depth.alias("depth"))


@query(f"""with {_PLACES} select k, case when lat >= 60 and (lon >= 60 or lon < -10) then case when lon >= 60 or lon < -170 then 'si' when lon < -60 then 'ar' else 'gr' end
when lon >= -170 and lon < -30 then case when lat >= 8 then 'na' else 'sa' end when lon >= -30 and lon < 60 then case when lat >= 34 then 'eu' else 'af' end when lon >= 60 and lat >= -10 then 'as' else 'au' end code from places""")
def region_code(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("k", geo.region(F.col("lat"), F.col("lon")).alias("code"))


@query("""with p as (select p_partkey k, p_size / 5::double n, 3.5::double t, case when p_size % 4 = 0 then cast(p_size % 3 + 1 as int) end f from part)
select k, case when f > 1 then 'oversample-forced' when f = 1 then 'direct' when n <= t / 2 then 'fetch-fine-then-block-average' when n <= t then 'direct-bilinear' else 'upsample-cubic-spline' end "name",
case when f > 1 then f when f = 1 then 1 when n <= t / 2 then 2 else 1 end factor, case when f > 1 then t / f when f = 1 then t when n <= t / 2 then t / 2 else t end res,
case when n > t then 'cubic_spline' when n > t / 2 then 'bilinear' else 'average' end kernel from p""")
def resample_policy(spark: SparkSession, d: str) -> DataFrame:
    native, target = F.col("p_size") / 5, F.lit(3.5)
    force = F.when(F.col("p_size") % 4 == 0, (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), geo.resample_policy(native, target, force).alias("p"), geo.resampling(native, target).alias("kernel")).select("k", "p.*", "kernel")


@query("select n, kind, native from (select p_size % 7 n, p_type kind, p_retailprice native, row_number() over (partition by p_size % 7 order by p_type not like 'ECONOMY%', p_retailprice, p_partkey) rn from part) where rn = 1")
def resolve_source(spark: SparkSession, d: str) -> DataFrame:
    """Of each group's covering sources the finest of the preferred kind, else the finest; first on a tie."""
    best = F.min(F.struct((~F.col("p_type").startswith("ECONOMY")).alias("a"), F.col("p_retailprice").alias("native"), "p_partkey", F.col("p_type").alias("kind"))).alias("b")
    return table(spark, d, "part").groupBy((F.col("p_size") % 7).alias("n")).agg(best).select("n", "b.kind", "b.native")


@query("""with e as (select s_suppkey id, s_suppkey * 100.0::double minx, 0.0::double miny, s_suppkey * 100.0::double + (s_suppkey % 3 + 1) * 3584 maxx, 14336.0::double maxy, cast((s_suppkey % 3 + 1) * 1024 as int) w, 4096 h from supplier)
select id, cast(r0 as int) r0, cast(c0 as int) c0, cast(least(2048, h - r0) as int) th, cast(least(2048, w - c0) as int) tw, minx + c0 * 3.5::double x0, maxy - r0 * 3.5::double y0 from (select *, unnest(range(0, h, 2048)) r0 from e), lateral (select unnest(range(0, w, 2048)) c0)""")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    e = table(spark, d, "supplier").select(k.alias("id"), (k * 100.0).alias("minx"), F.lit(0.0).alias("miny"), (k * 100.0 + (k % 3 + 1) * 3584).alias("maxx"), F.lit(14336.0).alias("maxy"))
    return geo.tile_grid(e, 3.5, 2048)


@query(f"""with {_PLACES}, b as (select k, lon - 0.4::double w, least(lat + 0.3::double, 89) n, lon + 0.4::double e, lat - 0.3::double s from places)
select k id, 'Copernicus_DSM_COG_10_' || case when la >= 0 then 'N' else 'S' end || lpad(abs(la)::varchar, 2, '0') || '_00_' || case when lo >= 0 then 'E' else 'W' end || lpad(abs(lo)::varchar, 3, '0') || '_00_DEM' tile from (select *, unnest(range(floor(s)::bigint, floor(n - 1e-9::double)::bigint + 1)) la from b), lateral (select unnest(range(floor(w)::bigint, floor(e - 1e-9::double)::bigint + 1)) lo)""")
def tile_names(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    return geo.tile_names(_places(spark, d).select(F.col("k").alias("id"), (lon - 0.4).alias("west"), (lat - 0.3).alias("south"), (lon + 0.4).alias("east"), F.least(lat + 0.3, F.lit(89.0)).alias("north")))


_MEAS = SEG + ", meas as (select *, coalesce(sum(len) over (partition by line order by seq rows between unbounded preceding and 1 preceding), 0) pos from (select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) len from seg))"


@query(f"with {_MEAS} select line, round(sum(len), 6) length from meas group by line")
def line_length(spark: SparkSession, d: str) -> DataFrame:
    return V.lengths(segments(vertices(spark, d))).select("line", _r("length"))


@query(f"""with {_MEAS}, w as (select line, sum(len) * 0.37::double d from meas group by line), h as (select line, m.*, d, row_number() over (partition by line order by seq) rn from w join meas m using (line) where d >= pos and d <= pos + len)
select line, round(x1 + (x2 - x1) * case when len > 0 then (d - pos) / len else 0 end, 5) x, round(y1 + (y2 - y1) * case when len > 0 then (d - pos) / len else 0 end, 5) y from h where rn = 1""")
def line_interpolate(spark: SparkSession, d: str) -> DataFrame:
    m = V.measured(segments(vertices(spark, d)))
    return V.interpolate(m, m.groupBy("line").agg((F.sum("len") * 0.37).alias("d"))).select("line", _r("x", 5), _r("y", 5))


BOX = (50.5, 5.5, 1500.5, 80.5)


def _clip_sql(box: tuple) -> str:
    b = [f"{x}::double" if isinstance(x, float) else x for x in box]
    one = lambda p, q, lo, hi: (f"case when {q} = {p} then case when {p} < {lo} or {p} > {hi} then 2 else 0 end else least(({lo} - {p}) / ({q} - {p}), ({hi} - {p}) / ({q} - {p})) end", f"case when {q} = {p} then case when {p} < {lo} or {p} > {hi} then -1 else 1 end else greatest(({lo} - {p}) / ({q} - {p}), ({hi} - {p}) / ({q} - {p})) end")
    (x0, x1), (y0, y1) = one("x1", "x2", b[0], b[2]), one("y1", "y2", b[1], b[3])
    return f"greatest(0, {x0}, {y0}) t0, least(1, {x1}, {y1}) t1"


@query(f"with {SEG}, k as (select *, {_clip_sql(BOX)} from seg) select line, cast(seq as int) seq, round(x1 + (x2 - x1) * t0, 9) x1, round(y1 + (y2 - y1) * t0, 9) y1, round(x1 + (x2 - x1) * t1, 9) x2, round(y1 + (y2 - y1) * t1, 9) y2 from k where t0 < t1")
def bbox_clip(spark: SparkSession, d: str) -> DataFrame:
    return V.clip(segments(vertices(spark, d)), BOX).select("line", "seq", *[_r(c, 9) for c in V.SEGMENT])


@query(f"""with {_MEAS}, t as (select line, seq, x1, y1, x2, y2, len, pos, unnest([0, 1, 2, 3]) side, unnest([case when x2 <> x1 then ({BOX[0]} - x1) / (x2 - x1) end, case when x2 <> x1 then ({BOX[2]} - x1) / (x2 - x1) end, case when y2 <> y1 then ({BOX[1]} - y1) / (y2 - y1) end, case when y2 <> y1 then ({BOX[3]} - y1) / (y2 - y1) end]) t from meas),
h as (select *, x1 + (x2 - x1) * t cx, y1 + (y2 - y1) * t cy, pos + len * t d0 from t where t >= 0 and t < 1), k as (select * from h where case when side < 2 then cy between {BOX[1]} and {BOX[3]} else cx between {BOX[0]} and {BOX[2]} end),
tot as (select line, max(pos + len) total from meas group by line), pr as (select k.line, k.seq, side, d0, cx, cy, dir, greatest(0, least(total, d0 + dir * 3)) d from k join tot using (line), (select unnest([-1, 1]) dir)),
pt as (select pr.*, m.x1 + (m.x2 - m.x1) * case when m.len > 0 then (d - m.pos) / m.len else 0 end px, m.y1 + (m.y2 - m.y1) * case when m.len > 0 then (d - m.pos) / m.len else 0 end py, row_number() over (partition by pr.line, pr.seq, side, d0, dir order by m.seq) rn from pr join meas m on m.line = pr.line and d >= m.pos and d <= m.pos + m.len),
b as (select line, seq, side, d0, cx, cy, max(case when dir = 1 then px > {BOX[0]} and px < {BOX[2]} and py > {BOX[1]} and py < {BOX[3]} end) af, max(case when dir = -1 then px > {BOX[0]} and px < {BOX[2]} and py > {BOX[1]} and py < {BOX[3]} end) be from pt where rn = 1 group by all)
select line, cast(seq as int) seq, ['W', 'E', 'S', 'N'][side + 1] edge, round(d0 + 1e-8::double, 6) d, round(cx + 1e-8::double, 6) x, round(cy + 1e-8::double, 6) y, case when af then 'in' else 'out' end flow from b where af <> be""")
def crossings(spark: SparkSession, d: str) -> DataFrame:
    return V.crossings(segments(vertices(spark, d)), BOX, 3.0).select("line", "seq", "edge", "flow", *[F.round(F.col(c) + 1e-8, 6).alias(c) for c in ("d", "x", "y")])


@query(f"with {VERT}, n as (select line, x, y, coalesce(lead(x) over w, first_value(x) over w) nx, coalesce(lead(y) over w, first_value(y) over w) ny from vert window w as (partition by line order by seq)) select line, sum(x * ny - nx * y) / 2 area from n group by line")
def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    return V.ring_area(vertices(spark, d))


def _dist(px: str, py: str) -> str:
    t = f"greatest(0, least(1, coalesce((({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0)))"
    return f"sqrt(({px} - x1 - {t} * (x2 - x1)) ** 2 + ({py} - y1 - {t} * (y2 - y1)) ** 2)"


_REACH = "reach as (select s_suppkey line, s_suppkey * 37 % 997 * 1.0::double x1, s_suppkey * 91 % 983 * 1.0::double y1, s_suppkey * 37 % 997 + 25.0::double x2, s_suppkey * 91 % 983 + (s_suppkey % 7 - 3) * 8.0::double y2 from supplier)"


def _reaches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 37 % 997).cast("double"), (k * 91 % 983).cast("double")
    return table(spark, d, "supplier").select(k.alias("line"), x.alias("x1"), y.alias("y1"), (x + 25.0).alias("x2"), (y + (k % 7 - 3) * 8.0).alias("y2"))


@query(f"with {_REACH}, p as (select c_custkey id, c_custkey * 17 % 1009 * 1.0::double px, c_custkey * 29 % 991 * 1.0::double py from customer), q as (select id, line, {_dist('px', 'py')} dd from p, reach), b as (select id, line, dd, row_number() over (partition by id order by dd, line) rn from q where dd <= 60) select p.id, b.line, round(b.dd, 6) distance from p left join b on b.id = p.id and rn = 1")
def nearest_join(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("id"), (k * 17 % 1009).cast("double").alias("px"), (k * 29 % 991).cast("double").alias("py"))
    return V.nearest(p, _reaches(spark, d), 60.0).select("id", "line", _r("distance"))


_BOXES = "boxes as (select s_suppkey id, s_suppkey * 19 % 1900 + 0.5::double minx, s_suppkey * 7 % 90 + 0.5::double miny, s_suppkey * 19 % 1900 + 2.5::double maxx, s_suppkey * 7 % 90 + 1.5::double maxy from supplier)"
_MEET = f"{SEG}, {_BOXES}, meet as (select id, line, line % 9 + 1 ord from (select *, {_clip_sql(('minx', 'miny', 'maxx', 'maxy'))} from boxes, seg) where t0 <= t1)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 19 % 1900).cast("double") + 0.5, (k * 7 % 90).cast("double") + 0.5
    return table(spark, d, "supplier").select(k.alias("id"), x.alias("minx"), y.alias("miny"), (x + 2).alias("maxx"), (y + 1).alias("maxy"))


def _meet(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    boxes = _boxes(spark, d)
    return boxes, V.crossing_boxes(boxes, segments(vertices(spark, d)), 100.0).select("id", "line", (F.col("line") % 9 + 1).alias("ord"))


@query(f"with {_MEET}, b as (select id, ord, line, row_number() over (partition by id order by ord desc, line) rn from meet) select boxes.id, coalesce(ord, 0) ord, line from boxes left join b on b.id = boxes.id and rn = 1")
def polygon_order_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The highest order through each polygon, its first line on a tie; 0 where none."""
    boxes = _boxes(spark, d)
    best = V.first_crossing(boxes, segments(vertices(spark, d)).withColumn("n", -(F.col("line") % 9 + 1)), ["n", "line"], 100.0)
    return boxes.join(best, "id", "left").select("id", F.coalesce(-F.col("n"), F.lit(0)).alias("ord"), "line")


@query(f"with {_MEET} select id from boxes where id not in (select id from meet where ord >= 8)")
def spatial_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Polygons that no line of order 8 or more meets."""
    boxes, meet = _meet(spark, d)
    return boxes.join(meet.where("ord >= 8"), "id", "left_anti").select("id")


_POLY = """corner as (select s_suppkey poly, s_suppkey * 7 % 90 + 5 cx, s_suppkey * 3 % 90 + 5 cy, s_suppkey % 5 + 1.3::double a from supplier), ring as (select poly, unnest([0, 1, 2, 3]) k, unnest([cx - a, cx, cx + a * 0.9::double, cx + 0.3::double]) x, unnest([cy * 1.0::double, cy - a * 1.1::double, cy + 0.2::double, cy + a]) y from corner),
edge as (select poly, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from (select * from ring union all select poly, 4, x, y from ring where k = 0) window w as (partition by poly order by k))"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("poly"), (k * 7 % 90 + 5).cast("double").alias("cx"), (k * 3 % 90 + 5).cast("double").alias("cy"), (k % 5 + 1.3).alias("a"))
    cx, cy, a = F.col("cx"), F.col("cy"), F.col("a")
    p = [(cx - a, cy), (cx, cy - a * 1.1), (cx + a * 0.9, cy + 0.2), (cx + 0.3, cy + a)]
    edges = F.array(*[F.struct(p[i][0].alias("x1"), p[i][1].alias("y1"), p[(i + 1) % 4][0].alias("x2"), p[(i + 1) % 4][1].alias("y2")) for i in range(4)])
    return s.select("poly", F.explode(edges).alias("e")).select("poly", "e.*")


_INSIDE = f"{_POLY}, px as (select poly, cast(r as int) r, cast(c as int) c from (select *, unnest(range(cy - 8, cy + 8)) r from corner), lateral (select unnest(range(cx - 8, cx + 8)) c)), inside as (select px.poly, r, c from px join edge e on e.poly = px.poly and x2 is not null group by px.poly, r, c having sum(case when (y1 > r + 0.5::double) <> (y2 > r + 0.5::double) and c + 0.5::double < (x2 - x1) * (r + 0.5::double - y1) / (y2 - y1) + x1 then 1 else 0 end) % 2 = 1)"


@query(f"with {_INSIDE} select poly, r, c from inside")
def rasterize_polygon(spark: SparkSession, d: str) -> DataFrame:
    return V.rasterise(_edges(spark, d))


@query(f"with {RAS}, {_INSIDE}, n as (select i.poly, count(*) n, round(quantile_cont(z, 0.1), 2) p10, round(quantile_cont(z, 0.9), 2) p90 from inside i join ras on ras.r = i.r and ras.c = i.c group by i.poly) select poly, n, p10, p90 from n")
def polygon_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = V.rasterise(_edges(spark, d)).join(raster(spark, d), ["r", "c"]).groupBy("poly").agg(F.count("*").alias("n"), F.percentile("z", F.array(F.lit(0.1), F.lit(0.9))).alias("p"))
    return p.select("poly", "n", F.round(F.col("p")[0], 2).alias("p10"), F.round(F.col("p")[1], 2).alias("p90"))


@query(f"with {_REACH}, px as (select *, unnest(range(floor(least(y1, y2) - 4)::bigint, ceil(greatest(y1, y2) + 4)::bigint + 1)) r from reach), py as (select *, unnest(range(floor(least(x1, x2) - 4)::bigint, ceil(greatest(x1, x2) + 4)::bigint + 1)) c from px) select line, cast(r as int) r, cast(c as int) c from py where {_dist('(c + 0.5::double)', '(r + 0.5::double)')} <= 2.5")
def rasterize_line(spark: SparkSession, d: str) -> DataFrame:
    return V.near_pixels(_reaches(spark, d), 2.5)


@query(f"""with {RAS}, {_MEAS}, t as (select line, sum(len) total, greatest(count(*) + 1, 8) n from meas group by line), q as (select line, n, cast(i as int) i, total * i / (n - 1) d from (select *, unnest(range(0, n)) i from t)),
h as (select q.line, n, i, cast(floor((x1 + (x2 - x1) * case when len > 0 then (d2 - pos) / len else 0 end + 1e-6::double) / 20.0::double) as int) c, cast(floor(y1 + (y2 - y1) * case when len > 0 then (d2 - pos) / len else 0 end + 1e-6::double) as int) r, row_number() over (partition by q.line, i order by seq) rn from (select q.*, least(d, total) d2 from q join t using (line)) q join meas m on m.line = q.line and d2 >= pos and d2 <= pos + len),
z as (select line, n, i, ras.z from h left join ras on ras.r = h.r and ras.c = h.c where rn = 1), g as (select line, median(case when i < greatest(2, n // 4) then z end) - median(case when i >= n - greatest(2, n // 4) then z end) dr from z group by line)
select line, round(dr, 6) "drop", case when dr is null then 'keep' when dr < -1 then 'reverse' else 'keep' end act, case when dr is null or abs(dr) >= 0.5 then 1 else 0 end flowdir from g""")
def line_direction(spark: SparkSession, d: str) -> DataFrame:
    """Heights at equally spaced points tell which way a line runs: the median of its first quarter less that of its last."""
    m = V.measured(segments(vertices(spark, d)))
    t = m.groupBy("line").agg(F.sum("len").alias("total"), F.greatest(F.count("*") + 1, F.lit(8)).alias("n"))
    q = t.withColumn("i", F.explode(F.expr("sequence(0, cast(n as int) - 1)"))).select("line", "n", "i", (F.col("total") * F.col("i") / (F.col("n") - 1)).alias("d"))
    p = V.interpolate(m, q).select("line", "n", "i", F.floor((F.col("x") + 1e-6) / 20).cast("int").alias("c"), F.floor(F.col("y") + 1e-6).cast("int").alias("r"))
    z = p.join(raster(spark, d), ["r", "c"], "left")
    k = F.greatest(F.lit(2), F.expr("n div 4"))
    g = z.groupBy("line").agg((F.median(F.when(F.col("i") < k, F.col("z"))) - F.median(F.when(F.col("i") >= F.col("n") - k, F.col("z")))).alias("dr"))
    return g.select("line", F.round("dr", 6).alias("drop"), F.when(F.col("dr") < -1, "reverse").otherwise("keep").alias("act"), F.when(F.abs("dr") < 0.5, 0).otherwise(1).alias("flowdir"))
