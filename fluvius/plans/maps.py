"""Queries over maps as documents, sites and channels, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvius.operators import geo, layers, publishing
from fluvius.operators import vector as V
from fluvius.plans.fixtures import table
from fluvius.plans.networks import _RUNS, _runs
from fluvius.plans.rasters import _r
from fluvius.plans.vectors import _REACH, _TAB, _reaches
from fluvius.sources import registry as sources

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_HALF = "(1.3::double + line % 4 * 0.71::double)"


@query(f"""with {_REACH}, moved as (select line, x1 + 0.37::double x1, y1 + 0.41::double y1, x2 + 0.37::double x2, y2 + 0.41::double y2 from reach), s as (select *, {_HALF} h, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) n from moved), u as (select *, (x2 - x1) / n ux, (y2 - y1) / n uy, (x1 + x2) / 2 mx, (y1 + y2) / 2 my from s),
pr as (select *, unnest(range(floor(least(y1, y2) - h - 1)::bigint, ceil(greatest(y1, y2) + h + 1)::bigint + 1)) r from u), pc as (select *, unnest(range(floor(least(x1, x2) - h - 1)::bigint, ceil(greatest(x1, x2) + h + 1)::bigint + 1)) c from pr),
d as (select *, c + 0.5::double - mx dx, r + 0.5::double - my dy from pc)
select line, cast(r as int) r, cast(c as int) c from d where abs(dx * ux + dy * uy) <= n / 2 + (abs(ux) + abs(uy)) / 2 and abs(dy * ux - dx * uy) <= h + (abs(ux) + abs(uy)) / 2 and abs(dx) <= 0.5::double + n / 2 * abs(ux) + h * abs(uy) and abs(dy) <= 0.5::double + n / 2 * abs(uy) + h * abs(ux)""")
def touched_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels that buffers with flat ends touch."""
    at = {c: F.col(c) + (0.37 if c[0] == "x" else 0.41) for c in V.SEGMENT}  # off the pixels' sides
    s = _reaches(spark, d).withColumns({**at, "part": F.lit(1), "seq": F.lit(1), "half": 1.3 + F.col("line") % 4 * 0.71})
    return V.touched_pixels(s)


_RECT = "rect as (select s_suppkey % 40 g, cast(s_suppkey * 7 % 10 as int) minx, cast(s_suppkey * 3 % 10 as int) miny, cast(s_suppkey * 7 % 10 + 4 + s_suppkey % 5 as int) maxx, cast(s_suppkey * 3 % 10 + 4 + s_suppkey % 3 as int) maxy from supplier)"


@query(f"with {_RECT}, box as (select c_custkey id, cast(c_custkey * 11 % 12 as int) x, cast(c_custkey * 5 % 12 as int) y, cast(1 + c_custkey % 4 as int) w from customer), cell as (select id, x, y, w, unnest(range(x, x + w)) cx from box), cells as (select *, unnest(range(y, y + w)) cy from cell), hit as (select id, cx, cy, max(rect.g is not null) ok from cells left join rect on cx >= minx and cx < maxx and cy >= miny and cy < maxy group by 1, 2, 3) select id, min(ok) covered from hit group by id")
def covered_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that the union of rectangles contains."""
    k = F.col("s_suppkey")
    b = table(spark, d, "supplier").select((k * 7 % 10).cast("double").alias("minx"), (k * 3 % 10).cast("double").alias("miny"), (k * 7 % 10 + 4 + k % 5).cast("double").alias("maxx"), (k * 3 % 10 + 4 + k % 3).cast("double").alias("maxy"))
    c = F.col("c_custkey")
    x, y, w = c * 11 % 12, c * 5 % 12, 1 + c % 4
    boxes = table(spark, d, "customer").select(c.alias("id"), x.cast("double").alias("minx"), y.cast("double").alias("miny"), (x + w).cast("double").alias("maxx"), (y + w).cast("double").alias("maxy"))
    return sources.covered(b, boxes)


def _flow(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("line"), F.when(p % 4 != 0, F.col("p_brand")).alias("name"), (p % 14).cast("int").alias("ord"), F.when(p % 3 == 0, F.col("p_retailprice") / 100).alias("discharge"), (p % 5 == 0).alias("intermittent"), F.col("p_retailprice").alias("lengthkm"))


@query(f"""with a as (select p_size % 14 o, case when p_size % 3 = 0 then p_retailprice / 100 end q, p_size % 5 = 0 i, p_retailprice km from part), b as (select *, greatest(2, least(10, o)) g from a),
e as (select *, case when q > 0 then greatest(3.0::double, sqrt(q) * 4.8::double) else case g {_TAB(geo.WIDTHS)} end end w, case when q > 0 then greatest(0.5::double, pow(q, 0.3::double) * 0.35::double) else case g {_TAB(geo.DEPTHS)} end end dp from b)
select round_even(w, 0) width, round_even((case when i then dp * 0.5::double else dp end) * 10, 0) / 10 depth, count(*) n, round(sum(km), 4) km from e group by 1, 2""")
def channel_groups(spark: SparkSession, d: str) -> DataFrame:
    return publishing.channel_groups(_flow(spark, d)).select("width", "depth", "n", _r("km", 4))


@query("select p_brand \"name\", cast(max(p_size % 14) as int) ord from part where p_size % 4 <> 0 group by 1 order by 2 desc, 1 limit 8")
def named_orders(spark: SparkSession, d: str) -> DataFrame:
    return publishing.named_orders(_flow(spark, d))


@query(f"with {_RUNS}, new as (select slug, max(seq) + 1 seq, 7.0::double scale from runs where slug % 2 = 0 group by 1), u as (select slug, seq, scale from runs union all select * from new) select slug, seq, scale from (select *, row_number() over (partition by slug order by seq desc) b from u) where b <= 3")
def appended_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each site's last three runs after another one is put behind those of every second site."""
    runs = _runs(spark, d).select("slug", "seq", "scale")
    new = runs.where("slug % 2 = 0").select("slug").distinct().withColumn("scale", F.lit(7.0))
    return publishing.appended(runs, new, 3).select("slug", "seq", "scale")


_DOC = """doc as (select c_custkey k, '{"site":{"name":"bench_a_' || c_custkey || '","lat":' || (c_custkey % 170 - 85) || '.0,"lon":12.5,"epsg":32633},"params":{"exaggeration":1.0,"burn":true,"deterrace":"auto","oversample":"auto","hydro":{"min_order":2,"depth_scale":1.0}},"vertical":{"height_scale_m":' || (200 + c_custkey % 9 * 10) || '.0,"sea_level_m":50.0},"playable":{"relief_m":' || c_custkey % 700 || '.5,"buildable_fraction_land":0.5},"water_sources":[{"kind":"water.lake"},{"kind":"water.stream"},{"kind":"water.lake"}],"downloaded":{"bytes":' || c_custkey * 12345 || '}}' manifest from customer)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.format_string('{"site":{"name":"bench_a_%d","lat":%d.0,"lon":12.5,"epsg":32633},"params":{"exaggeration":1.0,"burn":true,"deterrace":"auto","oversample":"auto","hydro":{"min_order":2,"depth_scale":1.0}},"vertical":{"height_scale_m":%d.0,"sea_level_m":50.0},"playable":{"relief_m":%d.5,"buildable_fraction_land":0.5},"water_sources":[{"kind":"water.lake"},{"kind":"water.stream"},{"kind":"water.lake"}],"downloaded":{"bytes":%d}}', k, k % 170 - 85, 200 + k % 9 * 10, k % 700, k * 12345)
    return publishing.named(publishing.parsed(table(spark, d, "customer").select(k.alias("slug"), k.alias("map"), text.alias("manifest"))))


@query(f"with {_DOC} select k slug, cast(manifest ->> '$.vertical.height_scale_m' as double) height_scale_m, cast(manifest ->> '$.playable.relief_m' as double) relief_m, cast(json_array_length(manifest -> '$.water_sources') as int) water_sources, 2 lakes, round_even(cast(manifest ->> '$.downloaded.bytes' as bigint) / 1e6, 1) downloaded_mb, false mixed_sources from doc")
def scorecards(spark: SparkSession, d: str) -> DataFrame:
    s = publishing.scorecards(_docs(spark, d))
    return s.select("slug", "height_scale_m", "relief_m", "water_sources", F.element_at("water_source_kinds", F.lit("lake")).alias("lakes"), "downloaded_mb", "mixed_sources")


_HASHED = """'{"burn":true,"depth_scale":1.0,"deterrace":"auto","epsg":32633,"exaggeration":1.0,"lat":' || (k % 170 - 85) || '.0,"lon":12.5,"min_order":2,"oversample":"auto","sea_level_m":null,"water_surface_real_m":null}'"""


@query(f"with {_DOC} select k map, 'A ' || k title, substr(sha1({_HASHED}), 1, 7) hash, 'A ' || k || ' - ' || substr(sha1({_HASHED}), 1, 7) folder, 'A_' || k stem from doc")
def map_names(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("map", "title", "hash", "folder", "stem")


@query(f"with {_DOC}, f as (select k map, 'A ' || k || ' - ' || substr(sha1({_HASHED}), 1, 7) folder, 'A_' || k stem, unnest(['x_heightmap.png', 'x_qa.png', 'x.log']) name, unnest(['h' || k % 3, 'q', 'l']) sha from doc), t as (select map, folder, name source, sha, folder || '/' || stem || '_' || substr(name, 3) target from f where name <> 'x.log') select map, folder, source, target, case when map % 2 = 1 then 'add' when sha in ('h0', 'q') then 'keep' else 'replace' end action from t")
def publish_plan(spark: SparkSession, d: str) -> DataFrame:
    """What publishing would do to each file."""
    maps = _docs(spark, d)
    pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), s.alias("sha")) for n, s in (("x_heightmap.png", F.concat(F.lit("h"), (F.col("map") % 3).cast("string"))), ("x_qa.png", F.lit("q")), ("x.log", F.lit("l")))]))
    done = F.inline(F.array(*[F.struct(F.concat("folder", F.lit("/"), "stem", F.lit(f"_{n}")).alias("target"), F.lit(s).alias("sha")) for n, s in (("heightmap.png", "h0"), ("qa.png", "q"))]))
    return publishing.file_plan(maps, maps.select("map", pairs), maps.where("map % 2 = 0").select(done))


@query(f"with {_DOC} select 'A ' || k || ' - ' || substr(sha1({_HASHED}), 1, 7) || '/A_' || k || '_heightmap.png' target from doc where k % 4 <> 0")
def untracked_files(spark: SparkSession, d: str) -> DataFrame:
    target = F.concat("folder", F.lit("/"), "stem", F.lit("_heightmap.png"))
    maps = _docs(spark, d)
    plan = maps.select(target.alias("target")).unionAll(maps.select(F.concat("folder", F.lit("/x_qa.png"))))
    return publishing.untracked(plan, maps.where("map % 4 = 0").select(target.alias("target")))


@query("select s_suppkey k, round_even((s_suppkey * 1.5::double + s_suppkey + 7) / 2, 9) lon, round_even((s_suppkey % 60 + 0.25::double + s_suppkey % 60 + 2) / 2, 9) lat from supplier where s_suppkey < 60 and s_suppkey <> 14")
def box_centres(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    lon, lat = geo.centre(F.least(k * 1.5, k + 7.0), k % 60 + 0.25, F.greatest(k * 1.5, k + 7.0), k % 60 + 2.0)
    s = table(spark, d, "supplier").where("s_suppkey < 60 and s_suppkey <> 14")  # 14 makes a box without width
    return s.select(k.alias("k"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


def _square_map(spark: SparkSession, d: str) -> tuple[DataFrame, layers.Grid, DataFrame, DataFrame, DataFrame]:
    """A map 100 pixels wide of 14 m over the raster, with rivers along it and lakes."""
    from fluvius.plans.fixtures import raster

    dem = raster(spark, d).select("r", "c", (100 + F.col("z") / 50).alias("z"))
    n = dem.agg(F.max("r")).first()[0] + 1
    on = layers.Grid(0.0, n * 14.0, 14.0, n, 100)
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    y0 = (k * 37 % 100) / 100 * n * 14
    flow = s.where("s_suppkey <= 12").select(k.alias("line"), F.col("s_name").alias("name"), (k % 9 + 1).cast("int").alias("ord"), F.when(k % 4 == 0, k * 3.0).alias("discharge"), (k % 5 == 0).alias("culvert"), F.array(point(F.lit(-50.0), y0), point(F.lit(600.0), y0 + k % 7 * 20), point(F.lit(1500.0), y0 + 30)).alias("geom"))
    x, y, a = k * 61 % 1400, (k * 29 % 100) / 100 * n * 14, 40 + k % 3 * 60
    ring = F.array(F.array(point(x - a, y), point(x, y - a), point(x + a, y), point(x, y + a), point(x - a, y)))
    poly = s.where("s_suppkey between 3 and 9").select(k.alias("poly"), F.lit(None).cast("string").alias("name"), F.when(k % 2 == 0, 390).otherwise(460).alias("ftype"), ring.alias("rings"))
    return dem, on, flow, poly.where("ftype = 460"), poly.where("ftype = 390")


@query()
def map_layers(spark: SparkSession, d: str) -> DataFrame:
    """Water layers of a map from its lines and polygons (tested against known maps)."""
    return layers.build(*_square_map(spark, d))[0].select("r", "c", "polygon", "mask", _r("depth"), _r("surface"))


@query()
def map_report(spark: SparkSession, d: str) -> DataFrame:
    return layers.build(*_square_map(spark, d))[1]


@query()
def reference_surface(spark: SparkSession, d: str) -> DataFrame:
    dem, on, flow, areas, bodies = _square_map(spark, d)
    return layers.reference_surface(dem, on, flow, layers.build(dem, on, flow, areas, bodies)[1])
