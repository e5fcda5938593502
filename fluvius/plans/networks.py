"""Network, placement and history queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvius.operators import graph, history, proposal
from fluvius.operators import placements as P
from fluvius.plans.fixtures import VERT, raster, table, vertices
from fluvius.plans.rasters import _r

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _ends(spark: SparkSession, d: str) -> DataFrame:
    v = vertices(spark, d).groupBy("line").agg(F.min(F.struct("seq", "x", "y")).alias("a"), F.max(F.struct("seq", "x", "y")).alias("b"))
    return v.select("line", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


CELL = 2.0
_ENDS = VERT + ", ends as (select line, round_even(min_by(x, seq) / 2, 0)::bigint ax, round_even(min_by(y, seq) / 2, 0)::bigint ay, round_even(max_by(x, seq) / 2, 0)::bigint bx, round_even(max_by(y, seq) / 2, 0)::bigint byy from vert group by line)"
_DOWN = _ENDS + ", down as (select a.line src, b.line dst from ends a join ends b on a.bx = b.ax and a.byy = b.ay and a.line <> b.line)"
_LEVEL = _DOWN + ", out_ as (select line node from ends where line not in (select src from down)), up(node, lvl) as (select node, 1 from out_ union select d.src, u.lvl + 1 from up u join down d on d.dst = u.node where u.lvl < 60), lev as (select e.line node, coalesce(min(lvl), 1) \"level\", coalesce(min(lvl), 0) raw from ends e left join up on up.node = e.line group by 1)"


@query(f"with {_DOWN} select src, dst from down")
def endpoint_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.snap_edges(_ends(spark, d), CELL)


@query(f"with recursive {_ENDS}, k as (select line, ax x, ay y from ends union select line, bx, byy from ends), s as (select distinct a.line a, b.line b from k a join k b using (x, y) where a.line <> b.line), g(id, k) as (select line, line from ends union select s.b, g.k from g join s on s.a = g.id where s.b > g.k), m as (select id, min(k) k from g group by id), r as (select a, b from s), h(id, k) as (select id, k from m union select r.b, h.k from h join r on r.a = h.id join m on m.id = r.b where h.k < m.k) select id node, min(k) component from h group by id")
def components(spark: SparkSession, d: str) -> DataFrame:
    e = _ends(spark, d)
    c = graph.components(graph.touch_edges(e, CELL))
    return e.join(c, e["line"] == c["node"], "left").select(F.col("line").alias("node"), F.coalesce("component", "line").alias("component"))


@query(f"with recursive {_LEVEL} select node, \"level\", raw from lev")
def hydroseq(spark: SparkSession, d: str) -> DataFrame:
    e = _ends(spark, d)
    return graph.upstream_levels(e.select(F.col("line").alias("node")), graph.snap_edges(e, CELL))


@query(f"with recursive {_LEVEL} select node, \"level\", coalesce((select min(l2.raw) from down join lev l2 on l2.node = down.dst where down.src = lev.node), 0) down, case when node in (select dst from down) then 0 else 1 end start, case when node in (select src from down) then 0 else 1 end terminal from lev")
def network_flags(spark: SparkSession, d: str) -> DataFrame:
    e = _ends(spark, d)
    edges = graph.snap_edges(e, CELL)
    return graph.network_flags(graph.upstream_levels(e.select(F.col("line").alias("node")), edges), edges)


@query("select cust, id, seq from (select o_custkey cust, o_orderkey id, o_totalprice seq, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders) where rn = 1")
def levelpath_top(spark: SparkSession, d: str) -> DataFrame:
    """The row with the greatest sequence of each path, the first on a tie."""
    best = F.min(F.struct((-F.col("o_totalprice")).alias("n"), F.col("o_orderkey").alias("id"))).alias("b")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(best).select("cust", "b.id", (-F.col("b.n")).alias("seq"))


@query("with t as (select o_orderkey id, o_totalprice drainage from orders), n as (select count(*) n, max(drainage) m from t) select id, drainage, round(drainage / m, 9) rate, case when drainage / m > 0.5 then 'large' when drainage / m > 0.15 then 'medium' else 'small' end size, greatest(n - 8, 0) skipped from t, n order by drainage desc, id limit 8")
def stream_rank(spark: SparkSession, d: str) -> DataFrame:
    return P.ranked(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("drainage")), 8).select("id", "drainage", _r("rate", 9), "size", "skipped")


def _points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), k.alias("seq"), (k * 37 % 1009).cast("double").alias("x"), (k * 53 % 997).cast("double").alias("y"), (k % 3).alias("ord"), F.col("c_nationkey").alias("path"), (k % 2).alias("flow"), F.col("c_acctbal").alias("drainage"), F.when(k % 4 != 0, F.col("c_name")).alias("name"), F.round(k % 7 * 1.0, 1).alias("area"), (F.col("c_acctbal") / 3).alias("level"))


@query()
def crossing_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Crossings of a path and direction, without those near one that was kept before."""
    return P.suppress(_points(spark, d).select("id", "seq", "x", "y", "path", "flow"), ["path", "flow"], 150.0).select("id", "path", "flow")


@query()
def crossing_clusters(spark: SparkSession, d: str) -> DataFrame:
    return P.seed_clusters(_points(spark, d).select("id", "seq", "x", "y", "path", "flow", "drainage", "name"), ["path", "flow"], 400.0).select("id", "path", "flow", "n")


@query("""with recursive p as (select c_custkey id, c_custkey * 37 % 1009 x, c_custkey * 53 % 997 y, c_custkey % 3 ord, c_custkey % 7 area, c_acctbal / 3 lvl from customer), s as (select a.id a, b.id b from p a join p b on a.ord = b.ord and a.area = b.area and a.id <> b.id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 3600),
g(id, k) as (select id, id from p union select s.b, g.k from g join s on s.a = g.id), m as (select id, min(k) grp from g group by id), r as (select m.grp, p.id, lvl, row_number() over (partition by grp order by lvl desc, p.id) rn, count(*) over (partition by grp) - 1 others from m join p using (id)) select id, round(lvl, 6) "level", others from r where rn = 1""")
def stream_reach_clusters(spark: SparkSession, d: str) -> DataFrame:
    return P.reach_clusters(_points(spark, d).select("id", "x", "y", "ord", "area", "level"), 60.0).select("id", _r("level"), "others")


@query()
def water_proposal(spark: SparkSession, d: str) -> DataFrame:
    """All placements of a map made of the given tables: customers and suppliers as rivers, nations as lakes and seas, events as pixels."""
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    lines = table(spark, d, "customer").select(k.alias("line"), (k % 500).alias("path"), (k % 8).cast("int").alias("ord"), F.when(k % 4 != 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("drainage"), k.alias("hydroseq"), (k % 2).alias("startflag"), (k % 3).alias("flowdir"), (k % 11 == 0).alias("culvert"))
    x, y = (k * 37 % 12_000 - 1000).cast("double"), (k * 53 % 12_000 - 1000).cast("double")
    segments = table(spark, d, "customer").select(k.alias("line"), F.lit(1).alias("seq"), x.alias("x1"), y.alias("y1"), (x + k % 900 - 450).alias("x2"), (y + k % 700 - 350).alias("y2"))
    polygons = table(spark, d, "nation").select(n.alias("poly"), F.when(n % 3 == 0, 445).otherwise(390).alias("ftype"), F.col("n_name").alias("name"), (n % 3 != 0).alias("body"))
    at = lambda i, j: ((n % 5 * 2100 + i * 1000 + 200).cast("double"), (F.floor(n / 5) * 2100 + j * 1000 + 200).cast("double"))
    corners = [at(0, 0), at(1, 0), at(1, 1), at(0, 1)]
    sides = [F.struct(*[v.alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (*corners[i], *corners[(i + 1) % 4]), strict=True)]) for i in range(4)]
    edges = table(spark, d, "nation").select(n.alias("poly"), F.inline(F.array(*sides)))
    pixels = raster(spark, d).select("r", "c", "z", F.when(F.col("kind") == "view", F.col("z")).alias("surface"), (F.col("kind") == "view").alias("water"))
    return proposal.propose(lines, segments, polygons, edges, pixels, proposal.Border((0, 0, 10_000, 10_000), 100.0, 100)).select("kind", "key", "c", "r", "level", "label")


_KIND = "[" + ", ".join(f"'{k}'" for k, _, _ in P.KINDS) + "]"
_PLACED = f"placed as (select c_custkey id, c_nationkey doc, {_KIND}[c_custkey % {len(P.KINDS)} + 1] kind, cast(c_custkey * 37 % 4096 as int) r, cast(c_custkey * 53 % 4096 as int) c, c_name label from customer)"
_GROUP = "case kind " + " ".join(f"when '{k}' then {g}" for k, _, g in P.KINDS) + " end"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    kinds = F.array(*[F.lit(x[0]) for x in P.KINDS])
    return table(spark, d, "customer").select(k.alias("id"), F.col("c_nationkey").alias("doc"), F.element_at(kinds, (k % len(P.KINDS) + 1).cast("int")).alias("kind"), (k * 37 % 4096).cast("int").alias("r"), (k * 53 % 4096).cast("int").alias("c"), F.col("c_name").alias("label"))


@query(f"with {_PLACED} select doc, id, cast(row_number() over (partition by doc order by {_GROUP}, kind, r, c, id) as int) number, kind from placed")
def placements_sorted(spark: SparkSession, d: str) -> DataFrame:
    return P.numbered(_placed(spark, d)).select("doc", "id", "number", "kind")


_LABELS = "case kind " + " ".join(f"when '{k}' then '{label}'" for k, label, _ in P.KINDS) + " end"


@query(f"with {_PLACED}, n as (select *, row_number() over (partition by doc order by {_GROUP}, kind, r, c, id) number from placed) select doc, string_agg('| ' || number || ' | ' || {_LABELS} || ' | ' || label || ' | ' || c || ', ' || r || ' |', chr(10) order by number) \"table\" from n group by doc")
def placements_markdown(spark: SparkSession, d: str) -> DataFrame:
    return P.markdown(P.numbered(_placed(spark, d)))


_RUNS = "runs as (select o_custkey slug, o_orderkey seq, (o_totalprice % 1000) / 1000 buildable, o_totalprice % 7 > 3 as s1, floor(o_totalprice / 50000) * 100 scale, o_orderkey % 4 sources, (o_totalprice % 100) / 100 seam, (o_totalprice % 10) / 10 water from orders), last_ as (select *, row_number() over (partition by slug order by seq desc) back from runs)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("slug"), k.alias("seq"), (p % 1000 / 1000).alias("buildable"), (F.floor(p / 50000) * 100).cast("double").alias("scale"), (k % 4).alias("sources"), (p % 100 / 100).alias("seam"), (p % 10 / 10).alias("water"))


@query(f"with {_RUNS} select slug, seq, scale, sources from last_ where back = 1")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(_runs(spark, d)).select("slug", "seq", "scale", "sources")


@query(f"with {_RUNS} select slug, seq, cast(back as int) back from last_ where back <= 5")
def run_cap(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(_runs(spark, d), 5).select("slug", "seq", "back")


@query(f"with {_RUNS} select n.slug, concat_ws(',', case when abs(n.buildable - o.buildable) > 0.02 then 'buildable' end, case when n.scale <> o.scale then 'scale' end, case when n.sources <> o.sources then 'sources' end, case when n.seam > 2 * o.seam and n.seam > 0.2 then 'seam' end) drift from last_ n join last_ o on o.slug = n.slug and n.back = 1 and o.back = 2")
def bench_compare(spark: SparkSession, d: str) -> DataFrame:
    return history.drift(_runs(spark, d)).select("slug", F.array_join("drift", ",").alias("drift"))


@query(f"with {_RUNS}, rg as (select slug, unnest(['buildable', 'seam', 'sources']) metric, unnest([0.2, null, 1.0])::double lo, unnest([0.7, 0.5, null])::double hi from (select distinct slug from runs)), l as (select slug, unnest(['buildable', 'seam', 'sources']) metric, unnest([buildable, seam, sources::double]) \"value\" from last_ where back = 1) select slug, metric, round(\"value\", 9) \"value\" from rg join l using (slug, metric) where coalesce(\"value\" < lo, false) or coalesce(\"value\" > hi, false)")
def bench_check(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d)
    r = spark.createDataFrame([("buildable", 0.2, 0.7), ("seam", None, 0.5), ("sources", 1.0, None)], "metric string, lo double, hi double")
    return history.check(runs, runs.select("slug").distinct().crossJoin(F.broadcast(r)), ["buildable", "seam", "sources"]).select("slug", "metric", _r("value", 9))


@query(f"with {_RUNS} select slug, round(buildable - 0.05, 9) buildable_lo, round(buildable + 0.05, 9) buildable_hi, round(scale * 0.9, 9) scale_lo, round(scale * 1.1, 9) scale_hi, round(water - 0.02, 9) water_lo, round(water + 0.02, 9) water_hi, sources - 3 sources_lo, sources + 3 sources_hi, round(greatest(0.5, seam * 2), 9) seam_hi from last_ where back = 1")
def expected_ranges(spark: SparkSession, d: str) -> DataFrame:
    e = history.expected(_runs(spark, d))
    return e.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in e.dtypes])


@query(f"with {_RUNS} select c_custkey slug, case when l.slug is null then 'not run' else '| ' || c_name || ' | ' || sources || ' |' end \"row\" from customer left join last_ l on l.slug = c_custkey and back = 1")
def index_table(spark: SparkSession, d: str) -> DataFrame:
    """A table row for each site, with its newest run if it has one."""
    l_ = history.latest(_runs(spark, d)).select("slug", "sources")
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("slug"), "c_name").join(l_, "slug", "left")
    return s.select("slug", F.when(F.col("sources").isNull(), "not run").otherwise(F.format_string("| %s | %d |", "c_name", "sources")).alias("row"))


@query("select p_partkey k, substr(sha1('{\"brand\":\"' || p_brand || '\",\"key\":' || p_partkey || ',\"size\":' || case when p_size % 5 = 0 then 'null' else p_size::varchar end || '}'), 1, 16) h from part")
def request_hash(spark: SparkSession, d: str) -> DataFrame:
    h = history.request_hash(("size", F.when(F.col("p_size") % 5 != 0, F.col("p_size"))), ("key", F.col("p_partkey")), ("brand", F.col("p_brand")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), h.alias("h"))


@query("select p_partkey k, array_to_string(list_transform(string_split(trim(regexp_replace(lower(p_name), '[_\\- ]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' - ' || substr(sha1(p_partkey::varchar), 1, 7) folder from part")
def display_name(spark: SparkSession, d: str) -> DataFrame:
    name = history.display_name(F.concat(F.lit("bench_"), F.replace("p_name", F.lit(" "), F.lit("_"))))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(name, F.lit(" - "), F.substring(F.sha1(F.col("p_partkey").cast("string")), 1, 7)).alias("folder"))


@query("select event_id k, cast(props ->> '$.k' as int) tag, coalesce(props ->> '$.water', 'none') water, case when cast(props ->> '$.k' as int) % 3 = 0 then 'culvert' else 'open' end state from events")
def osm_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of a JSON document, with defaults and derived attributes."""
    t = F.from_json("props", "map<string,string>")
    tag = F.try_element_at(t, F.lit("k")).cast("int")
    return table(spark, d, "events").select(F.col("event_id").alias("k"), tag.alias("tag"), F.coalesce(F.try_element_at(t, F.lit("water")), F.lit("none")).alias("water"), F.when(tag % 3 == 0, "culvert").otherwise("open").alias("state"))


@query("select event_type kind, count(*) n, count(distinct user_id) users, string_agg(distinct user_id::varchar, ',' order by user_id::varchar) filter (where user_id < 20) few from events group by 1")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    few = F.array_join(F.array_sort(F.collect_set(F.when(F.col("user_id") < 20, F.col("user_id").cast("string")))), ",")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.when(few != "", few).alias("few"))
