"""Views, access, hops and analytics over the ordered edge log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.operators import algorithms, dictionary, edges, traverse, views
from tidegraph.plans.registry import query
from tidegraph.plans.tables import D_SQL, E_SQL, K_SQL, N_SQL
from tidegraph.streaming import runners

BATCH = 256
W = f"with {E_SQL}, {N_SQL} "
EV = "select eid, src, dst"
COLS = ("eid", "src", "dst")


def view(t, **options):
    return views.static_view(t.log(), t.vertices(), BATCH, **options)


@query("edge_log", W + "select eid, src, dst, weight from e")
def edge_log(t):
    return t.log().select(*COLS, "weight")


@query("log_range", W + EV + " from e, n where eid >= head // 4 and eid < head // 2")
def log_range(t):
    head = t.head()
    return view(t).delta(head // 4, head // 2).raw.select(*COLS)


@query("static_view", W + EV + " from e")
def static_view(t):
    return view(t).edges.select(*COLS)


@query("view_stale", W + EV + f" from e, n where eid < head // {BATCH} * {BATCH}")
def view_stale(t):
    return view(t, stale=True).edges.select(*COLS)


@query("view_simple", W + "select src, count(*) as degree from e group by src")
def view_simple(t):
    return view(t).degrees().where("degree > 0").select(F.col("vid").alias("src"), "degree")


@query("view_tail", W + EV + f" from e, n where eid >= head // {BATCH} * {BATCH}")
def view_tail(t):
    head = t.head()
    return view(t).delta(head // BATCH * BATCH, head).edges.select(*COLS)


@query("historical_view", W + EV + " from e, n where eid >= head // 4 and eid < head * 3 // 4")
def historical_view(t):
    head = t.head()
    return view(t).delta(head // 4, head * 3 // 4).edges.select(*COLS)


@query("stream_delta", W + EV + f" from e, n where eid >= head - {BATCH}")
def stream_delta(t):
    head = t.head()
    return view(t).delta(head - BATCH, head).edges.select(*COLS)


@query("window_view", W + "select src, count(*) as n, sum(dst)::bigint as dst_sum from e, n where eid >= head - 1000 group by src")
def window_view(t):
    return view(t).window(1000).edges.groupBy("src").agg(F.count("*").alias("n"), F.sum("dst").alias("dst_sum"))


@query("time_window", f"with {E_SQL} select src, date_trunc('day', ts) as start, count(*) as n, round(sum(weight), 2) as total from e group by all")
def time_window(t):
    e = t.log().select("src", "ts", F.col("weight").alias("value"))
    return runners.windowed(e).select("src", "start", "n", F.round("total", 2).alias("total"))


@query(
    "changed_vertices",
    W + "select vid, before, after from (select c_custkey as vid, (select count(*) from e, n where src = c_custkey and eid < head // 2) as before, (select count(*) from e where src = c_custkey) as after from customer) where before <> after",
)
def changed_vertices(t):
    head = t.head()
    return view(t).changed(head // 2, head)


@query("snapshots", f"with {N_SQL} select (row_number() over (order by marker) - 1)::bigint as snap_id, marker from (select {BATCH} * k as marker from n, range(1, (select head from n) // {BATCH} + 1) r(k) where {BATCH} * k < head union select head from n)")
def snapshots(t):
    return views.snapshots(t.spark, t.head(), BATCH)


@query("live_edges", f"with {D_SQL}, s as (select *, sum(op) over (partition by src, dst order by eid) as r from d) select eid, src, dst from s a where op = 1 and not exists (select 1 from s b where b.src = a.src and b.dst = a.dst and b.eid > a.eid and b.r < a.r)")
def live(t):
    return edges.live_edges(t.del_log()).select(*COLS)


@query("live_edges_undirected", f"with {D_SQL}, u as (select eid, op, src, dst, least(src, dst) as x, greatest(src, dst) as y from d), s as (select *, sum(op) over (partition by x, y order by eid) as r from u) select eid, src, dst from s a where op = 1 and not exists (select 1 from s b where b.x = a.x and b.y = a.y and b.eid > a.eid and b.r < a.r)")
def live_undirected(t):
    return edges.live_edges(t.del_log(), directed=False).select(*COLS)


@query("edges_with_deletes", f"with {D_SQL}, s as (select *, sum(op) over (partition by src, dst order by eid) as r from d), w as (select *, r - least(0, min(r) over (partition by src, dst order by eid)) as h from s) select src, dst, arg_max(h, eid)::bigint as multiplicity from w group by src, dst having arg_max(h, eid) > 0")
def edges_with_deletes(t):
    from tidegraph.sources.readers import actions

    k = F.col("op")
    signed = t.del_log().select("eid", (k * (F.col("src") + 1)).alias("src"), (k * (F.col("dst") + 1)).alias("dst"))
    log = actions(signed).select("eid", "op", (F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"))
    return edges.live_edges(log).groupBy("src", "dst").agg(F.count("*").alias("multiplicity"))


@query("edges_reverse", W + "select eid, dst as src, src as dst from e")
def edges_reverse(t):
    return edges.reverse(t.log().select(*COLS))


@query("edges_undirected", W + "select eid, src, dst from e union all select eid, dst, src from e")
def edges_undirected(t):
    return edges.undirected(t.log().select(*COLS))


@query("edge_tiles", W + "select src // 256 as tile_i, dst // 256 as tile_j, count(*) as n from e group by all")
def edge_tiles(t):
    return edges.tiles(t.log(), 8).groupBy("tile_i", "tile_j").agg(F.count("*").alias("n"))


@query("adjacency", W + "select src, eid // 4096 as part, count(*) as degree, string_agg(dst::varchar, ',' order by eid) as nbrs from e group by all")
def adjacency(t):
    return edges.adjacency(t.log(), 4096).select("src", "part", "degree", F.array_join("nbrs", ",").alias("nbrs"))


@query("adjacency_dump", W + "select src, 'out' as side, eid // 65536 as part, string_agg(dst::varchar, ' ' order by eid) as nbrs from e group by all union all select dst, 'in', eid // 65536, string_agg(src::varchar, ' ' order by eid) from e group by all")
def adjacency_dump(t):
    out, into = edges.adjacency(t.log()), edges.adjacency(edges.reverse(t.log().select(*COLS)))
    return out.withColumn("side", F.lit("out")).unionByName(into.withColumn("side", F.lit("in"))).select("src", "side", "part", F.array_join("nbrs", " ").alias("nbrs"))


@query("csr_offsets", f"with {E_SQL}, g as (select c_custkey as vid, count(src) as degree from customer left join e on src = c_custkey group by c_custkey) select vid, degree, coalesce(sum(degree) over (order by vid rows between unbounded preceding and 1 preceding), 0)::bigint as start from g")
def csr_offsets(t):
    return edges.csr(t.vertices(), t.log())


@query("many2one_lww", W + "select src, arg_max(dst, eid) as dst from e group by src")
def many2one(t):
    return edges.many_to_one(t.log())


@query("one2one_lww", W + ", l as (select src, arg_max(dst, eid) as dst, max(eid) as eid from e group by src) select arg_max(src, eid) as src, dst from l group by dst")
def one2one(t):
    return edges.one_to_one(t.log())


@query("degree_out", W + "select c_custkey as vid, count(src) as degree from customer left join e on src = c_custkey group by 1")
def degree_out(t):
    return view(t).degrees()


@query("degree_in", W + "select c_custkey as vid, count(dst) as degree from customer left join e on dst = c_custkey group by 1")
def degree_in(t):
    return view(t).degrees("in")


@query("degree_at_snapshot", W + f"select c_custkey as vid, count(src) as degree from customer left join (select src from e where eid < 3 * {BATCH}) on src = c_custkey group by 1")
def degree_at_snapshot(t):
    return view(t).at(views.marker_of(2, t.head(), BATCH)).degrees()


@query("degree_live", f"with {D_SQL}, s as (select *, sum(op) over (partition by src, dst order by eid) as r from d), w as (select *, r - least(0, min(r) over (partition by src, dst order by eid)) as h from s), m as (select src, dst, arg_max(h, eid) as c from w group by src, dst) select src as vid, sum(c)::bigint as degree from m group by src having sum(c) > 0")
def degree_live(t):
    return views.GraphView(t.del_log(), t.vertices()).degrees().where("degree > 0")


@query("neighbors", W + EV + " from e where src in (0, 1, 2)")
def neighbors(t):
    return view(t).neighbours([0, 1, 2]).select(*COLS)


@query("neighbors_slice", W + "select src, pos, dst from (select src, dst, row_number() over (partition by src order by eid) - 1 as pos from e) where pos between 2 and 4")
def neighbors_slice(t):
    return view(t).neighbours_slice(2, 3)


@query("graph_stats", W + "select (select count(*) from customer) as vertices, (select count(*) from e) as edges, (select count(*) from (select distinct src, dst from e)) as distinct_edges, (select count(*) from e where src = dst) as loops, (select head from n) as marker")
def graph_stats(t):
    e = t.log()
    pairs = e.groupBy("src", "dst").agg(F.count("*").alias("c"))
    d = pairs.agg(F.sum("c").alias("edges"), F.count("*").alias("distinct_edges"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("c")).otherwise(0)).alias("loops"))
    return d.select(F.lit(t.customer.count()).cast("long").alias("vertices"), F.coalesce("edges", F.lit(0)).alias("edges"), "distinct_edges", F.coalesce("loops", F.lit(0)).alias("loops"), F.lit(t.head()).cast("long").alias("marker"))


@query("edge_weight_scan", W + "select src, count(*) as n, round(max(weight), 2) as top from e where weight >= 250000 group by src")
def edge_weight_scan(t):
    return t.log().where("weight >= 250000").groupBy("src").agg(F.count("*").alias("n"), F.round(F.max("weight"), 2).alias("top"))


@query("seeds_nonzero_degree", W + "select distinct src as vid from e")
def seeds_nonzero_degree(t):
    return t.vertices().join(t.log(), F.col("vid") == F.col("src"), "left_semi")


H1 = "select c.c_custkey as root, e.dst as vid from customer c join e on e.src = c.c_custkey"


@query("hop1", W + f"select root, count(*) as paths, sum(vid)::bigint as total from ({H1}) group by root")
def hop1(t):
    return traverse.hops(t.vertices(), t.log(), 1).groupBy("root").agg(F.count("*").alias("paths"), F.sum("vid").alias("total"))


@query("hop1_in", W + "select dst as root, count(*) as paths, sum(src)::bigint as total from e group by dst")
def hop1_in(t):
    return traverse.hops(t.vertices(), edges.reverse(t.log()), 1).groupBy("root").agg(F.count("*").alias("paths"), F.sum("vid").alias("total"))


@query("hop1_any", W + "select c_custkey as root, count(*) as paths, sum(case when src = c_custkey then dst else 0 end + case when dst = c_custkey then src else 0 end)::bigint as total from customer join e on src = c_custkey or dst = c_custkey where src <> dst group by 1")
def hop1_any(t):
    # two equi-joins in place of an OR join
    return traverse.hops(t.vertices(), edges.undirected(t.log().where("src <> dst")), 1).groupBy("root").agg(F.count("*").alias("paths"), F.sum("vid").alias("total"))


@query("hop1_sum", W + "select sum(dst)::bigint as total from e")
def hop1_sum(t):
    seeds = t.log().select(F.col("src").alias("vid")).distinct()
    return traverse.hops(seeds, t.log(), 1).agg(F.sum("vid").alias("total"))


@query("hop2", W + "select a.src as root, count(*) as paths, sum(b.dst)::bigint as total from e a join e b on a.dst = b.src group by 1")
def hop2(t):
    return traverse.hop2_totals(t.vertices(), t.log())


@query("hop2_sum", W + "select sum(b.dst)::bigint as total from e a join e b on a.dst = b.src")
def hop2_sum(t):
    return traverse.hop2_totals(t.vertices(), t.log()).agg(F.sum("total").alias("total"))


@query("hop2_distinct", W + "select distinct a.src as root, b.dst as vid from e a join e b on a.dst = b.src")
def hop2_distinct(t):
    e = t.log().select("src", "dst").distinct()
    return traverse.hops(t.vertices(), e, 2).distinct()


@query("friends_2hop", f"with {K_SQL} select a.dst as vid from k a where a.src = 10 union select b.dst from k a join k b on a.dst = b.src where a.src = 10 and b.dst <> 10")
def friends_2hop(t):
    k = t.knows()
    one = k.where("src = 10").select(F.col("dst").alias("vid"))
    two = one.join(k, F.col("vid") == F.col("src")).select(F.col("dst").alias("vid"))
    return one.union(two).distinct().where("vid <> 10")


def bfs_sql(graph: str, first: int = 1, root: int = 1) -> str:
    return f"with recursive {E_SQL}, {N_SQL}, g as ({graph}), r as (select {root}::bigint as vid, {first} as level union select g.dst, r.level + 1 from r join g on g.src = r.vid where r.level < 24), b as (select vid, min(level)::int as level from r group by vid) "


OUT = "select distinct src, dst from e"


@query("bfs", bfs_sql(OUT) + "select vid, level from b")
def bfs(t):
    return algorithms.bfs(t.log(), 1)


@query("bfs_levels", bfs_sql(OUT) + "select level, count(*) as n from b group by level")
def bfs_levels(t):
    return algorithms.bfs(t.log(), 1).groupBy("level").agg(F.count("*").alias("n"))


@query("bfs_undirected", bfs_sql("select src, dst from e union select dst, src from e") + "select level, count(*) as n from b group by level")
def bfs_undirected(t):
    return algorithms.bfs(edges.undirected(t.log().select(*COLS)), 1).groupBy("level").agg(F.count("*").alias("n"))


@query("bfs_historical", bfs_sql("select src, dst from e, n where eid < head // 5 union select dst, src from e, n where eid < head // 5") + "select level, count(*) as n from b group by level")
def bfs_historical(t):
    v = views.GraphView(t.log(), t.vertices(), 0, t.head() // 5, "undirected")
    return algorithms.bfs(v.edges, 1).groupBy("level").agg(F.count("*").alias("n"))


def pr_sql(rounds: int) -> str:
    steps = [f"with {E_SQL}, g as (select c_custkey as vid, count(src) as deg from customer left join e on src = c_custkey group by 1), p0 as (select vid, deg, case when deg > 0 then 0.15::double else 0::double end as p from g)"]
    for k in range(1, rounds + 1):
        value = "0.15::double + 0.85::double * coalesce(s, 0)"
        value = value if k == rounds else f"case when deg > 0 then ({value}) / deg else 0 end"
        steps.append(f"p{k} as (select g.vid, g.deg, {value} as p from g left join (select e.dst, sum(q.p) as s from e join p{k - 1} q on q.vid = e.src group by e.dst) x on x.dst = g.vid)")
    return ", ".join(steps) + f" select vid, round(p, 6) as rank from p{rounds}"


@query("pagerank_pull", pr_sql(5))
def pagerank_pull(t):
    return algorithms.pagerank(t.vertices(), t.log()).select("vid", F.round("rank", 6).alias("rank"))


@query("pagerank_push", pr_sql(5))
def pagerank_push(t):
    return algorithms.pagerank(t.vertices(), t.log(), push=True).select("vid", F.round("rank", 6).alias("rank"))


PR_EPS = f"""with recursive {E_SQL}, v as (select count(*)::double as n from customer),
g as (select c_custkey as vid, count(src) as deg from customer left join e on src = c_custkey group by 1),
r as (select vid, deg, 1 / n as p, 0 as k from g, v union all
  select g.vid, g.deg, 0.15 / v.n + 0.85 * coalesce(x.s, 0), x2.k + 1 from g cross join v cross join (select max(k) as k from r) x2
  left join (select e.dst, sum(r.p / r.deg) as s from e join r on r.vid = e.src group by e.dst) x on x.dst = g.vid where x2.k < 60)
select vid, round(p, 6) as rank from r where k = 60"""


@query("pagerank_eps", PR_EPS)
def pagerank_eps(t):
    return algorithms.pagerank_to(t.vertices(), t.log()).select("vid", F.round("rank", 6).alias("rank"))


WCC = f"with recursive {K_SQL}, r as (select distinct src as vid, src as label, 0 as j from k union all select vid, min(l), max(j) + 1 from (select vid, label as l, j from r union all select k.dst, r.label, r.j from r join k on k.src = r.vid) group by vid having max(j) < 24) "


@query("wcc", WCC + "select vid, label as component from r where j = 24")
def wcc(t):
    return algorithms.wcc(t.log())


@query("wcc_count", WCC + "select count(distinct label) as components, count(distinct vid) as vertices from r where j = 24")
def wcc_count(t):
    return algorithms.wcc(t.log()).agg(F.countDistinct("component").alias("components"), F.countDistinct("vid").alias("vertices"))


@query("stream_bfs", bfs_sql(OUT, first=0) + "select vid, level from b")
def stream_bfs(t):
    return runners.Stateful(t.log().select(*COLS), runners.bfs_step(1)).result()


@query("stream_bfs_serial", bfs_sql(OUT, first=0) + "select level, count(*) as n from b group by level")
def stream_bfs_serial(t):
    """Refresh by refresh without a streaming query: equal parts, the last takes all that is left."""
    from tidegraph.storage import stage

    log, head, state = stage(t.spark, t.log().select(*COLS), "log"), t.head(), None
    for k in range(3):
        v = views.GraphView(log, t.vertices())
        state = runners.bfs_step(1)(v.delta(head * k // 3, head * (k + 1) // 3).edges, v.at(head * (k + 1) // 3).edges, state)
    return state.groupBy("level").agg(F.count("*").alias("n"))


@query("stream_wcc", WCC + "select vid, label as component from r where j = 24")
def stream_wcc(t):
    return runners.Stateful(t.log().select(*COLS), runners.wcc_step).result()


@query("stream_pagerank", PR_EPS)
def stream_pagerank(t):
    return runners.Stateful(t.log().select(*COLS), runners.pagerank_step(t.vertices()), 2).result().select("vid", F.round("rank", 6).alias("rank"))


FLOW = "select user_id as src, count(*) as flows, round(sum(value), 2) as value, sum(event_id % 7)::bigint as packets, sum(length(props))::bigint as bytes from events group by 1"


def flows(t):
    return t.events.select(F.col("event_id").alias("eid"), F.col("user_id").alias("src"), "value", (F.col("event_id") % 7).alias("packets"), F.length("props").cast("long").alias("bytes"))


@query("flow_aggregate", FLOW)
def flow_aggregate(t):
    return runners.flow_step(flows(t), None, None).withColumn("value", F.round("value", 2))


@query("stream_flow", FLOW)
def stream_flow(t):
    return runners.Stateful(flows(t), runners.flow_step).result().withColumn("value", F.round("value", 2))


@query("bgp_transform", W + "select distinct dst as vid from e where src in (select c_custkey from customer where c_nationkey = 3)")
def bgp_transform(t):
    return traverse.transform(t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("vid")), t.log())


@query("bgp_transform_bu", W + "select distinct src as vid from e where dst in (select c_custkey from customer where c_nationkey = 3)")
def bgp_transform_bu(t):
    return traverse.transform(t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("vid")), t.log(), down=False)


@query("bgp_extend", W + "select c_custkey as vid, dst as x from customer join e on src = c_custkey where c_nationkey = 3")
def bgp_extend(t):
    return traverse.extend(t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("vid")), "vid", t.log(), "x")


@query("bgp_single", f"with {K_SQL} select distinct dst as x from k where src = 10")
def bgp_single(t):
    return traverse.Pattern({"knows": t.knows()}).triple(10, "knows", "?x").select("?x")


@query("type_counts", "select tid, count(*) as n from (select distinct 0 as tid, c_mktsegment as name from customer union select distinct 1, o_orderpriority from orders) group by tid")
def type_counts(t):
    return named(t).groupBy("tid").agg(F.count("*").alias("n"))


def named(t):
    """Two types of named vertices: segments (0) and priorities (1), in order of first sight."""
    a = t.customer.select(F.lit(0).alias("tid"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("eid"))
    b = t.orders.select(F.lit(1).alias("tid"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("eid"))
    return dictionary.build(a.union(b), BATCH)


DICT = "dict as (select tid, (row_number() over (partition by tid order by f, name) - 1)::bigint as vid, name from (select 0 as tid, c_mktsegment as name, min(c_custkey) as f from customer group by 2 union all select 1, o_orderpriority, min(o_orderkey) from orders group by 2))"


@query("vertex_dictionary", f"with {DICT} select tid, vid, name from dict")
def vertex_dictionary(t):
    return named(t)


@query("name_lookup", f"with {DICT} select name, (tid::bigint << 40) | vid as sid from dict")
def name_lookup(t):
    return named(t).select("name", dictionary.pack(F.col("tid"), F.col("vid")).alias("sid"))


@query("edges_by_name", f"with {DICT} select o_orderkey as eid, a.vid as src, b.vid as dst from orders join customer on c_custkey = o_custkey join dict a on a.tid = 0 and a.name = c_mktsegment join dict b on b.tid = 1 and b.name = o_orderpriority")
def edges_by_name(t):
    e = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("eid"), F.col("c_mktsegment").alias("src_name"), F.col("o_orderpriority").alias("dst_name"))
    return dictionary.resolve(e, named(t))
