"""Social-network query programs, graph patterns and lineage on the driver tables.

What stands for what: a person is a customer, `knows` is the undirected order
graph; a post is an order by its customer, a comment is an event by its user that
replies to order event_id * 13 % orders; a post's tags are the brands of its
lines' parts, a tag's class is the part's type; a country is a nation; a forum is
a supplier, its members the customers that bought from it, since the first ship
date; every fourth comment (event_id % 4 = 1) also replies to comment event_id // 3; a like is a `click` event on that same order; a person works at supplier
c_custkey % suppliers since 1990 + c_custkey % 30; interests are brands bought.
The person asked about is customer 10.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.operators import algorithms, dictionary
from tidegraph.operators.traverse import Pattern
from tidegraph.plans.registry import query
from tidegraph.plans.tables import K_SQL

ME = 10
CIRCLE = f"f as (select dst as p from k where src = {ME}), ff as (select p from f union select k.dst from f join k on k.src = f.p where k.dst <> {ME})"
POSTS = "posts as (select o_orderkey as msg, o_custkey as creator, o_orderdate as ts from orders)"
COMMENTS = "comments as (select event_id as msg, user_id as creator, ts, event_id * 13 % (select count(*) from orders) as reply_of, event_type from events)"
TAGS = "tags as (select distinct l_orderkey as msg, p_brand as tag, p_type as class from lineitem join part on p_partkey = l_partkey)"
INTEREST = "interest as (select distinct o_custkey as p, p_brand as tag from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey)"


def WITH(*parts: str) -> str:
    return "with " + ", ".join((K_SQL, CIRCLE, *parts)) + " "


def friends(t):
    return t.knows().where(F.col("src") == ME).select(F.col("dst").alias("p"))


def circle(t):
    """Friends and their friends, without oneself."""
    f = friends(t)
    two = f.join(t.knows(), F.col("p") == F.col("src")).select(F.col("dst").alias("p"))
    return f.union(two).where(F.col("p") != ME).distinct()


def posts(t):
    return t.orders.select(F.col("o_orderkey").alias("msg"), F.col("o_custkey").alias("creator"), F.col("o_orderdate").alias("ts"))


def comments(t):
    n = t.orders.count()
    return t.events.select(F.col("event_id").alias("msg"), F.col("user_id").alias("creator"), "ts", (F.col("event_id") * 13 % n).alias("reply_of"), "event_type")


def tags(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("msg"), F.col("p_brand").alias("tag"), F.col("p_type").alias("class")).distinct()


def interests(t):
    return posts(t).join(tags(t), "msg").select(F.col("creator").alias("p"), "tag").distinct()


def messages(t):
    """Posts and comments as one."""
    a = posts(t).select(F.lit("post").alias("kind"), "msg", "creator", "ts")
    return a.unionByName(comments(t).select(F.lit("comment").alias("kind"), "msg", "creator", "ts"))


MESSAGES = "messages as (select 'post' as kind, msg, creator, ts from posts union all select 'comment', msg, creator, ts from comments)"


@query("ic1", WITH("h3 as (select dst as p, 3 as dist from ff join k on src = p union all select p, 2 from ff union all select p, 1 from f), near as (select p, min(dist) as dist from h3 where p <> 10 group by p)") + "select p, dist::int as dist, c_mktsegment as segment, c_name as name from near join customer on c_custkey = p where starts_with(c_mktsegment, 'BUILD') order by dist, name, p limit 20")
def ic1(t):
    levels = algorithms.bfs(t.knows(), ME, first=0, depth=3).where("level > 0")
    c = t.customer.where(F.col("c_mktsegment").startswith("BUILD"))
    return levels.join(c, F.col("vid") == F.col("c_custkey")).select(F.col("vid").alias("p"), F.col("level").alias("dist"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name")).orderBy("dist", "name", "p").limit(20)


@query("ic2", WITH(POSTS, COMMENTS, MESSAGES) + "select kind, msg, creator, ts from messages where creator in (select p from f) and ts <= timestamp '2024-01-05' order by ts desc, msg, kind limit 20")
def ic2(t):
    m = messages(t).where(F.col("ts") <= F.lit("2024-01-05").cast("timestamp"))
    return m.join(friends(t), F.col("creator") == F.col("p"), "left_semi").orderBy(F.desc("ts"), "msg", "kind").limit(20)


@query(
    "ic3",
    WITH("s as (select o_custkey as p, s_nationkey as nation, o_orderkey as msg from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey)")
    + "select p, count(distinct msg) as n from s where p in (select p from ff) and nation in (1, 2) group by p having count(distinct nation) = 2 order by n desc, p limit 20",
)
def ic3(t):
    """Posts stand in the countries of their lines' suppliers."""
    s = t.bought().join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).where(F.col("s_nationkey").isin(1, 2))
    s = s.select(F.col("o_custkey").alias("p"), "s_nationkey", "o_orderkey").join(circle(t), "p", "left_semi")
    both = s.where("s_nationkey = 1").select("p").join(s.where("s_nationkey = 2").select("p"), "p", "left_semi").distinct()
    return s.join(both, "p", "left_semi").groupBy("p").agg(F.countDistinct("o_orderkey").alias("n")).orderBy(F.desc("n"), "p").limit(20)


@query("ic4", WITH(POSTS, TAGS) + "select tag, count(distinct msg) as n from posts join tags using (msg) where creator in (select p from f) and ts >= timestamp '1996-01-01' and ts < timestamp '1998-01-01' group by tag order by n desc, tag limit 10")
def ic4(t):
    lo, hi = (F.lit(d).cast("timestamp") for d in ("1996-01-01", "1998-01-01"))
    own = posts(t).where((F.col("ts") >= lo) & (F.col("ts") < hi)).join(friends(t), F.col("creator") == F.col("p"), "left_semi")
    return own.join(tags(t).select("msg", "tag").distinct(), "msg").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@query(
    "ic5",
    WITH("b as (select o_custkey as p, l_suppkey as forum, o_orderkey as msg, o_orderdate as ts, l_shipdate as ship from orders join lineitem on l_orderkey = o_orderkey), member as (select p, forum from b group by p, forum having min(ship) > timestamp '1996-01-01')")
    + "select forum, count(distinct msg) as n from b join member using (p, forum) where p in (select p from ff) group by forum order by n desc, forum limit 20",
)
def ic5(t):
    b = t.bought().select(F.col("o_custkey").alias("p"), F.col("l_suppkey").alias("forum"), F.col("o_orderkey").alias("msg"), F.col("l_shipdate").alias("ship")).join(circle(t), "p", "left_semi")
    member = b.groupBy("p", "forum").agg(F.min("ship").alias("joined")).where(F.col("joined") > F.lit("1996-01-01").cast("timestamp"))
    return b.join(member, ["p", "forum"]).groupBy("forum").agg(F.countDistinct("msg").alias("n")).orderBy(F.desc("n"), "forum").limit(20)


@query("ic6", WITH(POSTS, TAGS) + "select tag, count(distinct msg) as n from tags where tag <> 'Brand#7' and msg in (select msg from posts where creator in (select p from ff)) and msg in (select msg from tags where tag = 'Brand#7') group by tag order by n desc, tag limit 10")
def ic6(t):
    own = posts(t).join(circle(t), F.col("creator") == F.col("p"), "left_semi").select("msg")
    pairs = tags(t).select("msg", "tag").distinct().join(own, "msg", "left_semi")
    with_tag = pairs.where("tag = 'Brand#7'").select("msg")
    return pairs.where("tag <> 'Brand#7'").join(with_tag, "msg", "left_semi").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@query("ic7", WITH(POSTS, COMMENTS) + "select c.creator as liker, c.msg as like_id, c.ts, c.creator in (select p from f) as is_friend, datediff('day', posts.ts, c.ts)::int as latency_days from comments c join posts on posts.msg = c.reply_of where c.event_type = 'click' and posts.creator = 10 order by c.ts desc, c.msg limit 20")
def ic7(t):
    likes = comments(t).where("event_type = 'click'").select(F.col("creator").alias("liker"), F.col("msg").alias("like_id"), F.col("ts").alias("at"), "reply_of")
    mine = posts(t).where(F.col("creator") == ME).select("msg", "ts")
    flag = friends(t).withColumn("is_friend", F.lit(True))
    d = likes.join(mine, F.col("reply_of") == F.col("msg")).join(flag, F.col("liker") == F.col("p"), "left")
    return d.select("liker", "like_id", F.col("at").alias("ts"), F.coalesce("is_friend", F.lit(False)).alias("is_friend"), F.date_diff("at", "ts").alias("latency_days")).orderBy(F.desc("ts"), "like_id").limit(20)


@query("ic8", WITH(POSTS, COMMENTS) + "select msg as reply, creator, ts from comments where reply_of in (select msg from posts where creator = 10) or (msg % 4 = 1 and msg // 3 in (select msg from comments where creator = 10)) order by ts desc, reply limit 20")
def ic8(t):
    """Replies to posts and to comments; a reply to both counts once."""
    c = comments(t)
    to_posts = c.join(posts(t).where(F.col("creator") == ME).select(F.col("msg").alias("reply_of")), "reply_of", "left_semi")
    own = c.where(F.col("creator") == ME).select(F.col("msg").alias("parent"))
    to_comments = c.where("msg % 4 = 1").withColumn("parent", F.floor(F.col("msg") / 3)).join(own, "parent", "left_semi")
    columns = [F.col("msg").alias("reply"), "creator", "ts"]
    return to_posts.select(*columns).union(to_comments.select(*columns)).distinct().orderBy(F.desc("ts"), "reply").limit(20)


@query("ic9", WITH(POSTS, COMMENTS, MESSAGES) + "select kind, msg, creator, ts from messages where creator in (select p from ff) and ts < timestamp '2024-01-10' order by ts desc, msg, kind limit 20")
def ic9(t):
    m = messages(t).where(F.col("ts") < F.lit("2024-01-10").cast("timestamp"))
    return m.join(circle(t), F.col("creator") == F.col("p"), "left_semi").orderBy(F.desc("ts"), "msg", "kind").limit(20)


@query(
    "ic10",
    WITH(INTEREST, "far as (select p from ff where p not in (select p from f)), mine as (select tag from interest where p = 10)")
    + "select p, sum(case when tag in (select tag from mine) then 1 else -1 end)::bigint as score from interest where p in (select p from far) group by p order by score desc, p limit 10",
)
def ic10(t):
    far = circle(t).join(friends(t), "p", "left_anti")
    i = interests(t)
    mine = i.where(F.col("p") == ME).select("tag", F.lit(1).alias("mine"))
    scored = i.join(far, "p", "left_semi").join(mine, "tag", "left")
    return scored.groupBy("p").agg(F.sum(F.coalesce("mine", F.lit(-1))).alias("score")).orderBy(F.desc("score"), "p").limit(10)


@query("ic11", WITH("w as (select c_custkey as p, c_custkey % (select count(*) from supplier) as org, 1990 + c_custkey % 30 as since from customer)") + "select p, org, since from w where p in (select p from ff) and org in (select s_suppkey from supplier where s_nationkey < 8) order by since, p limit 10")
def ic11(t):
    n = t.supplier.count()
    works = t.customer.select(F.col("c_custkey").alias("p"), (F.col("c_custkey") % n).alias("org"), (F.col("c_custkey") % 30 + 1990).alias("since"))
    there = t.supplier.where("s_nationkey < 8").select(F.col("s_suppkey").alias("org"))
    return works.join(circle(t), "p", "left_semi").join(there, "org", "left_semi").select("p", "org", "since").orderBy("since", "p").limit(10)


@query("ic12", WITH(COMMENTS, TAGS) + "select creator as p, count(*) as n from comments where creator in (select p from f) and reply_of in (select msg from tags where class = 'PROMO') group by creator order by n desc, p limit 20")
def ic12(t):
    tagged = tags(t).where("class = 'PROMO'").select(F.col("msg").alias("reply_of"))
    c = comments(t).join(friends(t), F.col("creator") == F.col("p"), "left_semi").join(tagged, "reply_of", "left_semi")
    return c.groupBy(F.col("creator").alias("p")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(20)


@query("ic13", f"with recursive {K_SQL}, r as (select {ME}::bigint as vid, 0 as level union select k.dst, r.level + 1 from r join k on k.src = r.vid where r.level < 12) select min(level)::int as length from r where vid = 77")
def ic13(t):
    return algorithms.bfs(t.knows(), ME, first=0, target=77).where("vid = 77").agg(F.min("level").alias("length"))


@query(
    "ic13_path",
    f"with recursive {K_SQL}, r as (select {ME}::bigint as vid, 0 as level union select k.dst, r.level + 1 from r join k on k.src = r.vid where r.level < 12), l as (select vid, min(level) as level from r group by vid), p as (select vid, level from l where vid = 77 union all select (select min(l.vid) from l join k on k.src = l.vid and k.dst = p.vid where l.level = p.level - 1), p.level - 1 from p where p.level > 0) select level::int as step, vid from p",
)
def ic13_path(t):
    return algorithms.shortest_path(t.knows(), ME, 77)


@query("type_list", "select c_name as name from customer where c_mktsegment = 'MACHINERY'")
def type_list(t):
    return t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_name").alias("name"))


@query("type_filter", "select c_custkey as vid from customer where c_mktsegment in ('BUILDING', 'FURNITURE')")
def type_filter(t):
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "FURNITURE")).select(F.col("c_custkey").alias("vid"))


def hierarchy(t):
    """The super-type HOME holds two segments."""
    return t.spark.createDataFrame([("HOME", "HOUSEHOLD"), ("HOME", "FURNITURE")], "super string, tid string")


@query("type_inference", "select c_custkey as vid from customer where c_mktsegment in ('HOUSEHOLD', 'FURNITURE')")
def type_inference(t):
    v = t.customer.select(F.col("c_custkey").alias("vid"), F.col("c_mktsegment").alias("tid"))
    return dictionary.of_super_type(v, hierarchy(t), "HOME").select("vid")


def takes(t):
    """Relations for patterns: customers take parts; suppliers work for nations and publish parts."""
    b = t.bought()
    return {
        "takes": b.select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")).distinct(),
        "works_for": t.supplier.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst")),
        "published": t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct(),
    }


TAKEN = "select distinct o_custkey from orders join lineitem on l_orderkey = o_orderkey where l_partkey = 5"


@query("lubm_q1", f"select c_custkey as x from customer where c_mktsegment = 'HOUSEHOLD' and c_custkey in ({TAKEN})")
def lubm_q1(t):
    found = Pattern(takes(t)).triple("?x", "takes", 5).select("?x")
    return found.join(t.customer.where("c_mktsegment = 'HOUSEHOLD'"), F.col("x") == F.col("c_custkey"), "left_semi")


@query("lubm_q1_infer", f"select c_custkey as x from customer where c_mktsegment in ('HOUSEHOLD', 'FURNITURE') and c_custkey in ({TAKEN})")
def lubm_q1_infer(t):
    v = t.customer.select(F.col("c_custkey").alias("x"), F.col("c_mktsegment").alias("tid"))
    return Pattern(takes(t)).triple("?x", "takes", 5).select("?x").join(dictionary.of_super_type(v, hierarchy(t), "HOME"), "x", "left_semi")


@query("lubm_bgp2", "select distinct s_suppkey as x, p_partkey as y, p_name as name from supplier join lineitem on l_suppkey = s_suppkey join part on p_partkey = l_partkey where s_nationkey = 4")
def lubm_bgp2(t):
    found = Pattern(takes(t)).triple("?x", "works_for", 4).triple("?x", "published", "?y").select("?x", "?y")
    return found.join(t.part, F.col("y") == F.col("p_partkey")).select("x", "y", F.col("p_name").alias("name"))


@query("lubm_q4", "select s_suppkey as x, s_name as name, n_name as nation, round(s_acctbal, 2) as balance from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA'")
def lubm_q4(t):
    """A super-type over nations (the region), then three properties."""
    inside = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(inside, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("x"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.round("s_acctbal", 2).alias("balance"))


@query("wls_lineage", "select c_name as username, a.event_id as process, a.event_type as name, b.event_id as parent, b.event_type as parent_name from events a join customer on c_custkey = a.user_id join events b on b.event_id = a.event_id // 2 where a.event_id > 0")
def wls_lineage(t):
    """A user's processes and their parents: event_id // 2 stands for the parent."""
    runs = t.events.where("event_id > 0").select("event_id", "user_id", F.col("event_type").alias("name"), F.floor(F.col("event_id") / 2).alias("parent"))
    parent = t.events.select(F.col("event_id").alias("parent"), F.col("event_type").alias("parent_name"))
    named = runs.join(t.customer, F.col("user_id") == F.col("c_custkey")).join(parent, "parent")
    return named.select(F.col("c_name").alias("username"), F.col("event_id").alias("process"), "name", "parent", "parent_name")


@query("semi_join", "select c_custkey as vid from customer where c_custkey in (select user_id from events)")
def semi_join(t):
    return t.customer.select(F.col("c_custkey").alias("vid")).join(t.events.select(F.col("user_id").alias("vid")), "vid", "left_semi")


@query("anti_join", "select c_custkey as vid from customer where c_custkey not in (select user_id from events)")
def anti_join(t):
    return t.customer.select(F.col("c_custkey").alias("vid")).join(t.events.select(F.col("user_id").alias("vid")), "vid", "left_anti")


@query("set_intersect", f"with {K_SQL} select dst as vid from k where src = 10 intersect select b.dst from k a join k b on a.dst = b.src where a.src = 11")
def set_intersect(t):
    k = t.knows()
    two = k.where("src = 11").select(F.col("dst").alias("m")).join(k, F.col("m") == F.col("src")).select("dst")
    return k.where("src = 10").select(F.col("dst").alias("vid")).intersect(two)


@query("exists_tag", f"with {TAGS} select o_orderkey as msg from orders where exists (select 1 from tags where msg = o_orderkey and tag = 'Brand#7')")
def exists_tag(t):
    return t.orders.select(F.col("o_orderkey").alias("msg")).join(tags(t).where("tag = 'Brand#7'"), "msg", "left_semi")


@query("topk", "select o_orderkey as eid, o_totalprice as weight from orders order by o_totalprice desc, o_orderkey limit 20")
def topk(t):
    return t.orders.select(F.col("o_orderkey").alias("eid"), F.col("o_totalprice").alias("weight")).orderBy(F.desc("weight"), "eid").limit(20)


@query("filter_ts", "select o_orderkey as eid from orders where strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') < '1996-06-01T00:00:00'")
def filter_ts(t):
    return t.orders.where(F.col("o_orderdate") < F.lit("1996-06-01").cast("timestamp")).select(F.col("o_orderkey").alias("eid"))


@query("filter_prefix", "select c_custkey as vid, c_name as name from customer where c_name like 'Customer#0000000%'")
def filter_prefix(t):
    return t.customer.where(F.col("c_name").startswith("Customer#0000000")).select(F.col("c_custkey").alias("vid"), F.col("c_name").alias("name"))


@query("project_props", "select c_custkey as vid, c_name as name, n_name as nation, r_name as region from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def project_props(t):
    d = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select(F.col("c_custkey").alias("vid"), F.col("c_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
