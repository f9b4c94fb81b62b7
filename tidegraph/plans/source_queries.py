"""Parsers on text made from the driver tables, properties and their indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.functions import encoders
from tidegraph.operators import dictionary, edges
from tidegraph.plans.registry import query
from tidegraph.plans.tables import E_SQL
from tidegraph.sources import readers
from tidegraph.storage import stage


@query("src_text_edges", f"with {E_SQL} select src, dst, count(*) as n from e where eid % 10 <> 0 group by all")
def src_text_edges(t):
    """Every tenth line is a comment, every third separated by tabs."""
    k = F.col("eid")
    line = F.when(k % 10 == 0, F.format_string("%% %d", k)).when(k % 3 == 0, F.format_string("%d\t\t%d", "src", "dst")).otherwise(F.format_string(" %d %d", "src", "dst"))
    return readers.text_edges(t.log().select(line.alias("value"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("src_netflow", "select 'C' || o_custkey as src_device, o_orderkey % 65536 as dst_port, count(*) as n, sum(o_orderkey % 97)::bigint as src_bytes from orders group by all")
def src_netflow(t):
    k = F.col("o_orderkey")
    line = F.format_string("%d,1,C%d,D%d,6,Port%d,%s%d,1,2,%d,4", k, "o_custkey", k % 10, k % 1000, F.when(k % 2 == 0, "Port").otherwise(""), k % 65536, k % 97)
    return readers.netflow(t.orders.select(line.alias("value"))).groupBy("src_device", "dst_port").agg(F.count("*").alias("n"), F.sum("src_bytes").alias("src_bytes"))


@query("src_triples", "select '<c' || c_custkey || '>' as subject, '<in>' as predicate, '<n' || c_nationkey || '>' as object from customer union all select '<c' || c_custkey || '>', '<name>', '\"' || c_name || '\"' from customer")
def src_triples(t):
    a = t.customer.select(F.format_string("<c%d> <in> <n%d> .", "c_custkey", "c_nationkey").alias("value"))
    b = t.customer.select(F.format_string('<c%d>  <name> "%s" .', "c_custkey", "c_name").alias("value"))
    return readers.triples(a.union(b))


@query("src_binary_edges", f"with {E_SQL} select src, dst, count(*) as n from e group by all")
def src_binary_edges(t):
    """Packs the log into little-endian records, a file for each 4096, and reads them back."""
    pad = lambda c: F.concat(*(F.substring(F.lpad(F.hex(F.col(c)), 16, "0"), 2 * k + 1, 2) for k in range(7, -1, -1)))
    records = t.log().select(F.floor(F.col("eid") / 4096).alias("part"), F.unhex(F.concat(pad("src"), pad("dst"))).alias("r"))
    files = records.groupBy("part").agg(F.unhex(F.concat_ws("", F.transform(F.collect_list("r"), lambda x: F.hex(x)))).alias("content"))
    return readers.unpack(files.select("content")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("json_extract_edges", "select user_id as src, (props->>'k')::bigint as dst, count(*) as n from events where props->>'k' is not null group by all")
def json_extract_edges(t):
    j = F.from_json("props", "k long")
    return t.events.select(F.col("user_id").alias("src"), j["k"].alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("src_host_events", "select 'u' || user_id || '@' || event_type as \"user\", event_id || '@h' || user_id % 7 || '@0x1' as process, event_id // 2 || '@h' || user_id % 7 || '@0x1' as parent from events where event_id % 5 <> 0")
def src_host_events(t):
    """Every fifth line lacks its domain and is left out."""
    domain = F.when(F.col("event_id") % 5 != 0, F.col("event_type"))
    line = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("UserName"), domain.alias("DomainName"), F.concat(F.lit("h"), F.col("user_id") % 7).alias("LogHost"), F.lit("0x1").alias("LogonID"), F.col("event_id").alias("Time"), F.col("event_id").cast("string").alias("ProcessID"), F.floor(F.col("event_id") / 2).cast("string").alias("ParentProcessID")))
    return readers.host_events(t.events.select(line.alias("value"))).select("user", "process", "parent")


@query("src_csr_edges", f"with {E_SQL} select src, dst, count(*) as n from e group by all")
def src_csr_edges(t):
    """Compressed rows made from the log and exploded again."""
    from pyspark.sql import Window as W

    e = stage(t.spark, t.log().select("eid", "src", "dst"), "log")
    rows = edges.csr(t.vertices(), e).select("vid", "start", (F.col("start") + F.col("degree")).alias("end"))
    rows = stage(t.spark, rows, "csr")
    nth = F.row_number().over(W.partitionBy("src").orderBy("eid")) - 1
    nbrs = e.withColumn("nth", nth).join(rows, F.col("src") == F.col("vid")).select((F.col("start") + F.col("nth")).alias("pos"), "dst")
    return readers.csr_edges(rows, nbrs).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("vertex_props", "select o_custkey as vid, arg_max(o_orderpriority, o_orderkey) as priority, arg_max(o_totalprice, o_orderkey) as price from orders group by 1")
def vertex_props(t):
    """Last write wins for each property."""
    d = t.orders.select(F.col("o_custkey").alias("vid"), F.col("o_orderkey").alias("eid"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    return d.groupBy("vid").agg(F.max_by("priority", "eid").alias("priority"), F.max_by("price", "eid").alias("price"))


@query("prop_cast", "select o_orderkey as eid, o_orderdate as at, o_totalprice as price, o_custkey as vid, o_orderkey * 3 as hexed from orders")
def prop_cast(t):
    """Typed values from their text."""
    text = t.orders.select(F.col("o_orderkey").alias("eid"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("a"), F.col("o_totalprice").cast("string").alias("b"), F.col("o_custkey").cast("string").alias("c"), F.concat(F.lit("0x"), F.hex(F.col("o_orderkey") * 3)).alias("d"))
    use = encoders.encode
    return text.select("eid", use("time", F.col("a")).alias("at"), use("double", F.col("b")).alias("price"), use("int64", F.col("c")).alias("vid"), use("hex", F.col("d")).alias("hexed"))


@query("props_inverted_index", "select c_mktsegment as value, c_custkey // 256 as part, count(*) as n, string_agg(c_custkey::varchar, ',' order by c_custkey) as vids from customer group by all")
def props_inverted_index(t):
    d = t.customer.select(F.col("c_custkey").alias("vid"), F.col("c_mktsegment").alias("value"))
    return dictionary.inverted(d, "value", 256).select("value", "part", F.size("vids").cast("long").alias("n"), F.array_join("vids", ",").alias("vids"))


@query("props_map", "select o_custkey as vid, arg_max(o_orderstatus, o_orderkey) as status, arg_max(o_orderpriority, o_orderkey) as priority from orders group by 1")
def props_map(t):
    a = t.orders.select(F.col("o_custkey").alias("vid"), F.lit("status").alias("name"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("eid"))
    b = t.orders.select(F.col("o_custkey").alias("vid"), F.lit("priority").alias("name"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("eid"))
    m = dictionary.property_map(a.union(b))
    return m.select("vid", F.col("props")["status"].alias("status"), F.col("props")["priority"].alias("priority"))


@query("property_edges", "select l_suppkey as src, l_partkey as dst, count(*) as n, round(sum(l_quantity), 2) as quantity, max(l_shipdate) as last from lineitem group by 1, 2")
def property_edges(t):
    """A multigraph's edge properties, per pair."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.max("l_shipdate").alias("last"))
