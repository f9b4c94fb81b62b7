"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima and two equi-joins over the current edge
set.  A hub is pre-aggregated on the map side, and its edges meet its minimum by a
broadcast of the hubs alone: vertices with more than a `HUBS`-th of all edges, so
of a bounded number.  Each round is written to the shared folder, which cuts the
lineage and lets the job go on when executors are lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.storage import stage

#: There are at most twice as many hubs, whatever the number of edges.
HUBS = 20_000


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hub = F.col("n") > max(64, n_edges // HUBS)
    hubs = F.broadcast(least.where(hub).select(F.col("u").alias("hub"), F.col("m").alias("low")))
    told = both.join(hubs, both["u"] == F.col("hub"), "left").select("u", "v", "low")
    rest = told.where("low is null").select("u", "v").join(least.where(~hub).select("u", "m"), "u")
    moved = rest.select("u", "v", "m").union(told.where("low is not null").select("u", "v", F.col("low").alias("m")))
    return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (u, v) of any orderable type -> (vertex, component), component = least vertex reachable.

    Self-loops and repeated edges are harmless; rows with a null end are
    ignored; a vertex that only has self-loops is not returned.  An empty
    edge table gives an empty result.
    """
    spark = edges.sparkSession
    now = edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct()
    now = stage(spark, now, "edges")
    seen, n_edges = None, now.count()
    for _ in range(max_rounds):
        now = stage(spark, _small_star(_large_star(now, n_edges)), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 998244353)).first()
        if tuple(mark) == seen:
            break
        seen, n_edges = tuple(mark), mark[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("vertex")).distinct()
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots.select("vertex", F.col("vertex").alias("component")))
