"""The edge log and what is derived from it.

A relation is an append-only log (eid, op, src, dst, ...): eid is the offset and
the only order, op is +1 for an insert and -1 for a delete.  Duplicates are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_offsets(rows: DataFrame, *order: str) -> DataFrame:
    """Give rows without an offset one: their rank in the given order.  For small batches; a log's source should number its rows."""
    return rows.withColumn("eid", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).cast("long") - 1)


def head_of(log: DataFrame) -> int:
    """The offset after the last row's; 0 for an empty log."""
    return log.agg(F.coalesce(F.max("eid") + 1, F.lit(0))).first()[0]


def reverse(edges: DataFrame) -> DataFrame:
    swap = {"src": "dst", "dst": "src"}
    return edges.select(*(F.col(swap.get(c, c)).alias(c) for c in edges.columns))


def undirected(edges: DataFrame) -> DataFrame:
    """Forward and reverse copies; a self-loop stands twice."""
    return edges.unionByName(reverse(edges))


def live_edges(log: DataFrame, directed: bool = True) -> DataFrame:
    """Inserts that no delete has cancelled.

    A delete takes the newest live insert of its (src, dst), whatever its weight;
    one with nothing to take does nothing.  An insert is thus gone as soon as the
    running sum of op falls below its own value at some later row of the pair.
    Undirected: a delete of (a, b) also takes an insert of (b, a).
    One shuffle serves both windows: one runs forward, one back over the row
    numbers, so that each row costs the same however long its pair's history is
    and rows of one eid keep their order.
    """
    pair = [F.col("src"), F.col("dst")] if directed else [F.least("src", "dst"), F.greatest("src", "dst")]
    w = W.partitionBy(*pair).orderBy("eid")
    summed = log.withColumns({"_n": F.row_number().over(w), "_s": F.sum("op").over(w.rowsBetween(W.unboundedPreceding, 0))})
    back = W.partitionBy(*pair).orderBy(F.desc("_n")).rowsBetween(W.unboundedPreceding, -1)
    later = summed.withColumn("_low", F.min("_s").over(back))
    return later.where((F.col("op") == 1) & (F.col("_low").isNull() | (F.col("_low") >= F.col("_s")))).drop("_n", "_s", "_low")


def last_write(rows: DataFrame, key: str | list[str], value: str, order: str = "eid") -> DataFrame:
    """Last write wins per key; a map-side aggregate, no sort."""
    keys = [key] if isinstance(key, str) else key
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def many_to_one(log: DataFrame) -> DataFrame:
    """Out side single-valued: the last dst of each src."""
    return last_write(log, "src", "dst")


def one_to_one(log: DataFrame) -> DataFrame:
    """Both sides single-valued: of the last write of each src, the newest per dst."""
    newest = log.groupBy("src").agg(F.max_by("dst", "eid").alias("dst"), F.max("eid").alias("eid"))
    return newest.groupBy("dst").agg(F.max_by("src", "eid").alias("src")).select("src", "dst")


def adjacency(edges: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """(src, part, degree, nbrs): chunks of neighbours in log order, each of the edges of `chunk` offsets, so that a hub is many rows.

    part: the chunk's first offset over `chunk`; degree: of the chunk.
    """
    part = F.floor(F.col("eid") / chunk).cast("long").alias("part")
    return edges.groupBy("src", part).agg(F.count("*").alias("degree"), F.transform(F.array_sort(F.collect_list(F.struct("eid", "dst"))), lambda x: x["dst"]).alias("nbrs"))


def explode_adjacency(lists: DataFrame) -> DataFrame:
    """Stored adjacency -> (src, part, pos, dst), in each list's order."""
    return lists.select("src", "part", F.posexplode("nbrs").alias("pos", "dst"))


def evict(edges: DataFrame, lo: int) -> DataFrame:
    """What is left when edges of offsets under lo are given up, as a window's past is."""
    return edges.where(F.col("eid") >= lo)


def csr(vertices: DataFrame, edges: DataFrame, rows_a_range: int = 1 << 20) -> DataFrame:
    """(vid, degree, start): adjacency offsets over all vertices, without one task that sorts them all.

    Vertices are dense from 0; a range's start comes from the sums of the ranges before it.
    """
    degree = vertices.join(edges.groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("degree")), "vid", "left").fillna(0, ["degree"])
    n = (vertices.agg(F.max("vid")).first()[0] or 0) + 1
    ranges = max(64, -(-n // rows_a_range))
    d = degree.withColumn("r", F.floor(F.col("vid") * ranges / n).cast("int"))
    sums = d.groupBy("r").agg(F.sum("degree").alias("s"))
    starts = sums.select("r", F.coalesce(F.sum("s").over(W.partitionBy(F.lit(0)).orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # `ranges` rows
    inner = W.partitionBy("r").orderBy("vid").rowsBetween(W.unboundedPreceding, -1)
    run = d.withColumn("own", F.coalesce(F.sum("degree").over(inner), F.lit(0)))
    return run.join(starts, "r").select("vid", "degree", (F.col("base") + F.col("own")).alias("start"))


def tiles(edges: DataFrame, bits: int = 16) -> DataFrame:
    """Edges with the tile of the vertex-pair grid they fall in."""
    return edges.withColumns({"tile_i": F.shiftright("src", bits), "tile_j": F.shiftright("dst", bits)})
