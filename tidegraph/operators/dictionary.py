"""Names and ids, types and super-types, properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a vertex id inside its type, in a packed id.
VBIT = 40


def build(named: DataFrame, batch: int = 1 << 16) -> DataFrame:
    """(tid, name, eid) -> (tid, vid, name): ids dense per type in order of first sight, then name.

    Numbered in two steps, by archive batch and inside it, so a type with most
    of the names isn't one task.
    """
    first = named.groupBy("tid", "name").agg(F.min("eid").alias("first")).withColumn("b", F.floor(F.col("first") / batch))
    sums = first.groupBy("tid", "b").agg(F.count("*").alias("n"))
    base = sums.select("tid", "b", F.coalesce(F.sum("n").over(W.partitionBy("tid").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = first.withColumn("k", F.row_number().over(W.partitionBy("tid", "b").orderBy("first", "name")) - 1)
    return own.join(base, ["tid", "b"]).select("tid", (F.col("base") + F.col("k")).cast("long").alias("vid"), "name")


def pack(tid, vid):
    return F.shiftleft(tid.cast("long"), VBIT).bitwiseOR(vid)


def unpack(sid):
    """A packed id -> its type and its id inside it; a deleted one's mark is left out."""
    return F.shiftright(F.abs(sid), VBIT).cast("int"), F.abs(sid).bitwiseAND((1 << VBIT) - 1)


def deleted(sid):
    """The packed id that says that its edge is deleted, for ids packed with type ids from 1 on or vertices from 1 on."""
    return -sid


def is_deleted(sid):
    return sid < 0


def names_of(ids: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid) -> (sid, name)."""
    return sids.join(ids.select(pack(F.col("tid"), F.col("vid")).alias("sid"), "name"), "sid")


def precreate(spark: SparkSession, n: int) -> DataFrame:
    """n vertices (vid) without names."""
    return spark.range(n).select(F.col("id").alias("vid"))


def resolve(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(eid, src_name, dst_name) -> (eid, src, dst); rows with an unknown name are left out."""
    a = ids.select(F.col("name").alias("src_name"), F.col("vid").alias("src"))
    b = ids.select(F.col("name").alias("dst_name"), F.col("vid").alias("dst"))
    return edges.join(a, "src_name").join(b, "dst_name").select("eid", "src", "dst")


def of_super_type(vertices: DataFrame, hierarchy: DataFrame, name: str) -> DataFrame:
    """Vertices whose type belongs to the super-type."""
    return vertices.join(hierarchy.where(F.col("super") == name).select("tid").distinct(), "tid", "left_semi")


def inverted(properties: DataFrame, value: str, chunk: int = 1 << 16) -> DataFrame:
    """(vid, value) -> (value, part, vids): the vertices of each value in order, a row for each `chunk` of ids, so that a common value is many rows."""
    part = F.floor(F.col("vid") / chunk).cast("long").alias("part")
    return properties.groupBy(value, part).agg(F.array_sort(F.collect_list("vid")).alias("vids"))


def property_map(properties: DataFrame) -> DataFrame:
    """(vid, name, value, eid) -> (vid, props): a map with the last value of each name."""
    newest = properties.groupBy("vid", "name").agg(F.max_by("value", "eid").alias("value"))
    return newest.groupBy("vid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("props"))
