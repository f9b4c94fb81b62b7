"""Views: what part of a log a reader sees.  A view is a lazily filtered log, so a range of offsets prunes the scan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.operators.edges import evict, head_of, live_edges, reverse, undirected
from tidegraph.storage import stage

#: Edges in an archive batch unless said otherwise.
BATCH = 1 << 16


def snapshots(spark: SparkSession, head: int, batch: int = BATCH) -> DataFrame:
    """(snap_id, marker) of each full batch and of the rest."""
    return spark.range(-(-head // batch)).select(F.col("id").alias("snap_id"), F.least((F.col("id") + 1) * batch, F.lit(head)).cast("long").alias("marker"))


def marker_of(snap_id: int, head: int, batch: int = BATCH) -> int:
    """The marker of a snapshot, or of the last one."""
    return min((snap_id + 1) * batch, head)


def archived(requests: DataFrame, every: int) -> DataFrame:
    """(at, marker) of markers asked for at some tick -> (tick, marker): each tick, of `every` units of time, archives up to the newest one asked for by then."""
    return requests.groupBy(F.floor(F.col("at") / every).cast("long").alias("tick")).agg(F.max("marker").alias("marker"))


@dataclass
class GraphView:
    """Edges lo <= eid < hi of a log, with the graph's kind.

    kind: directed, undirected, or unidirected (no in-side).
    meta: what an algorithm keeps with the view.
    """

    log: DataFrame
    vertices: DataFrame
    lo: int = 0
    hi: int | None = None
    kind: str = "directed"
    meta: dict = field(default_factory=dict)

    @property
    def raw(self) -> DataFrame:
        """The log's rows in range, deletes included."""
        out = self.log if not self.lo else self.log.where(F.col("eid") >= self.lo)
        return out if self.hi is None else out.where(F.col("eid") < self.hi)

    @property
    def edges(self) -> DataFrame:
        """Live edges, both ways for an undirected graph; a delete only cancels inserts in range."""
        live = live_edges(self.raw, self.kind != "undirected") if "op" in self.log.columns else self.raw
        return undirected(live) if self.kind == "undirected" else live

    @property
    def in_edges(self) -> DataFrame:
        if self.kind == "unidirected":
            raise ValueError("a unidirected graph has no in-edges")
        return self.edges if self.kind == "undirected" else reverse(self.edges)

    def at(self, marker: int) -> GraphView:
        """The same view at another marker."""
        return GraphView(self.log, self.vertices, self.lo, marker, self.kind, self.meta)

    def delta(self, lo: int, hi: int) -> GraphView:
        """Only what came in lo .. hi - 1: a stream's view of one refresh."""
        return GraphView(self.log, self.vertices, lo, hi, self.kind, self.meta)

    def window(self, size: int) -> GraphView:
        """The last `size` edges before the view's head."""
        head = self.head()
        return self.delta(max(0, head - size), head)

    def head(self) -> int:
        if self.hi is not None:
            return self.hi
        return head_of(self.log)

    def refreshed(self) -> GraphView:
        """The same view up to what the log holds now."""
        return self.at(head_of(self.log))

    def private(self, marker: int) -> GraphView:
        """This view with its own copy of what comes from the marker on (the tail that isn't archived yet), written once."""
        tail = stage(self.log.sparkSession, self.log.where(F.col("eid") >= marker), "tail")
        return GraphView(self.log.where(F.col("eid") < marker).unionByName(tail), self.vertices, self.lo, self.hi, self.kind, self.meta)

    def retained(self, size: int) -> GraphView:
        """A view that has given up all but the last `size` edges."""
        head = self.head()
        return GraphView(evict(self.log, max(0, head - size)), self.vertices, self.lo, head, self.kind, self.meta)

    @property
    def is_unidir(self) -> bool:
        return self.kind == "unidirected"

    def parts(self, by: str = "edge", n: int = 8) -> DataFrame:
        """Edges with the `part` that works on them: by `edge` even ranges of the offset, by `vertex` the source, by `chunk` of the archive batch."""
        head = max(self.head(), 1)
        rule = {"edge": F.floor(F.col("eid") * n / head), "vertex": F.pmod(F.col("src"), F.lit(n)), "chunk": F.floor(F.col("eid") / BATCH)}
        return self.edges.withColumn("part", rule[by].cast("int"))

    def cursor(self, vid: int, start: int = 0) -> Iterator[int]:
        """A vertex's neighbours from a place on, one at a time; the driver holds a partition of them."""
        own = self.edges.where(F.col("src") == vid).orderBy("eid").offset(start).select("dst")
        return (r["dst"] for r in own.toLocalIterator())

    def where(self, condition: Column) -> GraphView:
        """Only edges whose properties satisfy the condition."""
        return GraphView(self.log.where(condition), self.vertices, self.lo, self.hi, self.kind, self.meta)

    def degrees(self, side: str = "out") -> DataFrame:
        """(vid, degree) for every vertex."""
        e = self.edges if side == "out" else self.in_edges
        return self.vertices.join(e.groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("degree")), "vid", "left").select("vid", F.coalesce("degree", F.lit(0)).alias("degree"))

    def neighbours(self, seeds: DataFrame | list[int], side: str = "out") -> DataFrame:
        """(src, dst, eid) of the seeds (vid)."""
        e = self.edges if side == "out" else self.in_edges
        if isinstance(seeds, list):
            return e.where(F.col("src").isin(seeds)).select("src", "dst", "eid")
        return e.join(seeds.select(F.col("vid").alias("src")).distinct(), "src", "left_semi").select("src", "dst", "eid")

    def neighbours_slice(self, start: int, count: int) -> DataFrame:
        """Neighbours at places start .. start + count - 1 of each vertex's list."""
        n = F.row_number().over(W.partitionBy("src").orderBy("eid")) - 1
        return self.edges.withColumn("pos", n.cast("long")).where(F.col("pos").between(start, start + count - 1)).select("src", "pos", "dst")

    def changed(self, lo: int, hi: int) -> DataFrame:
        """(vid, before, after) of vertices whose out-degree differs between two markers."""
        if "op" not in self.log.columns and self.kind != "undirected":  # one pass over the log, only the delta's vertices
            e = self.at(hi).edges
            old = F.count(F.when(F.col("eid") < lo, 1))
            return e.groupBy(F.col("src").alias("vid")).agg(old.alias("before"), F.count("*").alias("after")).where("before <> after")
        a, b = self.at(lo).degrees().withColumnRenamed("degree", "before"), self.at(hi).degrees().withColumnRenamed("degree", "after")
        return a.join(b, "vid").where("before <> after")


def static_view(log: DataFrame, vertices: DataFrame, batch: int = BATCH, stale: bool = False, kind: str = "directed") -> GraphView:
    """The whole log, or with `stale` only what full batches have archived."""
    view = GraphView(log, vertices, kind=kind)
    head = view.head()
    return view.at(head // batch * batch if stale else head)
