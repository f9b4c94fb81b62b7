"""Continuous runs over a log that arrives in files, a micro-batch for each file or few.

State is versioned by batch id beside the log, in the shared folder: a batch that
is run again after a failure, or by another driver after a restart, starts from the
version before it and gives the same version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegraph.operators.algorithms import pagerank_to, relax
from tidegraph.operators.components import connected_components
from tidegraph.operators.edges import head_of
from tidegraph.storage import folder, shared_dir, stage

#: fn(new edges, all edges so far, state or None) -> state
Step = Callable[[DataFrame, DataFrame, "DataFrame | None"], DataFrame]


def append(log: DataFrame, path: str, lo: int, hi: int, files: int = 1) -> None:
    """Add rows lo .. hi - 1 to the folder that streams read, as `files` files by ranges of the offset, written in order."""
    for k in range(files):
        a, b = lo + (hi - lo) * k // files, lo + (hi - lo) * (k + 1) // files
        log.where((F.col("eid") >= a) & (F.col("eid") < b)).coalesce(1).write.mode("append").parquet(path)


#: Rows of a file of a fed log: a batch is many files at size, so that many tasks write and read it.
FILE_ROWS = 1 << 18


def feed(log: DataFrame, batches: int) -> tuple[str, int]:
    """Write the log as `batches` ranges of the offset, in order, to a folder that lasts as long as the session; returns it and the files of a range."""
    spark = log.sparkSession
    path = f"{shared_dir(spark)}/tidegraph-feed-{uuid.uuid4().hex}"
    head = head_of(log)
    files = max(1, -(-head // (batches * FILE_ROWS)))
    for k in range(batches):
        part = log.where((F.col("eid") >= head * k // batches) & (F.col("eid") < head * (k + 1) // batches))
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    for place in (path, f"{path}-state", f"{path}-at"):
        folder(spark, place, leave=False)
    return path, files


class StreamView:
    """A view with state that follows the log in a folder.

    `name` tells several views of one log apart; each has its own checkpoint and
    its own state, so they run side by side, and one can be stopped for good with
    unregister().
    """

    def __init__(self, spark: SparkSession, path: str, schema, step: Step, name: str = "view", files: int = 1, every: str | None = None):
        self.spark, self.path, self.schema, self.step, self.name, self.files, self.every = spark, path, schema, step, name, files, every
        self.query: StreamingQuery | None = None

    def _version(self, batch_id: int) -> str:
        return f"{self.path}-state/{self.name}/{batch_id}"

    def _known(self, batch_id: int) -> tuple[DataFrame | None, int]:
        """The state after a batch and how far into the log it goes."""
        if batch_id < 0:
            return None, 0
        mark = self.spark.read.schema("head long").json(f"{self._version(batch_id)}/mark").first()["head"]
        return self.spark.read.parquet(f"{self._version(batch_id)}/state"), mark

    def _advance(self, batch: DataFrame, batch_id: int) -> None:
        state, mark = self._known(batch_id - 1)
        new = stage(self.spark, batch, "batch")
        head = max(mark, head_of(new))
        so_far = self.spark.read.schema(self.schema).parquet(self.path).where(F.col("eid") < head)
        self.step(new, so_far, state).write.mode("overwrite").parquet(f"{self._version(batch_id)}/state")
        self.spark.createDataFrame([(head,)], "head long").coalesce(1).write.mode("overwrite").json(f"{self._version(batch_id)}/mark")
        if batch_id >= 2:  # the version before is kept for a batch that is run again
            folder(self.spark, self._version(batch_id - 2), leave=False, now=True)

    def start(self) -> StreamingQuery:
        """Follow the log: all there is now, or with `every` (an interval) until it is stopped."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(self.path)
        writer = stream.writeStream.foreachBatch(self._advance).option("checkpointLocation", f"{self.path}-at/{self.name}")
        self.query = (writer.trigger(processingTime=self.every) if self.every else writer.trigger(availableNow=True)).start()
        return self.query

    def wait(self) -> StreamView:
        """Until what is there has been read."""
        if self.every:
            self.query.processAllAvailable()
        else:
            self.query.awaitTermination()
        if self.query.exception():
            raise self.query.exception()
        return self

    def state(self) -> DataFrame | None:
        """The newest whole version, whichever driver wrote it; None before the first."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}-state/{self.name}/*/mark/_SUCCESS")
        found = place.getFileSystem(conf).globStatus(place) or []
        ids = [int(f.getPath().getParent().getParent().getName()) for f in found]
        return self._known(max(ids))[0] if ids else None

    def unregister(self) -> None:
        """Stop, and give up checkpoint and state."""
        if self.query is not None:
            self.query.stop()
        for place in (f"{self.path}-state/{self.name}", f"{self.path}-at/{self.name}"):
            folder(self.spark, place, leave=False, now=True)


class Stateful:
    """A stream view over a log that is cut into files first."""

    def __init__(self, log: DataFrame, step: Step, batches: int = 3):
        self.log, self.step, self.batches = log, step, batches

    def result(self) -> DataFrame:
        return concurrent(self.log, {"view": self.step}, self.batches)["view"]


def concurrent(log: DataFrame, steps: dict[str, Step], batches: int = 3) -> dict[str, DataFrame]:
    """Several views that follow one log side by side -> their final states."""
    spark = log.sparkSession
    path, files = feed(log, batches)
    views = {name: StreamView(spark, path, log.schema, step, name, files) for name, step in steps.items()}
    for v in views.values():
        v.start()
    return {name: v.wait().state() for name, v in views.items()}


def bfs_step(root: int, first: int = 0):
    """Relax levels from the ends of new edges that are reached already."""

    def step(new: DataFrame, edges: DataFrame, state: DataFrame | None) -> DataFrame:
        spark = new.sparkSession
        state = spark.createDataFrame([(root, first)], "vid long, level int") if state is None else state
        return relax(state, edges.select("src", "dst"), new.select(F.col("src").alias("vid")))

    return step


def wcc_step(new: DataFrame, edges: DataFrame, state: DataFrame | None) -> DataFrame:
    """Join components that new edges connect: components of the graph of labels, not of all edges."""
    ends = new.where("src <> dst").select("src", "dst")
    if state is None:
        return connected_components(ends.toDF("u", "v")).toDF("vid", "component")
    label = state.withColumnsRenamed({"vid": "x", "component": "l"})
    named = ends.join(label.toDF("src", "ls"), "src", "left").join(label.toDF("dst", "ld"), "dst", "left")
    links = named.select(F.coalesce("ls", "src").alias("u"), F.coalesce("ld", "dst").alias("v"))
    merged = connected_components(links).toDF("old", "component")
    known = state.union(ends.select(F.col("src").alias("vid"), F.col("src")).union(ends.select("dst", "dst")).distinct().join(state.select("vid"), "vid", "left_anti"))
    return known.toDF("vid", "old").join(merged, "old", "left").select("vid", F.coalesce("component", "old").alias("component"))


def pagerank_step(vertices: DataFrame, epsilon: float = 1e-8):
    """Warm start from the ranks of the state before."""

    def step(new: DataFrame, edges: DataFrame, state: DataFrame | None) -> DataFrame:
        return pagerank_to(vertices, edges, epsilon, start=state)

    return step


def flow_step(new: DataFrame, edges: DataFrame, state: DataFrame | None) -> DataFrame:
    """Sums per source, added to those so far."""
    sums = ["flows", "value", "packets", "bytes"]
    now = new.groupBy("src").agg(F.count("*").alias("flows"), *(F.sum(c).alias(c) for c in sums[1:]))
    return now if state is None else state.unionByName(now).groupBy("src").agg(*(F.sum(c).alias(c) for c in sums))


def degree_step(new: DataFrame, edges: DataFrame, state: DataFrame | None) -> DataFrame:
    """Out-degrees, added to those so far."""
    now = new.groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("degree"))
    return now if state is None else state.unionByName(now).groupBy("vid").agg(F.sum("degree").alias("degree"))


def windowed(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Event-time windows on a streaming or batch frame with ts: (src, start, n, total)."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy("src", F.window("ts", length)).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("src", F.col("window.start").alias("start"), "n", "total")
