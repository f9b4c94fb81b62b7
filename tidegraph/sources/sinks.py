"""Durable logs, snapshots' manifests, splits and exports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.encoders import encode
from tidegraph.operators.edges import adjacency, explode_adjacency, head_of


def write_log(log: DataFrame, path: str, lo: int, hi: int) -> None:
    """Append the slice lo .. hi - 1; files are sorted by offset so a range read prunes row groups."""
    log.where((F.col("eid") >= lo) & (F.col("eid") < hi)).repartitionByRange("eid").sortWithinPartitions("eid").write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, lo: int = 0, hi: int | None = None) -> DataFrame:
    out = spark.read.parquet(path).where(F.col("eid") >= lo)
    return out if hi is None else out.where(F.col("eid") < hi)


def write_snapshots(marks: DataFrame, path: str) -> None:
    marks.write.mode("overwrite").json(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("snap_id long, marker long").json(path)


def split(log: DataFrame, n: int, path: str) -> None:
    """n files by ranges of the offset."""
    log.repartitionByRange(n, "eid").sortWithinPartitions("eid").write.mode("overwrite").parquet(path)


def write_adjacency(edges: DataFrame, path: str, chunk: int = 1 << 16) -> None:
    """Neighbour lists in chunks, by source vertex."""
    adjacency(edges, chunk).repartition("src").sortWithinPartitions("src", "part").write.mode("overwrite").parquet(path)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of stored lists, whose order is the log's."""
    return explode_adjacency(spark.read.parquet(path)).select("src", "dst")


def write_dictionary(ids: DataFrame, path: str) -> None:
    """(tid, vid, name), a folder for each type."""
    ids.repartition("tid", F.floor(F.col("vid") / (1 << 20))).sortWithinPartitions("tid", "vid").write.mode("overwrite").partitionBy("tid").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vid long, name string, tid int").parquet(path).select("tid", "vid", "name")


def write_properties(values: DataFrame, path: str) -> None:
    """(sid, name, value), a folder for each property."""
    values.repartition("name", F.pmod(F.xxhash64("sid"), F.lit(64))).sortWithinPartitions("name", "sid").write.mode("overwrite").partitionBy("name").parquet(path)


def read_properties(spark: SparkSession, path: str, encoders: dict[str, str] | None = None) -> DataFrame:
    """(sid, name, value); with encoders (a property -> its encoder) one column for each of these instead."""
    d = spark.read.schema("sid long, value string, name string").parquet(path).select("sid", "name", "value")
    if encoders is None:
        return d
    return d.groupBy("sid").pivot("name", sorted(encoders)).agg(F.first("value")).select("sid", *(encode(encoders[p], F.col(p)).alias(p) for p in sorted(encoders)))


def replay(spark: SparkSession, path: str, step, batch: int = 1 << 16, lo: int = 0) -> None:
    """Read a stored log again, `batch` offsets at a time, and call step(edges, marker) for each; one after another, for few batches."""
    head = head_of(spark.read.parquet(path))
    while lo < head:
        hi = min(lo + batch, head)
        step(read_log(spark, path, lo, hi), hi)
        lo = hi


def replayed(spark: SparkSession, path: str, batch: int = 1 << 16, lo: int = 0) -> DataFrame:
    """All batches of replay() in one scan: the log's rows from lo on, each with the `marker` of its batch."""
    log = read_log(spark, path, lo)
    end = lo + (F.floor((F.col("eid") - lo) / batch) + 1) * batch
    return log.withColumn("marker", F.least(end, F.lit(head_of(log))).cast("long"))


def to_binary(edges: DataFrame) -> DataFrame:
    """(src, dst) -> (part, content): packed little-endian records of a task's edges, at most a million in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, k = [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + k]), pa.array([b"".join(held)], pa.binary())], ["part", "content"])

        for b in batches:
            both = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            held.append(both.astype("<u8").tobytes())
            if sum(map(len, held)) >= 16 << 20:
                yield row()
                held, k = [], k + 1
        if held:
            yield row()

    return edges.select("src", "dst").mapInArrow(run, "part long, content binary")


def compact(live: DataFrame, path: str) -> None:
    """Edges without tombstones, by source vertex."""
    live.repartition("src").sortWithinPartitions("src", "eid").write.mode("overwrite").parquet(path)


def export_adjacency(csr: DataFrame, edges: DataFrame, path: str) -> None:
    """Text `AdjacencyGraph`: vertices, edges, then offsets, then neighbours, in parts that sort by name."""
    n, m = csr.count(), edges.count()
    spark = csr.sparkSession
    spark.createDataFrame([("AdjacencyGraph",), (str(n),), (str(m),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/0-head")
    csr.repartitionByRange("vid").sortWithinPartitions("vid").select(F.col("start").cast("string")).write.mode("overwrite").text(f"{path}/1-offsets")
    edges.repartitionByRange("src", "eid").sortWithinPartitions("src", "eid").select(F.col("dst").cast("string")).write.mode("overwrite").text(f"{path}/2-neighbours")
