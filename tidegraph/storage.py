"""Tables written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session is local and names no folder of its own, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/tidegraph"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def folder(spark: SparkSession, path: str, leave: bool = True, now: bool = False) -> bool:
    """Whether a folder is there; unless it is to be left, it goes when the session ends, or now."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(sc.hadoopConfiguration())
    if now:
        files.delete(place, True)
    elif not leave:
        files.deleteOnExit(place)
    return files.exists(place)


def stage(spark: SparkSession, df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; the files go when the session ends.

    tidy: let go of what led here, so that its shuffle files are deleted now and
    not when the driver next happens to collect garbage.
    """
    path = f"{shared_dir(spark)}/tidegraph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder(spark, path, leave=False)
    schema = df.schema
    if tidy:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)
