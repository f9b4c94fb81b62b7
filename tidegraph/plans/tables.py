"""The driver tables as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Loads by name; graphs as FIXTURES.md defines them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, **frames) -> DataFrame:
        return self.spark.sql(text, **frames)

    def vertices(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("vid"))

    def log(self) -> DataFrame:
        """G_ord: an edge per order; o_orderkey is the offset."""
        n = self.customer.count()
        return self.orders.select(F.col("o_orderkey").alias("eid"), F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7919 + 13) % n).alias("dst"), F.col("o_totalprice").alias("weight"), F.col("o_orderdate").alias("ts"))

    def del_log(self) -> DataFrame:
        """Two in three rows insert, every third deletes, on few pairs, so that deletes meet stacks, gaps and empty pairs."""
        k = F.col("o_orderkey")
        return self.orders.select(k.alias("eid"), F.when(k % 3 == 2, -1).otherwise(1).alias("op"), (F.col("o_custkey") % 97).alias("src"), (k * 31 % 11).alias("dst"), F.col("o_totalprice").alias("weight"))

    def head(self) -> int:
        return self.orders.count()

    def knows(self) -> DataFrame:
        """Friends: both ends of an order's edge, each pair once each way, no self-loops."""
        e = self.log().select("src", "dst").where("src <> dst")
        return e.union(e.select("dst", "src")).distinct()

    def bought(self) -> DataFrame:
        """Customer -> supplier and part through the lines of their orders."""
        return self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))


#: The same graphs in SQL, for the oracles.
E_SQL = "e as (select o_orderkey as eid, o_custkey as src, (o_orderkey * 7919 + 13) % (select count(*) from customer) as dst, o_totalprice as weight, o_orderdate as ts from orders)"
D_SQL = "d as (select o_orderkey as eid, case when o_orderkey % 3 = 2 then -1 else 1 end as op, o_custkey % 97 as src, o_orderkey * 31 % 11 as dst, o_totalprice as weight from orders)"
N_SQL = "n as (select count(*) as head from orders)"
K_SQL = E_SQL + ", k as (select src, dst from e where src <> dst union select dst, src from e where src <> dst)"
