"""Hops, and graph patterns as chains of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hop(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, vid) -> (root, vid) one edge on; paths are kept as a bag."""
    return frontier.join(edges.select(F.col("src").alias("vid"), F.col("dst").alias("nxt")), "vid").select("root", F.col("nxt").alias("vid"))


def hops(seeds: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    now = seeds.select(F.col("vid").alias("root"), "vid")
    for _ in range(n):
        now = hop(now, edges)
    return now


def hop2_totals(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, paths, total): two-hop paths of each seed (vid) and the sum of their ends, without building the paths: ends are summed per middle vertex first."""
    out = edges.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("n"), F.sum("dst").alias("s"))
    first = edges.join(seeds.select(F.col("vid").alias("src")).distinct(), "src", "left_semi").groupBy(F.col("src").alias("root"), F.col("dst").alias("mid")).agg(F.count("*").alias("times"))
    return first.join(out, "mid").groupBy("root").agg(F.sum(F.col("times") * F.col("n")).alias("paths"), F.sum(F.col("times") * F.col("s")).alias("total"))


def seeds(vertices: DataFrame, edges: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """The `n` vertices with out-edges that come first by a fixed mixing of their ids: as good as random, the same in each run."""
    mixed = (F.col("vid") * 7919 + salt) % 1000003
    return vertices.join(edges.select(F.col("src").alias("vid")), "vid", "left_semi").orderBy(mixed, "vid").limit(n)


def transform(bound: DataFrame, edges: DataFrame, down: bool = True) -> DataFrame:
    """A triple pattern with one end bound: (vid) -> distinct (vid) at the other end.

    down: bound vertices are subjects; up: they are objects and the edge side is
    probed.  Join order is left to the optimizer.
    """
    a, b = ("src", "dst") if down else ("dst", "src")
    return edges.join(bound.select(F.col("vid").alias(a)).distinct(), a, "left_semi").select(F.col(b).alias("vid")).distinct()


def extend(bound: DataFrame, on: str, edges: DataFrame, name: str, down: bool = True) -> DataFrame:
    """A triple pattern that keeps what is bound and adds a column for the other end."""
    a, b = ("src", "dst") if down else ("dst", "src")
    return bound.join(edges.select(F.col(a).alias(on), F.col(b).alias(name)), on)


class Pattern:
    """A basic graph pattern: Pattern(catalog).triple('?x', 'knows', '?y').triple('?y', 'lives', 7).select('?x')."""

    def __init__(self, relations: dict[str, DataFrame]):
        self.relations, self.rows = relations, None

    def triple(self, subject, predicate: str, obj) -> Pattern:
        e = self.relations[predicate].select("src", "dst")
        names = []
        for side, term in (("src", subject), ("dst", obj)):
            if isinstance(term, str) and term.startswith("?"):
                e = e.withColumnRenamed(side, term[1:])
                names.append(term[1:])
            else:
                e = e.where(F.col(side) == term).drop(side)
        shared = [n for n in names if self.rows is not None and n in self.rows.columns]
        if self.rows is None:
            self.rows = e
        elif shared:
            self.rows = self.rows.join(e, shared)
        else:
            raise ValueError(f"{subject} {predicate} {obj} shares no variable with the pattern so far")
        return self

    def select(self, *variables: str) -> DataFrame:
        return self.rows.select(*(v[1:] for v in variables)).distinct()
