"""Breadth-first search, PageRank and components over any view, or over its edges (src, dst)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.operators.components import connected_components
from tidegraph.operators.edges import tiles, undirected
from tidegraph.operators.views import GraphView
from tidegraph.storage import stage


def edges_of(graph: DataFrame | GraphView) -> DataFrame:
    return graph.edges if isinstance(graph, GraphView) else graph


#: Rounds after which the pieces of a growing result are written as one.
COMPACT = 8
#: Vertices of a frontier that may be broadcast.
SMALL = 100_000


def bfs(edges: DataFrame | GraphView, root: int, first: int = 1, depth: int | None = None, target: int | None = None) -> DataFrame:
    """(vid, level) of what root reaches, over at most `depth` edges if that is given; the root's level is `first`.

    The frontier alone meets the edges in each round; the levels so far are only
    probed.  Each round is written to the shared folder.  With a target it ends at
    the target's level.
    """
    edges = edges_of(edges)
    spark = edges.sparkSession
    e = stage(spark, edges.select("src", "dst").where("src <> dst").distinct(), "bfs-edges")
    seen = frontier = spark.createDataFrame([(root, first)], "vid long, level int")
    level = first
    while depth is None or level < first + depth:
        level += 1
        reached = e.join(frontier.select(F.col("vid").alias("src")), "src").select(F.col("dst").alias("vid")).distinct()
        frontier = stage(spark, reached.join(seen, "vid", "left_anti").withColumn("level", F.lit(level)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if (level - first) % COMPACT == 0:
            seen = stage(spark, seen, "levels")
        if target is not None and not frontier.where(F.col("vid") == target).isEmpty():
            break
    return seen


def shortest_path(edges: DataFrame | GraphView, root: int, target: int) -> DataFrame:
    """(step, vid) of a shortest path from root (step 0) to target, of several the one of least predecessors; no rows if there is none."""
    edges = edges_of(edges)
    spark = edges.sparkSession
    levels = bfs(edges, root, first=0, target=target)
    at = levels.where(F.col("vid") == target).first()
    path = [(at["level"], target)] if at else []
    while path and path[-1][0]:
        step, vid = path[-1]
        before = levels.where(F.col("level") == step - 1).select(F.col("vid").alias("src"))
        path.append((step - 1, edges.where(F.col("dst") == vid).join(before, "src", "left_semi").agg(F.min("src")).first()[0]))
    return spark.createDataFrame(path, "step int, vid long")


def relax(levels: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Bring levels (vid, level) up to date after edges were added, from the changed vertices (vid) on.

    Only vertices that change or get a better level are followed, so a round
    costs what it touches and writes only that; right for insert-only logs.
    A frontier of more than `SMALL` vertices is shuffled, so what goes through the
    driver in a round is bounded.
    """
    spark = edges.sparkSession
    now = levels
    frontier = levels.join(changed.select("vid").distinct().hint("merge"), "vid", "left_semi")
    size, rounds = None, 0
    while True:
        told = F.broadcast(frontier) if size is not None and size <= SMALL else frontier.hint("merge")
        offer = edges.join(told, F.col("vid") == F.col("src")).groupBy(F.col("dst").alias("vid")).agg((F.min("level") + 1).alias("offer"))
        best = offer.join(now.hint("merge"), "vid", "left").groupBy("vid").agg(F.min("offer").alias("offer"), F.min("level").alias("level"))
        frontier = stage(spark, best.where(F.col("level").isNull() | (F.col("offer") < F.col("level"))).select("vid", F.col("offer").cast("int").alias("level")), "relax")
        size = frontier.count()
        if not size:
            return now.groupBy("vid").agg(F.min("level").alias("level")) if rounds else now
        rounds += 1
        now = now.unionByName(frontier)  # the least of a vertex's rows counts
        if rounds % COMPACT == 0:
            now = stage(spark, now.groupBy("vid").agg(F.min("level").alias("level")), "levels")


def bfs_tiles(edges: DataFrame | GraphView, root: int, bits: int = 16, first: int = 1) -> DataFrame:
    """(vid, level) by correcting labels over tiles of the vertex grid, both ways: only tiles with a changed source are looked at.

    In a round each live tile gives each of its destinations the best level.
    """
    edges = edges_of(edges)
    spark = edges.sparkSession
    e = stage(spark, tiles(undirected(edges.select("src", "dst")), bits).distinct(), "tiles")
    now = frontier = spark.createDataFrame([(root, first)], "vid long, level int")
    rounds = 0
    while True:
        own = frontier.select(F.col("vid").alias("src"), F.shiftright("vid", bits).alias("tile_i"), "level")
        offer = e.join(own, ["tile_i", "src"]).groupBy("tile_j", "dst").agg((F.min("level") + 1).alias("offer"))
        best = offer.join(now, F.col("vid") == F.col("dst"), "left").groupBy("dst").agg(F.min("offer").alias("offer"), F.min("level").alias("level"))
        frontier = stage(spark, best.where("level is null or offer < level").select(F.col("dst").alias("vid"), F.col("offer").cast("int").alias("level")), "relax")
        if frontier.isEmpty():
            return now.groupBy("vid").agg(F.min("level").alias("level"))
        rounds += 1
        now = now.unionByName(frontier)
        if rounds % COMPACT == 0:
            now = stage(spark, now.groupBy("vid").agg(F.min("level").alias("level")), "levels")


def pagerank(vertices: DataFrame, edges: DataFrame | GraphView, rounds: int = 5, push: bool = False) -> DataFrame:
    """(vid, rank), fixed rounds, not normalised: p0 = 0.15 where there are out-edges, then (0.15 + 0.85 S) / outdegree, undivided in the last round.

    Pull gathers by dst from stored in-edges, push scatters along out-edges;
    both are one shuffled sum per round over edges that are dealt once.
    """
    edges = edges_of(edges)
    spark = edges.sparkSession
    e = stage(spark, edges.groupBy("src", "dst").agg(F.count("*").alias("times")), "edges")
    out = e.groupBy(F.col("src").alias("vid")).agg(F.sum("times").alias("deg"))
    v = stage(spark, vertices.join(out, "vid", "left").select("vid", F.coalesce("deg", F.lit(0)).alias("deg")), "degrees")
    p = v.select("vid", "deg", F.when(F.col("deg") > 0, F.lit(0.15)).otherwise(F.lit(0.0)).alias("rank"))
    for k in range(1, rounds + 1):
        have = p.select(F.col("vid").alias("src"), "rank").where("rank > 0")
        sent = have.join(e, "src") if push else e.join(have, "src")
        got = sent.groupBy(F.col("dst").alias("vid")).agg(F.sum(F.col("rank") * F.col("times")).alias("s"))
        score = F.lit(0.15) + F.lit(0.85) * F.coalesce("s", F.lit(0.0))
        if k < rounds:
            score = F.when(F.col("deg") > 0, score / F.col("deg")).otherwise(F.lit(0.0))
        p = v.join(got, "vid", "left").select("vid", "deg", score.alias("rank"))
    return p.select("vid", "rank")


#: Most edges of a tile and vertices of a block of pagerank_to(), on average.
TILE, BLOCK = 1 << 22, 1 << 21
#: How far two rounds' rates of change in pagerank_to() may differ, relatively, before a leap.
STEADY = 1e-3


def pagerank_to(vertices: DataFrame, edges: DataFrame | GraphView, epsilon: float = 1e-8, start: DataFrame | None = None, block: int = 1) -> DataFrame:
    """(vid, rank) of the first round whose summed change over vertices with out-edges is at most epsilon; start: ranks of an earlier state.

    Vertices lie in blocks, edges once in tiles (block of the source, block of the
    destination) as places in these blocks.  A round sends each block's ranks to
    its row of tiles and each tile's sums to a block, as arrays of doubles without
    keys: 16 bytes for each vertex and block, of which there are as many as the
    root of edges over `TILE`.  The change is looked at after each round, whatever
    `block` says, so none is gone through twice.

    Where the change shrinks by a steady rate, as it does while vertices without
    out-edges lose rank, the ranks leap to where it leads.  A leap only
    gives the next round's start: what is returned is a whole round's outcome whose own
    change is at most epsilon, so its distance to the limit has the same bound.  A leap
    that doesn't help is the last.
    """
    edges = edges_of(edges).select("src", "dst")
    spark = edges.sparkSession
    e = stage(spark, edges.groupBy("src", "dst").agg(F.count("*").alias("times")), "edges")
    v = vertices.join(e.groupBy(F.col("src").alias("vid")).agg(F.sum("times").alias("deg")), "vid", "left")
    v = v if start is None else v.join(start.withColumnRenamed("rank", "r"), "vid", "left")
    n, m = max(vertices.count(), 1), e.count()
    side = max(1, math.ceil(math.sqrt(m / TILE)), -(-n // BLOCK))
    k = F.pmod(F.xxhash64("vid"), F.lit(side)).cast("int")
    first = F.lit(1.0 / n) if start is None else F.coalesce("r", F.lit(1.0 / n))
    v = v.select("vid", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"), first.cast("double").alias("rank"), k.alias("k"))
    v = stage(spark, v.withColumn("i", F.row_number().over(W.partitionBy("k").orderBy("vid")) - 1), "places")
    a, b = (v.select(F.col("vid").alias(c), F.col("k").alias(f"{x}k"), F.col("i").alias(f"{x}i")) for c, x in (("src", "s"), ("dst", "d")))
    placed = e.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").select("sk", "dk", "si", "di", "times")
    tiles_ = placed.repartition(side * side, "sk", "dk").groupBy("sk", "dk").applyInArrow(_tile, "sk int, dk int, tile binary").persist()
    p = stage(spark, v.groupBy("k").applyInArrow(_block, "k int, deg binary, rank binary, moved double"), "blocks")
    rows = F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("dk")
    last, rate, earlier, leapt, leaps = None, None, None, None, True
    try:
        while True:
            leap = bool(leaps and rate and earlier and rate < 0.99 and abs(rate - earlier) <= STEADY * rate and last * rate > epsilon)
            have = p.select(F.col("k").alias("sk"), rows, "deg", "rank")
            sums = tiles_.hint("merge").join(have, ["sk", "dk"]).select("sk", "dk", "tile", "deg", "rank").mapInArrow(_send, "k int, sk int, a binary, b binary")
            both = sums.unionByName(p.select("k", F.lit(-1).alias("sk"), F.col("deg").alias("a"), F.col("rank").alias("b")))
            receive = _receiver(n, rate / (1 - rate) if leap else 0.0)
            p = stage(spark, both.repartition(side, "k").groupBy("k").applyInArrow(receive, "k int, deg binary, rank binary, moved double"), "ranks")
            moved = p.agg(F.sum("moved")).first()[0] or 0.0
            if moved <= epsilon and not leap:
                ranks = p.select("k", "rank").mapInArrow(_unpacked, "k int, i int, rank double")
                return v.drop("rank").join(ranks, ["k", "i"]).select("vid", "rank")
            if last is not None and not leap and moved >= last and moved < 1e-12:
                raise ValueError(f"ranks in doubles don't settle to {epsilon}")
            if leapt is not None and moved >= leapt:  # no better than without
                leaps = False
            leapt = moved * rate if leap else None
            rate, earlier, last = (None, None, None) if leap else (moved / last if last else None, rate, moved)
    finally:
        tiles_.unpersist()


def _tile(rows: pa.Table) -> pa.Table:
    """Edges of a tile -> one row: how many, then places of sources, places of destinations and times."""
    si, di, times = (rows.column(c).to_numpy() for c in ("si", "di", "times"))
    order = np.lexsort((di, si))
    tile = np.int64(len(si)).tobytes() + si[order].astype("<i4").tobytes() + di[order].astype("<i4").tobytes() + (b"" if (times == 1).all() else times[order].astype("<f8").tobytes())
    return pa.table({"sk": rows.column("sk").slice(0, 1), "dk": rows.column("dk").slice(0, 1), "tile": pa.array([tile], pa.binary())})


def _block(rows: pa.Table) -> pa.Table:
    """Vertices of a block -> one row of arrays in order of their places."""
    order = np.argsort(rows.column("i").to_numpy())
    deg, rank = (rows.column(c).to_numpy()[order] for c in ("deg", "rank"))
    return pa.table({"k": rows.column("k").slice(0, 1), "deg": pa.array([deg.astype("<i8").tobytes()], pa.binary()), "rank": pa.array([rank.astype("<f8").tobytes()], pa.binary()), "moved": pa.array([0.0])})


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tile with its sources' ranks -> the sums for its destinations, as places and values or, where that is shorter, values alone."""
    for batch in batches:
        for sk, dk, tile, deg, rank in zip(*batch.columns, strict=True):
            tile, deg, rank = tile.as_buffer(), np.frombuffer(deg.as_buffer(), "<i8"), np.frombuffer(rank.as_buffer(), "<f8")
            m = int(np.frombuffer(tile, "<i8", 1)[0])
            si, di = np.frombuffer(tile, "<i4", m, 8), np.frombuffer(tile, "<i4", m, 8 + 4 * m)
            share = (rank / np.maximum(deg, 1))[si]
            if len(tile) > 8 + 8 * m:
                share = share * np.frombuffer(tile, "<f8", m, 8 + 8 * m)
            sums = np.bincount(di, share)
            at = np.flatnonzero(sums)
            a, b = (at.astype("<i4").tobytes(), sums[at].tobytes()) if 12 * len(at) < 8 * len(sums) else (b"", sums.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([dk.as_py()], pa.int32()), pa.array([sk.as_py()], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], ["k", "sk", "a", "b"])


def _receiver(n: int, leap: float):
    """Of a block its degrees and ranks (sk = -1) and all sums for it -> its new ranks, `leap` times the change beyond it, and how far those with out-edges moved in the round."""

    def receive(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("sk").to_numpy())  # always added in the same order
        a, b = rows.column("a"), rows.column("b")
        deg, old = np.frombuffer(a[int(order[0])].as_buffer(), "<i8"), np.frombuffer(b[int(order[0])].as_buffer(), "<f8")
        s = np.zeros(len(old))
        for j in map(int, order[1:]):
            at, sums = np.frombuffer(a[j].as_buffer(), "<i4"), np.frombuffer(b[j].as_buffer(), "<f8")
            if len(at):
                s[at] += sums
            else:
                s[: len(sums)] += sums
        rank = 0.15 / n + 0.85 * s
        moved = float(np.abs(rank - old)[deg > 0].sum())
        rank = np.maximum(rank + leap * (rank - old), 0.0) if leap else rank
        return pa.table({"k": rows.column("k").slice(0, 1), "deg": pa.array([deg.tobytes()], pa.binary()), "rank": pa.array([rank.tobytes()], pa.binary()), "moved": pa.array([moved])})

    return receive


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, rank in zip(*batch.columns, strict=True):
            rank = np.frombuffer(rank.as_buffer(), "<f8")
            for lo in range(0, len(rank), 1 << 16):
                x = rank[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k.as_py(), np.int32)), pa.array(np.arange(lo, lo + len(x), dtype=np.int32)), pa.array(x)], ["k", "i", "rank"])


def wcc(edges: DataFrame | GraphView) -> DataFrame:
    """(vid, component), component = least vertex; self-loops don't count, vertices without other edges have none."""
    return connected_components(edges_of(edges).select(F.col("src").alias("u"), F.col("dst").alias("v"))).select(F.col("vertex").alias("vid"), "component")
