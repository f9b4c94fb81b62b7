"""Minimum-cost-flow resharding.

Old shards and their sizes, new shards and their capacities: a transportation
problem in which a byte that stays costs nothing and a byte that moves costs
one.  Its solution is how many bytes go from each old shard to each new one.
The rows of an old shard, in a fixed order, are then cut at the flow's prefix
sums, so only the flow's bytes move, and only files of shards that gain or lose
rows have to be rewritten.

Law `bytes`: shard sizes are near equal.  The unit that moves is a group of
equal texts of all old shards, unless the group is larger than `split_share` of
a shard; such groups are cut into units by a salt.  A unit counts as a whole to
the old shard with most of its bytes and gets one new shard, so the flow is over
units' bytes.  Sizes are thus equal to within a unit.

Rows never meet in one task: a shard's order is by a hash cut into even ranges,
offsets of the ranges come from their sums.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.storage import stage

SHARDS = 8


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Least-cost flow[i][j] from supplies to demands of the same total: successive shortest paths with potentials."""
    n, m = len(supply), len(demand)
    if sum(supply) != sum(demand):
        raise ValueError("supplies and demands differ")
    flow = [[0] * m for _ in range(n)]
    have, want = list(supply), list(demand)
    pot = [0] * (n + m)
    while any(have):
        dist = [0 if have[i] else None for i in range(n)] + [None] * m
        prev: list[int | None] = [None] * (n + m)
        heap = [(0, i) for i in range(n) if have[i]]
        done = set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            steps = [(n + j, cost[x][j]) for j in range(m)] if x < n else [(i, -cost[i][x - n]) for i in range(n) if flow[i][x - n]]
            for y, c in steps:
                w = d + c + pot[x] - pot[y]
                if dist[y] is None or w < dist[y]:
                    dist[y], prev[y] = w, x
                    heapq.heappush(heap, (w, y))
        end = min((j for j in range(m) if want[j] and dist[n + j] is not None), key=lambda j: (dist[n + j] + pot[n + j], j))
        far = dist[n + end]
        for x in range(n + m):
            pot[x] += min(dist[x], far) if dist[x] is not None else far
        path, x = [], n + end
        while prev[x] is not None:
            path.append((prev[x], x))
            x = prev[x]
        amount = min(have[x], want[end], *(flow[b][a - n] for a, b in path if a >= n), float("inf"))
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        have[x] -= amount
        want[end] -= amount
    return flow


def plan(old: dict[int, int], shards: int = SHARDS) -> list[tuple[int, int, int, int]]:
    """Sizes of old shards -> (old shard, first byte, end byte, new shard): what stays comes first."""
    ids, total = sorted(old), sum(old.values())
    capacity = [total // shards + (k < total % shards) for k in range(shards)]
    flow = min_cost_flow([old[i] for i in ids], capacity, [[int(i != k) for k in range(shards)] for i in ids])
    cuts = []
    for i, row in zip(ids, flow, strict=True):
        at = 0
        for k in sorted(range(shards), key=lambda k: (k != i, k)):
            if row[k]:
                cuts.append((i, at, at + row[k], k))
                at += row[k]
    return cuts


def _prefixed(d: DataFrame, shard: str, order: list[str], size: Column, total: str, buckets: int) -> DataFrame:
    """`total`: sum of `size` over the rows of the shard that come before; `order` starts with a column of even hash values in [0, 2**32)."""
    d = d.withColumn("_b", F.floor(F.col(order[0]) * buckets / F.lit(1 << 32)).cast("int")).withColumn("_s", size)
    sums = d.groupBy(shard, "_b").agg(F.sum("_s").alias("_n"))
    ahead = W.partitionBy(shard).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col(shard).alias("_k"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inner = W.partitionBy(shard, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_s").over(inner), F.lit(0)))
    return d.join(starts, (F.col(shard) == F.col("_k")) & (F.col("_b") == F.col("_c"))).withColumn(total, F.col("_start") + F.col("_in")).drop("_b", "_s", "_k", "_c", "_start", "_in")


def old_layout(d: DataFrame, shards: int = SHARDS) -> Column:
    """The layout to start from where a table has none: by hash of the source, so a hot source makes a hot shard."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(shards)).cast("int")


def _placed(docs: DataFrame, old_shard: Column | None, shards: int, split_share: float, buckets: int, keep: list[Column], staged: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of docs with `keep`, size, h, old_shard and unit; and the units' new shards (u, shard).

    staged: these rows are written once, so that the texts are read once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.xxhash64(text).alias("h"), (old_shard if old_shard is not None else old_layout(docs, shards)).alias("old_shard"), *keep)
    if staged:
        d = stage(docs.sparkSession, d, "rows")
    groups = d.groupBy("h", "size").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    share = max(1, int(total * split_share / shards))
    wide = groups.where(F.col("bytes") > share).select(F.col("h").alias("g_h"), F.col("size").alias("g_size"), F.ceil(F.col("bytes") / share).cast("int").alias("cuts"))
    # groups over a share number at most shards / split_share, 400, whatever the input
    d = d.join(F.broadcast(wide), (F.col("h") == F.col("g_h")) & (F.col("size") == F.col("g_size")), "left")
    salt = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("cuts")))
    d = d.withColumn("unit", F.xxhash64("h", "size", salt)).drop("g_h", "g_size", "cuts")
    parts = d.groupBy("unit", "old_shard").agg(F.sum("size").alias("bytes"))
    most = F.max(F.struct("bytes", (-F.col("old_shard")).alias("less")))
    units = parts.groupBy("unit").agg(F.sum("bytes").alias("bytes"), (-most["less"]).alias("home"))
    units = stage(docs.sparkSession, units, "units")
    # at most `shards` rows come to the driver, the sizes of the old shards
    old = {r["home"]: int(r["bytes"]) for r in units.groupBy("home").agg(F.sum("bytes").alias("bytes")).collect()}
    units = _prefixed(units.withColumn("place", F.pmod(F.xxhash64("unit"), F.lit(1 << 32))), "home", ["place", "unit"], F.col("bytes"), "start", buckets)
    middle = F.col("start") + F.floor(F.col("bytes") / 2)
    to = F.lit(None).cast("int")
    for i, lo, hi, k in plan(old, shards):  # a cut for each pair of shards with a flow
        to = F.when((F.col("home") == i) & (middle >= lo) & (middle < hi), F.lit(k)).otherwise(to)
    return d, units.select(F.col("unit").alias("u"), to.cast("int").alias("shard"))


def reshard(docs: DataFrame, old_shard: Column | None = None, shards: int = SHARDS, split_share: float = 0.02, buckets: int = 512) -> DataFrame:
    """(doc_id, text, source) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard).

    size: UTF-8 bytes of the text (null: none) plus 1.  Null doc_ids and repeated
    rows are rows like others: each gets a slot of its own.  An empty table gives
    no rows.  Slots are gapless from 0 in each shard.  Extra columns of docs are
    not used.
    """
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("text_crc32")
    d, moves = _placed(docs, old_shard, shards, split_share, buckets, [crc], True)
    d = d.join(moves, F.col("unit") == F.col("u")).drop("u")
    d = d.withColumn("place", F.pmod(F.xxhash64("doc_id", "h", F.lit(11)), F.lit(1 << 32)))
    d = _prefixed(d, "shard", ["place", "doc_id", "h", "size"], F.lit(1), "slot", buckets)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def rewrite(docs: DataFrame, path: str, old_shard: Column | None = None, shards: int = SHARDS, split_share: float = 0.02, buckets: int = 512, rows_a_file: int = 1_000_000) -> list[int]:
    """Write the rows of shards that change to path/shard=k, as reshard() places them; returns these shards.

    Shards whose rows all stay are left alone.  Every row is written once, null
    and repeated doc_ids included, with the columns it had.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    d, moves = _placed(docs, old_shard, shards, split_share, buckets, [row], False)
    whence = d.select("unit", "old_shard").distinct().join(moves, F.col("unit") == F.col("u"))
    went = whence.where("shard <> old_shard").select("shard", "old_shard").distinct().collect()  # at most a row for each pair of shards
    changed = sorted({k for r in went for k in r})
    rows = d.join(moves.where(F.col("shard").isin(changed)), F.col("unit") == F.col("u"))
    out = rows.select("shard", "_row.*") if "shard" not in docs.columns else rows.select("shard", F.col("_row").dropFields("shard").alias("_row")).select("shard", "_row.*")
    parts = max(1, -(-docs.count() // rows_a_file // shards))
    out.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).repartition("shard", "_part").drop("_part").write.mode("overwrite").partitionBy("shard").parquet(path)
    return changed
