"""Exact top-k by tiled matrix products.

Vectors are packed into blocks of at most `block` rows; a tile is a block of
queries against a block of candidates.  A task reads a slice of the candidate
blocks beside some blocks of queries from the shared folder, so no tile is ever
shuffled.  It keeps each query's k best so far, and of a tile's products only
those that reach the k-th are looked at.  The lists of a query, one a slice,
are merged in a tree of `fan`-way merges, so no task ever holds more than fan
lists of a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.storage import stage

#: Below these a float32 or float64 holds each integer, so a product of integers is exact, and an int64 has room to spare.
EXACT = ((1 << 24, np.float32), (1 << 53, np.float64), (1 << 62, np.int64))
#: A block holds at most so many components.
CELLS = 1 << 20
#: About so many tasks at most score tiles, whatever the size of the input.
TASKS = 2048

_BLOCK = "width int, item int, ids binary, data binary"


def quantize(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, v): floor(scale * x) per component, x as double.

    Vectors that are null or hold a null or a component that isn't finite are
    left out, as are rows whose vec_id is null.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    ok = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(vec_id, v) -> blocks of rows of one width from within a partition: (width, bytes a component, ids, data)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(width: int, least: int) -> Iterator[pa.RecordBatch]:
            """Whole blocks while at least so many rows are held."""
            ids, data = (np.concatenate(x) for x in zip(*held.pop(width), strict=True))
            n = max(1, min(block, CELLS // max(1, width)))
            at = 0
            while len(ids) - at >= max(1, min(least, n)):
                own = data[at : at + n]
                low, high = int(own.min(initial=0)), int(own.max(initial=0))
                item = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([width], pa.int32()), pa.array([np.dtype(item).itemsize], pa.int32()), pa.array([ids[at : at + n].tobytes()], pa.binary()), pa.array([own.astype(item).tobytes()], pa.binary())],
                    ["width", "item", "ids", "data"],
                )
                at += n
            if at < len(ids):
                held[width] = [(ids[at:], data[at:])]

        for batch in batches:
            ids, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            starts, widths = v.offsets.to_numpy()[:-1], np.diff(v.offsets.to_numpy())
            flat = v.values.to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                pick = widths == width
                held.setdefault(width, []).append((ids[pick], flat[starts[pick][:, None] + np.arange(width)[None, :]]))
                yield from out(width, block)
            if sum(len(p[0]) * (w + 1) for w, parts in held.items() for p in parts) > 8 * CELLS:  # many widths, a few rows of each
                for width in list(held):
                    yield from out(width, 1)
        for width in list(held):
            yield from out(width, 1)

    return rows.select("vec_id", "v").mapInArrow(pack, _BLOCK)


class _Best:
    """The k best candidates so far of each query of a block: highest score, then least id; candidates with the query's id don't count."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.k, self.most = q_ids, k, _most(q)
        self.n = np.zeros(len(q_ids), np.int64)
        self.ids, self.scores = np.zeros((len(q_ids), k), np.int64), np.zeros((len(q_ids), k), np.int64)

    def add(self, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, strip: int = 256) -> None:
        """Take in a block of candidates, which come by ascending id."""
        top = self.most * _most(c) * q.shape[1]
        kind = next((t for most, t in EXACT if top < most), object)
        right = c.astype(kind).T
        first, last = np.searchsorted(c_ids, self.q_ids), np.searchsorted(c_ids, self.q_ids, side="right")
        for at in range(0, len(q), strip):
            own = slice(at, at + strip)
            s = q[own].astype(kind) @ right
            hits = self._few(s, first[own], last[own]) if kind is object else self._reaching(s, own, first[own], last[own], c_ids)
            if len(hits[0]):
                self._merge(hits[0] + at, c_ids[hits[1]], hits[2])

    def _few(self, s: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's k best, for scores beyond 62 bits."""
        found = []
        for i in range(len(s)):
            found += [(i, j, int(s[i, j])) for j in sorted((j for j in range(s.shape[1]) if not first[i] <= j < last[i]), key=lambda j: (-s[i, j], j))[: self.k]]
        return tuple(np.array([f[x] for f in found], np.int64) for x in range(3))

    def _reaching(self, s: np.ndarray, own: slice, first: np.ndarray, last: np.ndarray, c_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scores that may be among the k best, by query and candidate."""
        low = np.iinfo(s.dtype).min if s.dtype.kind == "i" else s.dtype.type(-np.inf)
        for i in np.flatnonzero(last > first):
            s[i, first[i] : last[i]] = low
        full = self.n[own] == self.k
        edge = np.where(full, self.scores[own, -1].astype(s.dtype), low)  # rounding keeps the order, and whatever is rounded is beyond all of s
        parts = 8 * self.k
        if not full.all() and s.shape[1] > parts:
            # k parts of the row have a score that reaches the k-th highest of the parts' highest scores
            highest = np.maximum.reduceat(s[~full], np.arange(parts) * s.shape[1] // parts, axis=1)
            edge[~full] = np.partition(highest, parts - self.k, axis=1)[:, parts - self.k]
        i, j = np.divmod(np.flatnonzero((s >= edge[:, None]).reshape(-1)), s.shape[1])
        got = s[i, j]
        good = (got > low) & (~full[i] | (got > edge[i]) | (c_ids[j] < self.ids[own, -1][i]))
        return i[good], j[good], got[good].astype(np.int64)

    def _merge(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates beside those held: the k best stay."""
        rows = np.unique(row)
        i, j = np.nonzero(np.arange(self.k)[None, :] < self.n[rows][:, None])
        row, ids, scores = np.concatenate([row, rows[i]]), np.concatenate([ids, self.ids[rows[i], j]]), np.concatenate([scores, self.scores[rows[i], j]])
        order = np.lexsort((ids, ~scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        sizes = np.diff(begin, append=len(row))
        place = np.arange(len(row)) - np.repeat(begin, sizes)
        good = place < self.k
        self.ids[row[good], place[good]], self.scores[row[good], place[good]] = ids[good], scores[good]
        self.n[rows] = np.minimum(sizes, self.k)

    def lists(self, node: int) -> Iterator[pa.RecordBatch]:
        held = np.arange(self.k)[None, :] < self.n[:, None]
        hits = pa.StructArray.from_arrays([pa.array(self.scores[held]), pa.array(self.ids[held])], ["score", "vec_id"])
        best = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.n)]), pa.int32()), hits)
        yield pa.RecordBatch.from_arrays([pa.array(self.q_ids), pa.array(np.full(len(self.q_ids), node, np.int32)), best], ["query_id", "node", "best"])


def _most(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _read(ids: bytes, data: bytes, width: int, item: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's ids, ascending, and its vectors."""
    i = np.frombuffer(ids, np.int64)
    order = np.argsort(i, kind="stable")
    return i[order], np.frombuffer(data, f"i{item}").reshape(len(i), width)[order]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = 8192, scale: int = 256, fan: int = 16) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score), ranks from 1, of the k highest integer inner products.

    A query's own row (rows with its vec_id) is no candidate; ties go to the
    smaller vec_id; all candidates come if there are fewer than k.  Vectors of
    another length are never compared.  A query_id that stands in two rows is
    two queries of one id: their lists are merged, the best k stay.  Scores
    beyond 64 bits raise an error.
    """
    spark = vectors.sparkSession
    rows = stage(spark, quantize(vectors, scale), "vectors")
    asked = rows.where(is_query)
    corpus = stage(spark, _blocks(rows, block), "blocks")
    q_blocks = max(1, -(-asked.count() // block))
    queries = stage(spark, _blocks(asked.repartition(q_blocks), block), "queries")
    slices = max(1, min(corpus.count(), -(-TASKS // q_blocks)))
    # each slice of candidates meets each part of the queries where both are read; neither is shuffled, broadcast or written once more
    left = corpus.coalesce(slices).select(F.spark_partition_id().alias("node"), F.monotonically_increasing_id().alias("c_no"), "width", *(F.col(x).alias(f"c_{x}") for x in ("item", "ids", "data")))
    right = queries.select(F.monotonically_increasing_id().alias("q_no"), "width", *(F.col(x).alias(f"q_{x}") for x in ("item", "ids", "data")))
    tiles = left.hint("shuffle_replicate_nl").join(right, "width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Best] = {}
        node, at, block_at = 0, None, None
        for b in batches:
            for r in range(b.num_rows):
                node, c_no, width, c_item, q_no, q_item = (b.column(x)[r].as_py() for x in ("node", "c_no", "width", "c_item", "q_no", "q_item"))
                if c_no != at:  # a candidate block's tiles come one after another
                    at, block_at = c_no, _read(b.column("c_ids")[r].as_py(), b.column("c_data")[r].as_py(), width, c_item)
                q_ids, q = _read(b.column("q_ids")[r].as_py(), b.column("q_data")[r].as_py(), width, q_item)
                if q_no not in held:
                    held[q_no] = _Best(q_ids, q, k)
                held[q_no].add(q, *block_at)
        for best in held.values():
            yield from best.lists(node)

    lists = tiles.select("node", "c_no", "width", "c_item", "c_ids", "c_data", "q_no", "q_item", "q_ids", "q_data").mapInArrow(run, "query_id long, node int, best array<struct<score: bigint, vec_id: bigint>>")
    high = lambda a: F.slice(F.array_sort(a, lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["vec_id"] < y["vec_id"], -1).when(x["vec_id"] > y["vec_id"], 1).otherwise(0)), 1, k)
    rest = slices
    while True:
        lists = lists.groupBy("query_id", F.floor(F.col("node") / fan).cast("int").alias("node")).agg(high(F.flatten(F.collect_list("best"))).alias("best"))
        rest = -(-rest // fan)
        if rest <= 1:
            break
    return lists.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
