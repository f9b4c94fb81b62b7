"""SimHash near-duplicates under a generalised pigeonhole principle.

A document's fingerprint has one bit for each bit of its shingles' hashes, set
where over half the hashes (repeats included) have it.  Two fingerprints link
where they differ in at most `max_distance` bits.

Search: the bits are grouped so that correlated bits share a partition; each
partition i gets its own threshold t_i (-1: not probed) by dynamic programming
over candidate counts taken from all fingerprints; sum(t_i + 1) > max_distance,
so two fingerprints that link differ by at most t_i bits in some partition i.
Keys of all fingerprints within t_i of a partition's value meet in a bucket.
A bucket with more fingerprints than `bucket_limit` is dealt out again on other
cuts of all bits by the same principle (at most max_distance + 1 exact parts), so
hot values end in small buckets without losing a link; what is still large after
`depth` times is a group of close fingerprints, and compared by balls around
centres.  Within a bucket candidates are verified against the whole fingerprint
and only a spanning forest leaves.

`near_texts` is the same search over longer fingerprints for a Jaccard similarity
of word shingles.  The pigeonhole's certainty would compare nearly all pairs at
such distances, so the dynamic programme asks for a probability of meeting at the
least similarity instead (0.99); partitions widen with the corpus, candidates are
verified by their whole fingerprints and then exactly, by their shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.components import connected_components
from tidegraph.storage import stage

SEED = 42
#: The eight bits of a byte as eight bytes 0 or 1 of one word, the highest first.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(256)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, A-Z lower-cased; fewer words: of the whole; none: nothing."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[: len(found) - words].tolist()]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[s:e], SEED) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]), ">u8").astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(h: np.ndarray, lanes: int) -> np.ndarray:
    """Hashes -> 64 * lanes bits, packed: 1 where over half of the hashes (from lane 1 on: of mixes of them) have it."""
    steps = np.arange(lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(h), 255 * 16):
        x = h[at : at + 255 * 16, None] + steps
        x[:, 1:] = _mix(x[:, 1:])
        spread = _BYTE_BITS[x.astype(">u8").view(np.uint8)]
        for k in range(0, len(spread), 255):  # a byte counts up to 255
            counts += np.add.reduce(spread[k : k + 255], axis=0).view(np.uint8)
    return np.packbits((2 * counts > len(h)).astype(np.uint8))


def fingerprint(text: str | None, words: int = 3, lanes: int = 1) -> tuple[int, ...]:
    """`lanes` unsigned 64-bit words; all zero for a text without words."""
    return tuple(int(x) for x in _majority(shingle_hashes(text, words), lanes).view(">u8"))


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, text) -> (doc_id, f0 .. f{lanes-1}), one row per document; no shuffle.

    Null and empty texts, and texts of white space, have fingerprint zero.
    """
    fields = ", ".join(f"f{k} long" for k in range(lanes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, words, lanes) for t in b.column(1).to_pylist()], dtype=np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(prints[:, k]) for k in range(lanes))], ["doc_id", *(f"f{k}" for k in range(lanes))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {fields}")


def _bits(prints: np.ndarray) -> np.ndarray:
    """(n, lanes) uint64 -> (n, 64 * lanes) bits, bit 0 the highest of lane 0."""
    return np.unpackbits(np.ascontiguousarray(prints.astype(">u8")).view(np.uint8).reshape(len(prints), -1), axis=1)


def _columns(b: pa.RecordBatch, lanes: int) -> np.ndarray:
    return np.stack([b.column(b.schema.get_field_index(f"f{k}")).to_numpy(zero_copy_only=False) for k in range(lanes)], axis=1).astype(np.int64).view(np.uint64)


def bit_groups(nodes: DataFrame, lanes: int, width: int) -> list[list[int]]:
    """Partitions of at most `width` bits; bits that correlate over all fingerprints share one.

    Co-occurrence counts come from every fingerprint: each task returns one
    (64 lanes)^2 matrix of counts, summed on the executors.
    """
    n_bits = 64 * lanes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_bits, n_bits), np.int64)
        rows = 0
        for b in batches:
            prints = _columns(b, lanes)
            for at in range(0, len(prints), 1 << 14):
                x = _bits(prints[at : at + (1 << 14)]).astype(np.float32)
                total += (x.T @ x).astype(np.int64)
            rows += b.num_rows
        if rows:
            flat = np.append(total.reshape(-1), rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["cell", "n"])

    cells = nodes.select(*(f"f{k}" for k in range(lanes))).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(n_bits * n_bits + 1)
    flat[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    rows, both = max(flat[-1], 1), flat[:-1].reshape(n_bits, n_bits)
    p = np.diag(both) / rows
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / rows - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(n_bits)), []
    while left:
        first = max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())
        group = [first]
        left.remove(first)
        while left and len(group) < width:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _project(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))


def candidate_costs(nodes: DataFrame, lanes: int, groups: list[list[int]], most: int) -> tuple[np.ndarray, int]:
    """cost[i, t + 1]: keys written plus pairs met where partition i is probed at threshold t; from all fingerprints.

    The histogram of a partition has at most 2**16 cells, whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = _bits(_columns(b, lanes))
            for i, g in enumerate(groups):
                v, n = np.unique(_project(bits, g), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(n.astype(np.int64))], ["part", "v", "n"])

    h = nodes.select(*(f"f{k}" for k in range(lanes))).mapInArrow(count, "part int, v long, n long").groupBy("part", "v").agg(F.sum("n").alias("n")).toPandas()
    cost, total = np.zeros((len(groups), most + 2)), 0
    for i, g in enumerate(groups):
        own = h[h["part"] == i]
        hist = np.zeros(1 << len(g))
        hist[own["v"].to_numpy()] = own["n"].to_numpy()
        total = int(hist.sum())
        near, v = hist.copy(), np.arange(len(hist))
        met, keys = 0.0, 0
        for t in range(most + 1):
            if t == 1:
                near = hist + sum(hist[v ^ (1 << k)] for k in range(len(g)))
            elif t >= 2:
                near = near + sum(near[v ^ (1 << k)] for k in range(len(g))) / t
            keys += math.comb(len(g), t)
            met = float((near * (near - 1)).clip(0).sum()) / 2
            cost[i, t + 1] = 0.02 * met + keys * total
    return cost, total


def allocate(cost: np.ndarray, gain: np.ndarray, need: int) -> list[int]:
    """Thresholds t_i of least total cost with sum(gain[i, t_i + 1]) >= need, by dynamic programming."""
    best = {0: (0.0, [])}
    for i in range(len(cost)):
        step: dict[int, tuple[float, list[int]]] = {}
        for had, (c, path) in best.items():
            for k in range(cost.shape[1]):
                g = min(need, had + int(gain[i, k]))
                if g not in step or c + cost[i, k] < step[g][0]:
                    step[g] = (c + cost[i, k], [*path, k - 1])
        best = step
    if need not in best:
        raise ValueError("no thresholds reach the distance asked for")
    return best[need][1]


def _flips(width: int, t: int) -> np.ndarray:
    out, last = [0], [0]
    for _ in range(max(t, 0)):
        last = sorted({x ^ (1 << b) for x in last for b in range(width)} - set(out))
        out += last
    return np.array(out, np.int64)


def _spread(rows: DataFrame, lanes: int, parts: list[tuple[list[int], int]], salt: int) -> DataFrame:
    """A row (key, f0..) for each key of each fingerprint; `key` of the input, if any, is hashed in."""
    names = [f"f{k}" for k in range(lanes)]
    keyed = "key" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = np.int64(-7046029254386353131)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                prints = _columns(b, lanes)
                bits = _bits(prints)
                old = b.column(b.schema.get_field_index("key")).to_numpy(zero_copy_only=False) if keyed else np.zeros(len(prints), np.int64)
                for i, (group, t) in enumerate(parts):
                    if t < 0:
                        continue
                    flips = _flips(len(group), t)
                    v = (_project(bits, group)[:, None] ^ flips[None, :]).reshape(-1)
                    rep = np.repeat(np.arange(len(prints)), len(flips))
                    with np.errstate(over="ignore"):
                        # one 64-bit key for (what came before, partition, value); a collision only adds a candidate to verify
                        key = (old[rep] * mult + v * np.int64(0x2545F4914F6CDD1D) + np.int64(i + 1) * np.int64(0x369DEA0F31A53F85)) * mult + np.int64(salt)
                        key ^= key >> np.int64(29)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(prints[rep, k].view(np.int64)) for k in range(lanes))], ["key", *names])

    return rows.mapInArrow(run, "key long, " + ", ".join(f"{n} long" for n in names))


def _close_pairs(key: np.ndarray, prints: np.ndarray, distance: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by key -> pairs (x, y, their distance) of rows of one key within the distance: all of them, or of a key with over `limit` rows as many as connect the same."""
    n = len(key)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    lanes = [np.ascontiguousarray(prints[:, k]) for k in range(prints.shape[1])]
    at, d = np.flatnonzero(np.repeat(sizes <= limit, sizes)), 1
    found = [(np.empty(0, np.int64),) * 3]
    while True:
        at = at[at + d < n]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        a, far = at, np.zeros(len(at), np.int64)
        for lane in lanes:  # a pair goes as soon as its bits so far differ too much
            far = far + np.bitwise_count(lane[a] ^ lane[a + d])
            near = far <= distance
            a, far = a[near], far[near]
        found.append((a, a + d, far))
        d += 1
    for k in np.flatnonzero(sizes > limit).tolist():
        x, y, w = _ball_pairs(prints[starts[k] : starts[k] + sizes[k]], distance)
        found.append((x + starts[k], y + starts[k], w))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _links(buckets: DataFrame, lanes: int, distance: int, limit: int) -> DataFrame:
    """Verified links (u, v: fingerprints in hex) that span each bucket's linked sets."""

    def hexed(prints: np.ndarray) -> list[str]:
        return [x.hex() for x in np.ascontiguousarray(prints.astype(">u8")).view(f"V{8 * lanes}").reshape(-1).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, *words in _by_key(batches):
            prints = np.stack(words, axis=1).view(np.uint64)
            x, y = _closest(len(key), *_close_pairs(key, prints, distance, limit))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(hexed(prints[y])), pa.array(hexed(prints[x]))], ["u", "v"])

    return buckets.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u string, v string")


def links(nodes: DataFrame, lanes: int = 1, max_distance: int = 3, width: int = 16, bucket_limit: int = 2000, depth: int = 3) -> DataFrame:
    """Distinct fingerprints (f0..) -> links (u, v) in hex whose connected sets are those of all links within max_distance."""
    spark = nodes.sparkSession
    groups = bit_groups(nodes, lanes, width)
    most = min(2, max_distance)
    cost, _ = candidate_costs(nodes, lanes, groups, most)
    gain = np.tile(np.arange(most + 2), (len(groups), 1))
    thresholds = allocate(cost, gain, max_distance + 1)
    rows = _spread(nodes.select(*(f"f{k}" for k in range(lanes))), lanes, list(zip(groups, thresholds, strict=True)), 0)
    found = None
    for level in range(depth):
        rows = stage(spark, rows, "keys") if level else rows
        heavy = rows.groupBy("key").count().where(F.col("count") > bucket_limit).select("key")
        heavy = stage(spark, heavy, "heavy")
        if heavy.isEmpty():
            break
        light = _links(rows.join(heavy, "key", "left_anti"), lanes, max_distance, bucket_limit)
        found = light if found is None else found.union(light)
        # other cuts of all bits each time: one of max_distance + 1 parts is equal in both ends of a link
        order = np.random.default_rng(level + 1).permutation(64 * lanes).tolist()
        size = -(-len(order) // (max_distance + 1))
        parts = [(sorted(order[k : k + size]), 0) for k in range(0, len(order), size)]
        rows = _spread(rows.join(heavy, "key", "left_semi"), lanes, parts, level + 1)
    last = _links(rows, lanes, max_distance, bucket_limit)
    return last if found is None else found.union(last)


def components(docs: DataFrame, words: int = 3, lanes: int = 1, max_distance: int = 3, **search) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint, component_id, class_size).

    component_id: the smallest doc_id reachable over links, itself included;
    class_size: documents with the same fingerprint.  Documents of equal
    fingerprints are one class, so copies are never paired.  Null texts count
    as empty.  Rows with a null doc_id are kept and linked; they never name a
    component, so a component of such rows only has a null id.  Repeated rows
    each give a row.  Other columns of docs are not used.
    """
    spark = docs.sparkSession
    names = [f"f{k}" for k in range(lanes)]
    prints = stage(spark, fingerprints(docs, words, lanes), "prints")
    nodes = stage(spark, prints.groupBy(*names).agg(F.min("doc_id").alias("low"), F.count("*").alias("class_size")), "nodes")
    hexed = F.concat(*(F.lpad(F.lower(F.hex(F.col(n))), 16, "0") for n in names))
    found = connected_components(links(nodes, lanes, max_distance, **search)).select(F.col("vertex").alias("fingerprint"), F.col("component").alias("root"))
    joined = nodes.withColumn("fingerprint", hexed).join(found, "fingerprint", "left")
    # fingerprints without links stay out of the joins by root
    alone = joined.where("root is null").select("fingerprint", "class_size", F.col("low").alias("component_id"))
    in_sets = joined.where("root is not null")
    lows = in_sets.groupBy("root").agg(F.min("low").alias("component_id"))
    named = alone.unionByName(in_sets.join(lows, "root").select("fingerprint", "class_size", "component_id"))
    return prints.select("doc_id", hexed.alias("fingerprint")).join(named, "fingerprint").select("doc_id", "fingerprint", "component_id", "class_size")


def text_keys(text: Column) -> list[Column]:
    """128 bits (t0, t1) of a text; null texts and texts without words are one text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    text = F.when(text.rlike(r"[^\x09-\x0d\x20]"), text).otherwise(F.lit(""))
    return [F.xxhash64(text).alias("t0"), F.xxhash64(F.lit(7), text).alias("t1")]


def hexed(*names: str) -> Column:
    return F.concat(*(F.lpad(F.hex(n), 16, "0") for n in names))


def _text_prints(texts: DataFrame, words: int, lanes: int) -> DataFrame:
    """(t0, t1, text) -> distinct (t0, t1, n, print): n distinct shingles, none for texts without words, and the bits of their majority."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, prints = [], []
            for t in b.column(2).to_pylist():
                own = np.unique(shingle_hashes(t, words))
                n.append(len(own))
                prints.append(_majority(own, lanes).tobytes())
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(prints, pa.binary())], ["t0", "t1", "n", "print"])
            yield out.filter(pa.array(np.array(n) > 0))

    found = texts.select("t0", "t1", "text").mapInArrow(run, "t0 long, t1 long, n int, print binary")
    return found.groupBy("t0", "t1").agg(F.min("n").alias("n"), F.min("print").alias("print"))


def _print_bits(column: pa.Array, lanes: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 8 * lanes), axis=1)


def lane_groups(prints: DataFrame, lanes: int, width: int) -> tuple[list[list[int]], np.ndarray]:
    """Partitions of `width` bits inside lanes, the bits that correlate most over all prints together, and each bit's share of ones.

    A task returns a 64 x 64 matrix of counts for each lane; these are summed on
    the executors, and one matrix a lane comes to the driver.
    """
    cells = 64 * 64 + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((lanes, 64, 64), np.int64), 0
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                x = _print_bits(b.column(0).slice(at, 2048), lanes).reshape(-1, lanes, 64).transpose(1, 2, 0).astype(np.float32)
                total += (x @ x.transpose(0, 2, 1)).astype(np.int64)
            rows += b.num_rows
        if rows:
            counts = [np.append(m.reshape(-1), rows).tobytes() for m in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(lanes), pa.int32()), pa.array(counts, pa.binary())], ["lane", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for lane, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[lane] = sums.get(lane, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lane", "counts"])

    kind = "lane int, counts binary"
    found = prints.select("print").mapInArrow(count, kind).repartition(F.col("lane"), F.spark_partition_id() % 32).mapInArrow(add, kind).repartition("lane").mapInArrow(add, kind)
    by_lane = {r["lane"]: np.frombuffer(r["counts"], np.int64) for r in found.collect()}  # a matrix a lane
    groups, shares = [], np.full(64 * lanes, 0.5)
    for lane in range(lanes):
        counts = by_lane.get(lane, np.zeros(cells, np.int64))
        rows, both = max(int(counts[-1]), 1), counts[:-1].reshape(64, 64)
        p = np.diag(both) / rows
        shares[64 * lane : 64 * lane + 64] = p
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
        corr = np.abs((both / rows - np.outer(p, p)) / np.outer(spread, spread))
        np.fill_diagonal(corr, 0)
        left = list(range(64))
        while len(left) >= width:
            group = [left[int(np.argmax(corr[np.ix_(left, left)].sum(axis=1)))]]
            left.remove(group[0])
            while len(group) < width:
                group.append(left[int(np.argmax(corr[np.ix_(left, group)].sum(axis=1)))])
                left.remove(group[-1])
            groups.append(sorted(64 * lane + b for b in group))
    return groups, shares


def _at_most(chances: np.ndarray, most: int) -> np.ndarray:
    """Chances that at most 0, 1 .. `most` of independent events happen."""
    dist = np.zeros(most + 2)
    dist[0] = 1
    for c in chances:
        dist[1:] = dist[1:] * (1 - c) + dist[:-1] * c
        dist[0] *= 1 - c
    return np.cumsum(dist)[: most + 1]


def near_thresholds(groups: list[list[int]], shares: np.ndarray, rows: int, error: float, recall: float, most: int = 1) -> list[int]:
    """t_i by dynamic programming: least keys and expected candidates for a chance of `recall` that prints with this share of differing bits meet."""
    cost, gain = np.zeros((len(groups), most + 2)), np.zeros((len(groups), most + 2))
    for i, g in enumerate(groups):
        random = _at_most(2 * shares[g] * (1 - shares[g]), most)
        meet = _at_most(np.full(len(g), error), most)
        keys = np.cumsum([math.comb(len(g), t) for t in range(most + 1)])
        cost[i, 1:] = keys * rows + 0.02 * random * rows * rows / 2
        gain[i, 1:] = np.floor(-np.log1p(-np.minimum(meet, 0.999999)) * 200)
    need = min(math.ceil(-math.log(1 - recall) * 200), int(gain[:, -1].sum()))
    return allocate(cost, gain, need)


def _near_keys(prints: DataFrame, lanes: int, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(key, t0, t1, a, b) for each key of each print; a and b are its first two lanes."""
    parts = [(k, g, _flips(len(g), t)) for k, (g, t) in enumerate(parts) if t >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                bits = _print_bits(b.column(2), lanes)
                two = np.packbits(bits[:, :128], axis=1).view(">u8").astype(np.uint64).view(np.int64)
                own = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), two[:, 0], two[:, 1]]
                for k, group, flips in parts:
                    v = (_project(bits, group)[:, None] ^ flips[None, :]).reshape(-1).view(np.uint64)
                    key = _mix(v + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)
                    rows = own if len(flips) == 1 else [np.repeat(c, len(flips)) for c in own]
                    yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, rows)], ["key", "t0", "t1", "a", "b"])

    return prints.select("t0", "t1", "print").mapInArrow(run, "key long, t0 long, t1 long, a long, b long")


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first, cut only between its values."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held and cols[0][-1] == held[-1][0][-1]:
            held.append(cols)
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        held.append([c[:cut] for c in cols])
        yield [np.concatenate(x) for x in zip(*held, strict=True)]
        held = [[c[cut:] for c in cols]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _ball_pairs(two: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (x, y, their distance) that connect what pairs within `distance` connect.

    Greedy balls of half the radius: members are linked to their centre, two
    balls whose centres are near enough by their closest members.
    """
    apart = lambda i, js: np.bitwise_count(two[js] ^ two[i]).sum(axis=1, dtype=np.int64)
    if len(two) >= 1 << 24:
        raise ValueError("a bucket of over 16 million fingerprints; widen the partitions")
    left, balls, radius = np.arange(len(two)), [], []
    xs, ys, ws = [], [], []
    while len(left):
        d = apart(left[0], left)
        mine = d <= distance // 2
        balls.append(left[mine])
        radius.append(int(d[mine].max()))
        xs.append(np.full(mine.sum() - 1, left[0]))
        ys.append(left[mine][1:])
        ws.append(d[mine][1:])
        left = left[~mine]
    centres, radius = np.array([m[0] for m in balls]), np.array(radius)
    for k, m in enumerate(balls):
        d = apart(centres[k], centres[k + 1 :])
        near = np.flatnonzero(d <= distance + radius[k] + radius[k + 1 :]) + k + 1
        if not len(near):
            continue
        others = np.concatenate([balls[j] for j in near])
        starts = np.cumsum([0, *(len(balls[j]) for j in near[:-1])])
        step = max(1, (1 << 18) // len(others))
        best = np.full(len(near), np.iinfo(np.int64).max)
        for lo in range(0, len(m), step):  # (distance, place in others, member) in one number
            far = np.bitwise_count(two[m[lo : lo + step], None] ^ two[None, others]).sum(axis=2, dtype=np.int64)
            packed = (far.min(axis=0) << 48) + (np.arange(len(others)) << 24) + lo + far.argmin(axis=0)
            best = np.minimum(best, np.minimum.reduceat(packed, starts))
        best = best[best >> 48 <= distance]
        xs.append(m[best & 0xFFFFFF])
        ys.append(others[best >> 24 & 0xFFFFFF])
        ws.append(best >> 48)
    return tuple(np.concatenate([np.empty(0, np.int64), *v]).astype(np.int64) for v in (xs, ys, ws))


def _closest(n: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of least distances over the pairs, by rounds in which each part takes its closest pair to another."""
    order = np.lexsort((y, x, w))
    x, y = x[order], y[order]
    rank, part, taken = np.arange(len(x)), np.arange(n), []
    while True:
        open_ = part[x[rank]] != part[y[rank]]
        rank = rank[open_]
        if not len(rank):
            break
        best = np.full(n, len(x))
        np.minimum.at(best, part[x[rank]], rank)
        np.minimum.at(best, part[y[rank]], rank)
        for k in np.unique(best[best < len(x)]).tolist():
            i, j = int(part[x[k]]), int(part[y[k]])
            while part[i] != i:
                i = int(part[i])
            while part[j] != j:
                j = int(part[j])
            if i != j:
                part[max(i, j)] = min(i, j)
                taken.append(k)
        while True:
            up = part[part]
            if (up == part).all():
                break
            part = up
    return x[taken], y[taken]


def _near(keys: DataFrame, distance: int, limit: int) -> DataFrame:
    """(c0, c1, t0, t1): in each bucket a forest of the closest pairs whose first two lanes are within `distance`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t0, t1, a, b in _by_key(batches):
            x, y = _closest(len(key), *_close_pairs(key, np.stack([a, b], axis=1).view(np.uint64), distance, limit))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (t0[x], t1[x], t0[y], t1[y])], ["c0", "c1", "t0", "t1"])

    return keys.repartition("key").sortWithinPartitions("key", "t0", "t1").mapInArrow(run, "c0 long, c1 long, t0 long, t1 long")


def _likely(d: np.ndarray, n: np.ndarray, m: np.ndarray, bits: int, p: int, q: int) -> np.ndarray:
    """Which pairs of prints at these distances, of sets of n and m shingles, may have the similarity p/q."""
    least = np.minimum(n, m)
    error = np.where(least < 8, math.acos(2 * p / (p + q)) / math.pi + 0.04, math.acos(2 * p / (p + q)) / math.pi)
    return (d <= bits * error + 4 * np.sqrt(bits * error * (1 - error))) & (least * q >= np.maximum(n, m) * p)


def _alike(x: np.ndarray, y: np.ndarray, p: int, q: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * q >= (len(x) + len(y) - both) * p


def _bitmap(ids: DataFrame):
    """A broadcast bitmap of 2**24 bits, whatever the number of ids (t0): 2 MB that keep most other texts out of a shuffle."""
    at = F.col("t0").bitwiseAND((1 << 24) - 1)
    words = ids.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(t0 & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << 18, np.int64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(bits)


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(t0, t1, text) of the ids (t0, t1), one row each, staged."""
    shared = _bitmap(ids)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            t = b.column(0).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array((bits[(t & ((1 << 24) - 1)) >> 6] >> (t & 63)) & 1 == 1))

    few = texts.select("t0", "t1", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(some, "t0 long, t1 long, text string")
    return stage(texts.sparkSession, few.join(ids, ["t0", "t1"], "left_semi").groupBy("t0", "t1").agg(F.first("text").alias("text")), "texts", tidy=True)


def _verified(pairs: DataFrame, own: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """Distinct pairs (c0, c1, t0, t1) -> links (u, v) in hex, those whose shingle sets have the similarity p/q or more."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, np.uint64)
        for b in batches:
            keep = []
            for x, y in zip(b.column(4), b.column(5), strict=True):
                x = x.as_py()
                if x != last:
                    last, held = x, np.unique(shingle_hashes(x, words))
                keep.append(_alike(held, np.unique(shingle_hashes(y.as_py(), words)), p, q))
            b = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(4)], ["c0", "c1", "t0", "t1"])

    named = own.select(F.col("t0").alias("c0"), F.col("t1").alias("c1"), F.col("text").alias("other"))
    asked = pairs.join(own, ["t0", "t1"]).join(named, ["c0", "c1"]).select("c0", "c1", "t0", "t1", "other", "text")
    good = asked.mapInArrow(alike, "c0 long, c1 long, t0 long, t1 long")
    return stage(pairs.sparkSession, good.select(hexed("c0", "c1").alias("u"), hexed("t0", "t1").alias("v")), "links", tidy=True)


def _blocks(members: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(t0, t1, g, c), texts of cloud g and component c -> members with their block, and pairs of blocks (pair, block).

    A component of `block` texts or more has blocks of its own, others share
    some; blocks of one component aren't paired, nor are clouds of one component.
    """
    comps = members.groupBy("g", "c").agg(F.count("*").alias("n"))
    clouds = comps.groupBy("g").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("n") < block, F.col("n")).otherwise(0)).alias("rest")).where("kinds > 1").select("g", "rest")
    sized = comps.join(clouds, "g")
    rows = members.join(sized, ["g", "c"])
    large = F.col("n") >= block
    cut = F.when(large, F.pmod(F.xxhash64("t0", "t1"), F.ceil(F.col("n") / block))).otherwise(F.pmod(F.xxhash64("c"), F.ceil(F.col("rest") / block)))
    rows = rows.withColumn("pure", F.when(large, F.col("c"))).withColumn("block", F.xxhash64("g", "pure", cut)).select("t0", "t1", "g", "c", "pure", "block")
    blocks = rows.select("g", "block", "pure").distinct()
    other = blocks.select("g", F.col("block").alias("b"), F.col("pure").alias("p"))
    pairs = blocks.join(other, "g").where((F.col("block") <= F.col("b")) & ~F.coalesce(F.col("pure") == F.col("p"), F.lit(False)))
    pairs = pairs.select(F.xxhash64("block", "b").alias("pair"), F.explode(F.array_distinct(F.array("block", "b"))).alias("block"))
    return rows.select("t0", "t1", "c", "block"), pairs


def _across(members: DataFrame, own: DataFrame, prints: DataFrame, words: int, lanes: int, p: int, q: int, block: int) -> DataFrame:
    """Links (u, v) in hex that connect what links of similarity p/q connect between a cloud's components.

    Two blocks of a cloud meet in a task; its pairs of different components whose
    prints are near are checked exactly, the closest first, as long as they
    don't connect anyway.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # texts are looked at for few rows, so they stay in Arrow; a pair of blocks has some 2 * block rows
        held: list[pa.RecordBatch] = []
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if held and held[0].column(0)[0].as_py() != int(keys[lo]):
                    yield from work(held)
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from work(held)

    def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        t0, t1, c, blk, n = (t.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
        prints = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint64).reshape(-1, lanes)
        first = blk == blk[0]
        two = not first.all()
        xs, ys, ds = [], [], []
        for x in np.flatnonzero(first).tolist():
            others = np.flatnonzero(~first) if two else np.arange(x + 1, len(c))
            others = others[c[others] != c[x]]
            far = np.bitwise_count(prints[others] ^ prints[x]).sum(axis=1, dtype=np.int64)
            near = _likely(far, np.full(len(others), n[x], np.int64), n[others].astype(np.int64), 64 * lanes, p, q)
            xs.append(np.full(near.sum(), x))
            ys.append(others[near])
            ds.append(far[near])
        x, y, d = (np.concatenate([np.empty(0, np.int64), *v]).astype(np.int64) for v in (xs, ys, ds))
        root = {int(k): int(k) for k in np.unique(c)}

        def top(k: int) -> int:
            while root[k] != k:
                k = root[k]
            return k

        sets: dict[int, np.ndarray] = {}

        def shingles(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = np.unique(shingle_hashes(t.column(7)[k].as_py(), words))
            return sets[k]

        out = []
        for k in np.argsort(d, kind="stable").tolist():
            i, j = int(x[k]), int(y[k])
            a, b = top(int(c[i])), top(int(c[j]))
            if a != b and _alike(shingles(i), shingles(j), p, q):
                root[max(a, b)] = min(a, b)
                out.append((i, j))
        if out:
            i, j = np.array(out).T
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (t0[i], t1[i], t0[j], t1[j])], ["c0", "c1", "t0", "t1"])

    rows, pairs = _blocks(members, block)
    dealt = pairs.join(rows, "block").join(prints, ["t0", "t1"]).join(own, ["t0", "t1"]).select("pair", "t0", "t1", "c", "block", "n", "print", "text")
    good = dealt.repartition("pair").sortWithinPartitions("pair", "block", "t0", "t1").mapInArrow(run, "c0 long, c1 long, t0 long, t1 long")
    return stage(members.sparkSession, good.select(hexed("c0", "c1").alias("u"), hexed("t0", "t1").alias("v")), "links", tidy=True)


def near_texts(texts: DataFrame, words: int = 5, p: int = 4, q: int = 5, recall: float = 0.99, bucket_limit: int = 512, block: int = 512) -> DataFrame:
    """(t0, t1, text) as of text_keys, copies and nulls included -> (vertex, component) of texts linked to others; vertex: t0 and t1 in hex.

    Texts link where their sets of `words`-word shingles have a Jaccard
    similarity of p/q or more, checked exactly; a pair of just that similarity is
    a candidate with a chance of `recall` or more (nearer ones nearly always;
    sets of under 8 shingles may miss some more).  A text without words links to none.

    1. Each text's print (1024 bits; 2048 above a million texts) is probed by
       partition; a bucket gives a forest of its closest pairs, so a group of
       copies costs its size in links, not its square.  What these connect is a
       cloud: texts in different clouds are not compared.
    2. In clouds of over `block` texts the forest's pairs are checked, which
       leaves few components there.
    3. Texts of different components of a cloud (in a small one: all) meet in
       pairs of blocks, where links are found closest first.

    A bucket is held by one task, 40 bytes a row (16 million rows at most, or an error); above `bucket_limit` rows it is
    compared by balls, linear in its size where it is a group of near copies.
    """
    spark = texts.sparkSession
    rows = texts.count()
    lanes, width = (16, 16) if rows <= 1 << 20 else (32, 21) if rows <= 1 << 28 else (64, 32)
    error = math.acos(2 * p / (p + q)) / math.pi
    prints = stage(spark, _text_prints(texts, words, lanes), "prints", tidy=True)
    groups, shares = lane_groups(prints, lanes, width)
    parts = list(zip(groups, near_thresholds(groups, shares, rows, error, recall), strict=True))
    distance = math.ceil(128 * (error + 0.04) + 2.6 * math.sqrt(128 * (error + 0.04) * (0.96 - error)))
    forest = stage(spark, _near(_near_keys(prints, lanes, parts), distance, bucket_limit).distinct(), "forest", tidy=True)
    clouds = connected_components(forest.select(hexed("c0", "c1").alias("u"), hexed("t0", "t1").alias("v")))
    ids = forest.select("t0", "t1").union(forest.select("c0", "c1")).distinct().withColumn("vertex", hexed("t0", "t1"))
    ids = stage(spark, ids.join(clouds, "vertex").select("t0", "t1", "vertex", F.xxhash64("component").alias("g")), "ids", tidy=True)
    own = _texts_of(texts, ids.select("t0", "t1"))
    large = ids.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > block).select("g")
    asked = forest.join(ids.join(large, "g", "left_semi").select("t0", "t1"), ["t0", "t1"], "left_semi")
    sure = _verified(asked, own, words, p, q)
    found = connected_components(sure)
    members = ids.join(found, "vertex", "left").select("t0", "t1", "g", F.xxhash64(F.coalesce("component", "vertex")).alias("c"))
    more = _across(stage(spark, members, "members", tidy=True), own, prints, words, lanes, p, q, block)
    return connected_components(sure.union(more))
