"""Suffix-array dedup: strings of `length` bytes that start anywhere else are removed.

Candidates (lossless).  In each window of `length` bytes the least hash of its
k-grams is the window's anchor, so equal windows have the same anchor at the same
place.  The windows of one anchor form a run, a piece of text of at most
2 * length - k bytes; an anchor whose hash stands only once in the corpus can't
lie in a repeat.  Equal runs are counted together, so a passage that a third of
all documents share is one run with a count, never a group of rows.

Suffix arrays.  Runs that share an anchor but differ are laid end to end, and
their suffix array is built by linear grouping: suffixes are grouped by Lyndon
prefix, groups are taken in descending order, each member's previous smaller
suffix is found over the pointers of those before it, and the groups of these
are split by how often they are met.  The order inside groups is then emitted
from the start, without renaming or recursion.  Neighbours in the array with
`length` bytes in common mark repeated windows.

An anchor with more than `most` different runs goes another exact way: its
windows are counted by a 128-bit hash, dealt out by that hash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidegraph.storage import stage

_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of runs that a task lays out and sorts.
TASK_BYTES = 2 << 20
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def suffix_array(s: bytes | list[int]) -> list[int]:
    """Suffixes of s in lexicographic order (a shorter one before its extensions), by linear grouping."""
    n = len(s)
    heads: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        heads.setdefault(c, []).append(i)
    members = [heads[c] for c in sorted(heads)]
    sizes = [len(m) for m in members]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    # groups by rank: a list linked both ways, so that one can be put right above another
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    prev: list[int | None] = [None] * (n + 1)  # the last stands for place -1
    order: list[int] = []
    g = len(members) - 1
    while g >= 0:
        own = members[g]
        if len(own) != sizes[g]:  # some have moved on
            own = members[g] = [i for i in own if group[i] == g]
        order.append(g)
        if len(own) == 1:
            i = own[0]
            j = i - 1
            p = prev[j]
            while p is not None:
                j = p
                p = prev[j]
            prev[i] = j
            parts = [(group[j], own_j)] if j >= 0 and sizes[group[j]] > 1 and (own_j := [j]) else ()
        else:
            met = []
            for i in own:
                j = i - 1
                # all that rank as high or higher, and only they, have a pointer by now
                p = prev[j]
                while p is not None:
                    j = p
                    p = prev[j]
                prev[i] = j
                if j >= 0:
                    met.append(j)
            times: dict[int, dict[int, list[int]]] = {}
            last, count = -1, 0
            for j in met:  # pointers of ascending members ascend
                if j == last:
                    count += 1
                    continue
                if count:
                    times.setdefault(count, {}).setdefault(group[last], []).append(last)
                last, count = j, 1
            if count:
                times.setdefault(count, {}).setdefault(group[last], []).append(last)
            parts = [x for t in sorted(times, reverse=True) for x in times[t].items()] if len(times) > 1 else [*times[count].items()] if times else ()
        for old, moved in parts:
            if len(moved) == sizes[old]:  # a group that moves whole stays where it is
                continue
            k = len(members)
            members.append(moved)
            sizes.append(len(moved))
            sizes[old] -= len(moved)
            top = above[old]
            below.append(old)
            above.append(top)
            above[old] = k
            if top >= 0:
                below[top] = k
            for j in moved:
                group[j] = k
        g = below[g]
    # emission: a suffix is placed when the suffix after its Lyndon prefix is
    at, free = 0, [0] * len(members)
    for g in reversed(order):
        free[g] = at
        at += sizes[g]
    out = [-1] * n
    placed = bytearray(n + 1)
    placed[n] = 1  # place -1
    for k in range(-1, n):
        i = (out[k] if k >= 0 else n) - 1
        while not placed[i]:
            placed[i] = 1
            g = group[i]
            f = free[g]
            out[f] = i
            free[g] = f + 1
            i = prev[i]
    return out


def window_anchors(data: bytes, length: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows by anchor: (hash of the anchor's k-gram, its place, first window, last window); empty if data is shorter than a window."""
    n = len(data)
    if n < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    found, step = [], 1 << 20
    for lo in range(0, n - length + 1, step):  # windows lo .. hi - 1
        hi = min(lo + step, n - length + 1)
        found.append(_anchors(data[lo : hi + length - 1], length, k, lo))
    h, pos, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:  # a run that the cut between pieces has split
        cut = np.append(True, (pos[1:] != pos[:-1]))
        ends = np.append(np.flatnonzero(cut)[1:] - 1, len(pos) - 1)
        h, pos, first, last = h[cut], pos[cut], first[cut], last[ends]
    return h ^ np.uint64(seed), pos, first, last


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def _anchors(data: bytes, length: int, k: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(x)
    power, inverse = _powers(1 << max(12, (n - 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((x + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * inverse[: n - k + 1]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h ^= h >> np.uint64(30)
    w = length - k + 1
    m = len(h)
    # hash above, place below: the least is the leftmost of the least hashes
    low = np.uint64(21)
    packed = (h >> low << low) | np.arange(m, dtype=np.uint64)
    full = -(-m // w) * w
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = packed
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = m - w + 1
    pos = (np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows]) & np.uint64((1 << 21) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
    last = np.append(first[1:] - 1, windows - 1)
    at = pos[first]
    return h[at], at + shift, first + shift, last + shift


def repeated_starts(texts: list[bytes], length: int, owners: list | None = None) -> list[np.ndarray]:
    """For each text the starts of its `length`-byte strings that also start elsewhere in these texts (or again in it).

    With owners, one per text, they must also start in a text of another owner;
    an owner of None differs from all.
    """
    joined = b"\xff".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    whole = np.zeros(len(joined) + 1, bool)  # strings that end in their own text
    for t, end in zip(texts, ends.tolist(), strict=True):
        if len(t) >= length:
            whole[end - len(t) - 1 : end - length] = True
    sa = np.array(suffix_array(joined), np.int64)
    hit = np.zeros(len(joined) + 1, bool)
    last, last_at, same = b"", -1, None
    found: list[list[int]] = []
    # what lies between two equal strings in the array begins with the same bytes, so others can be passed over
    for i in sa[whole[sa]].tolist() if len(sa) else []:
        piece = joined[i : i + length]
        if piece != last:
            last, same = piece, None
        elif same is None:
            same = [last_at, i]
            found.append(same)
        else:
            same.append(i)
        last_at = i
    for same in found:
        if owners is not None:
            whose = [owners[k] for k in np.searchsorted(ends, same, side="right")]
            if None not in whose and len(set(whose)) == 1:
                continue
        hit[same] = True
    return [np.flatnonzero(hit[end - len(t) - 1 : end - 1]) for t, end in zip(texts, ends.tolist(), strict=True)]


def shared_parts(runs: list[tuple[int, int, int, int, bytes, bytes]], length: int, step: int = 8) -> list[tuple]:
    """One anchor's runs (anchor, run, n, off, data, uid) -> (anchor, run, n, uid, shift, data): what of each can be in a repeat.

    Lossless: windows that start at one distance from the anchor are cut into
    classes of `step` distances; all windows of a class hold the same core, so a
    class whose core stands in one run only holds no repeat.
    """
    cores: dict[tuple[int, bytes], list[int]] = {}
    places = []
    for _, _, n, off, data, _ in runs:
        last = len(data) - length
        own = []
        for j in range((off - min(off, last)) // step * step, off + 1, step):
            lo, hi = max(0, off - j - step + 1), min(last, off - j)
            if lo <= hi:
                key = (j, data[off - j : off - j - step + 1 + length])
                own.append((lo, hi, key))
                c = cores.setdefault(key, [0, 0])
                c[0] += 1
                c[1] += n == 1
        places.append(own)
    out = []
    for (anchor, run, n, _, data, uid), own in zip(runs, places, strict=True):
        live = [(lo, hi) for lo, hi, key in own if (c := cores[key])[0] > 1 and c[1]]
        if live:
            lo, hi = min(x[0] for x in live), max(x[1] for x in live)
            out.append((anchor, run, n, uid, lo, data[lo : hi + length]))
    return out


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts -> first and last of each run of consecutive ones."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]


_RUNS = "uid binary, anchor long, run long, lo int, hi int, off short"


def _scope_seed(scope: str | None) -> int:
    return xxhash.xxh64_intdigest(scope.encode()) if scope else 0


def repeats(texts: DataFrame, length: int = 200, k: int = 64, most: int = 2000, across: bool = False) -> DataFrame:
    """(uid binary, scope string, data binary) -> (uid, lo, hi): windows lo .. hi (starts, both included) that repeat in their scope.

    One row of `texts` for each text, copies included; equal texts share their
    uid, so each gets rows once.  With `across`, a string must start in texts of
    two uids.
    """
    spark = texts.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uids, parts = [], ([], [], [], [], [])
            for uid, scope, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, pos, first, last = window_anchors(data, length, k, _scope_seed(scope))
                if not len(h):
                    continue
                runs = np.frombuffer(b"".join([xxhash.xxh3_64_digest(data[s : e + length]) for s, e in zip(first.tolist(), last.tolist(), strict=True)]), ">i8").astype(np.int64)
                uids += [uid] * len(h)
                for into, x in zip(parts, (h.view(np.int64), runs, first, last, pos - first), strict=True):
                    into.append(x)
            if uids:
                h, runs, first, last, off = (np.concatenate(p) for p in parts)
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.binary()), pa.array(h), pa.array(runs), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(off.astype(np.int16))], ["uid", "anchor", "run", "lo", "hi", "off"])

    runs = stage(spark, texts.select("uid", "scope", "data").mapInArrow(cut, _RUNS), "runs", tidy=True)
    seen = runs.groupBy("anchor").count().where("count > 1").select("anchor")
    # a bitmap of 2**20 words of fixed size, whatever the input, keeps most lone anchors out of the shuffles
    words = seen.select(F.shiftright(F.col("anchor").bitwiseAND((1 << 26) - 1), 6).alias("w"), F.expr("shiftleft(1L, cast(anchor & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << 20, np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            a = b.column(1).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array((bits[(a & ((1 << 26) - 1)) >> 6] >> (a & 63)) & 1 == 1))

    kept = stage(spark, runs.mapInArrow(keep, _RUNS), "kept", tidy=True)
    places = kept.dropDuplicates(["anchor", "run", "uid"]) if across else kept
    kinds = places.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min(F.struct("uid", "lo", "hi", "off")).alias("at"))
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    kinds = stage(spark, kinds.join(anchors, "anchor"), "kinds", tidy=True)
    # a whole run that stands twice repeats in all its windows
    whole = kinds.where("n > 1").select("anchor", "run", F.lit(0).alias("a"), (F.col("at.hi") - F.col("at.lo")).alias("b"))
    mixed = kinds.where("kinds > 1").select("anchor", "run", "n", "kinds", F.col("at.uid").alias("uid"), F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), F.col("at.off").alias("off"))
    wanted = mixed.groupBy("uid").agg(F.collect_list(F.struct("anchor", "run", "n", "kinds", "lo", "hi", "off")).alias("want"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: bytes | None = None
        for b in batches:
            for uid, data, want in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if uid == done:  # a copy; those of other tasks go where runs are sorted
                    continue
                done = uid
                yield pa.RecordBatch.from_arrays([pa.array([w[c] for w in want], t) for c, t in (("anchor", pa.int64()), ("run", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64()), ("off", pa.int16()))] + [pa.array([uid] * len(want), pa.binary()), pa.array([data[w["lo"] : w["hi"] + length] for w in want], pa.binary())], ["anchor", "run", "n", "kinds", "off", "uid", "data"])

    one = texts.select("uid", "data").join(wanted, "uid").select("uid", "data", "want")
    pieces = stage(spark, one.mapInArrow(take, "anchor long, run long, n long, kinds long, off short, uid binary, data binary"), "pieces", tidy=True)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes, bytes]] = []  # an anchor's runs
        laid: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][:2] == row[:2]:  # cut from another copy
                    continue
                if held and held[-1][0] != row[0]:
                    laid += shared_parts(held, length)
                    size += sum(len(h[4]) for h in held)
                    held = []
                    if size > 400_000:
                        yield from work(laid)
                        laid, size = [], 0
                held.append(row)
        yield from work(laid + shared_parts(held, length))

    def work(laid: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int]] = []
        owners = [None if x[2] > 1 else x[3] for x in laid] if across else None
        found = repeated_starts([x[5] for x in laid], length, owners) if laid else []
        for (anchor, run, n, _, shift, _), starts in zip(laid, found, strict=True):
            if n == 1:
                rows += [(anchor, run, int(a) + shift, int(e) + shift) for a, e in zip(*_ranges(starts), strict=True)]
        if rows:
            a = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(a[:, 2].astype(np.int32)), pa.array(a[:, 3].astype(np.int32))], ["anchor", "run", "a", "b"])

    # tasks of some two megabytes, as sorting them takes a second each
    size = mixed.where(F.col("kinds") <= most).agg(F.sum(F.col("hi") - F.col("lo") + length)).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    few = pieces.where(F.col("kinds") <= most).select("anchor", "run", "n", "off", "data", "uid").repartition(tasks, "anchor").sortWithinPartitions("anchor", "run").mapInArrow(sort, "anchor long, run long, a int, b int")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for anchor, run, n, uid, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = len(data) - length + 1
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * m, pa.int64()), pa.array([run] * m, pa.int64()), pa.array([n] * m, pa.int64()), pa.array([uid] * m, pa.binary()), pa.array(np.arange(m, dtype=np.int32)), pa.array([xxhash.xxh3_128_digest(data[i : i + length]) for i in range(m)], pa.binary())], ["anchor", "run", "n", "uid", "a", "h"])

    hot = pieces.where(F.col("kinds") > most).dropDuplicates(["anchor", "run"]).select("anchor", "run", "n", "uid", "data").mapInArrow(windows, "anchor long, run long, n long, uid binary, a int, h binary")
    twice = (F.min("uid") != F.max("uid")) | (F.max("n") > 1) if across else F.sum("n") > 1
    often = hot.groupBy("anchor", "h").agg(twice.alias("twice")).where("twice").select("anchor", "h")
    many = hot.where("n = 1").join(often, ["anchor", "h"], "left_semi").select("anchor", "run", "a", F.col("a").alias("b"))
    marks = stage(spark, whole.union(few).union(many), "marks", tidy=True)
    return kept.join(marks, ["anchor", "run"]).select("uid", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi"))


def removed_runs(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows lo .. hi of `length` bytes -> starts and ends of the maximal runs of bytes that they cover."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], hi[order] + length
    reach = np.maximum.accumulate(end)
    new = np.append(True, lo[1:] > reach[:-1])
    ends = np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])
    return lo[new], ends


def with_repeats(docs: DataFrame, columns: list[str], length: int = 200, **search) -> DataFrame:
    """(row, data, spans): a struct of the columns of docs, the text's bytes (null: empty) and an array (lo, hi) of repeated windows, or null."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), data.alias("data"), F.unhex(F.md5(data)).alias("uid"))
    # one text of each set of copies is enough beyond its count: equal texts have equal runs, counted together
    found = repeats(d.select("uid", F.lit(None).cast("string").alias("scope"), "data"), length, **search)
    spans = found.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return d.join(spans, "uid", "left").select("row", "data", "spans")


def dedup(docs: DataFrame, length: int = 200, **search) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): the texts without repeated strings.

    A byte goes if a string of `length` bytes over it also starts anywhere else,
    in the same document or another; strings are judged on the input.  Null
    texts are empty; texts shorter than `length` stay.  Rows are independent of
    doc_id, so null and repeated doc_ids are kept; repeated rows are copies of
    each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, data, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kept, gone, n = data, 0, 0
                if spans:
                    at = np.array([(s["lo"], s["hi"]) for s in spans], np.int64)
                    starts, ends = removed_runs(at[:, 0], at[:, 1], length)
                    gone, n = int((ends - starts).sum()), len(starts)
                    edges = [0, *np.stack([starts, ends], 1).reshape(-1).tolist(), len(data)]
                    kept = b"".join(data[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id, len(data), gone, n, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = with_repeats(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], length, **search)
    return rows.select("row.doc_id", "data", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def cut_texts(docs: DataFrame, length: int = 200, **search) -> DataFrame:
    """docs with repeated strings of `length` bytes taken out of `text`, and n_chars (where there is one) counted anew.

    A code point of which a cut takes a part goes whole.  Null texts stay null.
    """
    names = docs.columns
    null = "_" * (1 + max(map(len, names)))  # a name that no column has
    d = docs.withColumn(null, F.col("text").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for data, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if spans:
                    at = np.array([(s["lo"], s["hi"]) for s in spans], np.int64)
                    starts, ends = removed_runs(at[:, 0], at[:, 1], length)
                    edges = [0, *np.stack([starts, ends], 1).reshape(-1).tolist(), len(data)]
                    data = b"".join(data[a:e].decode("utf-8", "ignore").encode() for a, e in zip(edges[::2], edges[1::2], strict=True))
                texts.append(data.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", "kept"])

    rows = with_repeats(d, [c for c in d.columns if c != "text"], length, **search)
    done = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("kept", StringType())]))
    text = F.when(~F.col("row")[null], F.col("kept"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return done.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in names))
