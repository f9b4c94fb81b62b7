"""Document fingerprints from prefix polynomial hashes.

A text's code points x_0 .. x_{n-1} give prefix sums H[i] = sum x_j B^j mod p for
two primes p.  From them comes, without reading the text again, the hash of any
span, so equality of spans and, by binary search, the longest common extension
of two positions.  Written out, a fingerprint is the length, both whole-text hashes
and the least `keep` distinct hashes of the text's spans of `span` code points.

Two texts' likeness comes from their prefix arrays: spans of one that also stand
in the other are extended to the longest common span by binary search, and the
code points under such spans are counted in both.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525)
SPAN, KEEP = 24, 64


@functools.lru_cache(maxsize=4)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0 .. B^{n-1} and the inverses, mod p; n is a power of two."""
    p, b = PRIMES[which], BASES[which]
    out = []
    for base in (b, pow(b, -1, p)):
        x = np.ones(n, np.uint64)
        m, step = 1, base
        while m < n:
            x[m : 2 * m] = x[:m] * np.uint64(step) % np.uint64(p)
            step = step * step % p
            m *= 2
        out.append(x)
    return out[0], out[1]


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(x)
        size = 1 << max(12, (self.n - 1).bit_length())
        self.h, self.inverse = [], []
        self.known: dict = {}
        for k, p in enumerate(PRIMES):
            power, inverse = _powers(k, size)
            h = np.zeros(self.n + 1, np.uint64)
            np.cumsum(x * power[: self.n] % np.uint64(p), out=h[1:])
            self.h.append(h % np.uint64(p))
            self.inverse.append(inverse)

    def spans(self, which: int, at: np.ndarray | slice, end: np.ndarray | slice, shift: np.ndarray | slice) -> np.ndarray:
        p = np.uint64(PRIMES[which])
        return (self.h[which][end] + p - self.h[which][at]) % p * self.inverse[which][shift] % p

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Hash of text[start:end]; equal texts have equal hashes wherever they stand."""
        a, e = np.array([start]), np.array([end])
        return tuple(int(self.spans(k, a, e, a)[0]) for k in range(2))

    def sketch(self, span: int = SPAN, keep: int = KEEP) -> np.ndarray:
        """The least `keep` distinct 32-bit mixes of span hashes; a shorter text has one span, an empty one none."""
        if not self.n:
            return np.empty(0, np.uint32)
        w = min(span, self.n)
        m = self.n - w + 1
        h = self.spans(0, slice(0, m), slice(w, self.n + 1), slice(0, m))
        h = (h + np.uint64(w)) * np.uint64(0x9E3779B97F4A7C15)
        h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
        few = keep
        while True:  # repeated spans count once, so look further until enough differ
            low = np.unique(np.partition(h, few)[:few] if few < m else h)
            if len(low) >= keep or few >= m:
                return low[:keep].astype(np.uint32)
            few *= 4

    def windows(self, w: int) -> np.ndarray:
        """62-bit hashes of all spans of w code points."""
        key = ("windows", w)
        if key not in self.known:
            m = self.n - w + 1
            first, second = (self.spans(k, slice(0, m), slice(w, self.n + 1), slice(0, m)) for k in range(2))
            self.known[key] = first << np.uint64(31) | second
        return self.known[key]

    def sorted_windows(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """windows() in order, and their places."""
        key = ("sorted", w)
        if key not in self.known:
            order = np.argsort(self.windows(w), kind="stable")
            self.known[key] = self.windows(w)[order], order
        return self.known[key]

    def fingerprint(self, span: int = SPAN, keep: int = KEEP) -> str:
        whole = self.span(0, self.n) if self.n else (0, 0)
        return f"{self.n:08x}{whole[0]:08x}{whole[1]:08x}" + self.sketch(span, keep).astype(">u4").tobytes().hex()


def longest_common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int, known: int = 0) -> int:
    """Length of the longest common span from a[i] and b[j], at least `known`: binary search over equal prefixes."""
    ends = [(p, a.h[k], int(a.h[k][i]), int(a.inverse[k][i]), b.h[k], int(b.h[k][j]), int(b.inverse[k][j])) for k, p in enumerate(PRIMES)]
    lo, hi = known, min(a.n - i, b.n - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if all((int(x[i + mid]) - x0) * xi % p == (int(y[j + mid]) - y0) * yi % p for p, x, x0, xi, y, y0, yi in ends):
            lo = mid
        else:
            hi = mid - 1
    return lo


def common_spans(a: PrefixHash, b: PrefixHash, least: int) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of common spans of `least` code points or more, from left to right in a.

    A span of a is matched where it stands first in b and extended as far as it
    goes; the next may overlap it by less than `least`.
    """
    if min(a.n, b.n) < least:
        return []
    own = a.windows(least)
    values, places = b.sorted_windows(least)
    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
    hits = np.flatnonzero(values[at] == own)
    out, k = [], 0
    while k < len(hits):
        i = int(hits[k])
        j = int(places[at[i]])
        n = longest_common_extension(a, i, b, j, least)
        out.append((i, j, n))
        k = int(np.searchsorted(hits, i + n - least + 1))
    return out


def _covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def span_likeness(a: PrefixHash, b: PrefixHash, span: int = SPAN) -> float:
    """0 to 1: twice the code points under common spans (in the text with fewer of them) over the lengths' sum; 1 for equal texts.

    Spans count from `span` code points on, from half the shorter text in short ones.
    """
    if a.n == b.n and (not a.n or a.span(0, a.n) == b.span(0, b.n)):
        return 1.0
    if not a.n or not b.n:
        return 0.0
    found = common_spans(a, b, max(1, min(span, min(a.n, b.n) // 2)))
    return 2 * min(_covered([(i, i + n) for i, _, n in found]), _covered([(j, j + n) for _, j, n in found])) / (a.n + b.n)


def likeness(a: str, b: str, keep: int = KEEP) -> float:
    """Of written fingerprints alone: an estimate of the share of spans in common, 0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = {a[k : k + 8] for k in range(24, len(a), 8)}, {b[k : k + 8] for k in range(24, len(b), 8)}
    union = sorted(x | y)[:keep]
    return sum(1 for v in union if v in x and v in y) / len(union) if union else 0.0


def _bounds_below(bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted bounds lie before (doc_id, tie): first among each chunk's last, then in the chunk."""
    if not bounds:
        return F.lit(0)
    size = math.isqrt(len(bounds)) + 1
    chunks = [bounds[k : k + size] for k in range(0, len(bounds), size)]
    column = lambda part: F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(tie).cast("long").alias("tie")) for i, tie in part))
    below = lambda part: F.size(F.filter(part, lambda b: (b["i"] < F.col("doc_id")) | ((b["i"] == F.col("doc_id")) & (b["tie"] < F.col("tie")))))
    whole = below(column([c[-1] for c in chunks]))
    inside = F.coalesce(F.element_at(F.array(*map(column, chunks)), whole + 1), F.array().cast("array<struct<i: bigint, tie: bigint>>")) if len(chunks) > 1 else column(chunks[0])
    return F.when(whole >= len(chunks), F.lit(len(bounds))).otherwise(whole * size + below(inside))


def with_next(docs: DataFrame, run, out: str, ranges: int | None = None) -> DataFrame:
    """Give run() the rows (doc_id, text) in order of doc_id, each with its successor's text (the last: the first's).

    Texts are dealt out once, by ranges of (doc_id, the text's hash).  The first row of a range is
    also sent to the range before it, so a task holds no more than two rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = ranges or 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = d.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 10000), F.count("doc_id"), F.count("*")).first()
    times = Counter(found[0] or []) if ranges > 1 else Counter()
    # an id that several bounds fall on has the rows of several ranges: it is cut by the texts' hash
    cut = lambda n: [-(1 << 63) + k * ((1 << 64) // n) for k in range(1, n)]
    bounds = [(i, tie) for i in sorted(times) for tie in [*cut(times[i]), (1 << 63) - 1]]
    d = d.withColumn("tie", F.xxhash64("text"))
    idle = cut(max(1, round(ranges * (found[2] - found[1]) / max(found[2], 1))))  # rows without an id come last, cut by hash
    past = F.lit(len(bounds)) + sum((F.when(F.col("tie") > b, 1).otherwise(0) for b in idle), F.lit(0))
    d = d.withColumn("place", F.when(F.col("doc_id").isNull(), past).otherwise(_bounds_below(bounds)).cast("int"))
    first = d.groupBy("place").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie")).alias("f"))
    firsts = sorted((r["place"], r["f"]["doc_id"], r["f"]["tie"]) for r in first.collect())  # at most a row for each range
    guests = spark.createDataFrame([(p, i, tie, firsts[k - 1][0]) for k, (p, i, tie) in enumerate(firsts)], "f_place int, f_id long, f_tie long, ahead int")
    d = d.join(F.broadcast(guests), (F.col("place") == F.col("f_place")) & F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("tie") == F.col("f_tie")), "left")
    ahead = F.col("ahead")
    copies = F.when(ahead.isNull(), F.array(F.struct(F.col("place").alias("p"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("place").alias("p"), F.lit(False).alias("guest")), F.struct(ahead.alias("p"), F.lit(True).alias("guest"))))
    d = d.withColumn("copy", F.explode(copies)).select("doc_id", "text", "tie", F.col("copy.p").alias("p"), F.col("copy.guest").alias("guest"))
    return d.repartition(ranges, "p").sortWithinPartitions("p", "guest", F.col("doc_id").isNull(), "doc_id", "tie").select("p", "guest", "doc_id", "text").mapInArrow(run, out)


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """Rows as with_next() deals them -> (doc_id, text, next text)."""
    held = None
    for b in batches:
        for p, guest, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held is not None and held[0] == p:
                yield held[1], held[2], text
            held = None if guest else (p, doc_id, text)


def edit(text: str, after: str) -> tuple[str, str]:
    """A text whose last n // 2 code points give way to the first n // 2 (or all) of the next one's, and its SHA-256."""
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    return edited, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()


def edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256) of pair_fingerprints() alone: the same pairs and edits, without prefix arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, text, after in neighbours(batches):
            rows.append((doc_id, len(text), edit(text, after)[1]))
            if len(rows) >= 2000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return with_next(docs, run, "doc_id long, n_chars long, edited_sha256 string")


def pair_fingerprints(docs: DataFrame, span: int = SPAN, keep: int = KEEP) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, same_start).

    The edited text is the text whose last n // 2 code points give way to the
    first n // 2 (or all) of the next document's.  near_edited, near_next: the
    text's span_likeness to its edited text and to the next document.
    same_start: code points from the start that the first two share.  Null text: empty.  Rows
    without a doc_id come last; rows with the same doc_id go by a hash of their
    text.  An only document is its own next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], ("", None)
        for doc_id, text, after in neighbours(batches):
            own = last[1] if last[1] is not None and last[0] == text else PrefixHash(text)
            nxt = own if after == text else PrefixHash(after)
            last = (after, nxt)
            edited, digest = edit(text, after)
            ed = PrefixHash(edited)
            a, e = own.fingerprint(span, keep), ed.fingerprint(span, keep)
            rows.append((doc_id, len(text), digest, a, e, span_likeness(own, ed, span), span_likeness(own, nxt, span), longest_common_extension(own, 0, ed, 0)))
            if len(rows) >= 2000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return with_next(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_start long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of all columns, or of the first few."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_start"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names[: len(rows[0])])
