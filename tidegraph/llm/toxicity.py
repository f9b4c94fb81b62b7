"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence scores p = sigmoid(b + sum of its
distinct words' weights, each word's beginnings with it); the document scores 1 - prod(1 - p), a noisy-or, so one
offending sentence is enough.  Weights are fitted to document labels alone
(Adam on the log loss, an L1 pull towards zero), and the sentence scores then say
where the offence stands.

Training reads at most `max_documents` labelled rows, those of least hash of
their doc_id; this bound is the only sample, every document is scored whole.
Their features are counted on the executors; the driver gets the kept features
and, for each sentence that has any, their numbers.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.storage import stage

MAX_DOCUMENTS = 12000
#: Words of a task whose features are remembered.
CACHED_WORDS = 200_000
_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text.lower()) if s.strip()]


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the doc_id as text, mod 4, is 2."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def features(word: str) -> list[str]:
    """A word and its beginnings, so that other forms of an offending stem count as well."""
    return [word + "$", *(word[:k] for k in range(3, min(len(word), 7) + 1))]


def _softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def __post_init__(self):
        self._known: dict[str, frozenset[str]] = {}

    def _weighted(self, word: str) -> frozenset[str]:
        """The features of a word that have a weight; the table of words met is begun anew when it is large."""
        if len(self._known) >= CACHED_WORDS:
            self._known.clear()
        own = self._known[word] = frozenset(f for f in features(word) if f in self.weights)
        return own

    def sentence_logit(self, sentence: str) -> float | None:
        """None: nothing in it has a weight, its score is that of the bias."""
        known, found = self._known, frozenset()
        for w in _WORD.findall(sentence):
            own = known.get(w)
            if own is None:
                own = self._weighted(w)
            if own:
                found |= own
        return self.bias + math.fsum(self.weights[f] for f in found) if found else None

    def sentence_scores(self, text: str) -> list[float]:
        logits = [self.sentence_logit(s) for s in sentences(text)]
        return [-math.expm1(-_softplus(self.bias if z is None else z)) for z in logits]

    def score(self, text: str | None) -> float:
        """Noisy-or over all sentences; a text without sentences scores 0."""
        logits = [self.sentence_logit(s) for s in sentences(text or "")]
        quiet = logits.count(None) * _softplus(self.bias) + sum(_softplus(z) for z in logits if z is not None)
        return min(1.0, max(0.0, -math.expm1(-quiet)))

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[str, float]]:
        """Sentences that score at least `least`, in order."""
        text = text or ""
        return [(s.strip(), p) for s, p in zip(sentences(text), self.sentence_scores(text), strict=True) if p >= least]


def count_features(rows: Iterable[tuple[str | None, int]], most: int = 200_000) -> Iterator[dict[str, list[int]]]:
    """(text, label) -> tables: feature -> [documents of label 1, of label 0] that hold it; a new one when a table is large."""
    counts: dict[str, list[int]] = {}
    for text, label in rows:
        for f in {f for w in set(_WORD.findall((text or "").lower())) for f in features(w)}:
            counts.setdefault(f, [0, 0])[1 - label] += 1
        if len(counts) >= most:
            yield counts
            counts = {}
    yield counts


def encode(text: str | None, vocab: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """A text's sentences without kept features (their number), and for the others the features' numbers, end to end, and how many each has."""
    plain, own, sizes = 0, [], []
    for s in sentences(text or ""):
        found = {vocab[f] for w in set(_WORD.findall(s)) for f in features(w) if f in vocab}
        if found:
            own += sorted(found)
            sizes.append(len(found))
        else:
            plain += 1
    return plain, own, sizes


def descend(y: np.ndarray, plain: np.ndarray, own: np.ndarray, s_of: np.ndarray, d_of: np.ndarray, n_words: int, rounds: int = 200, rate: float = 0.1, l1: float = 1e-4) -> tuple[float, np.ndarray]:
    """Bias and weights by Adam on the log loss of the noisy-or.

    Feature own[i] stands in sentence s_of[i], sentence k in document d_of[k];
    plain: a document's sentences without features.
    """
    n_s = len(d_of)
    theta, bias = np.zeros(n_words), -6.0
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for step in range(1, rounds + 1):
        g = gradient(theta, bias, y, plain, own, s_of, d_of, n_s)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        theta = theta - move[:-1]
        theta = np.sign(theta) * np.maximum(np.abs(theta) - rate * l1, 0)
        bias -= move[-1]
    return float(bias), theta


def gradient(theta: np.ndarray, bias: float, y: np.ndarray, plain: np.ndarray, own: np.ndarray, s_of: np.ndarray, d_of: np.ndarray, n_s: int) -> np.ndarray:
    """Of the mean log loss, by weights and then the bias."""
    z = bias + np.bincount(s_of, theta[own], n_s)
    quiet = np.bincount(d_of, np.logaddexp(0, z), len(y)) + plain * np.logaddexp(0, bias)  # -log of the chance that no sentence offends
    doc = np.maximum(-np.expm1(-quiet), 1e-9)
    pull = (doc - y) / doc / len(y)
    grad_z = pull[d_of] / (1 + np.exp(-z))
    return np.append(np.bincount(own, grad_z[s_of], len(theta)), grad_z.sum() + (plain * pull).sum() / (1 + np.exp(-bias)))


def _picked(docs: DataFrame, labels: DataFrame, max_documents: int) -> DataFrame:
    """(doc_id, text, label) of the rows to learn from, staged."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents).select("doc_id", (F.col("toxic") > 0).cast("int").alias("label"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(spark, own.join(F.broadcast(chosen), "doc_id"), "labelled", tidy=True)  # chosen: max_documents rows at most


def train(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, most: int = 2000, min_docs: int = 3, keep: float = 0.05) -> Model:
    """Fit on labelled documents that aren't held out.

    Of several labels of one doc_id the highest counts; null labels and ids don't.
    Features: the `most` that speak loudest for label 1 by documents (log odds over
    1 times the root of their count).  Without both labels: the rate of label 1,
    no words.
    """
    spark = docs.sparkSession
    picked = _picked(docs, labels, max_documents)
    totals = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        p = min(max(float(n1 > 0), 1e-3), 1 - 1e-3)
        return Model(math.log(p / (1 - p)), {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for table in count_features(rows):
            yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array([c[0] for c in table.values()], pa.int64()), pa.array([c[1] for c in table.values()], pa.int64())], ["f", "pos", "neg"])

    counts = picked.select("text", "label").mapInArrow(count, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
    loud = counts.where(F.col("pos") >= min_docs).withColumn("odds", odds).where("odds > 1").orderBy((F.col("odds") * F.sqrt("pos")).desc(), "f").limit(most)
    vocab = {r["f"]: k for k, r in enumerate(loud.select("f").collect())}
    shared = spark.sparkContext.broadcast(vocab)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [encode(t, shared.value) for t in b.column(1).to_pylist()]
            packed = [pa.array([np.array(r[k], np.int32).tobytes() for r in rows], pa.binary()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r[0] for r in rows], pa.int64()), *packed], ["doc_id", "label", "plain", "own", "sizes"])

    got = picked.mapInArrow(read, "doc_id long, label int, plain long, own binary, sizes binary").orderBy("doc_id", "plain", "own", "sizes").toArrow()
    own = np.frombuffer(b"".join(got.column("own").to_pylist()), np.int32)
    sizes = [np.frombuffer(x, np.int32) for x in got.column("sizes").to_pylist()]
    d_of = np.repeat(np.arange(len(sizes), dtype=np.int32), [len(x) for x in sizes])
    s_of = np.repeat(np.arange(len(d_of), dtype=np.int32), np.concatenate(sizes))
    bias, theta = descend(got.column("label").to_numpy().astype(np.float64), got.column("plain").to_numpy().astype(np.float64), own, s_of, d_of, len(vocab))
    return Model(bias, {f: float(theta[k]) for f, k in vocab.items() if abs(theta[k]) > keep})


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, text) -> (doc_id, held_out, score, predicted, worst_sentence): one row per row, whole texts.

    The score depends on the text alone.  Null and empty texts score as a text
    without sentences: 0.  worst_sentence: the highest-scoring sentence of a
    predicted document.  A null doc_id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            s = np.array([m.score(t) for t in texts], np.float64)
            worst = [max(zip(m.sentence_scores(t), sentences(t), strict=True))[1].strip() if p >= threshold and t and sentences(t) else None for t, p in zip(texts, s, strict=True)]
            held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(worst, pa.string())], ["doc_id", "held_out", "score", "predicted", "worst_sentence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, worst_sentence string")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores under the threshold, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
