"""Lexical retrieval packing.

Documents are tokenized once, in the task that reads them, and held in shards of
at most `shard_tokens` tokens.  A shard has an inverted BM25 index over its
documents' tokens.  Each unused document in turn is a seed: it opens or goes on
with a window, the index scores the shard's unused documents by all of the seed's
terms, and the whole ranked list fills the window greedily, first those that fit, then one that is cut and seeds the
next window with its rest.  Windows are thus full, all but the last of a task,
whose tokens are cut into powers of two, so nothing is padded.

Nothing is shuffled: shards are parts of the scan.  A task's memory is bounded by
a shard and its index, not by its input.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 1


@functools.lru_cache(maxsize=2)
def _encoder(table: str, pattern: str) -> Callable[[str], np.ndarray]:
    import tiktoken

    with open(table, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("table", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy


@functools.lru_cache(maxsize=2)
def _reference(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _added(path: str) -> tuple[str, ...]:
    """What the vocabulary adds to its ranks: strings that are one id each."""
    return tuple(t.content for t in _reference(path).get_added_tokens_decoder().values())


class Encoder:
    """ids of `tokenizers` for a vocabulary file, made with the same vocabulary's merge ranks where they are at hand.

    The ranks give the same ids several times faster; the first `compared` texts
    of each task are encoded both ways, and a difference is an error.  Texts that
    hold an added token are left to `tokenizers`.
    """

    def __init__(self, path: str, table: str | None = None, pattern: str | None = None, compared: int = 4):
        self.path, self.table, self.pattern, self.compared = path, table, pattern, compared

    def __call__(self, text: str) -> np.ndarray:
        if self.table is None or any(t in text for t in _added(self.path)):
            return np.array(_reference(self.path).encode(text, add_special_tokens=False).ids, np.uint32)
        ids = _encoder(self.table, self.pattern)(text)
        if self.compared:
            self.compared -= 1
            if _reference(self.path).encode(text, add_special_tokens=False).ids != ids.tolist():
                raise ValueError(f"{self.table} and {self.path} disagree")
        return ids


class Index:
    """Inverted BM25 index of one shard; terms are token ids."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        self.n = len(docs)
        terms, counts, owner = [], [], []
        for k, ids in enumerate(docs):
            t, c = np.unique(ids, return_counts=True)
            terms.append(t)
            counts.append(c)
            owner.append(np.full(len(t), k, np.int32))
        self.own = terms
        t, c, o = np.concatenate(terms), np.concatenate(counts).astype(np.float32), np.concatenate(owner)
        sizes = np.array([len(d) for d in docs], np.float32)
        order = np.argsort(t, kind="stable")
        t, c, self.doc = t[order], c[order], o[order]
        self.term, self.start = np.unique(t, return_index=True)
        self.start = np.append(self.start, len(t))
        df = np.diff(self.start)
        self.idf = np.log1p((self.n - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = k1 * (1 - b + b * sizes / max(sizes.mean(), 1))
        self.weight = (c * (k1 + 1) / (c + norm[self.doc])) * np.repeat(self.idf, df)
        self.df = df
        # terms of many documents have rows with a cell per document, at most 8 times the size of their postings
        often = np.flatnonzero(df * 8 > self.n)
        self.row = np.full(len(df), -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.n), np.float32)
        for k, a in enumerate(often):
            own = slice(self.start[a], self.start[a + 1])
            self.rows[k, self.doc[own]] = self.weight[own]

    def neighbours(self, seed: int, unused: np.ndarray, query_terms: int | None = None, most: int | None = None) -> np.ndarray:
        """Unused documents by score with all of the seed's terms (or its `query_terms` rarest shared ones), best first (the first `most`), ties to the first."""
        at = np.searchsorted(self.term, self.own[seed])
        at = at[self.df[at] > 1]
        if query_terms is not None and len(at) > query_terms:
            at = at[np.argsort(self.df[at], kind="stable")[:query_terms]]
        if not len(at):
            return np.empty(0, np.int64)
        row = self.row[at]
        rare = [slice(self.start[a], self.start[a + 1]) for a in at[row < 0].tolist()]
        score = self.rows[row[row >= 0]].sum(axis=0, dtype=np.float64)
        if rare:
            score += np.bincount(np.concatenate([self.doc[x] for x in rare]), np.concatenate([self.weight[x] for x in rare]), self.n)
        score[~unused] = 0
        score[seed] = 0
        hit = np.flatnonzero(score)
        return hit[np.lexsort((hit, -score[hit]))][:most]


class Packer:
    """Windows of `window` tokens from shards; what is left open goes on into the next shard."""

    def __init__(self, first_sequence: int, window: int):
        self.window = window
        self.sequence, self.filled = first_sequence, 0
        self.pending: list[tuple] = []
        self.rows: list[tuple] = []

    def _put(self, doc: tuple, start: int, length: int) -> None:
        """A piece of doc (id, ids) that fits the open window."""
        self.pending.append((doc[0], start, doc[1][start : start + length], len(doc[1])))
        self.filled += length
        if self.filled == self.window:
            self._emit(self.pending)
            self.pending, self.filled = [], 0

    def _emit(self, pieces: list[tuple]) -> None:
        """Pieces (id, start, ids, total) as one sequence."""
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4")), total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def _pour(self, doc: tuple) -> bool:
        """All of doc, cut where a window ends; whether the last window is still open."""
        at = 0
        while at < len(doc[1]):
            n = min(len(doc[1]) - at, self.window - self.filled)
            self._put(doc, at, n)
            at += n
        return self.filled > 0

    def shard(self, docs: list[tuple]) -> None:
        if not docs:
            return
        index = Index([d[1] for d in docs])
        unused = np.ones(len(docs), bool)
        sizes = np.array([len(d[1]) for d in docs])
        for first in range(len(docs)):
            if not unused[first]:
                continue
            seed: int | None = first
            while seed is not None:
                unused[seed] = False
                still_open, nxt = self._pour(docs[seed]), None
                if still_open:
                    near = index.neighbours(seed, unused)
                    for k in near[sizes[near] <= self.window - self.filled].tolist():
                        if sizes[k] <= self.window - self.filled:
                            unused[k] = False
                            self._pour(docs[k])
                            if not self.filled:
                                break
                    if self.filled:  # none left that fits: the best of the others is cut, and seeds the next window
                        rest = near[unused[near]]
                        nxt = int(rest[0]) if len(rest) else None
                seed = nxt

    def close(self) -> None:
        """The open window's tokens as sequences whose lengths are powers of two."""
        left, pieces = self.filled, self.pending
        self.pending, self.filled = [], 0
        while left:
            room, now = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc_id, start, ids, total = pieces.pop(0)
                now.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    pieces.insert(0, (doc_id, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self._emit(now)


def pack(docs: DataFrame, encode: Callable[[str], np.ndarray], window: int = 2048, shard_tokens: int = 1_500_000) -> DataFrame:
    """(doc_id, text) -> a row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids are encode(text) and the end id; null texts are empty.  Each
    id lies in one piece.  Null and repeated doc_ids are packed like others, a
    piece's row telling its place only by what it holds.  An empty table gives
    no rows.  sequence_id is unique over all tasks; offsets are gapless from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 36, window)
        held: list[tuple] = []
        size = 0
        end = np.array([END_ID], np.uint32)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end]).astype(np.uint32)
                held.append((doc_id, ids))
                size += len(ids)
                if size >= shard_tokens:
                    packer.shard(held)
                    held, size = [], 0
                    yield _rows(packer)
        packer.shard(held)
        packer.close()
        if packer.rows:
            yield _rows(packer)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _rows(packer: Packer) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*packer.rows, strict=True)) or [()] * len(names)
    packer.rows = []
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
