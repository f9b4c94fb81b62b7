"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events: a `message` opens a turn, a `delta` appends to
the newest turn, an `edit` replaces the text of the turn it names, and a
`regenerate` drops that turn and all with higher numbers.  The log is dealt by
conversation and sorted by sequence, the newest event first, so that a turn is
final when its message is met: what came later is known by then.  Folding thus
streams, holding the deltas of one turn and the edits still to be applied.

Template, per turn:  \\n### Role: text </turn>
Inside a text each backslash gets one more, as does each `#` or `<` that could
begin a control string, so no text can hold a marker and unescaping gives the
text back.  The loss mask covers exactly the text of assistant turns.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "### ", ": ", " </turn>\n"
_RISKY = re.compile(r"\\|#|<|:")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _RISKY.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's output and the span in it that the loss covers (empty for other roles)."""
    body = escape(text)
    head = OPEN + escape(role) + MID
    covered = len(body) if role == "assistant" else 0
    return head + body + CLOSE, len(head), len(head) + covered


def parse_turns(output: str) -> list[tuple[str, str]]:
    """Formatted output -> (role, text) of its turns; raises if it isn't well formed."""
    turns, at = [], 0
    while at < len(output):
        if not output.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        mid = output.find(MID, at)
        while mid > 0 and _slashes(output, mid) % 2:
            mid = output.find(MID, mid + 1)
        end = output.find(CLOSE, mid + len(MID))
        while end >= 0 and _slashes(output, end + 1) % 2:
            end = output.find(CLOSE, end + 1)
        if mid < 0 or end < 0:
            raise ValueError(f"open turn at {at}")
        turns.append((unescape(output[at + len(OPEN) : mid]), unescape(output[mid + len(MID) : end])))
        at = end + len(CLOSE)
    return turns


def _slashes(s: str, at: int) -> int:
    n = 0
    while at - n - 1 >= 0 and s[at - n - 1] == "\\":
        n += 1
    return n


Event = tuple[str, int | None, str, str]


class _Turn:
    """One turn's text while later events, in order, go over it."""

    def __init__(self, turn: int | None, role: str, text: str):
        self.turn, self.role, self.pieces, self.alive = turn, role, [text], True

    def takes(self, event: str, turn: int | None, text: str) -> None:
        if event == "delta":
            self.pieces.append(text)
        elif event == "edit" and turn == self.turn:
            self.pieces = [text]
        elif event == "regenerate" and turn is not None and self.turn is not None and turn <= self.turn:
            self.alive = False


def fold(events: Iterable[Event]) -> Iterator[tuple[int | None, str, str]]:
    """Events (event, turn, role, text) from the newest to the oldest -> final (turn, role, text), the newest first.

    A delta with no turn before it opens one.  Edits and regenerations of turns
    that aren't there do nothing; a turn without a number is never dropped.
    """
    later: list[Event] = []  # since the last final turn, the newest first
    edits: dict[int | None, str] = {}  # of what came after that, the newest of each turn
    least: int | None = None

    def settle(event: Event) -> tuple[int | None, str, str] | None:
        nonlocal later, least
        own = _Turn(event[1], event[2], event[3])
        gone = least is not None and own.turn is not None and own.turn >= least
        newest = edits.get(own.turn)
        for k in range(len(later) - 1, -1, -1):
            own.takes(later[k][0], later[k][1], later[k][3])
            if not own.alive:  # its deltas are gone, newer ones go to an older turn
                later = later[: k + 1] + [x for x in later[k + 1 :] if x[0] != "delta"]
                return None
        for kind, turn, _, text in later:
            if kind == "edit":
                edits.setdefault(turn, text)
            elif kind == "regenerate" and turn is not None:
                least = turn if least is None else min(least, turn)
        later = []
        return None if gone else (own.turn, own.role, "".join(own.pieces) if newest is None else newest)

    for e in events:
        if e[0] in ("delta", "edit", "regenerate"):
            later.append(e)
        elif (done := settle(e)) is not None:
            yield done
    while (k := next((k for k in range(len(later) - 1, -1, -1) if later[k][0] == "delta"), None)) is not None:
        first, later = later[k], later[:k]
        if (done := settle(first)) is not None:
            yield done


def turns(log: DataFrame) -> DataFrame:
    """Log (conv_id, turn, role, text[, event, seq]) -> (conv_id, at, role, output, loss_start, loss_end), a row per final turn.

    Without `event` each row is a message, in order of turn; with it rows go by
    `seq`.  Ties go by role and then text; repeated rows are turns of their own.
    Null text or role: empty.  Null turns come first.  Rows with a null conv_id
    make one conversation, null; a null event is a message.  `at` orders a
    conversation's turns, the last has -1.
    """
    events = "event" in log.columns
    d = log.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("event").cast("string"), F.lit("message")).alias("event") if events else F.lit("message").alias("event"),
        F.col("seq" if events else "turn").cast("long").alias("seq"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for conv, own in itertools.groupby(rows(batches), key=lambda r: r[0]):
            for at, (_, role, text) in enumerate(fold((event, turn, role, text) for _, event, _, turn, role, text in own)):
                out.append((conv, -1 - at, role, *render_turn(role, text)))
                size += len(text)
                if len(out) >= 5000 or size >= 1 << 22:
                    yield _turn_batch(out)
                    out, size = [], 0
        if out:
            yield _turn_batch(out)

    newest = [F.col(c).desc_nulls_last() for c in ("seq", "turn", "role", "text")]
    return d.repartition("conv_id").sortWithinPartitions("conv_id", *newest).mapInArrow(run, "conv_id long, at long, role string, output string, loss_start int, loss_end int")


def _turn_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "at", "role", "output", "loss_start", "loss_end"])


def format_chats(log: DataFrame) -> DataFrame:
    """The whole output of each conversation: (conv_id, output, loss) with loss as spans (start, end) of its code points.

    For conversations that fit a row; turns() has the same output in pieces.
    """
    t = turns(log).withColumn("n", F.length("output"))
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "output", "n", "loss_start", "loss_end"))).alias("t"))
    ends = F.expr("transform(sequence(0, size(t) - 1), k -> aggregate(slice(t, 1, k), 0L, (a, x) -> a + x.n))")
    spans = F.filter(F.arrays_zip("t", ends.alias("o")), lambda x: x["t"]["loss_end"] > x["t"]["loss_start"])
    return rows.withColumn("spans", spans).select("conv_id", F.concat_ws("", F.transform("t", lambda x: x["output"])).alias("output"), F.transform("spans", lambda x: F.struct((x["o"] + x["t"]["loss_start"]).alias("start"), (x["o"] + x["t"]["loss_end"]).alias("end"))).alias("loss"))


def digest(t: DataFrame) -> DataFrame:
    """What the output says when it is read back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    t: pieces of turns().  A conversation's pieces go through one task in order,
    as the hashes are sequential, but only one piece is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = object(), None, []

        def close() -> None:
            if state is not None:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, _, piece, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv != now or state is None:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_turns(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                masked = unescape(piece[lo:hi])
                state[2] += len(masked)
                state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if out:
                yield _digest_batch(out)
                out.clear()
        close()
        if out:
            yield _digest_batch(out)

    pieces = t.select("conv_id", "at", "output", "loss_start", "loss_end")
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
