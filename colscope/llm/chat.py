"""Chat formatting from event logs: reconstruct each conversation, render it, and read it back.

Events have (conv_id, turn, seq, kind, role, text). The log is partitioned by conversation and read in order of
(turn, seq); folding needs the text of one message at a time, so a conversation of any length is streamed:

* ``message``     opens a message (several in one turn stay several messages),
* ``delta``       adds text to the open message of its turn (opens one if there is none),
* ``edit``        replaces the text of the open message,
* ``regenerate``  discards the open message's text and everything said in later turns up to that moment.

The template writes a turn as ``<|turn|>role\\ntext<|end|>\\n``. Control strings inside texts, of this template and of
common others, are broken up by a backslash, backslashes are doubled; ``unescape`` undoes both.

Defined cases: a null text or role is empty; null conv_id, turn and seq are values that come first; equal rows are
messages of their own; ties of (turn, seq) go by kind, role, text; a turn whose message was discarded and not spoken
again is left out; unknown kinds raise; no rows in, no rows out. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import batch

BEGIN, END = "<|turn|>", "<|end|>\n"
# Control strings of public chat templates. Any "<|" is broken up too.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<|"]
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_TURN = re.compile(re.escape(BEGIN) + r"([^\n]*)\n(.*)" + re.escape(END), re.DOTALL)
LEARNED = "assistant"
KINDS = ["message", "delta", "edit", "regenerate"]

MESSAGES = "conv_id bigint, turn bigint, role string, text string"
SEGMENTS = "conv_id bigint, turn bigint, segment string, loss_start bigint, loss_end bigint"
READ = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)
_MESSAGES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
)
_READ = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)
# Rows that an output batch gathers, and characters.
_ROWS, _CHARS = 2_000, 4 << 20


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for begin in range(0, b.num_rows, _ROWS):
            yield from zip(*(c.to_pylist() for c in b.slice(begin, _ROWS).columns), strict=True)


def _gathered(rows: Iterator[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    out, chars = [], 0
    for row in rows:
        out.append(row)
        chars += len(row[text])
        if len(out) >= _ROWS or chars >= _CHARS:
            yield batch(schema, *(list(c) for c in zip(*out, strict=True)))
            out, chars = [], 0
    if out:
        yield batch(schema, *(list(c) for c in zip(*out, strict=True)))


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold event logs into final messages (conv_id, turn, role, text), in order within a conversation."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0))
    log = events.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("seq").cast("bigint").alias("seq"), rank.cast("int").alias("rank"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).filter(F.when(F.col("rank") > 0, True).otherwise(F.raise_error(F.lit("unknown kind of event")).cast("boolean")))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple]:
            place = conv = None
            role, parts, cut, cut_here = "", None, None, None
            for conv_id, turn, seq, rank, speaker, text in _rows(batches):
                if place != (conv_id, turn):
                    if parts is not None:
                        yield (*place, role, "".join(parts))
                    if place is None or conv != conv_id:
                        cut = cut_here = None
                    cut = cut_here if cut is None else cut if cut_here is None else max(cut, cut_here)
                    place, conv, role, parts, cut_here = (conv_id, turn), conv_id, speaker, None, None
                if cut is not None and (seq is None or seq <= cut):
                    continue  # said before an earlier turn was generated anew
                if rank == 1:
                    if parts is not None:
                        yield (*place, role, "".join(parts))
                    role, parts = speaker, [text]
                elif rank == 2:
                    if parts is None:
                        role, parts = speaker, []
                    parts.append(text)
                elif rank == 3:
                    role, parts = role if parts is not None else speaker, [text]
                else:
                    parts, cut_here = None, seq
            if parts is not None:
                yield (*place, role, "".join(parts))

        yield from _gathered(messages(), _MESSAGES, 3)

    order = ["conv_id", "turn", "seq", "rank", "role", "text"]
    return log.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(fold, MESSAGES)


def render(messages: DataFrame) -> DataFrame:
    """One row per turn, in order: the segment of the formatted conversation and the loss mask's span in it
    (code points from the conversation's beginning; null where the turn bears no loss).

    ``messages`` come as ``reconstruct`` leaves them: a conversation in one partition, in order.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segments() -> Iterator[tuple]:
            conv, at, begun = None, 0, False
            for conv_id, turn, role, text in _rows(batches):
                if not begun or conv_id != conv:
                    conv, at, begun = conv_id, 0, True
                head, body = f"{BEGIN}{_escape_role(role)}\n", escape(text)
                span = (at + len(head), at + len(head) + len(body)) if role == LEARNED else (None, None)
                yield (conv_id, turn, head + body + END, *span)
                at += len(head) + len(body) + len(END)

        yield from _gathered(segments(), _SEGMENTS, 2)

    return messages.mapInArrow(write, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and its mask alone: turns, digests, characters under the mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple]:
            conv, begun = None, False
            turns = loss = None
            n = chars = at = 0
            for conv_id, _, segment, loss_start, loss_end in _rows(batches):
                if not begun or conv_id != conv:
                    if begun:
                        yield (conv, n, turns.hexdigest(), chars, loss.hexdigest(), at)
                    conv, begun, turns, loss, n, chars, at = conv_id, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                role, body = _TURN.fullmatch(segment).groups()
                turns.update(f"{_unescape_role(role)}\n{unescape(body)}\n".encode())
                if loss_start is not None:
                    learned = unescape(segment[loss_start - at : loss_end - at])
                    loss.update(learned.encode())
                    chars += len(learned)
                n, at = n + 1, at + len(segment)
            if begun:
                yield (conv, n, turns.hexdigest(), chars, loss.hexdigest(), at)

        yield from _gathered(conversations(), _READ, 2)

    return segments.mapInArrow(read, READ)
