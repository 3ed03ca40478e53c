"""Packing by vector bin packing: the dot-product heuristic under limits on tokens, segments and loss-bearing tokens.

Documents are tokenized where they are read and cut into full sequences; what is left of each, shorter than a
sequence, waits in a bounded lot. From the lot one sequence after the other is filled: always the piece
with the largest dot product of its demand (tokens, segment, loss-bearing tokens) and the room left, as
long as one fits; then the longest piece that remains is cut to close the gap. The last, partly filled sequence of
a partition is written as sequences whose lengths are powers of two, which need no padding. Nothing is
shuffled and no group is formed, so skew has no effect and a lost task is simply run again.

Defined cases: a null or empty text is the end id alone; equal rows are packed as documents of their own; a column
``prompt_ids`` (optional; null: 0) counts leading ids that bear no loss; no rows in, no rows out. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import batch
from colscope.llm.words import blocks

END = 0
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "loss_tokens bigint, ids binary"
)
_OUT = pa.schema([*((c, pa.int64()) for c in SCHEMA.replace(" bigint", "").split(", ")[:-1]), ("ids", pa.binary())])


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 1024
    segments: int = 128
    loss: int = 1024
    # Shorter gaps are padded: no piece is cut shorter than this.
    least_cut: int = 4
    # Pieces a task holds back to choose from.
    lot: int = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoding(path: str):
    """The byte-level BPE of a ``tokenizers`` file as an encoder that yields NumPy ids (equal ids, several times faster)."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    as_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(as_byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    import public_tokenizers

    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(path: str, text: str) -> np.ndarray:
    return _encoding(path).encode_to_numpy(text, allowed_special="all")


class _Packer:
    """Fills sequences; ``out`` collects (doc, start, length, doc tokens, sequence, offset, loss, ids)."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.sequence, self.out, self.waiting = limits, first_sequence, [], []

    def place(self, piece, room: np.ndarray) -> None:
        doc, start, total, prompt, ids = piece
        loss = len(ids) - min(max(prompt - start, 0), len(ids))
        offset = self.limits.tokens - int(room[0])
        self.out.append((doc, start, len(ids), total, self.sequence, offset, loss, ids.tobytes()))
        room -= (len(ids), 1, loss)

    def add(self, doc, ids: np.ndarray, prompt: int) -> None:
        most = min(self.limits.tokens, self.limits.loss)
        at = 0
        while len(ids) - at >= most:
            self.place((doc, at, len(ids), prompt, ids[at : at + most]), self.room())
            self.sequence += 1
            at += most
        if at < len(ids):
            self.waiting.append((doc, at, len(ids), prompt, ids[at:]))

    def room(self) -> np.ndarray:
        return np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=np.int64)

    def fill(self, until: int) -> None:
        """Fill sequences from the waiting pieces until at most ``until`` are left."""
        pieces, self.waiting = self.waiting, []
        most = self.room().astype(float)
        length = np.array([len(p[4]) for p in pieces], dtype=np.int64)
        loss = np.array([len(p[4]) - min(max(p[3] - p[1], 0), len(p[4])) for p in pieces], dtype=np.int64)
        left = len(pieces)
        while left > until:
            room = self.room()
            while left and room[1] and room[0]:
                fits = (length > 0) & (length <= room[0]) & (loss <= room[2])
                gain = length * (room[0] / most[0] ** 2) + loss * (room[2] / most[2] ** 2) + room[1] / most[1] ** 2
                best = int(np.argmax(np.where(fits, gain, -1.0)))
                if not fits[best]:
                    break
                self.place(pieces[best], room)
                length[best], left = 0, left - 1
            gap = int(min(room[0], room[2]))
            if left and room[1] and gap >= self.limits.least_cut:
                longest = int(np.argmax(length))
                doc, start, total, prompt, ids = pieces[longest]
                gap = min(gap, len(ids))
                self.place((doc, start, total, prompt, ids[:gap]), room)
                pieces[longest] = (doc, start + gap, total, prompt, ids[gap:])
                length[longest] -= gap
                loss[longest] = length[longest] - min(max(prompt - start - gap, 0), int(length[longest]))
                left -= length[longest] == 0
            if not left and room[0]:
                self.in_powers()
            self.sequence += 1
        self.waiting = [p for p, n in zip(pieces, length, strict=True) if n]

    def in_powers(self) -> None:
        """Cut the last sequence into sequences whose lengths are powers of two."""
        last = next((i for i, p in enumerate(self.out) if p[4] == self.sequence), len(self.out))
        pieces, self.out = self.out[last:], self.out[:last]
        total = sum(p[2] for p in pieces)
        for power in (1 << i for i in reversed(range(total.bit_length())) if total >> i & 1):
            offset = 0
            while offset < power:
                doc, start, n, tokens, _, _, loss, raw = pieces[0]
                take = min(n, power - offset)
                rest = min(loss, n - take)  # what bears no loss comes first
                self.out.append((doc, start, take, tokens, self.sequence, offset, loss - rest, raw[: 4 * take]))
                pieces[0] = (doc, start + take, n - take, tokens, 0, 0, rest, raw[4 * take :])
                if take == n:
                    pieces.pop(0)
                offset += take
            self.sequence += 1

    def flush(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return batch(_OUT, *(list(c) for c in zip(*rows, strict=True)))


def pack(documents: DataFrame, tokenizer: str | None = None, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, loss_tokens, ids (little-endian 32 bit).

    ``tokenizer`` is the path of a byte-level BPE file for ``tokenizers`` that the executors can read.
    """
    prompt = F.col("prompt_ids") if "prompt_ids" in documents.columns else F.lit(0)
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(prompt, F.lit(0)).cast("bigint").alias("prompt_ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer or default_tokenizer()
        end = np.array([END], dtype=np.uint32)
        packer = _Packer(limits, TaskContext.get().partitionId() << 40)
        for b in batches:
            for part in blocks(b):
                docs, texts, prompts = (part.column(i).to_pylist() for i in range(3))
                for doc, text, prompt_ids in zip(docs, texts, prompts, strict=True):
                    packer.add(doc, np.concatenate([encode(path, text or ""), end]), prompt_ids)
                    if len(packer.waiting) >= limits.lot:
                        packer.fill(limits.lot // 2)
                if packer.out:
                    yield packer.flush()
        packer.fill(0)
        if packer.out:
            yield packer.flush()

    return rows.mapInArrow(run, SCHEMA)
