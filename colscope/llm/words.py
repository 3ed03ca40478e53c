"""Words of Arrow text columns as NumPy offsets and 64-bit hashes, a bounded block of bytes at a time.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 keeps these bytes out of every longer
character, so the byte view and the character view agree. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at once; a longer text is a block of its own.
BLOCK = 4 << 20
# Bytes hashed at once: the temporary arrays stay in the processor's cache.
HASH_BLOCK = 1 << 17

_SPACES = [0x20, *range(0x09, 0x0E)]
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[_SPACES] = False
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


mix = _mix


def _byte_values(fold: bool, seed: int) -> np.ndarray:
    code = np.arange(256, dtype=np.uint64)
    if fold:
        code[65:91] += np.uint64(32)
    return _mix(code + np.uint64(1 + 1000 * seed))


_VALUES = {(fold, seed): _byte_values(fold, seed) for fold in (False, True) for seed in (0, 1)}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = [_powers(_ODD, HASH_BLOCK + 4096), _powers(_ODD_INVERSE, HASH_BLOCK + 4096)]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most ``limit`` bytes together, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, first = np.cumsum(sizes.astype(np.int64)), 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last
    pa.default_memory_pool().release_unused()  # the executor's other tasks share what a worker keeps


class Words:
    """Where the words of a text column begin and end; ``first[i]:first[i + 1]`` are the words of text ``i``."""

    def __init__(self, texts: pa.Array):
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32) if len(texts) else np.zeros(1, int)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2] if len(texts) else None
        self.data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        inside = IN_WORD[self.data]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.offsets] = True
        after_space = np.ones(len(inside), dtype=bool)
        after_space[1:] = ~inside[:-1]
        before_space = np.ones(len(inside), dtype=bool)
        before_space[:-1] = ~inside[1:]
        self.starts = np.flatnonzero(inside & (after_space | edge[:-1]))
        self.ends = np.flatnonzero(inside & (before_space | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text every word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, fold: bool, seed: int = 0) -> np.ndarray:
        """One 64-bit hash per word; ``fold`` reads A-Z as a-z."""
        out, values, first = np.empty(len(self.starts), dtype=np.uint64), _VALUES[fold, seed], 0
        while first < len(out):
            base = self.starts[first]
            last = max(first + 1, int(np.searchsorted(self.ends, base + HASH_BLOCK, side="right")))
            size = int(self.ends[last - 1] - base)
            if size > len(_POWERS[0]):
                up, down = _powers(_ODD, size), np.ones(1, dtype=np.uint64)  # one word longer than a block
            else:
                up, down = _POWERS
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(values[self.data[base : base + size]] * up[:size], out=sums[1:])
            a, b = self.starts[first:last] - base, self.ends[first:last] - base
            out[first:last] = _mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _STEP)
            first = last
        return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values, in their order; shorter than ``h`` by ``k - 1``."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    n, power, span, done, out = len(h), h, 1, 0, None
    weight = int(_STEP) | 1
    while span <= k:
        if k & span:
            part = power[done : done + n - k + 1]
            factor = np.uint64(pow(weight, span, 1 << 64))
            out = part if out is None else out * factor + part
            done += span
        if span * 2 <= k:
            power = power[: len(power) - span] * np.uint64(pow(weight, span, 1 << 64)) + power[span:]
        span *= 2
    return _mix(out)


def sliding_min(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every ``k`` consecutive values, and where it stands first."""

    def lesser(left, left_at, right, right_at):
        take = right < left
        return np.where(take, right, left), np.where(take, right_at, left_at)

    n, span, low, at = len(values) - k + 1, 1, values, np.arange(len(values))
    while span * 2 <= k:
        low, at = lesser(low[:-span], at[:-span], low[span:], at[span:])
        span *= 2
    last = k - span
    return lesser(low[:n], at[:n], low[last : last + n], at[last : last + n])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
