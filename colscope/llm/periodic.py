"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words with smallest period q that no neighbouring word extends keeping that period. Its rightmost
square, words i to i + 2q, is a branching tandem: the suffixes i and i + q have exactly q words in common. Per block of
texts the suffix array is built by prefix doubling; the ranks of every doubling are kept, and tell common prefixes as well as
common endings. For each LCP interval of depth q, cut at its boundaries into two halves, every suffix i of the
smaller half asks the inverse suffix array whether i + q or i - q stands in the other half: n log n questions, all in array
operations, no tree is built. The squares found are rotated to the left as far as they go, which gives whole runs; of runs
over the same words the smallest period counts.

A word's number is its own in each text, so that texts of a block never meet. Nothing is shuffled; a lost task is run again.

Words are told apart by 64-bit hashes within a text. Defined cases: a null text has no words; texts without runs have an
empty list; equal rows are rows of their own; a text of any length is handled whole (some 30 integers a word while it is);
no rows in, no rows out. Other columns are carried through inside ``document``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.words import Words, blocks, mix

# A run holds so many words at least, and so many periods.
LEAST, PERIODS = 6, 4
# Bytes of text handled together; suffixes asked at once.
TEXT_BLOCK, QUESTIONS = 1 << 20, 1 << 20


def word_numbers(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words of one text only."""
    return mix(h ^ mix(text.astype(np.uint64) + np.uint64(1)))


def suffix_ranks(values: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... values; equal ranks only for as many equal values.

    ``end`` is where the text of each position ends. A rank is the place of the first suffix of its kind in the suffix
    array. The last array tells all suffixes apart: it is the inverse suffix array.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = place
    levels, step = [rank], 1
    last = np.ones(n, dtype=bool)
    last[:-1] = new[1:]
    active = order[~(new & last)]
    while len(active):
        rank = levels[-1]
        after = active + step
        inside = after < end[active]
        following = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[active] << 32 | following
        sort = np.argsort(key, kind="stable")
        active, key = active[sort], key[sort]
        own = key >> 32
        at = np.arange(len(key))
        group, kind = np.ones(len(key), dtype=bool), np.ones(len(key), dtype=bool)
        group[1:], kind[1:] = own[1:] != own[:-1], key[1:] != key[:-1]
        begins = np.maximum.accumulate(np.where(group, at, 0))
        kinds = np.maximum.accumulate(np.where(kind, at, 0))
        rank = rank.copy()
        rank[active] = own + kinds - begins
        levels.append(rank)
        last = np.ones(len(key), dtype=bool)
        last[:-1] = kind[1:]
        active, step = active[~(kind & last)], step * 2
    return levels


def common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """LCP of every suffix with the one before it in the suffix array; 0 for the first."""
    n = len(order)
    lcp = np.zeros(n, dtype=np.int64)
    first = levels[0][order]
    k = np.flatnonzero(first[1:] == first[:-1]) + 1
    a, b, found = order[k - 1], order[k], np.zeros(len(k), dtype=np.int64)
    for m in range(len(levels) - 1, -1, -1):
        level = np.append(levels[m], -1)  # behind the last text; only one of two suffixes gets there
        same = level[np.minimum(a + found, n)] == level[np.minimum(b + found, n)]
        found += same.astype(np.int64) << m
    lcp[k] = found
    return lcp


def halves(lcp: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the boundaries ``k``: where the left half begins and the right half ends. Boundaries deeper than k belong to
    the left half, those at least as deep to the right one: any two suffixes are parted by one boundary."""
    n, depth = len(lcp), lcp[k]
    positive = np.concatenate([[0], (lcp > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(positive))
    longest = int((edge[1::2] - edge[::2]).max()) if len(edge) else 1
    least = [lcp]
    while 2 << len(least) <= 2 * longest:
        span = 1 << (len(least) - 1)
        before = least[-1]
        least.append(np.minimum(before[:-span], before[span:]) if len(before) > span else before[:0])
    left, right = k.copy(), k + 1
    for j in range(len(least) - 1, -1, -1):
        span, low = 1 << j, least[j]
        if not len(low):
            continue
        go = (left >= span) & (low[np.clip(left - span, 0, len(low) - 1)] > depth)
        left -= go * span
        go = (right + span <= n) & (low[np.minimum(right, len(low) - 1)] >= depth)
        right += go * span
    return left - 1, right


def branching_squares(levels: list[np.ndarray], words: np.ndarray, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares that no longer hold one word further on; ``words`` is the length of the text at each
    position: a period longer than its ``periods``-th part cannot make a run."""
    rank = levels[-1]
    n = len(rank)
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    lcp = common_prefixes(levels, order)
    k = np.flatnonzero((lcp > 0) & (lcp * periods <= words[order]))
    if not len(k):
        return k, k
    left, right = halves(lcp, k)
    small_left = k - left <= right - k
    begin, size = np.where(small_left, left, k), np.where(small_left, k - left, right - k)
    other, other_end = np.where(small_left, k, left), np.where(small_left, right, k)
    depth, total = lcp[k], np.cumsum(size)
    starts, found, at = [], [], 0
    while at < len(k):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + QUESTIONS, side="right")))
        count = size[at:to]
        of = np.repeat(np.arange(at, to), count)
        i = order[np.arange(len(of)) - np.repeat(total[at:to] - count - done, count) + begin[of]]
        q, low, high = depth[of], other[of], other_end[of]
        for j, square in ((i + q, i), (i - q, i - q)):
            near = rank[np.clip(j, 0, n - 1)]
            hit = np.flatnonzero((j >= 0) & (j < n) & (near >= low) & (near < high))
            starts.append(square[hit])
            found.append(q[hit])
        at = to
    return np.concatenate(starts), np.concatenate(found)


def runs(values: np.ndarray, first: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in the texts ``first[t]:first[t + 1]`` of ``values``, by start, then period.

    ``values`` must not be shared by two texts; starts count from the first value of all.
    """
    nothing = np.zeros(0, dtype=np.int64)
    if not len(values):
        return nothing, nothing, nothing
    sizes = np.diff(first)
    levels = suffix_ranks(values, np.repeat(first[1:], sizes))
    start, period = branching_squares(levels, np.repeat(sizes, sizes), periods)
    end = start + 2 * period  # rotating to the left leaves the end where it is
    for m in range(len(levels) - 1, -1, -1):
        span, level = 1 << m, levels[m]
        back, ahead = start - span, start + period - span
        go = (back >= 0) & (level[np.maximum(back, 0)] == level[np.maximum(ahead, 0)])
        start = start - go * span
    length = end - start
    long = np.flatnonzero(length >= np.maximum(least, periods * period))
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the stretches."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of every text, with one space between them."""
    kept = np.flatnonzero(keep)
    sizes = words.ends[kept] - words.starts[kept]
    of = words.text_of()[kept]
    last = np.ones(len(kept), dtype=bool)
    last[:-1] = of[1:] != of[:-1]
    wide = sizes + ~last  # every word but a text's last one has a space behind it
    begin = np.cumsum(wide) - wide
    out = np.full(int(wide.sum()), 32, dtype=np.uint8)
    shift = np.repeat(words.starts[kept] - begin, sizes)
    place = np.arange(int(sizes.sum())) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    out[place] = words.data[place + shift]
    texts = len(words.first) - 1
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, weights=wide, minlength=texts).astype(np.int64))])
    return pa.Array.from_buffers(pa.large_string(), texts, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.string())


def periodic_runs(documents: DataFrame, columns: list[str] | None = None, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """``document`` (a struct of ``columns``, by default all but the text), n_words, runs (start, length, period; by start, then
    period) and collapsed: the words without those that a run holds after its first period, joined by spaces."""
    carried = [c for c in documents.columns if c != "text"] if columns is None else columns
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("document"), "text")
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    shape = rows.select("document", F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast(kind).alias("runs"),
                        F.lit("").alias("collapsed")).schema
    fields = ["start", "length", "period"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, limit=TEXT_BLOCK):
                words = Words(part.column("text"))
                numbers = word_numbers(words.hashes(False), words.text_of())
                start, length, period = runs(numbers, words.first, least, periods)
                keep = ~covered(len(words), start + period, start + length)
                first = np.searchsorted(start, words.first)
                inside = start - words.first[np.searchsorted(words.first, start, side="right") - 1]
                structs = pa.StructArray.from_arrays([pa.array(c) for c in (inside, length, period)], fields)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), structs)
                columns_ = [part.column("document"), pa.array(words.counts().astype(np.int64)), lists, joined(words, keep)]
                yield pa.RecordBatch.from_arrays(columns_, ["document", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, shape)
