"""Set similarity join: pairs of sets whose Jaccard index reaches a threshold, exactly.

Equal sets are collapsed first, so any number of copies is one item. Elements are ordered from rare to frequent, by how many
occurrences fall in their bucket of ``BUCKETS``: any order common to all sets will do, and this one needs no join. Two sets that
reach the threshold must share an element among their first ``size - ceil(t*size) + 1``, and only sets whose sizes
allow the threshold meet: bands of sizes are part of the key. The first element two sets share bounds what they can share, and a parity
sketch of the whole set, which travels with every posting, bounds how much they differ: a bit flips with every element that
only one of them holds. A posting also tells the element before its own: a pair that shares that one too has met there. So few pairs leave the bucket they meet in; they are verified on the whole sets, and a set travels once to
all the pairs of its neighbourhood, not once per pair.

A bucket is read as a stream in order of its key. One of more than ``CELL`` postings is met once more in cells of bounded size,
wherever they are worked on. No pair is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.session import cut_lineage, skew_join

# Buckets whose occurrences are counted; postings of a cell's side; elements and pairs looked at together.
BUCKETS, CELL = 1 << 20, 2_000
# Pairs that are verified together, on average.
TOGETHER = 4_000
_ELEMENTS, _PAIRS = 1 << 20, 1 << 20
# Fewest and most bits of a parity sketch.
_BITS = (128, 1024)
_POSTING = "key bigint, id bigint, info bigint, before bigint, sketch binary"
_SLACK = 1e-9
# Bands are this much wider than the threshold asks for, so that rounding cannot part similar sizes by two bands.
_BAND_SLACK = 1e-6


@dataclass
class DistinctSets:
    """``sets``: set_key, rep, codes, size, copies, one row per distinct set. ``members``: id, set_key of all sets."""

    sets: DataFrame
    members: DataFrame

    def of_members(self, per_set: DataFrame) -> DataFrame:
        """``per_set`` (set_key, ...) carried to every set; one set may have any number of copies."""
        return skew_join(self.members, per_set, "set_key").drop("set_key")


def distinct_sets(sets: DataFrame, id_column: str, elements: str) -> DistinctSets:
    """Collapse equal sets; the smallest id stands for its copies. Empty sets are similar to nothing and left out.

    Elements become 64-bit codes, so a set of long strings is small to move.
    """
    codes = F.sort_array(F.array_distinct(F.transform(elements, lambda e: F.xxhash64(e))))
    coded = sets.select(F.col(id_column).alias("id"), codes.alias("codes")).withColumn(
        "set_key", F.struct(F.xxhash64("codes").alias("a"), F.xxhash64(F.lit(1), "codes").alias("b"))
    )
    # elements can be costly to make: they are made once, for both tables below and for the filter
    keyed = cut_lineage(coded).filter(F.size("codes") > 0)
    classes = cut_lineage(
        keyed.groupBy("set_key").agg(
            F.min("id").alias("rep"), F.first("codes").alias("codes"), F.count(F.lit(1)).alias("copies")
        )
    )
    return DistinctSets(
        classes.select("rep", "codes", F.size("codes").alias("size"), "copies", "set_key"), keyed.select("id", "set_key")
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``batches`` with some ``_ELEMENTS`` codes together."""
    for b in batches:
        total = np.cumsum(b.column("codes").value_lengths().to_numpy())
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _ELEMENTS, side="right")))
            yield b.slice(at, to - at)
            at = to


def _occurrences(sets: DataFrame) -> np.ndarray:
    """How many elements of all sets fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for b in _slices(batches):
            counts += np.bincount(b.column("codes").flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    counted = sets.select("codes").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    occurrences = np.zeros(BUCKETS, dtype=np.int32)
    occurrences[counted.column("bucket").to_numpy()] = np.minimum(counted.column("n").to_numpy(), (1 << 31) - 1)
    return occurrences


def _bits(band: np.ndarray, width: float) -> np.ndarray:
    """Bits of the sketches of sets that meet in a band: about as many as its largest set has elements."""
    return np.exp2(np.clip(np.ceil((band + 1) * width / math.log(2)), *(math.log2(b) for b in _BITS))).astype(np.int64)


def _sketches(codes: np.ndarray, of: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """The parity sketch of every set; ``of`` tells the set of a code, in order."""
    first = np.cumsum(bits) - bits
    place = first[of] + (_mixed(codes.view(np.uint64)) % bits[of].astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(bool), bitorder="little").tobytes()
    return [packed[a // 8 : (a + n) // 8] for a, n in zip(first.tolist(), bits.tolist(), strict=True)]


def _postings(sets: DataFrame, threshold: float, occurrences: np.ndarray) -> DataFrame:
    """(key, id, info, before, sketch): the prefix of every set, element by element, in its own band and, as the smaller one, in the next.

    ``info`` holds the size, the position in the order, whether the band is the next one, and whether the set is wanted;
    ``before`` is the key of the element before, and of the first one the set's own id, which no other set has.
    """
    width = math.log(1 / threshold) + _BAND_SLACK
    schema = pa.schema([*((c, pa.int64()) for c in ("key", "id", "info", "before")), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            codes, size = b.column("codes").flatten().to_numpy(), b.column("codes").value_lengths().to_numpy().astype(np.int64)
            of = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((codes, occurrences[codes & (BUCKETS - 1)], of))
            place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
            band = np.floor(np.log(size) / width).astype(np.int64)
            ids, wanted = b.column("id").to_numpy(), b.column("wanted").to_numpy(zero_copy_only=False).astype(np.int64)
            longest = (size - np.ceil(size * threshold - _SLACK) + 1, size - np.ceil(size * (2 * threshold / (1 + threshold)) - _SLACK) + 1)
            for lower in (0, 1):
                use = np.flatnonzero(place < longest[lower][of])
                whose, at = of[use], place[use]
                key = _mixed(codes[order[use]].view(np.uint64) ^ _mixed((band[whose] + lower + 1).astype(np.uint64))).view(np.int64)
                info = size[whose] << 32 | at << 2 | lower << 1 | wanted[whose]
                # a prefix stands in its order here
                before = np.where(at == 0, ids[whose], np.roll(key, 1))
                sketch = pa.array(_sketches(codes, of, _bits(band + lower, width)), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[whose]), pa.array(info), pa.array(before), sketch.take(pa.array(whose))], schema=schema)

    return sets.select("id", "codes", "wanted").mapInArrow(run, _POSTING)


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of their first column, cut between its values."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last or (held and held[-1].column(0)[-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _possible(left: np.ndarray, right: np.ndarray, info: np.ndarray, before: np.ndarray, sketch: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of postings of one bucket may be the first element that two similar sets share."""
    # at the element before there was more room, and all else the same
    some = np.flatnonzero(before[left] != before[right])
    some = some[((info[left[some]] | info[right[some]]) & 1 == 1) & ((info[left[some]] & info[right[some]] & 2) == 0)]
    i, j = info[left[some]], info[right[some]]
    size1, size2 = i >> 32, j >> 32
    needed = (size1 + size2) * (threshold / (1 + threshold)) - _SLACK
    room = np.minimum(size1 - (i >> 2 & 0x3FFFFFFF), size2 - (j >> 2 & 0x3FFFFFFF))
    use = (np.minimum(size1, size2) >= np.maximum(size1, size2) * threshold - _SLACK) & (room >= needed)
    some, most = some[use], (size1 + size2 - 2 * needed)[use] + 1e-6
    apart = np.bitwise_count(sketch[left[some]] ^ sketch[right[some]]).sum(axis=1, dtype=np.int64)
    return some[apart <= most]


def _bucket_pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of the rows of every bucket, about ``_PAIRS`` at once."""
    row = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    behind, at = np.repeat(sizes, sizes) - row - 1, np.repeat(starts, sizes) + row
    total, first = np.cumsum(behind), 0
    while first < len(at):
        to = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + _PAIRS, side="right")))
        n = behind[first:to]
        left = np.repeat(at[first:to], n)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        first = to


def _meetings(rows: DataFrame, threshold: float, largest: int | None, sided: bool = False) -> DataFrame:
    """(a, b) of the sets that meet, or the postings of a bucket of more than ``largest`` as they came.

    Where ``sided``, ``info`` is preceded by the side of a row: only rows of different sides meet, where there are two.
    """
    schema = pa.schema([*((c, pa.int64()) for c in ("a", "b", "key", "id", "info", "before")), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches):
            lengths = table.column("sketch").combine_chunks().cast(pa.binary())
            lengths = np.diff(np.frombuffer(lengths.buffers()[1], dtype=np.int32)[lengths.offset : lengths.offset + len(lengths) + 1])
            for length in np.unique(lengths):
                part = table.filter(pa.array(lengths == length)).combine_chunks()
                keys, ids, info, before = (part.column(c).to_numpy() for c in ("key", "id", "info", "before"))
                sides = part.column("side").to_numpy() if sided else None
                sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(keys), -1)
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                sizes = np.diff(np.append(starts, len(keys)))
                long = sizes > largest if largest is not None else np.zeros(len(sizes), dtype=bool)
                if long.any():
                    again = part.filter(pa.array(np.repeat(long, sizes))).select(["key", "id", "info", "before", "sketch"]).combine_chunks()
                    nulls = pa.nulls(len(again), pa.int64())
                    for r in again.to_batches():
                        yield pa.RecordBatch.from_arrays([nulls[: len(r)], nulls[: len(r)], *r.columns], schema=schema)
                if sided:
                    # buckets of two sides
                    both = np.add.reduceat(sides, starts)
                    one_side = np.repeat((both == 0) | (both == sizes), sizes)
                for left, right in _bucket_pairs(starts[~long], sizes[~long]):
                    if sided:
                        cross = one_side[left] | (sides[left] != sides[right])
                        left, right = left[cross], right[cross]
                    found = _possible(left, right, info, before, sketch, threshold)
                    if len(found):
                        a, b = ids[left[found]], ids[right[found]]
                        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                        nulls = pa.nulls(len(a), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[nulls] * 4, pa.nulls(len(a), pa.binary())], schema=schema)

    ordered = rows.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "a bigint, b bigint, " + _POSTING)


def _candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): every pair of sets (id, codes, wanted) that may reach the threshold, once."""
    found = cut_lineage(_meetings(_postings(sets, threshold, _occurrences(sets)), threshold, CELL))
    pairs = found.filter("key IS NULL").select("a", "b")
    long = found.filter("key IS NOT NULL").select("key", "id", "info", "before", "sketch")
    if long.isEmpty():
        return pairs.distinct()
    parts = long.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    placed = long.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = placed.select(
        F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "id", "info", "before", "sketch",
        (F.col("part") > F.col("other")).cast("bigint").alias("side"),
    )
    return pairs.unionByName(_meetings(cells, threshold, None, sided=True).select("a", "b")).distinct()


def _shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared): how many elements the sets of every pair share.

    Pairs are dealt by the smallest neighbour of their first set, so those of a group of near copies come together; a large group
    is cut by both of its sides.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hubs = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("hub"))
    dealt = pairs.join(hubs, "a")
    parts = dealt.groupBy("hub").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / TOGETHER)).cast("int").alias("parts"))
    part = [F.pmod(F.xxhash64(c), F.col("parts")) for c in ("a", "b")]
    cells = max(1, -(-pairs.count() // TOGETHER))
    cell = F.pmod(F.xxhash64("hub", *part), F.lit(cells))
    dealt = cut_lineage(dealt.join(parts, "hub").select(cell.alias("cell"), "a", "b"))
    ends = dealt.select(F.col("cell").alias("place"), F.explode(F.array("a", "b")).alias("id"))
    members = ends.distinct().join(sets.select("id", "codes"), "id").select("place", "id", "codes")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64())])

    def count(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return schema.empty_table()
        ids, codes = held.column("id").to_numpy(), held.column("codes").combine_chunks()
        flat, at = codes.flatten().to_numpy(), np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy())])
        order = np.argsort(ids)
        a, b = asked.column("a").to_numpy(), asked.column("b").to_numpy()
        left, right = (order[np.searchsorted(ids, x, sorter=order)] for x in (a, b))
        # codes as small numbers; the elements of a left set are marked, and those of all its partners looked up together
        number = np.unique(flat, return_inverse=True)[1]
        size, marked = np.diff(at), np.zeros(int(number.max()) + 1, dtype=bool)
        shared, by_left = np.zeros(len(a), dtype=np.int64), np.argsort(left, kind="stable")
        for some in np.split(by_left, np.flatnonzero(np.diff(left[by_left])) + 1):
            own = number[at[left[some[0]]] : at[left[some[0]] + 1]]
            marked[own] = True
            total, first = np.cumsum(size[right[some]]), 0
            while first < len(some):
                to = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + _ELEMENTS, side="right")))
                j = right[some[first:to]]
                begin = np.cumsum(size[j]) - size[j]
                hit = marked[number[np.arange(int(size[j].sum())) + np.repeat(at[j] - begin, size[j])]]
                shared[some[first:to]] = np.add.reduceat(hit, begin, dtype=np.int64)
                first = to
            marked[own] = False
        return pa.table([a, b, shared], schema=schema)

    return dealt.groupBy("cell").cogroup(members.groupBy("place")).applyInArrow(
        count, "a bigint, b bigint, shared bigint"
    )


def similar_pairs(distinct: DistinctSets, threshold: float, wanted: DataFrame | None = None) -> DataFrame:
    """rep1 < rep2, size1, size2, copies1, copies2, shared, united, jaccard of the distinct sets that reach ``threshold``.

    ``wanted`` (rep) restricts them to pairs with at least one of these sets.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    sets = distinct.sets.withColumn("id", F.col("set_key.a"))
    if wanted is None:
        marked = sets.withColumn("wanted", F.lit(True))
    else:
        marked = sets.join(wanted.select("rep", F.lit(True).alias("wanted")), "rep", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    shared = _shared(cut_lineage(_candidates(marked.select("id", "codes", "wanted"), threshold)), sets)
    for side in ("a", "b"):
        described = F.struct("rep", "size", "copies").alias(f"set_{side}")
        shared = shared.join(sets.select(F.col("id").alias(side), described), side)
    first = F.col("set_a.rep") < F.col("set_b.rep")
    one, two = F.when(first, F.col("set_a")).otherwise(F.col("set_b")), F.when(first, F.col("set_b")).otherwise(F.col("set_a"))
    verified = shared.select(one.alias("one"), two.alias("two"), "shared").select(
        F.col("one.rep").alias("rep1"),
        F.col("two.rep").alias("rep2"),
        F.col("one.size").cast("bigint").alias("size1"),
        F.col("two.size").cast("bigint").alias("size2"),
        F.col("one.copies").alias("copies1"),
        F.col("two.copies").alias("copies2"),
        "shared",
    )
    united = F.col("size1") + F.col("size2") - F.col("shared")
    return (
        verified.withColumn("united", united)
        .withColumn("jaccard", F.col("shared") / F.col("united"))
        .filter(F.col("jaccard") >= threshold)
    )
