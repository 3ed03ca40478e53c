"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles (fewer words than a shingle: the whole sequence). Every element flips one
bit of a sketch chosen by its hash, so the Hamming distance of two sketches is a lower bound of the
symmetric difference of the sets. With a Jaccard similarity of p/q that difference is at most
(q-p)/(p+q) of both sizes together. A size band therefore cuts the elements into more blocks than that: of two
similar sets at least one block is untouched, and its parity (an XOR of 64-bit element hashes, a parity sketch as wide
as its hash) is the join key. Two similar sets share as many keys as a set has more blocks than can differ, so a set
that shares fewer with all others together is out at once. A block without elements is no key as long as a document has more other blocks
than can differ. Small sets, whose blocks are often empty, meet by their rarest elements instead, one more than may
be missing in a similar set: what many unrelated sets hold (a licence line) is the key of hardly any. How rare an element is need not be
known exactly, as any order common to all sets loses no pair. Candidates must pass the Hamming bound of 1024-bit sketches and are verified on whole sets.

Sizes: a pair meets in the band of its larger set; a set stands in its own band and the next, as bands are
a factor q/p wide. Equal sets are one class from the beginning.

Defined cases: a null text or one without words has the empty set, which links with nothing; equal rows are one class;
rows with a null doc_id take part like others and are linked through; the smallest doc_id that is not null names
a component, and one without any has none; no rows in, no rows out. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import batch, small_side, stored
from colscope.llm.linking import connected
from colscope.llm.words import Words, blocks, mix, runs, signed

SHINGLE = 5
# Similarity as a fraction: numerator, denominator.
SIMILAR = (80, 100)
# Longs of the sketch behind the Hamming bound.
SKETCH = 16
# Buckets in which the elements of short texts are counted, and their most characters: texts of small sets, by and large.
BUCKETS, SHORT = 1 << 18, 4_000
# Sets of up to so many elements meet by elements, larger ones by blocks; those of either side that may be similar do both.
SMALL = 100
# Bytes of text handled at once.
TEXT_BLOCK = 1 << 20
_SETS = pa.schema(
    [("doc_id", pa.int64()), ("row_id", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("need", pa.int64()), *((f"s{i}", pa.int64()) for i in range(SKETCH))]
)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one text after the other, and where each text's begin."""
    words = Words(texts)
    h, n = words.hashes(True), len(texts)
    counts, of = words.counts(), words.text_of()
    every = runs(h, k)
    whole = np.flatnonzero(of[: len(every)] == of[k - 1 :]) if len(h) >= k else np.zeros(0, dtype=np.int64)
    values, owner = every[whole], of[whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        some = [mix(runs(h[words.first[i] : words.first[i + 1]], int(counts[i])) + counts[i].astype(np.uint64))[0] for i in short]
        at = np.searchsorted(owner, short)
        values, owner = np.insert(values, at, np.array(some, dtype=np.uint64)), np.insert(owner, at, short)
    first = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(n + 1))


def _fold(values: np.ndarray, first: np.ndarray, with_ufunc) -> np.ndarray:
    """A ufunc over the values of every text; 0 where it has none."""
    out = np.zeros(len(first) - 1, dtype=values.dtype)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = with_ufunc.reduceat(values, first[:-1][some])
    return out


def _class_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 63-bit identity of every set."""
    n = np.diff(first).astype(np.uint64)
    total = mix(_fold(mix(values), first, np.add) + n) ^ _fold(mix(values ^ np.uint64(0x5851F42D4C957F2D)), first, np.bitwise_xor)
    return signed(mix(total) >> np.uint64(1))


def _sketch(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity of the elements at each of the sketch's bits, as longs."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    bit = (values >> np.uint64(40)).astype(np.int64) % (64 * SKETCH)
    out = np.zeros(n * SKETCH, dtype=np.uint64)
    np.bitwise_xor.at(out, owner * SKETCH + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    return out.reshape(n, SKETCH)


def band_of(sizes: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Bands are a factor 1/similarity wide; the edges are whole numbers, found without rounding errors."""
    edges, (p, q) = [1], similar
    while edges[-1] <= sizes.max(initial=1):
        edges.append(max(edges[-1] + 1, edges[-1] * q // p + 1))
    return np.searchsorted(np.array(edges), sizes, side="right") - 1


def band_edge(band: int, similar: tuple[int, int]) -> int:
    """The largest size in a band."""
    edge, (p, q) = 1, similar
    for _ in range(band + 1):
        edge = max(edge + 1, edge * q // p + 1)
    return edge - 1


def _blocks(values: np.ndarray, spread: np.ndarray, band: int, edge: int, similar: tuple[int, int]):
    """(block of every element, number of blocks, most blocks that can differ) of one set in a band."""
    p, q = similar
    differ = 2 * edge * (q - p) // (p + q)
    # one block more than can differ, and some for blocks without elements
    blocks_ = differ + 1 + differ // 8
    at = ((spread >> np.uint64(32)) * np.uint64(blocks_) >> np.uint64(32)).astype(np.int64)
    return at, blocks_, differ


def _spread(values: np.ndarray) -> np.ndarray:
    return mix(values ^ np.uint64(0xA0761D6478BD642F))


def _band_edges(similar: tuple[int, int]) -> dict[int, int]:
    return {b: band_edge(b, similar) for b in range(220)}


def _bucket(values: np.ndarray) -> np.ndarray:
    return (mix(values) % np.uint64(BUCKETS)).astype(np.int64)


def rarity(documents: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """How often the elements of a bucket occur in small sets of short texts, as a byte: four steps are twice as often."""
    p, q = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for part in blocks(b, limit=TEXT_BLOCK):
                values, first = shingle_sets(part.column("text"), shingle)
                sizes = np.diff(first)
                counts += np.bincount(_bucket(values[np.repeat(sizes * p <= SMALL * q, sizes)]), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    short = documents.select("text").filter(F.char_length("text") <= SHORT)
    counted = short.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.uint8)
    out[counted.column("bucket").to_numpy()] = np.log2(counted.column("n").to_numpy() + 1) * 4
    return out


def signatures(documents: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(key, id): the blocks of every set, in its own band and the next; of small sets the rarest elements."""
    p, q = similar
    often = rarity(documents, shingle, similar)
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])
    edges = _band_edges(similar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, limit=TEXT_BLOCK):
                values, first = shingle_sets(part.column("text"), shingle)
                sizes, ids = np.diff(first), _class_of(values, first)
                _, alone = np.unique(ids, return_index=True)
                alone = alone[sizes[alone] > 0]
                bands = band_of(sizes, similar)
                spread = _spread(values)
                keys, owners = [], []
                for i in alone:
                    own = slice(first[i], first[i + 1])
                    if sizes[i] * p <= SMALL * q:
                        order = np.argsort(often[_bucket(values[own])], kind="stable")
                        least = mix(values[own][order[: sizes[i] - (sizes[i] * p + q - 1) // q + 1]])
                        keys.append(least)
                        owners.append(np.full(len(least), ids[i]))
                    for band in (bands[i], bands[i] + 1) if sizes[i] > SMALL else ():
                        at, blocks_, differ = _blocks(values[own], spread[own], band, edges[band], similar)
                        parity = np.zeros(blocks_, dtype=np.uint64)
                        np.bitwise_xor.at(parity, at, values[own])
                        full = np.zeros(blocks_, dtype=bool)
                        full[at] = True
                        use = np.flatnonzero(full) if full.sum() > differ else np.arange(blocks_)
                        salt = (use.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(band * 2654435761 + 1)
                        keys.append(mix(parity[use] ^ mix(salt)))
                        owners.append(np.full(len(use), ids[i]))
                if keys:
                    yield batch(schema, signed(np.concatenate(keys)), np.concatenate(owners))

    return documents.select("text").mapInArrow(run, "key bigint, id bigint")


def keys_needed(values: np.ndarray, first: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """How many keys every set has at least in common with a similar one: its keys less the blocks that can differ."""
    edges, sizes, (p, q) = _band_edges(similar), np.diff(first), similar
    bands, spread, out = band_of(sizes, similar), _spread(values), np.ones(len(sizes), dtype=np.int64)
    for i in np.flatnonzero(sizes * p > SMALL * q):
        own, least = slice(first[i], first[i + 1]), []
        for band in (bands[i], bands[i] + 1):
            at, blocks_, differ = _blocks(values[own], spread[own], band, edges[band], similar)
            full = np.zeros(blocks_, dtype=bool)
            full[at] = True
            used = int(full.sum())
            least.append((used if used > differ else blocks_) - differ)
        out[i] = min(least)
    return out


def classes(documents: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(doc_id, row_id, n, id, need, s0..s15): row_id is xxhash64(doc_id, text); size, class, keys needed and sketch of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, limit=TEXT_BLOCK):
                values, first = shingle_sets(part.column("text"), shingle)
                longs = signed(_sketch(values, first)).T
                need = keys_needed(values, first, similar)
                yield batch(_SETS, part.column("doc_id"), part.column("row_id"), np.diff(first), _class_of(values, first), need, *longs)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_id"), "text")
    longs = ", ".join(f"s{i} bigint" for i in range(SKETCH))
    return rows.mapInArrow(run, f"doc_id bigint, row_id bigint, n bigint, id bigint, need bigint, {longs}")


def verified(pairs: DataFrame, representatives: DataFrame, documents: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs of classes (a, b) whose whole sets are similar."""
    p, q = similar
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(representatives, "id"))
    texts = documents.select(F.xxhash64("doc_id", "text").alias("row_id"), "text").join(
        small_side(needed), "row_id"
    ).select("id", "text")

    def to_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("elements", pa.binary())])
        for b in batches:
            for part in blocks(b, limit=TEXT_BLOCK):
                values, first = shingle_sets(part.column("text"), shingle)
                ids, own = part.column("id").to_numpy(), _class_of(values, first)
                # of rows that share a hash only those of the class count
                keep = np.flatnonzero(ids == own)
                yield batch(schema, ids[keep], [values[first[i] : first[i + 1]].tobytes() for i in keep])

    sets = stored(texts.mapInArrow(to_set, "id bigint, elements binary").dropDuplicates(["id"]), text=True)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for b in batches:
            left, right = b.column("a_set"), b.column("b_set")
            good = []
            for i in range(b.num_rows):
                x = np.frombuffer(left[i].as_buffer(), dtype=np.uint64)
                y = np.frombuffer(right[i].as_buffer(), dtype=np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(q * common >= p * (len(x) + len(y) - common))
            keep = pa.array(good, type=pa.bool_())
            yield batch(schema, b.column("a").filter(keep), b.column("b").filter(keep))

    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("b_set")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("elements").alias("a_set")), "a"
    )
    return joined.select("a", "b", "a_set", "b_set").mapInArrow(check, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(doc_id, row_id, n_shingles, component_id, group_id): one row per document; group_id tells components without any
    doc_id apart too, and is null for empty sets."""
    p, q = similar
    found = stored(classes(documents, shingle, similar), text=True)
    longs = [F.first(f"s{i}").alias(f"s{i}") for i in range(SKETCH)]
    unique = stored(found.filter("n > 0").groupBy("id").agg(
        F.min("doc_id").alias("doc_id"), F.min("row_id").alias("row_id"), F.first("n").alias("n"), F.first("need").alias("need"), *longs
    ))
    representatives = unique.select("id", "row_id")
    sketches = unique.drop("doc_id", "row_id", "need")

    def possible(a, b):
        apart = F.lit(0)
        for i in range(SKETCH):
            apart = apart + F.bit_count(a(f"s{i}").bitwiseXOR(b(f"s{i}")))
        sizes = a("n") + b("n")
        return ((p + q) * apart <= (q - p) * sizes) & (q * F.least(a("n"), b("n")) >= p * F.greatest(a("n"), b("n")))

    groups = connected(
        signatures(documents, shingle, similar), sketches, possible,
        lambda pairs: verified(pairs, representatives, documents, shingle, similar), need=unique.select("id", "need"),
    )
    named = stored(unique.select("id", "doc_id").join(groups, "id", "left").select(
        F.col("id").alias("class_id"), "doc_id", F.coalesce("component", "id").alias("group_id")
    ))
    # the smallest doc_id of a component stands for it
    least = named.groupBy("group_id").agg(F.min("doc_id").alias("component_id"))
    of_class = stored(named.select("class_id", "group_id").join(least, "group_id"))
    rows = found.select("doc_id", "row_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("id")).alias("class_id"))
    return rows.join(of_class, "class_id", "left").select(
        "doc_id", "row_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "group_id",
    )
