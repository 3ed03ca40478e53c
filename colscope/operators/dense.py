"""Threshold join of dense unit vectors, exact, without comparing whole vectors of all pairs.

The vectors are turned so that the first columns hold most of their length (principal axes of a bounded sample) and grouped
around pivots. A vector meets the groups that may hold a partner, by two bounds that need no look at the members: the
angle to the pivot against the group's widest angle, and the distance to the plane half way between the two pivots. Groups are
cut into blocks of bounded size, and every pair of blocks is a join key of its own. There the columns are read block by
block: what two vectors share so far plus the product of the lengths of their rests bounds the dot product, and pairs
that cannot reach the threshold any more are dropped. The rest is summed up in double precision on the given components,
and rounded before it is compared with the threshold.

How much the pivots save depends on the data. On vectors without any grouping every group is met; then there is but one group,
cut into blocks, so a vector travels once per block of the other side instead of once per group. Where the first
columns leave too many pairs, two blocks are multiplied as a whole, in single precision with a bound on its error, and only
pairs that may reach the threshold are summed up. ``dense_pairs`` can tell how many pairs it compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.session import cut_lineage

DIGITS = 6
# Vectors the axes and pivots are fitted on, at most in expectation; pivots; vectors of a block (of more than ``WIDE`` columns
# fewer); columns of a block.
SAMPLE, PIVOTS, BLOCK, WIDE, COLUMNS = 4_096, 64, 32_768, 64, 16
# Share of the groups that a vector meets beyond which there is one group; share of the pairs that the first columns leave
# beyond which blocks are multiplied as a whole; vectors of a tile.
UNITED, LEFT, TILE = 0.5, 0.125, 1_024
# Bounds are loosened by this much, so that rounding cannot lose a pair.
_SLACK = 1e-6
_SCALE = 1 << 30


@dataclass(frozen=True)
class DenseVectors:
    """Vectors of texts from a caller's model, of any length; (text, vector) relations.

    ``asked`` holds names, terms and phrases as they are; ``found`` the names as they are to be found by (enriched, if the
    caller enriches). By default they are found by what they are asked as.
    """

    asked: DataFrame
    found: DataFrame | None = None

    def of(self, texts: DataFrame, name: str, side: str) -> DataFrame:
        """(``name``, vector) of the distinct texts that have a vector."""
        vectors = self.found if side == "found" and self.found is not None else self.asked
        return unit_vectors(texts.select(F.col(name).alias("text")).distinct().join(vectors, "text"), "text", "vector").select(
            F.col("text").alias(name), "vector"
        )


def unit_vectors(rows: DataFrame, name: str, vector: str) -> DataFrame:
    """``name`` and its vector at unit length, once per name. Null and zero vectors and such with null or non-finite
    components have no direction and are left out; of different vectors of one name the smallest counts."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda total, x: total + x * x))
    finite = F.forall("_v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = rows.select(F.col(name).alias("_name"), doubles.alias("_v")).filter(F.col("_v").isNotNull() & finite)
    rows = rows.withColumn("_length", length).filter(F.col("_length") > 0)
    once = rows.groupBy("_name").agg(F.min(F.struct("_v", "_length")).alias("m"))
    return once.select(
        F.col("_name").alias(name), F.transform("m._v", lambda x: x / F.col("m._length")).alias(vector)
    )


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Space:
    """Axes and pivots fitted on a sample; every bound holds for whatever is put into it later."""

    def __init__(self, sample: np.ndarray, pivots: int):
        _, _, axes = np.linalg.svd(sample, full_matrices=True)
        self.axes = axes.T
        turned = sample @ self.axes
        picked = [0]
        nearest = turned @ turned[0]
        while len(picked) < min(pivots, len(sample)):  # always the one farthest from those picked
            picked.append(int(np.argmin(nearest)))
            nearest = np.maximum(nearest, turned @ turned[picked[-1]])
        centres = turned[picked]
        for _ in range(5):
            own = np.argmax(turned @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, turned)
            length = np.linalg.norm(sums, axis=1)
            centres[length > 0] = sums[length > 0] / length[length > 0, None]
        self.centres = np.unique(centres, axis=0)
        # planes half way between two pivots
        apart = self.centres[:, None] - self.centres[None]
        width = np.linalg.norm(apart, axis=2)
        self.width = np.where(width > 1e-9, width, np.inf)

    def turn(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.axes

    def own(self, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of every vector, and its angle to the pivot."""
        near = turned @ self.centres.T
        own = np.argmax(near, axis=1)
        return own, np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))

    def met(self, turned: np.ndarray, widest: np.ndarray, threshold: float) -> np.ndarray:
        """Which groups may hold a vector whose dot product reaches the threshold."""
        near = turned @ self.centres.T
        own = np.argmax(near, axis=1)
        reach = np.arccos(min(1.0, threshold))
        close = np.arccos(np.clip(near, -1, 1)) <= widest + reach + _SLACK
        if reach < np.pi / 2:
            # a partner on the other side of the plane is at least this far away
            over = (near[np.arange(len(own)), own][:, None] - near) / self.width[own]
            close &= over <= np.sin(reach) + _SLACK
        return close & (widest >= 0)


def pairs_above(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j) of turned vectors whose dot product may reach the threshold, and how many pairs went beyond the first columns."""
    width = left.shape[1]
    cuts = [*range(0, width, COLUMNS), width]
    # lengths of what is behind each cut
    rest = [np.sqrt(np.stack([(m[:, c:] ** 2).sum(axis=1) for c in cuts])) for m in (left, right)]
    first = cuts[1]
    shared = left[:, :first] @ right[:, :first].T
    i, j = np.nonzero(shared + rest[0][1][:, None] * rest[1][1][None] >= threshold - _SLACK)
    shared, seen = shared[i, j], len(i)
    for k in range(1, len(cuts) - 1):
        if not len(i):
            break
        part = slice(cuts[k], cuts[k + 1])
        shared = shared + np.einsum("ij,ij->i", left[i, part], right[j, part])
        use = shared + rest[0][k + 1][i] * rest[1][k + 1][j] >= threshold - _SLACK
        i, j, shared = i[use], j[use], shared[use]
    return i, j, seen


def whole_above(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of vectors of at most unit length whose dot product may reach the threshold, all columns in single precision."""
    # what rounding to single precision and adding up so many products may take away
    least = np.float32(threshold - _SLACK - (left.shape[1] + 8) * 2.0**-23)
    x, y = left.astype(np.float32), right.astype(np.float32)
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for at in range(0, len(x), TILE):
        for to in range(0, len(y), TILE):
            dots = x[at : at + TILE] @ y[to : to + TILE].T
            i, j = np.divmod(np.flatnonzero(dots >= least), dots.shape[1])
            found.append((i + at, j + to))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def leaves_many(left: np.ndarray, right: np.ndarray, threshold: float) -> bool:
    """Whether the first columns leave many of the pairs, judged by some of them."""
    some, others = left[:: max(1, len(left) // 128)], right[:: max(1, len(right) // 512)]
    first = slice(0, min(COLUMNS, left.shape[1]))
    rest = [np.sqrt((m[:, first.stop :] ** 2).sum(axis=1)) for m in (some, others)]
    bound = some[:, first] @ others[:, first].T + rest[0][:, None] * rest[1][None]
    return (bound >= threshold - _SLACK).mean() > LEFT


def dense_pairs(asked: DataFrame, found: DataFrame, name: str, threshold: float, vector: str = "vector", counted: bool = False) -> DataFrame:
    """name1, name2, similarity of all ordered pairs of an asked and a found unit vector that reach ``threshold``; exact.

    Both sides hold ``name`` and a unit ``vector``, each name once. With ``counted`` there is a row with null names too, whose
    similarity is the number of pairs that were compared beyond the first block of columns.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    spark = asked.sparkSession
    sides = []
    for side in (asked, found):
        named = side.select(F.col(name).alias("name"), F.col(vector).alias("v"))
        sides.append(cut_lineage(named))
    asked, found = sides
    out = f"name1 {asked.schema['name'].dataType.simpleString()}, name2 {found.schema['name'].dataType.simpleString()}, similarity double"
    total, width, other = found.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.size("v"))).first()
    widths = asked.agg(F.max(F.size("v")), F.min(F.size("v"))).first()
    if not total or widths[0] is None:
        return spark.createDataFrame([], out)
    if {width, other} != set(widths):
        raise ValueError("vectors of different length")
    share = F.pmod(F.xxhash64("name"), F.lit(_SCALE)) < int(min(1.0, SAMPLE / total) * _SCALE) + 1
    sample = _matrix(found.filter(share).select("v").toArrow().column("v")) if total else np.zeros((0, width))
    if not len(sample):
        sample = _matrix(found.limit(1).select("v").toArrow().column("v"))
    space = Space(sample, max(1, min(PIVOTS, int(np.sqrt(total)))))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, angle = space.own(space.turn(_matrix(b.column("v"))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(angle)], ["name", "v", "group", "angle"])

    kind = found.schema["name"].dataType.simpleString()
    block = max(1, BLOCK * WIDE // max(WIDE, width))
    placed = cut_lineage(found.mapInArrow(grouped, f"name {kind}, v array<double>, group bigint, angle double"))
    widest = np.full(len(space.centres), -1.0)
    parts = np.ones(len(space.centres), dtype=np.int64)
    for r in placed.groupBy("group").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():
        widest[r.group], parts[r.group] = r.angle, -(-r.n // block)
    united = space.met(space.turn(sample), widest, threshold).mean() > UNITED

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i, group = np.nonzero(space.met(space.turn(_matrix(b.column("v"))), widest, threshold))
                sub = b.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*sub.columns, pa.array(group)], ["name", "v", "group"])

    kind = asked.schema["name"].dataType.simpleString()
    if united:
        one = F.lit(0).cast("bigint").alias("group")
        placed, visits = found.select("name", "v", one), asked.select("name", "v", one)
        parts, visited = np.array([-(-total // block)]), np.array([-(-asked.count() // block)])
    else:
        visits = cut_lineage(asked.mapInArrow(meeting, f"name {kind}, v array<double>, group bigint"))
        visited = np.ones(len(space.centres), dtype=np.int64)
        for r in visits.groupBy("group").count().collect():
            visited[r.group] = -(-r["count"] // block)

    def looked_up(values: np.ndarray) -> Column:
        return F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("group").cast("int"))

    def cells(rows: DataFrame, own: np.ndarray, other: np.ndarray) -> DataFrame:
        mine = F.pmod(F.xxhash64("name"), looked_up(own)).cast("bigint")
        theirs = F.explode(F.sequence(F.lit(0).cast("bigint"), looked_up(other).cast("bigint") - 1))
        return rows.select("name", "v", "group", mine.alias("mine"), theirs.alias("theirs"))

    left = cells(visits, visited, parts).withColumn("cell", F.struct("group", F.col("mine").alias("a"), F.col("theirs").alias("b")))
    right = cells(placed, parts, visited).withColumn("cell", F.struct("group", F.col("theirs").alias("a"), F.col("mine").alias("b")))
    key = F.xxhash64("cell.group", "cell.a", "cell.b")
    left = left.select(key.alias("key"), "name", "v")
    right = right.select(key.alias("key"), "name", "v")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("name1", a.schema.field("name").type), ("name2", b.schema.field("name").type), ("similarity", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        x, y = _matrix(a.column("v")), _matrix(b.column("v"))
        tx, ty = space.turn(x), space.turn(y)
        found_, compared = [], 0
        many = leaves_many(tx, ty, threshold)
        step = TILE if many else max(1, (1 << 22) // len(y))
        for at in range(0, len(x), step):
            if many:
                i, j = whole_above(x[at : at + step], y, threshold)
                seen = len(x[at : at + step]) * len(y)
            else:
                i, j, seen = pairs_above(tx[at : at + step], ty, threshold)
            compared += seen
            similarity = np.round(np.einsum("ij,ij->i", x[i + at], y[j]), DIGITS)
            use = similarity >= threshold
            found_.append((i[use] + at, j[use], similarity[use]))
        i, j, similarity = (np.concatenate(c) for c in zip(*found_, strict=True))
        rows = pa.table([a.column("name").take(pa.array(i)), b.column("name").take(pa.array(j)), pa.array(similarity)], schema=schema)
        return pa.concat_tables([rows, pa.table([[None], [None], [float(compared)]], schema=schema)]) if counted else rows

    return left.groupBy("key").cogroup(right.groupBy("key")).applyInArrow(search, out)
