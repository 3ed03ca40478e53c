"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Largest inner product is nearest in distance once every vector gets one more component that brings it to the length of
the longest. Vectors are then turned by a random rotation, so that the distance over the first columns
estimates the whole one, and kept in column blocks. Lists are formed around centroids fitted on a bounded sample;
every vector is assigned. Within each probed list a query first sees the leading block of all vectors; after every
block a hypothesis test abandons the vectors whose partial distance is too large for the query's k-th
best so far. What survives all blocks is scored exactly on the original vectors in double precision.

Skew: equal vectors are folded to one row with their smallest ids (k + 1 of them suffice for an answer of
k); lists are dealt into shards of bounded size, a large list into several.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those
whose length differs from the most frequent one; rows of one id are queries of their own, ranked apart, if their vectors
differ, and one query if they are equal; a query never meets rows of its own id, and an id with one vector is one
candidate, however many rows it has; fewer candidates than k: all are returned; no rows in, no rows out. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from colscope.llm.common import batch, stored

# Vectors the index is fitted on, at most (in expectation; chosen by a hash of the id).
SAMPLE = 16_384
MOST_LISTS = 1_024
# Vectors of one shard, queries that meet it at once.
SHARD, QUERIES = 8_192, 16_384
BLOCK = 16
# Share of the lists that a query visits: all. Where lengths differ much, long vectors are far from every centroid, also of their
# own list, and a query's nearest lie in lists that its distances to the centroids put last.
PROBE = 1.0
# Confidence of the hypothesis test: a candidate is wrongly abandoned with a chance that falls as exp(-c * CONFIDENCE^2).
CONFIDENCE = 3.0
# Rows a query sees in full before the first tests.
FIRST_WAVE = 512
_SCALE = 1 << 20


def _usable(vector: str) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def clean(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): the vectors that take part."""
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("v")
    ).filter(F.col("id").isNotNull() & _usable("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.filter(F.size("v") == (sizes.n if sizes else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _fit(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a bounded sample (Lloyd's iterations on the driver)."""
    random = np.random.default_rng(7)
    centres = sample[random.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T - (centres**2).sum(1) / 2, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=lists)[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


class Space:
    """The rotated space: original vectors and queries go in, points whose distance orders the products come out."""

    def __init__(self, width: int, longest: float):
        self.longest = longest
        turn, _ = np.linalg.qr(np.random.default_rng(11).standard_normal((width + 1, width + 1)))
        self.turn = turn

    def points(self, v: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.longest**2 - (v**2).sum(1), 0))
        return np.hstack([v, more[:, None]]) @ self.turn

    def questions(self, q: np.ndarray) -> np.ndarray:
        """Only a query's direction matters: it is brought to the common length."""
        size = np.sqrt((q**2).sum(1))[:, None]
        return np.hstack([q / size * self.longest, np.zeros((len(q), 1))]) @ self.turn


def column_blocks(x: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    return [np.ascontiguousarray(x[:, i : i + block]) for i in range(0, x.shape[1], block)]


def adaptive_scan(q: np.ndarray, x: list[np.ndarray], rows: np.ndarray, k: int, confidence: float = CONFIDENCE) -> np.ndarray:
    """The ``rows`` that can be among the ``k`` nearest to ``q``, most promising lists first.

    Rows come in waves, each four times the last. After every column block a row is abandoned if the distance over the
    columns seen, scaled to all, exceeds the ``k``-th best of the waves before by more than the test allows.
    """
    at = np.cumsum([0, *(b.shape[1] for b in x)])
    width, begin, wave, bound = at[-1], 0, FIRST_WAVE, np.inf
    kept, distances = rows[:0], np.zeros(0)
    while begin < len(rows):
        some, part = rows[begin : begin + wave], 0.0
        for i, b in enumerate(x):
            part = part + ((b[some] - q[at[i] : at[i + 1]]) ** 2).sum(1)
            slack = 1.0 if at[i + 1] == width else (1 + confidence / np.sqrt(at[i + 1])) ** 2
            alive = part * (width / at[i + 1]) <= bound * slack * (1 + 1e-9) + 1e-12
            if not alive.all():
                some, part = some[alive], part[alive]
        kept, distances = np.concatenate([kept, some]), np.concatenate([distances, part])
        if len(kept) > k:
            bound = np.partition(distances, k - 1)[k - 1]
            near = distances <= bound * (1 + 1e-9) + 1e-12
            kept, distances = kept[near], distances[near]
        begin, wave = begin + wave, wave * 4
    return kept


def nearest(
    vectors: DataFrame, query_filter: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
    probe: float = PROBE, sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row under ``query_filter`` its ``k`` nearest other rows found.

    ``query_filter`` is a condition on ``id``. ``probe`` is the share of lists a query visits; the number of lists
    follows the root of the number of vectors.
    """
    out = "query_id bigint, rank int, vec_id bigint, score double"
    rows = stored(clean(vectors, id_column, vector_column))
    known = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)).alias("longest"),
    ).first()
    spark = vectors.sparkSession
    if not known.n:
        return spark.createDataFrame([], out)
    # equal vectors are one point with its smallest ids
    same = rows.select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(5), "v").alias("h2"))
    first = Window.partitionBy("h", "h2", "salt").orderBy("id")
    some = same.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = some.withColumn("r", F.dense_rank().over(first)).filter(F.col("r") <= k + 1)
    some = some.groupBy("h", "h2", "salt").agg(F.first("v").alias("v"), F.collect_set("id").alias("ids"))
    points = stored(
        some.groupBy("h", "h2")
        .agg(F.first("v").alias("v"), F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
        .select("v", "ids")
    )
    n = points.count()
    space = Space(known.width, float(np.sqrt(known.longest)))
    share = min(1.0, sample / n)
    picked = points.filter(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(_SCALE)) < int(share * _SCALE) + 1)
    chosen = picked.orderBy(F.col("ids")[0]).select("v").toArrow().column("v").combine_chunks()
    fitted = space.points(matrix(chosen)) if len(chosen) else np.zeros((0, known.width + 1))
    lists = int(max(1, min(MOST_LISTS, np.sqrt(n), len(fitted))))
    centres = _fit(fitted, lists) if len(fitted) else np.zeros((1, known.width + 1))
    lists, half = len(centres), (centres**2).sum(1) / 2
    width = "v array<double>"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.argmax(space.points(matrix(b.column(0))) @ centres.T - half, axis=1) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, type=pa.int64())], ["v", "ids", "list"])

    listed = stored(points.mapInArrow(assign, f"{width}, ids array<bigint>, list bigint"))
    # lists are dealt into shards in order; one longer than a shard has several to itself
    counts = dict(listed.groupBy("list").count().collect())
    shards_of, shard, room = {}, 0, SHARD
    for i in sorted(counts):
        if counts[i] > room and room < SHARD:
            shard, room = shard + 1, SHARD
        parts = -(-counts[i] // SHARD)
        shards_of[i] = (shard, parts)
        if parts > 1:
            shard, room = shard + parts, SHARD
        else:
            room -= counts[i]
    begin = np.array([shards_of.get(i, (0, 0))[0] for i in range(lists)])
    parts = np.array([shards_of.get(i, (0, 0))[1] for i in range(lists)])
    pairs = F.array(*[F.struct(F.lit(int(a)).alias("a"), F.lit(int(b)).alias("b")) for a, b in zip(begin, parts, strict=True)])
    place = F.get(pairs, F.col("list").cast("int"))
    data = listed.select(
        (place["a"] + F.pmod(F.xxhash64(F.col("ids")[0]), place["b"])).cast("bigint").alias("shard"),
        F.lit(0).cast("bigint").alias("id"), "v", "ids", "list",
    )
    visits = max(1, int(np.ceil(probe * lists)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("shard", pa.int64()), ("id", pa.int64()), ("v", pa.list_(pa.float64())), ("number", pa.int64()), ("lists", pa.list_(pa.int64()))]
        )
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                piece = b.slice(at, 1024)
                order = np.argsort(half - space.questions(matrix(piece.column(1))) @ centres.T, axis=1)[:, :visits]
                take, shards, wanted = [], [], []
                for i, probed in enumerate(order):
                    by_shard: dict[int, list[int]] = {}
                    for c in probed:
                        for s in range(begin[c], begin[c] + parts[c]):
                            by_shard.setdefault(int(s), []).append(int(c))
                    take += [i] * len(by_shard)
                    shards += by_shard
                    wanted += by_shard.values()
                sub = piece.take(pa.array(take, type=pa.int64()))
                yield batch(schema, shards, sub.column(0), sub.column(1).cast(pa.list_(pa.float64())), sub.column(2), wanted)

    asked_rows = stored(rows.filter(query_filter).select("id", "v", F.xxhash64("id", "v").alias("number")).dropDuplicates(["number"]))
    queries = asked_rows.mapInArrow(spread, f"shard bigint, id bigint, {width}, number bigint, lists array<bigint>")
    # a shard's queries come in groups of bounded size, each meeting the shard's vectors
    expected = max(1, -(-asked_rows.count() // QUERIES))
    group = F.pmod(F.xxhash64("number"), F.lit(expected))
    queries = queries.withColumn("part", group)
    data = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(expected - 1)))) if expected > 1 else data.withColumn("part", F.lit(0))
    found_schema = pa.schema([("number", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return found_schema.empty_table()
        asked, wanted = left.column("id").to_numpy(), left.column("lists").to_pylist()
        numbers = left.column("number").to_numpy()
        q0, x0 = matrix(left.column("v").combine_chunks()), matrix(right.column("v").combine_chunks())
        q, x = space.questions(q0), column_blocks(space.points(x0))
        ids, of = right.column("ids").to_pylist(), right.column("list").to_numpy()
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(lists + 1))
        out: list[tuple[np.ndarray, ...]] = []
        for i in range(len(asked)):
            rows = np.concatenate([order[cuts[c] : cuts[c + 1]] for c in wanted[i]])
            if not len(rows):
                continue
            rows = adaptive_scan(q[i], x, rows, k + 1)
            scores = x0[rows] @ q0[i]
            # a point may be the query alone, so one more is kept
            best = rows if len(rows) <= k + 1 else rows[scores >= np.partition(scores, -(k + 1))[-(k + 1)]]
            pairs = [(s, j) for s, r in zip((x0[best] * q0[i]).sum(1).tolist(), best.tolist(), strict=True) for j in ids[r] if j != asked[i]]
            pairs.sort(key=lambda p: (-p[0], p[1]))
            pairs = pairs[:k]
            out.append((np.full(len(pairs), numbers[i]), np.full(len(pairs), asked[i]), np.array([p[1] for p in pairs], int), np.array([p[0] for p in pairs])))
        if not out:
            return found_schema.empty_table()
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=found_schema)

    found = queries.groupBy("shard", "part").cogroup(data.groupBy("shard", "part")).applyInArrow(
        search, "number bigint, query_id bigint, vec_id bigint, score double"
    )
    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
