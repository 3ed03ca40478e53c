"""What the operators of this subpackage share: reading, storing, rows of equal keys, connected groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
# Rows a checked side may hold to be broadcast by hint.
BROADCAST_ROWS = 200_000
TEXT_ROWS = 1_000
# Members of one key that a stream holds until it has seen them all.
HELD = 1 << 16
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, text: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe against lost executors.

    ``text`` marks a job that hands whole texts to Python: its Arrow batches hold ``TEXT_ROWS`` rows at most, so that a
    task holds a few megabytes of them. The session's own setting is back when the job is done.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    if text:
        spark.conf.set(_BATCH, str(min(TEXT_ROWS, int(before)) if int(before) > 0 else TEXT_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if text:
            spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def remainder(column: str, by: int) -> Column:
    """crc32 of a key written as text, modulo ``by``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, broadcast when a count shows that it is small; else joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def equal_neighbours(columns: list[np.ndarray]) -> np.ndarray:
    """Whether row ``i + 1`` equals row ``i`` in all columns."""
    same = np.ones(max(0, len(columns[0]) - 1), dtype=bool)
    for c in columns:
        same &= c[1:] == c[:-1]
    return same


def companions(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Rows whose key another member has too, with ``hub``: a member of the key that is not larger, the smallest one
    unless the key has more than ``HELD`` members. Equal rows count once.

    ``key`` and ``member`` are bigint columns without nulls. Rows are shuffled by key once and read as a stream sorted by
    it (one long: a radix sort), so a key of any number of rows needs bounded memory.
    """
    schema = pa.schema([(c, pa.int64()) for c in (key, member, "hub")])

    def shared(keys: np.ndarray, members: np.ndarray, passed_on: int | None) -> Iterator[pa.RecordBatch]:
        """Whole keys; ``passed_on`` is a hub of the first one whose row is out already."""
        for _ in range(2):  # after the second time copies of one member are no company
            same = keys[1:] == keys[:-1]
            company = np.zeros(len(keys), dtype=bool)
            company[1:] = same
            company[:-1] |= same
            keys, members = keys[company], members[company]
            if not len(keys):
                return
            order = np.lexsort((members, keys))
            keys, members = keys[order], members[order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (members[1:] != members[:-1])
            keys, members = keys[new], members[new]
        begins = np.zeros(len(keys), dtype=np.int64)
        begins[1:] = np.where(keys[1:] == keys[:-1], 0, np.arange(1, len(keys)))
        hub = members[np.maximum.accumulate(begins)]
        if passed_on is not None:
            out = (keys != keys[0]) | (members != passed_on)
            keys, members, hub = keys[out], members[out], hub[out]
        if len(keys):
            yield batch(schema, keys, members, hub)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = members = np.zeros(0, dtype=np.int64)
        passed_on: int | None = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            members = np.concatenate([members, b.column(1).to_numpy()])
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                first_passed = passed_on if keys[0] != keys[-1] else None
                yield from shared(keys[:last], members[:last], first_passed)
                keys, members, passed_on = keys[last:], members[last:], None
            if len(keys) > HELD:
                members = np.unique(members)
                keys = keys[: len(members)]
                if len(keys) > HELD:
                    yield from shared(keys, members, passed_on)
                    keys, members, passed_on = keys[:1], members[:1], int(members[0])
        yield from shared(keys, members, passed_on)

    ordered = rows.select(key, member).repartition(key).sortWithinPartitions(key)
    return ordered.mapInArrow(stream, f"{key} bigint, {member} bigint, hub bigint")


def roots(parents: DataFrame) -> DataFrame:
    """(id, component) of all ids in ``parents`` (id, parent), at most one smaller parent per id: pointers are doubled
    until every id points at its tree's smallest one."""
    state = stored(parents.select("id", "parent"))
    while True:
        above = state.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        # a parent that has none itself is a root
        step = state.join(above, "parent", "left")
        state = stored(step.select("id", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            break
        state = state.select("id", "parent")
    found = state.select("id", F.col("parent").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in ``links`` (a, b) the smallest id it is connected with.

    Alternating star contraction: every node sends its larger neighbours, then its smaller ones, to
    its least neighbour, until nothing changes. Each step is a pre-aggregated minimum and an equi-join.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(
            small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))
        ).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
