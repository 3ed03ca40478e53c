"""Exact deduplication by a tree merge of sorted digest runs.

Every partition writes one sorted run of its digests, copies already folded. The runs are then exchanged in
binomial rounds: with radix 2^b, a round joins 2^b neighbouring runs and splits their digests into as
many ranges, so the number of runs stays and each holds a finer range of a wider part of the input. After the
last round a run holds one range of all digests. Every merge reads its runs as one sorted stream and keeps
the first row of a digest: the identifier that stays.

A digest is SHA-256 of the normalised text, verified at every level by an independent 64-bit hash and the
byte length: rows merge only where all three agree.

Defined cases: a null text counts as empty, all empty texts are copies of one another. Ties in length go to the
smaller doc_id, a null doc_id last; of wholly equal rows one stays. No rows in, no rows out. Only
doc_id and text are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import SPACES, batch, equal_neighbours, stored
from colscope.session import skew_join

# Runs that meet in one merge: 2 to this power.
RADIX_BITS = 3
KEY_BYTES = 48
RUN = "slot bigint, key binary, keep_points bigint, keep_id bigint, keep_row bigint, group_size bigint"
_RUN = pa.schema(
    [("slot", pa.int64()), ("key", pa.binary()), ("keep_points", pa.int64()), ("keep_id", pa.int64()),
     ("keep_row", pa.int64()), ("group_size", pa.int64())]
)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions("slot", "key", F.desc("keep_points"), F.asc_nulls_last("keep_id"), "keep_row")


def digests(documents: DataFrame) -> DataFrame:
    """One row per document: row_id, doc_id, points, text_sha256 and the 48 verified key bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    return (
        documents.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.char_length(text).cast("bigint").alias("points"), bare.alias("bare")
        )
        .select("doc_id", "points", F.sha2("bare", 256).alias("text_sha256"), F.xxhash64("bare").alias("check"),
                F.octet_length("bare").cast("bigint").alias("size"))
        .select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id", "points", "text_sha256",
            F.unhex(F.concat("text_sha256", F.lpad(F.hex("check"), 16, "0"), F.lpad(F.hex("size"), 16, "0"))).alias("key"),
        )
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold a sorted stream: the first row of every (slot, key) with the sum of its sizes."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        b = batch(_RUN, *b.columns)
        rows = pa.Table.from_batches([held, b] if held is not None else [b]).combine_chunks().to_batches()[0]
        raw = rows.column(1)
        begin = raw.offset * KEY_BYTES
        parts = np.frombuffer(raw.buffers()[2], dtype=np.uint64, offset=begin, count=len(raw) * KEY_BYTES // 8)
        parts = parts.reshape(len(raw), KEY_BYTES // 8)
        same = equal_neighbours([rows.column(0).to_numpy(), *parts.T])
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        sizes = np.add.reduceat(rows.column(5).to_numpy(), first)
        folded = rows.take(pa.array(first))
        folded = batch(_RUN, *[folded.column(i) for i in range(5)], sizes)
        if len(first) > 1:
            yield folded.slice(0, len(first) - 1)
        held = pa.Table.from_batches([folded.slice(len(first) - 1)]).take([0]).combine_chunks().to_batches()[0]
    if held is not None:
        yield held


def merged_runs(rows: DataFrame, radix_bits: int = RADIX_BITS) -> DataFrame:
    """(key, keep_points, keep_id, keep_row, group_size): one row per digest of stored ``digests`` rows."""
    runs = rows.select(
        F.spark_partition_id().cast("bigint").alias("slot"), "key", F.col("points").alias("keep_points"),
        F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row"), F.lit(1).cast("bigint").alias("group_size"),
    )
    runs = stored(_sorted(runs).mapInArrow(_merge, RUN))
    last, done = runs.agg(F.max("slot")).first()[0] or 0, 0
    prefix = F.conv(F.hex(F.substring("key", 1, 6)), 16, 10).cast("bigint")  # 48 bits of the digest
    while (last >> done) > 0:
        done += radix_bits
        place = F.shiftright(prefix, 48 - done)
        slot = F.shiftleft(F.shiftright("slot", done), done) + place
        # a run of this round is the part of the tree above it and the range of digests
        moved = _sorted(runs.withColumn("slot", slot).repartition("slot"))
        runs = stored(moved.mapInArrow(_merge, RUN))
    return runs.drop("slot")


def exact_dedup(documents: DataFrame, radix_bits: int = RADIX_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per document, dropped ones too."""
    rows = stored(digests(documents))
    return skew_join(rows, merged_runs(rows, radix_bits), "key").select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
