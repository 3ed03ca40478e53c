"""Self-joins over posting lists, with the lists of frequent keys split into blocks.

Two records are compared when they share a key in their *prefixes*: the rarest keys a record needs so
that no partner above the threshold can be missed. A key that many prefixes hold would still send all of its
postings to one task, so its postings are cut into blocks and every pair of blocks is a join key of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.session import broadcast_if_small, cut_lineage, holds_at_most

# Postings of one key that a task compares with each other.
BLOCK_POSTINGS = 2_000


def _split_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, left_blocks, right_blocks of every key with more than a block of postings on either side."""
    counts = (
        left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
        .join(right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right")), key)
    )
    return counts.filter(F.greatest("n_left", "n_right") > BLOCK_POSTINGS).select(
        key,
        F.ceil(F.col("n_left") / BLOCK_POSTINGS).cast("int").alias("left_blocks"),
        F.ceil(F.col("n_right") / BLOCK_POSTINGS).cast("int").alias("right_blocks"),
    )


def posting_pairs(left: DataFrame, right: DataFrame, key: str, condition: Column) -> DataFrame:
    """Inner equi-join of two posting relations on ``key`` plus ``condition``.

    Column names of the two sides are disjoint but for ``key``. The result is the plain join's.
    """
    if holds_at_most(left, BLOCK_POSTINGS) and holds_at_most(right, BLOCK_POSTINGS):
        return left.join(right, key).filter(condition)
    # a key in the table has more than a block of postings, so the table is small beside them; it is broadcast if a
    # count shows that, and otherwise joined like any other side
    split = broadcast_if_small(cut_lineage(_split_keys(left, right, key)))

    def blocks(side: DataFrame, own: str, other: str, own_first: bool) -> DataFrame:
        one = F.lit(1)
        own_block = F.pmod(F.xxhash64(*side.columns), F.coalesce(F.col(own), one))
        other_block = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), one) - 1))
        placed = side.join(split, key, "left").select(
            *side.columns, own_block.cast("int").alias("_own"), other_block.alias("_other")
        )
        row, column = ("_own", "_other") if own_first else ("_other", "_own")
        return placed.withColumn("_cell", F.struct(F.col(row).alias("r"), F.col(column).alias("c"))).drop(
            "_own", "_other"
        )

    placed_left = blocks(left, "left_blocks", "right_blocks", True)
    placed_right = blocks(right, "right_blocks", "left_blocks", False)
    return placed_left.join(placed_right, [key, "_cell"]).filter(condition).drop("_cell")

