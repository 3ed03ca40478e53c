"""Greedy leaders: in a given order, an item leads unless an earlier leader has claimed it.

The sequential rule is restated per round over the edge list: an item no undecided predecessor points to
leads; whatever a leader points to is claimed; edges of claimed items vanish. Rounds are as many as the longest
chain of dependent decisions, each a few joins; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.session import cut_lineage

# Rounds after which the claimed items so far are stored as one relation.
ROUNDS_PER_CUT = 20


def claimed_items(edges: DataFrame) -> DataFrame:
    """``id`` of the items that do not lead. ``edges``: (src, dst), src before dst, src claims dst if it leads."""
    remaining = cut_lineage(edges.select("src", "dst").distinct())
    claimed = remaining.select(F.col("dst").alias("id")).limit(0)
    round_ = 0
    while not remaining.isEmpty():
        round_ += 1
        leaders = remaining.select("src").distinct().join(
            remaining.select(F.col("dst").alias("src")).distinct(), "src", "left_anti"
        )
        lost = cut_lineage(
            remaining.join(leaders, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        )
        claimed = claimed.unionByName(lost)
        if round_ % ROUNDS_PER_CUT == 0:
            claimed = cut_lineage(claimed)
        remaining = cut_lineage(
            remaining.join(lost.select(F.col("id").alias("src")), "src", "left_anti").join(
                lost.select(F.col("id").alias("dst")), "dst", "left_anti"
            )
        )
    return claimed
