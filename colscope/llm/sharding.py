"""Sharding by weighted rendezvous hashing of a stable record key, with DataFrame functions only.

Every shard draws an exponential waiting time for a key, ``-ln(u) / weight`` with ``u`` from a hash of key and shard; the
shortest one takes the key. A shard that is added takes rows only into itself, one that is taken away gives up its
own rows only, and a weight that grows moves rows into that shard only; a shard gets rows in proportion to its weight.
No row is moved to find its shard: one projection over the scan.

``with_slots`` numbers the rows of every shard without gaps. Rows are numbered in the order in which they were read, by
blocks of ``BLOCK_ROWS``; the blocks of a shard are numbered by their running counts. A shard of any size is so the work of
many tasks.

Defined cases: the key is compared as text, so 7 and '7' are one key; a null key is a key of its own, apart from the empty
text; equal keys always share a shard, however many rows they have; a null text has no bytes; shards of weight 0 or less get
no rows, and without any other shard the number is null; equal rows get slots of their own; no rows in, no rows out. Other
columns are carried through inside ``document``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.common import stored

# Rows numbered by one group of the window.
BLOCK_ROWS = 1 << 16
# Bits of a hash that a double holds exactly.
_BITS = 52


def waiting_times(key: Column, weights: dict[int, float]) -> Column:
    """(time, shard) of every shard with a weight."""
    whole = F.xxhash64(key.isNull(), F.coalesce(key.cast("string"), F.lit("")))
    shards = [F.struct(F.lit(s).cast("int").alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(weights.items()) if w > 0]
    if not shards:
        return F.lit(None).cast("array<struct<time:double,shard:int>>")

    def drawn(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(whole, s["shard"].cast("bigint")), 64 - _BITS) + F.lit(0.5)) / F.lit(float(1 << _BITS))
        return F.struct((-F.log(u) / s["weight"]).alias("time"), s["shard"].alias("shard"))

    return F.transform(F.array(*shards), drawn)


def placed(documents: DataFrame, weights: dict[int, float], grown: dict[int, float] | None = None, key: str = "doc_id",
           columns: list[str] | None = None) -> DataFrame:
    """``document`` (a struct of ``columns``, by default all), its shard, and its shard under the weights ``grown``."""
    carried = F.struct(*[F.col(f"`{c}`") for c in columns or documents.columns]).alias("document")
    grown = weights if grown is None else grown
    # both are chosen from one list where they agree on the weights they share
    together = {**grown, **weights}
    shared = all(grown.get(s, w) == w for s, w in weights.items())
    lists = [together] if shared else [weights, grown]
    rows = documents.select(carried, *[waiting_times(F.col(f"`{key}`"), w).alias(f"times{i}") for i, w in enumerate(lists)])

    def least(of: dict[int, float], times: Column) -> Column:
        own = F.array(*[F.lit(s) for s, w in of.items() if w > 0]).cast("array<int>")
        some = times if {s for s, w in of.items() if w > 0} == {s for s, w in together.items() if w > 0} else F.filter(times, lambda t: F.array_contains(own, t["shard"]))
        return F.array_min(some)["shard"]

    return rows.select(
        "document", least(weights, F.col("times0")).alias("shard"), least(grown, F.col(f"times{len(lists) - 1}")).alias("grown_shard")
    )


def with_slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """``rows`` with ``slot``, from 0 without gaps in every shard. The rows are stored once and read twice."""
    names = rows.columns
    numbered = stored(rows.withColumn("_nth", F.monotonically_increasing_id()))
    # the upper bits are the task that read a row, so a block is never shared by two tasks
    blocks = numbered.withColumn("_block", F.floor(F.col("_nth") / BLOCK_ROWS)).withColumn("_shard", F.coalesce(shard, F.lit(-1)))
    counts = blocks.groupBy("_shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_shard", "_block").orderBy("_nth"))
    inside = blocks.withColumn("_within", within)
    return inside.join(starts, ["_shard", "_block"]).select(*[F.col(f"`{c}`") for c in names], (F.col("_start") + F.col("_within") - 1).alias("slot"))


def write_shards(rows: DataFrame, folder: str, file_rows: int = 1 << 20) -> None:
    """Rows with ``shard`` and ``slot`` as Parquet, a folder per shard, files of at most ``file_rows`` rows in slot order.

    The rows of a large shard are dealt out by ranges of slots, so that no task writes more than a few files' worth of one.
    """
    file = F.floor(F.col("slot") / file_rows)
    dealt = rows.withColumn("_file", file).repartition("shard", "_file").sortWithinPartitions("shard", "slot")
    dealt.drop("_file").write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(folder)
