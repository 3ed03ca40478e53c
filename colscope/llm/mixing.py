"""Mixing sources to target weights along a time-varying curriculum; DataFrame functions only.

Weights are given at knots of the training time (0 to 1) and become shares there; between knots a share
runs straight. Integrating a source's share gives its part of all words, and a target that stops at ``repeat``
times the source's size (the excess goes to the others by their parts). A source fills its target by whole passes
over its documents in a fixed pseudo-random order, the last pass as far as it reaches, cutting one document.
Inverting the source's cumulative demand turns the place of a document within its source into a position in
training, by which the documents are range-sorted. ``tilt`` lets the sources of the first weight begin above their share and
end below it, the others the other way round; over the whole training each keeps the part its weights give.

Skew: a source may hold any share of the rows. The running total within a source is taken in ``BUCKETS`` slices of
the pseudo-random order, so no task holds a source; slices are pre-aggregated. The order is that of a digest of doc_id and
text, so rows without a doc_id, or with one id, are spread like others. Only rows equal in both stay in one slice.

Defined cases: a null or wordless text has size 0 and is taken with 0 words; the null source is a source of its own,
last in order; equal rows are separate documents; no rows in, no rows out; if no document has words every target is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.common import WORD, small_side, stored

# Training time -> weights of the sources in code-point order, repeating.
CONSTANT = ((0.0, (5.0, 2.0, 1.0)), (1.0, (5.0, 2.0, 1.0)))
REPEAT = 3
BUCKETS = 4096


def _sources(sizes: DataFrame, knots: Sequence, repeat: int, tilt: float) -> DataFrame:
    """One row per source: its size, the shares at the knots, its part of all words and its target.

    The table has a row per source, not per document; its windows run over that dimension only.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    everything = Window.partitionBy()
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", rank)
    for i, (time, weights) in enumerate(knots):
        cycle = F.array(*[F.lit(float(w)) for w in weights])
        weight = F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))
        table = table.withColumn(f"weight{i}", weight)
        table = table.withColumn(f"share{i}", F.col(f"weight{i}") / F.sum(f"weight{i}").over(everything))
        first = F.when(F.col("rank") % len(weights) == 0, 1.0).otherwise(0.0)
        lean = first - F.sum(F.col(f"share{i}") * first).over(everything)  # the shares' mean of it is 0
        table = table.withColumn(f"lean{i}", lean)
        table = table.withColumn(f"share{i}", F.col(f"share{i}") * (1 + tilt * (1 - 2 * float(time)) * F.col(f"lean{i}")))
    part = F.lit(0.0)
    for i in range(len(knots) - 1):
        span = float(knots[i + 1][0] - knots[i][0])
        table = table.withColumn(f"before{i}", part)
        part = part + F.lit(span / 2) * (F.col(f"share{i}") + F.col(f"share{i + 1}"))
    cap = (F.col("source_size") * repeat).cast("double")
    table = table.withColumn("part", part).withColumn("cap", cap)
    # the sources that stop first come first; each sees what is left for it and those behind it
    table = table.withColumn("limit", F.when(F.col("part") > 0, F.col("cap") / F.col("part")).otherwise(float("inf")))
    ahead = Window.orderBy("limit", "rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything).cast("double")
    left = total - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    parts_left = F.sum("part").over(everything) - F.coalesce(F.sum("part").over(ahead), F.lit(0.0))
    table = table.withColumn("total", total).withColumn("level", F.try_divide(left, parts_left))
    stops = F.coalesce(F.col("limit") <= F.col("level"), F.lit(True))
    table = table.withColumn("level", F.min(F.when(~stops, F.struct("limit", "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("part") > 0, F.least("cap", F.coalesce(F.col("level") * F.col("part"), F.col("cap"))))
    return table.withColumn("target", F.coalesce(target, F.lit(0.0))).withColumn(
        "goal", F.floor(F.col("target") + 1e-6).cast("bigint")
    )


def _position(knots: Sequence, fraction: Column) -> Column:
    """The training time at which a source has met ``fraction`` of its demand."""
    wanted = fraction * F.col("part")
    out = F.lit(float(knots[-1][0]))
    for i in reversed(range(len(knots) - 1)):
        begin, span = float(knots[i][0]), float(knots[i + 1][0] - knots[i][0])
        over = F.greatest(wanted - F.col(f"before{i}"), F.lit(0.0))
        share, slope = F.col(f"share{i}"), (F.col(f"share{i + 1}") - F.col(f"share{i}")) / span
        root = share + F.sqrt(F.greatest(share * share + 2 * slope * over, F.lit(0.0)))
        at = begin + F.least(F.coalesce(F.try_divide(2 * over, root), F.lit(0.0)), F.lit(span))
        reached = F.col(f"before{i}") + span / 2 * (F.col(f"share{i}") + F.col(f"share{i + 1}"))
        out = F.when(wanted <= reached, at).otherwise(out)
    return out


def mix(
    documents: DataFrame, columns: Sequence[str] = ("doc_id",), knots: Sequence = CONSTANT, repeat: int = REPEAT, tilt: float = 0.0
) -> DataFrame:
    """One row per document: ``document`` (a struct of ``columns``), size, source_size, target, taken (words,
    repeats counted), passes (array of epoch, words, position; empty if nothing is taken). ``tilt`` is 0 to 1."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    none = F.lit("")
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), none), F.lit(":"), F.md5(F.coalesce("text", none))))
    rows = documents.select(
        F.struct(*columns).alias("document"), F.col("source"), size.alias("size"), place.alias("place")
    )
    sizes = stored(
        rows.groupBy("source", F.conv(F.substring("place", 1, 3), 16, 10).cast("int").alias("bucket"))
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    )
    sources = stored(_sources(sizes, knots, repeat, tilt))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = stored(sizes.select("source", "bucket", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("begun")))
    within = (
        Window.partitionBy("source", "bucket")
        .orderBy("place", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    begun = begun.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "begun")
    rows = rows.join(
        small_side(begun), F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))
    ).drop("s2", "b2")
    table = small_side(sources.withColumnRenamed("source", "s3"))
    rows = rows.join(table, F.col("source").eqNullSafe(F.col("s3")))
    start = F.col("begun") + F.col("before")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = F.col("goal") - whole * F.col("source_size")
    extra = F.greatest(F.least(rest - start, F.col("size")), F.lit(0))
    rows = rows.withColumn("start", start).withColumn("whole", whole).withColumn("extra", extra)
    epochs = F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("whole"))).otherwise(
        F.array().cast("array<bigint>")
    )

    def one(epoch: Column) -> Column:
        done = F.try_divide((epoch * F.col("source_size") + F.col("start")).cast("double"), F.col("goal").cast("double"))
        return F.struct(
            epoch.alias("epoch"),
            F.when(epoch < F.col("whole"), F.col("size")).otherwise(F.col("extra")).alias("words"),
            (_position(knots, done) * F.col("total")).alias("position"),
        )

    passes = F.filter(F.transform(epochs, one), lambda p: p["words"] > 0)
    return rows.select(
        "document", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"), passes.alias("passes"),
    )


def by_first_position(mixed: DataFrame) -> DataFrame:
    """``mix`` rows range-sorted by the first position a document has; those not taken come last."""
    first = F.coalesce(F.get("passes", F.lit(0))["position"], F.lit(float("inf")))
    return (
        mixed.withColumn("first_position", first)
        .repartitionByRange("first_position", F.col("document.doc_id"))
        .sortWithinPartitions("first_position", F.col("document.doc_id"))
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per pass of a document, range-sorted by its training position."""
    rows = mixed.select("*", F.explode("passes").alias("one")).select(
        "document", "size", "one.epoch", "one.words", "one.position"
    )
    by = ["position", F.col("document.doc_id"), "epoch"]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)
