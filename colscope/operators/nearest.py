"""The nearest schemas of every schema, and differences for those pairs only.

Differences of all schemas that share a column name grow with the square of a name that many hold. Here each schema gets its
``k`` most similar ones, so the rows grow with the schemas. The search is a set join in rounds of falling thresholds: whoever
has ``k`` partners at a threshold is done, as nothing unseen can be nearer, and only the others go on to the next round.
Partners below ``least`` are not sought; a column that all schemas share is no similarity by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.operators.relationships import difference_rows
from colscope.operators.shapes import Shapes, shapes_of, with_columns
from colscope.operators.similar_sets import DistinctSets, distinct_sets, similar_pairs
from colscope.session import cut_lineage

NEAREST, LEAST = 3, 0.3
# Thresholds of the rounds; the last one is ``least``.
ROUNDS = (0.95, 0.85, 0.7, 0.5, 0.3, 0.1)


def k_best(distinct: DistinctSets, k: int = NEAREST, least: float = LEAST) -> DataFrame:
    """rep, near, jaccard, rank of the ``k`` most similar distinct sets of each, among those of at least ``least``; ties by ``near``."""
    if k < 1:
        raise ValueError("k must be positive")
    open_ = distinct.sets.select("rep")
    best = Window.partitionBy("rep").orderBy(F.desc("jaccard"), "near")
    done = []
    for threshold in [t for t in ROUNDS if t > least] + [least]:
        pairs = cut_lineage(similar_pairs(distinct, threshold, open_).select("rep1", "rep2", "jaccard"))
        both = pairs.select(F.col("rep1").alias("rep"), F.col("rep2").alias("near"), "jaccard").unionByName(
            pairs.select(F.col("rep2").alias("rep"), F.col("rep1").alias("near"), "jaccard")
        )
        ranked = both.join(open_, "rep", "left_semi").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        ranked = cut_lineage(ranked)
        if threshold == least:
            done.append(ranked)
            break
        full = ranked.filter(F.col("rank") == k).select("rep")
        done.append(ranked.join(full, "rep", "left_semi"))
        open_ = cut_lineage(open_.join(full, "rep", "left_anti"))
        if open_.isEmpty():
            break
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found.select("rep", "near", "jaccard", "rank")


def nearest_shapes(found: Shapes, k: int = NEAREST, least: float = LEAST) -> DataFrame:
    """``k_best`` of the shapes by their columns, each with its type."""
    columns = F.transform("columns", lambda c: F.concat(c["name"], F.lit("\n"), c["type"]))
    return k_best(distinct_sets(found.shapes.select("rep", columns.alias("columns")), "rep", "columns"), k, least)


def nearest_schemas(catalog: DataFrame, k: int = NEAREST, least: float = LEAST) -> DataFrame:
    """The ``k`` most similar other schemas of every schema by shared columns of one type; schemas by their first files,
    ``copies`` tells how many files the near one stands for."""
    found = shapes_of(catalog)
    copies = found.shapes.select(F.col("rep").alias("near"), "copies")
    return nearest_shapes(found, k, least).join(copies, "near").select(
        "rep.file_name", "rep.file_path", F.col("near.file_name").alias("near_file"), F.col("near.file_path").alias("near_path"),
        "copies", "jaccard", "rank",
    )


def near_pairs(found: Shapes, k: int = NEAREST, least: float = LEAST) -> DataFrame:
    """rep1 < rep2: every pair of which one side is among the nearest of the other, once."""
    near = nearest_shapes(found, k, least)
    return near.select(F.least("rep", "near").alias("rep1"), F.greatest("rep", "near").alias("rep2")).distinct()


def nearest_differences(catalog: DataFrame, k: int = NEAREST, least: float = LEAST) -> DataFrame:
    """``schema_differences`` of every schema and its nearest ones: at most ``k`` rows a schema."""
    found = shapes_of(catalog)
    return difference_rows(with_columns(cut_lineage(near_pairs(found, k, least)), found.shapes))


def differences_between(catalog: DataFrame, pairs: DataFrame) -> DataFrame:
    """``schema_differences`` of given pairs of files (path1, path2), whatever they have in common, one row each.

    Pairs of unknown files are left out; copies are 1, as the rows speak of the files asked for.
    """
    found = shapes_of(catalog)
    files = found.members().join(found.shapes.select("rep", "columns"), "rep").select("file", "columns")
    asked = pairs.select("path1", "path2").distinct()
    for i in (1, 2):
        side = files.select(F.col("file.file_path").alias(f"path{i}"), F.col("file").alias(f"rep{i}"), F.col("columns").alias(f"columns{i}"))
        asked = asked.join(side.withColumn(f"copies{i}", F.lit(1).cast("bigint")), f"path{i}")
    return difference_rows(asked.drop("path1", "path2"))
