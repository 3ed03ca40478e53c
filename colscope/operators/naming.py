"""Naming groups and abbreviations per pair of names, with counts instead of every pair of columns.

A greedy walk over all columns of all files claims columns by their names, so what it finds can be told per (leading name,
claimed name). How many claimed columns come after how many leading ones is counted by their ranks in the order of the
catalog, in slices of ``SLICE`` columns: a pair of names costs the occurrences of both, not their product.
The occurrences themselves are rows of ``abbreviation_columns``, one per column and pair of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.operators import semantic, similarity
from colscope.operators.dense import DenseVectors
from colscope.session import cut_lineage, skew_join

SLICE_BITS = 16


def _in_order(catalog: DataFrame) -> DataFrame:
    """name, position, at: every column and a number that grows along the catalog."""
    columns = catalog.select(F.col("column_name").alias("name"), semantic.position().alias("position"))
    ordered = columns.repartitionByRange("position").sortWithinPartitions("position")
    return cut_lineage(ordered.withColumn("at", F.monotonically_increasing_id()))


def _leading(columns: DataFrame, leaders: DataFrame) -> DataFrame:
    """name1, position, at of the leading columns; ``leaders`` (name1, first1, claimed_at)."""
    found = skew_join(columns.withColumnRenamed("name", "name1"), leaders.select("name1", "claimed_at"), "name1")
    until = F.col("claimed_at").isNull() | (F.col("position") <= F.col("claimed_at"))
    return found.filter(until).select("name1", "position", "at")


def group_names(
    catalog: DataFrame, threshold: float = semantic.NAMING_THRESHOLD, enrich: str = similarity.TARGET, dense: DenseVectors | None = None
) -> DataFrame:
    """leader, member (names), similarity, members, pairs, and where they come first.

    ``members`` are the columns called ``member`` behind the first leading column called ``leader``; ``pairs`` counts them once
    for every leading column they come after.
    """
    edges = cut_lineage(similarity.name_pairs(catalog, "column_name", threshold, enrich, dense))
    columns = _in_order(catalog)
    lead = cut_lineage(_leading(columns, semantic.leading_names(catalog, edges)))
    used = edges.join(lead.select("name1").distinct(), "name1", "left_semi")
    pair = ["name1", "name2", "similarity"]
    leads = skew_join(cut_lineage(lead), used.groupBy("name1").agg(F.collect_list(F.struct("name2", "similarity")).alias("to")), "name1")
    leads = leads.select("name1", F.explode("to").alias("e"), "at", "position").select("name1", "e.*", "at", "position", F.lit(1).alias("lead"))
    members = skew_join(
        columns.withColumnRenamed("name", "name2"), used.groupBy("name2").agg(F.collect_list(F.struct("name1", "similarity")).alias("of")), "name2"
    )
    members = members.select("name2", F.explode("of").alias("e"), "at", "position").select("name2", "e.*", "at", "position", F.lit(0).alias("lead"))
    events = cut_lineage(leads.unionByName(members).withColumn("slice", F.shiftright("at", SLICE_BITS)))
    before = Window.partitionBy("name1", "name2").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = events.groupBy("name1", "name2", "slice").agg(F.sum("lead").alias("leads"))
    slices = slices.select("name1", "name2", "slice", F.coalesce(F.sum("leads").over(before), F.lit(0)).alias("ahead"))
    # a column does not come after itself
    within = Window.partitionBy("name1", "name2", "slice").orderBy("at", "lead").rowsBetween(Window.unboundedPreceding, -1)
    counted = events.withColumn("inside", F.coalesce(F.sum("lead").over(within), F.lit(0))).join(slices, ["name1", "name2", "slice"])
    after = F.col("ahead") + F.col("inside")
    claimed = (F.col("lead") == 0) & (after > 0)
    return (
        counted.groupBy(*pair)
        .agg(
            F.count_if(claimed).alias("members"),
            F.sum(F.when(claimed, after).otherwise(0)).alias("pairs"),
            F.min(F.when(F.col("lead") == 1, F.col("position"))).alias("first_leader"),
            F.min(F.when(claimed, F.col("position"))).alias("first_member"),
        )
        .filter("members > 0")
        .select(F.col("name1").alias("leader"), F.col("name2").alias("member"), "similarity", "members", "pairs", "first_leader", "first_member")
    )


def naming_group_names(
    catalog: DataFrame, threshold: float = semantic.NAMING_THRESHOLD, enrich: str = similarity.TARGET, dense: DenseVectors | None = None
) -> DataFrame:
    """``group_names`` with files and paths, most similar first."""
    return (
        group_names(catalog, threshold, enrich, dense)
        .select(
            "leader", "member", "similarity", "members", "pairs",
            F.col("first_leader.file_name").alias("leader_file"), F.col("first_leader.file_path").alias("leader_path"),
            F.col("first_member.file_name").alias("member_file"), F.col("first_member.file_path").alias("member_path"),
        )
        .orderBy(F.desc("similarity"), "leader", "member")
    )


def naming_groups(
    catalog: DataFrame, threshold: float = semantic.NAMING_THRESHOLD, enrich: str = similarity.TARGET, dense: DenseVectors | None = None
) -> DataFrame:
    """The group of the first leading column of every leading name, where its names mix styles or all differ: one row per leading name.

    Its members are the ``members`` of ``naming_group_names``; further leading columns of the name lead the same names.
    """
    found = cut_lineage(group_names(catalog, threshold, enrich, dense))
    own = found.select("leader", F.col("leader").alias("name"), F.lit(None).cast("double").alias("similarity"), F.lit(1).cast("bigint").alias("n"),
                       F.col("first_leader").alias("first")).distinct()
    members = found.select("leader", F.col("member").alias("name"), "similarity", F.col("members").alias("n"), F.col("first_member").alias("first"))
    rows = members.unionByName(own)
    order = F.struct(-F.coalesce("similarity", F.lit(2.0)), "first")
    groups = semantic.name_groups(rows, ["leader"], "name", order, F.col("n")).filter("inconsistent")
    average = F.round(F.sum(F.col("similarity") * F.col("members")) / F.sum("members"), similarity.DIGITS)
    averages = found.groupBy("leader").agg(average.alias("avg_similarity"), F.min("first_leader").alias("first"))
    concepts = semantic.classify_names(catalog, "column_name", dense=dense).withColumnRenamed("column_name", "leader")
    return (
        groups.join(averages, "leader")
        .join(concepts, "leader")
        .select(
            "leader", F.col("first.file_name").alias("file_name"), F.col("first.file_path").alias("file_path"), "concept", "members",
            "distinct_names", "styles", "avg_similarity", "suggestion",
        )
        .orderBy(F.desc("avg_similarity"), "leader")
    )


def _short_names(
    catalog: DataFrame, threshold: float, enrich: str, dense: DenseVectors | None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges of names that differ in length, all columns in order, and the leading ones."""
    gap = F.abs(F.length("name1") - F.length("name2"))
    edges = cut_lineage(similarity.name_pairs(catalog, "column_name", threshold, enrich, dense).filter(gap >= semantic.ABBREVIATION_GAP))
    columns = _in_order(catalog)
    return edges, columns, cut_lineage(_leading(columns, semantic.leading_names(catalog, edges)))


def _short_first(first: str, second: str) -> list[Column]:
    is_short = F.length("name1") < F.length("name2")
    return [F.when(is_short, F.col(first)).otherwise(F.col(second)), F.when(is_short, F.col(second)).otherwise(F.col(first))]


def abbreviation_names(
    catalog: DataFrame, threshold: float = semantic.NAMING_THRESHOLD, enrich: str = similarity.TARGET, dense: DenseVectors | None = None
) -> DataFrame:
    """short, long, similarity, pairs: names that differ in length by three or more, with the number of pairs of columns behind
    them and where each name comes first. Names that lead each other have a row for either direction."""
    edges, columns, lead = _short_names(catalog, threshold, enrich, dense)
    leads = lead.groupBy("name1").agg(F.count(F.lit(1)).alias("n1"), F.min("position").alias("place1"))
    all_ = columns.groupBy(F.col("name").alias("name2")).agg(F.count(F.lit(1)).alias("n2"), F.min("position").alias("place2"))
    found = edges.join(leads, "name1").join(all_, "name2")
    (short, long), (place, place_long) = _short_first("name1", "name2"), _short_first("place1", "place2")
    return found.select(
        short.alias("short"), long.alias("long"), "similarity", F.col("name1").alias("leader"), (F.col("n1") * F.col("n2")).alias("pairs"),
        place["file_name"].alias("short_file"), place["file_path"].alias("short_path"),
        place_long["file_name"].alias("long_file"), place_long["file_path"].alias("long_path"),
    ).orderBy(F.desc("similarity"), "short", "long", "leader")


def abbreviation_columns(
    catalog: DataFrame, threshold: float = semantic.NAMING_THRESHOLD, enrich: str = similarity.TARGET, dense: DenseVectors | None = None
) -> DataFrame:
    """The columns behind ``abbreviation_names``: short, long, leader, column_name and file, one row per column of a pair of names."""
    edges, columns, lead = _short_names(catalog, threshold, enrich, dense)
    named = edges.select("name1", "name2", *[c.alias(n) for c, n in zip(_short_first("name1", "name2"), ("short", "long"), strict=True)])
    leading = skew_join(lead, named.groupBy("name1").agg(F.collect_list(F.struct("short", "long")).alias("to")), "name1")
    leading = leading.select(F.explode("to").alias("e"), F.col("name1").alias("leader"), F.col("name1").alias("column_name"), "position")
    used = named.join(lead.select("name1").distinct(), "name1", "left_semi")
    others = skew_join(
        columns.withColumnRenamed("name", "name2"), used.groupBy("name2").agg(F.collect_list(F.struct("short", "long", "name1")).alias("of")), "name2"
    )
    others = others.select(F.explode("of").alias("e"), F.col("name2").alias("column_name"), "position")
    others = others.select(F.struct("e.short", "e.long").alias("e"), F.col("e.name1").alias("leader"), "column_name", "position")
    return leading.unionByName(others).select(
        "e.short", "e.long", "leader", "column_name", F.col("position.file_name").alias("file_name"), F.col("position.file_path").alias("file_path")
    )
