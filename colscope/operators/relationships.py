"""How files relate: common columns, similar schemas, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.operators import greedy
from colscope.operators.catalog import columns_in_files, columns_in_files_members, list_files
from colscope.operators.search import contains_ignoring_case
from colscope.operators.shapes import Shapes, file_key, shape_pairs, shapes_of
from colscope.operators.similar_sets import DistinctSets, distinct_sets, similar_pairs
from colscope.session import cut_lineage, skew_join

SCHEMA_THRESHOLD = 0.3


def legacy_threshold(threshold: float) -> float:
    """A threshold counted in tenths (up to 10) as a fraction; beyond that the default."""
    return threshold / 10 if threshold <= 10 else SCHEMA_THRESHOLD


def common_columns(catalog: DataFrame, threshold: int = 2) -> DataFrame:
    """Names in at least ``threshold`` files with their types, most frequent first."""
    return columns_in_files(catalog, threshold)


def common_column_files(catalog: DataFrame, threshold: int = 2) -> DataFrame:
    """The files of the common columns, one row each."""
    return columns_in_files_members(catalog, threshold)


def _column_sets(catalog: DataFrame) -> DistinctSets:
    files = catalog.groupBy(file_key().alias("file")).agg(F.collect_set("column_name").alias("columns"))
    return distinct_sets(files, "file", "columns")


def _flat(pairs: DataFrame, *columns: str | Column) -> DataFrame:
    return pairs.select(
        F.col("rep1.file_name").alias("file1"),
        F.col("rep1.file_path").alias("path1"),
        F.col("rep2.file_name").alias("file2"),
        F.col("rep2.file_path").alias("path2"),
        *columns,
    )


def schema_jaccard_pairs(catalog: DataFrame, threshold: float = SCHEMA_THRESHOLD) -> DataFrame:
    """Pairs of files whose column names reach a Jaccard index of ``threshold``.

    Files of equal columns are one item, named by the first and counted in ``copies``.
    """
    return _flat(
        similar_pairs(_column_sets(catalog), threshold),
        "copies1",
        "copies2",
        F.col("shared").alias("intersection"),
        F.col("united").alias("union"),
        "jaccard",
    )


def group_sets(distinct: DistinctSets, threshold: float) -> DataFrame:
    """id, leader: greedy groups of sets. A set joins the first leader it is similar to, or leads."""
    pairs = cut_lineage(similar_pairs(distinct, threshold).select("rep1", "rep2"))
    claimed = greedy.claimed_items(pairs.select(F.col("rep1").alias("src"), F.col("rep2").alias("dst")))
    from_leaders = pairs.join(claimed.select(F.col("id").alias("rep1")), "rep1", "left_anti")
    joined = from_leaders.groupBy(F.col("rep2").alias("rep")).agg(F.min("rep1").alias("leader"))
    leaders = distinct.sets.select("rep", "set_key").join(joined, "rep", "left").select(
        "set_key", F.coalesce("leader", "rep").alias("leader")
    )
    return distinct.of_members(leaders).select("id", "leader")


def schema_group_files(catalog: DataFrame, threshold: float = SCHEMA_THRESHOLD) -> DataFrame:
    """file, leader: the similar-schema group of every file, also of files alone in theirs."""
    if threshold <= 0:
        files = catalog.select(file_key().alias("file")).distinct()
        first = files.agg(F.min("file").alias("file")).select("file.*").first()
        leader = F.struct(F.lit(first.file_name).alias("file_name"), F.lit(first.file_path).alias("file_path"))
        return files.withColumn("leader", leader)
    return group_sets(_column_sets(catalog), threshold).withColumnRenamed("id", "file")


def schema_groups(catalog: DataFrame, threshold: float = SCHEMA_THRESHOLD) -> DataFrame:
    """Groups of at least two files with similar columns: leader, files, columns common to all, score.

    The score relates the number of common columns to the widest file of the group.
    """
    members = cut_lineage(schema_group_files(catalog, threshold))
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("file_count")).filter("file_count > 1")
    grouped = skew_join(members, sizes, "leader")
    columns = catalog.select(file_key().alias("file"), "column_name").join(grouped, "file")
    widths = (
        columns.groupBy("leader", "file")
        .agg(F.count(F.lit(1)).alias("width"))
        .groupBy("leader")
        .agg(F.max("width").alias("widest"))
    )
    common = (
        columns.groupBy("leader", "file_count", "column_name")
        .agg(F.count(F.lit(1)).alias("holders"))
        .filter("holders = file_count")
        .groupBy("leader")
        .agg(F.array_sort(F.collect_list("column_name")).alias("common"))
    )
    count = F.coalesce(F.size("common"), F.lit(0))
    count = F.when(F.col("common").isNull(), 0).otherwise(count).cast("bigint")
    return (
        sizes.join(widths, "leader")
        .join(common, "leader", "left")
        .select(
            F.col("leader.file_name").alias("leader_file"),
            F.col("leader.file_path").alias("leader_path"),
            "file_count",
            F.coalesce(F.array_join("common", ", "), F.lit("")).alias("common_columns"),
            count.alias("common_column_count"),
            F.round(count / F.col("widest"), 2).alias("similarity_score"),
        )
        .orderBy("leader_file", "leader_path")
    )


def names_of(columns: str) -> Column:
    return F.transform(columns, lambda c: c["name"])


def without_names(columns: str, names: Column) -> Column:
    return F.filter(columns, lambda c: ~F.array_contains(names, c["name"]))


def listed(columns: Column) -> Column:
    """Columns as ``name (type), ...``; bounded by the width of a file."""
    return F.array_join(F.transform(columns, lambda c: F.concat(c["name"], F.lit(" ("), c["type"], F.lit(")"))), ", ")


def differences_of(pairs: DataFrame) -> DataFrame:
    """Adds common, only1, only2 and mismatches to pairs of shapes, each inside the row."""
    return (
        pairs.withColumn("types2", F.map_from_entries("columns2"))
        .withColumn("common", F.array_intersect(names_of("columns1"), names_of("columns2")))
        .withColumn("only1", without_names("columns1", F.col("common")))
        .withColumn("only2", without_names("columns2", F.col("common")))
        .withColumn(
            "mismatches",
            F.filter(
                F.transform(
                    "columns1",
                    lambda c: F.struct(
                        c["name"].alias("name"),
                        c["type"].alias("type1"),
                        F.try_element_at("types2", c["name"]).alias("type2"),
                    ),
                ),
                lambda m: m["type1"] != m["type2"],
            ),
        )
        .withColumn("united", F.size("common") + F.size("only1") + F.size("only2"))
        .drop("types2")
    )


def mismatch_list(mismatches: Column) -> Column:
    return F.array_join(
        F.transform(
            mismatches, lambda m: F.concat(m["name"], F.lit(": "), m["type1"], F.lit(" vs "), m["type2"])
        ),
        ", ",
    )


def schema_differences(catalog: DataFrame) -> DataFrame:
    """Differences of the pairs of distinct schemas that share a column name, named by their first files.

    Nothing is said of schemas with nothing in common: their number grows with the square of the schemas'.

    ``copies`` tell how many files a side stands for; ``shape_members`` lists them. Columns whose type
    differs do not count as matching.
    """
    return difference_rows(shape_pairs(shapes_of(catalog).shapes))


def difference_rows(pairs: DataFrame) -> DataFrame:
    """The differences of pairs of shapes: rep1, rep2, copies1, copies2, columns1, columns2."""
    differences = differences_of(pairs)
    matching = F.size("common") - F.size("mismatches")
    return _flat(
        differences,
        "copies1",
        "copies2",
        (matching / F.col("united")).alias("similarity"),
        F.size("common").cast("bigint").alias("common_columns_count"),
        F.size("only1").cast("bigint").alias("unique_to_file1_count"),
        F.size("only2").cast("bigint").alias("unique_to_file2_count"),
        F.size("mismatches").cast("bigint").alias("type_mismatches_count"),
        listed(F.col("only1")).alias("unique_to_file1"),
        listed(F.col("only2")).alias("unique_to_file2"),
        mismatch_list(F.col("mismatches")).alias("type_mismatches"),
    )


def shape_members(catalog: DataFrame, with_types: bool = True) -> DataFrame:
    """file_name, file_path, and the first file of the same schema, which stands for it in pairs."""
    found: Shapes = shapes_of(catalog, with_types)
    return found.members().select(
        "file.*", F.col("rep.file_name").alias("first_file"), F.col("rep.file_path").alias("first_path")
    )


def _first_match(catalog: DataFrame, pattern: str) -> str:
    matches = list_files(catalog.filter(contains_ignoring_case("file_name", pattern))).take(1)
    if not matches:
        raise ValueError(f"No files found matching: {pattern}")
    return matches[0].file_path


def compare_schemas(catalog: DataFrame, item1: str, item2: str) -> DataFrame:
    """Columns of the first files matching two patterns: type on each side and whether they agree."""
    path1, path2 = _first_match(catalog, item1), _first_match(catalog, item2)

    def side(path: str, name: str) -> DataFrame:
        return catalog.filter(F.col("file_path") == path).select("column_name", F.col("data_type").alias(name))

    status = (
        F.when(F.col("type2").isNull(), "only_in_1")
        .when(F.col("type1").isNull(), "only_in_2")
        .when(F.col("type1") == F.col("type2"), "same_type")
        .otherwise("different_type")
    )
    return (
        side(path1, "type1")
        .join(side(path2, "type2"), "column_name", "full_outer")
        .select("column_name", "type1", "type2", status.alias("status"))
        .orderBy("status", "column_name")
    )
