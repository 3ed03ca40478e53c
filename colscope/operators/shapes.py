"""Shapes: the distinct schemas of a catalog.

Most files of a lake share their schema with others. Whatever compares files compares shapes, each named by
its first file and weighted by its copies; ``members`` lead back to the files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.operators.joins import posting_pairs
from colscope.session import cut_lineage, skew_join


def file_key() -> Column:
    """The order of files, and the id of a shape (its first file)."""
    return F.struct("file_name", "file_path")


@dataclass
class Shapes:
    """``shapes``: key, rep and last (first and last file), columns (array of name/type, by name), copies.

    ``files``: file, key.
    """

    shapes: DataFrame
    files: DataFrame

    def members(self) -> DataFrame:
        """file, rep of every file; a third of the files may share one shape."""
        return skew_join(cut_lineage(self.files), self.shapes.select("key", "rep"), "key").select("file", "rep")


def shapes_of(catalog: DataFrame, with_types: bool = True) -> Shapes:
    """Collapse files of equal columns (and types). A file's columns are bounded by its width."""
    column = F.struct(
        F.col("column_name").alias("name"), (F.col("data_type") if with_types else F.lit("")).alias("type")
    )
    files = (
        catalog.select(file_key().alias("file"), column.alias("column"))
        .groupBy("file")
        .agg(F.array_sort(F.collect_set("column")).alias("columns"))
        .withColumn("key", F.sha2(F.to_json("columns"), 256))
    )
    classes = cut_lineage(
        files.groupBy("key").agg(
            F.min("file").alias("rep"), F.max("file").alias("last"), F.first("columns").alias("columns"), F.count(F.lit(1)).alias("copies")
        )
    )
    return Shapes(classes, files.select("file", "key"))


def _names(shapes: DataFrame, rep: str, name: str, *more: str) -> DataFrame:
    return shapes.select(F.col("rep").alias(rep), *more, F.explode(F.transform("columns", lambda c: c["name"])).alias(name))


def with_columns(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Pairs (rep1, rep2) of shapes with what is known of either side."""
    one = shapes.select(F.col("rep").alias("rep1"), F.col("columns").alias("columns1"), F.col("copies").alias("copies1"))
    two = shapes.select(
        F.col("rep").alias("rep2"), F.col("last").alias("last2"), F.col("columns").alias("columns2"), F.col("copies").alias("copies2")
    )
    return pairs.join(one, "rep1").join(two, "rep2")


def shape_pairs(shapes: DataFrame) -> DataFrame:
    """Every pair of shapes in file order that share a column name, with their columns."""
    left, right = _names(shapes, "rep1", "name"), _names(shapes, "rep2", "name")
    pairs = posting_pairs(left, right, "name", F.col("rep1") < F.col("rep2"))
    return with_columns(cut_lineage(pairs.select("rep1", "rep2").distinct()), shapes)


def ordered_shape_pairs(shapes: DataFrame, similar: DataFrame) -> DataFrame:
    """Every ordered pair of different shapes that share a column name or hold ``similar`` ones (name1, name2), and of
    which some file of the first precedes some file of the second."""
    left = _names(shapes, "rep1", "name1")
    wanted = skew_join(cut_lineage(left), similar.groupBy("name1").agg(F.collect_set("name2").alias("names")), "name1", "left")
    wanted = wanted.select("rep1", F.explode(F.array_union(F.array("name1"), F.coalesce("names", F.array().cast("array<string>")))).alias("name"))
    right = _names(shapes.withColumn("last2", F.col("last")), "rep2", "name", "last2")
    pairs = posting_pairs(cut_lineage(wanted.distinct()), right, "name", in_file_order() & (F.col("rep1") != F.col("rep2")))
    return with_columns(cut_lineage(pairs.select("rep1", "rep2").distinct()), shapes)


def in_file_order() -> Column:
    """Whether some file of shape 1 precedes some file of shape 2."""
    return F.col("rep1") < F.col("last2")


def second_file() -> Column:
    """A file of shape 2 that the first file of shape 1 precedes."""
    return F.when(F.col("rep1") < F.col("rep2"), F.col("rep2")).otherwise(F.col("last2"))
