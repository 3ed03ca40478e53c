"""Queries over catalog rows: files, one file's schema, names, mismatches, totals.

(file_path, column_name) is unique in a catalog, so counting rows of a name counts its files. Distinct
counts are taken by grouping twice, never by several DISTINCT aggregates, which would copy every row and end in
a single task. Lists of files are returned as rows, in no order: the files of a common name are unbounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.session import skew_join

FILE = ["file_name", "file_path"]


def list_files(catalog: DataFrame) -> DataFrame:
    """One row per file, by name."""
    return (
        catalog.groupBy(*FILE)
        .agg(
            F.count("column_name").alias("column_count"),
            F.max("total_rows").alias("total_rows"),
            F.max("file_size_mb").alias("file_size_mb"),
            F.max("last_scanned").alias("last_scanned"),
        )
        .orderBy(*FILE)
    )


def file_schema(catalog: DataFrame, file_name: str) -> DataFrame:
    """Columns of one file, by name."""
    return (
        catalog.filter(F.col("file_name") == file_name)
        .select("column_name", "data_type", "null_count", "unique_count", "total_rows")
        .orderBy("column_name")
    )


def find_columns_like(catalog: DataFrame, term: str) -> DataFrame:
    """Columns whose name matches ``%term%`` in any case; ``_`` and ``%`` in the term are wildcards."""
    return (
        catalog.filter(F.col("column_name").ilike(f"%{term}%"))
        .select("file_name", "column_name", "data_type", "null_count", "unique_count")
        .orderBy("file_name", "column_name")
    )


def _types_of_names(catalog: DataFrame) -> DataFrame:
    """column_name, file_count, types: array of (data_type, file_count). Bounded by the type labels."""
    return (
        catalog.groupBy("column_name", "data_type")
        .agg(F.count(F.lit(1)).alias("file_count"))
        .groupBy("column_name")
        .agg(
            F.sum("file_count").alias("total_files"),
            F.array_sort(F.collect_list(F.struct("data_type", "file_count"))).alias("types"),
        )
    )


def type_mismatches(catalog: DataFrame) -> DataFrame:
    """Names with several types: one row per (name, type) with the number of files."""
    return (
        _types_of_names(catalog)
        .filter(F.size("types") > 1)
        .select("column_name", F.inline("types"))
        .orderBy("column_name", "data_type")
    )


def type_mismatch_files(catalog: DataFrame) -> DataFrame:
    """The files behind ``type_mismatches``, one row each."""
    mismatched = _types_of_names(catalog).filter(F.size("types") > 1).select("column_name")
    return skew_join(
        catalog.select("column_name", "data_type", *FILE), mismatched, "column_name", "left_semi"
    )


def columns_in_files(catalog: DataFrame, at_least: int = 2) -> DataFrame:
    """Names in at least that many files, most frequent first, with their types."""
    return (
        _types_of_names(catalog)
        .filter(F.col("total_files") >= at_least)
        .select(
            "column_name",
            F.col("total_files").alias("file_count"),
            F.size("types").cast("bigint").alias("type_variations"),
            F.array_join(F.transform("types", lambda t: t["data_type"]), ", ").alias("data_types"),
        )
        .orderBy(F.desc("file_count"), "column_name")
    )


def columns_in_files_members(catalog: DataFrame, at_least: int = 2) -> DataFrame:
    """The files behind ``columns_in_files``, one row each."""
    frequent = _types_of_names(catalog).filter(F.col("total_files") >= at_least).select(
        "column_name", F.col("total_files").alias("file_count")
    )
    return skew_join(catalog.select("column_name", "data_type", *FILE), frequent, "column_name")


def database_stats(catalog: DataFrame) -> DataFrame:
    """One row of totals; an empty catalog gives zeros."""
    per_file = catalog.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("columns"),
        F.sum("file_size_mb").alias("size_sum"),
        F.count("file_size_mb").alias("size_count"),
        F.max("last_scanned").alias("last_scan"),
    )
    files = per_file.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("columns").alias("columns"),
        F.lit(0).cast("bigint").alias("names"),
        F.sum("size_sum").alias("size_sum"),
        F.sum("size_count").alias("size_count"),
        F.max("last_scan").alias("last_scan"),
    )
    names = catalog.groupBy("column_name").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("names"))
    parts = files.unionByName(names, allowMissingColumns=True)
    average = F.sum("size_sum") / F.nullif(F.sum("size_count"), F.lit(0))
    return parts.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("total_files"),
        F.coalesce(F.sum("columns"), F.lit(0)).alias("total_columns"),
        F.coalesce(F.sum("names"), F.lit(0)).alias("unique_columns"),
        F.round(F.coalesce(average, F.lit(0.0)), 2).alias("avg_file_size_mb"),
        F.max("last_scan").alias("last_scan_time"),
    )
