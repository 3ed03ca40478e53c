"""Searching a catalog by name, file, type and meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.operators import similarity
from colscope.operators.catalog import FILE, list_files

SEARCH_THRESHOLD = 0.6
HIGH_CONFIDENCE = 0.8


def contains_ignoring_case(column: str, term: str) -> Column:
    """Literal substring test in any case."""
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(term)))


def files(catalog: DataFrame, pattern: str | None = None) -> DataFrame:
    """Files whose name contains ``pattern``; all without one."""
    rows = catalog if not pattern else catalog.filter(contains_ignoring_case("file_name", pattern))
    return list_files(rows)


def schemas(catalog: DataFrame, file_pattern: str | None = None, detailed: bool = True) -> DataFrame:
    """Columns of the matching files, one row each; ``detailed=False`` gives one row per file."""
    if not detailed:
        return files(catalog, file_pattern)
    rows = catalog if not file_pattern else catalog.filter(contains_ignoring_case("file_name", file_pattern))
    return rows.select(
        *FILE, "column_name", "data_type", "null_count", "unique_count", "total_rows"
    ).orderBy(*FILE, "column_name")


def columns(catalog: DataFrame, term: str) -> DataFrame:
    """Columns whose name contains ``term``."""
    return (
        catalog.filter(contains_ignoring_case("column_name", term))
        .select(*FILE, "column_name", "data_type", "null_count", "unique_count", "total_rows")
        .orderBy(*FILE, "column_name")
    )


def files_with_columns(catalog: DataFrame, term: str) -> DataFrame:
    """Files whose name contains ``term``, with their column names (bounded by the width of a file)."""
    return (
        catalog.filter(contains_ignoring_case("file_name", term))
        .groupBy(*FILE)
        .agg(
            F.count(F.lit(1)).alias("column_count"),
            F.array_sort(F.collect_list("column_name")).alias("columns"),
        )
        .orderBy(*FILE)
    )


def types(catalog: DataFrame, term: str) -> DataFrame:
    """Columns whose type label contains ``term``."""
    return (
        catalog.filter(contains_ignoring_case("data_type", term))
        .select(*FILE, "column_name", "data_type", "null_count", "unique_count", "total_rows")
        .orderBy(*FILE, "column_name")
    )


def confidence(similarity_column: Column) -> Column:
    return F.when(F.round(similarity_column, 3) > HIGH_CONFIDENCE, "HIGH").otherwise("MED")


def semantic_columns(
    catalog: DataFrame, term: str, threshold: float = SEARCH_THRESHOLD, enrich: str = similarity.TARGET
) -> DataFrame:
    """Columns similar in meaning to ``term``, best first."""
    matches = similarity.similar_columns(catalog, term, threshold, enrich)
    return matches.select(
        *FILE,
        "column_name",
        "data_type",
        "null_count",
        "unique_count",
        F.round("similarity", 3).alias("semantic_similarity"),
        F.lit("semantic").alias("match_type"),
        confidence(F.col("similarity")).alias("confidence"),
    ).orderBy(F.desc("semantic_similarity"), *FILE, "column_name")


def search(
    catalog: DataFrame, search_term: str, search_type: str = "column", semantic: bool = False
) -> DataFrame:
    """Search by type; a column search that finds nothing falls back to meaning."""
    if not search_term or not search_term.strip():
        raise ValueError("search term must not be empty")
    by_type = {"column": columns, "file": files_with_columns, "type": types}
    if search_type not in by_type:
        raise ValueError(f"unknown search type: {search_type}")
    if semantic and search_type == "column":
        return semantic_columns(catalog, search_term)
    found = by_type[search_type](catalog, search_term)
    if search_type == "column" and found.isEmpty():
        return semantic_columns(catalog, search_term)
    return found
