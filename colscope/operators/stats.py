"""Statistics of the whole catalog, of files and of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.operators import search
from colscope.operators.catalog import FILE, list_files

PREVIEW = 5


def catalog_totals(catalog: DataFrame) -> DataFrame:
    """One row: files, rows over all files, distinct names, distinct types and their list."""
    per_file = list_files(catalog).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("total_rows"), F.lit(0)).alias("rows")
    )
    per_name = (
        catalog.groupBy("column_name", "data_type")
        .agg(F.lit(1).alias("one"))
        .groupBy("column_name")
        .agg(F.collect_set("data_type").alias("types"))
        .agg(F.count(F.lit(1)).alias("names"), F.array_distinct(F.flatten(F.collect_set("types"))).alias("types"))
    )
    parts = per_file.unionByName(per_name, allowMissingColumns=True)
    types = F.array_sort(F.flatten(F.collect_list("types")))
    return parts.agg(
        F.sum("files").alias("total_files"),
        F.sum("rows").alias("total_rows"),
        F.sum("names").alias("unique_columns"),
        F.size(types).cast("bigint").alias("unique_types"),
        F.array_join(types, ", ").alias("data_types"),
    )


def file_stats(catalog: DataFrame, target: str) -> DataFrame:
    """Rows, columns, size and last scan of the files whose name contains ``target``."""
    return search.files(catalog, target)


def column_stats(catalog: DataFrame, target: str) -> DataFrame:
    """One row: matches, distinct files, types, the first five matches and how many more there are."""
    matches = search.columns(catalog, target)
    counts = (
        matches.groupBy("file_path")
        .agg(F.count(F.lit(1)).alias("matches"), F.collect_set("data_type").alias("types"))
        .agg(
            F.sum("matches").alias("matches"),
            F.count(F.lit(1)).alias("files"),
            F.array_distinct(F.flatten(F.collect_set("types"))).alias("types"),
        )
    )
    first = (
        matches.limit(PREVIEW)
        .select(
            F.struct(
                *FILE,
                "column_name",
                F.concat("file_name", F.lit(": "), "column_name", F.lit(" ("), "data_type", F.lit(")")).alias("line"),
            ).alias("match")
        )
        .agg(F.array_sort(F.collect_list("match")).alias("preview"))
    )
    parts = counts.unionByName(first, allowMissingColumns=True)
    matched = F.coalesce(F.sum("matches"), F.lit(0))
    return parts.agg(
        matched.alias("matches"),
        F.sum("files").alias("files"),
        F.array_join(F.array_sort(F.flatten(F.collect_list("types"))), ", ").alias("data_types"),
        F.array_join(F.transform(F.flatten(F.collect_list("preview")), lambda m: m["line"]), "; ").alias("preview"),
        F.greatest(matched - PREVIEW, F.lit(0)).alias("more"),
    )


def largest_files(catalog: DataFrame, top: int = 10) -> DataFrame:
    """Files with the most columns."""
    return (
        catalog.groupBy(*FILE)
        .agg(F.count(F.lit(1)).alias("column_count"), F.max("total_rows").alias("total_rows"))
        .orderBy(F.desc("column_count"), *FILE)
        .limit(top)
    )


def statistics(catalog: DataFrame, scope: str = "database", target: str | None = None) -> DataFrame:
    """Statistics by scope: ``database``, ``file`` or ``column``; the last two need a target."""
    if scope == "database":
        return catalog_totals(catalog)
    if scope not in ("file", "column"):
        raise ValueError(f"unknown scope: {scope}")
    if not target:
        raise ValueError(f"scope {scope} needs a target")
    return file_stats(catalog, target) if scope == "file" else column_stats(catalog, target)
