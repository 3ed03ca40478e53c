"""Exporting results into per-day folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions import text

_DAY_FOLDER = r"/export_date=(\d{4}-\d{2}-\d{2})/"
_EXPORT = r"/export_date=\d{4}-\d{2}-\d{2}/query_slug=[^/]*/export_time=[^/]*/"


def export_result(result: DataFrame, query: str, root: str) -> str:
    """Append ``result`` under ``root``/day/slug/time; the writer runs on the executors."""
    spark = result.sparkSession
    stamp = spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd").alias("day"),
        F.date_format(F.current_timestamp(), "HH-mm-ss").alias("time"),
        text.slug(F.lit(query)).alias("slug"),
    ).first()
    path = f"{root.rstrip('/')}/export_date={stamp.day}/query_slug={stamp.slug}/export_time={stamp.time}"
    result.write.mode("append").parquet(path)
    return path


def export_large(result: DataFrame, query: str, root: str, threshold: int = text.EXPORT_THRESHOLD) -> str | None:
    """Export a result of more than ``threshold`` rows; a smaller one is left to be shown."""
    if result.limit(threshold + 1).count() <= threshold:
        return None
    return export_result(result, query, root)


def export_stats(spark: SparkSession, root: str) -> DataFrame:
    """One row: total_exports, day_folders."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(root)
        .select(F.col("_metadata.file_path").alias("uri"))
    )
    exports = files.groupBy(
        F.regexp_extract("uri", _DAY_FOLDER, 1).alias("day"), F.regexp_extract("uri", _EXPORT, 0).alias("export")
    ).agg(F.lit(1).alias("one"))
    days = exports.groupBy("day").agg(F.count(F.lit(1)).alias("exports"))
    return days.agg(
        F.coalesce(F.sum("exports"), F.lit(0)).alias("total_exports"), F.count("day").alias("day_folders")
    )
