"""Parquet: reading, and finding out which files share a schema without opening them on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from colscope.sources.discovery import arrow_system, glob_safe

PARQUET_FILES = "*.[pP][aA][rR][qQ][uU][eE][tT]"
PROBED = "uri string, schema_key string, error string, footer_rows bigint"
# Stands for "Spark has to read this footer": the Arrow file systems do not know the scheme.
BY_SPARK = "by-spark"


def read_parquet(spark: SparkSession, paths: list[str], merge: bool = False, skip_damaged: bool = False) -> DataFrame:
    """Parquet files of one schema, taken from the first; ``merge`` unites the schemas of a folder's parts.

    A column that some parts lack is null there; parts whose types clash are an error. ``skip_damaged`` leaves out what
    cannot be read of a file; whoever asks for that compares the rows with the footer's.
    """
    safe = [glob_safe(p) for p in paths]
    reader = spark.read.option("pathGlobFilter", PARQUET_FILES).option("ignoreCorruptFiles", skip_damaged)
    if merge:
        return reader.option("mergeSchema", True).parquet(*safe)
    first = reader.parquet(safe[0])
    return first if len(safe) == 1 else reader.schema(first.schema).parquet(*safe)


def _probe_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    import pyarrow.parquet as pq

    def probe(uri: str) -> tuple[str, str | None, str | None, int | None]:
        try:
            system, path = arrow_system(uri)
        except Exception:
            return uri, BY_SPARK, None, None
        try:
            with system.open_input_file(path) as source:
                file = pq.ParquetFile(source)
                schema, rows = file.schema_arrow.remove_metadata(), file.metadata.num_rows
            return uri, hashlib.sha256(schema.to_string().encode()).hexdigest(), None, rows
        except Exception as error:  # a broken file is reported, not fatal
            return uri, None, f"{type(error).__name__}: {error}", None

    for batch in batches:
        probed = pd.DataFrame([probe(u) for u in batch["uri"]], columns=["uri", "schema_key", "error", "footer_rows"])
        yield probed.astype({"footer_rows": "Int64"})


def probe(files: DataFrame) -> DataFrame:
    """uri, schema_key, error, footer_rows: files of equal schema share a key. Reads footers, on the executors."""
    return files.select("uri").mapInPandas(_probe_batches, PROBED)
