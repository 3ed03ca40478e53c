"""The stored catalog: an append-only log of Parquet rows; of every file the rows of its newest version are current.

An update costs what it brings, not the size of the catalog, and never touches what readers hold. Versions are clock
readings, so writers need no listing and cannot claim the same folder; of two writers of one file the one with the later
clock wins, so writers' clocks have to agree better than their updates of a file follow each other.
A read takes the log once. ``compacted`` writes the current rows elsewhere, without history.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.labels import CATALOG_SCHEMA

class CatalogStore:
    """Catalog rows keyed by (file_path, column_name)."""

    schema = CATALOG_SCHEMA

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _log(self) -> DataFrame:
        fields = [*self.schema.fields, T.StructField("version", T.LongType()), T.StructField("removed", T.BooleanType())]
        try:
            return self.spark.read.schema(T.StructType(fields)).option("recursiveFileLookup", "true").parquet(self.root)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], T.StructType(fields))

    def _newest(self) -> DataFrame:
        """The log rows of every file's newest version, removals included; one shuffle of the log by file."""
        newest = F.max("version").over(Window.partitionBy("file_path"))
        return self._log().withColumn("newest", newest).filter("version = newest").drop("newest")

    def read(self) -> DataFrame:
        """The current catalog; an absent one is empty."""
        return self._newest().filter("NOT removed").select(*self.schema.fieldNames())

    def _append(self, rows: DataFrame, removed: bool) -> DataFrame:
        (
            rows.select(
                *self.schema.fieldNames(), F.lit(time.time_ns()).alias("version"), F.lit(removed).alias("removed")
            )
            .repartitionByRange("file_path", "column_name")
            .sortWithinPartitions("file_path", "column_name")
            .write.mode("append")
            .parquet(self.root)
        )
        return self.read()

    def upsert(self, rows: DataFrame) -> DataFrame:
        """Replace the rows of every file that occurs in ``rows``; returns the new catalog."""
        return self._append(rows, removed=False)

    def _remove(self, rows: DataFrame) -> DataFrame:
        """Append a removal for every file in ``rows``."""
        empty = [
            F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in ("file_path", "file_name")
        ]
        return self._append(rows.select("file_path", "file_name", *empty).distinct(), removed=True)

    def remove(self, files: DataFrame) -> DataFrame:
        """Drop all rows of the files listed in ``files`` (file_path, or file_name for every path of a name)."""
        key = "file_path" if "file_path" in files.columns else "file_name"
        return self._remove(self.read().join(files.select(key).distinct(), key, "left_semi"))

    def remove_file(self, file_name: str) -> DataFrame:
        """Drop all rows of the files called ``file_name``."""
        return self._remove(self.read().filter(F.col("file_name") == file_name))

    def compacted(self, root: str) -> CatalogStore:
        """A store at ``root`` that holds the current rows only."""
        store = CatalogStore(self.spark, root)
        store.upsert(self.read())
        return store
