"""Keeping the catalog up to date: files that arrive in a folder are profiled and replace their catalog rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from colscope.sources import discovery, scan
from colscope.sources.catalog_store import CatalogStore


def rescan_arrivals(
    spark: SparkSession, folder: str, store: CatalogStore, progress: str, files_per_batch: int = 1_000
) -> StreamingQuery:
    """Profile files as they arrive; each micro-batch is one scan and one append to the catalog.

    The stream is the listing, not the contents. ``progress`` is the folder of the stream's own state. A batch that
    is repeated after a failure replaces the same rows. Stops once it has seen all files there are.
    """
    schema = spark.read.format("binaryFile").load(discovery.glob_safe(folder)).schema
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(discovery.glob_safe(folder))
    )
    listed = discovery.describe(arrivals)

    def profile_batch(files: DataFrame, _: int) -> None:
        found = scan.scan_tables(files.sparkSession, discovery.tables_of(files))
        store.upsert(found.schema_info)

    return (
        listed.writeStream.foreachBatch(profile_batch)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
