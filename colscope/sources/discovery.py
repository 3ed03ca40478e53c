"""Finding data files: recursive listing, supported suffixes, size gate."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.session import cut_lineage

SUPPORTED = r"(?i)\.(csv|parquet)$"
MIB = 1048576
TABLE_PER_FILE = "file"
TABLE_PER_FOLDER = "folder"


def glob_safe(path: str) -> str:
    """A literal path for the readers, which would expand glob characters."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def plain_path(uri: Column) -> Column:
    """``file:///a%20b`` as ``/a b``; other schemes keep their URI."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def arrow_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a file, and its path there; an error if none knows the scheme."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(uri[len("file:"):]).lstrip("/")
    return fs.FileSystem.from_uri(uri)


def arrow_file(uri: str) -> pa.NativeFile:
    """A file opened for reading at any place."""
    system, path = arrow_system(uri)
    return system.open_input_file(path)


def parent_folder(uri: Column) -> Column:
    """The folder of a file, above any ``key=value`` partition folders."""
    return F.regexp_replace(uri, r"(/[^/=]+=[^/]*)*/[^/]*$", "")


def describe(listing: DataFrame) -> DataFrame:
    """uri, file_path, file_name, format, size_bytes, modified_at of the supported files of a ``binaryFile`` source.

    The ``content`` column of the source is pruned, so only the listing is read.
    """
    name = F.regexp_extract(F.col("file_path"), r"[^/]*$", 0)
    return (
        listing.select(
            F.col("_metadata.file_path").alias("uri"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("modified_at"),
        )
        .withColumn("file_path", plain_path(F.col("uri")))
        .withColumn("file_name", name)
        .filter(F.col("file_name").rlike(SUPPORTED))
        .withColumn("format", F.lower(F.regexp_extract("file_name", SUPPORTED, 1)))
        .select("uri", "file_path", "file_name", "format", "size_bytes", "modified_at")
    )


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files below ``folder``, at any depth."""
    return describe(
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob_safe(folder))
    )


def _listed(folder: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a folder, given as path or URI, and its path there."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def unlisted(spark: SparkSession, folder: str) -> DataFrame:
    """file_path, file_name, reason of the supported files that Spark's listing leaves out: hidden and empty ones.

    Folders are listed on the executors, level by level; the driver learns how many folders a level has. A folder that cannot
    be listed, or is of a scheme that the Arrow file systems do not know, is a row of its own.
    """
    told = "file_path string, file_name string, reason string"
    try:
        system, root = _listed(folder)
        if system.get_file_info(root).type != fs.FileType.Directory:
            return spark.createDataFrame([], told)
    except Exception as error:
        reason = f"hidden and empty files are not listed: {type(error).__name__}"
        return spark.createDataFrame([(folder, folder.rstrip("/").rsplit("/", 1)[-1], reason)], told)

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _listed(folder)
        for batch in batches:
            for path, hidden in zip(batch["file_path"], batch["hidden"]):
                rows = []
                try:
                    entries = system.get_file_info(fs.FileSelector(path))
                except OSError as error:
                    entries = []
                    rows.append((path, path.rsplit("/", 1)[-1], f"folder not listed: {type(error).__name__}", False, False))
                for entry in entries:
                    name = entry.base_name
                    unseen = bool(hidden) or name.startswith(".") or (name.startswith("_") and "=" not in name)
                    if entry.type == fs.FileType.Directory:
                        rows.append((entry.path, name, None, True, unseen))
                    elif re.search(SUPPORTED, name) and (unseen or entry.size == 0):
                        reason = "hidden from Spark's readers by its name" if unseen else "No columns to parse from file"
                        rows.append((entry.path, name, reason, False, unseen))
                yield pd.DataFrame(rows, columns=["file_path", "file_name", "reason", "folder", "hidden"])

    level, folders = spark.createDataFrame([(root, False)], "file_path string, hidden boolean"), 1
    found = []
    while folders:
        tasks = min(folders, spark.sparkContext.defaultParallelism)
        entries = cut_lineage(level.repartition(tasks).mapInPandas(children, f"{told}, folder boolean, hidden boolean"))
        found.append(entries.filter("NOT folder").select("file_path", "file_name", "reason"))
        level = entries.filter("folder").select("file_path", "hidden")
        folders = level.count()
    return reduce(DataFrame.unionByName, found)


def tables_of(files: DataFrame, layout: str = TABLE_PER_FILE) -> DataFrame:
    """Group files into tables: each file, or each folder of part files of one format."""
    if layout == TABLE_PER_FILE:
        return files.withColumn("files", F.lit(1).cast("bigint"))
    if layout != TABLE_PER_FOLDER:
        raise ValueError(f"unknown layout: {layout}")
    return (
        files.withColumn("uri", parent_folder(F.col("uri")))
        .groupBy("uri", "format")
        .agg(
            F.sum("size_bytes").alias("size_bytes"),
            F.max("modified_at").alias("modified_at"),
            F.count(F.lit(1)).alias("files"),
        )
        .withColumn("file_path", plain_path(F.col("uri")))
        .withColumn("file_name", F.regexp_extract("file_path", r"[^/]*$", 0))
        .select("uri", "file_path", "file_name", "format", "size_bytes", "modified_at", "files")
    )


def size_gate(tables: DataFrame, max_file_size_mb: float | None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); a rejected table carries the reason. No limit accepts all."""
    if max_file_size_mb is None:
        return tables, tables.limit(0).select("file_path", "file_name", F.lit("").alias("reason"))
    size = F.col("size_bytes") / MIB
    reason = F.format_string(f"File too large: %.1fMB > {max_file_size_mb}MB", size)
    return (
        tables.filter(size <= max_file_size_mb),
        tables.filter(size > max_file_size_mb).select("file_path", "file_name", reason.alias("reason")),
    )
