"""A folder's catalog kept per part: a refresh profiles the parts that changed, tables are united from what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions import labels
from colscope.operators import sketches
from colscope.session import cut_lineage
from colscope.sources import discovery, scan
from colscope.sources.catalog_store import CatalogStore

_STATE = ["size_bytes", "modified_at", "format"]
PART_SCHEMA = T.StructType(
    [
        *sketches.SKETCHED_SCHEMA.fields,
        T.StructField("size_bytes", T.LongType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("format", T.StringType()),
    ]
)


class PartStore(CatalogStore):
    """Profiles of the files below ``folder``, stored at ``root``, a row per (file, column) with sketches."""

    schema = PART_SCHEMA

    def __init__(self, spark: SparkSession, root: str, folder: str) -> None:
        super().__init__(spark, root)
        self.folder = folder

    def refresh(self) -> scan.ScanResult:
        """Profile the files whose size or time of change is not the stored one and forget those that are gone.

        Returns the profiles of the files that were read, and what was turned away; that is forgotten too and tried again by
        the next refresh.
        """
        listed = cut_lineage(discovery.discover(self.spark, self.folder))
        known = self.read().select("file_path", "file_name", *_STATE).distinct()
        changed = listed.join(known, ["file_path", *_STATE], "left_anti")
        found = scan.scan_tables(self.spark, discovery.tables_of(changed), sketched=True)
        profiles = cut_lineage(found.schema_info.join(listed.select("file_path", *_STATE), "file_path"))
        stale = known.join(listed, "file_path", "left_anti").select("file_path").unionByName(
            known.join(found.rejected, "file_path", "left_semi").select("file_path")
        )
        stale = cut_lineage(stale)
        self.upsert(profiles)
        self.remove(stale)
        return scan.ScanResult(profiles, found.rejected)

    def tables(self, layout: str = discovery.TABLE_PER_FOLDER, labels_mode: str = labels.NATIVE) -> scan.ScanResult:
        """The catalog of the stored parts, by folder or by file; reads no data."""
        by_folder = layout == discovery.TABLE_PER_FOLDER
        table = discovery.parent_folder(F.col("file_path")) if by_folder else F.col("file_path")
        return scan.ScanResult(*sketches.united(self.read(), table, labels_mode))

    def compacted(self, root: str) -> PartStore:
        """A store at ``root`` that holds the current rows only."""
        store = PartStore(self.spark, root, self.folder)
        store.upsert(self.read())
        return store
