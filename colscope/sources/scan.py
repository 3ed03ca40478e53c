"""The scan: from a folder to catalog rows.

Tables are grouped by schema (Parquet) or by dialect and header (CSV), each group is one scan, and
the groups of a chunk are profiled by one job. The driver holds table names and paths, as Spark's
own file index does, never data.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from colscope.functions import labels
from colscope.operators.profile import TableGroup, profile
from colscope.operators.sketches import SKETCHED_SCHEMA
from colscope.session import cut_lineage
from colscope.sources import csv_records, csv_tables, discovery, parquet_tables

GROUPS_PER_JOB = 50
TABLES_PER_GROUP = 10_000
# Rows that the dialect of a CSV file is taken from; rows after them may contradict it.
HEAD_ROWS = 100
_SAMPLE_SEED = 42
# Columns that a sample tells its rows' places by.
PATH, ROW = csv_records.PATH, "_colscope_row"


@dataclass
class ScanResult:
    """``schema_info``: catalog rows. ``rejected``: file_path, file_name, reason."""

    schema_info: DataFrame
    rejected: DataFrame


@contextmanager
def _case_sensitive(spark: SparkSession) -> Iterator[None]:
    """Files may hold columns that differ by case only."""
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def head_sample(df: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` rows of one file, in file order; a sort of the top rows only, block by block."""
    return (
        df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
        .withColumn("_row", F.monotonically_increasing_id())
        .orderBy("_path", "_block", "_row")
        .limit(rows)
        .drop("_path", "_block", "_row")
    )


def seeded_samples(df: DataFrame, rows: int, per_file: bool = True) -> DataFrame:
    """``rows`` rows of every file of a Parquet scan, or of the scan as a whole, without replacement, the same ones on every run.

    Rows are ranked by the digest of a seed and their place in the file. A first look, which reads no column, counts the rows
    of each file; only those whose digest is low enough to be among the chosen are read on and ranked, some more than wanted.
    Nothing is sorted as a whole, and any number of files is one job. The result has the columns ``PATH`` and ``ROW`` too.
    """
    own = F.col("_metadata.file_path") if per_file else F.lit("")
    place = F.col("_metadata.row_index").cast("string")
    place = place if per_file else F.concat(place, F.lit(":"), F.col("_metadata.file_path"))
    digest = F.md5(F.concat(F.lit(f"{_SAMPLE_SEED}:"), place))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    looked = df.select(own.alias(PATH), share.alias("share"))
    counts = looked.groupBy(PATH).agg(F.count(F.lit(1)).alias("n"))
    wanted = float(rows + 6 * math.sqrt(rows) + 20)
    cut = cut_lineage(counts.withColumn("cut", F.least(F.lit(1.0), wanted / F.col("n"))))
    # where chance left too few below the cut, all rows are ranked
    found = looked.join(F.broadcast(cut), PATH).filter("share <= cut").groupBy(PATH).agg(F.count(F.lit(1)).alias("found"))
    short = F.coalesce("found", F.lit(0)) < F.least(F.col("n"), F.lit(rows))
    cut = cut_lineage(cut.join(found, PATH, "left").select(PATH, F.when(short, F.lit(1.0)).otherwise(F.col("cut")).alias("_cut")))
    marked = df.select("*", own.alias(PATH), F.col("_metadata.row_index").alias(ROW), digest.alias("_digest"), share.alias("_share"))
    chosen = marked.join(F.broadcast(cut), PATH).filter(F.col("_share") <= F.col("_cut"))
    best = Window.partitionBy(PATH).orderBy("_digest", ROW)
    return chosen.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= rows).drop("_rank", "_digest", "_share", "_cut")


def _table_id(by_file: bool, uri: str) -> Column:
    return F.xxhash64(F.col("_metadata.file_path") if by_file else F.lit(uri))


def _described(spark: SparkSession, tables: list[Row]) -> DataFrame:
    rows = [(t.uri, t.file_name, t.file_path, t.size_bytes) for t in tables]
    return spark.createDataFrame(rows, "uri string, file_name string, file_path string, size bigint").select(
        F.xxhash64("uri").alias("table_id"),
        "file_name",
        "file_path",
        F.round(F.col("size") / discovery.MIB, 2).alias("file_size_mb"),
    )


def _groups(
    spark: SparkSession, tables: list[Row], layout: str, read: Callable[[list[Row]], tuple[DataFrame, list[str]]], text: bool
) -> Iterator[TableGroup]:
    """Scans over tables known to share schema and dialect; a scan with ``PATH`` tells the file of a row by it."""
    by_file = layout == discovery.TABLE_PER_FILE
    size = TABLES_PER_GROUP if by_file else 1

    def group(part: list[Row]) -> TableGroup:
        frame, names = read(part)
        fields = [f for f in frame.schema.fields if f.name not in (PATH, ROW)]
        middle = len(part) // 2
        halves = (lambda: [group(part[:middle]), group(part[middle:])]) if middle else None
        table_id = F.xxhash64(PATH) if by_file and PATH in frame.columns else _table_id(by_file, part[0].uri)
        return TableGroup(frame, table_id, _described(spark, part), fields, names, text, halves)

    for start in range(0, len(tables), size):
        yield group(tables[start:start + size])


def _rejections(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "file_path string, file_name string, reason string")


def _parquet_groups(
    spark: SparkSession, tables: DataFrame, layout: str, sample_rows: int | None, footers: dict[str, int]
) -> tuple[list[TableGroup], list[tuple[str, str, str]]]:
    """Scans of the Parquet tables, and what is turned away; ``footers`` is given the rows of each file by its footer."""
    rejected: list[tuple[str, str, str]] = []
    families: dict[str, list[Row]] = defaultdict(list)
    if layout == discovery.TABLE_PER_FILE:
        probed = tables.join(parquet_tables.probe(tables), "uri").orderBy("file_name", "file_path")
    else:
        probed = tables.withColumn("schema_key", F.lit(parquet_tables.BY_SPARK)).withColumn(
            "error", F.lit(None).cast("string")
        ).withColumn("footer_rows", F.lit(None).cast("bigint"))
    for table in probed.collect():
        if table.error:
            rejected.append((table.file_path, table.file_name, table.error))
        elif table.schema_key == parquet_tables.BY_SPARK:
            families[table.uri].append(table)
        else:
            families[table.schema_key].append(table)

    def read(part: list[Row]) -> tuple[DataFrame, list[str]]:
        by_file = layout == discovery.TABLE_PER_FILE
        # a sample cannot be compared with footers; what is damaged fails there
        skip = sample_rows is None and all(t.footer_rows is not None for t in part)
        frame = parquet_tables.read_parquet(spark, [t.file_path for t in part], merge=not by_file, skip_damaged=skip)
        return frame if sample_rows is None else seeded_samples(frame, sample_rows, by_file), frame.columns

    groups: list[TableGroup] = []
    for family in families.values():
        if sample_rows is None:
            footers.update((t.file_path, t.footer_rows) for t in family if t.footer_rows is not None)
        try:
            groups.extend(_groups(spark, family, layout, read, text=False))
        except Exception as error:
            rejected.extend((t.file_path, t.file_name, _reason(error)) for t in family)
    return groups, rejected


def _read_dialect(
    spark: SparkSession, files: list[Row], dialect: tuple[str, str, bool], sample_rows: int | None, by_heads: bool
) -> tuple[DataFrame, list[str]]:
    """CSV files (part_uri, part_path, size) of one dialect and header; their first rows, if only a sample is wanted.

    ``by_heads`` tells that the dialect is known of their heads only.
    """
    uris, paths = [f.part_uri for f in files], [f.part_path for f in files]
    reachable = csv_records.reachable(uris[0])
    if sample_rows is not None and reachable:
        return csv_records.read_heads(spark, uris, paths, sample_rows, *dialect)
    if sample_rows is not None:
        heads = [(head_sample(csv_tables.read_csv(spark, [p], *dialect)[0], sample_rows), u) for p, u in zip(paths, uris)]
        names = csv_tables.read_csv(spark, paths, *dialect)[1]
        return reduce(DataFrame.unionByName, [head.withColumn(PATH, F.lit(uri)) for head, uri in heads]), names
    if dialect[2] and reachable:
        return csv_records.read_split(spark, [(f.part_uri, f.size) for f in files], paths, *dialect[:2])
    if by_heads and reachable:
        return csv_tables.read_lines(spark, paths, *dialect[:2], PATH)
    return csv_tables.read_csv(spark, paths, *dialect)


def _csv_groups(
    spark: SparkSession, tables: DataFrame, layout: str, sample_rows: int | None, by_heads: bool = True
) -> tuple[list[TableGroup], list[tuple[str, str, str]]]:
    """Scans of the CSV tables, and what is turned away; dialects are taken from heads, or from all lines."""
    rejected: list[tuple[str, str, str]] = []
    listed = tables.select("file_path", "uri").collect()
    if not listed:
        return [], []
    by_file = layout == discovery.TABLE_PER_FILE
    probed = _probed(spark, [(r.file_path, r.uri) for r in listed], by_file, sample_rows, by_heads).withColumnRenamed("uri", "part_uri")
    probed = probed.withColumn("uri", F.col("part_uri") if by_file else discovery.parent_folder(F.col("part_uri")))
    probed = probed.withColumn("part_path", discovery.plain_path(F.col("part_uri")))
    families: dict[tuple, list[Row]] = defaultdict(list)
    folders: dict[str, list[Row]] = defaultdict(list)
    for table in tables.join(probed, "uri", "left").orderBy("file_name", "file_path", "part_path").collect():
        if table.header is None:
            rejected.append((table.file_path, table.file_name, "No columns to parse from file"))
        elif by_file:
            families[(table.encoding, table.separator, table.multi_line, table.header)].append(table)
        else:
            folders[table.uri].append(table)

    def files_of(key: tuple) -> Callable[[list[Row]], tuple[DataFrame, list[str]]]:
        return lambda part: _read_dialect(spark, part, key[:3], sample_rows, by_heads)

    def parts_of(rows: list[Row]) -> Callable[[list[Row]], tuple[DataFrame, list[str]]]:
        """A folder's parts, those of one dialect and header by one scan, matched by column name."""
        alike: dict[tuple, list[Row]] = defaultdict(list)
        for r in rows:
            alike[(r.encoding, r.separator, r.multi_line, r.header)].append(r)

        def read(_: list[Row]) -> tuple[DataFrame, list[str]]:
            parts = [files_of(key)(files) for key, files in alike.items()]
            frame, names = csv_tables.united(parts)
            return frame if sample_rows is None else frame.limit(sample_rows), names

        return read

    scans = [(family, files_of(key)) for key, family in families.items()]
    scans += [(rows[:1], parts_of(rows)) for rows in folders.values()]
    groups: list[TableGroup] = []
    for family, read in scans:
        try:
            groups.extend(_groups(spark, family, layout, read, text=True))
        except Exception as error:
            rejected.extend((t.file_path, t.file_name, _reason(error)) for t in family)
    return groups, rejected


def _probed(
    spark: SparkSession, listed: list[tuple[str, str]], by_file: bool, sample_rows: int | None, by_heads: bool
) -> DataFrame:
    """uri, encoding, separator, multi_line, header, size of the CSV files of the listed tables (path, uri)."""
    paths = [path for path, _ in listed]
    if not (by_heads or sample_rows) or not csv_records.reachable(listed[0][1]):
        return csv_tables.probe(spark, paths)
    uris = [uri for _, uri in listed]
    if not by_file:
        parts = discovery.describe(csv_tables.listing(spark, paths))
        uris = [r.uri for r in parts.select("uri").collect()]
    return csv_records.probe_heads(spark, uris, sample_rows or HEAD_ROWS)


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"


def _profile_or_split(
    spark: SparkSession, groups: list[TableGroup], mode: str, exact: bool, sketched: bool
) -> tuple[list[DataFrame], list[DataFrame]]:
    """Profile a chunk; if it fails, halve it, then its scans, until the failing table is alone; reject that one."""
    try:
        return [cut_lineage(profile(groups, mode, exact, sketched))], []
    except Exception as error:
        if len(groups) == 1 and groups[0].halves is not None:
            try:
                groups = groups[0].halves()
            except Exception as cause:
                error = cause
        if len(groups) == 1:
            reason = F.lit(_reason(error))
            return [], [groups[0].tables.select("file_path", "file_name", reason.alias("reason"))]
    middle = len(groups) // 2
    left, right = (_profile_or_split(spark, part, mode, exact, sketched) for part in (groups[:middle], groups[middle:]))
    return left[0] + right[0], left[1] + right[1]


def scan_folder(
    spark: SparkSession,
    folder: str,
    layout: str = discovery.TABLE_PER_FILE,
    max_file_size_mb: float | None = None,
    sample_rows: int | None = None,
    labels_mode: str = labels.NATIVE,
    exact: bool = True,
) -> ScanResult:
    """Profile every supported file below ``folder``; what cannot be read is reported, the rest goes on.

    ``sample_rows`` profiles the first rows of a CSV and a seeded sample of a Parquet file instead of
    all rows. ``layout="folder"`` takes each folder of part files as one table.
    """
    tables = discovery.tables_of(discovery.discover(spark, folder), layout)
    result = scan_tables(spark, tables, layout, max_file_size_mb, sample_rows, labels_mode, exact)
    return ScanResult(result.schema_info, result.rejected.unionByName(discovery.unlisted(spark, folder)))


def scan_tables(
    spark: SparkSession,
    tables: DataFrame,
    layout: str = discovery.TABLE_PER_FILE,
    max_file_size_mb: float | None = None,
    sample_rows: int | None = None,
    labels_mode: str = labels.NATIVE,
    exact: bool = True,
    sketched: bool = False,
) -> ScanResult:
    """``scan_folder`` of a given list of tables (``discovery.tables_of``).

    ``sketched`` estimates distinct counts by sketches, which the rows then hold (``sketches.SKETCHED_SCHEMA``).
    """
    if sample_rows is not None and sample_rows <= 0:
        sample_rows = None
    accepted, oversize = discovery.size_gate(tables, max_file_size_mb)
    with _case_sensitive(spark):
        groups: list[TableGroup] = []
        problems: list[tuple[str, str, str]] = []
        footers: dict[str, int] = {}
        for found, failed in (
            _parquet_groups(spark, accepted.filter("format = 'parquet'"), layout, sample_rows, footers),
            _csv_groups(spark, accepted.filter("format = 'csv'"), layout, sample_rows),
        ):
            groups += found
            problems += failed
        rejected: list[DataFrame] = [oversize, _rejections(spark, problems)]

        def run(groups: list[TableGroup]) -> list[DataFrame]:
            groups = [g for g in groups if g.fields]
            rows: list[DataFrame] = []
            for start in range(0, len(groups), GROUPS_PER_JOB):
                part, failed = _profile_or_split(spark, groups[start:start + GROUPS_PER_JOB], labels_mode, exact, sketched)
                rows += part
                rejected.extend(failed)
            return rows

        done = run(groups)
        contradicted = [] if sample_rows else _contradicted(done)
        if contradicted:
            wrong = spark.createDataFrame([(p,) for p in contradicted], "file_path string")
            done = [rows.join(wrong, "file_path", "left_anti").select(*rows.columns) for rows in done]
            found, failed = _csv_groups(spark, accepted.join(wrong, "file_path", "left_semi"), layout, None, by_heads=False)
            rejected.append(_rejections(spark, failed))
            done += run(found)
    empty = spark.createDataFrame([], SKETCHED_SCHEMA if sketched else labels.CATALOG_SCHEMA)
    found, surplus = _without_surplus(reduce(DataFrame.unionByName, done, empty))
    found, damaged = _without_damaged(found, footers)
    return ScanResult(found, reduce(DataFrame.unionByName, [*rejected, surplus, damaged]))


def _without_damaged(found: DataFrame, footers: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """The catalog without the files of which fewer rows were read than their footers tell, and those as rejections.

    The profiling pass leaves out what it cannot read, so damaged files, however many, cost no further pass.
    """
    told = found.sparkSession.createDataFrame(list(footers.items()), "file_path string, footer_rows bigint")
    read = found.groupBy("file_path", "file_name").agg(F.max("total_rows").alias("rows"))
    damaged = read.join(told, "file_path").filter("rows <> footer_rows").select(
        "file_path", "file_name", F.format_string("damaged: %d of %d rows can be read", "rows", "footer_rows").alias("reason")
    )
    return found.join(damaged.select("file_path"), "file_path", "left_anti").select(*found.columns), damaged


def _contradicted(done: list[DataFrame]) -> list[str]:
    """Paths of the tables with rows that are not of the dialect their heads show."""
    marked = [rows.filter((F.col("column_name") == csv_tables.CONTRADICTED) & (F.col("null_count") < F.col("total_rows"))) for rows in done]
    return [r.file_path for r in reduce(DataFrame.unionByName, marked).select("file_path").distinct().collect()] if done else []


def _without_surplus(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog without the marks, and the tables that have surplus cells as rejections."""
    marks = found.filter(F.col("column_name") == csv_tables.SURPLUS)
    surplus = marks.filter("null_count < total_rows").select(
        "file_path", "file_name",
        F.format_string("%d rows hold more cells than the header", F.col("total_rows") - F.col("null_count")).alias("reason"),
    )
    kept = found.filter(~F.col("column_name").isin(csv_tables.MARKS))
    return kept.join(surplus.select("file_path"), "file_path", "left_anti").select(*found.columns), surplus


def scan_file(
    spark: SparkSession,
    path: str,
    max_file_size_mb: float | None = None,
    sample_rows: int | None = None,
    labels_mode: str = labels.NATIVE,
) -> DataFrame:
    """Catalog rows of one file; a missing, unsupported or oversize file is an error."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if not name.lower().endswith((".csv", ".parquet")):
        raise ValueError(f"Unsupported file format: {name}")
    try:
        tables = discovery.tables_of(discovery.discover(spark, path))
        found = tables.limit(1).count()
    except Exception as error:
        raise FileNotFoundError(f"File not found: {path}") from error
    if not found:
        raise FileNotFoundError(f"File not found: {path}")
    result = scan_tables(spark, tables, discovery.TABLE_PER_FILE, max_file_size_mb, sample_rows, labels_mode)
    for problem in result.rejected.take(1):
        raise ValueError(problem.reason)
    return result.schema_info
