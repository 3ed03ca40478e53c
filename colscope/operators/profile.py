"""Column profiles: rows, nulls and distinct values of every column of many tables in one job.

Plan of the exact mode: each scan turns the values of a row into fingerprints, and a task sorts those of each column and drops
the repeats, so that few values are held once and many leave it as sorted runs. A run is cut into buckets by its
leading bits. Buckets of a column meet in one place, where their runs are merged and counted. A task
holds a bounded number of fingerprints whatever it reads, a column is never confined to one task, and a dominant value
(or null) is one fingerprint per task.

Values travel as fingerprints: integers as themselves, floating-point numbers as one 64-bit hash (which tells any two
64-bit numbers apart), everything else as two differently seeded 64-bit hashes. Long texts are thus hashed where they are read and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions import labels
from colscope.operators import sketches

_SECOND_SEED = 7919
_TABLE = "_colscope_table"
# Bytes of fingerprints a task holds; leading bits of a fingerprint that tell its bucket; buckets handed on at once.
HELD, BUCKET_BITS, _AT_ONCE = 128 << 20, 12, 512
# What a fingerprint is: the integer, the hash of a double, two hashes.
WHOLE, REAL, HASHED = range(3)
_RUNS = "table_id bigint, column_pos int, kind int, bucket int, total_rows bigint, null_count bigint, run binary"
_COUNTS = "table_id bigint, column_pos int, total_rows bigint, null_count bigint, unique_count bigint"


@dataclass
class TableGroup:
    """Tables of one schema that are read by one scan.

    ``frame`` holds the data, ``table_id`` tells which table a row belongs to, ``tables``
    describes the tables (table_id, file_name, file_path, file_size_mb), ``fields`` are the data columns in order.
    ``text`` marks a CSV scan, whose cells are untyped. ``halves`` gives the group as two smaller ones, if it can be cut.
    """

    frame: DataFrame
    table_id: Column
    tables: DataFrame
    fields: list[T.StructField]
    names: list[str] = field(default_factory=list)
    text: bool = False
    halves: Callable[[], list[TableGroup]] | None = None

    def __post_init__(self) -> None:
        if not self.names:
            self.names = [f.name for f in self.fields]


def table_group(
    df: DataFrame, file_name: str, file_path: str | None = None, size_bytes: int | None = None
) -> TableGroup:
    """One DataFrame as one table."""
    path = file_path or file_name
    table_id = F.xxhash64(F.lit(path))
    size = None if size_bytes is None else F.round(F.lit(size_bytes) / 1048576, 2)
    tables = df.sparkSession.range(1).select(
        table_id.alias("table_id"),
        F.lit(file_name).alias("file_name"),
        F.lit(path).alias("file_path"),
        (F.lit(None) if size is None else size).cast("double").alias("file_size_mb"),
    )
    return TableGroup(df, table_id, tables, list(df.schema.fields))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# A scan has a few expressions per column. They are written as SQL text and parsed at once, which for wide tables is
# much faster on the driver than building them call by call.


def _comparable(column: str, data_type: T.DataType) -> str:
    """The value in a form whose equality is value equality; NaN counts as missing."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return f"CASE WHEN NOT isnan({column}) THEN cast({column} AS double) + 0.0D END"
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return f"CASE WHEN {column} IS NOT NULL THEN to_json({column}) END"
    if isinstance(data_type, (T.DayTimeIntervalType, T.YearMonthIntervalType, T.VariantType)):
        return f"cast({column} AS string)"
    return column


def _fingerprint(column: str, data_type: T.DataType) -> tuple[int, list[str]]:
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return WHOLE, [f"cast({column} AS bigint)"]
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return REAL, [f"CASE WHEN {column} IS NOT NULL AND NOT isnan({column}) THEN xxhash64(cast({column} AS double) + 0.0D) END"]
    value = _comparable(column, data_type)
    return HASHED, [f"CASE WHEN {value} IS NOT NULL THEN xxhash64({value}) END", f"xxhash64({_SECOND_SEED}, {value})"]


def distinct_fingerprints(longs: list[np.ndarray]) -> list[np.ndarray]:
    """Fingerprints of one or two longs, each once, in order of the first."""
    if len(longs) == 1:
        longs = [np.sort(longs[0])]
    else:
        order = np.argsort(longs[0])
        ordered = [h[order] for h in longs]
        if ((ordered[0][1:] == ordered[0][:-1]) & (ordered[1][1:] != ordered[1][:-1])).any():
            ordered = [h[np.lexsort(longs[::-1])] for h in longs]
        longs = ordered
    new = np.ones(len(longs[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([h[1:] != h[:-1] for h in longs])
    return [h[new] for h in longs]


def _dealt(whole: np.ndarray) -> np.ndarray:
    """Integers as longs whose leading bits differ; different integers stay different."""
    x = whole.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


class _Held:
    """What a task holds of a column: rows, missing values and fingerprints."""

    def __init__(self, kind: int):
        self.kind, self.total_rows, self.null_count = kind, 0, 0
        self.parts: list[list[np.ndarray]] = []
        self.bytes = 0

    def add(self, longs: list[pa.Array]) -> None:
        if longs[0].null_count:
            valid = longs[0].is_valid()
            values = [h.filter(valid).to_numpy() for h in longs]
        else:
            values = [h.to_numpy() for h in longs]
        self.total_rows += len(longs[0])
        self.null_count += len(longs[0]) - len(values[0])
        self.parts.append([_dealt(values[0])] if self.kind == WHOLE else [h.view(np.uint64) for h in values])
        self.bytes += sum(h.nbytes for h in values)

    def merge(self) -> None:
        self.parts = [distinct_fingerprints([np.concatenate(h) for h in zip(*self.parts, strict=True)])] if self.parts else []
        self.bytes = sum(h.nbytes for part in self.parts for h in part)

    def runs(self, table_id: int, column_pos: int) -> Iterator[pa.RecordBatch]:
        """The fingerprints, merged, as a row per bucket; they are not held any more."""
        if not self.parts:
            return
        (longs,), self.parts, self.bytes = self.parts, [], 0
        bucket = (longs[0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, dtype=np.int64)
        raw = np.stack(longs, axis=1)
        ends = np.append(starts[1:], len(bucket))
        for at in range(0, len(starts), _AT_ONCE):
            first, last = starts[at : at + _AT_ONCE], ends[at : at + _AT_ONCE]
            offsets = (np.append(first, last[-1]) - first[0]) * raw.itemsize * raw.shape[1]
            data = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[first[0] : last[-1]].tobytes())]
            nothing = pa.nulls(len(first), pa.int64())
            yield _batch(_RUNS_ARROW, [table_id] * len(first), [column_pos] * len(first), [self.kind] * len(first), bucket[first],
                         nothing, nothing, pa.Array.from_buffers(pa.binary(), len(first), data))


_RUNS_ARROW = pa.schema([
    ("table_id", pa.int64()), ("column_pos", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("total_rows", pa.int64()),
    ("null_count", pa.int64()), ("run", pa.binary()),
])
_COUNTS_ARROW = pa.schema([
    ("table_id", pa.int64()), ("column_pos", pa.int32()), ("total_rows", pa.int64()), ("null_count", pa.int64()), ("unique_count", pa.int64()),
])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _runs(group: TableGroup) -> DataFrame:
    """The fingerprints of every column as sorted runs, a row per bucket, and a row with its rows and missing values."""
    fingerprints = [_fingerprint(_quoted(f.name), f.dataType) for f in group.fields]
    kinds = [(kind, len(longs)) for kind, longs in fingerprints]
    listed = [F.expr(h).alias(f"h{i}_{k}") for i, (_, longs) in enumerate(fingerprints) for k, h in enumerate(longs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], _Held] = {}
        total = 0
        for b in batches:
            of = b.column(0).to_numpy()
            tables = np.unique(of).tolist()
            for table_id in tables:
                rows = b if len(tables) == 1 else b.filter(pa.array(of == table_id))
                at = 1
                for i, (kind, n) in enumerate(kinds):
                    column = held.setdefault((table_id, i), _Held(kind))
                    total -= column.bytes
                    column.add([rows.column(at + k) for k in range(n)])
                    total += column.bytes
                    at += n
            if total > HELD:
                for column in held.values():
                    column.merge()
                total = sum(column.bytes for column in held.values())
                for key, column in sorted(held.items(), key=lambda c: -c[1].bytes):
                    if total <= HELD // 2:
                        break
                    total -= column.bytes
                    yield from column.runs(*key)
        for key, column in held.items():
            column.merge()
            yield from column.runs(*key)
            yield _batch(_RUNS_ARROW, [key[0]], [key[1]], [column.kind], [-1], [column.total_rows], [column.null_count], [None])

    return _with_table_id(group).select(F.col(_TABLE).alias("table_id"), *listed).mapInArrow(run, _RUNS)


def _changes(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Where rows begin that differ from the row before in one of the columns."""
    new = np.ones(table.num_rows, dtype=bool)
    columns = [table.column(c).to_numpy() for c in names]
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _counted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of runs in order of table, column, kind and bucket."""
    column_names = ["table_id", "column_pos", "kind"]

    def counts(table: pa.Table) -> pa.RecordBatch:
        found = []
        starts = _changes(table, column_names)
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            some = table.slice(at, end - at)
            raw = np.frombuffer(b"".join(some.column("run").drop_null().to_pylist()), dtype=np.uint64)
            width = 2 if some.column("kind")[0].as_py() == HASHED else 1
            unique = len(distinct_fingerprints([raw[k::width] for k in range(width)])[0])
            rows, nulls = (int(np.nansum(some.column(c).to_numpy())) for c in ("total_rows", "null_count"))
            found.append((some.column("table_id")[0].as_py(), some.column("column_pos")[0].as_py(), rows, nulls, unique))
        return _batch(_COUNTS_ARROW, *(list(c) for c in zip(*found, strict=True)))

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([*held, b])
        last = int(_changes(table, [*column_names, "bucket"])[-1])
        if last:
            yield counts(table.slice(0, last))
        held = table.slice(last).to_batches()
    if held:
        yield counts(pa.Table.from_batches(held))


def _with_table_id(group: TableGroup) -> DataFrame:
    """The scan with the table id computed once per row, below the explosion into cells."""
    return group.frame.select(group.table_id.alias(_TABLE), *[F.col(_quoted(f.name)) for f in group.fields])


def _text_cells(group: TableGroup) -> DataFrame:
    """(table_id, column_pos, cell) of a CSV scan, missing tokens as null."""
    cells = ", ".join(f"struct({i} AS column_pos, {_quoted(f.name)} AS cell)" for i, f in enumerate(group.fields))
    exploded = _with_table_id(group).select(F.col(_TABLE).alias("table_id"), F.expr(f"inline(array({cells}))"))
    return exploded.select(
        "table_id", "column_pos", labels.cell_key(labels.missing_to_null(F.col("cell"))).alias("cell")
    )


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _typed_counts(groups: Sequence[TableGroup]) -> DataFrame:
    place = ["table_id", "column_pos", "kind", "bucket"]
    runs = _union([_runs(g) for g in groups]).repartition(*place).sortWithinPartitions(*place)
    return runs.mapInArrow(_counted_runs, _COUNTS).groupBy("table_id", "column_pos").agg(
        *[F.sum(c).alias(c) for c in ("total_rows", "null_count", "unique_count")]
    )


def _approximate_counts(groups: Sequence[TableGroup]) -> DataFrame:
    """One pass without a value shuffle: HyperLogLog++ sketches per table and column."""
    frames = []
    for group in groups:
        values = [F.expr(_comparable(_quoted(f.name), f.dataType)) for f in group.fields]
        counts = group.frame.groupBy(group.table_id.alias("table_id")).agg(
            F.count(F.lit(1)).alias("total_rows"),
            *[F.count(v).alias(f"present_{i}") for i, v in enumerate(values)],
            *[F.approx_count_distinct(v).alias(f"unique_{i}") for i, v in enumerate(values)],
        )
        per_column = F.array(
            *[
                F.struct(
                    F.lit(i).alias("column_pos"),
                    (F.col("total_rows") - F.col(f"present_{i}")).alias("null_count"),
                    F.col(f"unique_{i}").alias("unique_count"),
                )
                for i in range(len(values))
            ]
        )
        frames.append(counts.select("table_id", "total_rows", F.inline(per_column)))
    return _union(frames).select("table_id", "column_pos", "total_rows", "null_count", "unique_count")


_KINDS = sketches.KINDS


def _sketched_counts(groups: Sequence[TableGroup]) -> DataFrame:
    """Rows, nulls and a sketch of the values per table and column, in the columns of ``_sketched_text_columns``."""
    frames = []
    for group in groups:
        values = []
        for f in group.fields:
            whole = isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType))
            value = _comparable(_quoted(f.name), f.dataType)
            values.append(F.expr(f"cast({value} AS bigint)" if whole else value))
        counts = group.frame.groupBy(group.table_id.alias("table_id")).agg(
            F.count(F.lit(1)).alias("total_rows"),
            *[F.count(v).alias(f"present_{i}") for i, v in enumerate(values)],
            *[sketches.sketch(v).alias(f"sketch_{i}") for i, v in enumerate(values)],
        )
        per_column = F.array(
            *[
                F.struct(
                    F.lit(i).alias("column_pos"),
                    (F.col("total_rows") - F.col(f"present_{i}")).alias("null_count"),
                    F.col(f"sketch_{i}").alias("value_sketch"),
                )
                for i in range(len(values))
            ]
        )
        frames.append(counts.select("table_id", "total_rows", F.inline(per_column)))
    return _union(frames).select(
        "table_id", "column_pos", "total_rows", "null_count", "value_sketch",
        F.lit(None).cast("binary").alias("spelling_sketch"),
        *[F.lit(None).cast("boolean").alias(f"has_{kind}") for kind in _KINDS],
    )


def _sketched_text_columns(groups: Sequence[TableGroup]) -> DataFrame:
    """Per CSV column: rows, nulls, the kinds of cells and sketches of values and spellings, in one pass."""
    cells = _union([_text_cells(g) for g in groups]).withColumn("kind", labels.cell_kind(F.col("cell")))
    return (
        cells.withColumn("value", labels.cell_value(F.col("cell"), F.col("kind")))
        .groupBy("table_id", "column_pos")
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if(F.col("value").isNull()).alias("null_count"),
            sketches.sketch(F.col("value")).alias("value_sketch"),
            sketches.sketch(F.col("cell")).alias("spelling_sketch"),
            *[F.coalesce(F.max(F.col("kind") == kind), F.lit(False)).alias(f"has_{kind}") for kind in _KINDS],
        )
    )


def _sketched(typed: Sequence[TableGroup], text: Sequence[TableGroup], mode: str) -> list[DataFrame]:
    """Counts with sketches; distinct counts are what the sketches estimate."""
    frames = []
    if typed:
        values = F.hll_sketch_estimate("value_sketch").alias("unique_count")
        frames.append(_sketched_counts(typed).select("*", values, F.lit(None).cast("string").alias("data_type")))
    if text:
        has = {kind: F.col(f"has_{kind}") for kind in _KINDS}
        label = labels.csv_label(has, F.col("total_rows"), F.col("null_count"), mode)
        columns = _sketched_text_columns(text).withColumn("data_type", label)
        values, spellings = (F.hll_sketch_estimate(f"{name}_sketch") for name in ("value", "spelling"))
        frames.append(columns.withColumn("unique_count", sketches.csv_unique(F.col("data_type"), values, spellings)))
    return frames


def _approximate_text_columns(groups: Sequence[TableGroup]) -> DataFrame:
    """What ``_text_columns`` gives, with estimated distinct counts: one pass, nothing but sums and sketches is shuffled."""
    cells = _union([_text_cells(g) for g in groups]).withColumn("kind", labels.cell_kind(F.col("cell")))
    return (
        cells.withColumn("value", labels.cell_value(F.col("cell"), F.col("kind")))
        .groupBy("table_id", "column_pos")
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if(F.col("value").isNull()).alias("null_count"),
            F.approx_count_distinct("cell").alias("spellings"),
            F.approx_count_distinct("value").alias("values"),
            *[F.coalesce(F.max(F.col("kind") == kind), F.lit(False)).alias(f"has_{kind}") for kind in _KINDS],
        )
    )


def _text_columns(groups: Sequence[TableGroup]) -> DataFrame:
    """Per CSV column: rows, nulls, distinct spellings and values, and the kinds of cells it holds."""
    cells = (
        _union([_text_cells(g) for g in groups])
        .groupBy("table_id", "column_pos", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("kind", labels.cell_kind(F.col("cell")))
        .withColumn("value", labels.cell_value(F.col("cell"), F.col("kind")))
    )
    values = cells.groupBy("table_id", "column_pos", "value").agg(
        F.sum("n").alias("n"),
        F.count("cell").alias("spellings"),
        *[F.max(F.col("kind") == kind).alias(f"has_{kind}") for kind in _KINDS],
    )
    return values.groupBy("table_id", "column_pos").agg(
        F.sum("n").alias("total_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
        F.sum("spellings").alias("spellings"),
        F.count("value").alias("values"),
        *[F.coalesce(F.max(f"has_{kind}"), F.lit(False)).alias(f"has_{kind}") for kind in _KINDS],
    )


def _text_counts(groups: Sequence[TableGroup], mode: str, exact: bool) -> DataFrame:
    """CSV columns: the label is inferred from the kinds of all cells."""
    columns = _text_columns(groups) if exact else _approximate_text_columns(groups)
    has = {kind: F.col(f"has_{kind}") for kind in _KINDS}
    label = labels.csv_label(has, F.col("total_rows"), F.col("null_count"), mode)
    all_boolean = has["boolean"] & ~has["integer"] & ~has["float"] & ~has["string"]
    return columns.withColumn("data_type", label).select(
        "table_id",
        "column_pos",
        "total_rows",
        "null_count",
        F.when(F.col("data_type").isin("integer", "float") | all_boolean, F.col("values"))
        .otherwise(F.col("spellings"))
        .alias("unique_count"),
        "data_type",
    )


def _columns_of(group: TableGroup, mode: str) -> DataFrame:
    """(table, column) rows a group must yield, also when it holds no data."""
    described = ", ".join(
        f"struct({i} AS column_pos, {_text_literal(name)} AS column_name, "
        f"{_text_literal('string' if group.text else labels.type_label(f.dataType, mode))} AS label)"
        for i, (f, name) in enumerate(zip(group.fields, group.names))
    )
    return group.tables.select(
        "table_id", "file_name", "file_path", "file_size_mb", F.expr(f"inline(array({described}))")
    )


def profile(
    groups: Sequence[TableGroup], labels_mode: str = labels.NATIVE, exact: bool = True, sketched: bool = False
) -> DataFrame:
    """Catalog rows (``CATALOG_SCHEMA``) of all tables of ``groups``.

    ``exact=False`` estimates the distinct counts in one pass without a shuffle of values: the mode for large lakes.
    ``sketched`` does so too and adds the sketches (``SKETCHED_SCHEMA``), by which profiles of parts can be united.
    """
    groups = [g for g in groups if g.fields]
    if not groups:
        raise ValueError("nothing to profile")
    described = _union([_columns_of(g, labels_mode) for g in groups])
    typed = [g for g in groups if not g.text]
    text = [g for g in groups if g.text]
    counts = _sketched(typed, text, labels_mode) if sketched else []
    if typed and not sketched:
        typed_counts = _typed_counts(typed) if exact else _approximate_counts(typed)
        counts.append(typed_counts.withColumn("data_type", F.lit(None).cast("string")))
    if text and not sketched:
        counts.append(_text_counts(text, labels_mode, exact))
    known = described.join(_union(counts), ["table_id", "column_pos"], "left")
    label = F.coalesce("data_type", "label")
    countable = label != labels.UNKNOWN

    def count_of(name: str, zero_if_unknown: bool = True) -> Column:
        value = F.coalesce(F.col(name), F.lit(0)).cast("bigint")
        return (F.when(countable, value).otherwise(0) if zero_if_unknown else value).alias(name)

    return known.select(
        "file_name",
        "file_path",
        "column_name",
        label.alias("data_type"),
        count_of("null_count"),
        count_of("unique_count"),
        count_of("total_rows", zero_if_unknown=False),
        "file_size_mb",
        F.current_timestamp().alias("last_scanned"),
        *([f.name for f in sketches.SKETCH_FIELDS] if sketched else []),
    )


def profile_tables(
    spark: SparkSession, tables: dict[str, DataFrame], labels_mode: str = labels.NATIVE, exact: bool = True
) -> DataFrame:
    """Profile named DataFrames; the name stands for the file name and path."""
    return profile([table_group(df, name) for name, df in tables.items()], labels_mode, exact)
