"""Type labels, missing tokens and the fixed schema of the catalog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("file_name", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("column_name", T.StringType(), False),
        T.StructField("data_type", T.StringType(), False),
        T.StructField("null_count", T.LongType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("file_size_mb", T.DoubleType()),
        T.StructField("last_scanned", T.TimestampType()),
    ]
)

# The cell texts that mean "missing" in a CSV file.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

NATIVE = "native"
REFERENCE = "reference"
UNKNOWN = "unknown"

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)
_INTERVALS = (T.DayTimeIntervalType, T.YearMonthIntervalType)


def type_label(data_type: T.DataType, mode: str = NATIVE) -> str:
    """Catalog label of a Spark type.

    ``native`` tells decimals, dates, binary and nested types apart; ``reference`` files the
    first three under ``string`` and nested types under ``unknown``.
    """
    if isinstance(data_type, _INTEGERS):
        return "integer"
    if isinstance(data_type, _FLOATS):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, _TIMESTAMPS):
        return "datetime"
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, (T.DecimalType, T.DateType, T.BinaryType)):
        return "string" if mode == REFERENCE else data_type.typeName()
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return UNKNOWN if mode == REFERENCE else data_type.typeName()
    if isinstance(data_type, _INTERVALS):
        return data_type.simpleString() if mode == REFERENCE else "interval"
    return data_type.simpleString()


def missing_to_null(cell: Column) -> Column:
    """Missing tokens of a CSV cell become null."""
    return F.when(~cell.isin(MISSING_TOKENS), cell)


_INT_TEXT = r"^[ \t]*[+-]?[0-9]+[ \t]*$"
_FLOAT_TEXT = r"^[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*$"
_INFINITY_TEXT = r"^[+-]?([iI]nf|INF|[iI]nfinity|INFINITY)$"
# The spellings of a boolean.
_BOOLEAN_TEXT = r"^(true|True|TRUE|false|False|FALSE)$"
# Integral doubles below this are written as integers, so that 1 and 1.0 are one value.
_EXACT_INTEGERS = 9007199254740992.0
_LONG_CELL = 64


def cell_key(cell: Column) -> Column:
    """What a CSV cell is grouped by: the cell, or the SHA-256 of a long text."""
    return F.when(
        (F.length(cell) > _LONG_CELL) & ~cell.rlike(_FLOAT_TEXT), F.concat(F.lit("\u0001"), F.sha2(cell, 256))
    ).otherwise(cell)


def cell_kind(cell: Column) -> Column:
    """``integer``, ``float``, ``boolean`` or ``string`` for one non-null cell."""
    as_float = cell.rlike(_FLOAT_TEXT) & cell.try_cast("double").isNotNull()
    return (
        F.when(cell.isNull(), None)
        .when(cell.rlike(_INT_TEXT) & cell.try_cast("bigint").isNotNull(), "integer")
        .when(as_float | cell.rlike(_INFINITY_TEXT), "float")
        .when(cell.rlike(_BOOLEAN_TEXT), "boolean")
        .otherwise("string")
    )


def cell_value(cell: Column, kind: Column) -> Column:
    """One spelling per value: ``01``, ``1`` and ``1.0`` agree, as do ``TRUE`` and ``true``."""
    number = cell.try_cast("double")
    integral = (number == F.floor(number)) & (F.abs(number) < _EXACT_INTEGERS)
    return (
        F.when(kind == "integer", cell.try_cast("bigint").cast("string"))
        .when((kind == "float") & integral, number.cast("bigint").cast("string"))
        .when(kind == "float", number.cast("string"))
        .when(kind == "boolean", F.lower(cell))
        .otherwise(cell)
    )


def csv_label(has: dict[str, Column], rows: Column, nulls: Column, mode: str) -> Column:
    """Label of a CSV column from the kinds seen in it.

    In ``reference`` mode a missing value turns integers into floats and booleans into
    strings, and a column of missing values only is a float; ``native`` ignores them.
    """
    numbers = ~has["string"] & ~has["boolean"]
    all_null = (rows > 0) & (nulls == rows)
    gaps = nulls > 0 if mode == REFERENCE else F.lit(False)
    empty_label = "float" if mode == REFERENCE else "string"
    return (
        F.when(rows == 0, "string")
        .when(all_null, empty_label)
        .when(numbers & (has["float"] | gaps), "float")
        .when(numbers, "integer")
        .when(has["boolean"] & ~has["integer"] & ~has["float"] & ~has["string"] & ~gaps, "boolean")
        .otherwise("string")
    )
