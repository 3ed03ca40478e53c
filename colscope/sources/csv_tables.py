"""CSV: dialect probe and untyped reading.

A file's dialect is its encoding, whether quoted fields span lines, and the separator, which follows from the header. It is
taken from the head of the file (``csv_records.probe_heads``), and rows that contradict it are marked as they are read; of
those files alone ``probe`` reads all lines. Files of one dialect and header are read by one scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.sources.discovery import glob_safe

# Separators and encodings in the order they are tried. latin-1 accepts any byte,
# so cp1252, the third encoding one could try, is never reached.
SEPARATORS = [",", ";", "\t"]
CSV_FILES = "*.[cC][sS][vV]"
ENCODINGS = ["UTF-8", "ISO-8859-1"]
# Stands for the cells beyond the header's; no header can hold this name.
SURPLUS = "\x00surplus"
# Stands for a mark on rows that are not what the head of their file led to expect.
CONTRADICTED = "\x00contradicted"
MARKS = [SURPLUS, CONTRADICTED]
# Separates nothing: a line is one cell.
_NO_SEPARATOR = "\x01\x02\x01"


def _fields_in(header: Column, separator: str) -> Column:
    unquoted = F.regexp_replace(header, '"[^"]*"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(separator), F.lit(""))) + 1


def open_quote(line: Column) -> Column:
    """Whether a line leaves a quoted field open: a quote that opens one has no partner; a quote inside a field opens nothing."""
    opening = F.regexp_replace(line, r'(^|[,;\t])\s*"(?:[^"]|"")*"(?=\s*($|[,;\t]))', "$1")
    return line.contains('"') & F.regexp_like(opening, F.lit(r'(^|[,;\t])\s*"'))


def contradicted(line: Column) -> Column:
    """A mark on a line with a field left open, or with bytes that its encoding does not know."""
    return F.when(line.contains("\ufffd") | open_quote(line), F.lit("contradicted"))


def listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The CSV files in given places, as the ``binaryFile`` source lists them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", CSV_FILES)
    return reader.load([glob_safe(p) for p in paths])


def probe(spark: SparkSession, paths: list[str]) -> DataFrame:
    """uri, encoding, separator, multi_line, header, size of each CSV file.

    The separator is the first that gives the header more than one field; a comma if none does. A field spans lines
    only if a quote that opens one has no partner in its line; a quote inside a field opens nothing.
    """
    position = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )
    lines = (
        spark.read.text(
            [glob_safe(p) for p in paths], recursiveFileLookup=True, pathGlobFilter=CSV_FILES
        )
        .select(
            "value",
            F.col("_metadata.file_path").alias("uri"),
            F.col("_metadata.file_size").alias("size"),
            position.alias("position"),
            open_quote(F.col("value")).cast("int").alias("open"),
        )
    )
    separator = F.lit(SEPARATORS[0])
    for candidate in reversed(SEPARATORS):
        separator = F.when(_fields_in(F.col("header"), candidate) > 1, candidate).otherwise(separator)
    return (
        lines.groupBy("uri")
        .agg(
            F.min(F.is_valid_utf8("value")).alias("utf8"),
            (F.max("open") > 0).alias("multi_line"),
            F.min_by("value", "position").alias("header"),
            F.max("size").alias("size"),
        )
        .withColumn("encoding", F.when(F.col("utf8"), ENCODINGS[0]).otherwise(ENCODINGS[1]))
        .withColumn("separator", separator)
        .select("uri", "encoding", "separator", "multi_line", F.sha2("header", 256).alias("header"), "size")
    )


def _reader(spark: SparkSession, encoding: str, separator: str, multi_line: bool):
    return (
        spark.read.option("pathGlobFilter", CSV_FILES)
        .option("sep", separator)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
    )


def column_names(cells: list[str | None]) -> list[str]:
    """Header cells as column names: blanks are numbered, repeated names get ``.1``, ``.2`` ..."""
    names: list[str] = []
    taken: set[str] = set()
    for i, cell in enumerate(cells):
        name = base = cell if cell else f"Unnamed: {i}"
        copy = 0
        while name in taken:
            copy += 1
            name = f"{base}.{copy}"
        taken.add(name)
        names.append(name)
    return names


def header_names(spark: SparkSession, path: str, encoding: str, separator: str, multi_line: bool) -> list[str]:
    """Column names by the header of a file."""
    header = _reader(spark, encoding, separator, multi_line).option("header", False).csv(glob_safe(path)).head(1)
    return column_names(list(header[0])) if header else []


def marked_surplus(cells: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Cells with the last column, of what the header does not cover, as a mark called ``SURPLUS``."""
    last = f"_{len(names)}"
    return cells.withColumn(last, F.when(F.col(last).isNotNull(), F.lit("surplus"))), [*names, SURPLUS]


def read_csv(
    spark: SparkSession, paths: list[str], encoding: str = "UTF-8", separator: str = ",", multi_line: bool = False
) -> tuple[DataFrame, list[str]]:
    """Untyped cells of CSV files that share dialect and header, and the column names.

    Columns are called ``_0``, ``_1`` ...; names that clash or differ by case only are thereby harmless. The last one,
    ``SURPLUS``, is set in rows that hold a cell beyond the header's.
    """
    safe = [glob_safe(p) for p in paths]
    names = header_names(spark, paths[0], encoding, separator, multi_line)
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names) + 1)])
    if not names:
        return spark.createDataFrame([], T.StructType([])), []
    frame = (
        _reader(spark, encoding, separator, multi_line)
        .schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .csv(safe)
    )
    return marked_surplus(frame, names)


def parser_options(separator: str, multi_line: bool) -> dict[str, str]:
    """Options of ``from_csv`` that parse a record as ``read_csv`` does."""
    return {"sep": separator, "quote": '"', "escape": '"', "multiLine": str(multi_line).lower(), "lineSep": "\n"}


def read_lines(spark: SparkSession, paths: list[str], encoding: str, separator: str, path_column: str) -> tuple[DataFrame, list[str]]:
    """What ``read_csv`` reads of files whose records are lines, with a second last column, ``CONTRADICTED``, and the file of a row.

    The mark is set in rows by which a file is not what it was taken for: then what was read of it does not count.
    """
    names = header_names(spark, paths[0], encoding, separator, False)
    if not names:
        return spark.createDataFrame([], T.StructType([])), []
    lines = (
        _reader(spark, encoding, _NO_SEPARATOR, False).option("quote", "").schema("line string")
        .option("header", True).option("enforceSchema", True).csv([glob_safe(p) for p in paths])
    )
    schema = ", ".join(f"_{i} string" for i in range(len(names) + 1))
    cells = lines.select(
        F.col("_metadata.file_path").alias(path_column),
        F.from_csv("line", schema, parser_options(separator, False)).alias("cells"),
        contradicted(F.col("line")).alias(f"_{len(names) + 1}"),
    )
    frame, names = marked_surplus(cells.select(path_column, "cells.*", f"_{len(names) + 1}"), names)
    return frame, [*names, CONTRADICTED]


def united(parts: list[tuple[DataFrame, list[str]]]) -> tuple[DataFrame, list[str]]:
    """Parts of one table, whose headers may differ, by column name; a column that a part lacks is null there."""
    names = list(dict.fromkeys(n for _, own in parts for n in own if n not in MARKS)) + MARKS
    frames = []
    for frame, own in parts:
        place = {name: i for i, name in enumerate(own)}
        cells = [F.col(f"_{place[n]}") if n in place else F.lit(None).cast("string") for n in names]
        frames.append(frame.select(*[c.alias(f"_{i}") for i, c in enumerate(cells)]))
    return reduce(DataFrame.unionByName, frames), names
