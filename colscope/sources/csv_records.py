"""CSV records by byte ranges: fields that span lines, in files cut at any place, and the heads of files.

Whether a line feed ends a record depends on the quotes before it. A file is cut into byte ranges, and every range is looked
at by its own task, which tells how the range ends if it begins outside quotes and how if it begins inside. These small maps
are chained in order per file, after which every range knows its true state; each task then cuts its own records, the last
of which may reach into the next range. Records are parsed by ``from_csv``, with the same parser as Spark's reader.

A head reads blocks of a file in order until enough records are there. What it reads does not depend on the size of the file.
An open quote that nothing closes makes the rest of the file one record, as Spark's reader has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colscope.sources import csv_tables
from colscope.sources.discovery import arrow_file, arrow_system

RANGE = 32 << 20
BLOCK = 1 << 18
# Text handed on at once.
BATCH = 4 << 20
TASKS = 10_000
# Column that holds the file of a record.
PATH = "_colscope_path"


@lru_cache(maxsize=16)
def _shapes(separator: str) -> tuple[re.Pattern, re.Pattern]:
    """Lines that end outside quotes, if they begin outside, and if they begin inside.

    A quote opens only as the first character of a field; two within quotes are one that does not close; what follows a
    closing quote belongs to the field up to the next separator.
    """
    s = re.escape(separator.encode())
    rest = rb'(?:[^"]|"")*+"[^%s]*+' % s
    field = rb'(?:"%s|[^"%s][^%s]*+)?+' % (rest, s, s)
    more = rb"(?:%s%s)*+" % (s, field)
    return re.compile(field + more, re.DOTALL), re.compile(rest + more, re.DOTALL)


def open_after(line: bytes, opened: bool, separator: str) -> bool:
    """Whether a quote is open after ``line`` (without its line feed)."""
    if b'"' not in line:
        return opened
    return _shapes(separator)[opened].fullmatch(line) is None


def _terminator(source: BinaryIO) -> bytes:
    """What ends the first line of a file ends all of them."""
    source.seek(0)
    while block := source.read(BLOCK):
        found = re.search(rb"\r\n|\n|\r", block)
        if found:
            # a carriage return at the very end of a block may be half of a pair
            return b"\r\n" if found.group() == b"\r" and found.end() == len(block) and source.read(1) == b"\n" else found.group()
    return b"\n"


def _lines(source: BinaryIO, start: int, feed: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, line with its end) of every line that begins at or after ``start``."""
    at = max(0, start - 1)
    source.seek(at)
    held: list[bytes] = []
    skip = start > 0
    while block := source.read(BLOCK):
        pieces = block.split(feed)
        for piece in pieces[:-1]:
            line = b"".join([*held, piece, feed])
            held = []
            if not skip:
                yield at, line
            skip = False
            at += len(line)
        if pieces[-1]:
            held.append(pieces[-1])
    if held and not skip:
        yield at, b"".join(held)


def _ends(source: BinaryIO, start: int, end: int, separator: str) -> tuple[bool, bool]:
    """Whether a quote is open where the range ends: if none was open where it begins, and if one was."""
    outside, inside = False, True
    ending = _terminator(source)
    for at, line in _lines(source, start, ending[-1:]):
        if at >= end:
            break
        text = line.removesuffix(ending[-1:])
        same = outside == inside
        outside = open_after(text, outside, separator)
        inside = outside if same else open_after(text, inside, separator)
    return outside, inside


def _records(
    source: BinaryIO, start: int, end: int | None, opened: bool, separator: str, multi_line: bool
) -> Iterator[tuple[bytes, bool]]:
    """(record without its line end, whether it spans lines) of the records that begin in a range; blank lines are none.

    Line ends within a record become line feeds, as in Spark's reader.

    ``opened`` tells that the range begins within a record, which belongs to the range before.
    """
    ending = _terminator(source)
    held: list[bytes] = []
    ours = not opened
    for at, line in _lines(source, start, ending[-1:]):
        if not held and not opened and end is not None and at >= end:
            return
        if opened and not ours and end is not None and at >= end:
            return  # the whole range lies within a record that began before
        text = line.removesuffix(ending[-1:])
        opened = multi_line and open_after(text, opened, separator)
        if not ours:
            ours = not opened
            continue
        held.append(line)
        if opened:
            continue
        record = b"".join(held).replace(ending, b"\n").removesuffix(b"\n")
        spans, held = len(held) > 1, []
        if record if multi_line else record.strip():
            yield record, spans
    if held:
        yield b"".join(held).replace(ending, b"\n"), len(held) > 1


def _head(source: BinaryIO, rows: int, separator: str, multi_line: bool) -> Iterator[tuple[bytes, bool]]:
    """The header and the first ``rows`` records of a file."""
    for i, record in enumerate(_records(source, 0, None, False, separator, multi_line)):
        yield record
        if i >= rows:
            return


def _batches(uri: str, records: Iterator[bytes], encoding: str) -> Iterator[pd.DataFrame]:
    texts: list[str] = []
    held = 0
    for record in records:
        texts.append(record.decode(encoding, "replace"))
        held += len(record)
        if held >= BATCH:
            yield pd.DataFrame({PATH: uri, "record": texts})
            texts, held = [], 0
    yield pd.DataFrame({PATH: uri, "record": texts}, dtype="str")


def reachable(uri: str) -> bool:
    """Whether the Arrow file systems know the scheme of ``uri``; other files are left to Spark's reader."""
    try:
        arrow_system(uri)
    except Exception:
        return False
    return True


def _ranges(spark: SparkSession, files: list[tuple[str, int]], length: int) -> tuple[DataFrame, int]:
    """(uri, start, end) of all ranges of ``files``, and how many tasks they are worth."""
    listed = spark.createDataFrame(files, "uri string, size bigint").filter("size > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(length).cast("bigint"))
    ranges = listed.select("uri", F.explode(starts).alias("start"))
    count = sum(-(-size // length) for _, size in files)
    worth = max(spark.sparkContext.defaultParallelism, -(-sum(size for _, size in files) // RANGE))
    return ranges.withColumn("end", F.col("start") + length), max(1, min(count, worth, TASKS))


def _with_states(ends: DataFrame) -> DataFrame:
    """The ranges with ``opened``: whether a quote is open where they begin.

    A range leaves the state as it is, turns it over, or sets it whatever it was. The state before a range is what the
    last setting one left, turned over as often as ranges since then do.
    """
    before = Window.partitionBy("uri").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("uri").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    turns = F.sum((F.col("outside") & ~F.col("inside")).cast("long")).over(upto)
    sets = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").cast("long").alias("state"), "turns"))
    last = F.last("sets", ignorenulls=True).over(before)
    base = F.coalesce(F.col("last.state") - F.col("last.turns"), F.lit(0))
    return (
        ends.withColumn("turns", turns)
        .withColumn("sets", sets)
        .withColumn("last", last)
        .withColumn("until", F.coalesce(F.last("turns").over(before), F.lit(0)))
        .select("uri", "start", "end", (F.pmod(F.col("until") + base, F.lit(2)) == 1).alias("opened"))
    )


def _parsed(spark: SparkSession, records: DataFrame, first: str, dialect: tuple[str, str, bool]) -> tuple[DataFrame, list[str]]:
    """Records as cells named as ``read_csv`` names them, the mark of ``read_lines``, and the file of each row in ``PATH``."""
    encoding, separator, multi_line = dialect
    names = csv_tables.header_names(spark, first, encoding, separator, multi_line)
    schema = ", ".join(f"_{i} string" for i in range(len(names) + 1))
    cells = F.from_csv("record", schema, csv_tables.parser_options(separator, multi_line)).alias("cells")
    mark = f"_{len(names) + 1}"
    bad = F.when(F.col("record").contains("\ufffd"), F.lit("contradicted")).alias(mark)
    frame, names = csv_tables.marked_surplus(records.select(PATH, cells, bad).select(PATH, "cells.*", mark), names)
    return frame, [*names, csv_tables.CONTRADICTED]


def read_split(
    spark: SparkSession,
    files: list[tuple[str, int]],
    paths: list[str],
    encoding: str,
    separator: str,
    range_bytes: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """What ``read_csv`` reads of files (uri, size) whose fields span lines, by as many tasks as they have ranges."""
    ranges, tasks = _ranges(spark, files, range_bytes or RANGE)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                with arrow_file(row.uri) as source:
                    outside, inside = _ends(source, row.start, row.end, separator)
                yield pd.DataFrame([(row.uri, row.start, row.end, outside, inside)], columns=["uri", "start", "end", "outside", "inside"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                with arrow_file(row.uri) as source:
                    found = (r for r, _ in _records(source, row.start, row.end, row.opened, separator, True))
                    if row.start == 0:
                        next(found, None)
                    yield from _batches(row.uri, found, encoding)

    ends = ranges.repartition(tasks).mapInPandas(look, "uri string, start bigint, end bigint, outside boolean, inside boolean")
    records = _with_states(ends).repartition(tasks).mapInPandas(cut, f"{PATH} string, record string")
    return _parsed(spark, records, paths[0], (encoding, separator, True))


def _spread(spark: SparkSession, uris: list[str]) -> DataFrame:
    """One row per file, over as many tasks as there are cores."""
    tasks = max(1, min(len(uris), spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(u,) for u in uris], "uri string").repartition(tasks)


def read_heads(
    spark: SparkSession, uris: list[str], paths: list[str], rows: int, encoding: str, separator: str, multi_line: bool
) -> tuple[DataFrame, list[str]]:
    """The first ``rows`` rows of each file, all files in one job, by bounded reads."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["uri"]:
                with arrow_file(uri) as source:
                    found = (r for r, _ in _head(source, rows, separator, multi_line))
                    next(found, None)
                    yield from _batches(uri, found, encoding)

    records = _spread(spark, uris).mapInPandas(heads, f"{PATH} string, record string")
    return _parsed(spark, records, paths[0], (encoding, separator, multi_line))


def _separator(header: str) -> str:
    """The first that gives the header more than one field; a comma if none does."""
    bare = re.sub('"[^"]*"', "", header)
    return next((s for s in csv_tables.SEPARATORS if s in bare), csv_tables.SEPARATORS[0])


def _dialect(source: BinaryIO, rows: int) -> tuple[str, str, bool, str] | None:
    """encoding, separator, multi_line, header line of a file as its first ``rows`` rows show them; none of a file without text."""
    first = next(_head(source, 0, csv_tables.SEPARATORS[0], False), None)
    if first is None:
        return None
    separator = _separator(first[0].decode("latin-1"))
    utf8, spans = True, False
    for record, several in _head(source, rows, separator, True):
        spans |= several
        try:
            record.decode("utf-8")
        except UnicodeDecodeError:
            utf8 = False
    encoding = csv_tables.ENCODINGS[0 if utf8 else 1]
    return encoding, separator, spans, first[0].decode(encoding, "replace")


def probe_heads(spark: SparkSession, uris: list[str], rows: int) -> DataFrame:
    """What ``csv_tables.probe`` tells, judged by the first ``rows`` rows of each file alone; a file that cannot be opened is left out."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = []
            for uri in batch["uri"]:
                try:
                    with arrow_file(uri) as source:
                        dialect, size = _dialect(source, rows), source.size()
                except OSError:
                    continue
                if dialect:
                    told.append((uri, *dialect, size))
            yield pd.DataFrame(told, columns=["uri", "encoding", "separator", "multi_line", "header", "size"])

    told = "uri string, encoding string, separator string, multi_line boolean, header string, size bigint"
    probed = _spread(spark, uris).mapInPandas(probe, told)
    return probed.withColumn("header", F.sha2("header", 256))
