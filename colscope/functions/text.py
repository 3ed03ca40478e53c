"""Line-oriented measures of a text column and the slug of a query; all inside one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates a report's sections, and the sizes of its preview.
SEPARATOR_LINE = "^[-=*_]{3,}$"
PREVIEW_SCANNED = 10
PREVIEW_SHOWN = 5
SLUG_LENGTH = 30
DEFAULT_SLUG = "query"
EXPORT_THRESHOLD = 20

# The white space a line is trimmed of.
BLANK = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANK))


def is_separator_line(line: Column) -> Column:
    """Whether a trimmed line only separates sections."""
    return line.rlike(SEPARATOR_LINE)


def _is_content(line: Column) -> Column:
    trimmed = strip(line)
    return (trimmed != "") & ~is_separator_line(trimmed)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def content_lines(text: Column) -> Column:
    """Number of lines that are neither blank nor separators."""
    return F.size(F.filter(lines(text), _is_content))


def exceeds(text: Column, threshold: int = EXPORT_THRESHOLD) -> Column:
    """Whether a text is too large to show and should be exported."""
    return content_lines(text) > threshold


def preview(text: Column) -> Column:
    """Up to five content lines from the first ten, and how many lines are left out if there are more."""
    head = F.slice(lines(text), 1, PREVIEW_SCANNED)
    shown = F.slice(F.filter(head, _is_content), 1, PREVIEW_SHOWN)
    total = content_lines(text)
    note = F.concat(
        F.lit("\n\n[... "), (total - F.size(shown)).cast("string"), F.lit(" more lines in export file ...]")
    )
    return F.concat(F.array_join(shown, "\n"), F.when(total > PREVIEW_SHOWN, note).otherwise(""))


def truncated_list(items: Column, shown: int) -> Column:
    """The first members of a list, joined, with ``...`` if it goes on."""
    head = F.array_join(F.slice(items, 1, shown), ", ")
    return F.concat(head, F.when(F.size(items) > shown, "...").otherwise(""))


def slug(query: Column) -> Column:
    """A file-name-safe form of a query."""
    kept = F.regexp_replace(F.left(F.lower(query), F.lit(SLUG_LENGTH)), r"[^a-z0-9\s]", "")
    dashed = F.regexp_replace(strip(kept), r"\s+", "-")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit(DEFAULT_SLUG))
