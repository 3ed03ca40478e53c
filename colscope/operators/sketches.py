"""Mergeable profiles: distinct-count sketches of the parts of a table, united without reading the parts again.

A part (one file) is profiled into rows, missing values and a HyperLogLog sketch per column; sketches of one width unite, so
the profile of a table follows from the stored rows of its parts. Sketches take 64-bit hashes of values, some 2 KB a column
at most, and estimate within about 2 % (one standard error); up to some hundred distinct values they are all but exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions import labels

# Sketches have 2 ** WIDTH registers.
WIDTH = 12
KINDS = ["integer", "float", "boolean", "string"]
# What the profile of a part holds beside the columns of a catalog. Spellings and kinds are those of CSV cells.
SKETCH_FIELDS = [
    T.StructField("value_sketch", T.BinaryType()),
    T.StructField("spelling_sketch", T.BinaryType()),
    *[T.StructField(f"has_{kind}", T.BooleanType()) for kind in KINDS],
]
SKETCHED_SCHEMA = T.StructType([*labels.CATALOG_SCHEMA.fields, *SKETCH_FIELDS])


def sketch(value: Column) -> Column:
    """A sketch of the values that are not null."""
    return F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), WIDTH)


def csv_unique(label: Column, values: Column, spellings: Column) -> Column:
    """Distinct values of a CSV column: numbers and booleans count by value, texts as they are spelled."""
    return F.when(label.isin("integer", "float", "boolean"), values).otherwise(spellings)


def _path_columns(per_part: DataFrame, labels_mode: str) -> DataFrame:
    """The ``key=value`` folders between a Parquet table and its parts as columns, exact: present, values, label by table and key."""
    below = F.expr("substring(file_path, length(table) + 2)")
    steps = F.filter(F.split(below, "/"), lambda s: s.contains("="))
    steps = F.transform(steps, lambda s: F.struct(
        F.substring_index(s, "=", 1).alias("column_name"),
        F.nullif(F.try_url_decode(F.regexp_replace(s, "^[^=]*=", "")), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("value"),
    ))
    found = per_part.filter("format = 'parquet'").select("table", "format", "rows", F.inline(steps)).filter("rows > 0")
    counted = found.groupBy("table", "format", "column_name", "value").agg(F.sum("rows").alias("rows"))
    label = F.lit("string")
    for type_name, name in (("date", labels.type_label(T.DateType(), labels_mode)), ("double", "float"), ("bigint", "integer")):
        shown = F.col("value").try_cast(type_name).isNotNull()
        if type_name == "bigint":
            shown = shown & F.col("value").rlike("^-?[0-9]+$")
        label = F.when(F.coalesce(F.bool_and(F.when(F.col("value").isNotNull(), shown)), F.lit(False)), name).otherwise(label)
    return counted.groupBy("table", "format", "column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("rows"))), F.lit(0)).alias("present"),
        F.count("value").alias("values"),
        label.alias("label"),
    )


def united(parts: DataFrame, table: Column, labels_mode: str = labels.NATIVE) -> tuple[DataFrame, DataFrame]:
    """(catalog rows, rejected) of the tables that ``parts`` (``SKETCHED_SCHEMA`` and size_bytes, format) belong to by ``table``.

    A column that a part lacks is null there; ``key=value`` folders of Parquet parts are columns too. A table with a column whose parts have different type labels (Parquet) is
    rejected. Partial aggregation unites the sketches of a map task before anything is shuffled.
    """
    keyed = parts.withColumn("table", table)
    key = ["table", "format"]
    per_part = keyed.groupBy(*key, "file_path").agg(
        F.max("total_rows").alias("rows"), F.max("size_bytes").alias("size"), F.max("last_scanned").alias("scanned")
    )
    tables = per_part.groupBy(*key).agg(
        F.sum("rows").alias("rows"), F.round(F.sum("size") / 1048576, 2).alias("file_size_mb"), F.max("scanned").alias("last_scanned")
    )
    columns = keyed.groupBy(*key, "column_name").agg(
        F.sum(F.col("total_rows") - F.col("null_count")).alias("present"),
        F.hll_sketch_estimate(F.hll_union_agg("value_sketch")).alias("values"),
        F.hll_sketch_estimate(F.hll_union_agg("spelling_sketch")).alias("spellings"),
        *[F.coalesce(F.max(f"has_{kind}"), F.lit(False)).alias(f"has_{kind}") for kind in KINDS],
        F.min("data_type").alias("label"),
        F.max("data_type").alias("other_label"),
    )
    columns = columns.unionByName(_path_columns(per_part, labels_mode).withColumn("other_label", F.col("label")), allowMissingColumns=True)
    known = columns.join(tables, key).withColumn("nulls", F.col("rows") - F.col("present"))
    text = F.col("format") == "csv"
    by_cells = labels.csv_label({kind: F.coalesce(f"has_{kind}", F.lit(False)) for kind in KINDS}, F.col("rows"), F.col("nulls"), labels_mode)
    known = known.withColumn("data_type", F.when(text, by_cells).otherwise(F.col("label")))
    clash = F.when(~text & (F.col("label") != F.col("other_label")), F.struct("column_name", "label", "other_label"))
    reason = F.format_string("parts clash: %s is %s and %s", "c.column_name", "c.label", "c.other_label")
    name = F.regexp_extract("table", r"[^/]*$", 0)
    clashes = known.groupBy(*key).agg(F.min(clash).alias("c")).filter("c IS NOT NULL")
    rejected = clashes.select(*key, F.col("table").alias("file_path"), name.alias("file_name"), reason.alias("reason"))
    countable = F.col("data_type") != labels.UNKNOWN
    unique = F.when(text, csv_unique(F.col("data_type"), F.col("values"), F.col("spellings"))).otherwise(F.col("values"))
    rows = known.join(rejected.select(*key), key, "left_anti").select(
        name.alias("file_name"), F.col("table").alias("file_path"), "column_name", "data_type",
        F.when(countable, F.col("nulls")).otherwise(0).alias("null_count"),
        F.when(countable, F.coalesce(unique, F.lit(0))).otherwise(0).alias("unique_count"),
        F.col("rows").alias("total_rows"), "file_size_mb", "last_scanned",
    )
    return rows, rejected.drop(*key)
