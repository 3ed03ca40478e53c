import datetime
import decimal
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions import labels
from colscope.operators import profile
from colscope.operators.profile import profile_tables


def counts(rows):
    return {
        r.column_name: (r.data_type, r.null_count, r.unique_count, r.total_rows) for r in rows.collect()
    }


@pytest.fixture(scope="module")
def mixed(spark):
    schema = T.StructType(
        [
            T.StructField("x", T.DoubleType()),
            T.StructField("s", T.StringType()),
            T.StructField("arr", T.ArrayType(T.IntegerType())),
            T.StructField("m", T.MapType(T.StringType(), T.IntegerType())),
            T.StructField("st", T.StructType([T.StructField("a", T.IntegerType())])),
            T.StructField("b", T.BinaryType()),
            T.StructField("d", T.DateType()),
            T.StructField("dec", T.DecimalType(10, 2)),
            T.StructField("ts", T.TimestampType()),
            T.StructField("flag", T.BooleanType()),
            T.StructField("none", T.StringType()),
            T.StructField("odd `name'", T.ByteType()),
        ]
    )
    day, when = datetime.date(2024, 1, 1), datetime.datetime(2024, 1, 1)
    one = decimal.Decimal("1.00")
    return spark.createDataFrame(
        [
            (0.0, "a", [1, 2], {"k": 1}, (1,), bytearray(b"x"), day, one, when, True, None, 1),
            (-0.0, "a", [1, 2], {"k": 1}, (1,), bytearray(b"x"), day, one, when, False, None, 1),
            (math.nan, None, [1, None], None, (2,), bytearray(b"y"), None, None, None, None, None, 2),
            (None, "NA", [1], {"k": 2}, None, None, day, decimal.Decimal("2.00"), when, True, None, None),
        ],
        schema,
    )


def test_counts_of_every_type(spark, mixed):
    assert counts(profile_tables(spark, {"t": mixed})) == {
        "x": ("float", 2, 1, 4),
        "s": ("string", 1, 2, 4),
        "arr": ("array", 0, 3, 4),
        "m": ("map", 1, 2, 4),
        "st": ("struct", 1, 2, 4),
        "b": ("binary", 1, 2, 4),
        "d": ("date", 1, 1, 4),
        "dec": ("decimal", 1, 2, 4),
        "ts": ("datetime", 1, 1, 4),
        "flag": ("boolean", 1, 2, 4),
        "none": ("string", 4, 0, 4),
        "odd `name'": ("integer", 1, 2, 4),
    }


def test_reference_labels(spark, mixed):
    found = counts(profile_tables(spark, {"t": mixed}, labels.REFERENCE))
    assert found["arr"] == ("unknown", 0, 0, 4)
    assert {found[c][0] for c in ("b", "d", "dec", "s")} == {"string"}


def test_table_without_rows(spark, mixed):
    found = counts(profile_tables(spark, {"t": mixed.limit(0)}))
    assert set(found.values()) >= {("float", 0, 0, 0)}
    assert len(found) == len(mixed.columns)


def test_approximate_counts_are_close(spark):
    df = spark.range(20000).select("id", F.when(F.col("id") % 4 != 0, F.col("id") % 1000).alias("k"))
    found = counts(profile_tables(spark, {"t": df}, exact=False))
    assert found["k"][1] == 5000
    assert abs(found["id"][2] - 20000) < 2000 and abs(found["k"][2] - 750) < 100


def test_one_value_in_a_third_of_the_rows(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    assert counts(profile_tables(spark, {"t": df}))["v"] == ("string", 0, 20001, 30000)


def test_scan_reads_only_what_it_profiles(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_tax")
    plan = profile_tables(spark, {"t": lineitem})._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_long_texts_are_not_shuffled(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    plan = profile_tables(spark, {"t": documents})._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("text" not in line for line in exchanges)


def test_each_fingerprint_once():
    """Also where two values share the first of their hashes."""
    first, second = np.array([3, 1, 3, 3, 1, 3], dtype=np.uint64), np.array([1, 9, 2, 1, 9, 2], dtype=np.uint64)
    assert [h.tolist() for h in profile.distinct_fingerprints([first, second])] == [[1, 3, 3], [9, 1, 2]]
    assert profile.distinct_fingerprints([first])[0].tolist() == [1, 3]
    assert [len(h) for h in profile.distinct_fingerprints([first[:0], second[:0]])] == [0, 0]
    whole = np.array([0, -1, 1, 2**63 - 1, -(2**63), 7, 7])
    assert len(set(profile._dealt(whole).tolist())) == 6


@pytest.mark.parametrize("held", [1 << 12, 1 << 16, 128 << 20])
def test_tasks_hold_bounded_runs(spark, monkeypatch, held):
    """Counts are those of a task that holds everything, however often it hands on what it holds."""
    monkeypatch.setattr(profile, "HELD", held)
    n = 30_000
    frame = spark.range(0, n, 1, 3).select(
        (F.col("id") - 15_000).alias("key"), (F.col("id") % 7).cast("int").alias("few"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 9_001).alias("some"),
        F.when(F.col("id") % 3 == 0, F.lit("NaN").cast("double")).otherwise((F.col("id") % 1_000 - 500) * -0.0).alias("zero"),
        (F.col("id") * 0.5).cast("float").alias("real"), F.concat(F.lit("v"), F.col("id") % 20_000).alias("text"),
        F.lit(None).cast("string").alias("none"),
    )
    found = profile_tables(spark, {"t": frame, "u": frame.limit(10), "v": frame.limit(0)})
    counted = {(r.file_name, r.column_name): (r.null_count, r.unique_count, r.total_rows) for r in found.collect()}
    assert {c: counted["t", c] for c in frame.columns} == {
        "key": (0, n, n), "few": (0, 7, n), "some": (6_000, 9_001, n), "zero": (10_000, 1, n), "real": (0, n, n), "text": (0, 20_000, n),
        "none": (n, 0, n),
    }
    assert counted["u", "key"] == (0, 10, 10) and counted["v", "key"] == (0, 0, 0)


def test_values_are_not_shuffled_one_by_one(spark):
    """No aggregation by value, whose hash table grows with what a task reads."""
    rows = spark.range(100_000).select("id", F.col("id").cast("string").alias("s"))
    runs = profile._runs(profile.table_group(rows, "t"))
    assert runs.count() <= 2 * (1 + 2**profile.BUCKET_BITS) * rows.rdd.getNumPartitions()
    assert runs.filter("bucket < 0").agg(F.sum("total_rows")).first()[0] == 200_000
