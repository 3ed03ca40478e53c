import pytest
from pyspark.sql import functions as F

from colscope.functions import text
from colscope.operators import catalog as C
from colscope.operators import search, stats
from colscope.plans import tools
from colscope.session import skew_join


def test_like_has_wildcards_and_search_has_not(make_catalog):
    rows = make_catalog({"f": {"a_b": "string", "axb": "string", "A%B": "string"}})
    assert {r.column_name for r in C.find_columns_like(rows, "a_b").collect()} == {"a_b", "axb", "A%B"}
    assert {r.column_name for r in search.columns(rows, "A_B").collect()} == {"a_b"}
    assert {r.column_name for r in search.columns(rows, "%").collect()} == {"A%B"}


def test_empty_catalog_gives_zeros(make_catalog):
    found = C.database_stats(make_catalog({})).first()
    assert (found.total_files, found.total_columns, found.unique_columns, found.avg_file_size_mb) == (0, 0, 0, 0.0)


def test_totals(make_catalog, tenants):
    rows = make_catalog(tenants)
    found = stats.catalog_totals(rows).first()
    names = {c for columns in tenants.values() for c in columns}
    assert (found.total_files, found.total_rows, found.unique_columns) == (6, 60, len(names))
    assert found.data_types == "boolean, float, integer, string"
    assert C.database_stats(rows).first().avg_file_size_mb == 1.5


def test_column_scope_counts_and_previews(make_catalog, tenants):
    found = stats.column_stats(make_catalog(tenants), "ID").first()
    matching = [c for f in tenants.values() for c in f if "id" in c.lower()]
    assert found.matches == len(matching) and found.more == len(matching) - 5
    assert len(found.preview.split("; ")) == 5


def test_search_falls_back_to_meaning(make_catalog, tenants):
    rows = make_catalog(tenants)
    found = tools.search_metadata(rows, "customer identifier").collect()
    assert found and {"customer_id", "customerId"} <= {r.column_name for r in found}
    assert all(r.match_type == "semantic" for r in found)
    assert {r.confidence for r in found} <= {"HIGH", "MED"}


@pytest.mark.parametrize(
    "call",
    [
        lambda c: tools.search_metadata(c, " "),
        lambda c: tools.search_metadata(c, "x", "table"),
        lambda c: tools.get_statistics(c, "file"),
        lambda c: tools.get_statistics(c, "schema", "x"),
        lambda c: tools.find_relationships(c, "unknown"),
        lambda c: tools.detect_inconsistencies(c, "unknown"),
        lambda c: tools.compare_items(c, "nothing", "orders"),
        lambda c: tools.compare_items(c, "orders", "orders", "rows"),
        lambda c: tools.run_analysis(c, "sing a song"),
    ],
)
def test_senseless_arguments(make_catalog, tenants, call):
    with pytest.raises(ValueError):
        call(make_catalog(tenants))


def test_documented_questions(make_catalog, tenants):
    rows = make_catalog(tenants)
    assert all(r.file_name.endswith(".csv") for r in tools.get_files(rows).collect())
    assert {r.file_name for r in tools.get_schemas(rows, "customers").collect()} == {f for f in tenants if "customers" in f}
    assert {r.file_name for r in tools.search_metadata(rows, "customer_id").collect()} == {
        "simple_customers.csv", "simple_orders.csv"
    }
    assert {r.column_name for r in tools.detect_inconsistencies(rows, ["data_types"]).collect()} == {"customer_id", "zip"}
    assert tools.run_analysis(rows, "which are the largest files").first().column_count == 7
    assert tools.run_analysis(rows, "similar schemas please").columns[0] == "leader_file"


def test_skew_join_is_the_plain_join(spark, monkeypatch):
    import colscope.session as S

    monkeypatch.setattr(S, "HOT_KEYS", 2)
    monkeypatch.setattr(S, "SMALL_ROWS", 0)
    rows = spark.range(300).select((F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 50)).alias("k"), "id")
    lookup = spark.range(0, 40, 3).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    rows = rows.withColumn("k", F.col("k").cast("int"))
    for how in ("inner", "left", "left_semi"):
        found, plain = skew_join(rows, lookup, "k", how), rows.join(lookup, "k", how)
        assert sorted(found.collect(), key=repr) == sorted(plain.collect(), key=repr)


def test_text_measures(spark):
    many = "\n".join(f"line {i}" for i in range(21))
    texts = ["", "---\n===\n***", "a\n\n  \n----\nb", many, "\n" * 9 + "x\ny", "a\nb\nc\nd\ne", " ab \n__\n-=*_"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {
        r.i: (r.n, r.big, r.p)
        for r in rows.select(
            "i",
            text.content_lines(F.col("t")).alias("n"),
            text.exceeds(F.col("t")).alias("big"),
            text.preview(F.col("t")).alias("p"),
        ).collect()
    }
    assert found[0] == (0, False, "")
    assert found[1] == (0, False, "")
    assert found[2] == (2, False, "a\nb")
    assert found[3][:2] == (21, True)
    assert found[3][2] == "\n".join(f"line {i}" for i in range(5)) + "\n\n[... 16 more lines in export file ...]"
    assert found[4] == (2, False, "x")
    assert found[5] == (5, False, "a\nb\nc\nd\ne")
    assert found[6] == (2, False, " ab \n__")


def test_slug(spark):
    queries = ["What files do we have?", "  !!! ", "A" * 40, "tab\tand  blanks"]
    rows = spark.createDataFrame([(q,) for q in queries], "q string").select(text.slug(F.col("q")).alias("s"))
    assert [r.s for r in rows.collect()] == ["what-files-do-we-have", "query", "a" * 30, "tab-and-blanks"]
