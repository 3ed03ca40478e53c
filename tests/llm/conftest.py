import pytest

FOLDER = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # names that operators use inside
    "id bigint, n bigint, key string, size int, hub bigint, document string, score double, row_id bigint, line bigint, words int"
)


def row(doc_id, text, source="src0"):
    return (doc_id, text, "en", source, None, 1, None, "k", 3, 4, "d", None, 5, 6, 7)


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i * i % 1009}x{i}" for i in range(20_000))
    passage = " ".join(f"shared{i}" for i in range(60))
    return [
        row(9001, None), row(9002, ""), row(9003, " \t\n\x0b\x0c\r "), row(None, "a text without a key at all here"),
        row(9005, long), row(9006, long + " end"), row(9007, "same row twice, said in seven words"),
        row(9007, "same row twice, said in seven words"), row(9008, "Same row  twice, said in seven words", None),
        row(9009, "one"), row(9010, "ONE"), row(9011, "é" * 5000), row(9012, "a b c d e " * 40, None),
        row(9013, "start one two " + passage + " three four end"), row(9014, "other begin " + passage + " and a last word"),
        row(9015, "x" * 200_000), row(9016, "line of seven words that is repeated\nline of seven words that is repeated\n\n"),
        row(9017, "Line of seven words that is repeated\nanother line that has some more words here"),
    ]


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def docs(spark, given, tmp_path_factory):
    """The given documents, the odd rows, and columns whose names operators use inside."""
    rows = [row(r.doc_id, r.text, r.source) for r in given.collect()] + odd_rows()
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
