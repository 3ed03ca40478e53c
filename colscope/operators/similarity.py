"""Similarity of texts: trigram vectors by default, dense vectors when the caller brings them.

Texts are compared once per distinct text, whatever number of files holds them. A similarity is rounded to
six digits before it is compared with a threshold, so that it does not depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions import names as N
from colscope.operators.dense import DenseVectors, dense_pairs
from colscope.operators.joins import posting_pairs
from colscope.session import broadcast_if_small, cut_lineage, holds_at_most, skew_join

TARGET = "target"
NONE = "none"
DIGITS = 6
_SLACK = 2e-6
FREQUENT_GRAMS = 10_000
QUERY_ROWS = 1_000
ITEM_ROWS = 100_000
# Distinct names whose grams a task holds at once, on average.
NAMES_TOGETHER = 50_000


def _check(threshold: float) -> None:
    if threshold <= 0:
        raise ValueError("threshold must be positive")


def target_text(name: Column, enrich: str = TARGET) -> Column:
    """The text a column name is found by."""
    if enrich not in (TARGET, NONE):
        raise ValueError(f"unknown enrichment: {enrich}")
    return N.normal_form(N.enrich(name) if enrich == TARGET else name)


def gram_counts(texts: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys, gram, n: the 3-character windows of each word, two blanks before it and one after, counted.

    ``texts`` that are already distributed by one of the keys are not shuffled again.
    """
    words = texts.select(*keys, F.explode(F.split(text, " ")).alias("_word")).filter("_word <> ''")
    padded = words.select(*keys, F.concat(F.lit("  "), "_word", F.lit(" ")).alias("_word"))
    starts = F.explode(F.sequence(F.lit(1), F.length("_word") - 2))
    windows = padded.select(*keys, "_word", starts.alias("_start"))
    return (
        windows.select(*keys, F.substring(F.col("_word"), F.col("_start"), F.lit(3)).alias("gram"))
        .groupBy(*keys, "gram")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )


def vectors(texts: DataFrame, text: Column, name: str) -> DataFrame:
    """``name`` and its unit-length trigram vector; texts without a word have none and are left out."""
    return (
        gram_counts(texts, [name], text)
        .groupBy(name)
        .agg(
            F.collect_list(F.struct("gram", "n")).alias("counts"),
            F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"),
        )
        .select(
            name,
            F.transform(
                "counts", lambda c: F.struct(c["gram"].alias("gram"), (c["n"] / F.col("length")).alias("weight"))
            ).alias("vector"),
        )
    )


def _in_parts(names: DataFrame, name: str) -> DataFrame:
    """The distinct ``names`` dealt by name into parts of bounded size: grams are many times the names they come from."""
    names = cut_lineage(names)
    parts = -(-names.count() // NAMES_TOGETHER)
    return names.repartition(parts, name) if parts > 1 else names


def term_matches(
    texts: DataFrame, name: str, terms: DataFrame, threshold: float, enrich: str = TARGET, fixed: bool = False,
    dense: DenseVectors | None = None,
) -> DataFrame:
    """Similarity of every distinct ``name`` with the terms (term, ...) of a list; by the caller's vectors if there are such.

    A list that is ``fixed`` (a constant of the code) or counted to be short is broadcast. The distinct names
    are dealt by name into parts of some ``NAMES_TOGETHER``; grams, vectors and sums then stay in their part.
    """
    _check(threshold)
    if dense is not None:
        asked = dense.of(terms, "term", "asked").select(F.col("term").alias("query_id"), F.col("vector").alias("query_vector"))
        found = dense.of(texts, name, "found").select(F.col(name).alias("item_id"), F.col("vector").alias("item_vector"))
        near = similar_vectors(cut_lineage(asked), found, threshold)
        near = near.select(F.col("item_id").alias(name), F.col("query_id").alias("term"), "similarity")
        return near.join(F.broadcast(terms) if fixed else terms, "term").select(name, *terms.columns, "similarity")
    term_vectors = vectors(terms.select("term").distinct(), N.normal_form(F.col("term")), "term")
    term_grams = term_vectors.select("term", F.inline("vector")).withColumnRenamed("weight", "term_weight")
    distinct = _in_parts(texts.select(name).distinct(), name)
    text_grams = vectors(distinct, target_text(F.col(name), enrich), name).select(name, F.inline("vector"))
    similarity = F.round(F.sum(F.col("weight") * F.col("term_weight")), DIGITS)
    matches = (
        text_grams.join(F.broadcast(term_grams) if fixed else broadcast_if_small(term_grams), "gram")
        .groupBy(name, "term")
        .agg(similarity.alias("similarity"))
        .filter(F.col("similarity") >= threshold)
    )
    return matches.join(F.broadcast(terms) if fixed else terms, "term").select(name, *terms.columns, "similarity")


def terms_frame(spark, concepts: dict[str, list[str]]) -> DataFrame:
    """concept, concept_order, term."""
    rows = [(c, i, term) for i, (c, terms) in enumerate(concepts.items()) for term in terms]
    return spark.createDataFrame(rows, "concept string, concept_order int, term string")


def similar_columns(
    catalog: DataFrame, term: str, threshold: float = 0.6, enrich: str = TARGET
) -> DataFrame:
    """Catalog rows whose name is similar to ``term``, with the similarity, best first."""
    terms = catalog.sparkSession.createDataFrame([(term,)], "term string")
    matches = term_matches(catalog, "column_name", terms, threshold, enrich, fixed=True).drop("term")
    return skew_join(catalog, matches, "column_name").orderBy(
        F.desc("similarity"), "file_name", "file_path", "column_name"
    )


def _rare_first(vectors_: DataFrame, name: str, frequent: DataFrame, threshold: float) -> DataFrame:
    """The prefix grams of each vector: rare to frequent, as long as the rest may still reach the threshold."""
    rank = F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), F.col("gram"), F.col("weight"))
    ranked = (
        vectors_.select(name, F.inline("vector"))
        .join(F.broadcast(frequent), "gram", "left")
        .groupBy(name)
        .agg(F.sort_array(F.collect_list(rank), asc=False).alias("ranked"))
    )
    # From the frequent end, drop grams while the length of what was dropped stays below the threshold.
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        "ranked",
        F.struct(F.lit(0.0).alias("rest"), empty.alias("kept")),
        lambda s, g: F.struct(
            (s["rest"] + g["weight"] * g["weight"]).alias("rest"),
            F.when(
                F.sqrt(s["rest"] + g["weight"] * g["weight"]) >= threshold - _SLACK,
                F.array_append(s["kept"], g["gram"]),
            ).otherwise(s["kept"]).alias("kept"),
        ),
        lambda s: s["kept"],
    )
    return ranked.select(name, F.explode(kept).alias("gram"))


def _dot(left: str, right: str) -> Column:
    """Dot product of two sparse vectors."""
    return N.let(
        F.map_from_entries(right),
        lambda weights: F.aggregate(
            left,
            F.lit(0.0),
            lambda total, g: total + g["weight"] * F.coalesce(F.try_element_at(weights, g["gram"]), F.lit(0.0)),
        ),
    )


def name_pairs(
    texts: DataFrame, name: str, threshold: float, enrich: str = TARGET, dense: DenseVectors | None = None
) -> DataFrame:
    """name1, name2, similarity of all ordered pairs of distinct names that reach ``threshold``.

    With ``dense`` the caller's vectors are compared, and ``enrich`` is the caller's affair.

    ``name1`` is the query, as it is; ``name2`` the target, enriched by default. A name is also compared with
    itself. Exact: the prefix of a vector is what remains when grams are dropped from the frequent end until
    their length would reach the threshold, so a pair without a common prefix gram cannot.
    """
    _check(threshold)
    if dense is not None:
        return dense_pairs(dense.of(texts, name, "asked"), dense.of(texts, name, "found"), name, threshold)
    distinct = texts.select(name).distinct()
    query = cut_lineage(vectors(distinct, N.normal_form(F.col(name)), name))
    target = query if enrich == NONE else cut_lineage(vectors(distinct, target_text(F.col(name), enrich), name))
    frequent = (
        target.select(F.explode("vector.gram").alias("gram"))
        .groupBy("gram")
        .agg(F.count(F.lit(1)).alias("frequency"))
        .orderBy(F.desc("frequency"), "gram")
        .limit(FREQUENT_GRAMS)
    )
    right = cut_lineage(_rare_first(target, name, frequent, threshold).withColumnRenamed(name, "name2"))
    if enrich == NONE:
        left = right.withColumnRenamed("name2", "name1")
    else:
        left = cut_lineage(_rare_first(query, name, frequent, threshold).withColumnRenamed(name, "name1"))
    candidates = posting_pairs(left, right, "gram", F.lit(True)).select("name1", "name2").distinct()
    one = query.select(F.col(name).alias("name1"), F.col("vector").alias("vector1"))
    two = target.select(F.col(name).alias("name2"), F.col("vector").alias("vector2"))
    return (
        candidates.join(one, "name1")
        .join(two, "name2")
        .select("name1", "name2", F.round(_dot("vector1", "vector2"), DIGITS).alias("similarity"))
        .filter(F.col("similarity") >= threshold)
    )


def dense_dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def similar_vectors(queries: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """query_id, item_id, similarity of unit vectors: (query_id, query_vector) against (item_id, item_vector).

    A short list of queries travels to the items, which are scanned once and not moved. A longer one is cut
    into lists, the items into blocks, and each list meets each block under a join key of its own.
    """
    similarity = F.round(dense_dot(F.col("query_vector"), F.col("item_vector")), DIGITS)
    if holds_at_most(queries, QUERY_ROWS):
        lists, blocks = 1, 1
    else:
        lists, blocks = -(-queries.count() // QUERY_ROWS), -(-items.count() // ITEM_ROWS)

    def spread(df: DataFrame, key: str, own: str, parts: int, other: str, other_parts: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(other_parts - 1)))
        )

    asked = spread(queries, "query_id", "_list", lists, "_block", blocks)
    found = spread(items, "item_id", "_block", blocks, "_list", lists).join(
        F.broadcast(asked) if lists == 1 else asked, ["_list", "_block"]
    )
    return found.select("query_id", "item_id", similarity.alias("similarity")).filter(
        F.col("similarity") >= threshold
    )


def embed(texts: DataFrame, text: Column, name: str, load: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """``name`` and the dense unit vector of ``text``, from a model the caller brings.

    ``load`` returns a function from texts to vectors; it is called once per Python worker, not per batch.
    """

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series([[float(x) for x in v] for v in model(batch.tolist())])

    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    return (
        texts.select(name, encode(text).alias("vector"))
        .withColumn("length", length)
        .filter("length > 0")
        .select(name, F.transform("vector", lambda x: x / F.col("length")).alias("vector"))
    )


def similar_columns_dense(
    catalog: DataFrame,
    term: str,
    load: Callable[[], Callable[[list[str]], list]],
    threshold: float = 0.6,
) -> DataFrame:
    """``similar_columns`` by the vectors of a model; every distinct name is embedded once."""
    _check(threshold)
    names = catalog.select("column_name").distinct()
    items = embed(names, N.enrich(F.col("column_name")), "column_name", load)
    asked = embed(catalog.sparkSession.createDataFrame([(term,)], "term string"), F.col("term"), "term", load)
    matches = similar_vectors(
        asked.select(F.col("term").alias("query_id"), F.col("vector").alias("query_vector")),
        items.select(F.col("column_name").alias("item_id"), F.col("vector").alias("item_vector")),
        threshold,
    ).select(F.col("item_id").alias("column_name"), "similarity")
    return skew_join(catalog, matches, "column_name").orderBy(
        F.desc("similarity"), "file_name", "file_path", "column_name"
    )
