"""Inconsistencies that need no notion of meaning: types of a name, and look-alike names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.operators.catalog import FILE, type_mismatch_files, type_mismatches
from colscope.operators.joins import posting_pairs
from colscope.session import cut_lineage

# Fixed value: characters of a prefix or suffix that two names must share.
AFFIX = 4


def type_variations(catalog: DataFrame) -> DataFrame:
    """Names with several types, most files first: one row per (name, type)."""
    mismatches = type_mismatches(catalog)
    totals = mismatches.groupBy("column_name").agg(F.sum("file_count").alias("total_files"))
    return (
        mismatches.join(totals, "column_name")
        .select("column_name", "total_files", "data_type", "file_count")
        .orderBy(F.desc("total_files"), "column_name", "data_type")
    )


def type_variation_files(catalog: DataFrame) -> DataFrame:
    """The files behind ``type_variations``, one row each."""
    return type_mismatch_files(catalog).select("column_name", "data_type", *FILE)


def _bare(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(""))


def _short_suffix(name: Column) -> Column:
    return F.right(name, F.lit(AFFIX))


def _has_prefix_of(a: Column, b: Column) -> Column:
    """Whether ``a`` starts with the first characters of ``b`` (all of it, if it is shorter)."""
    return F.startswith(a, F.left(b, F.lit(AFFIX)))


def _has_suffix_of(a: Column, b: Column) -> Column:
    return F.endswith(a, _short_suffix(b))


def similarity_reason(lower1: Column, lower2: Column) -> Column:
    """Why two lower-case names look alike; null if they do not."""
    return (
        F.when(_bare(lower1) == _bare(lower2), "underscore_variation")
        .when(_has_prefix_of(lower1, lower2) | _has_prefix_of(lower2, lower1), "similar_prefix")
        .when(_has_suffix_of(lower1, lower2) | _has_suffix_of(lower2, lower1), "similar_suffix")
    )


def naming_patterns(catalog: DataFrame, name: str = "column_name") -> DataFrame:
    """Pairs of distinct names that look alike: same first or last four characters, or same but for ``_``.

    Three blocked joins, one per reason, and each keeps only the pairs whose reason it is, so no pair is made
    twice and none has to be removed. A name shorter than four characters is itself the affix to be matched, so
    the other side offers all its affixes up to that length.
    """
    distinct = catalog.select(F.col(name).alias("name")).distinct()
    names = cut_lineage(distinct.withColumn("lower", F.lower("name")))
    left = names.select(F.col("name").alias("a"), F.col("lower").alias("la"))
    right = names.select(F.col("name").alias("b"), F.col("lower").alias("lb"))
    reason = similarity_reason(F.col("la"), F.col("lb"))
    lengths = F.sequence(F.lit(0), F.least(F.length("lb"), F.lit(AFFIX)))

    def joined(left_key: Column, right_key: Column, wanted: str, matched_back: Column) -> DataFrame:
        """``a`` fits ``b`` by the join key; a pair that also fits the other way is kept in order only."""
        once = (F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & ~matched_back)
        return posting_pairs(
            left.withColumn("key", left_key), right.withColumn("key", right_key), "key", (reason == wanted) & once
        )

    same = joined(_bare(F.col("la")), _bare(F.col("lb")), "underscore_variation", F.lit(True))
    prefix = joined(
        F.left("la", F.lit(AFFIX)),
        F.explode(F.transform(lengths, lambda n: F.substring(F.col("lb"), F.lit(1), n))),
        "similar_prefix",
        _has_prefix_of(F.col("la"), F.col("lb")),
    )
    suffix = joined(
        _short_suffix(F.col("la")),
        F.explode(F.transform(lengths, lambda n: F.right(F.col("lb"), n))),
        "similar_suffix",
        _has_suffix_of(F.col("la"), F.col("lb")),
    )
    pairs = same.unionByName(prefix).unionByName(suffix)
    return pairs.select(
        F.least("a", "b").alias("column1"),
        F.greatest("a", "b").alias("column2"),
        reason.alias("similarity_reason"),
    ).orderBy("column1", "column2")


def naming_families(texts: DataFrame, name: str) -> DataFrame:
    """The look-alike relation without its pairs, for vocabularies: names that share an affix or bare form.

    rule, key, names (how many), first_name. Linear in the number of names, however large a family is.
    """
    names = texts.select(F.col(name).alias("name")).distinct()
    lowered = F.lower("name")
    rules = F.array(
        F.struct(F.lit("bare").alias("rule"), _bare(lowered).alias("key")),
        F.struct(F.lit("prefix").alias("rule"), F.left(lowered, F.lit(AFFIX)).alias("key")),
        F.struct(F.lit("suffix").alias("rule"), _short_suffix(lowered).alias("key")),
    )
    return (
        names.select("name", F.inline(rules))
        .groupBy("rule", "key")
        .agg(F.count(F.lit(1)).alias("names"), F.min("name").alias("first_name"))
        .filter("names > 1")
    )
