"""Operators on the meaning of column names.

All of them rest on two relations over *distinct* names: names similar to fixed terms, and names similar to each
other. Greedy walks over all columns of all files are decided per name as well: whether a column is claimed
depends only on its name and on where the first leader like it stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions import names as N
from colscope.operators import greedy, similarity
from colscope.operators.catalog import FILE
from colscope.operators.dense import DenseVectors
from colscope.operators.joins import posting_pairs
from colscope.operators.relationships import (
    differences_of,
    listed,
    mismatch_list,
    names_of,
    without_names,
)
from colscope.operators.shapes import Shapes, in_file_order, ordered_shape_pairs, second_file, shapes_of, with_columns
from colscope.session import cut_lineage, skew_join

GROUP_THRESHOLD = 0.7
CLASS_THRESHOLD = 0.6
CLASS_FLOOR = 0.1
SCHEMA_THRESHOLD = 0.6
DIFFERENCE_THRESHOLD = 0.6
NAMING_THRESHOLD = 0.8
ABBREVIATION_GAP = 3
_SLACK = 1e-9


def position() -> Column:
    """Where a column stands in the catalog: by file, then by name."""
    return F.struct("file_name", "file_path", "column_name")


def concepts_of_names(
    texts: DataFrame, name: str, threshold: float = GROUP_THRESHOLD, dense: DenseVectors | None = None
) -> DataFrame:
    """concept, ``name``, similarity: the best similarity over the terms of each concept a name reaches."""
    terms = similarity.terms_frame(texts.sparkSession, N.CONCEPT_TERMS)
    return (
        similarity.term_matches(texts, name, terms, threshold, fixed=True, dense=dense)
        .groupBy("concept", name)
        .agg(F.max("similarity").alias("similarity"))
    )


def concept_groups(catalog: DataFrame, threshold: float = GROUP_THRESHOLD, dense: DenseVectors | None = None) -> DataFrame:
    """Columns of each concept, best first; a column may belong to several."""
    concepts = concepts_of_names(catalog, "column_name", threshold, dense)
    return (
        skew_join(catalog.select(*FILE, "column_name"), concepts, "column_name")
        .select("concept", *FILE, "column_name", "similarity")
        .orderBy("concept", F.desc("similarity"), *FILE, "column_name")
    )


def classify_names(
    texts: DataFrame, name: str, threshold: float = CLASS_THRESHOLD, dense: DenseVectors | None = None
) -> DataFrame:
    """``name``, concept: the concept of the most similar phrase, or ``other`` below the threshold."""
    terms = similarity.terms_frame(texts.sparkSession, N.CONCEPT_TEMPLATES)
    names = cut_lineage(texts.select(name).distinct())
    best = (
        similarity.term_matches(names, name, terms, max(threshold, CLASS_FLOOR), fixed=True, dense=dense)
        .groupBy(name)
        .agg(F.min_by("concept", F.struct(-F.col("similarity"), "concept_order")).alias("concept"))
    )
    return (
        names.join(best, name, "left")
        .select(name, F.coalesce("concept", F.lit(N.OTHER)).alias("concept"))
    )


def concept_evolution(catalog: DataFrame, threshold: float = GROUP_THRESHOLD, dense: DenseVectors | None = None) -> DataFrame:
    """Concepts found in several files: one row per (concept, file) with the column names there, best first."""
    per_file = (
        concept_groups(catalog, threshold, dense)
        .groupBy("concept", *FILE)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "column_name"))).alias("found"))
    )
    files = per_file.groupBy("concept").agg(F.count(F.lit(1)).alias("file_count")).filter("file_count > 1")
    return (
        per_file.join(F.broadcast(files), "concept")
        .select(
            "concept",
            "file_count",
            *FILE,
            F.array_join(F.transform("found", lambda c: c["column_name"]), ", ").alias("columns"),
        )
        .orderBy("concept", *FILE)
    )


def _types_of_concepts(catalog: DataFrame, threshold: float, dense: DenseVectors | None) -> DataFrame:
    """concept, type, columns: how many columns of a concept have a type. ``other`` is no concept."""
    names = classify_names(catalog, "column_name", threshold, dense).filter(F.col("concept") != N.OTHER)
    return (
        catalog.groupBy("column_name", "data_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(names, "column_name")
        .groupBy("concept", F.col("data_type").alias("type"))
        .agg(F.sum("n").alias("columns"))
    )


def concept_types(catalog: DataFrame, threshold: float = CLASS_THRESHOLD, dense: DenseVectors | None = None) -> DataFrame:
    """Concepts whose columns have several types: the types, the number of columns, the type to settle on.

    The most frequent type is suggested; among equals the first by name.
    """
    return (
        _types_of_concepts(catalog, threshold, dense)
        .groupBy("concept")
        .agg(
            F.sum("columns").alias("columns"),
            F.array_sort(F.collect_list("type")).alias("types"),
            F.min_by("type", F.struct(-F.col("columns"), "type")).alias("suggestion"),
        )
        .filter(F.size("types") > 1)
        .select("concept", "columns", F.array_join("types", ", ").alias("inconsistent_types"), "suggestion")
        .orderBy("concept")
    )


def concept_type_columns(catalog: DataFrame, threshold: float = CLASS_THRESHOLD, dense: DenseVectors | None = None) -> DataFrame:
    """The columns behind ``concept_types``, one row each."""
    mixed = concept_types(catalog, threshold, dense).select("concept")
    names = classify_names(catalog, "column_name", threshold, dense).join(F.broadcast(mixed), "concept", "left_semi")
    return skew_join(catalog.select(*FILE, "column_name", "data_type"), names, "column_name")


def _shape_columns(found: Shapes) -> DataFrame:
    return found.shapes.select(
        "rep", F.size("columns").alias("width"), F.explode(names_of("columns")).alias("name")
    )


def _shape_scores(found: Shapes, pairs: DataFrame, threshold: float) -> DataFrame:
    """rep1, rep2, similarity of the ordered pairs of shapes above ``threshold``, by mean best match.

    To pass, more than ``threshold * width`` columns of a shape need a partner, so among any
    ``ceil(width * (1 - threshold))`` of them one has. Only that many are probed, the ones with the fewest partners.
    """
    columns = cut_lineage(_shape_columns(found))
    holders = columns.groupBy(F.col("name").alias("name2")).agg(F.count(F.lit(1)).alias("holders"))
    reach = pairs.join(holders, "name2").groupBy(F.col("name1").alias("name")).agg(F.sum("holders").alias("reach"))
    ranked = (
        skew_join(columns, reach, "name", "left")
        .groupBy("rep", "width")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("reach", F.lit(0)).alias("reach"), "name"))).alias("r"))
    )
    probes = F.greatest(F.ceil(F.col("width") * (1 - threshold) - _SLACK), F.lit(1)).cast("int")
    probed = ranked.select(
        F.col("rep").alias("rep1"), F.explode(F.transform(F.slice("r", F.lit(1), probes), lambda c: c["name"])).alias("name1")
    )
    of_two = columns.select(F.col("rep").alias("rep2"), F.col("name").alias("name2"))
    wanted = cut_lineage(probed.join(pairs.select("name1", "name2"), "name1").select("rep1", "name2").distinct())
    candidates = posting_pairs(wanted, of_two, "name2", F.lit(True)).select("rep1", "rep2").distinct()
    of_one = columns.select(F.col("rep").alias("rep1"), "width", F.col("name").alias("name1"))
    best = (
        candidates.join(of_one, "rep1")
        .join(pairs, "name1")
        .join(of_two, ["rep2", "name2"])
        .groupBy("rep1", "rep2", "width", "name1")
        .agg(
            F.max("similarity").alias("best"),
            F.min_by("name2", F.struct(-F.col("similarity"), "name2")).alias("name2"),
        )
    )
    return (
        best.groupBy("rep1", "rep2", "width")
        .agg(
            F.sum("best").alias("total"),
            F.array_sort(F.collect_list(F.struct("name1", "name2", "best"))).alias("matches"),
        )
        .withColumn("similarity", F.round(F.col("total") / F.col("width"), similarity.DIGITS))
        .filter(F.col("similarity") > threshold)
        .select("rep1", "rep2", "similarity", "matches")
    )


def _scored_files(
    catalog: DataFrame, threshold: float, enrich: str, per_file: bool, dense: DenseVectors | None
) -> DataFrame:
    """file1, file2, copies1, copies2, similarity, matches, in file order."""
    found = shapes_of(catalog, with_types=False)
    pairs = cut_lineage(similarity.name_pairs(catalog, "column_name", threshold, enrich, dense))
    scores = _shape_scores(found, pairs, threshold)
    if per_file:
        members = cut_lineage(found.members())
        ones = members.select(F.col("file").alias("file1"), F.col("rep").alias("rep1"))
        twos = members.select(F.col("file").alias("file2"), F.col("rep").alias("rep2"))
        copies = F.lit(1).cast("bigint")
        return (
            scores.join(ones, "rep1")
            .join(twos, "rep2")
            .filter("file1 < file2")
            .select("file1", "file2", copies.alias("copies1"), copies.alias("copies2"), "similarity", "matches")
        )
    ones = found.shapes.select(F.col("rep").alias("rep1"), F.col("copies").alias("copies1"))
    twos = found.shapes.select(F.col("rep").alias("rep2"), F.col("last").alias("last2"), F.col("copies").alias("copies2"))
    return (
        scores.join(ones, "rep1")
        .join(twos, "rep2")
        .filter(in_file_order())
        .select(
            F.col("rep1").alias("file1"), second_file().alias("file2"), "copies1", "copies2", "similarity", "matches"
        )
    )


def _file_columns(*more: str | Column) -> list[Column]:
    return [
        F.col("file1.file_name").alias("file1"),
        F.col("file1.file_path").alias("path1"),
        F.col("file2.file_name").alias("file2"),
        F.col("file2.file_path").alias("path2"),
        *[F.col(c) if isinstance(c, str) else c for c in more],
    ]


def semantic_schema_pairs(
    catalog: DataFrame,
    threshold: float = SCHEMA_THRESHOLD,
    enrich: str = similarity.TARGET,
    per_file: bool = False,
    dense: DenseVectors | None = None,
) -> DataFrame:
    """Pairs of files of similar meaning: mean over the first file's columns of the best match in the second.

    Files of equal columns are one item, counted in ``copies``: a row stands for all pairs of a file of the first item
    before a file of the second, and names one of them. Scores are one-way, so two items have a row for each
    order in which their files occur, and an item of several files one with itself. ``per_file`` states every pair.
    """
    return (
        _scored_files(catalog, threshold, enrich, per_file, dense)
        .select(*_file_columns("copies1", "copies2", "similarity"))
        .orderBy(F.desc("similarity"), "file1", "path1", "file2", "path2")
    )


def matching_concepts(
    catalog: DataFrame, threshold: float = SCHEMA_THRESHOLD, enrich: str = similarity.TARGET, dense: DenseVectors | None = None
) -> DataFrame:
    """The best partner of each column in the pairs of ``semantic_schema_pairs``, and the column's concept."""
    matches = _scored_files(catalog, threshold, enrich, False, dense).select(
        *_file_columns(F.explode("matches").alias("m"))
    )
    concepts = classify_names(catalog, "column_name", dense=dense).withColumnRenamed("column_name", "column1")
    return (
        matches.select(
            "file1",
            "path1",
            "file2",
            "path2",
            F.col("m.name1").alias("column1"),
            F.col("m.name2").alias("column2"),
            F.col("m.best").alias("similarity"),
        )
        .join(concepts, "column1")
    )


def is_inconsistent(styles: Column, distinct_names: Column, members: Column) -> Column:
    """Whether a group mixes naming styles, or repeats no name."""
    return (members > 1) & ((F.size(styles) > 1) | (distinct_names == members))


def suggested_name(all_id: Column, customer: Column, user: Column, order: Column, shortest: Column) -> Column:
    return (
        F.when(all_id & customer, "customer_id")
        .when(all_id & user, "user_id")
        .when(all_id & order, "order_id")
        .otherwise(shortest)
    )


def _word(name: Column, word: str) -> Column:
    return F.contains(F.lower(name), F.lit(word))


def name_groups(
    members: DataFrame, keys: list[str], name: str, order: Column, count: Column | None = None
) -> DataFrame:
    """Per group of names: members, distinct_names, styles, inconsistent, suggestion.

    ``members`` holds a name at most once per value of ``order``; ``count`` is how many columns a row stands for.
    Styles and names are combined map-side; a group's columns are never brought together.
    """
    n = F.lit(1) if count is None else count
    shown = N.styles(F.col(name))
    per_name = members.groupBy(*keys, name).agg(F.sum(n).alias("n"), F.min(order).alias("first"))
    groups = per_name.groupBy(*keys).agg(
        F.sum("n").alias("members"),
        F.count(F.lit(1)).alias("distinct_names"),
        *[F.max(F.array_contains(shown, s)).alias(f"has_{s}") for s in ("underscore", "camelcase", "lowercase")],
        F.min(_word(F.col(name), "id")).alias("all_id"),
        *[F.max(_word(F.col(name), w)).alias(f"any_{w}") for w in ("customer", "user", "order")],
        F.min_by(name, F.struct(F.length(name), "first")).alias("shortest"),
    )
    styles = F.array_compact(
        F.array(*[F.when(F.col(f"has_{s}"), s) for s in ("underscore", "camelcase", "lowercase")])
    )
    return groups.select(
        *keys,
        "members",
        "distinct_names",
        F.array_join(styles, ", ").alias("styles"),
        is_inconsistent(styles, F.col("distinct_names"), F.col("members")).alias("inconsistent"),
        suggested_name(
            F.col("all_id"), F.col("any_customer"), F.col("any_user"), F.col("any_order"), F.col("shortest")
        ).alias("suggestion"),
    )


def _first_positions(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(F.col("column_name").alias("name")).agg(F.min(position()).alias("first"))


def leading_names(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """name1, first1, claimed_at of the names with columns that lead a greedy walk over all columns.

    ``edges`` (name1, name2, similarity): a leader called name1 claims later columns called name2. The first column of
    a name leads iff no leading name before it claims the name; if it does, so does every further column of
    the name that stands before the first claim.
    """
    firsts = _first_positions(catalog)
    one = firsts.select(F.col("name").alias("name1"), F.col("first").alias("first1"))
    two = firsts.select(F.col("name").alias("name2"), F.col("first").alias("first2"))
    placed = cut_lineage(edges.select("name1", "name2").join(one, "name1").join(two, "name2"))
    forward = placed.filter(F.col("first1") < F.col("first2"))
    claimed = greedy.claimed_items(forward.select(F.col("first1").alias("src"), F.col("first2").alias("dst")))
    leaders = one.join(claimed.select(F.col("id").alias("first1")), "first1", "left_anti")
    claims = (
        placed.join(leaders.select("name1"), "name1", "left_semi")
        .groupBy(F.col("name2").alias("name1"))
        .agg(F.min("first1").alias("claimed_at"))
    )
    return leaders.join(claims, "name1", "left")


def _leading_columns(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """name1, position of the columns that lead."""
    columns = catalog.select(F.col("column_name").alias("name1"), position().alias("position"))
    # A column at the claiming position is the claimant itself; what comes after it is claimed.
    leading = skew_join(columns, leading_names(catalog, edges), "name1").filter(
        F.col("claimed_at").isNull() | (F.col("position") <= F.col("claimed_at"))
    )
    return leading.select("name1", "position")


def naming_inconsistency_members(
    catalog: DataFrame, threshold: float = NAMING_THRESHOLD, enrich: str = similarity.TARGET, dense: DenseVectors | None = None
) -> DataFrame:
    """Greedy groups of like columns: leader (position), member (position), similarity; the leader included."""
    edges = cut_lineage(similarity.name_pairs(catalog, "column_name", threshold, enrich, dense))
    leading = _leading_columns(catalog, edges)
    columns = catalog.select(F.col("column_name").alias("name2"), position().alias("member"))
    led = cut_lineage(edges.join(leading, "name1"))
    followers = posting_pairs(columns, led, "name2", F.col("position") < F.col("member")).select(
        F.col("position").alias("leader"), "member", "similarity"
    )
    followers = cut_lineage(followers)
    alone = followers.select("leader").distinct()
    own = alone.select("leader", F.col("leader").alias("member"), F.lit(None).cast("double").alias("similarity"))
    return followers.unionByName(own)


def naming_inconsistencies(
    catalog: DataFrame, threshold: float = NAMING_THRESHOLD, enrich: str = similarity.TARGET, dense: DenseVectors | None = None
) -> DataFrame:
    """Groups of like columns whose names mix styles or all differ, most similar first.

    One row per group with its leader, concept, average similarity and suggested name; the columns of the groups are
    ``naming_inconsistency_members``.
    """
    members = naming_inconsistency_members(catalog, threshold, enrich, dense)
    named = members.select("leader", F.col("member.column_name").alias("name"), "member", "similarity")
    groups = name_groups(named, ["leader"], "name", F.struct(-F.coalesce("similarity", F.lit(2.0)), "member"))
    averages = named.groupBy("leader").agg(F.round(F.avg("similarity"), similarity.DIGITS).alias("avg_similarity"))
    concepts = classify_names(catalog, "column_name", dense=dense)
    return (
        groups.filter("inconsistent")
        .join(averages, "leader")
        .withColumn("column_name", F.col("leader.column_name"))
        .join(concepts, "column_name")
        .select(
            F.col("leader.file_name").alias("file_name"),
            F.col("leader.file_path").alias("file_path"),
            "column_name",
            "concept",
            "members",
            "distinct_names",
            "styles",
            "avg_similarity",
            "suggestion",
        )
        .orderBy(F.desc("avg_similarity"), "file_name", "file_path", "column_name")
    )


def abbreviations(
    catalog: DataFrame, threshold: float = NAMING_THRESHOLD, enrich: str = similarity.TARGET, dense: DenseVectors | None = None
) -> DataFrame:
    """Like columns whose names differ in length by three or more: the short and the long name and their files."""
    gap = F.abs(F.length("name1") - F.length("name2"))
    edges = cut_lineage(
        similarity.name_pairs(catalog, "column_name", threshold, enrich, dense).filter(gap >= ABBREVIATION_GAP)
    )
    leading = _leading_columns(catalog, edges)
    columns = catalog.select(F.col("column_name").alias("name2"), position().alias("member"))
    led = cut_lineage(edges.join(leading, "name1"))
    found = posting_pairs(columns, led, "name2", F.lit(True))
    first_is_short = F.length("name1") < F.length("name2")

    def either(when_first: str, otherwise: str) -> Column:
        return F.when(first_is_short, F.col(when_first)).otherwise(F.col(otherwise))

    return found.select(
        either("name1", "name2").alias("short"),
        either("name2", "name1").alias("long"),
        "similarity",
        either("position.file_name", "member.file_name").alias("short_file"),
        either("position.file_path", "member.file_path").alias("short_path"),
        either("member.file_name", "position.file_name").alias("long_file"),
        either("member.file_path", "position.file_path").alias("long_path"),
    ).orderBy(F.desc("similarity"), "short", "long", "short_file", "long_file")


def _match_one_to_one(edges: str) -> Column:
    """Walk (name1, minus, name2) in order: each name1 takes its best name2 that is still free."""
    match = "struct<name1:string,name2:string,similarity:double>"
    start = F.struct(
        F.array().cast("array<string>").alias("used"),
        F.lit("").alias("last"),
        F.lit(False).alias("started"),
        F.array().cast(f"array<{match}>").alias("found"),
    )

    def step(state: Column, edge: Column) -> Column:
        taken = F.array_contains(state["used"], edge["name2"]) | (
            state["started"] & (state["last"] == edge["name1"])
        )
        pair = F.struct(
            edge["name1"].alias("name1"), edge["name2"].alias("name2"), (-edge["minus"]).alias("similarity")
        )
        return F.struct(
            F.when(taken, state["used"]).otherwise(F.array_append(state["used"], edge["name2"])).alias("used"),
            F.when(taken, state["last"]).otherwise(edge["name1"]).alias("last"),
            (state["started"] | ~taken).alias("started"),
            F.when(taken, state["found"]).otherwise(F.array_append(state["found"], pair)).alias("found"),
        )

    return F.aggregate(F.array_sort(edges), start, step, lambda s: s["found"])


def semantic_differences(
    catalog: DataFrame, threshold: float = DIFFERENCE_THRESHOLD, enrich: str = similarity.TARGET,
    dense: DenseVectors | None = None, near: Callable[[Shapes], DataFrame] | None = None,
) -> DataFrame:
    """Differences of the pairs of distinct schemas that share a column or a meaning, with unmatched columns paired.

    Nothing is said of schemas with nothing in common. The pairing starts from the first file, so schemas whose files occur in both orders have a row for each.

    In name order, each column only in the first file takes the most similar free column only in the second.
    What remains on either side may be missing on the other. Columns of differing type count as matching here.
    ``near`` chooses the pairs (rep1, rep2) of shapes to speak of, such as ``nearest.near_pairs``.
    """
    found = shapes_of(catalog)
    similar = cut_lineage(similarity.name_pairs(catalog, "column_name", threshold, enrich, dense))
    if near is None:
        chosen = ordered_shape_pairs(found.shapes, similar)
    else:
        some = near(found)
        some = some.unionByName(some.select(F.col("rep2").alias("rep1"), F.col("rep1").alias("rep2"))).distinct()
        chosen = with_columns(cut_lineage(some), found.shapes).filter(in_file_order())
    pairs = cut_lineage(differences_of(chosen))
    edges = (
        pairs.select("rep1", "rep2", names_of("only2").alias("names2"), F.explode(names_of("only1")).alias("name1"))
        .join(similar, "name1")
        .filter(F.array_contains("names2", F.col("name2")))
        .groupBy("rep1", "rep2")
        .agg(F.collect_list(F.struct("name1", (-F.col("similarity")).alias("minus"), "name2")).alias("edges"))
        .select("rep1", "rep2", _match_one_to_one("edges").alias("equivalents"))
    )
    matched = F.coalesce("equivalents", F.array().cast("array<struct<name1:string,name2:string,similarity:double>>"))
    with_equivalents = (
        pairs.join(edges, ["rep1", "rep2"], "left")
        .withColumn("equivalents", matched)
        .withColumn("only1", without_names("only1", F.transform("equivalents", lambda e: e["name1"])))
        .withColumn("only2", without_names("only2", F.transform("equivalents", lambda e: e["name2"])))
    )
    equivalent_list = F.array_join(
        F.transform(
            "equivalents",
            lambda e: F.concat(e["name1"], F.lit(" <-> "), e["name2"], F.lit(" "), F.format_number(e["similarity"], 3)),
        ),
        ", ",
    )
    with_equivalents = with_equivalents.filter((F.size("common") > 0) | (F.size("equivalents") > 0))
    return with_equivalents.select(
        F.col("rep1.file_name").alias("file1"),
        F.col("rep1.file_path").alias("path1"),
        second_file()["file_name"].alias("file2"),
        second_file()["file_path"].alias("path2"),
        "copies1",
        "copies2",
        ((F.size("common") + F.size("equivalents")) / F.col("united")).alias("similarity"),
        F.size("common").cast("bigint").alias("common_columns"),
        listed(F.col("only1")).alias("unique_to_file1"),
        listed(F.col("only2")).alias("unique_to_file2"),
        mismatch_list(F.col("mismatches")).alias("type_mismatches"),
        equivalent_list.alias("semantic_equivalents"),
        F.array_join(names_of("only1"), ", ").alias("missing_in_file2"),
        F.array_join(names_of("only2"), ", ").alias("missing_in_file1"),
    )
