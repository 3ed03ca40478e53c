"""The eight catalog tools as functions from a catalog to a DataFrame.

An argument that makes no sense raises ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from colscope.operators import consistency, naming, nearest, relationships, search, stats
from colscope.operators import semantic as meaning
from colscope.operators.dense import DenseVectors

LARGEST_FILES = 10


def get_files(catalog: DataFrame, pattern: str | None = None) -> DataFrame:
    return search.files(catalog, pattern)


def get_schemas(catalog: DataFrame, file_pattern: str | None = None, detailed: bool = True) -> DataFrame:
    return search.schemas(catalog, file_pattern, detailed)


def get_statistics(catalog: DataFrame, scope: str = "database", target: str | None = None) -> DataFrame:
    return stats.statistics(catalog, scope, target)


def search_metadata(
    catalog: DataFrame, search_term: str, search_type: str = "column", semantic: bool = False
) -> DataFrame:
    return search.search(catalog, search_term, search_type, semantic)


def find_relationships(
    catalog: DataFrame,
    analysis_type: str = "common_columns",
    threshold: float | None = None,
    semantic: bool = False,
    near: int | None = None,
    dense: DenseVectors | None = None,
) -> DataFrame:
    """Relations by type; each has a default threshold of its own scale. ``semantic`` compares names by meaning.

    ``near`` restricts differences to the so many nearest schemas of each, which keeps them linear; ``dense`` brings the
    vectors of a model for the types on meaning.

    ``common_columns`` counts files (2). ``similar_schemas`` takes tenths of a Jaccard index (3). The types
    on meaning take a similarity.
    """
    given = {} if threshold is None else {"threshold": threshold}
    if analysis_type == "semantic_groups":
        return meaning.concept_groups(catalog, **given, dense=dense)
    if analysis_type == "concept_evolution":
        return meaning.concept_evolution(catalog, **given, dense=dense)
    if analysis_type == "similar_schemas":
        if semantic:
            return meaning.semantic_schema_pairs(catalog, **given, dense=dense)
        return relationships.schema_groups(catalog, relationships.legacy_threshold(3 if threshold is None else threshold))
    if analysis_type == "schema_differences":
        chosen = None if near is None else lambda found: nearest.near_pairs(found, near)
        if semantic:
            return meaning.semantic_differences(catalog, **given, dense=dense, near=chosen)
        return relationships.schema_differences(catalog) if near is None else nearest.nearest_differences(catalog, near)
    if analysis_type == "common_columns":
        return relationships.common_columns(catalog, int(2 if threshold is None else threshold))
    raise ValueError(f"unknown analysis type: {analysis_type}")


def detect_inconsistencies(
    catalog: DataFrame, check_type: str | list[str] = "data_types", threshold: float | None = None,
    by_name: bool = False, dense: DenseVectors | None = None,
) -> DataFrame:
    """Checks by type; of a list the first counts. Each check on meaning has a default threshold of its own.

    ``by_name`` tells naming groups and abbreviations per pair of names, with counts, instead of per column and pair of columns;
    ``dense`` brings the vectors of a model for the checks on meaning.
    """
    given = {} if threshold is None else {"threshold": threshold}
    if isinstance(check_type, list):
        check_type = check_type[0] if check_type else "data_types"
    if check_type == "data_types":
        return consistency.type_variations(catalog)
    if check_type == "naming_patterns":
        return consistency.naming_patterns(catalog)
    if check_type == "semantic_naming":
        groups = naming.naming_groups if by_name else meaning.naming_inconsistencies
        return groups(catalog, **given, dense=dense)
    if check_type == "concept_consistency":
        return meaning.concept_types(catalog, **given, dense=dense)
    if check_type == "abbreviation_detection":
        found = naming.abbreviation_names if by_name else meaning.abbreviations
        return found(catalog, **given, dense=dense)
    raise ValueError(f"unknown check type: {check_type}")


def compare_items(catalog: DataFrame, item1: str, item2: str, comparison_type: str = "schemas") -> DataFrame:
    if comparison_type != "schemas":
        raise ValueError(f"unsupported comparison type: {comparison_type}")
    return relationships.compare_schemas(catalog, item1, item2)


def run_analysis(catalog: DataFrame, description: str) -> DataFrame:
    """The analysis a description asks for by its key words."""
    asked = description.lower()
    if "similar" in asked and ("schema" in asked or "column" in asked):
        return relationships.schema_groups(catalog, relationships.legacy_threshold(3))
    if "most columns" in asked or "largest" in asked:
        return stats.largest_files(catalog, LARGEST_FILES)
    if "type mismatch" in asked or "inconsistent" in asked:
        return consistency.type_variations(catalog)
    raise ValueError(
        f"no analysis for {description!r}; see search_metadata, get_schemas, find_relationships, "
        "detect_inconsistencies, compare_items"
    )
