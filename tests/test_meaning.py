import itertools
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colscope.functions import names as N
from colscope.plans import tools
from colscope.operators import semantic, similarity
from tests.conftest import flat


def enriched(name):
    spaced = name.replace("_", " ")
    return spaced + "".join(p for words, p in N.ENRICHMENTS if any(w in spaced.lower() for w in words))


def vector(text):
    text = re.sub("([a-z0-9])([A-Z])", r"\1 \2", text).replace("_", " ").lower()
    grams = Counter(f"  {w} "[i:i + 3] for w in text.split() for i in range(len(w) + 1))
    length = math.sqrt(sum(n * n for n in grams.values()))
    return {g: n / length for g, n in grams.items()}


def sim(query, target, enrich=False):
    one, two = vector(query), vector(enriched(target) if enrich else target)
    return round(sum(w * two.get(g, 0) for g, w in one.items()), 6)


@pytest.mark.parametrize("threshold,enrich", [(0.3, similarity.NONE), (0.6, similarity.TARGET), (0.8, similarity.NONE)])
def test_name_pairs_equal_brute_force(make_catalog, tenants, threshold, enrich):
    names = {c for f in tenants.values() for c in f}
    found = {
        (r.name1, r.name2): r.similarity
        for r in similarity.name_pairs(make_catalog(tenants), "column_name", threshold, enrich).collect()
    }
    expected = {
        (a, b): s
        for a, b in itertools.product(names, names)
        if (s := sim(a, b, enrich == similarity.TARGET)) >= threshold
    }
    assert found.keys() == expected.keys()
    assert all(found[p] == pytest.approx(expected[p], abs=2e-6) for p in found)


def test_enrichment(spark):
    rows = spark.createDataFrame([("customer_id",), ("Width",), ("updated_title",)], "n string")
    assert [r.e for r in rows.select(N.enrich(F.col("n")).alias("e")).collect()] == [
        enriched("customer_id"), enriched("Width"), enriched("updated_title")
    ]


def test_styles(spark):
    rows = spark.createDataFrame([("a_b",), ("aB",), ("ab",), ("A_b",), ("12",)], "n string")
    assert [r.s for r in rows.select(N.styles(F.col("n")).alias("s")).collect()] == [
        ["underscore"], ["camelcase"], ["lowercase"], ["underscore", "camelcase"], []
    ]


def suggest(names):
    if all("id" in n.lower() for n in names):
        for word in ("customer", "user", "order"):
            if any(word in n.lower() for n in names):
                return f"{word}_id"
    return min(names, key=len)


def inconsistent(names):
    styles = set()
    for n in names:
        styles |= {"u"} if "_" in n else set()
        styles |= {"c"} if any(x.isupper() for x in n) else set()
        styles |= {"l"} if n.islower() and "_" not in n else set()
    return len(styles) > 1 or len(set(names)) == len(names)


@pytest.mark.parametrize("threshold", [0.4, 0.6])
@pytest.mark.parametrize("enrich", [similarity.NONE, similarity.TARGET])
def test_naming_inconsistencies_equal_the_sequential_walk(make_catalog, tenants, threshold, enrich):
    columns = flat(tenants)
    taken, expected = set(), {}
    for i, (file, name) in enumerate(columns):
        if (file, name) in taken:
            continue
        like = [(f, c, sim(name, c, enrich == similarity.TARGET)) for f, c in columns[i + 1:]]
        like = sorted([m for m in like if m[2] >= threshold], key=lambda m: -m[2])
        if like:
            taken |= {(f, c) for f, c, _ in like} | {(file, name)}
            names = [name] + [c for _, c, _ in like]
            if inconsistent(names):
                average = sum(s for *_, s in like) / len(like)
                expected[(file, name)] = (len(names), suggest(names), pytest.approx(average, abs=1e-5))
    found = {
        (r.file_name, r.column_name): (r.members, r.suggestion, r.avg_similarity)
        for r in semantic.naming_inconsistencies(make_catalog(tenants), threshold, enrich).collect()
    }
    assert found == expected and found


@pytest.mark.parametrize("threshold", [0.4, 0.6])
def test_abbreviations_equal_the_sequential_walk(make_catalog, tenants, threshold):
    columns = flat(tenants)
    taken, expected = set(), []
    for file, name in columns:
        if (file, name) in taken:
            continue
        for f, c in columns:
            if (f, c) != (file, name) and sim(name, c) >= threshold and abs(len(name) - len(c)) >= 3:
                pair = sorted([(len(name), name, file), (len(c), c, f)])
                expected.append((pair[0][1], pair[1][1], pair[0][2], pair[1][2]))
                taken |= {(file, name), (f, c)}
    found = semantic.abbreviations(make_catalog(tenants), threshold, similarity.NONE)
    assert sorted((r.short, r.long, r.short_file, r.long_file) for r in found.collect()) == sorted(expected)


def best_concept(name, threshold):
    best, found = 0.0, "other"
    for concept, phrases in N.CONCEPT_TEMPLATES.items():
        score = max([s for p in phrases if (s := sim(p, name, True)) >= 0.1], default=0.0)
        if score > best and score >= threshold:
            best, found = score, concept
    return found


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.6])
def test_classification(make_catalog, tenants, threshold):
    found = semantic.classify_names(make_catalog(tenants), "column_name", threshold).collect()
    assert {r.column_name: r.concept for r in found} == {
        c: best_concept(c, threshold) for f in tenants.values() for c in f
    }


@pytest.mark.parametrize("threshold", [0.2, 0.35])
@pytest.mark.parametrize("enrich", [similarity.NONE, similarity.TARGET])
def test_schema_scores_equal_brute_force(make_catalog, tenants, threshold, enrich):
    files = tenants | {"zz_copy.csv": tenants["eu_orders.csv"]}
    expected = {}
    for a, b in itertools.combinations(sorted(files), 2):
        best = [max(sim(x, y, enrich == similarity.TARGET) for y in files[b]) for x in files[a]]
        score = sum(s for s in best if s >= threshold) / len(best)
        if round(score, 6) > threshold:
            expected[(a, b)] = pytest.approx(score, abs=1e-5)
    rows = make_catalog(files)
    per_file = semantic.semantic_schema_pairs(rows, threshold, enrich, per_file=True).collect()
    assert {(r.file1, r.file2): r.similarity for r in per_file} == expected
    per_shape = semantic.semantic_schema_pairs(rows, threshold, enrich).collect()
    shape = {f: min(g for g in files if set(files[g]) == set(files[f])) for f in files}
    found = {(shape[r.file1], shape[r.file2]): r for r in per_shape}
    assert len(found) == len(per_shape)
    assert found.keys() == {(shape[a], shape[b]) for a, b in expected}
    for (one, two), r in found.items():
        assert (r.file1, r.file2) in expected and r.similarity == expected[(r.file1, r.file2)]
        assert (r.copies1, r.copies2) == (2 if one == "eu_orders.csv" else 1, 2 if two == "eu_orders.csv" else 1)


def test_schema_scores_in_both_orders(make_catalog):
    """Scores are one-way: equal schemas on either side of another one need both."""
    rows = make_catalog({"f1": {"price": "float", "zzz": "float"}, "f2": {"price": "float"}, "f3": {"price": "float", "zzz": "float"}})
    found = semantic.semantic_schema_pairs(rows, 0.6, similarity.NONE).collect()
    assert {(r.file1, r.file2, r.similarity) for r in found} == {("f1", "f3", 1.0), ("f2", "f3", 1.0)}
    matches = semantic.matching_concepts(rows, 0.6, similarity.NONE).collect()
    assert {(r.file1, r.file2, r.column1) for r in matches} == {("f1", "f3", "price"), ("f1", "f3", "zzz"), ("f2", "f3", "price")}
    differences = semantic.semantic_differences(rows, 0.6, similarity.NONE).collect()
    assert {(r.file1, r.file2, r.copies1, r.copies2) for r in differences} == {("f1", "f2", 2, 1), ("f2", "f3", 1, 2)}


def test_tools_take_a_threshold_of_zero(make_catalog):
    rows = make_catalog({"a": {"x": "float"}, "b": {"y": "float"}})
    assert [r.file_count for r in tools.find_relationships(rows, "similar_schemas", 0).collect()] == [2]
    assert tools.find_relationships(rows, "similar_schemas", semantic=True).count() == 0
    assert tools.detect_inconsistencies(rows, "concept_consistency", 0.9).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5])
def test_semantic_differences_match_one_to_one(make_catalog, tenants, threshold):
    found = semantic.semantic_differences(make_catalog(tenants), threshold, similarity.NONE).collect()
    rows = {(r.file1, r.file2): r for r in found}
    assert len(rows) == len(found)
    for pair in itertools.combinations(sorted(tenants), 2):
        one, two = set(tenants[pair[0]]), set(tenants[pair[1]])
        free, pairs = two - one, []
        for c in sorted(one - two):
            like = sorted((-s, d) for d in free if (s := sim(c, d)) >= threshold)
            if like:
                pairs.append((c, like[0][1]))
                free.discard(like[0][1])
        assert (pair in rows) == bool(one & two or pairs)
        if pair not in rows:
            continue
        r = rows[pair]
        shown = [tuple(p.rsplit(" ", 1)[0].split(" <-> ")) for p in r.semantic_equivalents.split(", ") if p]
        assert shown == pairs
        assert r.similarity == pytest.approx((len(one & two) + len(pairs)) / len(one | two))
        assert r.missing_in_file1 == ", ".join(sorted(free))


def test_search_examples(make_catalog):
    rows = make_catalog({"f": {c: "string" for c in ("price", "unit_price", "unitPrice", "invoice_id", "created_on", "updated_on")}})
    assert {r.column_name for r in similarity.similar_columns(rows, "price").collect()} == {"price", "unit_price", "unitPrice"}
    assert {r.column_name for r in similarity.similar_columns(rows, "timestamp").collect()} == {"created_on", "updated_on"}
    with pytest.raises(ValueError):
        similarity.similar_columns(rows, "price", 0)


def test_long_query_lists_give_the_same_result(spark, monkeypatch):
    vectors = spark.range(40).select(
        "id", F.array(F.cos("id").cast("float"), F.sin("id").cast("float")).alias("v")
    )
    queries = vectors.select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    items = vectors.select(F.col("id").alias("item_id"), F.col("v").alias("item_vector"))
    short = sorted(similarity.similar_vectors(queries, items, 0.5).collect())
    monkeypatch.setattr(similarity, "QUERY_ROWS", 7)
    monkeypatch.setattr(similarity, "ITEM_ROWS", 9)
    assert sorted(similarity.similar_vectors(queries, items, 0.5).collect()) == short and short


def load_letter_counts():
    return lambda texts: [[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def test_dense_search_by_a_model_of_the_caller(make_catalog, tenants):
    def unit(text):
        counts = load_letter_counts()([text])[0]
        length = math.sqrt(sum(n * n for n in counts))
        return [n / length for n in counts]

    expected = {
        c: round(s, 6)
        for f in tenants.values()
        for c in f
        if (s := sum(a * b for a, b in zip(unit("customer"), unit(enriched(c))))) >= 0.7
    }
    found = similarity.similar_columns_dense(make_catalog(tenants), "customer", load_letter_counts, 0.7).collect()
    assert {r.column_name: pytest.approx(r.similarity, abs=2e-6) for r in found} == expected and expected
    assert [r.similarity for r in found] == sorted((r.similarity for r in found), reverse=True)


def test_grams_of_many_names_are_made_in_parts(spark, monkeypatch):
    names = spark.createDataFrame([(f"customer number{i}",) for i in range(200)] + [(None,), ("",)], "word string")
    terms = spark.createDataFrame([("customer",)], "term string")
    whole = similarity.term_matches(names, "word", terms, 0.3, similarity.NONE, fixed=True).collect()
    monkeypatch.setattr(similarity, "NAMES_TOGETHER", 20)
    parted = similarity.term_matches(names, "word", terms, 0.3, similarity.NONE, fixed=True)
    assert parted.rdd.getNumPartitions() >= 10
    assert sorted(parted.collect()) == sorted(whole) and len(whole) == 200
