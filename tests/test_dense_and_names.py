"""Joins by a model's vectors, groups per pair of names, nearest schemas: against brute force, and how they grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.operators import dense, naming, nearest, relationships, semantic, similarity
from colscope.operators.shapes import shapes_of
from colscope.plans import tools


def _clustered(n, clusters, width, seed, spread=0.25):
    random = np.random.default_rng(seed)
    centres = random.standard_normal((clusters, width))
    x = centres[random.integers(clusters, size=n)] + spread * random.standard_normal((n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _frame(spark, x, name="name"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], f"{name} bigint, vector array<double>")


def _brute(x, y, threshold):
    dots = np.round(x @ y.T, dense.DIGITS)
    return {(int(i), int(j)): dots[i, j] for i, j in zip(*np.nonzero(dots >= threshold), strict=True)}


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.97, 1.0])
def test_dense_pairs(spark, threshold, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 70)
    monkeypatch.setattr(dense, "COLUMNS", 7)
    x, y = _clustered(400, 12, 24, 1), _clustered(300, 12, 24, 1)
    y[:20] = x[:20]
    y[100:200] = y[100]  # a hot direction
    found = dense.dense_pairs(_frame(spark, x), _frame(spark, y), "name", threshold).collect()
    assert len(found) == len({(r.name1, r.name2) for r in found})
    assert {(r.name1, r.name2): r.similarity for r in found} == pytest.approx(_brute(x, y, threshold))


def test_dense_pairs_of_few_and_odd_vectors(spark):
    one = spark.createDataFrame([("a", [1.0, 0.0])], "name string, vector array<double>")
    nothing = one.limit(0)
    assert [tuple(r) for r in dense.dense_pairs(one, one, "name", 0.5).collect()] == [("a", "a", 1.0)]
    assert dense.dense_pairs(one, nothing, "name", 0.5).collect() == dense.dense_pairs(nothing, one, "name", 0.5).collect() == []
    with pytest.raises(ValueError, match="length"):
        dense.dense_pairs(one, spark.createDataFrame([("b", [1.0])], one.schema), "name", 0.5)
    with pytest.raises(ValueError, match="positive"):
        dense.dense_pairs(one, one, "name", 0.0)
    odd = spark.createDataFrame(
        [("a", [3.0, 4.0]), ("a", [3.0, 4.0]), ("null", None), ("zero", [0.0, 0.0]), ("nan", [float("nan"), 1.0]),
         ("inf", [float("inf"), 1.0]), ("hole", [None, 1.0])], "name string, vector array<float>")
    assert [(r.name, r.vector) for r in dense.unit_vectors(odd, "name", "vector").collect()] == [("a", [0.6, 0.8])]


def test_compared_pairs_at_three_scales(spark):
    """On grouped vectors the pairs compared beyond the first columns grow like the result, not like all pairs."""
    share = []
    for n in (500, 1_000, 2_000):
        x = _clustered(n, n // 25, 48, 7, 0.1)
        frame = _frame(spark, x)
        rows = dense.dense_pairs(frame, frame, "name", 0.9, counted=True)
        compared = rows.filter("name1 IS NULL").agg(F.sum("similarity")).first()[0]
        found = rows.filter("name1 IS NOT NULL").count()
        assert found == len(_brute(x, x, 0.9))
        share.append(compared / n**2)
        assert compared <= 0.35 * n**2
    assert share[2] < share[0]


@pytest.mark.parametrize("left", [0.0, 2.0])
def test_vectors_without_groups_travel_once_per_block(spark, monkeypatch, left):
    """All groups are met; no vector is stored once per group, whichever way blocks are compared."""
    monkeypatch.setattr(dense, "BLOCK", 150)
    monkeypatch.setattr(dense, "TILE", 64)
    monkeypatch.setattr(dense, "LEFT", left)
    stored = []

    def counted(df):
        stored.append(df.count())
        return df

    monkeypatch.setattr(dense, "cut_lineage", counted)
    random = np.random.default_rng(3)
    x = random.standard_normal((500, 24))
    x[40:60] = x[40]
    x[60] = -x[40]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = _frame(spark, x)
    for threshold in (0.3, 1.0):
        found = dense.dense_pairs(frame, _frame(spark, x[:333]), "name", threshold).collect()
        assert len(found) == len({(r.name1, r.name2) for r in found})
        assert {(r.name1, r.name2): r.similarity for r in found} == pytest.approx(_brute(x, x[:333], threshold))
        if threshold == 0.3:
            assert max(stored) <= 500


def test_single_precision_loses_no_pair():
    """Pairs just at the threshold are among the candidates, in any number of columns."""
    random = np.random.default_rng(4)
    for width in (3, 64, 1_000):
        x = random.standard_normal((300, width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        dots = x @ x.T
        for threshold in np.sort(dots.ravel())[-3_000::500].tolist():
            candidates = set(zip(*(c.tolist() for c in dense.whole_above(x, x, threshold)), strict=True))
            assert {(int(i), int(j)) for i, j in zip(*np.nonzero(dots >= threshold), strict=True)} <= candidates


def _meaning(spark, names, groups):
    """Names of one group point the same way, others elsewhere."""
    axes = np.eye(len(groups) + len(names))
    where = {n: axes[i] for i, g in enumerate(groups) for n in g}
    rows = [(n, where.get(n, axes[len(groups) + i]).tolist()) for i, n in enumerate(names)]
    return dense.DenseVectors(spark.createDataFrame(rows, "text string, vector array<double>"))


def test_operators_take_a_models_vectors(spark, make_catalog):
    catalog = make_catalog(
        {"a.csv": {"cust": "string", "client_key": "integer", "amount": "float"}, "b.csv": {"customer_identifier": "integer", "total": "float"},
         "c.csv": {"other": "string"}}
    )
    groups = [("cust", "client_key", "customer_identifier", "customer id"), ("amount", "total")]
    names = ["cust", "client_key", "amount", "customer_identifier", "total", "other"]
    phrases = [t for terms in semantic.N.CONCEPT_TEMPLATES.values() for t in terms] + [t for terms in semantic.N.CONCEPT_TERMS.values() for t in terms]
    meaning = _meaning(spark, [*names, *dict.fromkeys(phrases)], groups)
    scores = {(r.file1, r.file2): r.similarity for r in semantic.semantic_schema_pairs(catalog, dense=meaning).collect()}
    assert scores == {("a.csv", "b.csv"): 1.0}
    pairs = {(r.file1, r.file2): r.semantic_equivalents for r in semantic.semantic_differences(catalog, dense=meaning).collect()}
    assert pairs == {("a.csv", "b.csv"): "amount <-> total 1.000, client_key <-> customer_identifier 1.000"}
    short = {(r.short, r.long) for r in naming.abbreviation_names(catalog, dense=meaning).collect()}
    assert short == {(r.short, r.long) for r in semantic.abbreviations(catalog, dense=meaning).collect()}
    assert ("cust", "customer_identifier") in short or ("cust", "client_key") in short
    by_tool = tools.detect_inconsistencies(catalog, "abbreviation_detection", by_name=True, dense=meaning)
    assert {(r.short, r.long) for r in by_tool.collect()} == short
    groups_found = {r.leader: r.members for r in naming.naming_groups(catalog, dense=meaning).collect()}
    assert groups_found["amount"] == 2 and max(groups_found.values()) == 3
    known = dict(semantic.classify_names(catalog, "column_name", dense=meaning).collect())
    assert set(known) == set(names)
    reached = {c for c, terms in semantic.N.CONCEPT_TERMS.items() if any(t in names or any(t in g for g in groups) for t in terms)}
    assert {r.concept for r in semantic.concept_groups(catalog, dense=meaning).collect()} == reached and reached
    assert tools.find_relationships(catalog, "similar_schemas", semantic=True, dense=meaning).count() == 1


def _lake(make_catalog, files, more=lambda i: {}):
    return make_catalog({f"f{i:03d}.csv": {"customer": "string", "customer_name": "string", **more(i)} for i in range(files)})


def test_names_grow_with_the_names_and_columns_with_the_files(spark, make_catalog):
    for files in (10, 30):
        catalog = _lake(make_catalog, files)
        for enrich in (similarity.NONE, similarity.TARGET):
            for threshold in (0.4,):
                names = naming.abbreviation_names(catalog, threshold, enrich).collect()
                assert sum(r.pairs for r in names) == semantic.abbreviations(catalog, threshold, enrich).count() and len(names) <= 2
                assert naming.abbreviation_columns(catalog, threshold, enrich).count() <= 4 * files
                groups = naming.naming_group_names(catalog, threshold, enrich).collect()
                members = semantic.naming_inconsistency_members(catalog, threshold, enrich).filter("similarity IS NOT NULL")
                assert sum(r.pairs for r in groups) == members.count() and len(groups) <= 4
                assert naming.naming_groups(catalog, threshold, enrich).count() <= 2


@pytest.mark.parametrize("bits", [16, 1])
def test_group_names_against_all_pairs(spark, make_catalog, tenants, bits, monkeypatch):
    """Counts by ranks are those of the expanded groups, also when the order is cut into many slices."""
    monkeypatch.setattr(naming, "SLICE_BITS", bits)
    files = {f"{i}_{name}": columns for i in range(3) for name, columns in tenants.items()}
    catalog = make_catalog(files)
    for enrich in (similarity.NONE, similarity.TARGET):
        pairs = semantic.naming_inconsistency_members(catalog, 0.5, enrich).filter("similarity IS NOT NULL")
        grouped = pairs.groupBy(F.col("leader.column_name").alias("l"), F.col("member.column_name").alias("m")).agg(
            F.count(F.lit(1)).alias("pairs"), F.count_distinct("member").alias("members"), F.min("leader").alias("first"), F.min("member").alias("begin")
        )
        expected = {(r.l, r.m): (r.pairs, r.members, tuple(r.first), tuple(r.begin)) for r in grouped.collect()}
        found = naming.group_names(catalog, 0.5, enrich).collect()
        assert {(r.leader, r.member): (r.pairs, r.members, tuple(r.first_leader), tuple(r.first_member)) for r in found} == expected
        assert expected
    assert naming.group_names(catalog.limit(0), 0.5).count() == 0


def _typed_jaccard(a, b):
    x, y = set(a.items()), set(b.items())
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_schemas(spark, make_catalog, k):
    random = np.random.default_rng(k)
    files = {}
    for i in range(60):
        columns = {"id": "integer"} | {f"c{c}": "string" if random.random() < 0.9 else "float" for c in random.integers(0, 25, size=random.integers(1, 12))}
        files[f"f{i:02d}.csv"] = columns
    files["copy.csv"] = files["f00.csv"]
    found = nearest.nearest_schemas(make_catalog(files), k, 0.2).collect()
    shapes: dict = {}
    for name in sorted(files):
        shapes.setdefault(frozenset(files[name].items()), name)
    reps = sorted(shapes.values())
    expected = set()
    for a in reps:
        near = sorted((-_typed_jaccard(files[a], files[b]), b) for b in reps if a != b)
        expected |= {(a, b, i + 1, round(-s, 9)) for i, (s, b) in enumerate(near[:k]) if -s >= 0.2 - 1e-12}
    assert {(r.file_name, r.near_file, r.rank, round(r.jaccard, 9)) for r in found} == expected
    copies = {r.near_file: r.copies for r in found}
    assert all(n == (2 if b == "copy.csv" else 1) for b, n in copies.items())
    with pytest.raises(ValueError, match="positive"):
        nearest.nearest_schemas(make_catalog(files), 0)


def test_differences_stay_linear_where_every_schema_holds_one_name(spark, make_catalog):
    for files in (10, 30):
        catalog = _lake(make_catalog, files, lambda i: {"id": "integer", f"own{i}": "string", f"pair{i // 2}": "string"})
        rows = nearest.nearest_differences(catalog, 1, 0.3).collect()
        assert 0 < len(rows) <= files
        whole = {(r.file1, r.file2): r for r in relationships.schema_differences(catalog).collect()}
        assert len(whole) == files * (files - 1) // 2
        assert all(whole[r.file1, r.file2] == r for r in rows)
        assert tools.find_relationships(catalog, "schema_differences", near=1).count() == len(rows)
        few = semantic.semantic_differences(catalog, near=lambda found: nearest.near_pairs(found, 1, 0.3))
        assert few.count() <= files


def test_differences_of_given_pairs(spark, make_catalog):
    catalog = make_catalog({"a": {"x": "string"}, "b": {"x": "float", "y": "string"}, "c": {"z": "string"}, "d": {"x": "string"}})
    asked = spark.createDataFrame([("a", "b"), ("c", "a"), ("d", "a"), ("a", "b"), ("a", "unknown"), (None, "a")], "path1 string, path2 string")
    found = {(r.file1, r.file2): (r.similarity, r.common_columns_count, r.type_mismatches) for r in nearest.differences_between(catalog, asked).collect()}
    assert found == {("a", "b"): (0.0, 1, "x: string vs float"), ("c", "a"): (0.0, 0, ""), ("d", "a"): (1.0, 1, "")}
    assert nearest.near_pairs(shapes_of(catalog.limit(0))).count() == 0
