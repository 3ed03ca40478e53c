import itertools
import random

import pytest
from pyspark.sql import functions as F

import colscope.operators.joins as joins
from colscope.operators import consistency, greedy, relationships, similar_sets


def test_greedy_leaders_equal_the_sequential_walk(spark):
    rng = random.Random(7)
    graphs = []
    for g in range(60):
        n = rng.randint(2, 9)
        graphs.append({(g * 100 + i, g * 100 + j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4})
    edges = sorted(set().union(*graphs))
    expected = set()
    for item in sorted({x for e in edges for x in e}):
        if item not in expected:
            expected |= {j for i, j in edges if i == item}
    found = greedy.claimed_items(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.id for r in found.collect()} == expected


def test_greedy_follows_chains_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(greedy, "ROUNDS_PER_CUT", 4)
    chain = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.id for r in greedy.claimed_items(chain).collect()} == set(range(1, 41, 2))


def test_every_long_posting_list_is_split(spark, monkeypatch):
    """More hot keys than any bound of old: the split join equals the plain one."""
    monkeypatch.setattr(joins, "BLOCK_POSTINGS", 3)
    rows = spark.range(6_000).select((F.col("id") % 1_200).alias("k"), F.col("id").alias("x"))
    other = rows.withColumnRenamed("x", "y")
    found = joins.posting_pairs(rows, other, "k", F.col("x") < F.col("y"))
    assert found.count() == found.distinct().count() == 1_200 * 10


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 1.0])
def test_similar_sets_equal_brute_force(spark, threshold, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_POSTINGS", 8)
    rng = random.Random(int(threshold * 100))
    sets = {}
    for i in range(90):
        base = rng.choice([range(0, 12), range(6, 20), range(30)])
        sets[i] = {rng.choice(base) for _ in range(rng.randint(0, 10))} | ({99} if i % 3 == 0 else set())
    sets[90], sets[91] = set(sets[3]), set(sets[3])
    frame = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, s array<string>")
    distinct = similar_sets.distinct_sets(frame, "id", "s")
    rep = {r.id: r.rep for r in distinct.of_members(distinct.sets.select("set_key", "rep")).collect()}
    assert rep == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets if sets[i]}
    found = {
        (r.rep1, r.rep2): (r.shared, r.united) for r in similar_sets.similar_pairs(distinct, threshold).collect()
    }
    expected = {}
    for a, b in itertools.combinations(sorted(set(rep.values())), 2):
        shared, united = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if shared / united >= threshold:
            expected[(a, b)] = (shared, united)
    assert found == expected

    leader = {}
    for a in sorted(set(rep.values())):
        if a not in leader:
            leader[a] = a
            for b in sorted(set(rep.values())):
                if b > a and b not in leader and (a, b) in expected:
                    leader[b] = a
    groups = {r.id: r.leader for r in relationships.group_sets(distinct, threshold).collect()}
    assert groups == {i: leader[rep[i]] for i in rep}


def test_few_pairs_of_sets_leave_their_buckets(spark, monkeypatch):
    """Sets that share some rare elements but little else are no candidates, and crowded buckets lose no pair."""
    monkeypatch.setattr(similar_sets, "CELL", 20)
    monkeypatch.setattr(similar_sets, "TOGETHER", 10)
    rng = random.Random(4)
    sets = {i: {rng.randrange(400) for _ in range(60)} for i in range(300)}
    for i in range(300, 360):  # near copies
        sets[i] = set(sorted(sets[i % 7])[: rng.randrange(44, 60)])
    frame = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, s array<string>")
    distinct = similar_sets.distinct_sets(frame, "id", "s")
    expected = {}
    reps = sorted(r.rep for r in distinct.sets.select("rep").collect())
    for a, b in itertools.combinations(reps, 2):
        shared, united = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if shared / united >= 0.7:
            expected[(a, b)] = (shared, united)
    found = similar_sets.similar_pairs(distinct, 0.7)
    assert {(r.rep1, r.rep2): (r.shared, r.united) for r in found.collect()} == expected
    whole = distinct.sets.select(F.col("set_key.a").alias("id"), "codes", F.lit(True).alias("wanted"))
    assert len(expected) <= similar_sets._candidates(whole, 0.7).count() <= 2 * len(expected)


def test_thresholds_outside_the_range(spark):
    empty = spark.createDataFrame([], "id long, s array<string>")
    with pytest.raises(ValueError):
        similar_sets.similar_pairs(similar_sets.distinct_sets(empty, "id", "s"), 0)
    assert relationships.legacy_threshold(3) == 0.3 and relationships.legacy_threshold(11) == 0.3


def test_pairs_that_share_many_elements_meet_once(spark):
    """Near copies share nearly all of their prefix; a pair leaves the bucket of the first element it shares, and no other."""
    rows = [(i, [f"w{j}" for j in range(100)] + [f"own{i}"]) for i in range(400)]
    distinct = similar_sets.distinct_sets(spark.createDataFrame(rows, "id bigint, s array<string>"), "id", "s")
    sets = distinct.sets.select(F.col("set_key.a").alias("id"), "codes", F.lit(True).alias("wanted"))
    postings = similar_sets._postings(sets, 0.7, similar_sets._occurrences(sets))
    assert similar_sets._meetings(postings, 0.7, None).count() == 400 * 399 // 2
    found = similar_sets.similar_pairs(distinct, 0.7).collect()
    assert {(r.rep1, r.rep2, r.shared, r.united) for r in found} == {(a, b, 100, 102) for b in range(400) for a in range(b)}


def test_schema_groups_collapse_copies(make_catalog):
    columns = {"id": "integer", "a": "string", "b": "string"}
    files = {f"copy{i}": columns for i in range(5)} | {"near": {"id": "integer", "a": "float"}, "far": {"q": "string"}}
    found = relationships.schema_groups(make_catalog(files), 0.5).collect()
    assert [(r.leader_file, r.file_count, r.common_columns, r.similarity_score) for r in found] == [
        ("copy0", 6, "a, id", 0.67)
    ]
    pairs = relationships.schema_jaccard_pairs(make_catalog(files), 0.5).collect()
    assert [(p.file1, p.file2, p.copies1, p.copies2) for p in pairs] == [("copy0", "near", 5, 1)]
    everything = relationships.schema_groups(make_catalog(files), 0).collect()
    assert [(r.file_count, r.common_column_count) for r in everything] == [(7, 0)]


def test_schema_differences_add_up(make_catalog, tenants):
    found = relationships.schema_differences(make_catalog(tenants)).collect()
    sharing = {p for p in itertools.combinations(sorted(tenants), 2) if tenants[p[0]].keys() & tenants[p[1]].keys()}
    assert len(found) == len(sharing) and {(r.file1, r.file2) for r in found} == sharing
    for r in found:
        one, two = tenants[r.file1], tenants[r.file2]
        assert r.file1 < r.file2
        assert r.common_columns_count == len(one.keys() & two.keys())
        assert r.unique_to_file1_count == len(one.keys() - two.keys())
        assert r.type_mismatches_count == sum(one[c] != two[c] for c in one.keys() & two.keys())
        united = len(one.keys() | two.keys())
        assert r.similarity == pytest.approx((r.common_columns_count - r.type_mismatches_count) / united)


def test_members_lead_back_to_every_file(make_catalog):
    files = {"x/a": {"c": "string"}, "y/a": {"c": "string"}, "z": {"c": "integer"}}
    found = {r.file_path: r.first_path for r in relationships.shape_members(make_catalog(files)).collect()}
    assert found == {"x/a": "x/a", "y/a": "x/a", "z": "z"}


def reason(a, b):
    a, b = a.lower(), b.lower()
    if a.replace("_", "") == b.replace("_", ""):
        return "underscore_variation"
    if a.startswith(b[:4]) or b.startswith(a[:4]):
        return "similar_prefix"
    if a.endswith(b[-4:]) or b.endswith(a[-4:]):
        return "similar_suffix"
    return None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_naming_patterns_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_POSTINGS", 5)
    rng = random.Random(seed)
    names = {"".join(rng.choice("abA_") for _ in range(rng.randint(1, 7))) for _ in range(80)} | {"id", "ip", "a", "id_", "user_id"}
    frame = spark.createDataFrame([(n,) for n in names], "column_name string")
    found = [tuple(r) for r in consistency.naming_patterns(frame).collect()]
    expected = [
        (a, b, reason(a, b)) for a, b in itertools.combinations(sorted(names), 2) if reason(a, b) is not None
    ]
    assert found == expected
