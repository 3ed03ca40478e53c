"""Operators 1, 5 and 8: held-out quality, brute force where it exists."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.llm import ann, class_ngrams, quality, queries
from colscope.llm.common import remainder
from tests.llm.conftest import FOLDER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = object()


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def test_class_ngrams(docs, texts, nothing):
    words = [(d, [*WORD.findall((t or "").translate(FOLD)), END]) for d, t in texts]
    counts = Counter(w for d, ws in words if not held(d) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    expected = Counter()
    for d, ws in words:
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        expected[(d, held(d), len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 4))] += 1
    found = class_ngrams.scores(docs, remainder("doc_id", 10) == 0, classes=16, rounds=4).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == expected
    given = [r for r in found if (r.doc_id or 9000) < 9000]
    assert sum(r.score for r in given if r.held_out) > sum(r.base_score for r in given if r.held_out)
    assert class_ngrams.scores(nothing, F.lit(False)).count() == 0


def test_class_ngrams_without_training(docs):
    found = class_ngrams.scores(docs, F.lit(True), classes=4, rounds=1).collect()
    assert len(found) == docs.count() and all(r.n_known == 0 and r.score < 0 for r in found)


def test_exchange_prefers_the_greater_likelihood():
    random = np.random.default_rng(1)
    table = random.integers(1, 50, (5, 5)).astype(float)
    left, right = random.integers(0, 2, (1, 5)).astype(float), random.integers(0, 2, (1, 5)).astype(float)
    left[0, 2] = right[0, 2] = 1  # the word follows itself once
    table[:, 2] += left[0]
    table[2, :] += right[0]
    table[2, 2] -= 1

    def likelihood(t):
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    def moved(to):
        t = table.copy()
        before, after = left[0].copy(), right[0].copy()
        before[2] -= 1
        after[2] -= 1
        t[:, 2] -= before
        t[2, :] -= after
        t[2, 2] -= 1
        t[:, to] += before
        t[to, :] += after
        t[to, to] += 1
        return likelihood(t)

    best = class_ngrams._best_moves(np.array([0]), left, right, np.array([1.0]), np.array([2]), table, 3)[0]
    assert best == int(np.argmax([moved(c) for c in range(3)]))


@pytest.fixture(scope="module")
def vectors(spark):
    random = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in random.standard_normal(24)]) for i in range(1500)]
    rows += [(5000 + i, [0.5] * 24) for i in range(900)]  # a hot vector
    rows += [(7000, None), (7001, [0.0] * 24), (7002, [float("nan")] * 24), (7003, [float("inf")] + [1.0] * 23),
             (7004, [1.0] * 3), (7005, [None] + [1.0] * 23), (7006, []), (None, [1.0] * 24), (20, [2.0] * 24)]
    again = next(r for r in rows if r[0] == 40)
    rows += [again] * 30  # one row many times over, as a query and as a candidate
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit("x"))


def test_nearest(vectors):
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in vectors.collect()
            if r.vec_id is not None and not 7000 <= r.vec_id < 8000]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    found = ann.nearest(vectors, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    by_query: dict = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    assert by_query.keys() == {int(i) for i in ids if i % 20 == 0}
    x, at = np.unique(np.column_stack([ids, x]), axis=0, return_index=True)  # equal rows are one
    ids, x = ids[at], x[:, 1:]
    hits = total = 0
    for q, got in by_query.items():
        own = np.flatnonzero(ids == q)
        assert Counter(r.rank for r in got) == Counter(list(range(1, 21)) * len(own))
        asked = Counter()
        for i in own:
            scores = x @ x[i]
            order = [j for j in np.lexsort((ids, -np.round(scores, 9))) if ids[j] != q][:20]
            asked.update((int(ids[j]), round(float(scores[j]), 6)) for j in order)
        answered = Counter((r.vec_id, round(r.score, 6)) for r in got)
        assert all(any(math.isclose(r.score, float(x[j] @ x[i]), rel_tol=1e-9, abs_tol=1e-9) for i in own for j in np.flatnonzero(ids == r.vec_id)) for r in got)
        if len(own) == 1:
            assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
            assert len(answered) == 20
        hits += (asked & answered).total()
        total += 20 * len(own)
    assert hits / total >= 0.9


def test_recall_where_lengths_differ_much(spark):
    random = np.random.default_rng(3)
    x = random.standard_normal((6000, 32)) * (random.pareto(1.0, 6000) + 0.1)[:, None]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {}
    for r in ann.nearest(vectors, F.col("id") % 100 == 0, 20, sample=1000).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, 6000, 100):
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += len(found[i] & set(np.argsort(-scores)[:20].tolist()))
    assert hits / (20 * 60) >= 0.98


def test_nearest_with_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (40, [3.0, 3.0])], "vec_id bigint, embedding array<double>")
    found = ann.nearest(one, F.col("id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [(0, 1, 40, 9.0), (0, 2, 1, 4.0), (40, 1, 0, 9.0), (40, 2, 1, 9.0)]
    assert ann.nearest(one.limit(0), F.col("id") % 20 == 0).count() == 0
    assert ann.nearest(one, F.col("id") < 0).count() == 0


def test_recall_on_the_given_vectors(spark):
    found = queries.op5_adaptive_scan_ann(spark, FOLDER).collect()
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        best = [j for j in np.argsort(-(x @ x[i])) if j != i][:20]
        hits += len({r.vec_id for r in found if r.query_id == ids[i]} & {int(ids[j]) for j in best})
    assert hits / len(found) >= 0.9


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op8_pu_quality(spark, folder).collect()}
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if found[r.doc_id].held_out]
    right = sum(found[r.doc_id].predicted == r.quality for r in labels)
    assert right / len(labels) >= 0.93
    good = [found[r.doc_id].score for r in labels if r.quality]
    bad = [found[r.doc_id].score for r in labels if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) >= 0.95


def test_quality_of_odd_rows(spark, docs, nothing):
    positives = docs.filter("doc_id < 100").select("doc_id")
    model = quality.fit(docs, positives)
    rows = quality.score(docs, model, ["doc_id", "n", "document"]).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(nothing, model, ["doc_id"]).count() == 0
    without = quality.fit(docs, positives.limit(0))
    assert {r.score for r in quality.score(docs, without, ["doc_id"]).collect()} == {0.5}
    assert quality.fit(nothing, positives.limit(0)).prior == 0.5
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (None, 1), (3, None)], "doc_id bigint, quality int")
    assert [r.doc_id for r in quality.trusted_positives(labels).collect()] == [2]


def test_the_prior_is_estimated():
    random = np.random.default_rng(2)
    positive = random.normal(1.5, 1, (2000, 4))
    unlabelled = np.vstack([random.normal(1.5, 1, (1200, 4)), random.normal(-1.5, 1, (800, 4))])[random.permutation(2000)]
    assert abs(quality.estimate_prior(positive, unlabelled) - 0.6) < 0.08


def test_quality_sample_is_bounded_for_hot_keys(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality, "estimate_prior", lambda p, u: sizes.extend([len(p), len(u)]) or 0.5)
    rows = [(None, "a row without a key")] * 2000 + [(1, "one key of many rows")] * 2000 + [(i, f"text {i}") for i in range(2, 2002)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    positives = spark.createDataFrame([(i,) for i in range(1, 101)], "doc_id bigint")
    quality.fit(documents, positives, (200, 300))
    assert 80 <= sizes[0] <= 130 and 200 <= sizes[1] <= 400
