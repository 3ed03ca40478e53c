"""Operators 11, 12 and 13 against brute force: shards by every shard's draw, groups by overlapping tokens, runs by every period."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given as for_all
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colscope.llm import periodic, queries, sharding, token_alignment
from colscope.llm.packing import default_tokenizer
from tests.llm.conftest import FOLDER

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 11


def _long(value, seed):
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed=seed)


def _place(key, weights):
    null = xxhash.xxh64_intdigest(struct.pack("<i", key is None), seed=42)
    h = xxhash.xxh64_intdigest(("" if key is None else str(key)).encode(), seed=null)
    h -= (h >> 63) << 64
    drawn = [(-math.log(((_long(s, _long(h, 42)) >> 12) + 0.5) / 2**52) / w, s) for s, w in weights.items() if w > 0]
    return min(drawn)[1] if drawn else None


def _gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_query(spark):
    given = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op11_rendezvous_sharding(spark, FOLDER).collect()
    assert len(rows) == len(given) and _gapless(rows)
    for r in rows:
        raw = given[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.shard == _place(r.doc_id, dict.fromkeys(range(40), 1.0)) and r.grown_shard in (r.shard, 40)
        assert r.grown_shard == _place(r.doc_id, dict.fromkeys(range(41), 1.0))


def test_sharding_of_odd_rows(docs, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 7)
    weights = {3: 1.0, 5: 2.5, 6: 0.0, 9: 1.0}
    placed = sharding.placed(docs, weights)
    rows = sharding.with_slots(placed).collect()
    given = docs.collect()
    assert Counter((r.document.doc_id, r.document.text) for r in rows) == Counter((r.doc_id, r.text) for r in given)
    assert _gapless(rows) and {r.shard for r in rows} <= {3, 5, 9}
    assert all(r.shard == r.grown_shard == _place(r.document.doc_id, weights) for r in rows)
    assert sharding.with_slots(sharding.placed(nothing, weights)).count() == 0
    assert {r.shard for r in sharding.with_slots(sharding.placed(docs, {1: 0.0})).collect()} == {None}
    # a key is its text; an extra column of the shard's name does no harm
    clash = docs.withColumn("shard", F.lit("x")).withColumn("slot", F.lit("y"))
    texts = sharding.placed(clash.withColumn("doc_id", F.col("doc_id").cast("string")), weights)
    assert Counter((r.document.doc_id, r.shard) for r in texts.collect()) == Counter(
        (None if r.document.doc_id is None else str(r.document.doc_id), r.shard) for r in rows
    )
    sharding.write_shards(sharding.with_slots(placed.select("document.doc_id", "shard")), str(tmp_path / "out"), file_rows=5)
    written = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert written.count() == len(rows)
    assert written.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 5


def test_sharding_shares_and_moves(spark):
    n, weights = 40_000, {0: 1.0, 1: 1.0, 2: 2.0, 3: 4.0}
    keys = spark.range(n).withColumnRenamed("id", "doc_id")
    for grown, gainer in (({**weights, 4: 2.0}, 4), ({**weights, 1: 3.0}, 1)):
        rows = sharding.placed(keys, weights, grown).select("shard", "grown_shard").collect()
        sizes = Counter(r.shard for r in rows)
        assert all(sizes[s] == pytest.approx(n * w / 8, rel=0.05) for s, w in weights.items())
        moved = [r for r in rows if r.shard != r.grown_shard]
        assert {r.grown_shard for r in moved} == {gainer}
        assert len(moved) == pytest.approx(n * (grown[gainer] / 10 - weights.get(gainer, 0) / 8), rel=0.06)
    # a shard that goes gives up its own rows only
    fewer = sharding.placed(keys, weights, {s: w for s, w in weights.items() if s != 2}).collect()
    assert all(r.shard == 2 or r.shard == r.grown_shard for r in fewer) and all(r.grown_shard != 2 for r in fewer)


# 12


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece

    a = Tokenizer.from_file(default_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=token_alignment.default_pieces())


def _spelled(a, b):
    """Bytes of every id, decoded from the vocabularies."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [i for i in range(256) if i not in visible]
    byte = {chr(i): i for i in visible} | {chr(256 + k): i for k, i in enumerate(hidden)}
    left = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab().items() if all(c in byte for c in t)}
    right = {}
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        match = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        right[i] = bytes([int(match[1], 16)]) if match else piece.replace("▁", " ").encode()
    return left, right


def _expected_alignment(rows, tokenizers):
    a, b = tokenizers
    left, right = _spelled(a, b)
    docs = []
    for doc_id, text in rows:
        groups = []
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(left[i] for i in x) == whole == b"".join(right[i] for i in y):
            i = j = ends_a = ends_b = 0
            group = ([], [])
            while i < len(x) or j < len(y):
                if ends_a <= ends_b and i < len(x):
                    group[0].append(x[i])
                    ends_a += len(left[x[i]])
                    i += 1
                else:
                    group[1].append(y[j])
                    ends_b += len(right[y[j]])
                    j += 1
                if ends_a == ends_b:
                    groups.append(group)
                    group = ([], [])
        docs.append((doc_id, groups))
    in_docs = Counter()
    held = []
    for _, groups in docs:
        links = Counter()
        for p, q in groups:
            p, q = Counter(p), Counter(q)
            for u in p:
                for v in q:
                    links[u, v] += p[u] * q[v]
        held.append(links)
        in_docs.update(links.keys())
    most = defaultdict(int)
    for (u, _), n in in_docs.items():
        most[u] = max(most[u], n)
    out = []
    for (doc_id, groups), links in zip(docs, held, strict=True):
        spelled = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((
            doc_id, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(links.values()),
            sum(n for k, n in links.items() if in_docs[k] == most[k[0]]), sum(n * in_docs[k] for k, n in links.items()),
            hashlib.sha256(spelled.encode()).hexdigest() if spelled else "",
        ))
    return out


ODD = ["</s> <unk> <0x41> <|endoftext|> [INST]", " two  spaces ", "▁ mark", "ﬁ ligature ﬃ", "日本語のテキスト、句読点。", "🙂🙃 emoji 👩‍👩‍👧", "á é", "tab\tand\nnewline\r\n",
       "\x00 nul", "１２３ full width", "aaa" * 700, "ไทยไม่มีช่องว่าง" * 20, "nbsp here", "    indented\n        more"]


def test_alignment(spark, docs, texts, nothing, tokenizers):
    odd = spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    frame = docs.unionByName(odd, allowMissingColumns=True).repartition(3)
    expected = _expected_alignment(texts + [(20_000 + i, t) for i, t in enumerate(ODD)], tokenizers)
    found = token_alignment.aligned(frame)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == Counter(expected)
    assert any(e[1] == 0 for e in expected if e[0] and e[0] >= 20_000) and sum(e[1] > 0 for e in expected[-len(ODD):]) > 5
    assert token_alignment.aligned(nothing).count() == 0
    spelled = token_alignment.token_groups(frame).collect()
    digests = Counter((r.doc_id, r.n_links, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in spelled)
    assert digests == Counter((e[0], e[4], e[7]) for e in expected)


def test_alignment_in_small_pieces(docs, texts, tokenizers, monkeypatch):
    monkeypatch.setattr(token_alignment, "CHUNK", 3000)
    monkeypatch.setattr(token_alignment, "LINKS", 100)
    monkeypatch.setattr(token_alignment, "WIDE", 3)
    few = docs.filter("doc_id < 40 OR doc_id IS NULL")
    rows = [(d, t) for d, t in texts if d is None or d < 40]
    chunks = token_alignment._chunks(few, None, None)
    assert chunks.count() > 3
    assert Counter(tuple(r) for r in token_alignment.aligned(few).collect()) == Counter(_expected_alignment(rows, tokenizers))


@settings(deadline=None)
@for_all(st.lists(st.integers(1, 5), min_size=1, max_size=40), st.lists(st.integers(1, 5), min_size=1, max_size=40))
def test_last_of_group(sizes_a, sizes_b):
    total = max(sum(sizes_a), sum(sizes_b))
    ends = [np.cumsum(s + [total - sum(s)] * (sum(s) < total)) for s in (sizes_a, sizes_b)]
    last_a, last_b = token_alignment.last_of_group(*ends)
    common = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    for last, own in ((last_a, ends[0]), (last_b, ends[1])):
        assert ends[0][last].tolist() == [next(c for c in common if c >= e) for e in own.tolist()]


def test_alignment_query(spark, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = queries.op12_token_alignment(spark, FOLDER).collect()
    assert Counter(tuple(r) for r in found) == Counter(_expected_alignment(rows, tokenizers))


# 13


def _expected_runs(words, least=6, periods=4):
    out, n = {}, len(words)
    ids: dict = {}
    values = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    for q in range(1, n // periods + 1):
        same = np.concatenate([[0], (values[q:] == values[:-q]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = end - start + q
            if length >= max(least, periods * q):
                out.setdefault((start, length), q)
    return sorted(((start, length, q) for (start, length), q in out.items()), key=lambda r: (r[0], r[2]))


def _collapsed(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _found_runs(lists, least=6, periods=4):
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    text = np.repeat(np.arange(len(lists)), np.diff(first))
    h = np.array([hash((w, 1)) & 0xFFFFFFFFFFFF for x in lists for w in x], dtype=np.uint64)
    start, length, period = periodic.runs(periodic.word_numbers(h, text), first, least, periods)
    out = [[] for _ in lists]
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        t = int(np.searchsorted(first, s, side="right")) - 1
        out[t].append((s - int(first[t]), n, q))
    return out


@settings(deadline=None, max_examples=300)
@for_all(st.lists(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abcd"), max_size=60), min_size=1, max_size=5),
         st.sampled_from([(6, 4), (2, 2), (3, 2), (6, 3)]))
def test_runs_of_short_alphabets(lists, limits):
    assert _found_runs(lists, *limits) == [_expected_runs(x, *limits) for x in lists]


@settings(deadline=None, max_examples=60)
@for_all(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=12), st.integers(1, 9)), min_size=1, max_size=8))
def test_runs_of_repeated_stretches(stretches):
    words = [w for stretch, times in stretches for w in stretch * times]
    assert _found_runs([words, words[::-1]]) == [_expected_runs(words), _expected_runs(words[::-1])]


def test_runs_of_long_texts():
    one = ["a"] * 20_000
    fibonacci, before = ["a", "b"], ["a"]
    while len(fibonacci) < 5_000:
        fibonacci, before = fibonacci + before, fibonacci
    mixed = [f"w{i * i % 701}" for i in range(9_000)]
    assert _found_runs([one, fibonacci, mixed], 6, 4) == [[(0, 20_000, 1)], _expected_runs(fibonacci), _expected_runs(mixed)]


def test_periodic_runs_of_odd_rows(spark, docs, texts, nothing, monkeypatch):
    monkeypatch.setattr(periodic, "QUESTIONS", 500)
    extra = [(30_000, "x " * 50 + "y"), (30_001, "a b a b a b a b c c c c c c"), (30_002, "no run here at all"), (None, "z q " * 9), (30_001, "a b a b a b a b c c c c c c")]
    frame = docs.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"), allowMissingColumns=True).repartition(3)
    found = periodic.periodic_runs(frame).select("document.doc_id", "n_words", "runs", "collapsed").collect()
    expected = Counter()
    for doc_id, text in texts + extra:
        words = WORD.findall(text or "")
        listed = _expected_runs(words) if len(words) < 6_000 else []  # the long odd texts repeat no word closely
        expected[doc_id, len(words), tuple(listed), _collapsed(words, listed)] += 1
    assert Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in found) == expected
    assert periodic.periodic_runs(nothing).count() == 0


def _planted(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def test_periodic_query(spark):
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op13_periodic_runs(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(given) and sum(r.n_runs for r in rows) > 20
    for r in rows:
        words = _planted(r.doc_id, given[r.doc_id])
        listed = _expected_runs(words)
        best = max(listed, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(listed), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(_collapsed(words, listed).encode()).hexdigest()


def test_planted_runs_of_odd_rows(docs, texts):
    found = queries.with_planted_runs(docs.drop("n", "a", "p", "words").withColumn("n", F.lit("clash"))).collect()
    plain = [(d, WORD.findall(t or "")) for d, t in ((r.doc_id, r.text) for r in found)]
    assert Counter((d, tuple(w)) for d, w in plain) == Counter((d, tuple(_planted(d, t))) for d, t in texts)
