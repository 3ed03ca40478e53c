"""Operators 4, 6 and 9: conservation, exact round trips, equal ids."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given as for_all
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colscope.llm import chat, mixing, packing, queries
from tests.llm.conftest import FOLDER

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _targets(sizes, weights, repeat=3):
    total, stopped = sum(sizes), set()
    while True:
        rest = total - sum(repeat * sizes[i] for i in stopped)
        weight = sum(w for i, w in enumerate(weights) if i not in stopped)
        out = [repeat * s if i in stopped else rest * weights[i] / weight if weight else 0 for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in stopped and out[i] >= repeat * s}
        if not over:
            return out
        stopped |= over


def test_mix(docs, texts, nothing):
    size = Counter()
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    for _, source, n in rows:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, _targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    mixed = mixing.mix(docs, ["doc_id", "source", "document"])
    found = mixing.by_first_position(mixed).select("document.*", "size", "source_size", "target", "taken", "passes").collect()
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter(rows)
    taken = Counter()
    for r in found:
        assert r.source_size == size[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(p["words"] for p in r.passes)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) < 1 + 1e-6 for s in order)
    again = mixing.mix(docs.repartition(3), ["doc_id"]).select("document.doc_id", "size", "taken").collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in found)
    assert mixing.mix(nothing).count() == 0
    wordless = docs.filter("doc_id in (9001, 9002, 9003)")
    assert {(r.taken, r.target) for r in mixing.mix(wordless).collect()} == {(0, 0.0)}


def test_curriculum_positions(docs):
    """A source that fades out is met early, one that fades in late; shares hold over every stretch."""
    knots = ((0.0, (9.0, 1.0)), (0.5, (5.0, 5.0)), (1.0, (1.0, 9.0)))
    two = docs.filter("doc_id < 9000").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    rows = mixing.training_order(mixing.mix(two, ["doc_id", "source"], knots)).collect()
    places = [r.position for r in rows]
    assert places == sorted(places)
    total = sum(r.words for r in rows)
    assert 0 <= places[0] and places[-1] <= total * 1.01
    early = [r for r in rows if r.position < total / 4]
    share = sum(r.words for r in early if r.document["source"] == "a") / sum(r.words for r in early)
    assert share == pytest.approx(0.8, abs=0.2)


def test_tilted_schedule(docs):
    """A tilt moves words in time and leaves targets and taken words alone; rows without a doc_id are placed by their texts."""
    rows = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    flat, tilted = (mixing.mix(rows, ["doc_id", "source"], tilt=t).collect() for t in (0.0, 0.5))
    assert Counter((r.document, r.size, r.taken) for r in flat) == Counter((r.document, r.size, r.taken) for r in tilted)
    assert {(r.source_size, round(r.target, 6)) for r in flat} == {(r.source_size, round(r.target, 6)) for r in tilted}

    # shares run straight from 1 + 0.5 lean to 1 - 0.5 lean, so a source's words are met 0.5 lean / 6 before the middle
    order = sorted({r.document.source for r in flat}, key=lambda s: (s is None, s or ""))
    weights = [(5, 2, 1)[i % 3] for i in range(len(order))]
    mean = sum(w for w in weights if w == 5) / sum(weights)
    for source, weight in zip(order, weights, strict=True):
        passes = [p for r in tilted if r.document.source == source for p in r.passes]
        if len(passes) >= 100:
            met = sum(p.words * p.position for p in passes) / sum(p.words for p in passes) / sum(r.size for r in tilted)
            assert met == pytest.approx(0.5 - 0.5 * ((weight == 5) - mean) / 6, abs=0.02)


@settings(deadline=None)
@for_all(st.text(alphabet="<|s>/[INST]\\ \nabend_of_turn", max_size=60))
def test_escape_is_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)
    assert chat._unescape_role(chat._escape_role(text)) == text and "\n" not in chat._escape_role(text)


def _digests(conversations):
    out = {}
    for conv, turns in conversations.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def _read(events):
    rows = chat.read_back(chat.render(chat.reconstruct(events))).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


def test_chat_of_the_given_conversations(spark):
    expected = defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").orderBy("conv_id", "turn").collect():
        expected[r.conv_id].append((r.role, r.text or ""))
    said = "</s>[INST] ok [/INST]"
    expected[-7] = [("user", said), ("assistant", said)]
    found = {r.conv_id: tuple(r)[1:5] for r in queries.op6_event_sourced_chat(spark, FOLDER).collect()}
    assert found == _digests(expected)


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "message", "user", "hel"), (1, 0, 1, "delta", "user", "lo"), (1, 1, 2, "message", "assistant", "first"),
        (1, 2, 3, "message", "user", "forgotten"), (1, 1, 4, "regenerate", "assistant", None),
        (1, 1, 5, "delta", "assistant", "sec"), (1, 1, 6, "delta", "assistant", "ond"), (1, 2, 7, "message", "user", "kept"),
        (1, 0, 8, "edit", "user", "edited </s>"), (2, 0, 0, "message", None, None), (2, 0, 0, "message", None, None),
        (3, 0, 0, "message", "user", "x"), (3, 0, 1, "regenerate", "user", None), (None, None, None, "message", "assistant", "a" * 100_000),
    ]
    events = spark.createDataFrame(log, "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string")
    events = events.withColumn("rank", F.lit("clash")).repartition(3)
    expected = {1: [("user", "edited </s>"), ("assistant", "second"), ("user", "kept")], 2: [("", ""), ("", "")],
                None: [("assistant", "a" * 100_000)]}
    assert _read(events) == _digests(expected)
    assert _read(events.limit(0)) == {}
    with pytest.raises(Exception, match="unknown kind"):
        _read(events.withColumn("kind", F.lit("other")))


def test_many_events_in_one_conversation(spark):
    """State crosses Arrow batches."""
    events = spark.range(25_000).select(
        F.lit(5).alias("conv_id"), F.expr("id div 2").alias("turn"), F.col("id").alias("seq"),
        F.expr("CASE WHEN id % 2 = 0 THEN 'message' ELSE 'delta' END").alias("kind"),
        F.expr("CASE WHEN id % 4 < 2 THEN 'user' ELSE 'assistant' END").alias("role"), F.col("id").cast("string").alias("text"),
    )
    turns = [("user" if i % 2 == 0 else "assistant", f"{2 * i}{2 * i + 1}") for i in range(12_500)]
    assert _read(events) == _digests({5: turns})


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


@settings(max_examples=300, deadline=None)
@for_all(text=st.text(max_size=80))
def test_ids_equal_those_of_the_tokenizer(tokenizer, text):
    assert packing.encode(packing.default_tokenizer(), text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_special_texts(tokenizer):
    for text in ("<|endoftext|>a <|endoftext|> b", "   　x", "a" * 5000, " " * 3000, "'s 'S it's\r\n\t\x0b", "٣४ Ⅷ½²"):
        assert packing.encode(packing.default_tokenizer(), text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def _check_pieces(rows, texts, tokenizer, limits):
    expected = Counter()
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END], dtype="<u4")
        expected[(doc_id, ids.tobytes())] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    wanted = Counter()
    for (doc_id, ids), n in expected.items():
        wanted[doc_id, len(ids) // 4] += n
    for (doc_id, tokens), pieces in by_doc.items():
        copies = wanted[doc_id, tokens]
        covered = Counter()
        for p in pieces:
            covered.update(range(p.start, p.start + p.length))
            assert len(p.ids) == 4 * p.length
        assert covered == Counter({i: copies for i in range(tokens)})
        if copies == 1:
            whole = b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: p.start))
            assert (doc_id, whole) in expected
    assert by_doc.keys() == wanted.keys()
    padding = used = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == np.cumsum([0] + [p.length for p in pieces[:-1]]).tolist()
        n = sum(p.length for p in pieces)
        assert n <= limits.tokens and len(pieces) <= limits.segments and sum(p.loss_tokens for p in pieces) <= limits.loss
        padding += 0 if n & (n - 1) == 0 else limits.tokens - n
        used += n
    return padding / max(1, used)


def test_pack(docs, texts, tokenizer, nothing):
    limits = packing.Limits()
    assert _check_pieces(packing.pack(docs).collect(), texts, tokenizer, limits) < 0.01
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(1024, 3, 300), packing.Limits(256, 8, 256, lot=16), packing.Limits(100, 1, 100)])
def test_pack_under_other_limits(docs, texts, tokenizer, limits):
    few = docs.filter("doc_id < 9000").withColumn("prompt_ids", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    rows = packing.pack(few, limits=limits).collect()
    _check_pieces(rows, [t for t in texts if t[0] is not None and t[0] < 9000], tokenizer, limits)
    loss = Counter()
    for r in rows:
        loss[r.doc_id] += r.loss_tokens
    tokens = {r.doc_id: r.doc_tokens for r in rows}
    prompts = {r.doc_id: r.prompt_ids or 0 for r in few.select("doc_id", "prompt_ids").collect()}
    assert all(loss[d] == max(0, tokens[d] - prompts[d]) for d in tokens)
