"""Brown class-based bigrams: exchange clustering, class transitions, word emissions, and the score of every text.

The model: P(text) = product of P(class | class before) * P(word | class), an end after the last word.

* Words are counted over all training texts. Those that hold at least one in ``CORE`` of the tokens (so at most ``CORE``
  words, at any size) are clustered by exchange: in each round every word computes, from its left and right
  class counts, the exact change of the class-bigram likelihood for each class; half of the words, by a
  hash that changes with the round, move to their best one. The best assignment seen is kept.
* Every other word is exchanged once against the converged classes, from all its occurrences.
* Transitions and emissions are then counted anew over all training tokens, each with its class.

No vocabulary is gathered: texts are encoded in chunks, each with its own sorted list of rarer words; the lists meet
their counts and classes by a shuffle on the word's hash and return to the chunk. What reaches the driver is
bounded by ``CORE`` and the number of classes. Words are told apart by 64-bit hashes.

A word unseen in training can come from every class, each of which keeps the mass of one more word for it: its
probability is the sum over them, and what follows it is drawn from the classes' overall shares.

Defined cases: a null or empty text is the end alone; equal rows count as often as they occur; a null key is held out or not like the empty text; no
training rows: all words are unknown and classes uniform; no rows in, no rows out. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import batch, stored
from colscope.llm.words import Words, blocks, mix, signed

CLASSES, ROUNDS, CORE = 48, 6, 1 << 15
# Added to every count of a transition, and of a word in its class.
TRANSITION, EMISSION = 0.5, 0.1
# Bytes of text in a chunk; distinct entries a task gathers before it hands them on.
CHUNK, GATHERED = 6 << 20, 1 << 19


class _Counter:
    """Counts of 64-bit keys, in bounded memory."""

    def __init__(self) -> None:
        self.keys, self.counts, self.parts = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        self.parts.append((keys[first], np.diff(np.append(first, len(keys)))))
        if sum(len(k) for k, _ in self.parts) > GATHERED:
            self.merge()

    def add_counts(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
        counts = np.concatenate([self.counts, *(c for _, c in self.parts)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        self.keys, self.counts, self.parts = keys[first], np.add.reduceat(counts, first) if len(first) else counts, []

    def take(self, least: int = 0) -> pa.RecordBatch | None:
        """What was gathered, if it is more than ``least`` entries."""
        if least and len(self.keys) <= least:
            return None
        self.merge()
        out = batch(_COUNTS, self.keys, self.counts)
        self.keys = self.counts = np.zeros(0, np.int64)
        return out


_COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def _counted(rows: DataFrame, keys_of) -> DataFrame:
    """(key, n) over the keys that ``keys_of(words)`` yields for every block of texts, counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for b in batches:
            for part in blocks(b):
                counter.add(keys_of(Words(part.column("text"))))
                full = counter.take(GATHERED)
                if full is not None:
                    yield full
        yield counter.take()

    return stored(rows.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), text=True)


def _with_ends(values: np.ndarray, words: Words, end: int) -> np.ndarray:
    """The values of all words with ``end`` after every text."""
    texts = len(words.first) - 1
    out = np.full(len(words) + texts, end, dtype=np.int64)
    out[np.arange(len(words)) + words.text_of()] = values
    return out


def _before(values: np.ndarray, end: int) -> np.ndarray:
    return np.concatenate([[end], values[:-1]])


@dataclass
class Core:
    """The frequent words: sorted hashes, counts, classes. Symbols: 0.. words, then the rest, then the end."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    n_classes: int

    @property
    def rest(self) -> int:
        return len(self.hashes)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        if not self.rest:
            return np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), self.rest - 1)
        return np.where(self.hashes[at] == h, at, self.rest)

    def of_symbols(self) -> np.ndarray:
        """Class of every symbol; the rest and the end have classes of their own."""
        return np.concatenate([self.classes, [self.n_classes, self.n_classes + 1]])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _best_moves(words: np.ndarray, left: np.ndarray, right: np.ndarray, itself: np.ndarray, own: np.ndarray, table: np.ndarray, n: int):
    """For every word the class of greatest likelihood, others staying where they are."""
    best = np.empty(len(words), dtype=np.int64)
    for i, a in enumerate(own):
        before, after, s = left[i].copy(), right[i].copy(), itself[i]
        before[a] -= s
        after[a] -= s
        bare = table.copy()
        bare[:, a] -= before
        bare[a, :] -= after
        bare[a, a] -= s
        total = before.sum() + s
        columns = _xlogx(bare + before[:, None]) - _xlogx(bare)
        rows = _xlogx(bare + after[None, :]) - _xlogx(bare)
        diagonal = np.diagonal(bare)
        gain = columns.sum(0) + rows.sum(1) - np.diagonal(columns) - np.diagonal(rows)
        gain += _xlogx(diagonal + before + after + s) - _xlogx(diagonal)
        for sums in (bare.sum(0), bare.sum(1)):
            gain -= _xlogx(sums + total) - _xlogx(sums)
        best[i] = np.argmax(gain[:n])
        if gain[best[i]] <= gain[a] + 1e-9:
            best[i] = a
    return best


def _moves(core: Core, table: np.ndarray, round_: int):
    """The moves of one round, for a group of the core words' contexts."""
    classes, n, wide = core.classes, core.n_classes, core.n_classes + 2

    def moves(group: pa.Table) -> pa.Table:
        place, other = np.divmod(group.column("key").to_numpy(), wide)
        word, side = np.divmod(place, 3)
        draw = mix(word.astype(np.uint64) + np.uint64(round_ // 2 * 7919)) % np.uint64(2)
        turn = (word < len(classes)) & (draw == round_ % 2)
        words, at = np.unique(word[turn], return_inverse=True)
        counts = np.zeros((3, len(words), wide))
        counts[side[turn], at, other[turn]] = group.column("n").to_numpy()[turn]
        found = _best_moves(words, counts[0], counts[1], counts[2, :, 0], classes[words], table, n)
        return pa.table([words, found], schema=pa.schema([("word", pa.int64()), ("class", pa.int64())]))

    return moves


def _exchange(bigrams: DataFrame, core: Core, rounds: int) -> tuple[Core, np.ndarray]:
    """Exchange clustering of the core words over their bigram counts (key = before * symbols + word)."""
    symbols, wide = core.rest + 2, core.n_classes + 2
    best, best_table, best_value = core.classes, None, -np.inf
    for round_ in range(rounds + 1):
        of = core.of_symbols()

        def contexts(batches: Iterator[pa.RecordBatch], of=of) -> Iterator[pa.RecordBatch]:
            """Counts by (word, side or itself, class of the other), gathered before the shuffle."""
            counter = _Counter()
            for b in batches:
                code, n = b.column(0).to_numpy(), b.column(1).to_numpy()
                a, w = np.divmod(code, symbols)
                same = a == w
                keys = [(w * 3) * wide + of[a], (a * 3 + 1) * wide + of[w], (a[same] * 3 + 2) * wide]
                counter.add_counts(np.concatenate(keys), np.concatenate([n, n, n[same]]))
                full = counter.take(GATHERED)
                if full is not None:
                    yield full
            yield counter.take()

        rows = bigrams.mapInArrow(contexts, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
        rows = stored(rows.withColumn("part", F.floor(F.col("key") / (3 * wide * 64)).cast("bigint")))

        def totals(batches: Iterator[pa.RecordBatch], of=of) -> Iterator[pa.RecordBatch]:
            counter = _Counter()
            for b in batches:
                place, other = np.divmod(b.column(0).to_numpy(), wide)
                left = place % 3 == 0
                counter.add_counts(other[left] * wide + of[place[left] // 3], b.column(1).to_numpy()[left])
            yield counter.take()

        table = np.zeros(wide * wide)
        for key, n in rows.select("key", "n").mapInArrow(totals, "key bigint, n bigint").groupBy("key").agg(F.sum("n")).collect():
            table[key] = n
        table = table.reshape(wide, wide)
        value = _xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum()
        if value > best_value:
            best, best_table, best_value = core.classes, table, value
        if round_ == rounds:
            break

        moved = rows.groupBy("part").applyInArrow(_moves(core, table, round_), "word bigint, class bigint").collect()
        classes = core.classes.copy()
        for word, class_ in moved:
            classes[word] = class_
        core = Core(core.hashes, core.counts, classes, core.n_classes)
    return Core(core.hashes, core.counts, best, core.n_classes), best_table


def _binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes cut into a binary column."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype(np.uint8).tobytes())])


_ENCODED = "chunk bigint, word int, h bigint, bytes binary, keys array<bigint>, held array<boolean>, sizes array<int>"


def _encoded(rows: DataFrame, core: Core) -> DataFrame:
    """Two kinds of rows. A chunk of texts (word -1): keys, sizes and the codes of all words, as byte planes. A
    rarer word of a chunk: its place in the chunk's list, hash and the classes around its occurrences in training."""
    schema = pa.schema(
        [("chunk", pa.int64()), ("word", pa.int32()), ("h", pa.int64()), ("bytes", pa.binary()),
         ("keys", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32()))]
    )
    of, end = core.of_symbols(), core.rest + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            for part in blocks(b, limit=CHUNK):
                words = Words(part.column("text"))
                h = words.hashes(True)
                symbol = core.symbols(h)
                rare = np.flatnonzero(symbol == core.rest)
                found, at = np.unique(h[rare], return_inverse=True)
                codes = symbol.copy()
                codes[rare] = core.rest + at
                planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
                held = part.column("held")
                ids = pa.array([part.column("key").to_pylist()], type=pa.list_(pa.int64()))
                yield batch(schema, [chunk], [-1], [None], [planes], ids, [held.to_pylist()], [words.counts()])
                # classes before and after every rare word of a training text
                classes = _with_ends(of[symbol], words, of[end])
                place = rare + words.text_of()[rare]
                learn = ~held.to_numpy(zero_copy_only=False)[words.text_of()[rare]]
                around = np.stack([_before(classes, of[end])[place], classes[place + 1] if len(place) else classes[:0]], axis=1)
                order = np.argsort(at[learn], kind="stable")
                sizes = 2 * np.bincount(at[learn], minlength=len(found))
                n = len(found)
                if n:
                    yield batch(
                        schema, np.full(n, chunk), np.arange(n, dtype=np.int32), signed(found),
                        _binaries(around[learn][order].ravel(), sizes), pa.nulls(n, pa.list_(pa.int64())),
                        pa.nulls(n, pa.list_(pa.bool_())), pa.nulls(n, pa.list_(pa.int32())),
                    )
                chunk += 1

    return stored(rows.mapInArrow(run, _ENCODED), text=True)


def _placed(encoded: DataFrame, table: np.ndarray, n_classes: int) -> DataFrame:
    """(chunk, word, n, class, first): count and best class of every rarer word; ``first`` marks one row per word."""
    schema = pa.schema(
        [("chunk", pa.int64()), ("word", pa.int32()), ("n", pa.int64()), ("class", pa.int32()), ("first", pa.bool_())]
    )
    wide = n_classes + 2
    log, totals = np.log(table + TRANSITION), np.log(table.sum(0) + TRANSITION * wide) + np.log(table.sum(1) + TRANSITION * wide)

    def classed(rows: pa.Table) -> pa.RecordBatch:
        h = rows.column("h").to_numpy()
        raw = rows.column("bytes").combine_chunks()
        sizes = pa.compute.binary_length(raw).to_numpy()
        begin = raw.offset
        offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[begin : begin + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] else np.zeros(0, np.uint8)
        new = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(new) - 1
        count = group[-1] + 1
        of = np.repeat(group, sizes // 2)
        n = np.bincount(of, minlength=count)
        gain = np.zeros((count, wide))
        for side, logs in ((0, log), (1, log.T)):
            gain += np.bincount(of * wide + data[side::2], minlength=count * wide).reshape(count, wide) @ logs
        best = np.argmax((gain - n[:, None] * totals)[:, :n_classes], axis=1)
        best[n == 0] = -1
        return batch(schema, rows.column("chunk").combine_chunks(), rows.column("word").combine_chunks(), n[group],
                     best[group].astype(np.int32), new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            h = rows.column("h").to_numpy()
            last = int(np.searchsorted(h, h[-1]))
            if last:
                yield classed(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield classed(held)

    words = encoded.filter("word >= 0").select("chunk", "word", "h", "bytes").repartition("h").sortWithinPartitions("h")
    return stored(words.mapInArrow(run, "chunk bigint, word int, n bigint, class int, first boolean"))


def scores(documents: DataFrame, held_out: Column, key: str = "doc_id", classes: int = CLASSES, rounds: int = ROUNDS, core_words: int = CORE) -> DataFrame:
    """One row per text: the key, held_out, n_tokens, n_known, train_tokens, base_score (unigrams), score (log10)."""
    rows = documents.select(F.col(key).cast("bigint").alias("key"), F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    learn = rows.filter(~F.col("held")).select("text")
    unigrams = _counted(learn, lambda words: signed(words.hashes(True)))
    ends = learn.count()
    words_n, distinct = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, vocabulary = words_n + ends, distinct + (ends > 0)
    frequent = unigrams.filter(F.col("n") * core_words >= words_n).collect()
    h = np.array([r.key for r in frequent], dtype=np.int64).view(np.uint64)
    n = np.array([r.n for r in frequent], dtype=np.int64)
    order = np.argsort(h)
    rank = np.empty(len(h), dtype=np.int64)
    rank[np.lexsort((h, -n))] = np.arange(len(h))
    core = Core(h[order], n[order], rank[order] % classes, classes)
    symbols = core.rest + 2

    def pairs(words: Words) -> np.ndarray:
        sequence = _with_ends(core.symbols(words.hashes(True)), words, core.rest + 1)
        return _before(sequence, core.rest + 1) * symbols + sequence

    core, table = _exchange(_counted(learn, pairs), core, rounds)
    encoded = _encoded(rows, core)
    placed = _placed(encoded, table, classes)
    # words and tokens of every class
    size, tokens = np.ones(classes), np.zeros(classes)
    np.add.at(size, core.classes, 1)
    np.add.at(tokens, core.classes, core.counts)
    of_class = placed.filter("first AND class >= 0").groupBy("class").agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")
    )
    for r in of_class.collect():
        size[r["class"]] += r.words
        tokens[r["class"]] += r.tokens
    unknown, wide = classes + 1, classes + 2  # symbols after the classes: the end, an unseen word
    emitted = np.append(np.log10(tokens + EMISSION * size), [0.0, 0.0])
    base = np.log10(total + 0.1 * (vocabulary + 1))
    per_text = "key bigint, held boolean, n_tokens bigint, n_known bigint, base double, emission double, classes binary"
    schema = pa.schema(
        [("key", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()),
         ("emission", pa.float64()), ("classes", pa.binary())]
    )

    def attach(chunk: pa.Table, lexicon: pa.Table) -> pa.Table:
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.array(s, dtype=np.int64) for s in chunk.column("sizes").to_pylist())])
        planes = chunk.column("bytes")[0].as_buffer()
        codes = np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()
        count = np.zeros(core.rest + lexicon.num_rows, dtype=np.int64)
        class_ = np.zeros(len(count), dtype=np.int64)
        count[: core.rest], class_[: core.rest] = core.counts, core.classes
        at = core.rest + lexicon.column("word").to_numpy()
        count[at], class_[at] = lexicon.column("n").to_numpy(), lexicon.column("class").to_numpy()
        class_[class_ < 0] = unknown
        known = count > 0
        by_word = np.stack([known, np.log10(count + 0.1) - base, np.where(known, np.log10(count + EMISSION) - emitted[class_], 0)])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        sums = [np.diff(np.concatenate([[0], np.cumsum(v[codes])])[bounds]) for v in by_word]
        end = np.log10(ends + 0.1) - base
        return pa.table(
            [pa.array(chunk.column("keys")[0].as_py(), type=pa.int64()), pa.array(chunk.column("held")[0].as_py(), type=pa.bool_()),
             sizes + 1, np.rint(sums[0]).astype(np.int64) + (ends > 0), sums[1] + end, sums[2], _binaries(class_[codes], sizes)],
            schema=schema,
        )

    texts = encoded.filter("word = -1").select("chunk", "bytes", "keys", "held", "sizes")
    lexicon = placed.select("chunk", "word", "n", "class")
    known = stored(texts.groupBy("chunk").cogroup(lexicon.groupBy("chunk")).applyInArrow(attach, per_text))

    def transitions(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all transitions of a batch, and where each text's begin."""
        column = part.column("classes")
        sizes = pa.compute.binary_length(column).to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
        sequence = np.full(len(data) + len(sizes), classes, dtype=np.int64)
        sequence[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
        return _before(sequence, classes) * wide + sequence, np.concatenate([[0], np.cumsum(sizes + 1)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(wide * wide, dtype=np.int64)
        for b in batches:
            for part in blocks(b, "classes"):
                found += np.bincount(transitions(part)[0], minlength=wide * wide)
        yield batch(_COUNTS, np.arange(wide * wide), found)

    seen = np.zeros(wide * wide)
    counted = known.filter("NOT held").select("classes").mapInArrow(count, "key bigint, n bigint")
    for key_, n_ in counted.groupBy("key").agg(F.sum("n")).collect():
        seen[key_] = n_
    seen = seen.reshape(wide, wide)[: classes + 1, : classes + 1]
    chance = np.vstack([seen, seen.sum(0)]) + TRANSITION  # after an unseen word: the overall shares
    chance /= chance.sum(1, keepdims=True)
    unseen = chance[:, :classes] @ (EMISSION / (tokens + EMISSION * size))
    steps = np.full((wide, wide), -np.inf)
    rows_of = [*range(classes + 1), unknown]
    steps[rows_of, : classes + 1], steps[rows_of, unknown] = np.log10(chance), np.log10(unseen)
    step = steps.ravel()
    out = pa.schema(
        [("key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
         ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, "classes"):
                codes, first = transitions(part)
                moved = np.add.reduceat(step[codes], first[:-1])
                yield batch(out, *(part.column(i) for i in range(5)), part.column("emission").to_numpy() + moved)

    final = known.mapInArrow(finish, "key bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return final.select(
        F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"),
        "base_score", "score",
    )
