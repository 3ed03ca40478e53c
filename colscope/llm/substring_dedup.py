"""Substring deduplication: repeated windows of words, counted by super-k-mer partitioning.

A window of ``WINDOW`` words has a minimiser, the least hash of its ``SEED``-word runs. Consecutive windows that share
one occurrence of it form a super-k-mer (so equal windows are never in the same one). A window can only repeat if its minimiser does, so the minimisers are counted
first; super-k-mers of the others go no further. The rest travel to their minimiser's bucket as one packed
string each, where their windows are sorted and counted exactly, word by word. A bucket of more than ``HOT``
super-k-mers is not gathered: its windows are dealt out by their own 128-bit fingerprints, as a sorted stream. Every
word under a repeated window is removed; windows are judged on the input.

Defined cases: a null text has no words; texts shorter than a window lose nothing; equal rows repeat each other, so both
lose all words under a window; a null doc_id is a value; no rows in, no rows out. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import batch, small_side, stored
from colscope.llm.words import Words, blocks, runs, signed, sliding_min

WINDOW, SEED = 35, 8
# Super-k-mers of one minimiser that a task gathers; more are dealt out by window.
HOT = 1 << 16
# Super-k-mers whose windows are sorted at once, whole buckets.
SORTED = 1 << 14


def _row_id(df: DataFrame):
    """Equal rows share it: they stand and fall together."""
    return F.xxhash64("doc_id", "text")


def _windows(words: Words, window: int, seed: int):
    """For every window of a block: first word, minimiser; and where super-k-mers begin among them."""
    h = words.hashes(False)
    if len(h) < window:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, h
    least, place = sliding_min(signed(runs(h, seed)), window - seed + 1)
    of = words.text_of()
    whole = of[: len(least)] == of[window - 1 :]
    first = np.flatnonzero(whole)
    low, place = least[first], place[first]
    begins = np.ones(len(first), dtype=bool)
    begins[1:] = place[1:] != place[:-1]
    return first, low, np.flatnonzero(begins), h


def _minimisers(documents: DataFrame, window: int, seed: int) -> DataFrame:
    """(low, place): the minimiser of every super-k-mer and a number for its document and first word."""
    schema = pa.schema([("low", pa.int64()), ("row_id", pa.int64()), ("start", pa.int64()), ("twin", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twin = 0
        for b in batches:
            for part in blocks(b):
                words = Words(part.column("text"))
                first, low, begin, _ = _windows(words, window, seed)
                of = np.searchsorted(words.first, first[begin], side="right") - 1
                ids = part.column("row_id").to_numpy()[of]
                yield batch(schema, low[begin], ids, first[begin] - words.first[of], twin + np.arange(len(begin)))
                twin += len(begin)

    return documents.mapInArrow(run, "low bigint, row_id bigint, start bigint, twin bigint")


def _repeated_minimisers(rows: DataFrame) -> DataFrame:
    """(row_id, start, low) of the super-k-mers whose minimiser occurs again."""
    schema = pa.schema([("row_id", pa.int64()), ("start", pa.int64()), ("low", pa.int64())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, company_held = None, False
        for b in batches:
            if not b.num_rows:
                continue
            low, ids, start = (b.column(i).to_numpy() for i in range(3))
            if held is not None:
                low, ids, start = (np.concatenate([h, c]) for h, c in zip(held, (low, ids, start), strict=True))
            same = low[1:] == low[:-1]
            company = np.zeros(len(low), dtype=bool)
            company[1:] = same
            company[:-1] |= same
            company[0] |= held is not None and company_held
            out = company[:-1]
            if out.any():
                yield batch(schema, ids[:-1][out], start[:-1][out], low[:-1][out])
            held, company_held = (low[-1:], ids[-1:], start[-1:]), bool(company[-1])
        if held is not None and company_held:
            yield batch(schema, held[1], held[2], held[0])

    ordered = rows.select("low", "row_id", "start").repartition("low").sortWithinPartitions("low")
    return ordered.mapInArrow(stream, "row_id bigint, start bigint, low bigint")


def _super_k_mers(documents: DataFrame, wanted: DataFrame, window: int, seed: int) -> DataFrame:
    """Packed super-k-mers of ordinary buckets (key low, key2 null), windows of hot ones (two fingerprints)."""
    schema = pa.schema(
        [("key", pa.int64()), ("key2", pa.int64()), ("packed", pa.binary()), ("row_id", pa.int64()), ("start", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b):
                words = Words(part.column("text"))
                first, low, begin, h = _windows(words, window, seed)
                if not len(begin):
                    continue
                end = np.append(begin[1:], len(first))
                of = np.searchsorted(words.first, first[begin], side="right") - 1
                row_ids = part.column("row_id").to_numpy()
                offset = first[begin] - words.first[of]
                asked = part.column("starts")
                sizes = np.diff(asked.offsets.to_numpy())
                pair = asked.flatten()
                want_of = np.repeat(np.arange(len(asked)), sizes)
                want = pair.field(0).to_numpy(zero_copy_only=False)
                hot = pair.field(1).to_numpy(zero_copy_only=False).astype(bool)
                # match (text, start) of the request with the super-k-mers found again
                scale = int(max(offset.max(), want.max(initial=0))) + 1
                code = of * scale + offset
                at = np.searchsorted(code, want_of * scale + want)
                plain, at_hot = at[~hot], at[hot]
                data = words.data.tobytes()
                # spaces between words are brought to one
                packed = [
                    b" ".join(data[words.starts[first[i]] : words.ends[first[j - 1] + window - 1]].split())
                    for i, j in zip(begin[plain], end[plain], strict=True)
                ]
                if packed:
                    nothing = pa.nulls(len(packed), pa.int64())
                    yield batch(schema, low[begin[plain]], nothing, packed, row_ids[of[plain]], offset[plain])
                if len(at_hot):
                    one, two = runs(h, window), runs(words.hashes(False, seed=1), window)
                    each = np.concatenate([np.arange(i, j) for i, j in zip(begin[at_hot], end[at_hot], strict=True)])
                    owner = np.searchsorted(words.first, first[each], side="right") - 1
                    yield batch(
                        schema, signed(one[first[each]]), signed(two[first[each]]), pa.nulls(len(each), pa.binary()),
                        row_ids[owner], first[each] - words.first[owner],
                    )

    lists = wanted.groupBy(F.col("row_id").alias("id2")).agg(F.sort_array(F.collect_set(F.struct("start", "hot"))).alias("starts"))
    rows = documents.join(lists, F.col("row_id") == F.col("id2")).select("row_id", "text", "starts")
    return rows.mapInArrow(run, "key bigint, key2 bigint, packed binary, row_id bigint, start bigint")


def _repeated_in(packed: list[bytes], window: int) -> list[tuple[int, int, int]]:
    """(super-k-mer, begin, end): its words under windows that occur again among ``packed``, in spans.

    Windows are sorted by two 64-bit hashes; neighbours of equal hashes are compared word by word.
    """
    words = Words(pa.array(packed, type=pa.binary()))
    one, two = runs(words.hashes(False), window), runs(words.hashes(False, seed=1), window)
    of = words.text_of()
    whole = np.flatnonzero(of[: len(one)] == of[window - 1 :]) if len(one) else np.zeros(0, dtype=np.int64)
    order = whole[np.lexsort((two[whole], one[whole]))]
    same = np.flatnonzero((one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]]))
    data = words.data.tobytes()
    text = lambda i: data[words.starts[i] : words.ends[i + window - 1]]
    again = np.zeros(len(words), dtype=bool)
    for k in same.tolist():
        if text(order[k]) == text(order[k + 1]):
            again[order[k]] = again[order[k + 1]] = True
    places = np.flatnonzero(again)
    if not len(places):
        return []
    new = np.ones(len(places), dtype=bool)
    new[1:] = (of[places[1:]] != of[places[:-1]]) | (places[1:] > places[:-1] + window)
    first = np.flatnonzero(new)
    last = places[np.append(first[1:], len(places)) - 1]
    begin, owner = places[first], of[places[first]]
    at = words.first[owner]
    return list(zip(owner.tolist(), (begin - at).tolist(), (last - at + window).tolist(), strict=True))


def _count_buckets(rows: DataFrame, window: int) -> DataFrame:
    """(row_id, begin, end): words under repeated windows, from the packed super-k-mers."""
    schema = pa.schema([("row_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def counted(rows: list[tuple[int, bytes, int, int]]) -> list[tuple[int, int, int]]:
        # equal super-k-mers repeat each other whole; one of them stands for all among the others
        copies: dict[bytes, list[tuple[int, int]]] = {}
        for _, text, row_id, start in rows:
            copies.setdefault(text, []).append((row_id, start))
        out = []
        for text, places in copies.items():
            if len(places) > 1:
                size = text.count(b" ") + 1
                out += [(row_id, start, start + size) for row_id, start in places]
        texts = list(copies)
        for i, begin, end in _repeated_in(texts, window):
            if len(copies[texts[i]]) == 1:
                row_id, start = copies[texts[i]][0]
                out.append((row_id, start + begin, start + end))
        return out

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, int]] = []

        def emit(rows):
            found = counted(rows)
            return [batch(schema, *(list(c) for c in zip(*found, strict=True)))] if found else []

        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns), strict=True)
            if len(held) >= SORTED:
                # up to the beginning of the last bucket, which may go on
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                yield from emit(held[:cut])
                held = held[cut:]
        yield from emit(held)

    ordered = rows.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(stream, "row_id bigint, begin bigint, end bigint")


def repeated_spans(documents: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(row_id, spans): spans of words (begin, end) to remove; ``documents`` are (row_id, doc_id, text)."""
    places = stored(_repeated_minimisers(_minimisers(documents.select("row_id", "text"), window, seed)))
    hot = stored(places.groupBy("low").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("low"))
    wanted = places.join(small_side(hot.withColumn("hot", F.lit(True))), "low", "left").select(
        "row_id", "start", F.coalesce("hot", F.lit(False)).alias("hot")
    )
    travel = stored(_super_k_mers(documents.select("row_id", "text"), wanted, window, seed), text=True)
    spans = _count_buckets(travel.filter("key2 IS NULL").select("key", "packed", "row_id", "start"), window)
    # the windows of hot buckets: those whose fingerprint another place has too
    dealt = travel.filter("key2 IS NOT NULL").select("key", "key2", "row_id", "start")
    spans = spans.unionByName(_repeated_windows(dealt, window))
    return spans.groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))


def _repeated_windows(rows: DataFrame, window: int) -> DataFrame:
    schema = pa.schema([("row_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, company_held = None, False

        def emit(ids, start):
            # neighbouring windows of one text become one span
            order = np.lexsort((start, ids))
            ids, start = ids[order], start[order]
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (ids[1:] != ids[:-1]) | (start[1:] > start[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(ids)) - 1
            return batch(schema, ids[first], start[first], start[last] + window)

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(4)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
            company = np.zeros(len(cols[0]), dtype=bool)
            company[1:] = same
            company[:-1] |= same
            company[0] |= held is not None and company_held
            out = company[:-1]
            if out.any():
                yield emit(cols[2][:-1][out], cols[3][:-1][out])
            held, company_held = [c[-1:] for c in cols], bool(company[-1])
        if held is not None and company_held:
            yield emit(held[2], held[3])

    ordered = rows.repartition("key", "key2").sortWithinPartitions("key", "key2")
    return ordered.mapInArrow(stream, "row_id bigint, begin bigint, end bigint")


def remove_repeats(documents: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): the kept words of every document, joined by one space."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(_row_id(rows).alias("row_id"), "doc_id", "text")
    spans = repeated_spans(rows, window, seed).withColumnRenamed("row_id", "id2")
    joined = rows.join(spans, F.col("row_id") == F.col("id2"), "left").select("doc_id", "text", "spans")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b):
                words = Words(part.column("text"))
                n = words.counts()
                step = np.zeros(len(words) + 1, dtype=np.int64)
                asked = part.column("spans")
                given = np.flatnonzero(asked.is_valid().to_numpy(zero_copy_only=False))
                if len(given):
                    valid = asked.take(pa.array(given))
                    sizes = np.diff(valid.offsets.to_numpy())
                    flat = valid.flatten()
                    base = np.repeat(words.first[given], sizes)
                    np.add.at(step, base + flat.field(0).to_numpy(zero_copy_only=False), 1)
                    np.add.at(step, base + flat.field(1).to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(step[:-1]) > 0
                removed = np.add.reduceat(np.append(gone, False), words.first[:-1]) if len(n) else n
                removed = np.where(n > 0, removed, 0)
                # bytes of kept words, each followed by one space
                inside = np.zeros(len(words.data) + 1, dtype=np.int64)
                kept = ~gone
                np.add.at(inside, words.starts[kept], 1)
                np.add.at(inside, words.ends[kept], -1)
                keep = np.cumsum(inside[:-1]) > 0
                texts = []
                for i in range(part.num_rows):
                    a, z = words.offsets[i], words.offsets[i + 1]
                    if removed[i] == n[i]:
                        texts.append(b"")
                    else:
                        raw = np.where(keep[a:z], words.data[a:z], 32).astype(np.uint8).tobytes()
                        texts.append(b" ".join(raw.split()))
                out = pa.array(texts, type=pa.binary()).cast(pa.string())
                yield batch(schema, part.column("doc_id"), n, removed, out)

    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
