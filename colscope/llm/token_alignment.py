"""Alignment of two tokenizers' tokens by pointer jumping.

Both tokenizers cut the same bytes. Tokens of the one and the other that share a byte overlap; a group is a connected
component of overlapping tokens, which ends where both end a token. Every token points to the overlapping token that reaches
farthest to the right: one of the other tokenizer, or itself where both end. The pointers of all texts of a block
are doubled together until nothing moves; every token then points to the last one of its group, which names the group.

Tokens of different tokenizers in one group are linked. How many documents hold a pair of ids linked is counted over the whole
corpus: a chunk of texts lists its distinct pairs with their documents, the lists are added up by pair, and every chunk
gets the sums of its own list back, the most frequent pairs by broadcast, the rest by shuffle. What travels is one row per
distinct pair of a chunk, not one per link.

Defined cases: a null or empty text has no tokens, as has one whose tokens do not spell it in either
tokenizer (the second may fold characters); names of special tokens in a text are plain text; a null doc_id is kept;
equal rows are documents of their own; a text of any length is handled whole, and a group that pairs very many tokens
is first summed up by id; no rows in, no rows out. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import batch, stored
from colscope.llm.packing import _encoding, default_tokenizer
from colscope.llm.words import blocks
from colscope.session import skew_join

# Bytes of text in a chunk; links listed at once; a group of more links than this is summed up by id first.
CHUNK, LINKS, WIDE = 2 << 20, 1 << 20, 256
# Bits of an id in a pair, and of a text's number in a chunk.
_BITS = 21
_MASK = (1 << _BITS) - 1


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _byte_tokens(path: str):
    """Encoder of a byte-level BPE file and the length of every token."""
    encoding = _encoding(path)
    sizes = np.zeros(encoding.n_vocab, dtype=np.int64)
    for i in range(encoding.n_vocab):
        try:
            sizes[i] = len(encoding.decode_single_token_bytes(i))
        except KeyError:
            continue
    return encoding, sizes


@lru_cache(maxsize=2)
def _pieces(path: str):
    """Processor of a piece model and the bytes of every piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        spelled.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return model, spelled


def tokens(texts: list[str | None], byte_path: str, piece_path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ends in bytes) by the first and by the second tokenizer of every text, over a space and the text."""
    encoding, sizes = _byte_tokens(byte_path)
    model, spelled = _pieces(piece_path)
    lengths = np.array([len(s) for s in spelled], dtype=np.int64)
    nothing = np.zeros(0, dtype=np.int64)
    for text in texts:
        if not text:
            yield nothing, nothing, nothing, nothing
            continue
        pieces = model.encode(text, num_threads=1)
        if b"".join(map(spelled.__getitem__, pieces)) != b" " + text.encode():
            yield nothing, nothing, nothing, nothing
            continue
        a = encoding.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        b = np.array(pieces, dtype=np.int64)
        yield a, np.cumsum(sizes[a]), b, np.cumsum(lengths[b])


def last_of_group(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the tokens of both sides, which cover the same bytes, the token (of the first side) that ends their group."""
    n = len(ends_a)
    right = np.searchsorted(ends_b, ends_a)  # the other side's token at a token's last byte
    pointer = np.concatenate([
        np.where(ends_b[right] > ends_a, n + right, np.arange(n)) if n else right, np.searchsorted(ends_a, ends_b)
    ])
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer[:n], pointer[n:]
        pointer = further


class Aligned:
    """Tokens of a list of texts, one text after another, and their groups."""

    def __init__(self, texts: list[str | None], byte_path: str, piece_path: str):
        each = list(tokens(texts, byte_path, piece_path))
        count = [np.array([len(x[side]) for x in each], dtype=np.int64) for side in (0, 2)]
        self.first_a, self.first_b = (np.concatenate([[0], np.cumsum(c)]) for c in count)
        size = np.array([x[1][-1] if len(x[1]) else 0 for x in each], dtype=np.int64)
        before = np.cumsum(size) - size
        nothing = [np.zeros(0, dtype=np.int64)]
        self.a, self.b = (np.concatenate(nothing + [x[side] for x in each]) for side in (0, 2))
        self.ends_a, self.ends_b = (np.concatenate(nothing + [x[side] for x in each]) for side in (1, 3))
        self.ends_a += np.repeat(before, count[0])
        self.ends_b += np.repeat(before, count[1])
        last_a, last_b = last_of_group(self.ends_a, self.ends_b)
        ends = last_a == np.arange(len(last_a))
        number = np.cumsum(ends) - 1
        self.group_a, self.group_b = number[last_a], number[last_b]
        self.n_groups = int(ends.sum())
        # the groups of text i are first_group[i] to first_group[i + 1]
        self.first_group = np.concatenate([[0], np.cumsum(ends)])[self.first_a]
        self.wide_a = np.bincount(self.group_a, minlength=self.n_groups)
        self.wide_b = np.bincount(self.group_b, minlength=self.n_groups)

    def links(self) -> np.ndarray:
        """Number of links of every text."""
        return np.diff(np.concatenate([[0], np.cumsum(self.wide_a * self.wide_b)])[self.first_group])

    def _summed(self, group: np.ndarray, ids: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, id, times) by group; equal ids of a wide group are one."""
        many = wide[group]
        if not many.any():
            return group, ids, np.ones(len(ids), dtype=np.int64)
        code, times = np.unique(group[many] << _BITS | ids[many], return_counts=True)
        groups = np.concatenate([group[~many], code >> _BITS])
        order = np.argsort(groups, kind="stable")
        whole = np.concatenate([ids[~many], code & _MASK])
        return groups[order], whole[order], np.concatenate([np.ones(int((~many).sum()), dtype=np.int64), times])[order]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes (text, id of the first, id of the second side) of all links, ascending, and how often each occurs."""
        wide = self.wide_a * self.wide_b > WIDE
        group_a, a, times_a = self._summed(self.group_a, self.a, wide)
        group_b, b, times_b = self._summed(self.group_b, self.b, wide)
        first_b = np.searchsorted(group_b, np.arange(self.n_groups + 1))
        count = np.diff(first_b)[group_a]
        text = np.searchsorted(self.first_group, group_a, side="right") - 1
        total, at, codes, times = np.cumsum(count), 0, [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        while at < len(a):
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + LINKS, side="right")))
            n = count[at:to]
            left = np.repeat(np.arange(at, to), n)
            right = np.arange(len(left)) - np.repeat(total[at:to] - n - done, n) + first_b[group_a[left]]
            code = (text[left] << _BITS | a[left]) << _BITS | b[right]
            weight = times_a[left] * times_b[right]
            if (weight == 1).all():
                code, weight = np.unique(code, return_counts=True)
            else:
                code, own = np.unique(code, return_inverse=True)
                weight = _sums(own, weight, len(code))
            codes.append(code)
            times.append(weight)
            at = to
        if len(codes) <= 2:
            return codes[-1], times[-1]
        code, own = np.unique(np.concatenate(codes), return_inverse=True)
        return code, _sums(own, np.concatenate(times), len(code))

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text: the ids of its groups in order."""
        group = np.concatenate([self.group_a, self.group_b])
        side = np.repeat([0, 1], [len(self.a), len(self.b)])
        order = np.argsort(2 * group + side, kind="stable")
        group, side, ids = group[order], side[order], np.concatenate([self.a, self.b])[order]
        mark = np.zeros(len(ids), dtype=np.int64)  # after an id: none at a text's end, a comma, a bar, a semicolon
        mark[:-1] = np.where(group[1:] != group[:-1], 3, np.where(side[1:] != side[:-1], 2, 1))
        first = self.first_a + self.first_b
        ends = first[1:][np.diff(first) > 0] - 1
        mark[ends] = 0
        known, own = np.unique(ids << 2 | mark, return_inverse=True)
        spelled = [f"{c >> 2}{('', ',', '|', ';')[c & 3]}" for c in known.tolist()]
        parts = list(map(spelled.__getitem__, own.tolist()))
        return ["".join(parts[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _sums(own: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, own, weight)
    return out


def token_groups(documents: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links and ``groups``: the aligned ids of every document, spelled out."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string())])
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = byte_path or default_tokenizer(), piece_path or default_pieces()
        for b in batches:
            for part in blocks(b, limit=CHUNK):
                found = Aligned(part.column("text").to_pylist(), *paths)
                sizes = [np.diff(x) for x in (found.first_a, found.first_b, found.first_group)]
                yield batch(schema, part.column("doc_id"), *sizes, found.links(), found.groups())

    return rows.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string")


_CHUNK_COLUMNS = {"keys": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint",
                  "digests": "string", "sizes": "int", "place": "int", "times": "bigint", "pairs": "bigint", "docs": "int"}
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _chunks(documents: DataFrame, byte_path: str | None, piece_path: str | None) -> DataFrame:
    """A row per chunk: what is known of its texts (keys to sizes), their pairs as places in the chunk's list and how often each is
    linked (place, times), and the list of distinct pairs with the number of texts that hold each (pairs, docs)."""
    schema = pa.schema([("chunk", pa.int64()), *((c, pa.list_(_ARROW[t])) for c, t in _CHUNK_COLUMNS.items())])
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        paths = byte_path or default_tokenizer(), piece_path or default_pieces()
        for b in batches:
            for part in blocks(b, limit=CHUNK):
                found = Aligned(part.column("text").to_pylist(), *paths)
                code, times = found.pairs()
                pairs, place, docs = np.unique(code & ((1 << 2 * _BITS) - 1), return_inverse=True, return_counts=True)
                sizes = np.bincount(code >> 2 * _BITS, minlength=part.num_rows)
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups()]
                counts = [np.diff(x) for x in (found.first_a, found.first_b, found.first_group)]
                values = [part.column("doc_id"), *counts, found.links(), digests, sizes, place, times, pairs, docs]
                lists = []
                for value, kind in zip(values, _CHUNK_COLUMNS.values(), strict=True):
                    flat = value if isinstance(value, pa.Array) else pa.array(value, type=_ARROW[kind], safe=False)
                    lists.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], type=pa.int32()), flat))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], type=pa.int64()), *lists], schema=schema)
                chunk += 1

    kinds = ", ".join(f"{c} array<{t}>" for c, t in _CHUNK_COLUMNS.items())
    return stored(rows.mapInArrow(run, f"chunk bigint, {kinds}"), text=True)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked; best where that is the most of its first id."""
    listed = chunks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.pairs", "p.docs")
    counts = stored(listed.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n")))
    of = F.shiftright("pair", _BITS)
    most = counts.groupBy(of.alias("a")).agg(F.max("n").alias("most"))
    return stored(counts.join(most, of == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def aligned(documents: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in most documents of all of its first
    id), count_sum (documents of the pair, over all links), groups_sha256."""
    chunks = _chunks(documents, byte_path, piece_path)
    rows = chunks.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    found = skew_join(rows, pair_counts(chunks), "pair").select(
        F.col("chunk").alias("of_chunk"), "at", "n", "best"
    )
    texts = chunks.drop("pairs", "docs")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = pa.schema([*((c, pa.int64()) for c in names), ("groups_sha256", pa.string())])

    def attach(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        def flat(name: str) -> pa.Array:
            return chunk.column(name).combine_chunks().flatten()

        n, best = np.zeros(counts.num_rows, dtype=np.int64), np.zeros(counts.num_rows, dtype=np.int64)
        at = counts.column("at").to_numpy()
        n[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
        place, times = flat("place").to_numpy(), flat("times").to_numpy()
        bounds = np.concatenate([[0], np.cumsum(flat("sizes").to_numpy().astype(np.int64))])
        sums = [np.diff(np.concatenate([[0], np.cumsum(v[place] * times)])[bounds]) for v in (best, n)]
        known = [flat(c) for c in ("keys", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*known, *(pa.array(s) for s in sums), flat("digests")], schema=schema)

    return texts.groupBy("chunk").cogroup(found.groupBy("of_chunk")).applyInArrow(
        attach, ", ".join([*(f"{c} bigint" for c in names), "groups_sha256 string"])
    )
