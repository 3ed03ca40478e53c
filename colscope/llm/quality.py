"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives and a sample of unlabelled texts are described by features of their bytes and words; a linear
model minimises ``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))`` with the logistic loss, stepping
against the negative part when it falls below zero. The class prior is estimated first: a plain positive-versus-
unlabelled model is fitted on each half, and on the other half the share of unlabelled texts above a score, divided
by the share of positives above it, is least where only positives are; that ratio bounds the prior from above.

Bounds: ``POSITIVES`` and ``UNLABELLED`` texts are sampled (in expectation; trusted keys by a hash and one row of each, the
others row by row, so that rows of one key count as any others) and only their features reach the driver. Rows are told apart by
their place in the scan, so the same model comes out again for the same files and split size only. Every text is scored whole, by
a model of fixed size.

Defined cases: a null text is empty, an empty or very long text gets a score like any other; a key labelled both ways
is no positive; labels without a document, null labels and repeated rows do no harm; without any positive every
score is 0.5; no rows in, no rows out. doc_id, lang, source and labels are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import batch
from colscope.llm.words import Words, blocks

POSITIVES, UNLABELLED = 4_000, 8_000
PAIRS = 512
# Weight decay; least spread of a feature, so that rare ones are not blown up.
DECAY, FLOOR = 1e-2, 1e-2
_SCALE = 1 << 20
# Bytes of text described at once: features take some fifty bytes of working memory for each.
BLOCK = 1 << 20


def features(texts: pa.Array) -> np.ndarray:
    """One row per text: root shares of bytes and of hashed byte pairs, and shapes of words and lines."""
    words, n = Words(texts), len(texts)
    sizes = np.diff(words.offsets)
    owner = np.repeat(np.arange(n), sizes)
    data = words.data.astype(np.int64)
    size = np.maximum(sizes, 1)[:, None]
    out = [np.sqrt(np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256) / size)]
    if len(data) > 1:
        pair = ((data[:-1] * 256 + data[1:]) * 40503 >> 7) % PAIRS
        inside = owner[:-1] == owner[1:]
        pairs = np.bincount((owner[:-1] * PAIRS + pair)[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    else:
        pairs = np.zeros((n, PAIRS))
    out.append(np.sqrt(pairs / size))
    counts, of = words.counts(), words.text_of()
    count = np.maximum(counts, 1)
    h = words.hashes(True)
    order = np.lexsort((h, of))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=n)
    letters = words.ends - words.starts
    shapes = [
        distinct / count,
        np.bincount(of, weights=letters, minlength=n) / count / 20,
        np.bincount(of, weights=letters > 15, minlength=n) / count,
        np.log1p(counts) / 10,
        counts == 0,
    ]
    return np.hstack([*out, np.array(shapes, dtype=float).T])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 300, decay: float = DECAY):
    """Adam on the non-negative risk; without a prior, plain logistic regression of positives against the rest."""
    total = len(positive) + len(unlabelled)
    centre = (positive.sum(0, dtype=float) + unlabelled.sum(0, dtype=float)) / total
    square = (np.square(positive - centre).sum(0) + np.square(unlabelled - centre).sum(0)) / total
    spread = np.sqrt(square) + FLOOR
    # single precision halves what the driver holds
    p, u = (((rows - centre) / spread).astype(np.float32) for rows in (positive, unlabelled))
    w, first, second = (np.zeros(len(centre) + 1) for _ in range(3))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def mean_slope(rows, slope):
        return np.append((slope.astype(np.float32) @ rows).astype(float), slope.sum()) / len(rows)

    def chances(rows):
        return sigmoid((rows @ w[:-1].astype(np.float32)).astype(float) + w[-1])

    for step in range(1, steps + 1):
        at_p, at_u = chances(p), chances(u)
        if prior is None:
            gradient = mean_slope(p, at_p - 1) + mean_slope(u, at_u)
        else:
            negative = -np.log1p(-np.minimum(at_u, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(at_p, 1 - 1e-12)).mean()
            part = mean_slope(u, at_u) - prior * mean_slope(p, at_p)
            gradient = prior * mean_slope(p, at_p - 1) + part if negative >= 0 else -part
        gradient[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = w[:-1] / spread
    return weights, float(w[-1] - centre @ weights)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of unlabelled to positive texts above a score; each half is judged by a model of the other."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    found = []
    for fold in (0, 1):
        weights, bias = _fit(positive[fold::2], unlabelled[fold::2], None)
        p, u = positive[1 - fold :: 2] @ weights + bias, unlabelled[1 - fold :: 2] @ weights + bias
        cuts = np.quantile(p, np.arange(0.05, 0.61, 0.05))
        found.append(min((u >= c).mean() / (p >= c).mean() for c in cuts))
    return float(np.clip(np.mean(found), 0.05, 0.98))


def fit(documents: DataFrame, positives: DataFrame, most: tuple[int, int] = (POSITIVES, UNLABELLED)) -> Model:
    """``documents`` (doc_id, text) to learn from; ``positives`` (doc_id): the trusted ones among them."""
    counts = [max(1, positives.count()), max(1, documents.count())]
    cuts = [min(_SCALE, int(m / n * _SCALE) + 1) for m, n in zip(most, counts, strict=True)]
    keys = positives.select("doc_id").filter(F.pmod(F.xxhash64("doc_id"), F.lit(_SCALE)) < cuts[0])
    # of the rows of a trusted key one is taken, in expectation
    times = documents.select("doc_id").join(F.broadcast(keys), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    drawn = documents.select(
        "doc_id", "text", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(_SCALE)).alias("mark")
    )
    chosen = drawn.join(F.broadcast(times), "doc_id", "left").select(
        "doc_id", "text", F.coalesce(F.col("mark") * F.col("times") < _SCALE, F.lit(False)).alias("trusted"),
        (F.col("mark") < cuts[1]).alias("unlabelled"),
    ).filter("trusted OR unlabelled")
    schema = pa.schema([("doc_id", pa.int64()), ("trusted", pa.bool_()), ("unlabelled", pa.bool_()), ("x", pa.binary())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, limit=BLOCK):
                x = features(part.column("text")).astype(np.float32)
                yield batch(schema, part.column(0), part.column(2), part.column(3), [row.tobytes() for row in x])

    rows = chosen.mapInArrow(describe, "doc_id bigint, trusted boolean, unlabelled boolean, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id, r.x))
    width = features(pa.array([""])).shape[1]
    sets = []
    for flag in ("trusted", "unlabelled"):
        raw = b"".join(r.x for r in rows if r[flag])
        sets.append(np.frombuffer(raw, dtype=np.float32).reshape(-1, width))
    del rows
    if not len(sets[0]) or not len(sets[1]):
        return Model(np.zeros(width), 0.0, 0.5)
    prior = estimate_prior(*sets)
    return Model(*_fit(*sets, prior), prior)


def score(documents: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``document``, a struct of ``columns``, and ``score``, the probability of good quality, of every document."""
    document = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("document")
    # a text that is carried through anyway travels once
    rows = documents.select(document) if "text" in columns else documents.select(document, "text")
    wide = rows.select("document", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            carried = b.column(0)
            text = carried.field("text") if "text" in columns else b.column(1)
            for part in blocks(pa.RecordBatch.from_arrays([carried, text], ["document", "text"]), limit=BLOCK):
                scores = pa.array(model.scores(features(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("document"), scores], ["document", "score"])

    return rows.mapInArrow(run, wide)


def trusted_positives(labels: DataFrame) -> DataFrame:
    """(doc_id) of the keys whose labels all say quality 1."""
    return labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
