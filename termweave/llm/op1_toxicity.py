"""Toxicity: averaged subword embeddings under a linear softmax, trained in numpy.

A word is the bag of its character n-grams (3 to 6, with word bounds), hashed into
``2 ** BITS`` rows of an embedding matrix. The embeddings of a span of ``SPAN``
words are averaged; a linear softmax on the average gives the span's two class
probabilities. Embeddings and softmax are trained together. A spelling never seen
shares most n-grams, and so its vectors, with the spelling it comes from.

A document is toxic if one of its spans is, so its score is that of its highest
span, put through a logistic curve fitted on the training documents. Labels belong
to documents: training begins with all spans of a toxic document as toxic and then
keeps those that the model itself ranks highest.

The model is fitted on a sample of at most ``max_toxic`` + ``max_clean`` labelled
documents, the first by a hash of their ids, of texts up to ``max_chars``
characters. Scoring reads every text whole, in spans, on the executors; the model
is sent to them as one number per row (the embedding times the difference of the
two softmax rows), a few MB at any input size.

A null or empty text has no span and gets the score of an average of zero. With no
label of one class, all scores are 0. Repeated rows get equal scores. Other columns
of the input are ignored.

An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import crc_of_id
from termweave.llm.subwords import code_points, grams, slices

BITS = 18
DIM = 8
SPAN = 24
SHORTEST, LONGEST = 3, 6
#: A span of fewer n-grams is filled up with zero vectors.
LEAST = 150
SLICE_CHARS = 1 << 18
BATCH = 256
#: Least number of batches in a round of training.
STEPS = 120
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64))


@dataclass(frozen=True)
class Model:
    """``weights``: a number per hash; ``bias``: of the softmax; ``curve``: slope and place of the logistic curve."""

    weights: np.ndarray
    bias: float
    curve: tuple[float, float]


def spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For every n-gram its row and span; for every span its document; the number of spans."""
    points, starts = code_points(texts)
    begins = np.zeros(len(points), bool)
    begins[1:] = (points[1:] != 32) & (points[:-1] == 32)
    word = np.cumsum(begins)  # at each place, the words begun so far
    before = word[starts[:-1]]
    counts = word[np.minimum(starts[1:], len(points) - 1)] - before
    per_doc = np.maximum(counts // SPAN, counts > 0)  # what is left over belongs to the last span
    first = np.concatenate([[0], np.cumsum(per_doc)])
    doc_of_word = np.repeat(np.arange(len(texts)), counts)
    at_word = np.arange(int(counts.sum()))
    number = np.minimum((at_word - before[doc_of_word]) // SPAN, per_doc[doc_of_word] - 1)
    span_of_word = first[doc_of_word] + number
    # A word counts once in a span, however often it is repeated.
    word_starts = np.flatnonzero(begins)
    place = np.arange(len(points)) - np.where(word > 0, word_starts[np.maximum(word - 1, 0)], 0) if len(word_starts) else word
    held = np.where(points == 32, 0, points.astype(np.uint64) * _POWERS[np.minimum(place, len(_POWERS) - 1)])
    key = np.add.reduceat(held, word_starts) if len(word_starts) else held[:0]
    key = key * np.uint64(0x9E3779B97F4A7C15) + span_of_word.astype(np.uint64)
    counted = np.zeros(len(key), bool)
    counted[np.unique(key, return_index=True)[1]] = True
    rows, owners = [], []
    for at, h in grams(points, SHORTEST, LONGEST):
        own = np.where(points[at] == 32, at + 1, at)  # an n-gram that begins with the bound belongs to the next word
        of = word[own] - 1
        use = counted[of]
        rows.append((h[use] >> np.uint32(32 - BITS)).astype(np.int32))
        owners.append(span_of_word[of[use]].astype(np.int32))
    return np.concatenate(rows), np.concatenate(owners), np.repeat(np.arange(len(texts)), per_doc), int(first[-1])


def span_scores(texts: list[str], weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    rows, owners, docs, n = spans(texts)
    total = np.bincount(owners, weights[rows], n)
    return total / np.maximum(np.bincount(owners, minlength=n), LEAST) + bias, docs


def raw_scores(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The highest span's log odds of each document."""
    out = np.full(len(texts), -np.inf)
    for a, b in slices([len(t) for t in texts], SLICE_CHARS):
        scores, docs = span_scores(texts[a:b], weights, bias)
        np.maximum.at(out, docs + a, scores)
    return np.where(np.isinf(out), bias, out)


class _Trainer:
    """Embeddings and softmax under Adagrad, on spans given as rows of n-gram indexes."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
        self.out = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seen = [np.full(1 << BITS, 1e-6, np.float32), np.full((2, DIM), 1e-6, np.float32), np.full(2, 1e-6, np.float32)]
        self.rng = rng

    def step(self, rows, owners, n, labels, rate: float) -> None:
        counts = np.maximum(np.bincount(owners, minlength=n), LEAST).astype(np.float32)
        vectors = self.table[rows]
        edges = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        mean = np.zeros((n, DIM), np.float32)
        mean[owners[edges]] = np.add.reduceat(vectors, edges, axis=0)
        mean /= counts[:, None]
        logits = mean @ self.out.T + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), labels] -= 1
        p /= n
        to_out, to_bias = p.T @ mean, p.sum(0)
        to_mean = (p @ self.out) / counts[:, None]
        used, inverse = np.unique(rows, return_inverse=True)
        grad = np.stack([np.bincount(inverse, to_mean[owners, d], len(used)) for d in range(DIM)], 1).astype(np.float32)
        self.seen[0][used] += (grad * grad).mean(1)
        self.table[used] -= rate * grad / np.sqrt(self.seen[0][used])[:, None]
        self.seen[1] += to_out * to_out
        self.out -= rate * to_out / np.sqrt(self.seen[1])
        self.seen[2] += to_bias * to_bias
        self.bias -= rate * to_bias / np.sqrt(self.seen[2])

    def epoch(self, texts: list[list], labels: np.ndarray, rate: float, batch: int = BATCH) -> None:
        order = self.rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            rows = np.concatenate([texts[i] for i in pick])
            owners = np.repeat(np.arange(len(pick)), [len(texts[i]) for i in pick])
            if len(rows):
                self.step(rows, owners, len(pick), labels[pick], rate)

    def weights(self) -> tuple[np.ndarray, float]:
        return self.table @ (self.out[1] - self.out[0]), float(self.bias[1] - self.bias[0])


def _curve(raw: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by damped Newton steps."""
    scale = max(float(raw.std()), 1e-6)
    x = np.stack([raw / scale, np.ones(len(raw))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w -= np.clip(np.linalg.solve(hess, x.T @ (weight * (p - toxic)) + 1e-2 * w), -2, 2)
    return float(w[0] / scale), float(w[1])


def fit(texts: list[str], toxic: np.ndarray, toxic_rate: float, rounds: int = 4, clean_spans: int = 6) -> Model:
    """Train on labelled texts. ``toxic_rate``: the share of toxic documents among all that are labelled."""
    if len(texts) == 0 or toxic.min() == toxic.max():
        return Model(np.zeros(1 << BITS, np.float32), -40.0, (1.0, 0.0))
    bags, owner = [], []
    for a, b in slices([len(t) for t in texts], SLICE_CHARS):
        rows, own, docs, n = spans(texts[a:b])
        order = np.argsort(own, kind="stable")
        bags += np.split(rows[order], np.cumsum(np.bincount(own, minlength=n))[:-1])
        owner.append(docs + a)
    owner = np.concatenate(owner)
    span_toxic = toxic[owner].astype(np.int64)
    trainer = _Trainer()
    use = np.arange(len(bags))
    for round_ in range(rounds):
        clean = use[span_toxic[use] == 0]
        hit = use[span_toxic[use] == 1]
        if round_:
            weights, bias = trainer.weights()
            score = np.array([weights[b].sum() / max(len(b), LEAST) for b in bags])
            trainer = _Trainer(round_)  # afresh: what the other spans of toxic documents taught is noise
            # Of a toxic document the spans near its best, of a clean one its best spans and some at random.
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, owner, score)
            rank = np.argsort(np.lexsort((-score, owner))) - np.searchsorted(owner, owner)
            hit = np.flatnonzero((span_toxic == 1) & (score >= best[owner] - 1e-9) | (span_toxic == 1) & (score + bias > 0))
            clean = np.flatnonzero((span_toxic == 0) & ((rank < 2) | (trainer.rng.random(len(bags)) < 0.3)))
        else:
            order = trainer.rng.permutation(clean)
            clean = order[: max(len(hit), clean_spans * len(texts))]
        pick = np.concatenate([hit, clean])
        labels = np.concatenate([np.ones(len(hit), np.int64), np.zeros(len(clean), np.int64)])
        chosen = [bags[i] for i in pick]
        for _ in range(max(2, -(-STEPS * BATCH // max(1, len(chosen))))):
            trainer.epoch(chosen, labels, 0.2)
    weights, bias = trainer.weights()
    raw = raw_scores(texts, weights, bias)
    weight = np.where(toxic == 1, toxic_rate / toxic.mean(), (1 - toxic_rate) / (1 - toxic.mean()))
    return Model(weights.astype(np.float32), bias, _curve(raw, toxic, weight))


def train(
    docs: DataFrame, labels: DataFrame, max_toxic: int = 2500, max_clean: int = 4000, max_chars: int = 20_000
) -> Model:
    """Fit on a bounded sample of the labelled documents whose id is not held out."""
    known = labels.where(labels["toxic"].isin(0, 1) & (crc_of_id(labels["doc_id"]) % 4 != 2)).select("doc_id", "toxic")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = lambda value, n: known.where(F.col("toxic") == value).orderBy(*order).limit(n)
    chosen = pick(1, max_toxic).unionAll(pick(0, max_clean))  # bounded by the two limits
    texts = docs.where(F.length("text") <= max_chars).select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = sorted(rows.collect())
    toxic = np.array([r["toxic"] for r in found], np.int64)
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([r["text"] for r in found], toxic, rate)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        slope, offset = m.curve
        for batch in batches:
            texts = [b.decode("utf-8", "replace") for b in batch.column(2).to_pylist()]
            raw = raw_scores(texts, m.weights, m.bias)
            p = 1 / (1 + np.exp(-np.clip(slope * raw + offset, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        "doc_id",
        (crc_of_id(docs["doc_id"]) % 4 == 2).alias("held_out"),
        F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
