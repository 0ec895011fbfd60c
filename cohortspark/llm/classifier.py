"""Quality classifier: random-indexing word vectors, pooled, under a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    id_and_bytes,
    map_slices,
    pack_array,
    record_batch,
    slices,
    tree_merge,
    unpack_array,
)
from .tokens import groups, mix, token_hashes

#: Words share vectors by hash bucket, so the model has a fixed size.
BUCKET_BITS = 13
DIMENSIONS = 64
#: Non-zero entries of an index vector, and words on either side that count as context.
ENTRIES, CONTEXT = 2, 2
#: Weight a / (a + share) of a word in the pooled vector; frequent words count less.
POOLING = 1e-3
#: Most labelled rows that the network is fitted on, chosen by hash.
MAX_TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 3, 1
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 40, 256, 3e-3, 1e-4, 42
#: Rows of one part of the context matrix on its way to the driver.
PART = 512
#: Tokens whose vectors are gathered at once.
GATHER = 1 << 13


def index_entries(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vector of each word, ``ENTRIES`` a word."""
    parts = np.stack([mix(hashes + np.uint64(n + 1)) for n in range(ENTRIES)], axis=1)
    return (parts % np.uint64(DIMENSIONS)).astype(np.int64), 1 - 2 * (parts >> np.uint64(63)).astype(np.int64)


def add_contexts(total: np.ndarray, parts: list[bytes]) -> None:
    """Add to each word's bucket the index vectors of its neighbours, and one to its count."""
    hashes, piece = token_hashes(parts)
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    places, signs = index_entries(hashes)
    width = DIMENSIONS + 1
    flat = total.reshape(-1)
    size = flat.size
    for step in range(1, CONTEXT + 1):
        near = np.flatnonzero(piece[step:] == piece[:-step])
        for word, other in ((near, near + step), (near + step, near)):
            for n in range(ENTRIES):
                cell = bucket[word] * width + places[other, n]
                flat += np.bincount(cell, signs[other, n], size).astype(np.int64)
    flat += np.bincount(bucket * width + DIMENSIONS, minlength=size)


def context_matrix(docs: DataFrame) -> np.ndarray:
    """Context vectors and counts of all buckets over all rows, summed as a tree."""
    shape = (1 << BUCKET_BITS, DIMENSIONS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for piece in slices(batches):
            for _, parts in groups(piece.column("text").to_pylist()):
                add_contexts(total, parts)
        if total.any():
            rows = [pack_array(total[n : n + PART]) for n in range(0, shape[0], PART)]
            yield record_batch({
                "key": pa.array(range(len(rows)), pa.int32()), "payload": pa.array(rows, pa.binary())
            })

    parts = docs.select("text").mapInArrow(run, "key int, payload binary")
    total = np.zeros(shape, np.int64)
    for row in tree_merge(parts, np.add, "int64").collect():
        total[row.key * PART : (row.key + 1) * PART] = unpack_array(row.payload, "int64").reshape(
            -1, shape[1]
        )
    return total


@dataclass
class WordVectors:
    """Unit context vector and pooling weight of each bucket."""

    vectors: np.ndarray

    @classmethod
    def of(cls, total: np.ndarray) -> WordVectors:
        contexts, counts = total[:, :-1].astype(np.float64), total[:, -1]
        seen = counts.sum() or 1
        mean = contexts.sum(axis=0) / max(1, counts.sum())
        contexts = contexts / np.maximum(counts, 1)[:, None] - mean  # what all words share says nothing
        length = np.linalg.norm(contexts, axis=1, keepdims=True)
        weight = POOLING / (POOLING + counts / seen)
        return cls((contexts / np.where(length > 0, length, 1) * weight[:, None]))

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean and spread of a text's word vectors, and mean size of the step between neighbours.

        The steps tell repeated words from prose, which a mean cannot. All are zero for a text
        without words.
        """
        sums = np.zeros((3, len(texts), DIMENSIONS))
        count = np.zeros(len(texts))
        for numbers, parts in groups(texts):
            hashes, piece = token_hashes(parts)
            bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            owner = np.asarray(numbers)[piece]
            count += np.bincount(owner, minlength=len(texts))
            for at in range(0, len(bucket), GATHER):
                own = slice(at, at + GATHER)
                who = owner[own]
                first = np.flatnonzero(np.diff(who, prepend=-1))
                vectors = self.vectors[bucket[own]]
                before = np.maximum(np.arange(at, at + len(who)) - 1, 0)
                steps = np.abs(vectors - self.vectors[bucket[before]])
                steps[owner[before] != who] = 0
                for n, part in enumerate((vectors, vectors**2, steps)):
                    sums[n][who[first]] += np.add.reduceat(part, first, axis=0)
        mean, square, step = sums / np.maximum(count, 1)[:, None]
        return np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0)), step], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Network:
    """Two layers over standardised features; the temperature calibrates its logits."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((features - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def probability(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(features) / self.temperature)

    @classmethod
    def fit(cls, features: np.ndarray, labels: np.ndarray) -> Network:
        """Adam on the log loss; a fifth of the rows is kept apart for the temperature."""
        rng = np.random.default_rng(SEED)
        size = features.shape[1]
        weights = [
            rng.normal(0, (2 / size) ** 0.5, (size, HIDDEN)), np.zeros(HIDDEN),
            rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(()),
        ]
        if len(labels) == 0 or labels.min() == labels.max():
            # nothing to tell apart: the smoothed share of label 1, 0.5 without labels
            share = (labels.sum() + 1) / (len(labels) + 2)
            flat = [np.zeros_like(w) for w in weights[:3]] + [np.array(np.log(share / (1 - share)))]
            return cls(np.zeros(size), np.ones(size), flat)
        order = rng.permutation(len(labels))
        apart = order[: len(labels) // 5]
        own = order[len(labels) // 5 :]
        scale = features[own].std(axis=0)
        net = cls(features[own].mean(axis=0), np.where(scale > 0, scale, 1), weights)
        x, y = (features[own] - net.mean) / net.scale, labels[own]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
                w1, b1, w2, b2 = weights
                hidden = x[rows] @ w1 + b1
                active = np.maximum(hidden, 0)
                error = (sigmoid(active @ w2 + b2) - y[rows]) / max(1, len(rows))
                back = np.outer(error, w2) * (hidden > 0)
                slopes = [x[rows].T @ back + DECAY * w1, back.sum(axis=0), active.T @ error + DECAY * w2, error.sum()]
                step += 1
                for n, slope in enumerate(slopes):
                    first[n] = 0.9 * first[n] + 0.1 * slope
                    second[n] = 0.999 * second[n] + 0.001 * slope**2
                    move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                    weights[n] = weights[n] - RATE * move
                net.weights = weights
        net.temperature = best_temperature(net.logits(features[apart]), labels[apart]) if len(apart) else 1.0
        return net


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature of least log loss on rows that the weights have not seen."""

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, logits / t) - labels * logits / t))

    return min(np.exp(np.linspace(np.log(0.5), np.log(8), 121)), key=loss)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def training_rows(docs: DataFrame, labels: DataFrame, words: WordVectors) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``MAX_TRAIN_ROWS`` rows outside the held-out fold.

    An id with several labels counts as 1 only if all say so.
    """
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_ROWS)

    def setup():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            pooled = words.pool(piece.column("text").to_pylist())
            return record_batch({
                "doc_id": piece.column("doc_id"), "quality": piece.column("quality"),
                "vector": pa.array([v.astype("<f4").tobytes() for v in pooled], pa.binary()),
            })

        return work

    # the chosen ids have a fixed bound
    labelled = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int"))
    vectors = map_slices(labelled, setup, "doc_id long, quality int, vector binary")
    ranked = vectors.orderBy(F.xxhash64("doc_id", "vector"), "doc_id", "vector").limit(MAX_TRAIN_ROWS).collect()
    if not ranked:
        return np.zeros((0, 3 * DIMENSIONS)), np.zeros(0)
    return np.array([np.frombuffer(r.vector, "<f4") for r in ranked], np.float64), np.array([float(r.quality) for r in ranked])


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, held_out boolean, score double, predicted int`` of every row.

    Word vectors come from the contexts of all words of all rows; the network is fitted on a
    bounded sample of labelled rows outside the held-out fold, its temperature on a part of
    them that the weights have not seen. Only the text enters a score.

    A null text counts as empty; texts without words get the score of a zero vector; a null
    id stays null and is never learnt from; repeated rows count as often as they occur in
    contexts; other columns are not read; without labels, or with one value only, scores are
    the smoothed share of label 1; an empty table gives an empty table. Very long texts
    are pooled whole.
    """
    texts = id_and_bytes(docs, id_col, text_col)
    words = WordVectors.of(context_matrix(texts))
    network = Network.fit(*training_rows(texts, labels, words))

    def setup():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            scores = network.probability(words.pool(piece.column("text").to_pylist()))
            return record_batch({"doc_id": piece.column("doc_id"), "score": pa.array(scores, pa.float64())})

        return work

    scored = map_slices(texts, setup, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
