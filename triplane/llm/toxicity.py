"""Toxicity scoring: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is its set of words, word pairs and skip-grams (pairs with one or two words between), hashed
to 2**BITS coordinates.  A longer word also counts by its stems, its first 3 to 8 bytes, under coordinates
of their own: inflected forms share them, while a short word is not taken for the start of another.  Training is online with per-coordinate learning rates; L1 leaves few weights, and
those are broadcast.  The model is fitted on a bounded, documented sample of labelled rows (``bound``: the
expected number, taken by a hash of doc_id; ``most_bytes``: the expected bytes of their texts, taken by a
second hash), in one task that holds at most the sample.

Defined results: null and empty texts score the bias alone; rows without a label or with a
null one do not train; several labels of one document train with the largest; repeated rows are
scored alike and train once each; texts of any length are scored whole; without any usable label every
score is 0.5; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.llm import scratch
from triplane.llm.words import ALNUM, Words, chunks, mix

BITS = 20
BIAS = 1 << BITS
GAPS = (2, 3)
#: Bytes of the stems of a longer word.
STEMS = range(3, 9)
_U = np.uint64


def hashed(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word number, coordinate) lists of words, stems, pairs and skip-grams."""
    h, shift = words.hashes, _U(64 - BITS)
    last = np.repeat(words.docs[1:], np.diff(words.docs))
    out = [(np.arange(len(h)), (mix(h) >> shift).astype(np.int64))]
    for length in STEMS:
        at = np.flatnonzero(words.ends - words.starts > length)
        stem = words.prefix.hash(words.starts[at], words.starts[at] + length)
        out.append((at, (mix(stem ^ _U(0xA0761D6478BD642F)) >> shift).astype(np.int64)))
    for gap in (1, *GAPS):
        at = np.flatnonzero(np.arange(len(h)) + gap < last)
        pair = mix(h[at] * _U(0x9E3779B97F4A7C15 + 2 * gap) + h[at + gap])
        out.append((at, (pair >> shift).astype(np.int64)))
    return out


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, buf, offsets in chunks(batch.column(1)):
            words = Words(buf, offsets, ALNUM)
            parts = hashed(words)
            at, coordinate = np.concatenate([a for a, _ in parts]), np.concatenate([c for _, c in parts])
            text = np.searchsorted(words.docs, at, "right") - 1
            pairs = np.unique(text * (1 << BITS) + coordinate)
            place = np.searchsorted(pairs >> BITS, np.arange(end - first + 1))
            own = pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array((pairs & (BIAS - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), own], names=["order", "toxic", "coordinates"]
            )


class Ftrl:
    """Per-coordinate FTRL-proximal state with L1 and L2."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _train(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            lists = batch.column(2)
            rows += [(y, np.append(lists[k].values.to_numpy(), BIAS)) for k, y in enumerate(batch.column(1).to_pylist())]
        if not rows:
            return
        model = Ftrl()
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)).tolist():
                model.learn(rows[k][1], rows[k][0])
        at = np.flatnonzero(model.weights(np.arange(BIAS + 1)))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(model.weights(at))], names=["coordinate", "weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = 10_000, epochs: int = 3, most_bytes: int = 64 << 20) -> dict[int, float]:
    """Sparse weights from about ``bound`` labelled documents."""
    scratch.ship(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    many = known.count()
    share = min(1.0, bound / max(1, many))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(known, "doc_id")
    rows = scratch.keep(rows.select(F.xxhash64("doc_id", "text").alias("order"), "text", "y"), "sample")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > most_bytes:
        rows = rows.where(F.pmod(F.xxhash64("order"), F.lit(1 << 30)) < int(most_bytes / size * (1 << 30)))
    rows = rows.mapInArrow(_train_rows, "order long, toxic int, coordinates array<int>")
    rows = rows.repartition(1).sortWithinPartitions("order")
    return {r["coordinate"]: r["weight"] for r in rows.mapInArrow(_train(epochs), "coordinate long, weight double").collect()}


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sparse = held.value
        weight = np.zeros(BIAS + 1)
        weight[list(sparse)] = list(sparse.values())
        live = weight != 0
        for batch in batches:
            for first, end, buf, offsets in chunks(batch.column(1)):
                words = Words(buf, offsets, ALNUM)
                at, coordinate = [], []
                for a, c in hashed(words):
                    used = live[c]
                    at.append(a[used])
                    coordinate.append(c[used])
                text = np.searchsorted(words.docs, np.concatenate(at), "right") - 1
                pairs = np.unique(text * (1 << BITS) + np.concatenate(coordinate))
                total = np.bincount(pairs >> BITS, weight[pairs & (BIAS - 1)], end - first) + weight[BIAS]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=["doc_id", "score"]
                )

    return run


def score(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """doc_id and score of every document."""
    scratch.ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights)  # at most 2**BITS + 1 entries
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_score(held), "doc_id long, score double")
