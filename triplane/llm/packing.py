"""Sequence packing as a cutting-stock problem solved by column generation.

Texts are encoded, an end id is added, and documents longer than a sequence are cut at whole
sequences; what remains are pieces of 1 to ``capacity`` tokens.  Lengths fall into classes (exact up to 128,
then 64 per octave, named by their upper end), and the classes' histogram - a table of bounded size -
is the demand of a linear program over patterns (multisets of classes that fit a sequence):

* the restricted master program starts from a greedy packing's patterns and is solved by a revised simplex method,
* an unbounded-knapsack dynamic program over the smoothed duals prices new patterns, many from each table,
* generation ends when the dual bound proves the relative gap to be under ``gap`` (or after ``rounds``),
* rounded-down pattern counts are used as they are, and the residual demand, which does not grow with the
  input, is packed largest class first.

Pieces are ranked within their class in a distributed way, and a bounded pattern table turns
(class, rank) into a sequence.  Only histograms reach the driver.

Defined results: null text is empty and packs as its end id alone; rows with equal or null doc_ids are
packed separately (ids are carried, never used as a key); an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triplane.llm import scratch
from triplane.llm.tokens import encoder, with_end
from triplane.llm.words import chunks

EXACT_BITS = 6


def length_class(n: np.ndarray) -> np.ndarray:
    """Upper end of each length's class: 2**EXACT_BITS classes an octave."""
    octave = np.frexp(n.astype(np.float64))[1] - 1  # exact floor(log2(n))
    width = 1 << np.maximum(octave - EXACT_BITS, 0)
    return -(-n // width) * width


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for first, end, buf, offsets in chunks(batch.column(1)):
                ids, bounds = with_end(*encode(buf, offsets), end_id)
                n = np.diff(bounds)
                parts = -(-n // capacity)
                doc = np.repeat(np.arange(end - first), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
                length = np.minimum(n[doc] - start, capacity)
                raw = ids.astype("<u4").tobytes()
                at = (bounds[doc] + start) * 4
                crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(at.tolist(), (length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first).take(pa.array(doc)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crc, pa.int64()),
                        pa.array(n[doc]),
                        pa.array(length_class(length).astype(np.int32)),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls"],
                )

    return run


def knapsack(width: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity with any number of each item, and the item taken last (-1: none).

    ``width`` ascends.
    """
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(width, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = fits[c]
        if not k:
            continue
        gain = best[c - width[:k]] + value[:k]
        at = int(gain.argmax())
        best[c], taken[c] = gain[at], at
        if best[c - 1] > best[c]:
            best[c], taken[c] = best[c - 1], -2
    return best, taken


def _pattern(width: np.ndarray, taken: np.ndarray, item: int, capacity: int) -> np.ndarray:
    out = np.zeros(len(width))
    out[item] = 1
    c = capacity - int(width[item])
    while c > 0 and taken[c] != -1:
        if taken[c] == -2:
            c -= 1
            continue
        out[taken[c]] += 1
        c -= int(width[taken[c]])
    return out


def greedy(width: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns [(count of each class, times)] that use all demand, largest class first."""
    left, out = demand.astype(np.int64).copy(), []
    while left.any():
        room, counts = capacity, np.zeros_like(left)
        for k in range(len(width) - 1, -1, -1):
            if left[k] and width[k] <= room:
                counts[k] = min(int(left[k]), room // int(width[k]))
                room -= int(counts[k] * width[k])
        some = counts > 0
        times = int((left[some] // counts[some]).min())
        left -= counts * times
        out.append((counts, times))
    return out


def patterns(width: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 300, each: int = 20, smoothing: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: (patterns as rows, fractional use) of an LP solution within ``gap`` of the optimum.

    The first columns are the greedy packing's.  Prices are the duals smoothed towards those of the
    best bound so far (at the start, the share of a sequence that a class fills).
    """
    m = len(width)
    basis = np.diag((capacity // width).astype(float))
    inverse = np.diag(1.0 / basis.diagonal())
    use = inverse @ demand

    def enter(column: np.ndarray) -> bool:
        """Bring a pattern of negative reduced cost into the basis."""
        nonlocal use
        some = np.flatnonzero(column)
        if column[some] @ inverse[:, some].sum(axis=0) <= 1 + 1e-6:
            return False
        rate = inverse[:, some] @ column[some]
        ratio = np.full(m, np.inf)
        ok = rate > 1e-9
        ratio[ok] = use[ok] / rate[ok]
        out = int(ratio.argmin())
        step = max(float(ratio[out]), 0.0)
        use = np.maximum(use - step * rate, 0)
        use[out] = step
        row = inverse[out] / rate[out]
        moved = np.flatnonzero(np.abs(rate) > 1e-12)
        inverse[moved] -= np.outer(rate[moved], row)
        inverse[out] = row
        basis[:, out] = column
        return True

    for counts, _ in greedy(width, demand, capacity):
        enter(counts.astype(float))
    best = width / capacity
    bound = float(demand @ best)
    for _ in range(rounds):
        if use.sum() <= bound * (1 + gap):
            break
        price = np.maximum(smoothing * best + (1 - smoothing) * inverse.sum(axis=0), 0)
        value, taken = knapsack(width, price, capacity)
        scaled = price / max(1.0, float(value[capacity]))  # feasible duals: no pattern is worth over 1
        if demand @ scaled > bound:
            bound, best = float(demand @ scaled), scaled
        gains = price + value[capacity - width]
        entered = [enter(_pattern(width, taken, item, capacity)) for item in np.argsort(-gains)[:each].tolist()]
        if not any(entered):
            smoothing /= 2
            if smoothing < 0.01:
                break
    return basis.T, use


def plan(width: np.ndarray, demand: np.ndarray, capacity: int, **how) -> list[tuple[np.ndarray, int]]:
    """Whole patterns [(count of each class, times)] that use every piece exactly once."""
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    if len(width):
        found, use = patterns(width, demand.astype(float), capacity, **how)
        for counts, times in zip(found.astype(np.int64), np.floor(use + 1e-6).astype(np.int64), strict=True):
            some = counts > 0
            times = min(int(times), int((left[some] // counts[some]).min()))
            if times > 0:
                left -= counts * times
                out.append((counts, times))
    return out + greedy(width, left, capacity)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, **how) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    scratch.ship(spark)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    pieces = scratch.keep(rows.mapInArrow(_pieces(tokenizer, end_id, capacity), schema), "pieces")
    histogram = sorted((r["cls"], r["n"]) for r in pieces.groupBy("cls").agg(F.count("*").alias("n")).collect())
    width = np.array([w for w, _ in histogram], np.int64)
    table, sequences, done = [], 0, np.zeros(len(width), np.int64)
    for counts, times in plan(width, np.array([n for _, n in histogram], np.int64), capacity, **how):
        for k in np.flatnonzero(counts).tolist():
            low = int(done[k])
            done[k] += counts[k] * times
            table.append((int(width[k]), low, int(done[k]), int(counts[k]), sequences))
        sequences += times
    # At most 2 * classes patterns of few classes each: a bound that no input moves.
    places = F.broadcast(spark.createDataFrame(table, "p_cls int, low long, high long, each long, first long"))
    ranks = scratch.ranked(pieces, "cls", ["doc_id", "start", "doc_tokens", "ids_crc32"], "rank")
    placed = ranks.join(places, (F.col("cls") == F.col("p_cls")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")).cast("long"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
