"""Exact deduplication by content-defined chunk recipes.

Every text is cut where a rolling hash of its own bytes says so; a document becomes an ordered list
of chunk identifiers (its recipe).  Identifiers are 64-bit hashes, verified over the whole corpus
against 128-bit digests of the chunks' bytes; should one identifier stand for two contents, the
digests take its place everywhere.  Documents are equal when their identifier lists are equal, so
only lists of about 1/100 of the bytes are shuffled and long documents never move.

Defined results: null text counts as empty; an empty text has the empty recipe; rows with a null
doc_id join their group but lose to any id (all null: keep_id is null and every row is kept);
repeated rows keep all rows with the kept id.  An empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.llm import scratch
from triplane.llm.words import Prefix, chunks, mix

_U = np.uint64


def cut_points(buf: np.ndarray, offsets: np.ndarray, prefix: Prefix, window: int, bits: int, least: int, most: int) -> list[list[int]]:
    """Chunk ends of each text; they depend on the text's own bytes alone."""
    n = len(buf)
    marks = np.zeros(0, np.int64)
    if n >= window:
        ends = np.arange(window, n + 1)
        rolling = mix(prefix.raw(ends - window, ends))
        marks = ends[(rolling >> _U(64 - bits)) == 0]
    out = []
    first = np.searchsorted(marks, offsets[:-1] + window)
    last = np.searchsorted(marks, offsets[1:])
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), last.tolist(), strict=True):
        own, ends_, at = marks[i:j].tolist(), [], a
        while b - at > least:
            k = bisect_left(own, at + least)
            end = min(own[k] if k < len(own) else b, at + most, b)
            ends_.append(end)
            at = end
        if at < b:
            ends_.append(b)
        out.append(ends_)
    return out


def _recipes(window: int, bits: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for first, end, buf, offsets in chunks(texts):
                prefix = Prefix(buf)
                cuts = cut_points(buf, offsets, prefix, window, bits, least, most)
                ends = np.array([e for own in cuts for e in own], np.int64)
                counts = np.array([len(own) for own in cuts])
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                ids = prefix.hash(starts, ends).view(np.int64)
                raw = buf.tobytes()
                digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                place = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(sha),
                        pa.ListArray.from_arrays(place, pa.array(ids)),
                        pa.ListArray.from_arrays(place, pa.array(digests, pa.binary())),
                    ],
                    names=["doc_id", "text_sha256", "ids", "digests"],
                )

    return run


def exact_dedup(docs: DataFrame, window: int = 48, bits: int = 10, least: int = 256, most: int = 8192) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    scratch.ship(docs.sparkSession)
    schema = "doc_id long, text_sha256 string, ids array<long>, digests array<binary>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = scratch.keep(rows.mapInArrow(_recipes(window, bits, least, most), schema), "recipes")
    seen = rows.select(F.explode(F.arrays_zip("ids", "digests")).alias("c"))
    seen = seen.groupBy(F.col("c.ids").alias("id")).agg(F.min("c.digests").alias("lo"), F.max("c.digests").alias("hi"))
    verified = seen.where("lo <> hi").limit(1).count() == 0
    rows = rows.withColumn("recipe", F.col("ids") if verified else F.col("digests"))
    groups = rows.groupBy("recipe").agg(
        F.max("doc_id").alias("keep_id"),
        F.count("*").alias("group_size"),
        F.min("text_sha256").alias("lo"),
        F.max("text_sha256").alias("hi"),
    )
    # Written out, so that both sides of the join are plain shuffles and a hot recipe's rows can be split.
    out = rows.join(scratch.keep(groups, "groups"), "recipe")
    same = F.coalesce(F.assert_true(F.col("lo") == F.col("hi"), F.lit("texts of one recipe differ")).cast("boolean"), F.lit(True))
    return out.where(same).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.size("ids").alias("n_chunks"),
    )
