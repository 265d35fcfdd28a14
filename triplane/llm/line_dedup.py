"""Cross-site line deduplication by distinct-site spread, with DataFrame functions only.

A line that stands on many sites is boilerplate.  Per line hash a HyperLogLog sketch of its sites is
built and merged by aggregation; an estimate clear of the threshold decides, and lines near it
get exact distinct counts.  A spread line stays once, at its smallest (doc_id, position), and goes
everywhere else; texts are put together again from the lines that stay.

Defined results: a null text has no lines and stays null; empty lines and lines of spaces alone are
never removed; a null source is no site, a null doc_id sorts after all ids; rows that repeat both
doc_id and text are treated alike, so a first place stays in each of them.  A document left without
lines has the empty text.  An empty table gives no rows.  All input columns pass through unchanged,
whatever their names, but for ``text``; the operator's own columns ``n_lines`` and ``n_removed``
replace input columns of these names in any case.

Rows are told apart by a 128-bit digest of doc_id and text, made once a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.llm import scratch

LG_K = 12
#: Relative error that a sketch with LG_K may show, with a wide margin (about 6 standard errors).
MARGIN = 0.1


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """Line hashes on at least min_sites distinct sites, each with its first place."""
    # The frequency bound is lossless: min_sites distinct sites need min_sites rows.
    sketched = lines.groupBy("line").agg(
        F.count("site").alias("n"),
        F.hll_sketch_agg(F.xxhash64("site"), F.lit(LG_K)).alias("sketch"),
        F.min("place").alias("first"),
    )
    rated = sketched.where(F.col("n") >= min_sites).select("line", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    rated = scratch.keep(rated.where(F.col("sites") >= min_sites * (1 - MARGIN)), "spread")
    clear = F.col("sites") > min_sites * (1 + MARGIN)
    near = rated.where(~clear)
    exact = (
        lines.join(near.select("line"), "line", "left_semi")
        .groupBy("line", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("line")
        .agg(F.count("site").alias("exact"))
        .where(F.col("exact") >= min_sites)
    )
    return rated.where(clear).select("line", "first").unionByName(near.join(exact, "line").select("line", "first"))


def line_dedup(docs: DataFrame, min_sites: int = 10, site: str = "source") -> DataFrame:
    """All input columns with ``text`` without repeated spread lines, plus n_lines and n_removed."""
    own = ("n_lines", "n_removed")
    columns = [c for c in docs.columns if c.lower() not in own]
    row_key, gone_at = scratch.unused(docs.columns, "row_key", "gone")
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))))
    rows = docs.where(F.col("text").isNotNull()).select(F.col(f"`{site}`").alias("site"), F.col("doc_id").cast("long").alias("doc"), key.alias("row_key"), F.split("text", "\n", -1).alias("parts"))
    lines = rows.select("site", "doc", "row_key", F.posexplode("parts").alias("pos", "content"))
    lines = lines.where(F.trim("content") != "").select(
        F.unhex(F.md5("content")).alias("line"),
        "site",
        F.struct(F.col("doc").isNull().alias("none"), "doc", "pos", "row_key").alias("place"),
    )
    spread = spread_lines(lines, min_sites)
    hits = lines.join(spread, "line").where(F.col("place") != F.col("first"))
    # Rows that repeat doc_id and text give the same places again: a set holds each once.
    gone = hits.groupBy(F.col("place.row_key").alias(row_key)).agg(F.collect_set("place.pos").alias(gone_at))
    split, at = F.split("text", "\n", -1), F.col(gone_at)
    rest = F.filter(split, lambda _, i: ~F.array_contains(at, i))
    out = docs.select(*[F.col(f"`{c}`") for c in columns], key.alias(row_key)).join(gone, row_key, "left")
    text = F.when(at.isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return out.select(
        *[text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_removed"),
    )
