"""A training-data pipeline over ``documents``: five stages, each one operator of ``triplane.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's rows as
Parquet into the shared scratch folder and rereads them as the next one's docs.  All stages but
the last return the columns of ``documents``:

* language_id drops documents of no language (``und``: null text, or no letter),
* line_dedup cuts repeated cross-site lines out of the texts (a spread line stays at its first place),
* near_dedup keeps one document of every near-duplicate group (five-word shingles, similarity 0.8),
* decontaminate drops documents that hold a ten-word window of a benchmark item,
* packing returns the packed pieces of what is left.

near_dedup and decontaminate judge every row by itself, under a row key, also where doc_id is null or
repeated; of a near-duplicate group the row with the least doc_id stays (null is last).  Texts are read
whole, however long; null and letterless texts go in the first stage; further columns of
``documents``, whatever their names, are left behind by the first stage.  Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.llm import language, scratch
from triplane.llm.decontaminate import decontaminate
from triplane.llm.line_dedup import line_dedup
from triplane.llm.near_dedup import near_dedup
from triplane.llm.packing import pack
from triplane.llm.queries import MIN_SITES, PIECES, TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.identify(docs, language.fit(docs, PIECES))
    return found.where(F.col("lang_pred") != "und").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs, MIN_SITES).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with a key of each row, kept in the shared folder, and the same rows with the key as doc_id."""
    rows = scratch.keep(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    return rows, rows.select(F.col("row").alias("doc_id"), "text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, own = keyed(docs)
    found = near_dedup(own).select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    stays = found.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(stays, "row", "left_semi").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, own = keyed(docs)
    found = decontaminate(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("row"))
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, TOKENIZER, 4096, 2)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]

#: The tokenizer, the language model and MinHash have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.forget(before)
        before = docs
    return docs
