"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from triplane.llm import language, scratch, sql, toxicity
from triplane.llm.decontaminate import decontaminate
from triplane.llm.exact_dedup import exact_dedup
from triplane.llm.line_dedup import line_dedup
from triplane.llm.near_dedup import near_dedup
from triplane.llm.packing import pack
from triplane.llm.sharding import shard_documents
from triplane.llm.token_files import read_tokens, write_tokens
from triplane.llm.url_filter import url_filter

#: (action, host, path) of the url rules.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MIN_SITES = 8
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document's crc32(doc_id as text) leaves this remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER, 4096, 2)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), size=3, percent=85)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.fit(docs.where(~held_out(5, 0)), table(spark, sf_dir, "labels").where(~held_out(5, 0)).select("doc_id", "toxic"))
    scored = toxicity.score(docs, weights)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out(3, 1)), PIECES)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 24)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(table(spark, sf_dir, "documents"), TOKENIZER, scratch.new_path(spark, "tokens"), 1)
    return read_tokens(spark, manifest)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), MIN_SITES)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1,
    "op2_url_filter": op2,
    "op3_near_dedup": op3,
    "op4_toxicity": op4,
    "op5_language_id": op5,
    "op6_kd_sharding": op6,
    "op7_decontaminate": op7,
    "op8_token_files": op8,
    "op9_exact_dedup": op9,
    "op10_line_dedup": op10,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": sql.URLS,
    "op3_near_dedup": sql.NEAR,
    "op7_decontaminate": sql.LEAKS,
    "op9_exact_dedup": sql.EXACT,
    "op10_line_dedup": sql.LINES,
}
