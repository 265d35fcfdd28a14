"""Rows without a doc_id and rows that share one."""

import random

SCHEMA = "doc_id long, text string"


def words(seed: int, n: int = 80) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def near(own: list[str]) -> str:
    return " ".join([*own[:-1], "changed"])


def test_pipeline_judges_rows_without_an_id(spark):
    import corpus_pipeline

    a, b, c = words(1), words(2), words(3)
    rows = [(None, " ".join(a)), (None, near(a)), (5, near([*a[:-2], "x", "y"])), (None, " ".join(b)), (None, " ".join(b)), (7, " ".join(c)), (7, near(b)), (7, "alone under an id that others have"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "'a' AS lang", "'s' AS source", "1L AS n_chars")
    got = corpus_pipeline.near_stage(spark, docs, "").collect()
    want = [(5, rows[2][1]), (7, " ".join(c)), (7, near(b)), (7, rows[7][1]), (None, None), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


def test_pipeline_decontaminates_rows_without_an_id(spark, tmp_path):
    import corpus_pipeline

    a, b = words(4), words(5)
    spark.createDataFrame([(1, " ".join(a[20:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, " ".join(a)), (None, " ".join(b)), (3, near(a)), (3, near(b)), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "'a' AS lang", "'s' AS source", "1L AS n_chars")
    got = corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
