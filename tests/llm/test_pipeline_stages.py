"""Every stage of the pipeline alone: empty tables, nulls, repeats, very long texts and further columns."""

import pytest

import corpus_pipeline
from tests.llm.test_row_keys import near, words

ROWS = [
    (1, " ".join(words(1)), "en", "s1", 1), (2, near(words(1)), "en", "s2", 1), (2, near(words(1)), "en", "s2", 1), (None, " ".join(words(2)), None, None, None), (3, None, "en", "s1", None), (4, "", None, "s3", 0),
    (5, "12 34 !", "en", "s4", 6), (6, " ".join(words(6, 60_000)), "en", "s5", 9), (7, " ".join([*words(7)[:20], *words(99, 30), *words(8)]), "en", "s6", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([(1, " ".join(words(99, 30))), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS row", "2 AS keep", "'x' AS `a.b`") if name == "language_id" else spark.createDataFrame(ROWS, SCHEMA)
    assert stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0
    got = stage(spark, docs, folder)
    rows = got.collect()
    kept = sorted((r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None) if name not in ("packing", "near_dedup") else None
    if name != "packing":
        assert got.columns == corpus_pipeline.COLUMNS
    if name == "language_id":
        assert [d for d, _ in kept] == [1, 2, 2, 6, 7] and sum(r["doc_id"] is None for r in rows) == 1
    elif name == "line_dedup":
        assert len(rows) == len(ROWS) and {r["text"] for r in rows} == {t for _, t, *_ in ROWS}
    elif name == "near_dedup":
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 7] and len(rows) == 7
    elif name == "decontaminate":
        assert len(rows) == len(ROWS) - 1 and 7 not in {r["doc_id"] for r in rows}
    else:
        parts = {}
        for r in rows:
            parts.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert all(sum(n for _, n in own) <= 4096 for own in parts.values()) and sum(r["length"] for r in rows if r["doc_id"] == 6) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 6) > 60_000
        assert sum(r["start"] == 0 for r in rows) == len(ROWS)
