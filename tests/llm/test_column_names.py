"""Extra columns, whatever their names, pass through or are ignored."""

from triplane.llm import language
from triplane.llm.line_dedup import line_dedup
from triplane.llm.queries import PIECES


def test_line_dedup_columns(spark):
    schema = "doc_id long, text string, source string, `_k` string, `_gone` int, `a.b` string, `N_LINES` string, row_key string, gone string, `Row_Key2` string"
    rows = [(k, f"shared\nown {k}", f"s{k}", "k", 7, "dot", "clash", "r", "g", "z") for k in range(12)]
    got = line_dedup(spark.createDataFrame(rows, schema), 8)
    assert got.columns == ["doc_id", "text", "source", "_k", "_gone", "a.b", "row_key", "gone", "Row_Key2", "n_lines", "n_removed"]
    for r in got.collect():
        assert list(r)[3:9] == ["k", 7, "dot", "r", "g", "z"] and r["n_lines"] == 2 and r["text"] == (f"own {r['doc_id']}" if r["doc_id"] else "shared\nown 0")


def test_line_dedup_lines_of_one_very_long_text(spark):
    rows = [(k, "\n".join([f"line {j}" if j % 7 else "same" for j in range(20_000)]) if k == 3 else f"same\nrow {k}\n   \n\t", f"s{k}") for k in range(10)]
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), 8).collect()}
    assert got[3]["n_lines"] == 20_000 and got[3]["n_removed"] == len(range(0, 20_000, 7)) and got[0]["text"].startswith("same\nrow 0\n   ") and got[9]["text"].startswith("row 9\n   ")


def test_language_columns(spark):
    rows = [(k, "the of and to in is that it was" if k % 2 else "der die und ein nicht", ("en", "de")[k % 2 == 0], "x", "y", 0.5) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, `_lettered` string, `a.b` string, `Score` double")
    got = language.identify(table, language.fit(table, PIECES))
    assert got.columns == ["doc_id", "text", "lang", "_lettered", "a.b", "lang_pred", "score"]
    assert all(r["lang_pred"] == r["lang"] and r["_lettered"] == "x" and r["a.b"] == "y" for r in got.collect())


def test_language_fit_is_bounded_by_bytes_too(spark):
    rows = [(k, "the of and to in is that it was " * (5_000 if k == 1 else 2) if k % 2 else "der die und ein nicht", ("en", "de")[k % 2 == 0]) for k in range(60)]
    table = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string, lang string")
    got = language.identify(table, language.fit(table, PIECES, most_bytes=2000)).collect()
    assert len(got) == 62 and all(r["lang_pred"] == r["lang"] for r in got)
