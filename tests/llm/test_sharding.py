"""The k-d tree at the registered number of shards and at thousands of leaves."""

from pyspark.sql import functions as F

from triplane.llm.sharding import shard_documents


def table(spark, n):
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id").cast("string"), F.expr("repeat('x', cast(20 + pmod(id * 7919, 80) as int))")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"), F.when(F.col("id") % 2 == 0, "en").alias("lang"), F.lit(1).alias("node"), F.lit(2).alias("shards"),
    )


def test_target_bytes_give_thousands_of_even_leaves(spark):
    docs = table(spark, 60_000)
    got = shard_documents(docs, None, target_bytes=2000)
    by = got.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    total = sum(r["b"] for r in by)
    assert sum(r["n"] for r in by) == 60_000 and all(r["top"] == r["n"] - 1 for r in by)
    assert len(by) == -(-total // 2000) > 2000 and max(r["b"] for r in by) < 2 * 2000 and min(r["b"] for r in by) > 1000


def test_more_shards_than_groups(spark):
    docs = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(["a", "a", "b", None, "", "a", "long " * 50_000])], "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r["shard"] for r in shard_documents(docs, 24).collect()}
    assert len(got) == 7 and got[0] == got[1] == got[5] and got[3] == got[4] and all(0 <= s < 24 for s in got.values())
