"""Shared-folder scratch tables, code shipping and distributed ranks used by the operators.

Intermediate results that are read more than once are written as Parquet below the folder that
``spark.checkpoint.dir`` names (shared by driver and executors), so a lost executor costs a reread
of files, never a recomputation of the whole lineage.  Where the setting is absent, a session on
local threads (tests) gets a temporary folder; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triplane.sources.storage import drop, fresh

_SHIPPED = "_triplane_shipped"
#: Bytes of one Arrow batch handed to a Python worker; a batch ends with the row that passes it.
BATCH_BYTES = 8 << 20


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the driver's Python ends."""
    return fresh(spark, f"llm-{name}")


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete kept tables that nothing reads any more: what was made of them has been written."""
    for df in tables:
        if df is not None:
            drop(df.sparkSession, df.kept_at)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session, and bound their batches by bytes."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(sc, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parents[1]
    place = os.path.join(tempfile.mkdtemp(prefix="triplane-code-"), "triplane_code.zip")
    atexit.register(shutil.rmtree, os.path.dirname(place), ignore_errors=True)
    with zipfile.ZipFile(place, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("triplane") / p.relative_to(root)))
    sc.addPyFile(place)
    setattr(sc, _SHIPPED, True)


def ranked(df: DataFrame, group: str, order: list[str], rank: str, per_bucket: int = 10_000) -> DataFrame:
    """Add gapless 0-based ranks within each group without gathering a group in one task.

    A group of n rows is dealt over ceil(n / per_bucket) hash buckets; rows are numbered inside
    their bucket and the bucket's start is a running sum over bucket counts.  ``df`` must be
    repeatable (a kept table) and ``order`` must identify rows up to full repeats.
    """
    sizes = df.groupBy(group).agg(F.ceil(F.count("*") / per_bucket).alias("_nb"))
    dealt = df.join(sizes, df[group].eqNullSafe(sizes[group])).drop(sizes[group])
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64(*order), F.col("_nb"))).drop("_nb")
    inner = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)) - 1)
    counts = dealt.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("_g"), F.col("_b").alias("_sb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s")
    )
    joined = inner.join(starts, inner[group].eqNullSafe(starts["_g"]) & (inner["_b"] == starts["_sb"]))
    return joined.withColumn(rank, (F.col("_s") + F.col("_r")).cast("long")).drop("_g", "_sb", "_s", "_r", "_b")
