"""URL filtering by a trie over reversed host labels, then path segments.

Rules (action, host, path) enter a trie: first the host's labels from the last one on, then the
path's whole segments; a path rest without a closing slash is kept at its node as a string prefix.  A
rule fits its host, all subdomains, and every path that starts with its path.  The longest fitting
rule (host plus path characters) decides; of rules of one length a block beats an allow, then a
longer host a longer path; without a fitting rule the default verdict holds.  Hosts, of urls and of
rules, are lower-cased in A-Z alone.

The trie is broadcast while the rules' size is below ``broadcast_bytes``; beyond it the same answer
comes from a shuffle join of the urls' host suffixes and path prefixes with the rule table.

Defined results: a null url, or one without ``://``, has empty host and path and the default verdict;
repeated rows give repeated rows; null rules' parts count as empty; a rule without host is no rule;
urls of any length are judged whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.llm import scratch

Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    there = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


class Trie:
    """Nodes are [children, rule ending here, [(path rest, rule)]]."""

    def __init__(self, rules: Iterable[Rule]):
        self.hosts: list = [{}, None]
        for action, host, path in rules:
            host, path = (host or "").translate(_FOLD), path or ""
            if not host:
                continue
            node = self.hosts
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, None, []]
            node = node[1]
            *whole, rest = path.split("/")
            for segment in whole:
                node = node[0].setdefault(segment, [{}, None, []])
            found = (len(host) + len(path), action == "block", len(host), host + path, action)
            if rest:
                node[2].append((rest, found))
            elif node[1] is None or node[1] < found:
                node[1] = found

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest fitting rule."""
        best = None
        segments = path.split("/")
        node = self.hosts
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            at = node[1]
            for k in range(len(segments)):
                if at is None:
                    break
                if at[1] is not None and (best is None or best < at[1]):
                    best = at[1]
                if at[2]:
                    left = "/".join(segments[k:])
                    for rest, found in at[2]:
                        if left.startswith(rest) and (best is None or best < found):
                            best = found
                at = at[0].get(segments[k]) if k < len(segments) - 1 else None
        return best and best[3:]


def _walk(held, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = held.value.judge
        for batch in batches:
            known: dict = {}  # every distinct host and path of the batch is judged once
            found = []
            for url in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if url not in known:
                    known[url] = judge(*url) or (None, default)
                found.append(known[url])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def _joined(pages: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    spark = pages.sparkSession
    table = spark.createDataFrame([(a, (h or "").translate(_FOLD), p or "") for a, h, p in rules if h], "action string, rule_host string, rule_path string")
    table = table.withColumn("rank", F.struct(F.length("rule_host") + F.length("rule_path"), F.col("action") == "block", F.length("rule_host")))
    table = table.groupBy("rule_host", "rule_path").agg(F.max_by("action", "rank").alias("action"), F.max("rank").alias("rank"))
    lengths = sorted({len(p or "") for _, _, p in rules})
    keyed = pages.withColumn("_row", F.monotonically_increasing_id())
    keyed = scratch.keep(keyed, "urls")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    tried = keyed.select("_row", "path", F.explode(suffixes).alias("rule_host"))
    tried = tried.join(table.select("rule_host").distinct(), "rule_host", "left_semi")
    tried = tried.select("_row", "rule_host", F.explode(F.transform(prefixes, lambda n: F.substr("path", F.lit(1), n))).alias("rule_path"))
    best = (
        tried.join(table, ["rule_host", "rule_path"])
        .groupBy("_row")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("action")), "rank").alias("best"))
    )
    out = keyed.join(best, "_row", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def url_filter(pages: DataFrame, rules: Iterable[Rule], default: str = "allow", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    rules = list(rules)
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if sum(200 + len(h or "") + len(p or "") for _, h, p in rules) > broadcast_bytes:
        return _joined(parts, rules, default)
    spark = pages.sparkSession
    scratch.ship(spark)
    held = spark.sparkContext.broadcast(Trie(rules))
    return parts.mapInArrow(_walk(held, default), "page_id long, host string, path string, rule string, verdict string")
