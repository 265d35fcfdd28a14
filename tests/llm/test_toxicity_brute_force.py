"""The fit and the scores against a plain-Python FTRL-proximal over the same features."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from triplane.llm import toxicity
from triplane.llm.words import _BASE, _VALUES

MASK = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def hashed(raw):
    return mix((sum(int(_VALUES[b]) * pow(_BASE, j, 1 << 64) for j, b in enumerate(raw)) + len(raw)) & MASK)


def coordinates(text):
    """Words, stems, pairs and skip-grams of a text."""
    own = [w.lower().encode() for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]
    h = [hashed(w) for w in own]
    out = {mix(x) for x in h} | {mix(hashed(w[:n]) ^ 0xA0761D6478BD642F) for w in own for n in range(3, 9) if len(w) > n}
    for gap in (1, 2, 3):
        out |= {mix((h[k] * (0x9E3779B97F4A7C15 + 2 * gap) + h[k + gap]) & MASK) for k in range(len(h) - gap)}
    return {x >> (64 - toxicity.BITS) for x in out}


def plain_fit(rows, epochs, alpha=1.0, beta=1.0, l1=3.0, l2=0.1):
    z, n = {}, {}

    def weight(i):
        return 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)).tolist():
            at, label = rows[k]
            own = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(own.values()))))) - label
            for i in at:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * own[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_fit_and_scores(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(80):
        words = [rng.choice("amber Birch cobalt dune ember éclair".split()) + str(rng.randrange(9)) for _ in range(25)]
        if k % 4 == 0:
            words[rng.randrange(25)] = rng.choice(["spiteful", "spitefully"])
        rows.append((k, " ".join(words), "x"))
        labels.append((k, int(k % 4 == 0), 1))
    rows += [rows[4], rows[5], (200, "word " * 40_000, "x"), (201, None, "x"), (202, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    weights = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int, y int"))
    known = dict((d, y) for d, y, _ in labels)
    order = {(r["doc_id"], r["text"]): r["o"] for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("o")).collect()}
    train = sorted((order[d, t], t, known[d]) for d, t, _ in rows if d in known)
    want = plain_fit([(coordinates(t) | {toxicity.BIAS}, y) for _, t, y in train], 3)
    assert set(weights) == set(want) and all(math.isclose(weights[i], want[i], rel_tol=1e-9, abs_tol=1e-12) for i in want) and len(want) > 3
    for r in toxicity.score(docs, weights).collect():
        text = next(t for d, t, _ in rows if d == r["doc_id"])
        total = sum(want.get(i, 0.0) for i in coordinates(text) | {toxicity.BIAS})
        assert math.isclose(r["score"], 1 / (1 + math.exp(-max(-30, min(30, total)))), rel_tol=1e-9)


def test_fit_is_bounded_by_bytes(spark):
    rows = [(k, ("good plain words " if k % 2 else "spiteful plain words ") * 50) for k in range(400)]
    table = spark.createDataFrame([(k, 1 - k % 2) for k in range(400)], "doc_id long, toxic int")
    weights = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), table, most_bytes=100_000)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), weights).collect()}
    assert sum((got[k] >= 0.5) == (k % 2 == 0) for k in range(400)) == 400
