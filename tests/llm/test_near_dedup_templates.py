"""Texts over one template, near duplicates among them, against all pairs."""

import random

from tests.llm.test_operators import clusters
from triplane.llm import near_dedup


def test_templates(spark, monkeypatch):
    own = 14
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "HOT", 32)
    rng = random.Random(own)
    template = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(150):  # most of a text is the template; some have a copy with one word changed
        words = template + [f"o{k}x{rng.randrange(10**6)}" for _ in range(own)]
        rows.append((len(rows), " ".join(words)))
        if k % 3 == 0:
            at = rng.randrange(len(words))
            rows.append((len(rows), " ".join([*words[:at], f"c{k}", *words[at + 1 :]])))
    want = clusters(rows, 3, 85)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len({c for _, c in want.values()}) == 150


def test_hot_links_finds_every_link():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    rows = [{"doc": k, "comp": k, "shingles": s.tobytes(), "prefix": [1, *range(100 + k, 103 + k)]} for k, s in enumerate(sets)]
    links = near_dedup.hot_links(1, rows, rows, True, 60)
    pairs = [(a, b) for a in range(30) for b in range(a + 1, 30) if near_dedup._linked(sets[a], sets[b], 60)]
    from tests.llm.test_operators import clusters_of

    assert clusters_of(30, links) == clusters_of(30, pairs) and not near_dedup.hot_links(7, rows, rows, True, 60)
