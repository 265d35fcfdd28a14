"""Different texts under one doc_id are linked each by itself."""

import random

from tests.llm.test_operators import shingles
from triplane.llm.near_dedup import near_dedup


def test_near_dedup_of_texts_that_share_an_id(spark):
    rng, rows = random.Random(12), []
    for k in range(40):
        a, b = ([f"{x}{k}w{rng.randrange(10**6)}" for _ in range(70)] for x in "ab")
        rows += [(4 * k + 3, " ".join(a)), (4 * k + 3, " ".join(b)), (4 * k + 3, "  ".join(b).upper())]
        rows += [(4 * k + 1 + k % 2 * 4, " ".join([*a[:-1], "n"])), (4 * k + 2 + k % 3 * 2, " ".join([*b[:-1], "n"]))]
    rows.append(rows[0])
    sets = [frozenset(shingles(t, 3)) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    want = sorted((d, len(s), least[r], d == least[r]) for (d, _), s, r in zip(rows, sets, root, strict=True))
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want
