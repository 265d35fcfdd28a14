"""Texts are not dealt for their sets, and no document is copied to blocks before it has a candidate there."""

import random

import numpy as np

from tests.llm.test_near_dedup_candidates import rows as listed
from tests.llm.test_operators import clusters
from triplane.llm import near_dedup as N


def below(plan: str, name: str) -> list[str]:
    lines = plan.split("\n")
    at = next(k for k, x in enumerate(lines) if name in x)
    depth = lines[at].index(name)
    out = []
    for x in lines[at + 1 :]:
        if not x[:depth].strip(" :") and len(x) > depth:
            out.append(x)
        else:
            break
    return out


def test_long_list_is_dealt_for_candidates_only(spark, monkeypatch):
    kept, plans = N.scratch.keep, {}

    def keep(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return kept(df, name)

    def blocks(lists):
        raise AssertionError("only lists over HOT are dealt by all their documents")

    monkeypatch.setattr(N.scratch, "keep", keep)
    monkeypatch.setattr(N, "_block_rows", blocks)
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(14)
    template, rows = [f"t{k}" for k in range(60)], []
    for k in range(100):  # lists of several blocks, near duplicates among them
        words = template + [f"o{k}x{rng.randrange(10**6)}" for _ in range(11)]
        rows.append((len(rows), " ".join(words)))
        if k % 3 == 0:
            at = rng.randrange(len(words))
            rows.append((len(rows), " ".join([*words[:at], f"c{k}", *words[at + 1 :]])))
    got = N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == clusters(rows, 3, 85)
    assert "candidates" in plans
    texts = below(plans["sets"], "MapInArrow")
    assert texts and not [x for x in texts if "Join" in x or "Aggregate" in x], texts


def test_blocks_hold_every_candidate():
    rng, n, t = np.random.default_rng(4), 48, 26
    np.seterr(over="ignore")
    base = rng.integers(1, 2**63, 60).astype(np.uint64)

    def near() -> np.ndarray:
        own = base.copy()
        own[rng.integers(0, 60, rng.integers(1, 9))] = rng.integers(1, 2**63)
        return np.unique(own)

    held = listed(rng, [near() for _ in range(40)], n, False)
    for token in sorted({x for r in held for x in r["own"]})[::5]:
        side = N._Side(held, n)
        alone = {r["doc"] for r, x in zip(held, N.block_candidates(token, side, side, True, t)[0].tolist(), strict=True) if x}
        found = N.list_candidates([r | {"token": token} for r in held], n, t, 7)
        assert {r["doc"] for r in found} == alone
        # every link of the whole list is within one pair of blocks, whose documents come with their sets
        by = {r["doc"]: r for r in held}
        links = []
        for left, right in {(r["left"]["part"], r["right"]["part"]) for r in found}:
            one, other = ([by[r["doc"]] for r in found if (r["left"]["part"], r["right"]["part"], r["side"]) == (left, right, s)] for s in (False, True))
            a = N._Side(one, n)
            links += N.block_links(token, a, N._Side(other, n) if other else a, not other, n, t, 85)
        whole = N.block_links(token, side, side, True, n, t, 85)
        comp = {r["doc"]: r["comp"] for r in held}
        assert closed(links, comp) == closed(whole, comp)


def closed(links, comp) -> dict:
    root = {c: c for c in comp.values()}
    for u, v in [(comp[u], comp[v]) for u, v in links]:
        a, b = root[u], root[v]
        root = {k: min(a, b) if x in (a, b) else x for k, x in root.items()}
    return root
