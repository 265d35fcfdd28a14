"""Only documents of a candidate pair are sent to the block pass with their sets, and no candidate is left out."""

import numpy as np

from triplane.llm import near_dedup as N


def rows(rng, sets, n: int, side: bool) -> list[dict]:
    out = []
    for k, own in enumerate(sets):
        least = np.array([(own * f).min() for f in N._factors(n)])
        tokens = N.mix(least + N.mix(np.arange(n, dtype=np.uint64) + np.uint64(77))).view(np.int64)
        held = np.sort(rng.permutation(n)[: n - 3])  # some coordinates are not shared with anyone
        order = np.array([(int(tokens[c]) % 5 + 2) * 64 + int(c) for c in held])
        by = np.argsort(order)
        doc = 2 * k + side
        out.append({"side": side, "doc": doc, "comp": doc // 4, "own": tokens[held][by].tolist(), "order": order[by].tolist(), "shingles": np.sort(own).tobytes()})
    return out


def test_candidates_cover_all_links():
    rng, n, t, links = np.random.default_rng(3), 48, 26, 0
    np.seterr(over="ignore")
    base = [rng.integers(1, 2**63, 60).astype(np.uint64) for _ in range(3)]

    def near() -> np.ndarray:
        own = base[rng.integers(3)].copy()
        own[rng.integers(0, 60, rng.integers(1, 9))] = rng.integers(1, 2**63)
        return np.unique(own)

    for same in (True, False):
        for _ in range(10):
            left = rows(rng, [near() for _ in range(12)], n, False)
            right = left if same else rows(rng, [near() for _ in range(12)], n, True)
            for token in {x for r in left for x in r["own"]}:
                a = N._Side(left, n)
                b = a if same else N._Side(right, n)
                found = N.block_links(token, a, b, same, n, t, 85)
                bare = [[{k: v for k, v in r.items() if k != "shingles"} for r in x] for x in (left, right)]
                one = N._Side(bare[0], n)
                hit = N.block_candidates(token, one, one if same else N._Side(bare[1], n), same, t)
                picked = [[r for r, x in zip(rows_, h.tolist(), strict=True) if x] for rows_, h in zip((left, right), hit, strict=True)]
                if not found:
                    continue
                links += len(found)
                a = N._Side(picked[0], n)
                again = N.block_links(token, a, a if same else N._Side(picked[1], n), same, n, t, 85)
                assert again == found
    assert links > 100


def test_documents_without_a_candidate_are_left_out():
    rng = np.random.default_rng(5)
    np.seterr(over="ignore")
    apart = rows(rng, [rng.integers(1, 2**63, 60).astype(np.uint64) for _ in range(8)], 48, False)
    for r in apart:  # one token in common, as by a frequent shingle
        r["own"][0] = 7
    side = N._Side([{k: v for k, v in r.items() if k != "shingles"} for r in apart], 48)
    assert not N.block_candidates(7, side, side, True, 26)[0].any()
