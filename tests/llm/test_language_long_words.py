"""Words of any length are summed over all their segmentations, without cuts."""

import numpy as np
import pytest

from triplane.llm import language
from triplane.llm.queries import PIECES

LONG = ["Straßenbahnhaltestellenverzeichnis" * 3, "東京都庁前駅から新宿駅まで歩いて行きました" * 2, "interna" * 9, "short"]


@pytest.fixture(scope="module")
def pieces():
    return language.Vocabulary(PIECES)


def whole(pieces, text):
    buf = np.frombuffer(text.encode(), np.uint8)
    prefix = language.Prefix(buf, language.LOWER_VALUES)
    return language.Lattice(pieces, buf, prefix, np.array([0]), np.array([len(buf)]), np.array([True]))


@pytest.mark.parametrize("block", [1, 1 << 16])
def test_scores_of_long_words(pieces, block, monkeypatch):
    monkeypatch.setattr(language, "LATTICE", block, raising=False)
    p = np.random.default_rng(0).random((pieces.n, 2)) * 0.05 + 0.001
    raw = " ".join(LONG).encode()
    got = language.Model(pieces, ["a", "b"], p).log_likelihoods(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert np.allclose(got[0], sum(np.log(whole(pieces, x).totals(p)[0]) for x in LONG), rtol=1e-12)


def test_score_of_a_very_long_word(pieces):
    p = np.full((pieces.n, 1), language._FLOOR)
    raw = "一".encode() * 3000
    buf = np.frombuffer(raw, np.uint8)
    edges: list = [[] for _ in range(len(raw) + 1)]
    ends, sizes, _, _ = language._long_edges(pieces, buf, language.Prefix(buf, language.LOWER_VALUES), np.array([0]), np.array([len(raw)]), 0, len(raw))
    for e, n in zip(ends.tolist(), sizes.tolist(), strict=True):
        edges[e].append(n)
    value = [0.0]
    for e in range(1, len(raw) + 1):
        value.append(float(np.logaddexp.reduce([value[e - n] + np.log(language._FLOOR) for n in edges[e]])))
    got = language.Model(pieces, ["a"], p).log_likelihoods(buf, np.array([0, len(raw)]))
    assert np.isfinite(got).all() and np.isclose(got[0, 0], value[-1])


def test_expected_uses_in_long_words(pieces):
    p = np.random.default_rng(1).random((pieces.n, 2)) * 0.05 + 0.001
    for k, text in enumerate(LONG[:3]):
        buf = np.frombuffer(text.encode(), np.uint8)
        prefix, start, size = language.Prefix(buf, language.LOWER_VALUES), np.array([0]), np.array([len(buf)])
        counts = np.array([[3.0, 0.0]])[:, :: 1 - k % 2 * 2]
        got = language.long_expected(pieces, buf, prefix, start, size, np.log(p), np.array([k % 2]), np.array([3.0]))
        assert np.allclose(got, whole(pieces, text).expected(p, counts))


def test_fit_sees_whole_long_words(spark, pieces):
    rows = [(k, LONG[0], "de") for k in range(3)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES, rounds=1)
    want = whole(pieces, LONG[0]).expected(np.full((pieces.n, 1), 1 / pieces.n), np.array([[3.0]])) + 0.01
    assert np.allclose(model.probability, np.maximum(want / want.sum(axis=0), language._FLOOR))
