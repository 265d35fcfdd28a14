"""What a Python worker holds while it serves one stage after another."""

import numpy as np

from triplane.llm import words
from triplane.llm.tokens import _ENCODERS, encoder


def test_a_worker_drops_the_encoder_in_other_stages():
    from triplane.llm.queries import TOKENIZER

    encoder(TOKENIZER)
    words.drop_caches()
    assert not _ENCODERS
    ids = encoder(TOKENIZER)
    assert sum(x.nbytes for x in (ids.near_key, ids.near_slot)) <= 13 << 20


def test_powers_are_no_larger_than_a_chunk(monkeypatch):
    monkeypatch.setattr(words, "_POWERS", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    words._powers(1000)
    assert len(words._POWERS[0]) <= words.CHUNK_BYTES + 2
