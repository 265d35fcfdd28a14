"""Special tokens are told apart by case, whichever spelling comes first."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from triplane.llm.queries import TOKENIZER
from triplane.llm.tokens import Encoder


@pytest.mark.parametrize("own", [["<|endoftext|>", "<|ENDOFTEXT|>"], ["a<|EndOfText|>b <|", "A<|endoftext|>B <|", "<|STARTOFTEXT|>!<|startoftext|>", "<", "|"]])
def test_special_tokens_by_case(own):
    plain = Tokenizer.from_file(TOKENIZER)
    for texts in (own, own[::-1]):
        fast = Encoder(TOKENIZER)
        raw = [t.encode() for t in texts]
        ids, bounds = fast.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids
