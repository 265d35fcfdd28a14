"""A tokenizer of another make encodes whole texts; repeated ids come in one order."""

import json

import numpy as np
from tokenizers import Tokenizer

from triplane.llm.queries import TOKENIZER
from triplane.llm.tokens import Encoder, cuts_fit
from triplane.llm.token_files import read_tokens, write_tokens


def test_cased_tokenizer(tmp_path):
    made = json.loads(Tokenizer.from_file(TOKENIZER).to_str())
    made["normalizer"]["normalizers"] = made["normalizer"]["normalizers"][:2]
    (tmp_path / "cased.json").write_text(json.dumps(made))
    plain, fast = Tokenizer.from_file(str(tmp_path / "cased.json")), Encoder(str(tmp_path / "cased.json"))
    own = ["Alpha ALPHA alpha", "", "it's 12 <|endoftext|> É"]
    raw = [t.encode() for t in own]
    ids, bounds = fast.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert not cuts_fit(plain) and cuts_fit(Tokenizer.from_file(TOKENIZER))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in own]


def test_repeated_ids_have_one_order(spark, tmp_path):
    rows = [(7, f"text {k} " * (k + 1), "x") for k in range(6)] * 2 + [(None, "b", "x"), (None, "a", "x")]
    seen = []
    for k in (1, 3):
        docs = spark.createDataFrame(rows[::-1] if k == 3 else rows, "doc_id long, text string, tokens string").repartition(k)
        seen.append([tuple(r) for r in read_tokens(spark, write_tokens(docs, TOKENIZER, f"file://{tmp_path}/{k}", 1)).orderBy("start").collect()])
    assert seen[0] == seen[1] and len(seen[0]) == len(rows)
