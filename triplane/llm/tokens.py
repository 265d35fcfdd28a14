"""Whole-text encoding with a public tokenizer, through a cache of text pieces.

A text is cut into pieces at places where the tokenizer's own pre-tokenizer must cut, whatever
surrounds them, so that the ids of a text are the ids of its pieces in order:

* at ASCII white space (never part of a token),
* between an ASCII or Latin-1 letter, an ASCII digit and an ASCII sign other than ``' < | >`` (letters,
  single digits and signs never share a token; ``'`` starts contractions, ``< | >`` special tokens),
* between two ASCII digits.

Each distinct piece is encoded once a worker by the tokenizer itself; everything else is numpy.  Pieces
are told apart without case, as the tokenizer lower-cases them, but for those with ``<|``: special
tokens are matched by case before that.

These cuts hold for tokenizers of one make (``_FITS``).  Any other tokenizer encodes whole texts, without the cache.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np

from triplane.llm.words import CACHES, LOWER_VALUES, Prefix

_LETTER, _DIGIT, _SIGN, _SPACE, _OTHER = 1, 2, 3, 4, 0
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[39, 60, 62, 124]] = _OTHER
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
#: Whether the pre-tokenizer must cut between two kinds (8 * first + second).
_CUT = np.zeros(64, bool)
for _a in (_LETTER, _DIGIT, _SIGN, _SPACE, _OTHER):
    for _b in (_LETTER, _DIGIT, _SIGN, _SPACE, _OTHER):
        _CUT[8 * _a + _b] = (_a != _b and (_SPACE in (_a, _b) or _OTHER not in (_a, _b))) or _a == _b == _DIGIT
_PLACE_BITS = 20
_PLACE = np.uint64(64 - _PLACE_BITS)
#: Pieces over this many bytes, or with ``<|``, are named by a digest of their exact bytes instead of the rolling hash.
_LONG = 256
#: Words encoded by one call.
_RUN = 2000
#: Distinct pieces held by a worker before it starts anew; bounds its memory, not its results.
_MOST = 800_000


#: Normaliser, pre-tokeniser pattern and model of the tokenizers that the cuts fit (fixed values).
_FITS = {
    "normalizers": ["NFC", "Replace", "Lowercase"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "pretokenizers": ["Split", "ByteLevel"],
    "suffix": "</w>",
}


def cuts_fit(tokenizer) -> bool:
    """Whether a tokenizer is of the make that the cuts are made for."""
    made = json.loads(tokenizer.to_str())
    normal, pre, model = made.get("normalizer") or {}, made.get("pre_tokenizer") or {}, made["model"]
    parts = pre.get("pretokenizers", [])
    added = [x["content"] for x in made.get("added_tokens", [])]
    return (
        [x["type"] for x in normal.get("normalizers", [])] == _FITS["normalizers"]
        and [x["type"] for x in parts] == _FITS["pretokenizers"]
        and parts[0]["pattern"].get("Regex") == _FITS["pattern"]
        and model["type"] == "BPE"
        and model.get("end_of_word_suffix") == _FITS["suffix"]
        and all(x.startswith("<|") and x.endswith("|>") and x[2:-2].isalpha() for x in added)
    )


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cached = cuts_fit(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.word_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted keys of all pieces held, in 12 bytes a piece with their slots
        self.slots = np.zeros(0, np.int32)
        self.start = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.used = 0
        self.near_key = np.zeros(1 << _PLACE_BITS, np.uint64)  # most recent piece of each place: no sort for pieces just seen
        self.near_slot = np.full(1 << _PLACE_BITS, -1, np.int32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of pieces.  Words of letters alone are encoded in runs: each ends with its only word-end token."""
        out: list[list[int]] = [[]] * len(texts)
        words = [k for k, x in enumerate(texts) if x.isalpha() and len(x) <= _LONG]
        for s in range(0, len(words), _RUN):
            part = words[s : s + _RUN]
            ids = np.array(self.tokenizer.encode(" ".join([texts[k] for k in part]), add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(part):
                words = words[:s]
                break
            for k, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[k] = ids[a:b].tolist()
        done = set(words)
        rest = [k for k in range(len(texts)) if k not in done]
        for k, x in zip(rest, self.tokenizer.encode_batch([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    def _learn(self, texts: list[str]) -> np.ndarray:
        """The slots of new pieces."""
        batch = self._ids(texts)
        n, first = np.array([len(x) for x in batch], np.int64), len(self.slots)
        while len(self.start) < first + len(n):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        total = int(n.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = [i for x in batch for i in x]
        self.count[first : first + len(n)] = n
        self.start[first : first + len(n)] = self.used + np.cumsum(n) - n
        self.used += total
        return np.arange(first, first + len(n), dtype=np.int32)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, where each text's ids start and end)."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if not self.cached:
            raw = buf.tobytes()
            whole = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.array([i for x in whole for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in whole])]).astype(np.int64)
        kind = _KIND[buf]
        lead = np.flatnonzero(buf == 0xC3)  # valid UTF-8: a lead byte is never the last one
        follow = buf[lead + 1]
        lead = lead[(follow >= 0x80) & (follow <= 0xBF) & (follow != 0x97) & (follow != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        cut = np.ones(len(buf) + 1, bool)
        cut[1:-1] = _CUT[kind[:-1] * np.uint8(8) + kind[1:]]
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        real = kind[starts] != _SPACE
        starts, ends = starts[real], ends[real]
        keys = Prefix(buf, LOWER_VALUES).hash(starts, ends)
        exact = ends - starts > _LONG
        opens = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))
        at = np.searchsorted(starts, opens, "right") - 1  # signs are in a piece, always
        exact[at[opens + 1 < ends[at]]] = True
        for k in np.flatnonzero(exact).tolist():
            digest = hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
            keys[k] = np.frombuffer(digest, np.uint64)[0]
        place = (keys >> _PLACE).astype(np.int64)
        slot = self.near_slot[place]
        missing = np.flatnonzero((self.near_key[place] != keys) | (slot < 0))
        if len(missing):
            if len(self.known) > _MOST:
                self._clear()
                missing = np.arange(len(keys))
            unique, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            at = np.searchsorted(self.known, unique)
            held = at < len(self.known)
            held[held] = self.known[at[held]] == unique[held]
            got = np.zeros(len(unique), np.int32)
            got[held] = self.slots[at[held]]
            if len(new := np.flatnonzero(~held)):
                raw, own = buf.tobytes(), missing[first[new]]
                texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
                got[new] = self._learn(texts)
                self.known, self.slots = np.insert(self.known, at[new], unique[new]), np.insert(self.slots, at[new], got[new])
            slot[missing] = got[back]
            self.near_key[place[missing]] = keys[missing]
            self.near_slot[place[missing]] = slot[missing]
        n = self.count[slot].astype(np.int64)
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.flat[np.repeat(self.start[slot] - upto + n, n) + np.arange(total)]
        bounds = np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]
        return ids, bounds


_ENCODERS: dict[str, Encoder] = {}
CACHES.append(_ENCODERS.clear)


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append an end id to every text's ids."""
    n = len(bounds) - 1
    wider = bounds + np.arange(n + 1)
    out = np.full(len(ids) + n, end, np.uint32)
    own = np.ones(len(out), bool)
    own[wider[1:] - 1] = False
    out[own] = ids
    return out, wider
