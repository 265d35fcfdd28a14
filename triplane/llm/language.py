"""Language identification by segmentation-marginalised unigram models.

The pieces of a fixed public vocabulary (lower-cased, as UTF-8 bytes, word-initial and inner ones apart,
with every single byte as a fallback) get one probability per language.  A word's likelihood is
the sum over all its segmentations into pieces, computed by the forward algorithm; a text's is the
product over its words.  Probabilities are fitted by expectation-maximisation (forward-backward) on word
counts of a bounded, documented sample of labelled documents per language (``bound``: the expected
number, taken by a hash of doc_id and text; ``most_bytes``: the expected bytes, beyond which a hash takes
words of the sampled texts), so what the driver gathers is bounded too.

Words are runs of ASCII letters (A-Z lower-cased) and non-ASCII bytes and are never cut: those over REACH
bytes, whose likelihoods could be too small for a double, are summed in logarithms over blocks of
positions.  The score is the posterior of the best language under equal priors.

Defined results: null text and text without a letter give ``und`` with score 0; without any training
row every text is ``und``; ties go to the first language by name; rows with a null lang do not
train; repeated rows are judged alike; columns named as the new ones, in any case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.llm import scratch
from triplane.llm.words import ALPHA, LOWER_VALUES, Lookup, Prefix, Words, chunks, drop_caches

REACH = 32
#: Bytes of long words, times words, whose forward values are held at once when scoring, about; a longer word is fitted alone.
LATTICE = 1 << 16
_U = np.uint64
_START = _U(0xA0761D6478BD642F)
_FLOOR = 1e-9


class Vocabulary:
    """Hashes of pieces; byte pieces stand at the end and always match."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = set()
        for k in range(model.get_piece_size()):
            if model.is_control(k) or model.is_unknown(k) or model.is_byte(k):
                continue
            text = model.id_to_piece(k)
            begins = text.startswith("▁")
            raw = text.removeprefix("▁").encode().lower()
            if len(raw) > 1 and ALPHA[np.frombuffer(raw, np.uint8)].all():
                pieces |= {(begins, raw)}
        self.longest = max((len(p) for _, p in pieces), default=1)
        ordered = sorted(pieces)
        buf = np.frombuffer(b"".join(p for _, p in ordered), np.uint8)
        ends = np.cumsum([len(p) for _, p in ordered])
        starts = ends - [len(p) for _, p in ordered]
        keys = Prefix(buf, LOWER_VALUES).hash(starts, ends)
        keys = np.where([b for b, _ in ordered], keys ^ _START, keys)
        self.table = Lookup(keys)
        self.n = len(self.table.keys) + 256


class Lattice:
    """All pieces inside a set of words: edges by (end, length)."""

    def __init__(self, vocabulary: Vocabulary, buf: np.ndarray, prefix: Prefix, starts: np.ndarray, lengths: np.ndarray, begins: np.ndarray):
        self.size, self.edges = len(starts), []
        n = len(vocabulary.table.keys)
        for end in range(1, int(lengths.max(initial=0)) + 1):
            rows = np.flatnonzero(lengths >= end)
            self.edges.append((end, 1, rows, n + buf[starts[rows] + end - 1].astype(np.int64)))
            for length in range(2, min(end, vocabulary.longest) + 1):
                a = starts[rows] + end - length
                h = prefix.hash(a, a + length)
                if end == length:
                    at, piece = vocabulary.table.find(np.where(begins[rows], h ^ _START, h))
                    self.edges.append((end, length, rows[at], piece))
                at, piece = vocabulary.table.find(h) if end > length else (np.zeros(0, np.int64),) * 2
                if len(at):
                    self.edges.append((end, length, rows[at], piece))
        self.lengths = lengths

    def forward(self, probability: np.ndarray) -> np.ndarray:
        alpha = np.zeros((int(self.lengths.max(initial=0)) + 1, self.size, probability.shape[1]))
        alpha[0] = 1
        for end, length, rows, piece in self.edges:
            alpha[end, rows] += alpha[end - length, rows] * probability[piece]
        return alpha

    def totals(self, probability: np.ndarray) -> np.ndarray:
        return self.forward(probability)[self.lengths, np.arange(self.size)]

    def expected(self, probability: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece, words weighted by their counts per language."""
        alpha = self.forward(probability)
        beta = np.zeros_like(alpha)
        whole = alpha[self.lengths, np.arange(self.size)]
        beta[self.lengths, np.arange(self.size)] = counts / np.maximum(whole, 1e-300)
        out = np.zeros_like(probability)
        for end, length, rows, piece in reversed(self.edges):
            flow = beta[end, rows] * probability[piece]
            beta[end - length, rows] += flow
            np.add.at(out, piece, flow * alpha[end - length, rows])
        return out


def _long_edges(vocabulary: Vocabulary, buf: np.ndarray, prefix: Prefix, starts: np.ndarray, lengths: np.ndarray, low: int, high: int):
    """Pieces of words that end over ``low`` and up to ``high`` bytes into them: (end, length, word, piece), by end and length."""
    n = np.clip(lengths - low, 0, high - low)
    rows = np.repeat(np.arange(len(n)), n)
    ends = low + 1 + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    found = [(ends, np.ones(len(rows), np.int64), rows, len(vocabulary.table.keys) + buf[starts[rows] + ends - 1].astype(np.int64))]
    for length in range(2, vocabulary.longest + 1):
        fits = np.flatnonzero(ends >= length)
        a = starts[rows[fits]] + ends[fits] - length
        h = prefix.hash(a, a + length)
        at, piece = vocabulary.table.find(np.where(ends[fits] == length, h ^ _START, h))
        found.append((ends[fits[at]], np.full(len(at), length), rows[fits[at]], piece))
    flat = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.lexsort((flat[1], flat[0]))
    return [x[order] for x in flat]


def _groups(ends: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of edges with one end and length; a word is in each at most once."""
    edge = np.flatnonzero((np.diff(ends) != 0) | (np.diff(sizes) != 0)) + 1
    return list(zip([0, *edge.tolist()], [*edge.tolist(), len(ends)], strict=True)) if len(ends) else []


def _batches(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Words of like length, of LATTICE bytes together or one word."""
    order = np.argsort(lengths, kind="stable")
    first = 0
    while first < len(order):
        end = first + 1
        while end < len(order) and (end + 1 - first) * lengths[order[end]] <= LATTICE:
            end += 1
        yield order[first:end]
        first = end


def long_totals(vocabulary: Vocabulary, buf: np.ndarray, prefix: Prefix, starts: np.ndarray, lengths: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations of whole words; the forward values of one block are held at a time."""
    out = np.zeros((len(starts), log_p.shape[1]))
    reach = vocabulary.longest
    for own in _batches(lengths):
        begin, size = starts[own], lengths[own]
        step = max(reach, LATTICE // len(own))
        step = min(step, int(size.max()))
        alpha = np.full((reach + step + 1, len(own), log_p.shape[1]), -np.inf)  # from ``reach`` before the block to its end
        alpha[reach] = 0
        for low in range(0, int(size.max()), step):
            ends, sizes, rows, pieces = _long_edges(vocabulary, buf, prefix, begin, size, low, low + step)
            for a, b in _groups(ends, sizes):
                at, r = int(ends[a]) - low + reach, rows[a:b]
                alpha[at, r] = np.logaddexp(alpha[at, r], alpha[at - int(sizes[a]), r] + log_p[pieces[a:b]])
            done = np.flatnonzero((size > low) & (size <= low + step))
            out[own[done]] = alpha[size[done] - low + reach, done]
            alpha[: reach + 1] = alpha[step:].copy()
            alpha[reach + 1 :] = -np.inf
    return out


def long_expected(vocabulary: Vocabulary, buf: np.ndarray, prefix: Prefix, starts: np.ndarray, lengths: np.ndarray, log_p: np.ndarray, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in whole words, each of one language and with its count."""
    out = np.zeros_like(log_p)
    for own in _batches(lengths):
        size, lang = lengths[own], where[own]
        ends, sizes, rows, pieces = _long_edges(vocabulary, buf, prefix, starts[own], size, 0, int(size.max()))
        p, groups = log_p[pieces, lang[rows]], _groups(ends, sizes)
        alpha = np.full((int(size.max()) + 1, len(own)), -np.inf)
        beta = alpha.copy()
        alpha[0] = 0
        for a, b in groups:
            at, r = int(ends[a]), rows[a:b]
            alpha[at, r] = np.logaddexp(alpha[at, r], alpha[at - int(sizes[a]), r] + p[a:b])
        whole = alpha[size, np.arange(len(own))]
        beta[size, np.arange(len(own))] = 0
        for a, b in reversed(groups):
            at, r = int(ends[a]), rows[a:b]
            back = at - int(sizes[a])
            beta[back, r] = np.logaddexp(beta[back, r], beta[at, r] + p[a:b])
        flow = np.exp(alpha[ends - sizes, rows] + p + beta[ends, rows] - whole[rows]) * counts[own][rows]
        np.add.at(out, (pieces, lang[rows]), flow)
    return out


class Model:
    def __init__(self, vocabulary: Vocabulary, languages: list[str], probability: np.ndarray):
        self.vocabulary, self.languages, self.probability = vocabulary, languages, probability

    def log_likelihoods(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows: texts; columns: languages."""
        words = Words(buf, offsets, ALPHA)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(words.starts):
            return out
        starts, lengths = words.starts, words.ends - words.starts
        _, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        value = np.zeros((len(first), len(self.languages)))
        short = np.flatnonzero(lengths[first] <= REACH)
        for s in range(0, len(short), 16384):
            at = first[short[s : s + 16384]]
            lattice = Lattice(self.vocabulary, buf, words.prefix, starts[at], lengths[at], np.ones(len(at), bool))
            value[short[s : s + 16384]] = np.log(np.maximum(lattice.totals(self.probability), 1e-300))
        if len(long := np.flatnonzero(lengths[first] > REACH)):
            value[long] = long_totals(self.vocabulary, buf, words.prefix, starts[first[long]], lengths[first[long]], np.log(self.probability))
        text = np.searchsorted(words.docs, np.arange(len(starts)), "right") - 1
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(text, value[back, k], len(out))
        return out


def fit(docs: DataFrame, vocabulary: str, lang: str = "lang", bound: int = 400, rounds: int = 4, most_bytes: int = 8 << 20) -> Model:
    """Fit on about ``bound`` documents, and at most about ``most_bytes``, of each language."""
    known = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull())
    many = {r[lang]: r["n"] for r in known.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    languages = sorted(many)
    pieces = Vocabulary(vocabulary)
    probability = np.full((pieces.n, max(1, len(languages))), 1 / pieces.n)
    if not languages:
        return Model(pieces, [], probability)
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = F.create_map(*[x for k, n in many.items() for x in (F.lit(k), F.lit(int(min(1.0, bound / n) * (1 << 30))))])
    sample = known.where(pick < share[F.col(lang)])
    sizes = {r[0]: r[1] for r in sample.groupBy(F.col(lang)).agg(F.sum(F.octet_length("text"))).collect()}
    words = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int(min(1.0, most_bytes / max(1, sizes.get(k) or 1)) * (1 << 30))))])
    runs = F.split(F.regexp_replace("text", r"[^A-Za-z\x{80}-\x{10FFFF}]+", " "), " ")
    spread = sample.select(F.col(lang).alias("lang"), F.xxhash64("doc_id", "text").alias("row"), F.posexplode(runs).alias("at", "word")).where("word <> ''")
    spread = spread.where(F.pmod(F.xxhash64("row", "at"), F.lit(1 << 30)) < words[F.col("lang")])
    counted = spread.groupBy("lang", "word").agg(F.count("*").alias("n"))
    rows = counted.collect()
    for _ in range(rounds):
        total = np.zeros_like(probability)
        for s in range(0, len(rows), 8192):
            part = rows[s : s + 8192]
            where = np.array([languages.index(r["lang"]) for r in part])
            for first, end, buf, offsets in chunks(pa.array([r["word"] for r in part])):
                words = Words(buf, offsets, ALPHA)
                starts, lengths = words.starts, words.ends - words.starts
                text = np.searchsorted(words.docs, np.arange(len(starts)), "right") - 1 + first
                uses = np.array([part[k]["n"] for k in text.tolist()], float)
                short, long = np.flatnonzero(lengths <= REACH), np.flatnonzero(lengths > REACH)
                counts = np.zeros((len(short), len(languages)))
                counts[np.arange(len(short)), where[text[short]]] = uses[short]
                total += Lattice(pieces, buf, words.prefix, starts[short], lengths[short], np.ones(len(short), bool)).expected(probability, counts)
                if len(long):
                    total += long_expected(pieces, buf, words.prefix, starts[long], lengths[long], np.log(probability), where[text[long]], uses[long])
        probability = (total + 0.01) / (total + 0.01).sum(axis=0)
        probability = np.maximum(probability, _FLOOR)
    return Model(pieces, languages, probability)


def _identify(held, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        model: Model = held.value
        for batch in batches:
            names, scores = [], []
            lettered = batch.column(batch.num_columns - 1).to_pylist()
            for first, end, buf, offsets in chunks(batch.column(text_at)):
                if not model.languages:
                    names += [None] * (end - first)
                    scores += [0.0] * (end - first)
                    continue
                value = model.log_likelihoods(buf, offsets)
                best = value.argmax(axis=1)
                scores += (1 / np.exp(value - value.max(axis=1)[:, None]).sum(axis=1)).tolist()
                names += [model.languages[k] for k in best.tolist()]
            known = [bool(has) and name is not None for has, name in zip(lettered, names, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([name if k else "und" for k, name in zip(known, names, strict=True)], pa.string()),
                    pa.array([s if k else 0.0 for k, s in zip(known, scores, strict=True)], pa.float64()),
                ],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs plus lang_pred and score."""
    scratch.ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary size * languages numbers
    columns = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    schema = rows.drop("lettered").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(_identify(held, [c.lower() for c in columns].index("text")), schema).toDF(*columns, "lang_pred", "score")
