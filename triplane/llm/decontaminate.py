"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``width`` consecutive words of an item (a shorter item is one window).  A text holds a
window only if it holds all of the window's shingles, so one shingle is a necessary prefix: shingles
are ordered by rarity, counted over the whole corpus, and each window is joined through its rarest
one alone (a window whose rarest shingle never occurs is dropped).  The shingle's place in the window
fixes where the window must start (positional bound) and it must end inside the text (length bound);
then all words are compared, byte by byte.

The windows of a benchmark under ``block_bytes`` are broadcast.  A larger one is joined by shuffle: a
broadcast bitmap of 2**MAP_BITS bits, whatever the benchmark's size, lets only places of its shingles leave a
text, with the words around them.  Either way reads the corpus twice, once to count and once to match.

Defined results: null and empty texts have no words, no hits, no items; items without words have no
window; an item without id still hits words but is not listed; repeated items count once; repeated
documents give repeated rows; texts are read whole, however long; other columns are ignored.  An
empty benchmark hits nothing, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.llm import scratch
from triplane.llm.words import ALNUM, LOWER_BYTES, Bitmap, Lookup, Words, chunks, same_bytes

SHINGLE = 3
MAP_BITS = 27
_SPANS = "array<struct<start:int,end:int>>"


def _item_windows(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """(text number, hashes of a window's words, the words) of every window of every text."""
    for first, _end, buf, offsets in chunks(texts):
        words, raw = Words(buf, offsets, ALNUM), LOWER_BYTES[buf].tobytes()
        for k in range(len(offsets) - 1):
            a, b = int(words.docs[k]), int(words.docs[k + 1])
            own = [raw[x:y] for x, y in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)]
            n = min(width, b - a)
            for s in range(b - a - n + 1 if n else 0):
                yield first + k, words.hashes[a + s : a + s + n], own[s : s + n]


class Windows:
    """Distinct windows of a block of items: their words, words' hashes, lengths, shingles and items."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        self.names = [name for name, _ in items]
        rows: dict[tuple, tuple[np.ndarray, set[int]]] = {}
        for k, part, own in _item_windows(pa.array([t for _, t in items], pa.large_string()), width):
            rows.setdefault(tuple(own), (part, set()))[1].add(k)
        self.lengths = np.array([len(own) for own in rows], np.int64)
        self.words = np.zeros((len(rows), width), np.uint64)
        self.spans = np.zeros((len(rows), width), np.int64)  # bytes of each word
        for k, (own, (part, _)) in enumerate(rows.items()):
            self.words[k, : len(own)] = part
            self.spans[k, : len(own)] = [len(x) for x in own]
        self.raw = np.frombuffer(b"".join(x for own in rows for x in own), np.uint8)
        flat = self.spans.reshape(-1)
        self.at = (np.cumsum(flat) - flat).reshape(self.spans.shape)
        self.items = [sorted(x for x in own if self.names[x] is not None) for _, own in rows.values()]

    def shingles(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle size: (hash, window, place in the window) of every shingle."""
        out = {}
        for size in sorted({min(SHINGLE, int(n)) for n in self.lengths}):
            windows = np.flatnonzero(np.minimum(self.lengths, SHINGLE) == size)
            hashes, owner, place = [], [], []
            for length in np.unique(self.lengths[windows]):
                same = windows[self.lengths[windows] == length]
                flat = _Flat(self.words[same, :length].reshape(-1))
                grams = Words.grams(flat, size)[0].reshape(len(same), length)[:, : length - size + 1]
                hashes.append(grams.reshape(-1))
                owner.append(np.repeat(same, length - size + 1))
                place.append(np.tile(np.arange(length - size + 1), len(same)))
            out[size] = (np.concatenate(hashes), np.concatenate(owner), np.concatenate(place))
        return out


class _Flat:
    """One run of words, as Words.grams reads it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.docs = hashes, np.array([0, len(hashes)])


def _count(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {size: (Lookup(keys), np.zeros(len(keys), np.int64)) for size, keys in held.value.items()}
        for batch in batches:
            for _, _, buf, offsets in chunks(batch.column(0)):
                words = Words(buf, offsets, ALNUM)
                for size, (keys, counts) in tables.items():
                    grams, fits = words.grams(size)
                    _, place = keys.find(grams[fits])
                    counts += np.bincount(place, minlength=len(counts))
        for size, (keys, counts) in tables.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), size, np.int32)), pa.array(keys.keys[some].view(np.int64)), pa.array(counts[some])], names=["size", "shingle", "n"]
            )

    return run


class Prefixes:
    """Each window under its rarest shingle: shingle -> [(window, place)] in flat arrays."""

    def __init__(self, windows: Windows, counts: dict[tuple[int, int], int]):
        self.windows, self.by_size = windows, {}
        for size, (hashes, owner, place) in windows.shingles().items():
            n = np.array([counts.get((size, x), 0) for x in hashes.view(np.int64).tolist()], np.int64)
            order = np.lexsort((place, n, owner))
            first = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
            absent = np.zeros(len(windows.lengths), bool)
            absent[owner[n == 0]] = True
            first = first[~absent[owner[first]]]
            first = first[np.argsort(hashes[first], kind="stable")]
            keys = Lookup(hashes[first])
            starts = np.searchsorted(hashes[first], keys.keys)
            self.by_size[size] = (keys, np.append(starts, len(first)), owner[first], place[first])

    def matches(self, words: Words, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence, word numbers being those of the run of texts."""
        w, out = self.windows, []
        last = np.repeat(words.docs[1:], np.diff(words.docs))
        first = np.repeat(words.docs[:-1], np.diff(words.docs))
        for size, (keys, starts, owner, place) in self.by_size.items():
            grams, fits = words.grams(size)
            at, token = keys.find(grams)
            at, token = at[fits[at]], token[fits[at]]
            n = starts[token + 1] - starts[token]
            at = np.repeat(at, n)
            entry = np.repeat(starts[token] - np.cumsum(n) + n, n) + np.arange(n.sum())
            window, begin = owner[entry], at - place[entry]
            inside = (begin >= first[at]) & (begin + w.lengths[window] <= last[at])
            window, begin = window[inside], begin[inside]
            good = np.ones(len(window), bool)
            for k in range(w.words.shape[1]):
                used = k < w.lengths[window]
                good &= ~used | (words.hashes[np.minimum(begin + k, len(words.hashes) - 1)] == w.words[window, k])
            begin, window = begin[good], window[good]
            out.append(self._verified(words, buf, begin, window))
        return np.concatenate([x for x, _ in out] or [np.zeros(0, np.int64)]), np.concatenate([x for _, x in out] or [np.zeros(0, np.int64)])


    def _verified(self, words: Words, buf: np.ndarray, begin: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those occurrences whose words are the window's, byte by byte."""
        w, good = self.windows, np.ones(len(begin), bool)
        for k in range(w.words.shape[1]):
            at = np.flatnonzero(good & (k < w.lengths[window]))
            start, n = words.starts[begin[at] + k], words.ends[begin[at] + k] - words.starts[begin[at] + k]
            alike = n == w.spans[window[at], k]
            good[at[~alike]] = False
            at, start, n = at[alike], start[alike], n[alike]
            good[at] = same_bytes(buf, start, w.raw, w.at[window[at], k], n)
        return begin[good], window[good]


def _spans(words: Words, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of merged runs of hit words, relative to their text."""
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + length, -1)
    hit = np.cumsum(cover)[:-1] > 0
    edge = np.zeros(len(hit) + 1, bool)
    edge[words.docs] = True
    padded = np.concatenate([[False], hit, [False]])
    starts = np.flatnonzero(padded[1:-1] & (~padded[:-2] | edge[:-1]))
    ends = np.flatnonzero(padded[1:-1] & (~padded[2:] | edge[1:])) + 1
    text = np.searchsorted(words.docs, starts, "right") - 1
    return text, starts - words.docs[text], ends - words.docs[text]


def _match(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes: Prefixes = held.value
        names, listed, lengths = prefixes.windows.names, prefixes.windows.items, prefixes.windows.lengths
        for batch in batches:
            for first, end, buf, offsets in chunks(batch.column(1)):
                words, n = Words(buf, offsets, ALNUM), end - first
                begin, window = prefixes.matches(words, buf)
                text, start, stop = _spans(words, begin, lengths[window]) if len(begin) else (np.zeros(0, np.int64),) * 3
                items: list[set] = [set() for _ in range(n)]
                owner = np.searchsorted(words.docs, begin, "right") - 1
                pairs = np.unique(owner * max(1, len(lengths)) + window) if len(begin) else []
                for pair in np.asarray(pairs).tolist():
                    items[pair // len(lengths)].update(listed[pair % len(lengths)])
                place = pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32())
                spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(np.diff(words.docs)),
                        pa.ListArray.from_arrays(place, spans),
                        pa.array([sorted({names[x] for x in own}) for own in items], pa.list_(pa.string())),
                    ],
                    names=["key", "n_words", "spans", "items"],
                )

    return run


def _pass(rows: DataFrame, windows: Windows) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    keys = sc.broadcast({size: np.unique(x[0]) for size, x in windows.shingles().items()})
    counted = rows.select("text").mapInArrow(_count(keys), "size int, shingle long, n long")
    counts = {(x.size, x.shingle): x.n for x in counted.groupBy("size", "shingle").agg(F.sum("n").alias("n")).withColumnRenamed("size", "size").collect()} if len(windows.lengths) else {}
    held = sc.broadcast(Prefixes(windows, counts))
    return rows.select("key", "text").mapInArrow(_match(held), f"key long, n_words long, spans {_SPANS}, items array<string>")


def _window_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, grams, lengths, sizes, shingles = [], [], [], [], []
            ids = batch.column(0).to_pylist()
            for k, part, own in _item_windows(batch.column(1), width):
                size = min(SHINGLE, len(own))
                names.append(ids[k])
                grams.append(b" ".join(own).decode())
                lengths.append(len(own))
                sizes.append(size)
                shingles.append(Words.grams(_Flat(part), size)[0][: len(own) - size + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(grams, pa.string()), pa.array(lengths, pa.int32()), pa.array(sizes, pa.int32()), pa.array(shingles, pa.list_(pa.int64()))],
                names=["item", "gram", "n", "size", "shingles"],
            )

    return run


def _bitmap(rows: DataFrame):
    """A broadcast bitmap of the shingles of rows; the driver sees at most 2**MAP_BITS / 64 words."""
    place = F.shiftrightunsigned("shingle", 64 - MAP_BITS)
    words = rows.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(shingle, {64 - MAP_BITS}) & 63 AS int))")).alias("bits")).toArrow()
    flat = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    flat[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sizes = sorted(r["size"] for r in rows.select("size").distinct().collect())
    return rows.sparkSession.sparkContext.broadcast((Bitmap(flat, MAP_BITS), sizes))


def _count_marked(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, sizes = held.value
        for batch in batches:
            for _, _, buf, offsets in chunks(batch.column(0)):
                words = Words(buf, offsets, ALNUM)
                for size in sizes:
                    grams, fits = words.grams(size)
                    grams = grams[fits]
                    found, n = np.unique(grams[marked.has(grams)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), size, np.int32)), pa.array(found.view(np.int64)), pa.array(n)], names=["size", "shingle", "n"])

    return run


_PLACES = "array<struct<size:int,shingle:bigint,at:int,first:int,words:array<string>>>"


def _places(held, width: int):
    """Each text's marked places with the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, sizes = held.value
        kind = pa.list_(pa.struct([("size", pa.int32()), ("shingle", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("words", pa.list_(pa.string()))]))
        for batch in batches:
            for first, end, buf, offsets in chunks(batch.column(1)):
                words, raw = Words(buf, offsets, ALNUM), LOWER_BYTES[buf].tobytes()
                out: list[list[dict]] = [[] for _ in range(end - first)]
                for size in sizes:
                    grams, fits = words.grams(size)
                    at = np.flatnonzero(fits)
                    at = at[marked.has(grams[at])]
                    text = np.searchsorted(words.docs, at, "right") - 1
                    for x, k in zip(at.tolist(), text.tolist(), strict=True):
                        begin, stop = int(words.docs[k]), int(words.docs[k + 1])
                        low, high = max(begin, x - width + size), min(stop, x + width)
                        near = [raw[a:b].decode() for a, b in zip(words.starts[low:high].tolist(), words.ends[low:high].tolist(), strict=True)]
                        out[k].append({"size": size, "shingle": int(grams[x].view(np.int64)), "at": x - begin, "first": low - begin, "words": near})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.diff(words.docs)), pa.array(out, kind)], names=["doc_id", "n_words", "places"])

    return run


def _joined(rows: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """The shuffle join for benchmarks of any size."""
    made = scratch.keep(items.mapInArrow(_window_rows(width), "item string, gram string, n int, size int, shingles array<long>"), "windows")
    posted = made.dropDuplicates(["gram"]).select("gram", "n", "size", F.posexplode("shingles").alias("place", "shingle"))
    counts = rows.select("text").mapInArrow(_count_marked(_bitmap(made.select("size", F.explode("shingles").alias("shingle")))), "size int, shingle long, n long")
    counts = counts.groupBy("size", "shingle").agg(F.sum("n").alias("seen"))
    rarest = posted.join(counts, ["size", "shingle"]).groupBy("gram", "n", "size").agg(F.count("*").alias("found"), F.min(F.struct("seen", "place", "shingle")).alias("rarest"))
    rarest = rarest.where("found = n - size + 1").select("gram", "n", "size", "rarest.place", "rarest.shingle")  # a window with an absent shingle is dropped
    rarest = scratch.keep(rarest, "prefixes")
    texts = rows.mapInArrow(_places(_bitmap(rarest), width), f"doc_id long, n_words long, places {_PLACES}")
    texts = scratch.keep(texts.withColumn("key", F.monotonically_increasing_id()), "places")
    tried = texts.select("key", F.explode("places").alias("p")).select("key", "p.*").join(rarest, ["size", "shingle"])
    begin = F.col("at") - F.col("place")
    inside = (begin >= F.col("first")) & (begin + F.col("n") <= F.col("first") + F.size("words"))
    same = F.concat_ws(" ", F.slice("words", F.greatest(begin - F.col("first") + 1, F.lit(1)), F.col("n"))) == F.col("gram")
    hits = scratch.keep(tried.where(inside & same).select("key", "gram", begin.alias("start"), (begin + F.col("n")).alias("end")).distinct(), "hits")
    spans = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("all"))
    owners = made.where("item IS NOT NULL").select("gram", "item").distinct()
    named = hits.select("key", "gram").distinct().join(owners, "gram").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = texts.select("key", "doc_id", "n_words").join(spans, "key", "left").join(named, "key", "left")
    empty = F.array().cast(_SPANS)

    def join_on(done, x):
        tail = F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(tail["start"].alias("start"), F.greatest(tail["end"], x["end"]).alias("end"))))
        return F.when(F.size(done) == 0, F.array(x)).when(tail["end"] >= x["start"], longer).otherwise(F.concat(done, F.array(x)))

    merged = F.aggregate(F.coalesce("all", empty), empty, join_on)
    return out.select("doc_id", "n_words", merged.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, spans (merged runs of hit words), items (ids found)."""
    scratch.ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > block_bytes:
        return _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), items, width)
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").alias("text"))
    own = [(x.item_id, x.text) for x in items.collect()]
    return _pass(rows, Windows(own, width)).withColumnRenamed("key", "doc_id")
