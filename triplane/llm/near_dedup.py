"""Near-duplicate detection: MinHash signatures joined by signature coordinate.

1. Every text becomes its set of distinct word shingles, a 128-bit key of that set and a signature of ``n``
   minimum hashes.  Documents with one key have one set; the key, numbered, is the node that is linked.
2. Representatives are posted under each (coordinate, value) token.  Tokens seen once cannot collide and
   go.  A pair above the match threshold of ``t`` equal coordinates shares one of each side's n - t + 1
   rarest tokens (prefix merging), so only those are posted; lists of frequent tokens are skipped and
   their collisions are counted from the two signatures (skip merging).
3. Links are confirmed on full shingle sets.  First each document is tried against its lists' leaders
   (in the first round the best one, and the other document of each list of two) and linked ones fall
   into components; within a list, pairs of one component need no test.
   What is left in lists with several components is compared in blocks of bounded size: every
   pair of different components with t or more collisions is tested, in the list of its rarest common
   token alone, and only links leave the block.  Signatures go first, a whole list at a time, so that each
   document goes once to each of its lists; they name the documents that are in such a pair, and only these
   are dealt to blocks, with their sets.  No list is capped and no pair is emitted
   unless it is a link or a leader's candidate.
4. A list over HOT documents (texts that share a template, but are no near duplicates) would make too many
   block pairs.  Its documents are posted anew under their rarest full-set shingles: two sets of
   similarity p share one of each side's (1 - p) * size + 1 rarest, in one order by rarity among these
   documents.  Shingles of one document fill that prefix without being posted, so a text with a share of
   its own over 1 - p meets nobody, and the new lists are those of true candidates; they go through blocks
   as above.  This loses no link.
5. Components are closed over the links.

Two texts at the similarity threshold 0.85 agree in each coordinate with probability 0.85; with n = 48
and t = 29 fewer than 2 in 100,000 such pairs miss the match threshold.

Defined results: null text, empty text and text without words have an empty set, link with nothing and
are their own component; rows that share a doc_id are linked each by its own text, and a component is
named by its least doc_id, whose rows are kept; rows with a null doc_id are returned unlinked
(component_id null, kept true).  An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triplane.llm import scratch
from triplane.llm.components import components
from triplane.llm.words import NOT_SPACE, Bitmap, Words, chunks, drop_caches, mix

_U = np.uint64
#: Documents in a block, about; larger blocks mean fewer copies of a document, smaller ones less memory a task.
BLOCK = 512
#: Documents in a list from which on it is split by full-set shingles.
HOT = 8 * BLOCK
STAR_ROUNDS = 3
#: 2**MAP_BITS bits tell which documents' sets are made: none is missed, and joins drop the others that pass.
MAP_BITS = 25
#: Leaders that a document not linked in the first round is tried against in each later one.
TRIES = 4


def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(buf, offsets, NOT_SPACE)
    grams, _ = words.grams(size)
    out = []
    for a, b in zip(words.docs[:-1].tolist(), words.docs[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            key = _U(b - a)
            for x in words.hashes[a:b]:
                key = mix(np.array([key * _U(0x9E3779B97F4A7C15) + x], _U))[0]
            out.append(np.array([key], _U))
        else:
            out.append(np.zeros(0, _U))
    return out


def _features(size: int, n: int):
    factors, salts = _factors(n), mix(np.arange(n, dtype=_U) + _U(77))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        drop_caches()
        for batch in batches:
            for first, end, buf, offsets in chunks(batch.column(1)):
                sets = shingle_sets(buf, offsets, size)
                counts = np.array([len(s) for s in sets])
                some = np.flatnonzero(counts)
                least = np.zeros((len(some), n), _U)
                if len(some):
                    flat = np.concatenate([sets[k] for k in some.tolist()])
                    starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
                    for k in range(n):
                        least[:, k] = np.minimum.reduceat(flat * factors[k], starts)
                tokens = mix(least + salts).view(np.int64)
                place = np.zeros(len(counts) + 1, np.int32)
                place[1:] = np.cumsum((counts > 0) * n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(counts),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(place), pa.array(tokens.reshape(-1))),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "tokens"],
                )

    return run


def _bitmap(docs: DataFrame):
    """A broadcast bitmap of the column ``hash``; the driver sees at most 2**MAP_BITS / 64 words."""
    place = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - MAP_BITS}) & 63 AS int))")
    words = docs.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    flat = np.zeros(1 << (MAP_BITS - 6), _U)
    flat[words["word"].to_numpy()] = words["bits"].to_numpy().view(_U)
    return docs.sparkSession.sparkContext.broadcast(Bitmap(flat, MAP_BITS))


def _sets(size: int, held):
    """(doc_id, text, hash) to the sets of the documents that the bitmap has; the texts of others stay where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        drop_caches()
        marked = held.value
        for batch in batches:
            batch = batch.filter(pa.array(marked.has(batch.column(2).to_numpy().view(_U))))
            for first, end, buf, offsets in chunks(batch.column(1)):
                own = [s.tobytes() for s in shingle_sets(buf, offsets, size)]
                keys = pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in own], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), keys, pa.array(own, pa.binary())], names=["doc_id", "set_key", "shingles"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    both = int(np.count_nonzero(b[place] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [_linked(np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


class _Side:
    """Documents of one block; those that are looked through for candidates come without their sets."""

    def __init__(self, rows: list[dict], n: int):
        self.docs = [r["doc"] for r in rows]
        self.comps = np.array([r["comp"] for r in rows])
        self.sets = [np.frombuffer(r["shingles"], _U) for r in rows if "shingles" in r]
        self.sizes = np.array([len(s) for s in self.sets])
        self.tokens = np.zeros((len(rows), n), np.int64)
        self.order = np.zeros((len(rows), n), np.int64)
        for k, r in enumerate(rows):
            order = np.array(r["order"], np.int64)
            self.tokens[k, order % 64] = r["own"]
            self.order[k, order % 64] = order


def block_links(token: int, a: _Side, b: _Side, same: bool, n: int, t: int, percent: int) -> list[tuple[int, int]]:
    """Links between documents of different components whose rarest common token is ``token``."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(len(a.docs)):
        equal = (b.tokens == a.tokens[i]) & (a.tokens[i] != 0)
        good = (equal.sum(axis=1) >= t) & (b.comps != a.comps[i])
        good &= 100 * np.minimum(b.sizes, a.sizes[i]) >= percent * np.maximum(b.sizes, a.sizes[i])
        if same:
            good[: i + 1] = False
        rows = np.flatnonzero(good)
        if not len(rows):
            continue
        rarest = np.where(equal[rows], a.order[i], np.iinfo(np.int64).max).argmin(axis=1)
        for j in rows[a.tokens[i][rarest] == token].tolist():
            x, y = root(int(a.comps[i])), root(int(b.comps[j]))
            if x != y and _linked(a.sets[i], b.sets[j], percent):
                parent[x] = y
                out.append((a.docs[i], b.docs[j]))
    return out


def block_candidates(token: int, a: _Side, b: _Side, same: bool, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each side in a pair that ``block_links`` compares by set, or would but for the sizes."""
    hit = [np.zeros(len(a.docs), bool), np.zeros(len(b.docs), bool)]
    for i in range(len(a.docs)):
        equal = (b.tokens == a.tokens[i]) & (a.tokens[i] != 0)
        good = (equal.sum(axis=1) >= t) & (b.comps != a.comps[i])
        if same:
            good[: i + 1] = False
        rows = np.flatnonzero(good)
        if not len(rows):
            continue
        rarest = np.where(equal[rows], a.order[i], np.iinfo(np.int64).max).argmin(axis=1)
        rows = rows[a.tokens[i][rarest] == token]
        hit[1][rows] = True
        hit[0][i] |= len(rows) > 0
    if same:
        hit[0] |= hit[1]
    return hit[0], hit[1]


_CANDIDATE = "token long, left struct<of:long,part:long>, right struct<of:long,part:long>, side boolean, doc long, comp long"
_PART = pa.struct([("of", pa.int64()), ("part", pa.int64())])
_CANDIDATE_ARROW = pa.schema([("token", pa.int64()), ("left", _PART), ("right", _PART), ("side", pa.bool_()), ("doc", pa.int64()), ("comp", pa.int64())])


def list_candidates(rows: list[dict], n: int, t: int, block: int) -> list[dict]:
    """The rows of one list that are in a candidate pair there, once for each pair of blocks that holds one."""
    token, whole = rows[0]["token"], _Side(rows, n)
    hit, _ = block_candidates(token, whole, whole, True, t)
    rows = sorted((r for r, x in zip(rows, hit.tolist(), strict=True) if x), key=lambda r: (r["comp"], r["doc"]))
    parts = [rows[k : k + block] for k in range(0, len(rows), block)]
    sides, out = [_Side(x, n) for x in parts], []
    for i, j in ((i, j) for i in range(len(parts)) for j in range(i, len(parts))):
        hits = block_candidates(token, sides[i], sides[j], i == j, t)
        for side, part, found in ((False, parts[i], hits[0]), (True, parts[j], hits[1]))[: 1 if i == j else 2]:
            own = {"token": token, "left": {"of": None, "part": i}, "right": {"of": None, "part": j}, "side": side}
            out += [own | {"doc": r["doc"], "comp": r["comp"]} for r, x in zip(part, found.tolist(), strict=True) if x]
    return out


def _candidates(n: int, t: int):
    """Rows sorted by token to those that are in a candidate pair of a block pair of their list."""
    block = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_key(batches, ["token"], lambda rows: list_candidates(rows, n, t, block)):
            yield pa.RecordBatch.from_pylist(found, _CANDIDATE_ARROW)

    return run


def _by_key(batches: Iterator[pa.RecordBatch], names: list[str], solve) -> Iterator[list]:
    """What ``solve`` gives for the rows of each key, of a batch at a time."""
    held: list[dict] = []
    key, found = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = [row[x] for x in names]
            if now != key:
                if held:
                    found += solve(held)
                key, held = now, []
            held.append(row)
        if found:
            yield found
            found = []
    if held and (found := solve(held)):
        yield found


def hot_links(token: int, a: list[dict], b: list[dict], same: bool, percent: int) -> list[tuple[int, int]]:
    """Links between documents of different components whose rarest common prefix shingle is ``token``."""
    sets = [[np.frombuffer(r["shingles"], _U) for r in rows] for rows in (a, b)]
    sizes, comps = np.array([len(x) for x in sets[1]]), np.array([r["comp"] for r in b])
    held = [set(r["prefix"]) for r in b]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, row in enumerate(a):
        n = len(sets[0][i])
        good = (comps != row["comp"]) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
        if same:
            good[: i + 1] = False
        for j in np.flatnonzero(good).tolist():
            x, y = root(row["comp"]), root(b[j]["comp"])
            if x != y and next(s for s in row["prefix"] if s in held[j]) == token and _linked(sets[0][i], sets[1][j], percent):
                parent[x] = y
                out.append((row["doc"], b[j]["doc"]))
    return out


def _blocks(n: int, t: int, percent: int, hot: bool = False):
    """Rows sorted by (token, left, right, side) to links."""

    def solve(rows: list[dict]) -> list[tuple[int, int]]:
        token = rows[0]["token"]
        left, right = [r for r in rows if not r["side"]], [r for r in rows if r["side"]]
        if hot:
            return hot_links(token, left, right or left, not right, percent)
        a = _Side(left, n)
        return block_links(token, a, _Side(right, n) if right else a, not right, n, t, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_key(batches, ["token", "left", "right"], solve):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, comp, shingles) to one row a shingle: doc, comp, size, shingle."""
    for batch in batches:
        own = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
        sizes = np.array([len(x) for x in own])
        wide = [np.repeat(x, sizes) for x in (batch.column(0).to_numpy(), batch.column(1).to_numpy(), sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*wide, np.concatenate(own))] if own else [pa.array([], pa.int64())] * 4, names=["doc", "comp", "size", "shingle"])


def _hot_lists(hot: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Lists by prefix shingle of the documents in hot lists, and each document's prefix: (token, doc, comp), (doc, prefix)."""
    docs = hot.select("doc", "comp").distinct().join(sets, "doc").select("doc", "comp", "shingles")
    rows = scratch.keep(docs.mapInArrow(_shingle_rows, "doc long, comp long, size long, shingle long"), "shingles")
    seen = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    spread = rows.join(seen, "shingle")
    own = Window.partitionBy("doc")
    place = F.row_number().over(own.orderBy("df", "shingle")) + F.col("size") - F.count("*").over(own)  # those of this document alone come first
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    posted = scratch.keep(spread.select("doc", "comp", "shingle", "df", place.alias("place"), prefix.alias("upto")).where("place <= upto"), "posted")
    scratch.forget(rows)
    several = posted.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle")
    lists = scratch.keep(posted.join(several, "shingle").select(F.col("shingle").alias("token"), "doc", "comp"), "open")
    prefixes = posted.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("place", "shingle")))["shingle"].alias("prefix"))
    return lists, prefixes


def _of(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The sets of these documents, so that a join deals no others."""
    return sets.join(docs.distinct(), "doc", "left_semi")


def _star(lists: DataFrame, members: DataFrame, sets: DataFrame, t: int, percent: int, turn: int) -> DataFrame:
    """Confirmed links of documents to a leader of another component in one of their lists; lists of two are settled.

    Leaders are chosen by the number of lists in common, so only the chosen pairs meet their signatures and sets.
    """
    lead = lists.groupBy("token").agg(F.min_by(F.struct("doc", "comp"), F.xxhash64("doc", F.lit(turn))).alias("lead"), F.count("*").alias("n"))
    tried = lists.join(lead, "token").where(F.col("comp") != F.col("lead.comp"))
    tried = tried.groupBy("doc", F.col("lead.doc").alias("lead")).agg(F.count("*").alias("common"), (F.min("n") == 2).alias("two"))
    best = tried.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("common", "lead", "two")), False).alias("leads"))  # one a list at most
    first = F.slice("leads", 1, TRIES if turn else 1)
    best = best.select("doc", F.explode(F.array_union(first, F.filter("leads", lambda x: x["two"]))["lead"]).alias("lead"))
    own = members.select("doc", "own")
    best = best.join(own.toDF("lead", "theirs"), "lead").join(own, "doc").where(F.size(F.array_intersect("own", "theirs")) >= t).select("doc", "lead")
    best = scratch.keep(best, "tried")  # few pairs are left: their number is known before the sets are joined
    leads, docs = _of(sets, best.select(F.col("lead").alias("doc"))), _of(sets, best.select("doc"))
    pairs = best.join(leads.toDF("lead", "a"), "lead").join(docs.toDF("doc", "b"), "doc")
    return pairs.select("doc", "lead", "a", "b").mapInArrow(_confirm(percent), "u long, v long")


def _block_rows(lists: DataFrame) -> DataFrame:
    """(token, left, right, side, doc, comp): documents dealt to the block pairs that need a look."""
    sizes = lists.groupBy("token", "comp").agg(F.count("*").alias("n"))
    pools = sizes.where(F.col("n") < BLOCK).groupBy("token").agg(F.ceil(F.sum("n") / (BLOCK)).alias("pools"))
    of = sizes.join(pools, "token", "left").select("token", "comp", "n", "pools")
    dealt = lists.join(of, ["token", "comp"])
    big = F.col("n") >= BLOCK
    part = F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / (BLOCK)))
    block = F.when(big, F.struct(F.col("comp").alias("of"), part.alias("part")))
    block = block.otherwise(F.struct(F.lit(None).cast("long").alias("of"), F.pmod(F.xxhash64("comp"), F.col("pools")).alias("part")))
    dealt = scratch.keep(dealt.select("token", "doc", "comp", block.alias("block")), "blocks")  # read three times below
    there = dealt.select("token", "block").distinct()
    pairs = there.toDF("token", "left").join(there.toDF("token", "right"), "token").where(F.col("left") <= F.col("right"))
    pairs = pairs.where(~F.coalesce(F.col("left.of") == F.col("right.of"), F.lit(False)))
    left = dealt.join(pairs, (dealt["token"] == pairs["token"]) & dealt["block"].eqNullSafe(pairs["left"])).drop(pairs["token"])
    right = dealt.join(pairs.where("left <> right"), (dealt["token"] == pairs["token"]) & dealt["block"].eqNullSafe(pairs["right"])).drop(pairs["token"])
    columns = ["token", "left", "right", "doc", "comp"]
    return left.select(*columns, F.lit(False).alias("side")).union(right.select(*columns, F.lit(True).alias("side")))


def _compared(now: DataFrame, members: DataFrame, sets: DataFrame, n: int, t: int, percent: int) -> DataFrame:
    """Links within the lists that still hold several components."""
    long = now.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("token")
    hot = now.join(long, "token", "left_semi")
    key, how = ["token", "left", "right"], "u long, v long"
    # Signatures alone tell which documents have a candidate, a whole list at a time, so only those are dealt to blocks.
    signed = members.select("doc", "own", "order")
    cold = now.join(long, "token", "left_anti").join(signed, "doc")
    cold = cold.repartition("token").sortWithinPartitions("token").select("token", "doc", "comp", "own", "order")
    picked = scratch.keep(cold.mapInArrow(_candidates(n, t), _CANDIDATE), "candidates")
    whole = _of(sets, picked.select("doc")).join(signed, "doc")  # a row a document; the copies for blocks are made of these
    cold = picked.join(whole, "doc")
    cold = cold.repartition(*key).sortWithinPartitions(*key, "side").select(*key, "side", "doc", "comp", "own", "order", "shingles")
    out = cold.mapInArrow(_blocks(n, t, percent), how)
    if hot.limit(1).count():
        lists, prefixes = _hot_lists(hot, sets, percent)
        rows = _block_rows(lists).join(prefixes, "doc").join(sets, "doc")
        rows = rows.repartition(*key).sortWithinPartitions(*key, "side").select(*key, "side", "doc", "comp", "prefix", "shingles")
        out = out.union(rows.mapInArrow(_blocks(n, t, percent, hot=True), how))
    return out


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, n: int = 48, t: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch.ship(spark)
    if n > 64:
        raise ValueError("a signature has at most 64 coordinates")
    if t is None:  # 4.6 standard errors under the mean of pairs at the threshold
        p = percent / 100
        t = max(1, int(n * p - 4.6 * (n * p * (1 - p)) ** 0.5))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    features = scratch.keep(rows.mapInArrow(_features(size, n), "doc_id long, n_shingles long, set_key binary, tokens array<long>"), "signatures")
    full = features.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("least")).withColumn("doc", F.monotonically_increasing_id())
    classes = scratch.keep(classes, "classes")

    reps = full.join(classes, (full["doc_id"] == classes["least"]) & (full["set_key"] == classes["set_key"])).select("doc", "tokens")
    posted = reps.select("doc", F.posexplode("tokens").alias("coord", "token"))
    seen = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = posted.join(seen, "token").groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("df", "coord", "token"))).alias("shared"))
    # Tokens of one document come first in the order by rarity: they fill the prefix without being posted.
    length = F.size("shared") - (t - 1)
    members = shared.where(length > 0).select(
        "doc",
        F.slice("shared.token", F.lit(1), length).alias("prefix"),
        F.col("shared.token").alias("own"),
        F.transform("shared", lambda x: x["df"] * 64 + x["coord"]).alias("order"),  # the order by rarity, with the coordinate
    )
    members = scratch.keep(members, "members")
    lists = members.select("doc", F.explode("prefix").alias("token"))
    several = lists.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    lists = scratch.keep(lists.join(several, "token"), "lists")

    wanted = classes.join(lists.select("doc").distinct(), "doc", "left_semi").select("doc", F.col("least").alias("doc_id"), "set_key")
    # No text is dealt: where documents are read, a bitmap tells whose sets are made.
    hashed = rows.select("doc_id", "text", F.xxhash64("doc_id").alias("hash"))
    made = hashed.mapInArrow(_sets(size, _bitmap(wanted.select(F.xxhash64("doc_id").alias("hash")))), "doc_id long, set_key binary, shingles binary")
    sets = made.dropDuplicates(["doc_id", "set_key"]).join(wanted, ["doc_id", "set_key"]).select("doc", "shingles")
    sets = scratch.keep(sets, "sets")

    found = None  # (u, v) links
    labels = None
    for turn in range(STAR_ROUNDS + 1):
        if labels is None:
            now = lists.withColumn("comp", F.col("doc"))
        else:
            own = labels.withColumnRenamed("node", "doc")
            now = lists.join(own, "doc", "left").select("doc", "token", F.coalesce("component", "doc").alias("comp"))
        open_ = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
        open_ = open_.where(F.col("lo") != F.col("hi"))
        if turn:  # in turn 0 both documents of every list of two have been tried against each other
            open_ = open_.where("n > 2")
        now = scratch.keep(now.join(open_.select("token"), "token"), "open")
        if now.limit(1).count() == 0:
            break
        if turn < STAR_ROUNDS:
            more = _star(now, members, sets, t, percent, turn)
        else:
            more = _compared(now, members, sets, n, t, percent)
        more = scratch.keep(more, "links")
        before = labels
        edges = more if labels is None else more.union(labels.select("node", "component"))
        labels = scratch.keep(components(edges.toDF("u", "v")), "labels")
        scratch.forget(now, more, before)
    scratch.forget(members, lists, sets)

    if labels is not None:
        least = classes.select(F.col("doc").alias("node"), "least").join(labels, "node").groupBy("component").agg(F.min("least").alias("first"))
        named = labels.join(least, "component").select(F.col("node").alias("doc"), "first")
        classes = classes.join(named, "doc", "left").select("set_key", F.coalesce("first", "least").alias("component"))
    else:
        classes = classes.select("set_key", F.col("least").alias("component"))
    out = features.join(classes.withColumn("has", F.lit(1)), "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
