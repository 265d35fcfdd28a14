"""Each operator against a brute-force version on small tables with nulls, repeats, ties and empty input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from triplane.llm import language, near_dedup, packing, scratch, token_files, toxicity
from triplane.llm.decontaminate import decontaminate
from triplane.llm.exact_dedup import exact_dedup
from triplane.llm.line_dedup import line_dedup
from triplane.llm.queries import PIECES, TOKENIZER, URL_RULES
from triplane.llm.sharding import shard_documents
from triplane.llm.tokens import Encoder
from triplane.llm.url_filter import url_filter
from triplane.llm.words import ALNUM, NOT_SPACE, Words, chunks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, line string, node int, rank int, size long"
WORDS = ["alpha", "Beta", "gamma", "delta", "épsilon", "Zeta", "eta", "theta", "iota", "kappa"]


def texts() -> list:
    rng = random.Random(7)
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(5, 120))) for _ in range(40)]
    near = [" ".join([*x.split()[:-1], "changed"]) for x in base[:12]]
    long_ = " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(30_000))
    return [*base, *base[:5], base[0], *near, None, "", "   \n ", "one", "one two", "ONE two", long_, "same " * 3000, "don't <|endoftext|> “q”, x1234 — ÑÉ\u0301!", "shared line\n" + base[7]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k % 9 == 0 else "ab"[k % 2], None if k % 7 == 0 else f"s{k % 12}", 1, "k", "l", 1, 2, 3) for k, t in enumerate(texts())]
    rows += [(None, "no id", "a", "s1", 0, None, None, None, None, None), (3, rows[3][1], "a", "s3", 0, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return df.select("doc_id", "text").collect()


def test_words_match_regex():
    for table, pattern in ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        own = [t.replace("\n", " \t\x0b") if t else t for t in texts()]
        for first, end, buf, offsets in chunks(pa.array(own), 5000):
            words = Words(buf, offsets, table)
            raw = buf.tobytes()
            for k in range(end - first):
                lower = "".join(c.lower() if c.isascii() else c for c in own[first + k] or "")
                got = [raw[words.starts[j] : words.ends[j]].decode() for j in range(words.docs[k], words.docs[k + 1])]
                assert ["".join(c.lower() if c.isascii() else c for c in x) for x in got] == re.findall(pattern, lower)


def test_encoder_is_exact():
    rng = random.Random(3)
    signs = ["'s", "'", "don't", "12", "3.5", "<|endoftext|>", "<|", "é", "E\u0301", "“", "”,", "\u00a0", "×", "÷", "ß", "İ", "日本", "\u2003", "\x1c", "_", "#!", "x" * 300, "ÀÉ,", "\t\n"]
    own = ["".join(rng.choice([*signs, *WORDS, " "]) for _ in range(rng.randrange(0, 60))) for _ in range(800)] + [t or "" for t in texts()]
    plain, fast = Tokenizer.from_file(TOKENIZER), Encoder(TOKENIZER)
    for _ in range(2):
        for first, _end, buf, offsets in chunks(pa.array(own), 9000):
            ids, bounds = fast.encode(buf, offsets)
            for k in range(len(offsets) - 1):
                assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(own[first + k], add_special_tokens=False).ids


def test_exact_dedup(docs, empty):
    got = sorted(map(tuple, exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    groups: dict = {}
    for d, t in rows_of(docs):
        groups.setdefault(t or "", []).append(d)
    want = []
    for t, own in groups.items():
        keep = max((d for d in own if d is not None), default=None)
        want += [(d, keep, len(own), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in own]
    assert got == sorted(want, key=str)
    assert exact_dedup(empty).count() == 0


def test_line_dedup(spark, empty):
    rows = [(k, f"own {k}\nshared a\n\nshared b" if k % 2 else f"own {k}\nshared a\nshared a\n", None, f"s{k}", 0, None, None, None, None, None) for k in range(20)]
    rows += [(90, None, None, "s1", 0, None, None, None, None, None), (91, "", None, None, 0, None, None, None, None, None), (92, "few", None, "s1", 0, None, None, None, None, None), (93, "few", None, "s2", 0, None, None, None, None, None)]
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, SCHEMA), 8).collect()}
    assert got[0]["text"] == "own 0\nshared a\n" and got[1]["text"] == "own 1\n\nshared b" and got[3]["text"] == "own 3\n" and got[2]["text"] == "own 2\n"
    assert (got[3]["n_lines"], got[3]["n_removed"]) == (4, 2) and got[90]["text"] is None and got[91]["text"] == "" and got[92]["text"] == got[93]["text"] == "few"
    assert line_dedup(empty, 8).count() == 0


def test_url_filter(spark):
    urls = ["http://a.com/x", "https://www.EXAMPLE.com/en/1?q", "http://example.com/en/", "http://b.example.com/en", "http://x.net/es/?a", "http://net/fr/#b", "http://ynet/es/", "nothing", None, "://", "http://x.net", "http://q.org/a?b://c", "x://com:80/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), a == "block", h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    want = [(k, *judge(u)) for k, u in enumerate(urls)]
    assert sorted(map(tuple, url_filter(pages, URL_RULES).collect())) == want
    assert sorted(map(tuple, url_filter(pages, URL_RULES, broadcast_bytes=0).collect())) == want  # the way beyond the bound
    odd = [("block", "com", ""), ("allow", "com", "/x")]
    assert [r["verdict"] for r in url_filter(pages, odd).orderBy("page_id").collect()][:2] == ["allow", "block"]


def shingles(text, size):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def clusters(rows, size, percent):
    own = {d: shingles(t, size) for d, t in rows if d is not None}
    root = {d: d for d in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(own)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(own[d]), find(d)) for d in own}


@pytest.mark.parametrize(("block", "hot"), [(512, 4096), (4, 3)])
def test_near_dedup(spark, docs, empty, block, hot, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "HOT", hot)
    rng = random.Random(5)
    group = [f"w{k}" for k in range(60)]
    more = [(1000 + k, " ".join(rng.choice("xyz") + str(k) if rng.random() < 0.06 else w for w in group)) for k in range(40)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    for size, percent in ((3, 85), (5, 80)):
        want = clusters(rows_of(table), size, percent)
        for r in near_dedup.near_dedup(table, size, percent).collect():
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    if block == 512:
        assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_links_of_lists_of_two(spark):
    rng = random.Random(11)
    rows = []
    for k in range(120):  # an original with two copies that differ more from each other, or a chain of three revisions
        first = [f"v{k}x{rng.randrange(10**6)}" for _ in range(90)]
        other, chain = list(first), k % 2
        at = rng.sample(range(4, 86, 8), 6)
        for j in at[:2]:
            other[j] = f"o{k}x{j}"
        last = list(other if chain else first)
        for j in at[2 : 4 + k % 3 // 2]:
            last[j] = f"l{k}x{j}"
        rows += [(3 * k + d, " ".join(w)) for d, w in enumerate(rng.sample([first, other, last], 3))]
    want = clusters(rows, 3, 85)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_block_links_finds_every_link():
    rng = np.random.default_rng(1)
    n, sets = 16, [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    rows = [{"doc": k, "comp": k, "shingles": s.tobytes(), "own": list(range(1, n + 1)), "order": [64 * 2 + c for c in range(n)]} for k, s in enumerate(sets)]
    side = near_dedup._Side(rows, n)
    links = near_dedup.block_links(1, side, side, True, n, 5, 60)
    pairs = [(a, b) for a in range(30) for b in range(a + 1, 30) if near_dedup._linked(sets[a], sets[b], 60)]
    same = lambda edges: clusters_of(30, edges)
    assert same(links) == same(pairs)


def clusters_of(n, edges):
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_decontaminate(spark, docs, empty):
    base = texts()
    bench = [(1, " ".join(base[3].split()[2:30])), (2, "one two"), (10, "One, TWO"), (3, None), (4, ""), (5, "nowhere to be found at all in any of these texts here"), (None, base[9]), (1, " ".join(base[3].split()[2:30])), (6, " ".join(base[46].split()[100:140]))]
    table = spark.createDataFrame(bench, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = []
    for i, t in bench:
        w = words(t)
        n = min(10, len(w))
        windows += [(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n]
    by_length: dict = {}
    for i, win in windows:
        by_length.setdefault(len(win), {}).setdefault(win, set()).update({str(i)} if i is not None else set())
    rows = docs.select("doc_id", "text").collect()
    want = []
    for d, t in rows:
        w, hit, items = words(t), set(), set()
        for n, known in by_length.items():
            for k in range(len(w) - n + 1):
                if (found := known.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    items |= found
        want.append((d, len(w), sorted(hit), sorted(items)))
    for kwargs in ({}, {"block_bytes": 200}):
        got = [(r["doc_id"], r["n_words"], [k for a, b in r["spans"] for k in range(a, b)], r["items"]) for r in decontaminate(docs, table, **kwargs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate(empty, table, block_bytes=200).count() == 0 and max(n for _, n, _, _ in want) >= 30_000
    assert decontaminate(empty, table).count() == 0
    assert decontaminate(docs, table.limit(0)).where("size(spans) > 0").count() == 0


def test_sharding(docs, empty):
    got = shard_documents(docs, 5).collect()
    assert len(got) == docs.count() and shard_documents(empty, 5).count() == 0
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    of: dict = {}
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        of.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(x) == 1 for x in of.values())


def test_sharding_is_even(spark):
    rows = [(k, f"{k} " * (20 + k % 30), "en", "hot" if k % 3 else f"s{k % 5}", 0, None, None, None, None, None) for k in range(3000)]
    sizes: dict = {}
    for r in shard_documents(spark.createDataFrame(rows, SCHEMA), 24).collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and max(sizes.values()) < 1.1 * mean and min(sizes.values()) > 0.9 * mean


def test_packing(docs, empty):
    plain = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(docs, TOKENIZER, 256, 2).collect()
    ids = {d: plain.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows_of(docs)}
    assert sum(r["length"] for r in got) == sum(len(ids[d]) for d, _ in rows_of(docs))
    sequences: dict = {}
    for r in got:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(own) and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_packing_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    width = np.unique(packing.length_class(np.minimum(rng.lognormal(6, 1, 20000).astype(int) + 1, 4096)))
    demand = rng.integers(1, 400, len(width))
    plan = packing.plan(width, demand, 4096)
    assert (sum(c * t for c, t in plan) == demand).all() and all(c @ width <= 4096 for c, _ in plan)
    fractional = packing.patterns(width, demand.astype(float), 4096)[1].sum()
    assert sum(t for _, t in plan) <= fractional + len(width)
    value = rng.random(5)
    best, _ = packing.knapsack(np.array([3, 5, 7, 8, 11]), value, 30)
    brute = [0.0] * 31
    for c in range(1, 31):
        brute[c] = max([brute[c - 1], *[brute[c - w] + v for w, v in zip([3, 5, 7, 8, 11], value, strict=True) if w <= c]])
    assert np.allclose(best, brute)


def test_token_files(spark, docs, empty, tmp_path):
    plain = Tokenizer.from_file(TOKENIZER)
    manifest = token_files.write_tokens(docs, TOKENIZER, f"file://{tmp_path}/t", 1)
    got = token_files.read_tokens(spark, manifest).orderBy("start").collect()
    start = 0
    own = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    for r, (d, t) in zip(got, own, strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read_tokens(spark, token_files.write_tokens(empty, TOKENIZER, f"file://{tmp_path}/e", 1)).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 49408, 20001), np.full(5000, 7), np.concatenate([rng.integers(0, 9, 4096), [2**32 - 1]]), np.array([3])):
        ids = ids.astype(np.uint32)
        for p in (0.0, 0.5, 0.9, 1.0):
            blocks = token_files.encode_blocks(ids, p)
            starts = np.cumsum([0, *[len(b) for b in blocks]])[:-1]
            assert (token_files.decode_blocks(memoryview(b"".join(blocks)), starts) == ids).all()


def test_toxicity(spark, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(900):
        bad = k % 6 == 0
        words = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(60)]
        if bad:
            words[rng.randrange(60)] = rng.choice(["vile", "nasty"])
            words[rng.randrange(60)] = "awful"
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "vile")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([*labels[:600], (7, None), (None, 1)], "doc_id long, toxic int")
    weights = toxicity.fit(docs, table)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, weights).collect()}
    right = sum((got[k] >= 0.5) == bool(y) for k, y in labels[600:])
    assert right >= 285 and len(weights) < 5000 and got[5000] == got[5001] and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(empty, toxicity.fit(docs, table.limit(0))).count() == 0
    assert {r["score"] for r in toxicity.score(docs, {}).collect()} == {0.5}


def test_toxicity_inflected_words(spark):
    rng = random.Random(5)
    ends = ["".join(rng.choices("aeioust", k=4)) for _ in range(300)]
    rows, labels = [], []
    for k in range(900):
        words = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(60)]
        if k % 6 == 0:  # no form of the second half stands in the first
            for stem in ("vilé", "nastig"):
                words[rng.randrange(60)] = stem + ends[rng.randrange(150) + 150 * (k >= 600)]
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = toxicity.fit(docs, spark.createDataFrame(labels[:600], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, weights).collect()}
    assert sum((got[k] >= 0.5) == bool(y) for k, y in labels[600:]) >= 294


def test_language(spark, docs, empty):
    own = {"xx": "straße über der die und ein nicht", "yy": "the of and to in is that it was"}
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices(own[x].split(), k=30)), x, "clash") for k in range(200) for x in [("xx", "yy")[k % 2]]] + [(900, None, "xx", ""), (901, "123 !!", "yy", ""), (902, "abc", None, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in language.identify(table, language.fit(table.where("doc_id % 2 < 5"), PIECES)).collect()}
    assert sum(got[k]["lang_pred"] == ("xx", "yy")[k % 2] for k in range(200)) == 200
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0 and 0 < got[5]["score"] <= 1
    assert language.identify(empty, language.fit(table, PIECES)).count() == 0
    assert {r["lang_pred"] for r in language.identify(table, language.fit(table.limit(0), PIECES)).collect()} == {"und"}


def test_language_forward_sums_all_segmentations():
    pieces = language.Vocabulary(PIECES)
    rng = np.random.default_rng(0)
    p = rng.random((pieces.n, 1)) * 0.01
    word = b"thestation"
    buf = np.frombuffer(word, np.uint8)
    prefix = language.Prefix(buf, language.LOWER_VALUES)
    lattice = language.Lattice(pieces, buf, prefix, np.array([0]), np.array([len(word)]), np.array([True]))
    edges = [(end - length, end, p[piece[0], 0]) for end, length, at, piece in lattice.edges if len(at)]

    def total(at):
        return 1.0 if at == len(word) else sum(x * total(b) for a, b, x in edges if a == at)

    assert np.isclose(lattice.totals(p)[0, 0], total(0)) and len(edges) > len(word)
    counts = lattice.expected(p, np.array([[1.0]]))
    lengths = np.zeros(pieces.n)
    for _, length, at, piece in lattice.edges:
        lengths[piece] = length
    assert np.isclose(counts[:, 0] @ lengths, len(word))


def test_ranked(spark):
    rows = scratch.keep(spark.range(5000).selectExpr("id", "if(id < 4000, 'hot', null) AS g"), "ranked")
    got = scratch.ranked(rows, "g", ["id"], "rank", 300).collect()
    for g, n in (("hot", 4000), (None, 1000)):
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(n))


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.select(*corpus_pipeline.COLUMNS).where("doc_id IS NOT NULL").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(texts()[3].split()[2:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 3 not in kept and 40 not in kept and 0 in kept and 20 in kept and 52 not in kept
