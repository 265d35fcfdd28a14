"""Token-id files of patched frame-of-reference blocks.

Documents are range-partitioned and sorted by doc_id; each task encodes its range and writes one
shard file into the shared folder:

    magic "TPFR0001"
    blocks: u32 minimum, u16 values, u8 width, u8 0, u16 exceptions, u16 0,
            ceil(values / 64) * width words (u64) of packed low bits,
            exceptions: u16 positions (padded to 8 bytes), u32 values (padded to 8 bytes)
    index:  u64 byte start of every block, i64 doc_id, u8 has-id and u32 tokens of every document
    tail:   u64 index start, u64 blocks, u64 documents, u64 tokens, magic

All numbers are little-endian.  A block subtracts its minimum and packs at the width that holds
``percentile`` of its values; the others are exceptions.  A document's ids may cross blocks.

Attempts never share a file: a task writes under a fresh name and reports it in its output row, so
the manifest (one row per shard) lists exactly the shards of successful attempts, and a lost executor
leaves at most an unlisted file.  Shards are read back from the manifest.

Defined results: null text is empty (its end id alone); null doc_ids come first; rows with one doc_id
follow each other in the order of their texts; an empty table writes no shard and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triplane.llm import scratch
from triplane.llm.tokens import encoder, with_end
from triplane.llm.words import chunks, release

MAGIC = b"TPFR0001"
BLOCK = 4096
_HEAD = struct.Struct("<IHBBHH")
_TAIL = struct.Struct("<QQQQ8s")
_RUN = 64  # blocks packed at once
_U = np.uint64


def pack_words(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values each to rows of ``width`` 64-bit words."""
    out = np.zeros((len(values), max(width, 1)), _U)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[:, word] |= values[:, j] << _U(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, j] >> _U(64 - shift)
    return out[:, :width]


def unpack_words(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack_words."""
    out = np.zeros((len(words), 64), _U)
    mask = _U((1 << width) - 1)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        x = words[:, word] >> _U(shift)
        if shift + width > 64:
            x = x | (words[:, word + 1] << _U(64 - shift))
        out[:, j] = x & mask
    return out


def encode_blocks(ids: np.ndarray, percentile: float) -> list[bytes]:
    """Blocks of BLOCK values each (the last one may be shorter)."""
    n = len(ids)
    count = -(-n // BLOCK)
    full = np.zeros(count * BLOCK, np.int64)
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    grid = full.reshape(count, BLOCK)
    low = grid.min(axis=1)
    rest = (grid - low[:, None]).astype(_U)
    sizes = np.full(count, BLOCK)
    sizes[-1:] = n - (count - 1) * BLOCK
    reach = np.partition(rest, min(BLOCK - 1, int(BLOCK * percentile)), axis=1)[:, min(BLOCK - 1, int(BLOCK * percentile))]
    widths = np.array([int(x).bit_length() for x in reach.tolist()])
    out: list[bytes] = [b""] * count
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        words = pack_words((rest[rows] & _U((1 << width) - 1)).reshape(-1, 64), width).astype("<u8").reshape(len(rows), -1)
        for row, own in zip(rows.tolist(), words, strict=True):
            size = int(sizes[row])
            odd = np.flatnonzero((rest[row, :size] >> _U(width)) > 0)
            where, what = odd.astype("<u2").tobytes(), (rest[row, odd]).astype("<u4").tobytes()
            out[row] = b"".join(
                [
                    _HEAD.pack(int(low[row]), size, width, 0, len(odd), 0),
                    b"\0" * 4,
                    own[: -(-size // 64) * width].tobytes(),
                    where + b"\0" * (-len(where) % 8),
                    what + b"\0" * (-len(what) % 8),
                ]
            )
    return out


def decode_blocks(raw: memoryview, starts: np.ndarray) -> np.ndarray:
    """Values of the blocks that start at the given bytes."""
    heads = [_HEAD.unpack_from(raw, s) for s in starts.tolist()]
    out = [np.zeros(0, np.uint32)] * len(heads)
    by_width: dict[int, list[int]] = {}
    for k, h in enumerate(heads):
        by_width.setdefault(h[2], []).append(k)
    for width, own in by_width.items():
        groups = [-(-heads[k][1] // 64) for k in own]
        words = np.concatenate([np.frombuffer(raw, "<u8", g * width, int(starts[k]) + 16) for k, g in zip(own, groups, strict=True)])
        values = unpack_words(words.reshape(-1, width) if width else np.zeros((sum(groups), 0), _U), width)
        at = 0
        for k, g in zip(own, groups, strict=True):
            low, size, _, _, odd, _ = heads[k]
            x = values[at : at + g].reshape(-1)[:size].copy()
            at += g
            if odd:
                place = int(starts[k]) + 16 + g * width * 8
                where = np.frombuffer(raw, "<u2", odd, place)
                x[where] = np.frombuffer(raw, "<u4", odd, place + odd * 2 + (-odd * 2 % 8))
            out[k] = (x + _U(low)).astype(np.uint32)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Writer:
    """One shard file; ids stream in and full runs of blocks stream out."""

    def __init__(self, uri: str, percentile: float):
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.file, self.percentile = fs.open_output_stream(path), percentile
        self.file.write(MAGIC)
        self.at, self.starts, self.waiting, self.held = 8, [], [], 0
        self.docs: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.known: list[np.ndarray] = []

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        n = len(ids) if all_ else len(ids) // BLOCK * BLOCK
        for s in range(0, n, BLOCK * _RUN):
            for block in encode_blocks(ids[s : min(n, s + BLOCK * _RUN)], self.percentile):
                self.starts.append(self.at)
                self.file.write(block)
                self.at += len(block)
        self.waiting, self.held = [ids[n:]], len(ids) - n

    def add(self, docs: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs)
        self.known.append(known)
        self.lengths.append(lengths)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK * _RUN:
            self._flush(False)

    def close(self) -> tuple[int, int]:
        """(documents, tokens)"""
        self._flush(True)
        docs, lengths, known = (np.concatenate(x) for x in (self.docs, self.lengths, self.known))
        for part in (np.array(self.starts, "<u8"), docs.astype("<i8"), known.astype("u1"), lengths.astype("<u4")):
            self.file.write(part.tobytes())
        tokens = int(lengths.sum())
        self.file.write(_TAIL.pack(self.at, len(self.starts), len(docs), tokens, MAGIC))
        self.file.close()
        return len(docs), tokens


def read_shard(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, has-id, lengths, ids) over runs of whole documents of one shard file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        at, blocks, docs, tokens, magic = _TAIL.unpack(f.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        index = f.read_at(size - _TAIL.size - at, at)
        starts = np.frombuffer(index, "<u8", blocks).astype(np.int64)
        names = np.frombuffer(index, "<i8", docs, blocks * 8)
        known = np.frombuffer(index, "u1", docs, (blocks + docs) * 8).astype(bool)
        lengths = np.frombuffer(index, "<u4", docs, (blocks + docs) * 8 + docs).astype(np.int64)
        upto, ends = np.concatenate([[0], np.cumsum(lengths)]), np.append(starts, at)
        held, done, seen = np.zeros(0, np.uint32), 0, 0
        for s in range(0, blocks, _RUN):
            own = starts[s : s + _RUN]
            begin, end = int(own[0]), int(ends[min(s + _RUN, blocks)])
            held = np.concatenate([held, decode_blocks(memoryview(f.read_at(end - begin, begin)), own - begin)])
            whole = int(np.searchsorted(upto, seen + len(held), "right")) - 1
            if whole > done:
                n = int(upto[whole] - seen)
                yield names[done:whole], known[done:whole], lengths[done:whole], held[:n]
                held, done, seen = held[n:], whole, int(upto[whole])
        if seen != tokens:
            raise ValueError(f"{uri} ends early")


def _write(path: str, folder: str, end_id: int, percentile: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, uri, low = encoder(path).encode, None, "", None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                uri = f"{folder}/shard-{uuid.uuid4().hex}.tpfr"
                writer, low = Writer(uri, percentile), batch.column(0)[0].as_py()
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            names = batch.column(0).fill_null(0).to_numpy()
            for first, end, buf, offsets in chunks(batch.column(1)):
                ids, bounds = with_end(*encode(buf, offsets), end_id)
                writer.add(names[first:end], known[first:end], np.diff(bounds), ids)
        if writer is not None:
            docs, tokens = writer.close()
            writer = None
            release()
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri]), pa.array([low], pa.int64()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], names=["file", "low", "docs", "tokens"]
            )

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, percentile: float = 0.9) -> DataFrame:
    """Write shard files below ``folder`` and return the manifest: file, docs, tokens, start."""
    scratch.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = rows.mapInArrow(_write(tokenizer, folder, end_id, percentile), "file string, low long, docs long, tokens long")
    made = scratch.keep(made, "manifest")
    before = Window.orderBy(F.asc_nulls_first("low")).rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return made.select("file", "docs", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for names, known, lengths, ids in read_shard(uri):
                upto = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for n, b in zip(lengths.tolist(), upto.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, mask=~known), pa.array(start + upto - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                start += int(upto[-1])
            release()


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    scratch.ship(spark)
    shards = max(1, manifest.count())
    return manifest.select("file", "start").repartition(shards).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
