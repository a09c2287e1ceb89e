"""Token ids in directly addressable codes.

A file holds a stream of token ids. Each id is split into 8-bit chunks; chunk
level k holds the k-th chunk of all ids that have one, with a bitmap that tells
which of them go on, and a rank directory over the bitmap. The place of an id
on the next level is the number of set bits before it, so any id or run of ids
is read from a few byte ranges without decoding what comes before.

Layout (little-endian): magic, u64 ids, u32 levels, u32 zero; for each level u64 entries,
u64 offset of the codes, u64 offset of the bitmap, u64 offset of the directory;
then the arrays. The bitmap is least-bit first; the directory has a u64 count of
the set bits before each block of 512 bits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.storage import Scratch, tasks

MAGIC = b"WLDAC001"
BLOCK_BYTES = 64
#: Ids after which a file is closed (at the next end of a document).
FILE_IDS = 1 << 24
#: Words whose ids a worker remembers.
REMEMBERED = 1_000_000
#: A space after a non-space always starts a new unit of the tokenizer.
UNIT = re.compile(r"(?<=[^\s\x1c-\x1f]) ")
#: Texts in which a space follows white space; all others are cut at every space.
ODD = re.compile(r"[\s\x1c-\x1f] ")


def pack(ids: np.ndarray) -> bytes:
    """The file's bytes for an array of unsigned 32-bit ids."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        on = rest > 0xFF
        bits = np.packbits(on, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % BLOCK_BYTES, np.uint8)))
        ones = np.bitwise_count(bits.reshape(-1, BLOCK_BYTES)).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)))
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()))
        rest = rest[on] >> np.uint32(8)
        if not len(rest):
            break
    head = MAGIC + np.array([len(ids)], "<u8").tobytes() + np.array([len(levels), 0], "<u4").tobytes()
    at, table, body = len(head) + 32 * len(levels), [], []
    for n, *arrays in levels:
        entry = [n]
        for a in arrays:
            entry.append(at)
            at += len(a)
            body.append(a)
        table.append(np.array(entry, "<u8").tobytes())
    return b"".join([head, *table, *body])


class Reader:
    """Random access to a packed file; ``read_at(size, offset)`` gives its bytes."""

    def __init__(self, read_at):
        self.read_at = read_at
        head = read_at(24, 0)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.size = int(np.frombuffer(head, "<u8", 1, 8)[0])
        levels = int(np.frombuffer(head, "<u4", 1, 16)[0])
        self.levels = np.frombuffer(read_at(32 * levels, 24), "<u8").reshape(-1, 4).astype(np.int64)

    def _bits(self, level: np.ndarray, start: int, stop: int) -> np.ndarray:
        raw = self.read_at((stop + 7) // 8 - start // 8, int(level[2]) + start // 8)
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[start % 8 : start % 8 + stop - start].astype(bool)

    def _rank(self, level: np.ndarray, at: int) -> int:
        """Set bits before ``at``: a directory entry and part of one block."""
        block = at // (8 * BLOCK_BYTES)
        before = int(np.frombuffer(self.read_at(8, int(level[3]) + 8 * block), "<u8")[0])
        return before + int(self._bits(level, block * 8 * BLOCK_BYTES, at).sum())

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n``."""
        if not 0 <= start <= start + n <= self.size:
            raise IndexError((start, n, self.size))
        out, where = np.zeros(n, np.uint32), np.arange(n)
        for k, level in enumerate(self.levels):
            if not len(where):
                break
            codes = np.frombuffer(self.read_at(len(where), int(level[1]) + start), np.uint8)
            out[where] |= codes.astype(np.uint32) << np.uint32(8 * k)
            if k + 1 < len(self.levels):
                on = self._bits(level, start, start + len(where))
                start, where = self._rank(level, start), where[on]
        return out

    def __getitem__(self, at: int) -> int:
        return int(self.read(at, 1)[0])


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file; words seen before are not encoded again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # words come once: looking them up costs more than it saves
        names = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[k for name, k in names.items() if name[0] == "\u0120"]] = True  # the byte-level sign of a space
        self.known: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, units: list[str]) -> None:
        """Ids of ``' ' + unit`` for each unit; with one space in each, ids that begin with a space tell where units begin."""
        got = self.tokenizer.encode_batch_fast(["".join([f" {u}" for u in units])], add_special_tokens=False)[0]
        ids = np.array(got.ids, "<u4")
        starts = np.flatnonzero(self.spaced[ids]) * 4
        raw, ends = ids.tobytes(), [*starts[1:].tolist(), 4 * len(ids)]
        self.known.update((u, raw[a:b]) for u, a, b in zip(units, starts.tolist(), ends, strict=True))

    def _units(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, list[str]]:
        """All units but the first of each text, how many a text has, and the first units."""
        strange = [ODD.search(text) is not None for text in texts]
        lists = pc.split_pattern(pa.array([t for t, s in zip(texts, strange, strict=True) if not s], pa.string()), " ")
        offsets, flat = lists.offsets.to_numpy(), lists.flatten()
        later = np.ones(len(flat), bool)
        later[offsets[:-1] - offsets[0]] = False  # a text has one unit at least
        kept, begun, counts = flat.filter(pa.array(later)), flat.filter(pa.array(~later)).to_pylist(), (np.diff(offsets) - 1).tolist()
        if not any(strange):
            return kept, np.array(counts), begun
        plain, at, words, firsts, sizes = iter(zip(begun, counts, strict=True)), 0, [], [], []
        for text, s in zip(texts, strange, strict=True):
            if s:
                first, *units = UNIT.split(text)
                words.append(pa.array(units, pa.string()))
                n = len(units)
            else:
                first, n = next(plain)
                words.append(kept.slice(at, n))
                at += n
            firsts.append(first)
            sizes.append(n)
        return pa.concat_arrays(words), np.array(sizes), firsts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        flat, sizes, firsts = self._units(texts)
        coded = flat.dictionary_encode()
        words, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids = list(map(known.get, words))
        missing = [k for k, x in enumerate(ids) if x is None]
        new = [words[k] for k in missing]
        plain = [u for u in new if " " not in u]
        for at in range(0, len(plain), 500):
            self._learn(plain[at : at + 500])
        known.update((u, self._plain(f" {u}")) for u in new if " " in u)
        for k in missing:
            ids[k] = known[words[k]]
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(length) - length
        each = length[place]
        stop = np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))
        out = pool[np.repeat(start[place] - stop[:-1], each) + np.arange(stop[-1])]
        ends = stop[np.cumsum(sizes)].tolist()
        return [(self._plain(first) if first else b"") + out[a:b].tobytes() for first, a, b in zip(firsts, [0, *ends[:-1]], ends, strict=True)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _batches(texts: list[str], size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes docs, writes token files in ascending doc_id order below ``folder`` and returns their index.

    Index rows: doc_id, file, part and seq (which order the files), at (place in
    the file), n_tokens with the end id. Docs are range-partitioned by doc_id
    and sorted; each task streams its range into files of about ``file_ids``
    ids. Every attempt of a task writes files of its own name, and the index
    holds those of the attempts that counted, so a lost executor or a second
    attempt leaves at most files that nobody refers to. The folder must be one
    that pyarrow can write and all executors share. A null text is empty;
    documents with one doc_id follow each other in the order of their texts'
    CRC-32; null ids come first.
    """
    spark = docs.sparkSession
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("file", T.StringType()), ("part", T.IntegerType()), ("seq", T.IntegerType()), ("at", T.LongType()), ("n_tokens", T.LongType())))])

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, own, encoder = TaskContext.get().partitionId(), uuid.uuid4().hex, _encoder(tokenizer)
        last = np.array([end], "<u4").tobytes()
        seq, held, rows, total = 0, [], [], 0

        def close() -> pd.DataFrame:
            nonlocal seq, held, rows, total
            name = f"part-{part:06d}-{seq:04d}-{own}.dac"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(pack(np.frombuffer(b"".join(held), "<u4")))
            frame = pd.DataFrame(rows, columns=["doc_id", "at", "n_tokens"]).assign(file=name, part=part, seq=seq)
            seq, held, rows, total = seq + 1, [], [], 0
            return frame[schema.names]

        for frame in frames:
            keys, texts = frame["doc_id"].tolist(), [t or "" for t in frame["text"].tolist()]
            for a, b in _batches(texts):
                for key, raw in zip(keys[a:b], encoder.encode(texts[a:b]), strict=True):
                    held.append(raw + last)
                    rows.append((None if key != key else key, total, len(raw) // 4 + 1))
                    total += len(raw) // 4 + 1
                    if total >= file_ids:
                        yield close()
        if rows:
            yield close()

    order = ["doc_id", "_crc"]  # short keys: their samples go to the driver
    ranged = docs.select("doc_id", "text", F.crc32(F.encode("text", "utf-8")).alias("_crc")).repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return ranged.mapInPandas(encode, schema)


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """index with ``ids`` (little-endian unsigned 32-bit integers), read by random access."""
    schema = T.StructType([*index.schema.fields, T.StructField("ids", T.BinaryType())])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for frame in frames:
            for name, rows in frame.groupby("file", sort=False):
                with fs.open_input_file(f"{root}/{name}") as f:
                    reader = Reader(f.read_at)
                    for at in range(0, len(rows), 1000):
                        some = rows.iloc[at : at + 1000]
                        yield some.assign(ids=[reader.read(a, n).astype("<u4").tobytes() for a, n in zip(some["at"].tolist(), some["n_tokens"].tolist(), strict=True)])

    return index.mapInPandas(read, schema)


def token_report(docs: DataFrame, tokenizer: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes docs as token files, reads them back and reports start, length and CRC-32 of each document's ids."""
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = scratch.path("files")
    index = scratch.write(write_tokens(docs, folder, tokenizer, file_ids=file_ids), "index")
    sizes = index.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))  # a row a file
    before = sizes.select("part", "seq", F.coalesce(F.sum("n").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    crc = read_tokens(index, folder).select("doc_id", "part", "seq", "at", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return crc.join(before, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
