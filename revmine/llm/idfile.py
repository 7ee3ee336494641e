"""Token ids in binary shards: bit- or byte-plane shuffled blocks, zstandard, and a chunk index.

A shard is: magic, blocks, the document index, the chunk index, a footer of fixed size. A block is a fixed
number of ids (the last one fewer), transposed into 4 byte planes or 32 bit planes, each compressed by
itself (an empty plane is one byte); the chunk index has offset, plane sizes, count and CRC-32 of each
block. Documents are range-partitioned and sorted by id, every partition writes its shards in order, and
the shards' counts are prefix-summed, so ``start`` needs no pass over the ids.

Words are encoded through a bounded cache in each worker, so that the tokenizers library meets a word once
a worker rather than once an occurrence.

Defined cases: null text is an empty text (only the end id); a text is encoded whole, in its task's memory, however
long, and may run over many blocks; ids may be numbers or strings, null ids come first; rows that repeat an id stand in
the order of their texts' hashes; an empty table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common, wordtable

MAGIC, BLOCK_IDS, SHARD_IDS, END_ID = b"RVIDS001", 65_536, 32_000_000, 0
#: Words that a worker remembers before it starts anew (and those of the texts of one call, about 2 MB).
CACHE_WORDS = 1_000_000
_FOOTER = "<QQQQQQQ8s"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return [x.tobytes() for x in planes]
    return [np.packbits((plane >> k) & 1).tobytes() for plane in planes for k in range(8)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if bits:
        planes = [sum((np.unpackbits(np.frombuffer(planes[8 * b + k], np.uint8), count=n) << k for k in range(1, 8)), np.unpackbits(np.frombuffer(planes[8 * b], np.uint8), count=n)).astype(np.uint8).tobytes() for b in range(4)]
    return np.ascontiguousarray(np.frombuffer(b"".join(planes), np.uint8).reshape(4, n).T).view("<u4").ravel()


def write_shard(uri: str, documents: Iterator[tuple[object, bytes]], bits: bool = False, block_ids: int = BLOCK_IDS, kind: pa.DataType | None = None) -> tuple[int, int, int]:
    """documents: (id of the type kind, its ids as little-endian unsigned 32-bit). Gives (documents, ids, bytes)."""
    names, counts, index, packer, state = [], [], [], zstandard.ZstdCompressor(level=3), [len(MAGIC), 0]

    def block(data: bytes) -> bytes:
        packed = [packer.compress(p) if p.strip(b"\0") else b"\0" for p in to_planes(np.frombuffer(data, "<u4"), bits)]
        index.append((state[0], len(data) // 4, zlib.crc32(data), *map(len, packed)))
        state[0] += sum(map(len, packed))
        return b"".join(packed)

    def parts() -> Iterator[bytes]:
        yield MAGIC
        held, size, most = [], 0, 4 * block_ids
        for name, data in documents:
            names.append(name)
            counts.append(len(data) // 4)
            held.append(data)
            size += len(data)
            state[1] += len(data) // 4
            if size >= most:
                whole = b"".join(held)
                for a in range(0, size - size % most, most):
                    yield block(whole[a : a + most])
                held, size = [whole[size - size % most :]], size % most
        if size:
            yield block(b"".join(held))
        docs = packer.compress(np.array(counts, "<i8").tobytes() + wordtable.stream_of(pa.array(names, kind)))
        chunks = packer.compress(np.array(index, "<i8").tobytes())
        yield docs
        yield chunks
        yield struct.pack(_FOOTER, state[0], len(docs), len(chunks), len(names), len(index), state[1], int(bits), MAGIC)

    size = common.write_bytes(uri, parts())
    return len(names), state[1], size


class Shard:
    """Random access to a shard through its indexes."""

    def __init__(self, uri: str):
        system, path = common.pafs_of(uri)
        self.file = system.open_input_file(path)
        self.file.seek(self.file.size() - struct.calcsize(_FOOTER))
        at, docs, chunks, self.n_docs, blocks, self.n_ids, self.bits, magic = struct.unpack(_FOOTER, self.file.read(struct.calcsize(_FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard of token ids")
        self.file.seek(at)
        unpack = zstandard.ZstdDecompressor().decompress
        raw = unpack(self.file.read(docs))
        n = self.n_docs
        self.counts, self.names = np.frombuffer(raw, "<i8", n), wordtable.array_of(raw[8 * n :])
        self.chunks = np.frombuffer(unpack(self.file.read(chunks)), "<i8").reshape(blocks, -1)

    def block(self, k: int) -> bytes:
        at, n, crc, *sizes = self.chunks[k].tolist()
        self.file.seek(at)
        raw, unpack = self.file.read(sum(sizes)), zstandard.ZstdDecompressor().decompress
        empty, planes = bytes(-(-n // 8) if self.bits else n), []
        for size in sizes:
            planes.append(empty if size == 1 else unpack(raw[:size]))
            raw = raw[size:]
        data = from_planes(planes, n, bool(self.bits)).tobytes()
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {k} fails its CRC-32")
        return data

    def documents(self) -> Iterator[tuple[object, int, list[memoryview]]]:
        """(id, number of ids, the ids' bytes in parts), block after block."""
        k, data, at = -1, memoryview(b""), 0
        for name, count in zip(self.names.to_pylist(), self.counts.tolist()):
            need, found = 4 * count, []
            while need:
                if at == len(data):
                    k, at = k + 1, 0
                    data = memoryview(self.block(k))
                part = data[at : at + need]
                found.append(part)
                at += len(part)
                need -= len(part)
            yield name, count, found


class CachedEncoder:
    """texts -> ids as bytes, through a bounded table of words met before: a word costs one lookup, and a new one the encoder once."""

    def __init__(self, vocabulary: str):
        self.cut, self.encode = bpe.splitter(bpe.added_tokens(vocabulary)), bpe.WordEncoder(vocabulary)
        self.clear()

    def clear(self) -> None:
        self.numbers: defaultdict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.starts, self.counts, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.numbers) > CACHE_WORDS:
            self.clear()
        words = [self.cut(x) for x in texts]
        known, sizes = len(self.numbers), np.array([len(x) for x in words], np.int64)
        flat = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        if len(self.numbers) > known:
            starts, counts, values = self.encode(list(islice(self.numbers, known, None)))
            self.starts, self.counts, self.values = np.append(self.starts, starts + len(self.values)), np.append(self.counts, counts), np.append(self.values, values)
        ids, ends = bpe.gathered(self.starts, self.counts, self.values, flat)
        cuts = np.append(0, ends)[np.append(0, np.cumsum(sizes))].tolist()
        data = ids.astype("<u4")
        return [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def encoder(vocabulary: str) -> CachedEncoder:
    cache, key = common.worker_cache(), f"encoder-{hash(vocabulary)}"
    if key not in cache:
        cache[key] = CachedEncoder(vocabulary)
    return cache[key]


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, end_id: int = END_ID, bits: bool = False, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode, append end_id to each document, and write shards in ascending id order: (part, shard, path, start, n_docs, n_ids, bytes)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(bpe.vocabulary_text(vocabulary_path))
    slim = docs.select(common.id_of(docs, id_col).alias("id"), common.text_of(docs, text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part, kind = encoder(vocabulary.value), struct.pack("<I", end_id), TaskContext.get().partitionId(), None

        def documents() -> Iterator[tuple[object, bytes]]:
            nonlocal kind
            held, chars = [], 0
            for rows in batches:
                kind = rows.column(0).type
                for i, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                    held.append((i, text.as_py()))
                    chars += len(held[-1][1])
                    if chars > 2_000_000:
                        yield from ((k, x + end) for (k, _), x in zip(held, encode([t for _, t in held])))
                        held, chars = [], 0
            yield from ((k, x + end) for (k, _), x in zip(held, encode([t for _, t in held])))

        coming, shard = documents(), 0
        first = next(coming, None)
        while first is not None:
            rest: list = []

            def taken(first=first, rest=rest) -> Iterator[tuple[object, bytes]]:
                size = 0
                while first is not None:
                    if size and size + len(first[1]) > 4 * shard_ids:
                        rest.append(first)
                        return
                    size += len(first[1])
                    yield first
                    first = next(coming, None)

            path = f"{folder}/shards/{part:07d}-{shard:05d}.ids"
            n_docs, n_ids, size = write_shard(path, taken(), bits, kind=kind)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, shard, path, n_docs, n_ids, size)], ["part", "shard", "path", "n_docs", "n_ids", "bytes"])
            first, shard = (rest[0] if rest else None), shard + 1

    sorted_ = slim.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    shards = common.written(sorted_.mapInArrow(task, "part long, shard long, path string, n_docs long, n_ids long, bytes long"), folder, "shards-table")
    before = F.sum("n_ids").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1))
    return shards.withColumn("start", F.coalesce(before, F.lit(0)))


def read(shards: DataFrame, id_col: str = "doc_id", id_kind: str = "long") -> DataFrame:
    """Per document, from the files: doc_id (of the type id_kind), start, n_tokens, ids_crc32, first_ids (up to 8)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (x for rows in batches for x in rows.to_pylist()):
            names, starts, counts, crcs, heads, start = [], [], [], [], [], row["start"]
            shard = Shard(row["path"])
            for name, count, parts in shard.documents():
                crc, head = 0, []
                for part in parts:
                    crc = zlib.crc32(part, crc)
                if parts:
                    head = np.frombuffer(parts[0][:32], "<u4").astype(np.int64).tolist()
                for to, x in zip((names, starts, counts, crcs, heads), (name, start, count, crc, head)):
                    to.append(x)
                start += count
            out = pa.RecordBatch.from_arrays([pa.array(names, shard.names.type), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(heads, pa.list_(pa.int64()))], [id_col, "start", "n_tokens", "ids_crc32", "first_ids"])
            yield from common.in_parts(out, 20_000)

    return common.spread(shards.select("path", "start"), "path").mapInArrow(task, f"`{id_col}` {id_kind}, start long, n_tokens long, ids_crc32 long, first_ids array<long>")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, bits: bool = False) -> DataFrame:
    return read(write(docs, common.shared_folder(docs.sparkSession, "idfile"), id_col, text_col, vocabulary_path, bits=bits), id_col, common.id_kind(docs, id_col))
