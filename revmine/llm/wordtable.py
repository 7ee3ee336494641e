"""Batch dictionaries: documents as numbers of words, so that only distinct words travel.

A task splits its documents into words and numbers the distinct ones of a batch (a bounded amount of
text). The numbers stay in one compressed file a batch in the shared folder; what is shuffled is a row
for each distinct word of a batch, never one for each occurrence. Values found once for each word go
back to their batch by (batch, pos) and meet the numbers there. Batch keys follow from the input split
alone, so a task that runs again after a lost executor writes the same files and rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of text in a batch; a longer document is a batch of its own.
BATCH_CHARS = 24_000_000
OCCURRENCES = "batch long, pos int, word string, n long"


class Numbered(NamedTuple):
    """A batch: its documents in order, and the words' numbers one document after the other."""

    ids: pa.Array
    flags: np.ndarray
    sizes: np.ndarray
    words: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.sizes)


def pack(b: Numbered) -> bytes:
    planes = np.ascontiguousarray(b.words.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    ids = stream_of(b.ids)
    head = np.array([len(b.ids), len(b.words), len(ids)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + ids + b.flags.astype(np.uint8).tobytes() + b.sizes.astype("<i8").tobytes() + planes.tobytes())


def unpack(data: bytes) -> Numbered:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, m, size = np.frombuffer(raw, "<i8", 3).tolist()
    at = 24 + size
    flags = np.frombuffer(raw, np.uint8, n, at)
    sizes = np.frombuffer(raw, "<i8", n, at + n)
    planes = np.frombuffer(raw, np.uint8, 4 * m, at + 9 * n).reshape(4, m)
    return Numbered(array_of(raw[24:at]), flags.astype(bool), sizes, np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int32))


def stream_of(values: pa.Array) -> bytes:
    """An array of any type as bytes (an Arrow stream)."""
    rows, sink = pa.record_batch([values], ["v"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def array_of(data: bytes) -> pa.Array:
    (rows,) = pa.ipc.open_stream(data)
    return rows.column(0)


def batch_file(folder: str, batch: int) -> str:
    return f"{folder}/batches/{batch}.zst"


def _strings(words: list) -> pa.Array:
    """Words as strings; a splitter may give str or UTF-8 bytes."""
    if words and isinstance(words[0], bytes):
        return pa.array(words, pa.binary()).cast(pa.string())
    return pa.array(words or [None], pa.string())


def split_batches(docs: DataFrame, split: Callable[[], Callable[[str], list[str]]], folder: str, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """docs(id of any type, text string, flag boolean) -> a row for each distinct word of each batch.

    split() makes the splitter in the worker. n counts the word's occurrences in flagged documents.
    A batch without words still gives one row (pos -1, word null), so that its documents are not lost.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, pid, order = split(), TaskContext.get().partitionId(), 0
        numbers: defaultdict = defaultdict()
        numbers.default_factory = numbers.__len__
        ids, flags, parts, chars, kind = [], [], [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal order, chars, ids, flags, parts
            sizes = np.array([len(x) for x in parts], np.int64)
            words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            whole = Numbered(pa.array(ids, kind), np.array(flags, bool), sizes, words)
            batch = (pid << 24) | order
            common.write_bytes(batch_file(folder, batch), pack(whole))
            count = np.bincount(words[np.repeat(whole.flags, sizes)], minlength=len(numbers))
            rows = pa.RecordBatch.from_arrays([pa.array(np.full(max(1, len(numbers)), batch)), pa.array(np.arange(len(numbers), dtype=np.int32) if numbers else np.array([-1], np.int32)), _strings(list(numbers)), pa.array(count.astype(np.int64) if numbers else np.zeros(1, np.int64))], ["batch", "pos", "word", "n"])
            order += 1
            numbers.clear()
            ids, flags, parts, chars = [], [], [], 0
            del whole, words, sizes, count
            common.give_back()
            return common.in_parts(rows, 65_536)

        for rows in batches:
            kind = rows.column(0).type
            for i, text, flag in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2).to_pylist()):
                text = text.as_py() or ""
                if ids and chars + len(text) > batch_chars:
                    yield from flush()
                found = cut(text)
                ids.append(i)
                flags.append(bool(flag))
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                chars += len(text)
        if ids:
            yield from flush()
        common.give_back()

    return docs.mapInArrow(task, OCCURRENCES)


def sums(whole: Numbered, values: np.ndarray) -> np.ndarray:
    """values (one for each occurrence) summed by document; equal documents get equal sums."""
    out, some = np.zeros(len(whole.sizes)), whole.sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (whole.ends - whole.sizes)[some])
    return out


def squeeze(columns: list[np.ndarray]) -> bytes:
    """Integer columns of one length as bytes: each in the narrowest width that holds it, byte plane by byte plane; longer ones compressed."""
    out = [np.array([len(columns[0])], "<u4").tobytes()]
    for x in columns:
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
        width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w - 1)
        out.append(bytes([width]) + np.ascontiguousarray(x.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T).tobytes())
    data = b"".join(out)
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(data) if len(data) > 512 else b"\0" + data


def unsqueeze(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data[1:]) if data[0] else data[1:]
    n, at, out = int(np.frombuffer(data, "<u4", 1)[0]), 4, []
    while at < len(data):
        width = data[at]
        planes = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<i{width}").reshape(n).astype(np.int64))
        at += 1 + n * width
    return out


def parcels(rows: Iterator[tuple[np.ndarray, ...]], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(batch, pos, integer values...) columns -> one row (batch, data) for all values of a batch among ``most`` rows."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        batch, *columns = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((columns[0], batch))
        batch, columns = batch[order], [x[order].astype(np.int64) for x in columns]
        starts = np.flatnonzero(np.concatenate(([True], batch[1:] != batch[:-1])))
        ends = [*starts[1:].tolist(), len(batch)]
        data = [squeeze([np.diff(columns[0][a:b], prepend=0), *(x[a:b] for x in columns[1:])]) for a, b in zip(starts.tolist(), ends)]
        return pa.RecordBatch.from_arrays([pa.array(batch[starts]), pa.array(data, pa.binary())], ["batch", "data"])

    for columns in rows:
        held.append(columns)
        size += len(columns[0])
        if size >= most:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def opened(data: pa.ChunkedArray) -> list[np.ndarray]:
    """The values of a batch by pos, from all its parcels."""
    parts = [unsqueeze(x.as_py()) for x in data]
    places = [np.cumsum(steps) for steps, *_ in parts]
    out = [np.zeros(1 + max((int(p.max(initial=-1)) for p in places), default=-1), np.int64) for _ in parts[0][1:]]
    for at, (_, *values) in zip(places, parts):
        for to, x in zip(out, values):
            to[at[at >= 0]] = x[at >= 0]
    return out


def by_batch(values: DataFrame, *order: str) -> DataFrame:
    """The rows of each batch together, in order. Batches are of bounded size and are dealt to the partitions in turn, so each gets its share."""
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.shiftright("batch", 24) + F.col("batch").bitwiseAND(F.lit((1 << 24) - 1)) * 7919
    return values.repartitionById(n, F.pmod(turn, F.lit(n)).cast("int")).sortWithinPartitions("batch", *order)
