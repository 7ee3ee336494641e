"""What the corpus operators share: the shared work folder, binary files in it, hashing of row groups."""

from __future__ import annotations

import atexit
import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: a run of bytes other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``.

    Where that setting is absent, a local session (tests) gets one under /tmp; a cluster must set it.
    The folder lives as long as the driver: results are read from it lazily.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/revmine/{purpose}-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = folder.replace("file:/", "file:///") if folder.startswith("file:/") else f"file://{folder}"
    pafs_of(folder)
    atexit.register(_drop, folder)
    return folder


def pafs_of(uri: str) -> tuple[pafs.FileSystem, str]:
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path


def _drop(uri: str) -> None:
    try:
        system, path = pafs_of(uri)
        system.delete_dir(path)
    except (OSError, pa.ArrowException):
        pass  # never written, or gone with the cluster


def drop_folder(uri: str) -> None:
    """Free a work folder whose contents nothing reads any more."""
    _drop(uri)


def write_bytes(uri: str, data: bytes | Iterator[bytes]) -> int:
    """Write a file whole or not at all: under another name first, so a lost attempt leaves nothing that is read."""
    system, path = pafs_of(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with system.open_output_stream(draft, compression=None) as out:
        for part in [data] if isinstance(data, bytes) else data:
            out.write(part)
            size += len(part)
    try:
        system.move(draft, path)
    except OSError:
        if system.get_file_info(path).type != pafs.FileType.File:
            raise
        system.delete_file(draft)  # where a move replaces nothing: an earlier attempt of the task has put the same bytes there
    return size


def read_bytes(uri: str, start: int = 0, size: int | None = None) -> bytes:
    system, path = pafs_of(uri)
    with system.open_input_file(path) as file:
        file.seek(start)
        return file.read() if size is None else file.read(size)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut lineage: the frame as a Parquet table in the shared folder, read back."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """A few small rows that stand for much work (files, byte ranges), over all partitions; Spark would coalesce them by their size otherwise."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def worker_cache() -> dict:
    """What one Python worker keeps between tasks."""
    return sys.modules.setdefault("_revmine_worker", types.ModuleType("_revmine_worker")).__dict__


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, beside a JVM that needs the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; texts that are all ASCII take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def own(docs: DataFrame) -> list[Column]:
    """The columns of docs, to be selected beside columns that a step has added."""
    return [quoted(c) for c in docs.columns]


def prefix(docs: DataFrame) -> str:
    """What no column of docs begins with, for the names of a step's own columns beside them."""
    found = "__"
    while any(c.lower().startswith(found) for c in docs.columns):
        found += "_"
    return found


def id_kind(docs: DataFrame, id_col: str) -> str:
    """Type of ids in results: long for whole numbers, else that of the column (strings, say)."""
    kind = docs.select(quoted(id_col)).schema[0].dataType.simpleString()
    return "long" if kind in ("tinyint", "smallint", "int", "bigint") else kind


def id_of(docs: DataFrame, id_col: str) -> Column:
    return quoted(id_col).cast(id_kind(docs, id_col))


def text_of(docs: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(quoted(text_col).cast("string"), F.lit(""))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Tables of the rows with one key, from batches in which such rows stand together."""
    import numpy as np

    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if held and keys[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def in_parts(rows: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, rows.num_rows, size):
        yield rows.slice(i, size)


def map_arrow(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(task, schema)
