"""Text encoders: where no pretrained model is at hand, words hashed into a vector of unit length, plain or fitted on a corpus.

An encoder is any function Column -> array<double>, so a model behind a pandas UDF can take this one's place.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

WIDTH = 64
#: Words whose document counts an encoder is fitted with; others count as words of no document.
MOST_WORDS = 50_000


def _coded(lists: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """Of lists of words, some lists at a time: (how many lists, list and word of each occurrence as numbers, distinct words)."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends, a = np.cumsum(sizes), 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        coded = lists.slice(a, b - a).flatten().dictionary_encode()
        yield b - a, np.repeat(np.arange(b - a), sizes[a:b]), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        a = b


def _hash(words: pa.Array) -> np.ndarray:
    return np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words.to_pylist()], np.int64)


def _vectors(lists: pa.Array, width: int, placed: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Sums of the words' weights by bucket, at length 1. placed: bucket and weight of distinct words."""
    out = [np.zeros((0, width))]
    for n, row, word, names in _coded(lists):
        bucket, weight = placed(names)
        v = np.bincount(row * width + bucket[word], weight[word], n * width).astype(float).reshape(n, width)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        out.append(np.divide(v, norm, out=v, where=norm > 0))
    flat = np.concatenate(out)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, width, dtype=np.int32)), pa.array(flat.ravel()))


def hashed(c: Column, width: int = WIDTH) -> Column:
    """Counts of the words by the first 32 bits of their md5, modulo width, at length 1; zeros for a text without words."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def encode(lists: pa.Array) -> pa.Array:
        return _vectors(lists, width, lambda names: (_hash(names) % width, np.ones(len(names))))

    return encode(c)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n): how many lists of a batch have a word."""
    for batch in batches:
        for _, row, word, names in _coded(batch.column("words")):
            both = np.unique(row * np.int64(max(1, len(names))) + word)
            yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(both % max(1, len(names)), minlength=len(names)))], ["w", "n"])


def fitted(corpus: DataFrame, words: Column, width: int = WIDTH, most: int = MOST_WORDS) -> Callable[[Column], Column]:
    """An encoder of arrays of words, fitted on a corpus: a word counts by its rarity there, ln((1 + n) / (1 + documents)) + 1, with a sign of its own.

    Bucket and sign come from the first 32 bits of the word's md5; a task counts documents over its distinct words before their shuffle, and ``most`` of the words are kept.
    """
    seen = corpus.select(words.alias("words")).mapInArrow(_documents, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(most).toArrow()
    total = corpus.count()
    weights = np.array([math.log((1 + total) / (1 + n)) + 1 for n in seen["n"].to_pylist()] + [math.log(1 + total) + 1])
    shipped = corpus.sparkSession.sparkContext.broadcast((seen["w"].combine_chunks(), weights))

    @F.arrow_udf(ArrayType(DoubleType()))
    def encode(lists: pa.Array) -> pa.Array:
        known, weights = shipped.value

        def placed(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            h, at = _hash(names), pc.index_in(names, value_set=known).fill_null(len(known)).to_numpy(zero_copy_only=False)
            return h // 2 % width, weights[at] * (1 - h % 2 * 2)

        return _vectors(lists, width, placed)

    return encode


def dual(first: Column, second: Column | None, width: int) -> Column:
    """Two vectors side by side; a missing second one is all zeros."""
    return F.concat(first, second if second is not None else F.array_repeat(F.lit(0.0), width))
