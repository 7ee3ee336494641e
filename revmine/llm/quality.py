"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes become learned vectors;
learned filters of WIDTH bytes run over each chunk; a filter's largest response in a chunk is the chunk's
feature. Over the chunks the largest and the mean of each feature are taken and combined into one
probability that the label is 1.

Training: at most ``sample`` labelled documents (in the order of a hash of the id, so the bound does not
depend on how rows are stored), on the driver, with at most ``max_bytes`` of each: a longer one gives pieces spread
evenly over its whole text; scoring: every whole text, on
the executors, in blocks of chunks, so memory does not grow with a document beyond its bytes. Labels and
other columns are never inputs of a score.

Defined cases: null text is an empty text (one chunk of padding is scored); without labelled rows of both
kinds every score is the share of ones (0.5 without any); an id labelled twice counts with its larger label;
repeated rows get equal scores; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

VECTOR, WIDTH, STRIDE, FILTERS, POSITIONS = 8, 8, 2, 24, 256
HOP = STRIDE * POSITIONS
CHUNK = HOP - STRIDE + WIDTH
SAMPLE, MAX_BYTES, PIECES, EPOCHS, SEED = 3000, 60_000, 16, 8, 5
BLOCK = 48


class Model(NamedTuple):
    vectors: np.ndarray  # (256, VECTOR)
    filters: np.ndarray  # (WIDTH * VECTOR, FILTERS)
    offsets: np.ndarray  # (FILTERS,)
    largest: np.ndarray  # (FILTERS,)
    mean: np.ndarray  # (FILTERS,)
    bias: np.ndarray  # (1,)


def chunks(data: bytes) -> np.ndarray:
    """(n, CHUNK): chunks that overlap by WIDTH - STRIDE bytes; the end is filled with zeros."""
    n = max(1, -(-(len(data) - WIDTH + STRIDE) // HOP))
    whole = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    whole[: len(data)] = np.frombuffer(data, np.uint8)[: len(whole)]
    return np.lib.stride_tricks.as_strided(whole, (n, CHUNK), (HOP, 1))


def responses(model: Model, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each chunk, and where it is."""
    tops, wheres = [], []
    for a in range(0, len(cut), BLOCK):
        x = np.ascontiguousarray(model.vectors[cut[a : a + BLOCK]])
        s0, s1, s2 = x.strides
        patches = np.lib.stride_tricks.as_strided(x, (len(x), POSITIONS, WIDTH * VECTOR), (s0, STRIDE * s1, s2)).reshape(-1, WIDTH * VECTOR)
        out = (patches @ model.filters).reshape(len(x), POSITIONS, -1)
        where = out.argmax(axis=1)
        wheres.append(where)
        tops.append(np.take_along_axis(out, where[:, None, :], 1)[:, 0, :])
    return np.concatenate(tops) + model.offsets, np.concatenate(wheres)


def tops(model: Model, cut: np.ndarray) -> np.ndarray:
    """As responses(), without positions."""
    found = []
    for a in range(0, len(cut), BLOCK):
        x = np.ascontiguousarray(model.vectors[cut[a : a + BLOCK]])
        s0, s1, s2 = x.strides
        patches = np.lib.stride_tricks.as_strided(x, (len(x), POSITIONS, WIDTH * VECTOR), (s0, STRIDE * s1, s2)).reshape(-1, WIDTH * VECTOR)
        found.append((patches @ model.filters).reshape(len(x), POSITIONS, -1).max(axis=1))
    return np.concatenate(found) + model.offsets


def probabilities(model: Model, documents: list[bytes]) -> np.ndarray:
    cuts = [chunks(x) for x in documents]
    out, a = np.zeros(len(cuts)), 0
    while a < len(cuts):  # some documents at a time
        b, n = a, 0
        while b < len(cuts) and (b == a or n + len(cuts[b]) <= 20 * BLOCK):
            n += len(cuts[b])
            b += 1
        hidden = np.maximum(tops(model, np.concatenate(cuts[a:b])), 0)
        sizes = np.array([len(x) for x in cuts[a:b]])
        starts = np.cumsum(sizes) - sizes
        logit = np.maximum.reduceat(hidden, starts) @ model.largest + (np.add.reduceat(hidden, starts) / sizes[:, None]) @ model.mean + model.bias
        out[a:b] = 1 / (1 + np.exp(-logit.astype(np.float64)))
        a = b
    return out


def train(documents: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, batch: int = 32, rate: float = 0.01) -> Model:
    """Adam on the log loss; gradients pass through the positions and chunks of the largest responses."""
    rng, ones = np.random.default_rng(seed), float(np.mean(labels)) if len(labels) else 0.5
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    params = [draw(256, VECTOR, scale=0.5), draw(WIDTH * VECTOR, FILTERS, scale=0.15), np.zeros(FILTERS, np.float32), draw(FILTERS, scale=0.1), draw(FILTERS, scale=0.1), np.zeros(1, np.float32)]
    share = min(max(ones, 1e-3), 1 - 1e-3)
    params[5][0] = np.log(share / (1 - share))
    if ones in (0.0, 1.0) or not len(labels):
        return Model(*[p * 0 for p in params[:5]], params[5] if len(labels) else params[5] * 0)
    moments, step, cuts, steps = [(np.zeros_like(p), np.zeros_like(p)) for p in params], 0, [chunks(x) for x in documents], epochs * -(-len(labels) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), batch):
            take, model = order[a : a + batch], Model(*params)
            cut, sizes = np.concatenate([cuts[i] for i in take]), np.array([len(cuts[i]) for i in take])
            starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(take)), sizes)
            raw, where = responses(model, cut)
            hidden = np.maximum(raw, 0)
            most, mean = np.maximum.reduceat(hidden, starts), np.add.reduceat(hidden, starts) / sizes[:, None]
            p = 1 / (1 + np.exp(-(most @ model.largest + mean @ model.mean + model.bias)))
            error = ((p - labels[take]) / len(take)).astype(np.float32)
            first = (hidden == most[of]) / np.maximum.reduceat((hidden == most[of]).astype(np.float32), starts)[of]
            ties = np.add.reduceat((hidden == most[of]).astype(np.float32), starts)[of]
            back = error[of][:, None] * (model.largest * first / np.maximum(ties, 1) + model.mean / sizes[of][:, None]) * (raw > 0)
            at = (where * STRIDE)[:, :, None] + np.arange(WIDTH)
            seen = np.take_along_axis(cut[:, None, :], at.reshape(len(cut), 1, -1), 2).reshape(len(cut), FILTERS, WIDTH)
            patch = model.vectors[seen].reshape(len(cut), FILTERS, WIDTH * VECTOR)
            to_vectors = (back[:, :, None] * model.filters.T[None]).reshape(-1, VECTOR)
            grown = np.stack([np.bincount(seen.ravel(), to_vectors[:, k], 256) for k in range(VECTOR)], axis=1)
            grads = [grown, np.einsum("nf,nfd->df", back, patch), back.sum(0), error @ most, error @ mean, error.sum(keepdims=True)]
            step += 1
            pace = rate * (1 - step / (steps + 1)) ** 0.5
            for param, grad, (m, v) in zip(params, grads, moments):
                grad = grad.astype(np.float32)
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(*params)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(common.quoted(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def drawn(text: Column, max_bytes: int) -> Column:
    """The bytes of a text to learn from: all, or of one beyond max_bytes PIECES pieces that are spread evenly over the whole."""
    data, piece = text.cast("binary"), max(1, max_bytes // PIECES)
    starts = [F.floor((F.octet_length(text) - piece) * k / (PIECES - 1)).cast("int") + 1 for k in range(PIECES)]
    return F.when(F.octet_length(text) <= max_bytes, data).otherwise(F.concat(*[F.substring(data, s, F.lit(piece)) for s in starts]))


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, max_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """At most ``sample`` (bytes, label) pairs outside the held-out third. The chosen ids are at most ``sample`` rows, so they are broadcast."""
    known = labels.filter(~held_out(id_col)).groupBy(common.id_of(labels, id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y")).filter("y is not null and i is not null")
    chosen = known.orderBy(F.xxhash64("i"), "i").limit(sample)
    found = docs.select(common.id_of(docs, id_col).alias("d"), common.text_of(docs, text_col).alias("t")).join(F.broadcast(chosen), F.col("d") == F.col("i"))
    rows = found.select("i", "y", F.xxhash64("t").alias("h"), drawn(F.col("t"), max_bytes).alias("b")).orderBy(F.xxhash64("i"), "i", "h").limit(sample).select("b", "y").collect()
    return [bytes(r["b"]) for r in rows], np.array([r["y"] for r in rows], np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, max_bytes: int = MAX_BYTES, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    return train(*sample_of(docs, labels, id_col, text_col, label_col, sample, max_bytes), epochs, seed)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score; the columns of docs pass through."""

    @F.pandas_udf("double")
    def probability(text):
        import pandas as pd

        found = []
        for a in range(0, len(text), 256):
            found.append(probabilities(model, [x.encode() for x in text.iloc[a : a + 256]]))
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(score_col, probability(common.text_of(docs, text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    slim = docs.select(common.quoted(id_col).alias(id_col), common.text_of(docs, text_col).alias("__text"))
    return scored(slim, fit(docs, labels, id_col, text_col), "__text").select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that the classifier accepts, with the columns of docs."""
    name = f"{common.prefix(docs)}score"
    return scored(docs, fit(docs, labels, id_col, text_col), text_col, name).filter(F.col(name) >= threshold).select(common.own(docs))
