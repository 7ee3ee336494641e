"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance 4 or less have a variant in common that is at most 2 bits from either.
So every distinct fingerprint has all its variants within 2 bits (2,081) put into one table of variants;
fingerprints that meet in a variant are candidates and are verified by their distance.

What is shuffled is not each variant but each *prefix* of variants: all variants of a fingerprint with the
same leading bits go to the same place, so one row (prefix, fingerprint) stands for them, and the task that
has the prefix makes the variants that begin with it. With p leading bits that is 1 + p + p(p-1)/2 rows a
fingerprint instead of 2,081; p grows with the number of fingerprints so that a prefix has about
PREFIX_VARIANTS variants, and a prefix with more (skewed fingerprints) is cut further, bit by bit, within
its task, so that memory is bounded. Fingerprints that meet in one variant are within 4 bits of each other,
so they are linked as a chain, not as all pairs (with an odd radius, whose balls are rounded up, all pairs
are verified); a task reduces its links to a forest, and the forests'
links are joined into components.

Defined cases: null or empty text has fingerprint 0 and is linked like any other; a text counts whole, in a task's
memory at once, however long; repeated rows are rows of one component; a null id never names a component unless it
has no other; an empty table gives an empty result; ids may be numbers or strings; other columns pass through
``near_dedup`` untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, rows

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
PREFIX_VARIANTS, TASK_VARIANTS = 1 << 21, 1 << 22


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the XXH64 of all word shingles (repeats count), as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(whole, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: -shingle].tolist()]
        hashes = [digest(whole[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    values, ones = np.fromiter(hashes, np.uint64, len(hashes)), np.zeros(BITS, np.int64)
    for a in range(0, len(values), 65_536):
        part = values[a : a + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, key, fp): key tells rows with different id or text apart."""
    slim = docs.select(common.id_of(docs, id_col).alias("id"), rows.row_key(docs, id_col, text_col).alias("key"), common.text_of(docs, text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [fingerprint(x.as_py().encode(), shingle, seed) for x in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(found, pa.int64())], ["id", "key", "fp"])
        common.give_back()

    return slim.mapInArrow(task, f"id {common.id_kind(docs, id_col)}, key long, fp long")


def _masks(bits: int, most: int) -> list[np.ndarray]:
    """Masks of the low bits with 0, 1, ... ones."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(bits), k)], np.uint64) for k in range(most + 1)]


def ball(radius: int) -> int:
    """Bits that each of two fingerprints may flip so that those within the radius meet."""
    return (radius + 1) // 2


def prefix_bits(n: int, radius: int = RADIUS) -> int:
    variants = sum(math.comb(BITS, k) for k in range(ball(radius) + 1))
    return min(40, max(0, math.ceil(math.log2(max(1, n * variants / PREFIX_VARIANTS)))))


def meet(fps: np.ndarray, left: np.ndarray, bits: int, radius: int) -> Iterator[np.ndarray]:
    """Pairs (rows of two) of fps that meet in a variant; left: flips that each may still spend on its low bits."""
    half = ball(radius)
    if len(fps) < 2:
        return
    sizes = np.cumsum([math.comb(bits, k) for k in range(half + 1)])
    if sizes[left].sum() > TASK_VARIANTS and bits > 1:
        bit = (fps >> np.uint64(bits - 1)) & np.uint64(1)
        for b in (0, 1):
            rest = left - (bit != b)
            yield from meet(fps[rest >= 0], rest[rest >= 0], bits - 1, radius)
        return
    masks, low = _masks(bits, half), np.uint64((1 << bits) - 1)
    variants, owners = [], []
    for k in range(half + 1):
        of = np.flatnonzero(left == k)
        flips = np.concatenate(masks[: k + 1])
        variants.append(((fps[of] & low)[:, None] ^ flips[None, :]).ravel())
        owners.append(np.repeat(of, len(flips)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    if radius % 2:
        yield from meet_all(fps, variant, owner, radius)
        return
    same = np.flatnonzero(variant[1:] == variant[:-1])
    if len(same):
        pairs = np.unique(np.sort(np.stack([fps[owner[same]], fps[owner[same + 1]]], axis=1), axis=1), axis=0)
        yield pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius]


def meet_all(fps: np.ndarray, variant: np.ndarray, owner: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Pairs within an odd radius among all owners of a variant, which may be radius + 1 apart, so that neighbours alone do not make the chain."""
    start = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
    end = np.repeat(np.append(start[1:], len(variant)), np.diff(np.append(start, len(variant))))
    at, step = np.arange(len(variant)), 1
    while len(at := at[at + step < end[at]]):
        a, b = fps[owner[at]], fps[owner[at + step]]
        near = np.bitwise_count(a ^ b) <= radius
        if near.any():
            yield np.unique(np.sort(np.stack([a[near], b[near]], axis=1), axis=1), axis=0)
        step += 1


def forest(pairs: np.ndarray) -> np.ndarray:
    """The pairs' components as rows (node, least node), roots left out."""
    nodes, at = np.unique(pairs, return_inverse=True)
    at, label = at.reshape(-1, 2), np.arange(len(nodes))
    while True:
        least, was = np.minimum(label[at[:, 0]], label[at[:, 1]]), label.copy()
        np.minimum.at(label, at[:, 0], least)
        np.minimum.at(label, at[:, 1], least)
        label = label[label]
        if (label == was).all():
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[other], nodes[label[other]]], axis=1)


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """distinct(fp) -> (u, v): links that join exactly the fingerprints that chains of radius or less join."""
    p, half = prefix_bits(n, radius), ball(radius)
    flips = np.concatenate(_masks(p, half)) if p else np.zeros(1, np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part_rows in batches:
            fps = part_rows.column("fp").to_numpy().view(np.uint64)
            for a in range(0, len(fps), 4096):
                part = fps[a : a + 4096]
                prefix = ((part >> np.uint64(BITS - p)) if p else part * np.uint64(0))[:, None] ^ flips[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(prefix.ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], ["prefix", "fp"])

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prefix, met in common.runs(batches, "prefix"):
            fps = met.column("fp").to_numpy().view(np.uint64)
            spent = np.bitwise_count((fps >> np.uint64(BITS - p)) ^ np.uint64(prefix)) if p else np.zeros(len(fps), np.uint8)
            found = list(meet(fps, half - spent.astype(np.int64), BITS - p, radius))
            if found and sum(map(len, found)):
                tree = forest(np.concatenate(found)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tree[:, 0]), pa.array(tree[:, 1])], ["u", "v"])
        common.give_back()

    return distinct.mapInArrow(spread, "prefix long, fp long").repartition("prefix").sortWithinPartitions("prefix").mapInArrow(collide, "u long, v long")


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, fingerprint (hex), component_id (least id)."""
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return labelled(docs, id_col, text_col, radius, shingle, seed).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per row: id, key, fp, root (a fingerprint that names the component) and component_id (its least id)."""
    folder = common.shared_folder(docs.sparkSession, "simhash")
    found = common.written(fingerprints(docs, id_col, text_col, shingle, seed), folder, "fingerprints")
    distinct = common.written(found.groupBy("fp").agg(F.min("id").alias("least")), folder, "distinct")
    linked = components.connected(links(distinct.select("fp"), distinct.count(), radius), folder)
    linked = common.written(linked.join(distinct, F.col("node") == F.col("fp")).select("node", "root", "least"), folder, "linked")
    named = common.written(linked.groupBy("root").agg(F.min("least").alias("component")), folder, "named")
    of = linked.join(named, "root").select("node", "root", "component")
    whole = distinct.join(of, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id"))
    return found.join(common.written(whole, folder, "components"), "fp").select("id", "key", "fp", "root", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of each component, with the columns of docs: that with the least id. Texts move as little as ``rows.without`` lets them."""
    folder = common.shared_folder(docs.sparkSession, "simhash")
    found = common.written(labelled(docs, id_col, text_col, radius, shingle, seed).select("id", "key", "root"), folder, "labels")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key")))
    groups = common.written(found.groupBy("root").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key")), folder, "groups")
    members = found.join(groups, "root").withColumn("stays", F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")))
    leaving = common.written(members.filter("NOT stays").select("id", "key").distinct(), folder, "leaving")
    repeated = common.written(members.filter("stays").groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "key"), folder, "repeated")
    return rows.without(docs, leaving, repeated, id_col, text_col)
