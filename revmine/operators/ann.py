"""Approximate nearest neighbours by an inverted file: vectors in cells around centres, of which a query searches some.

Centres come from k-means over a sample of at most ``sample`` vectors (in hash order of the ids, so that it does not
depend on how rows are stored), on the driver. Every row is indexed: a task gives each of its rows the nearest centre, and
rows are written sorted by cell. How many cells a query probes is set from the sample: as many as hold RECALL of the
neighbours there (in a larger corpus neighbours are nearer, and as a rule in fewer cells). A query block is broadcast with the cells that each query probes; a task multiplies
its rows of a cell with the queries that probe that cell, and rows of other cells with none. Rows never move; only the k
best of each task and query do. With ``probes`` equal to the number of cells the result is exact.

Defined cases: as in ``knn``, but all vectors must have one length; an empty corpus gives no results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import work
from . import knn

#: Vectors that the centres are fitted on, rounds of k-means, the share of neighbours to be found, and the sample's queries and neighbours that it is measured by.
SAMPLE, ROUNDS, RECALL, ASKED, NEIGHBOURS = 20_000, 10, 0.95, 256, 10


class Index(NamedTuple):
    rows: DataFrame  # (cell, id, vector)
    kind: str
    centres: np.ndarray
    probes: int


def fit(vectors: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centres of spherical k-means; a cell that loses its rows keeps its centre."""
    unit, rng = knn._unit(vectors), np.random.default_rng(seed)
    centres = unit[rng.permutation(len(unit))[:cells]]
    for _ in range(rounds):
        of = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, unit)
        some = np.bincount(of, minlength=len(centres)) > 0
        centres = np.where(some[:, None], knn._unit(sums), centres)
    return centres


def calibrated(vectors: np.ndarray, centres: np.ndarray, recall: float = RECALL) -> int:
    """Cells to probe so that a share ``recall`` of the nearest neighbours of some of the vectors lie in them."""
    unit = knn._unit(vectors)
    near = unit[:ASKED] @ unit.T
    np.fill_diagonal(near, -np.inf)
    found = np.argsort(-near, axis=1)[:, : min(NEIGHBOURS, len(unit) - 1)]
    if not found.size:
        return len(centres)
    cell, place = (unit @ centres.T).argmax(1), np.argsort(np.argsort(-(unit[:ASKED] @ centres.T), axis=1, kind="stable"), axis=1)
    return 1 + int(np.quantile(np.take_along_axis(place, cell[found], 1), recall, method="higher"))


def build(corpus: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> Index:
    """Index every row of corpus; cells defaults to the square root of the number of rows (at most that of the sample)."""
    folder = work.shared_folder(corpus.sparkSession, "ann")
    slim, kind = knn.picked(corpus, id_col, vector_col, None)
    drawn = slim.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    vectors = np.nan_to_num(np.array([r["vector"] for r in drawn], np.float64))
    cells = cells or max(1, min(len(drawn), int(slim.count() ** 0.5)))
    centres = fit(vectors, cells) if len(drawn) else np.zeros((0, 0))
    shipped = corpus.sparkSession.sparkContext.broadcast(centres)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at, found = knn._matrix(rows.column("vector"), shipped.value.shape[1])
            if len(at) < rows.num_rows:
                raise ValueError("the vectors of an index must have one length")
            yield pa.RecordBatch.from_arrays([pa.array((knn._unit(found) @ shipped.value.T).argmax(1).astype(np.int32)), rows.column("id"), rows.column("vector")], ["cell", "id", "vector"])

    placed = slim.mapInArrow(task, f"cell int, id {kind}, vector {slim.schema['vector'].dataType.simpleString()}").sortWithinPartitions("cell")
    return Index(work.written(placed, f"{folder}/rows"), kind, centres, calibrated(vectors, centres) if len(drawn) else 0)


def _block(index: Index, query_kind: str, queries: list, k: int, probes: int) -> DataFrame:
    names, vectors = [q["query_id"] for q in queries], np.nan_to_num(np.array([q["query_vector"] for q in queries], np.float64))
    near = np.argsort(-(knn._unit(vectors) @ index.centres.T), axis=1, kind="stable")[:, :probes]
    order = np.argsort(near.ravel(), kind="stable")
    # Of each cell the queries that probe it: from starts[cell] to starts[cell + 1].
    starts, probing = np.searchsorted(near.ravel()[order], np.arange(len(index.centres) + 1)), (order // near.shape[1]).astype(np.int32)
    shipped = index.rows.sparkSession.sparkContext.broadcast((names, vectors, starts, probing))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, starts, probing = shipped.value
        kept, kind = None, None
        for rows in batches:
            all_ids, kind = knn.ids_of(rows.column("id")), rows.column("id").type
            if kept is None:
                kept = (np.zeros(0, np.int64), np.zeros(0, all_ids.dtype), np.zeros(0))
            cell, (_, found) = rows.column("cell").to_numpy(), knn._matrix(rows.column("vector"), vectors.shape[1])
            cuts = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                asked = probing[starts[cell[a]] : starts[cell[a] + 1]].astype(np.int64)
                step = max(1, knn.MATRIX_CELLS // max(1, len(asked)))
                for c in range(a, b if len(asked) else a, step):
                    far = knn.closest(knn.distances(vectors[asked], found[c : min(b, c + step)]), k)
                    q, at = np.nonzero(np.isfinite(far))
                    kept = knn.nearest_of(*(np.concatenate(x) for x in zip(kept, (asked[q], all_ids[c + at], far[q, at]))), k)
        if kept is not None:
            asked_kind = pa.int64() if names and isinstance(names[0], int) else pa.string()
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in kept[0].tolist()], asked_kind), pa.array(kept[1].tolist(), kind), pa.array(kept[2])], ["query_id", "id", "distance"])

    return index.rows.mapInArrow(task, f"query_id {query_kind}, id {index.kind}, distance double")


def search(index: Index, queries: DataFrame, k: int, query_id: str = "vec_id", vector_col: str = "embedding", probes: int | None = None, block_bytes: int = knn.BLOCK_BYTES) -> DataFrame:
    """(query_id, id, distance, rank) by cosine distance: the k nearest rows in the cells that a query probes."""
    asked, query_kind = knn.picked(queries, query_id, vector_col, None, "query_")
    probes = min(len(index.centres), probes or index.probes)
    near = knn.in_blocks(asked, F.size("query_vector") * 8, block_bytes, lambda part, _: _block(index, query_kind, part.to_pylist(), k, probes), "ann-near") if len(index.centres) else None
    if near is None:
        near = queries.sparkSession.createDataFrame([], f"query_id {query_kind}, id {index.kind}, distance double")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).filter(F.col("rank") <= k)
