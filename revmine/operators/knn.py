"""Nearest neighbours of a set of query vectors, exactly.

Distinct query vectors are searched once. They are taken in blocks of a bounded size; a block is broadcast, and every partition of
the corpus multiplies its Arrow batches with it, a tile at a time. A product says which pairs may be among the k nearest of what the
task has seen: cosines are multiplied in single precision, and pairs within its error bound of the k-th distance stay. Only these
pairs get their distances, in double precision. Of equal vectors of a batch the k smallest ids are met, as no others can be
results. Only the k nearest of each query in each task, at most partitions x queries x k rows, are shuffled and ranked. Rows of
the corpus never move. Where there are several blocks, the corpus is written first (it may be encoded on the way), and one block is
searched and its results are written before the next is fetched, so the driver holds one block at a time. ``ann`` has an
index that leaves most of the corpus out.
Distances are rounded to 9 decimals before they are ranked, ties go to the smaller id.

Defined cases: ids may be numbers or strings; a null id or vector is neither query nor candidate; a query meets the
vectors of its own length only, so lengths may be mixed; a zero vector has cosine distance 1 to everything; fewer
than k rows give fewer results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import work

#: Bytes of a query block that is broadcast; cells of a tile of products; rows of a step, fewer of the first ones; candidates that are gathered before they are ranked.
BLOCK_BYTES, MATRIX_CELLS = 64 << 20, 1 << 20
STEP_ROWS, FIRST_ROWS, GATHERED = 4096, 1024, 1 << 20
DIGITS = 9


def id_of(df: DataFrame, name: str) -> tuple[Column, str]:
    """An id column, whole numbers as long, and its type."""
    kind = df.select(name).schema[0].dataType.simpleString()
    kind = "long" if kind in ("tinyint", "smallint", "int", "bigint") else kind
    return F.col(name).cast(kind), kind


def ids_of(column: pa.Array) -> np.ndarray:
    return column.to_numpy() if pa.types.is_integer(column.type) else np.array(column.to_pylist(), object)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a vector of the width, the vectors)."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return rows, np.nan_to_num(flat.reshape(len(rows), width))


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


class Metric:
    """Of query vectors: factors whose products with those of rows grow as distances fall, the least product that may be within a distance, and distances of pairs."""

    def __init__(self, queries: np.ndarray, metric: str):
        if metric not in ("cosine", "l2sq"):
            raise ValueError(f"unknown metric {metric}")
        self.cosine, width = metric == "cosine", queries.shape[1]
        self.queries = _unit(queries) if self.cosine else queries
        self.squares = (queries * queries).sum(1)
        self.left = self.queries.astype(np.float32) if self.cosine else np.column_stack([queries, np.ones(len(queries))])
        self.error = (width + 8) * 2.0**-23 + 10.0**-DIGITS

    def factors(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(rows as pairs() takes them, factors, error of a product)."""
        if self.cosine:
            rows = _unit(rows)
            return rows, rows.astype(np.float32), self.error
        squares = (rows * rows).sum(1)
        error = 10.0**-DIGITS + (rows.shape[1] + 8) * 2.0**-51 * float(self.squares.max(initial=0) + squares.max(initial=0))
        return rows, np.column_stack([2 * rows, -squares]), error

    def least(self, far: np.ndarray) -> np.ndarray:
        return (1.0 if self.cosine else self.squares) - far

    def pairs(self, q: np.ndarray, rows: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Distances: cosine 1 - cos; l2sq the squared Euclidean one."""
        out = np.empty(len(q))
        for a in range(0, len(q), 1 << 16):
            x, y = self.queries[q[a : a + (1 << 16)]], rows[r[a : a + (1 << 16)]]
            dot = np.einsum("ij,ij->i", x, y)
            out[a : a + (1 << 16)] = 1 - dot if self.cosine else np.maximum((x * x).sum(1) + (y * y).sum(1) - 2 * dot, 0)
        return np.round(out, DIGITS) + 0.0  # no negative zeros


def nearest_of(query: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates (query, id, distance) the k nearest of each query, ties by id."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, far, query))
    query, ids, far = query[order], ids[order], far[order]
    starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    near = rank < k
    return query[near], ids[near], far[near]


def distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine distances of all pairs."""
    return np.round(1 - _unit(queries) @ _unit(rows).T, DIGITS) + 0.0  # no negative zeros


def closest(far: np.ndarray, k: int) -> np.ndarray:
    """far with all but the k least of each row (and their ties) at infinity."""
    return far if far.shape[1] <= k else np.where(far <= np.partition(far, k - 1, axis=1)[:, k - 1 : k], far, np.inf)


def least_ids(rows: np.ndarray, ids: np.ndarray, codes: np.ndarray | None, k: int) -> np.ndarray:
    """Places of the k smallest ids of each group of equal vectors (of one code), in order."""
    group = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
    if codes is not None:
        group = np.unique(group * np.int64(codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
    return first_of(group, ids, k)


def first_of(group: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest ids of each group, in order."""
    sizes = np.bincount(group)
    if sizes.max(initial=0) <= k:
        return np.arange(len(group))
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], group))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.sort(order[rank < k])


class Kept:
    """The k nearest of each query of what was met; candidates are gathered and ranked some at a time."""

    def __init__(self, queries: int, k: int, ids: np.dtype):
        self.k, self.best, self.more, self.size = k, (np.zeros(0, np.int64), np.zeros(0, ids), np.zeros(0)), [], 0
        self.far = np.full(queries, np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, far: np.ndarray) -> None:
        self.more.append((query, ids, far))
        self.size += len(query)
        if self.size >= GATHERED:
            self.rank()

    def rank(self) -> None:
        self.best = nearest_of(*(np.concatenate(x) for x in zip(self.best, *self.more)), self.k)
        self.more, self.size = [], 0
        counts = np.bincount(self.best[0], minlength=len(self.far))
        full = counts >= self.k
        self.far[full] = self.best[2][np.cumsum(counts)[full] - 1]


def _block(corpus: DataFrame, kinds: tuple[str, str], asked: pa.Table, k: int, metric: str, matched: bool) -> DataFrame:
    asked = asked.combine_chunks()
    lists, names = asked.column("query_vector").combine_chunks(), asked.column("query_id").combine_chunks()
    groups = asked.column("query_match").fill_null("").to_pylist() if matched else None
    sizes = np.unique(lists.value_lengths().to_numpy())
    vectors = {int(w): _matrix(lists, int(w)) for w in sizes}
    shipped = corpus.sparkSession.sparkContext.broadcast((names, vectors, groups))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, groups = shipped.value
        known = {g: i for i, g in enumerate(sorted(set(groups)))} if groups is not None else {}
        wanted = np.array([known[g] for g in groups], np.int64) if groups is not None else None
        metrics, seen = {w: Metric(x, metric) for w, (_, x) in vectors.items()}, dict.fromkeys(vectors, 0)
        kept, kind = None, None
        for batch in batches:
            all_ids, kind = ids_of(batch.column("id")), batch.column("id").type
            kept = kept or Kept(len(names), k, all_ids.dtype)
            for width, (at, _) in vectors.items():
                rows, found = _matrix(batch.column("vector"), width)
                ids, codes, m = all_ids[rows], None, metrics[width]
                if groups is not None:  # rows of a group that no query asks for have the last code
                    codes = np.array([known.get(g, len(known)) for g in batch.column("match").fill_null("").to_pylist()], np.int64)[rows]
                some = least_ids(found, ids, codes, k)
                found, ids, codes, a = found[some], ids[some], codes[some] if codes is not None else None, 0
                while a < len(ids):
                    fresh = seen[width] < 2 * FIRST_ROWS
                    b = a + max(1, min(FIRST_ROWS if fresh else STEP_ROWS, MATRIX_CELLS))
                    exact, right, error = m.factors(found[a:b])
                    step = max(1, MATRIX_CELLS // len(right))
                    for c in range(0, len(at), step):
                        score = m.left[c : c + step] @ right.T
                        least = m.least(kept.far[at])[c : c + step] - error
                        same = wanted[at[c : c + step], None] == codes[None, a:b] if codes is not None else None
                        if fresh and score.shape[1] > k:
                            ranked = score if same is None else np.where(same, score, -np.inf)
                            least = np.maximum(least, np.partition(ranked, -k, axis=1)[:, -k] - 2 * error)
                        met = score >= least.astype(score.dtype)[:, None]
                        q, r = np.divmod(np.flatnonzero(met if same is None else met & same), score.shape[1])
                        kept.add(at[c + q], ids[a + r], m.pairs(c + q, exact, r))
                    if fresh:
                        kept.rank()
                    seen[width], a = seen[width] + len(right), b
        if kept is not None:
            kept.rank()
            query, ids, far = kept.best
            for a in range(0, len(query), 100_000):
                part = slice(a, a + 100_000)
                own = ids[part] if ids.dtype != object else ids[part].tolist()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query[part])), pa.array(own, kind), pa.array(far[part])], ["query_id", "id", "distance"])

    return corpus.mapInArrow(task, f"query_id {kinds[0]}, id {kinds[1]}, distance double")


def in_blocks(queries: DataFrame, cost: Column, block_bytes: int, search: Callable[[pa.Table, DataFrame | None], DataFrame], purpose: str, corpus: DataFrame | None = None) -> DataFrame | None:
    """search() for queries (with a column query_id), in blocks whose cost adds up to about block_bytes each.

    A single block's result is left lazy; for several, a given corpus is written once, and each result before the next block is fetched.
    """
    size, spark = queries.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0], queries.sparkSession
    blocks, path = -(-size // block_bytes), None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow() if blocks > 1 else queries.toArrow()
        if not part.num_rows:
            continue
        if blocks == 1:
            return search(part, corpus)
        if path is None:
            path = f"{work.shared_folder(spark, purpose)}/blocks"
            corpus = work.written(corpus, f"{path}-corpus") if corpus is not None else None
        search(part, corpus).write.mode("append").parquet(path)
    return spark.read.parquet(path) if path else None


def picked(df: DataFrame, id_col: str, vector_col: str, match: str | None, prefix: str = "", sized: bool = True) -> tuple[DataFrame, str]:
    """(id, vector, match) of the rows with an id and, if sized, a vector, and the id's type. A filter on a vector that is being encoded would encode it twice."""
    name, kind = id_of(df, id_col)
    columns = [name.alias(f"{prefix}id"), F.col(vector_col).alias(f"{prefix}vector"), *([F.col(match).cast("string").alias(f"{prefix}match")] if match else [])]
    return df.select(columns).filter(f"{prefix}id is not null" + (f" and size({prefix}vector) > 0" if sized else "")), kind


def nearest(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "vec_id", metric: str = "cosine", match: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of corpus for each row of queries.

    match names a column that must be equal on both sides (null counts as '').
    """
    asked, query_kind = picked(queries, query_id, vector_col, match, "query_", False)
    slim, kind = picked(corpus, id_col, vector_col, match, sized=False)
    folder, same = work.shared_folder(corpus.sparkSession, "knn-queries"), ["query_vector", *(["query_match"] if match else [])]
    asked = work.written(asked.withColumn("query_match", F.coalesce("query_match", F.lit(""))) if match else asked, f"{folder}/asked").filter("size(query_vector) > 0")
    once = work.written(asked.groupBy(same).agg(F.min("query_id").alias("query_id")), f"{folder}/distinct")
    near = in_blocks(once, F.size("query_vector") * 8, block_bytes, lambda part, rows: _block(rows, (query_kind, kind), part, k, metric, match is not None), "knn", slim)
    if near is None:
        near = corpus.sparkSession.createDataFrame([], f"query_id {query_kind}, id {kind}, distance double")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).filter(F.col("rank") <= k)
    if once.count() == asked.count():
        return near
    named = asked.join(once.withColumnRenamed("query_id", "__one"), same).select("query_id", "__one")
    return near.withColumnRenamed("query_id", "__one").join(work.written(named, f"{folder}/named"), "__one").select("query_id", "id", "distance", "rank")


def nearest_or_any(corpus: DataFrame, queries: DataFrame, k: int, match: str, **options) -> DataFrame:
    """As nearest() among rows with an equal ``match``; queries that have none are searched among all rows."""
    found = nearest(corpus, queries, k, match=match, **options)
    known = corpus.select(F.col(match).cast("string").alias("__known")).distinct()
    alone = queries.join(known, F.coalesce(F.col(match).cast("string"), F.lit("")) == F.coalesce(F.col("__known"), F.lit("")), "left_anti")
    return found.withColumn("matched", F.lit(True)).unionByName(nearest(corpus, alone, k, **options).withColumn("matched", F.lit(False)))


def dot(a, b):
    """Dot product of two arrays, for the few rows that are left after ranking."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
