"""Taking rows out of a table of documents by slim tables of their ids and keys, so that texts move as little as can be.

A table of at most BROADCAST_ROWS rows (ids and keys) is broadcast. Beyond, a Bloom filter of its keys is, and only
documents that the filter may have (those that go, and a few more) shuffle to meet the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom, common

BROADCAST_ROWS = 400_000


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(common.quoted(id_col).cast("string"), common.text_of(docs, text_col))


def _meet(keyed: DataFrame, p: str, table: DataFrame, how: str) -> DataFrame:
    """keyed rows that the table of (id, key) has (left_semi) or lacks (left_anti)."""
    n, names = table.count(), (f"{p}other_id", f"{p}other_key")
    other = table.select(F.col("id").alias(names[0]), F.col("key").alias(names[1]))
    same = (F.col(f"{p}key") == F.col(names[1])) & F.col(f"{p}id").eqNullSafe(F.col(names[0]))
    if n <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(other), same, how)
    slots = bloom.slots_for(n)
    marked = bloom.marked(keyed, F.col(f"{p}key"), bloom.hit(table, "key", slots), slots, f"{p}may")
    met = marked.filter(F.col(f"{p}may")).join(other, same, how)
    return (met if how == "left_semi" else marked.filter(~F.col(f"{p}may")).unionByName(met)).drop(f"{p}may")


def without(docs: DataFrame, leaving: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows in leaving(id, key), and with one only of each row in repeated(id, key)."""
    p = common.prefix(docs)
    keyed = docs.withColumns({f"{p}id": common.quoted(id_col), f"{p}key": row_key(docs, id_col, text_col)})
    if not leaving.isEmpty():
        keyed = _meet(keyed, p, leaving, "left_anti")
    if repeated.isEmpty():
        return keyed.select(common.own(docs))
    once = _meet(keyed, p, repeated, "left_semi").dropDuplicates([f"{p}id", f"{p}key"])
    return _meet(keyed, p, repeated, "left_anti").select(common.own(docs)).unionByName(once.select(common.own(docs)))
