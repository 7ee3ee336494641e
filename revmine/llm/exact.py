"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

The normalised texts' SHA-256 are written once, without the texts. Pass 1 puts their 64-bit hashes into a filter
(``bloom``) and keeps the slots that were hit twice. Pass 2 tests each row: only rows whose slots were all hit twice
can repeat, so only those shuffle, to be grouped by their SHA-256; all others pass straight through. A slot
never misses a repeat; a false positive only shuffles one row more.

The filter has 16 slots a row up to ``max_slots``, so at most max_slots / 64 rows of two longs are broadcast.
Beyond max_slots / 16 rows the filter lets more unique rows through to the shuffle, and in the limit this is a
plain group-by of the slim rows; results stay the same.

Defined cases: null text is an empty text; a text is hashed whole, however long; an empty table gives an empty
result; a null doc_id stays only where its group has no other; rows repeated with the id that stays are all marked
kept (``dedup`` leaves one of them). Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, common, rows

MAX_SLOTS = bloom.MAX_SLOTS


def hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, sha, hash): key tells rows with different id or text apart, sha is of the normalised text."""
    text = common.text_of(docs, text_col)
    sha = F.sha2(common.lower_ascii(text).cast("binary"), 256)
    return docs.select(common.quoted(id_col).alias("id"), rows.row_key(docs, id_col, text_col).alias("key"), sha.alias("sha")).withColumn("hash", F.xxhash64("sha"))


def labelled(hashed: DataFrame, max_slots: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows that cannot repeat, rows that may), with keep_id, the id that stays, and the size of their group.

    The groups are written before they are joined, so that Spark can split a group with very many rows, or
    broadcast a small table of groups.
    """
    slots = bloom.slots_for(hashed.count(), max_slots)
    marked = bloom.marked(hashed, F.col("hash"), bloom.hit_twice(hashed, "hash", slots), slots, "may")
    single = marked.filter("NOT may").drop("may").withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("long")})
    maybe = marked.filter("may").drop("may")
    groups = common.written(maybe.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), folder, "groups")
    return single, maybe.join(groups, "sha")


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_slots: int = MAX_SLOTS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    folder = common.shared_folder(docs.sparkSession, "exact")
    hashed = common.written(hashes(docs, id_col, text_col).drop("key"), folder, "hashes")
    single, repeated = labelled(hashed, max_slots, folder)
    return single.unionByName(repeated).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_slots: int = MAX_SLOTS) -> DataFrame:
    """The rows that stay, with the columns of docs. All is decided on the slim rows; of the texts themselves only rows that go can need a shuffle (``rows.without``)."""
    folder = common.shared_folder(docs.sparkSession, "exact")
    hashed = common.written(hashes(docs, id_col, text_col), folder, "hashes")
    repeated = common.written(labelled(hashed, max_slots, folder)[1].select("id", "key", "sha", "keep_id"), folder, "repeated")
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    several = common.written(repeated.filter(stays).groupBy("sha").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first"), folder, "several")
    again = repeated.filter(stays).join(several, "sha")
    leaving = repeated.filter(~stays).unionByName(again.filter("key <> first").drop("first")).select("id", "key").distinct()
    twice = again.filter("key = first").select("id", "key").distinct()
    return rows.without(docs, common.written(leaving, folder, "leaving"), common.written(twice, folder, "twice"), id_col, text_col)


ORACLE = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{common.UPPER}', '{common.UPPER.lower()}') AS t FROM documents)
"""
