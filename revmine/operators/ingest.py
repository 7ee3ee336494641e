"""Relational steps: joins of reviews, closed time ranges, dedup and incremental loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text


def reviews(pulls: DataFrame, files: DataFrame, comments: DataFrame) -> DataFrame:
    """pulls(pr_id, ...) x files(pr_id, filename, diff_text) x comments(pr_id, file_path, ...) on pr_id and path, inner. Labels are joined in with the pull's columns."""
    placed = comments.withColumnRenamed("file_path", "filename")
    return pulls.join(files, "pr_id").join(placed, ["pr_id", "filename"])


def nested(pulls: DataFrame, column: str) -> DataFrame:
    """A row for each element of an array of structs (files or comments of a pull), with the pull's id; pulls without any give none."""
    return pulls.select(F.col("id").alias("pr_id"), F.explode(column).alias("one")).select("pr_id", "one.*")


def counted(df: DataFrame, keep: Column, name: str = "progress") -> tuple[DataFrame, Observation]:
    """The rows to keep, and an observation of how many were visited and kept; it is filled by whatever action runs the plan."""
    seen = Observation(name)
    watched = df.withColumn("__keep", F.coalesce(keep, F.lit(False))).observe(seen, F.count(F.lit(1)).alias("visited"), F.count_if("__keep").alias("kept"))
    return watched.filter("__keep").drop("__keep"), seen


def orphans(pulls: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments of a pull that stand at no file."""
    return pulls.join(comments.filter("file_path is null"), "pr_id")


def in_range(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows between two instants, both included; a bare date is its midnight. Reaches the scan as a pushed filter."""
    return df.filter(F.col(column).between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def long_enough(df: DataFrame, column: str, least: int = text.SHORTEST) -> DataFrame:
    return df.filter(F.length(text.strip(column)) >= least)


def first_of(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key. Minima are combined before the shuffle, so a key with very many rows is no hot group."""
    whole = F.struct(*[F.col(c).alias(c) for c in order], *[F.col(c).alias(c) for c in df.columns if c not in order])
    return df.groupBy(key.alias("__key")).agg(F.min(whole).alias("__row")).select(*[F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def not_indexed(new: DataFrame, index: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new whose key the index does not have, each key once."""
    return new.dropDuplicates([key]).join(index.select(key), key, "left_anti")


def cached(docs: DataFrame, cache: DataFrame, text_col: str) -> DataFrame:
    """docs with ``key`` (SHA-256 of the text), the cached embedding where there is one, and ``hit``."""
    keyed = docs.withColumn("key", text.checksum(text_col))
    return keyed.join(cache.select("key", "embedding", F.lit(True).alias("__hit")), "key", "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def upserted(cache: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key of both tables; of equal versions a new row replaces a cached one. Maxima are combined before the shuffle, so a key with very many rows is no hot group."""
    row = F.struct(*[F.col(f"`{c}`") for c in cache.columns])
    rank = lambda side: F.struct(F.col(f"`{version}`"), F.lit(side))
    both = cache.select(row.alias("row"), rank(0).alias("rank")).unionByName(new.select(cache.columns).select(row.alias("row"), rank(1).alias("rank")))
    return both.groupBy(F.col(f"row.`{key}`").alias("key")).agg(F.max_by("row", "rank").alias("row")).select("row.*")


def of_pull(pulls: DataFrame, files: DataFrame, number: str | int) -> DataFrame:
    """The files of one pull, in order of their names; a number that is not all digits raises."""
    if not str(number).isascii() or not str(number).isdigit():
        raise ValueError(f"{number!r} is no pull number")
    return pulls.filter(F.col("pr_number") == int(number)).join(files, "pr_id").orderBy("filename")
