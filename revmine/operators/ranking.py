"""Exact row numbers in hash order, or in an order of columns, without a window over all rows.

The key is an md5 in hex. Its leading digits are buckets of about equal size however the rows are skewed;
rows are counted a bucket, the counts (a few thousand rows) are prefix-summed, and rows are numbered
within their bucket. Numbers begin at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import work

BUCKET_ROWS, MOST_DIGITS = 200_000, 4


def hash_key(seed: int | str, *ids: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.coalesce(i.cast("string"), F.lit("null")) for i in ids]).cast("binary"))


def digits_for(n: int) -> int:
    digits = 0
    while n > BUCKET_ROWS * 16**digits and digits < MOST_DIGITS:
        digits += 1
    return digits


def numbered(df: DataFrame, key: Column, *ties: str, name: str = "row_no") -> tuple[DataFrame, int]:
    """(df with its rows' numbers in the order of key and ties, number of rows)."""
    n = df.count()
    digits = digits_for(n)
    keyed = df.withColumns({"__key": key}).withColumn("__bucket", F.substring("__key", 1, digits) if digits else F.lit(""))
    inner = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", *ties))
    if not digits:
        return keyed.withColumn(name, inner.cast("long") - 1).drop("__key", "__bucket"), n
    counts = keyed.groupBy(F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    placed = keyed.withColumn("__in", inner.cast("long") - 1).join(before, F.col("__bucket") == F.col("__b"))
    return placed.withColumn(name, F.col("__before") + F.col("__in")).drop("__key", "__bucket", "__in", "__b", "__before"), n


def ordered(df: DataFrame, *order: str | Column, name: str = "row_no") -> DataFrame:
    """df with its rows' numbers in an order: rows are range-partitioned and sorted, and written with their places; a partition's numbers begin behind those of the partitions before it. Ties are numbered as they were written."""
    placed = work.written(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()), f"{work.shared_folder(df.sparkSession, 'ordered')}/rows")
    part, inside = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), part == F.col("__part")).withColumn(name, F.col("__before") + inside).drop("__place", "__part", "__before")
