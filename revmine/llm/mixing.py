"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Sources, ordered by code point (null last), weigh 5, 2, 1 in turn and share 150 % of all words; a target
stops at twice its source's size and the excess is reshared by weight. Whole epochs come first. What then
remains of a target is filled in the order of exponential keys -ln(u) / quality weight (u from a
seeded hash of the id), up to the word budget; the last document is taken in part, so that a source's
taken words are its target rounded down.

No source is ever gathered: keys fall into about sqrt(rows) buckets by their rank under weight 1; words
are summed a bucket, the sums are prefix-summed within the source, and only the one bucket in which the
budget ends (about sqrt(rows) documents) is sorted.

Defined cases: null text has size 0; a text is counted whole, however long; null source is a source; empty table
gives an empty result; rows that repeat an id have the same key and stand next to each other in the order; a source
without words has target 0; ids may be of any type; other columns pass through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, rows

SOURCE_WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: The table of sources is broadcast up to so many rows; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(common.WORD)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """2 for a mean word length of 3 to 10 characters, times 2 from 50 words on; else 1."""
    mean = F.char_length(text) / F.greatest(size, F.lit(1))
    return F.when(mean.between(3, 10), 2.0).otherwise(1.0) * F.when(size >= 50, 2.0).otherwise(1.0)


def key_columns(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weight: Column | None = None, p: str = "") -> DataFrame:
    """docs with id, source, size, key (the exponential key) and rank (its rank under weight 1), each named with p in front; weight may use the columns of docs."""
    text, name = common.text_of(docs, text_col), lambda x: F.col(p + x)
    drawn = F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(common.quoted(id_col).cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(drawn, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    keyed = docs.withColumns({f"{p}id": common.quoted(id_col), f"{p}source": common.quoted(source_col), f"{p}size": word_count(text), f"{p}u": u})
    keyed = keyed.withColumn(f"{p}weight", weight if weight is not None else quality_weight(text, name("size")))
    return keyed.withColumns({f"{p}key": -F.log(name("u")) / name("weight"), f"{p}rank": 1 - F.pow(name("u"), 1 / name("weight"))}).drop(f"{p}weight", f"{p}u")


def _row(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(rows.row_key(docs, id_col, text_col), common.quoted(source_col).cast("string"))


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weight: Column | None = None) -> DataFrame:
    """The slim table on which all is decided: (id, row, source, size, key, rank); row tells rows with different id, text or source apart."""
    p = common.prefix(docs)
    keyed = key_columns(docs, id_col, text_col, source_col, seed, weight, p)
    slim = keyed.select(F.col(f"{p}id").alias("id"), _row(docs, id_col, text_col, source_col).alias("row"), *[F.col(p + c).alias(c) for c in ("source", "size", "key", "rank")])
    return common.written(slim, common.shared_folder(docs.sparkSession, "mixing"), "keys")


def targets(keyed: DataFrame) -> DataFrame:
    """(source, source_size, target): one row a source; a window over the table of sources alone."""
    w = F.element_at(F.array(*map(F.lit, SOURCE_WEIGHTS)), (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(SOURCE_WEIGHTS) + 1)
    sources = keyed.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w)
    all_, before = Window.partitionBy(), Window.orderBy("cap", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    shared = sources.withColumn("cap", MOST_EPOCHS * F.col("source_size") / F.col("w"))
    left = SHARE * F.sum("source_size").over(all_) - MOST_EPOCHS * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    shared = shared.withColumn("rate", left / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0)))).withColumn("capped", F.col("rate") > F.col("cap"))
    rate = F.min(F.when(~F.col("capped"), F.struct("cap", F.col("source").isNull(), F.col("source"), "rate"))).over(all_)["rate"]
    return shared.select("source", "source_size", F.when(F.col("capped"), MOST_EPOCHS * F.col("source_size").cast("double")).otherwise(F.col("w") * rate).alias("target"))


def bucket_of(rank: Column, buckets: int) -> Column:
    return F.least(F.floor(rank * buckets), F.lit(buckets - 1))


def plan(keyed: DataFrame) -> tuple[DataFrame, int]:
    """For each source (s): size, target, epochs, and the bucket in which its budget ends with what is left there. A written table."""
    buckets, folder = max(1, math.isqrt(keyed.count())), common.shared_folder(keyed.sparkSession, "mixing")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = targets(keyed).withColumn("epochs", F.least(full, F.lit(MOST_EPOCHS))).withColumn("budget", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    goals = common.written(goals.withColumnRenamed("source", "s"), folder, "goals")
    sums = keyed.groupBy("source", bucket_of(F.col("rank"), buckets).alias("bucket")).agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = sums.join(goals, F.col("source").eqNullSafe(F.col("s"))).filter(F.col("before") <= F.col("budget")).groupBy("source").agg(F.max("bucket").alias("end_bucket"), F.max_by("before", "bucket").alias("end_before"))
    found = goals.join(ends, F.col("s").eqNullSafe(F.col("source")), "left").select("s", "source_size", "target", "epochs", F.coalesce("end_bucket", F.lit(-1)).alias("end_bucket"), (F.col("budget") - F.coalesce("end_before", F.lit(0))).alias("left_words"))
    return common.written(found, folder, "plan"), buckets


def _small(goals: DataFrame) -> DataFrame:
    return F.broadcast(goals) if goals.count() <= BROADCAST_SOURCES else goals


def decide(keyed: DataFrame, goals: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Rows outside and inside the bucket in which their source's budget ends, with extra (words of the fractional part) and partly (the row has a part)."""
    placed = keyed.withColumn("bucket", bucket_of(F.col("rank"), buckets)).join(_small(goals), F.col("source").eqNullSafe(F.col("s")))
    plain = placed.filter("bucket <> end_bucket").withColumn("partly", F.col("bucket") < F.col("end_bucket")).withColumn("extra", F.when(F.col("partly"), F.col("size")).otherwise(F.lit(0).cast("long")))
    order = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = placed.filter("bucket = end_bucket").withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.withColumn("partly", F.col("before") < F.col("left_words")).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left_words") - F.col("before"))).cast("long")).drop("before")
    return plain, last


def mix_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weight: Column | None = None) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, epochs."""
    keyed = with_keys(docs, id_col, text_col, source_col, seed, weight)
    plain, last = decide(keyed, *plan(keyed))
    taken = F.col("epochs") * F.col("size") + F.col("extra")
    return plain.unionByName(last).select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "epochs")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weight: Column | None = None) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each epoch of a document, and one for a fractional part.

    All is decided on slim rows. Documents are read once more and meet the sources' plan and the rows of the buckets
    in which budgets end (about sqrt(rows) a source, broadcast up to ``rows.BROADCAST_ROWS``).
    """
    p, keyed = common.prefix(docs), with_keys(docs, id_col, text_col, source_col, seed, weight)
    goals, buckets = plan(keyed)
    ends = decide(keyed, goals, buckets)[1].groupBy("id", "row").agg(F.count_if("partly").alias("parts"), F.count(F.lit(1)).alias("n"))
    ends = common.written(ends, common.shared_folder(docs.sparkSession, "mixing"), "ends")
    goals = _small(goals.select([F.col(c).alias(p + c) for c in ("s", "epochs", "end_bucket")]))
    known = ends.select(F.col("id").alias(f"{p}end_id"), F.col("row").alias(f"{p}end_row"), F.col("parts").alias(f"{p}parts"), F.col("n").alias(f"{p}n"))
    known = F.broadcast(known) if known.count() <= rows.BROADCAST_ROWS else known
    own = common.own(docs)
    placed = key_columns(docs, id_col, text_col, source_col, seed, weight, p).withColumns({f"{p}row": _row(docs, id_col, text_col, source_col), f"{p}bucket": bucket_of(F.col(f"{p}rank"), buckets)})
    placed = placed.join(goals, F.col(f"{p}source").eqNullSafe(F.col(f"{p}s")))
    placed = placed.join(known, (F.col(f"{p}row") == F.col(f"{p}end_row")) & F.col(f"{p}id").eqNullSafe(F.col(f"{p}end_id")), "left")
    # A row that repeats and has a part in some of its repeats only is counted for all of them, and stands once.
    split = F.coalesce(F.col(f"{p}parts").between(1, F.col(f"{p}n") - 1), F.lit(False))
    part = F.coalesce((F.col(f"{p}parts") > 0).cast("int"), (F.col(f"{p}bucket") < F.col(f"{p}end_bucket")).cast("int"))
    copies = F.when(split, F.col(f"{p}epochs") * F.col(f"{p}n") + F.col(f"{p}parts")).otherwise(F.col(f"{p}epochs") + part).cast("int")
    drawn = lambda df: df.withColumn(f"{p}copy", F.explode(F.array_repeat(F.lit(0), F.col(f"{p}copies")))).select(own)
    counted = placed.withColumns({f"{p}copies": copies, f"{p}split": split})
    if ends.filter("parts BETWEEN 1 AND n - 1").isEmpty():
        return drawn(counted)
    return drawn(counted.filter(~F.col(f"{p}split"))).unionByName(drawn(counted.filter(F.col(f"{p}split")).dropDuplicates([f"{p}id", f"{p}row"])))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS size,
             (CAST('0x' || substr(md5('7-' || coalesce(doc_id::VARCHAR, 'null')), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
k AS (SELECT *, -ln(u) / ((CASE WHEN length(t) / greatest(size, 1) BETWEEN 3 AND 10 THEN 2.0 ELSE 1.0 END) * (CASE WHEN size >= 50 THEN 2.0 ELSE 1.0 END))::DOUBLE AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
c AS (SELECT *, 2 * source_size::DOUBLE / w AS cap FROM w),
r AS (SELECT *, (1.5 * sum(source_size) OVER ()::DOUBLE - 2 * coalesce(sum(source_size) OVER b, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS rate FROM c
      WINDOW b AS (ORDER BY cap, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CASE WHEN rate > cap THEN 2.0::DOUBLE * source_size ELSE w * (SELECT arg_min(rate, (cap, source IS NULL, source)) FROM r WHERE NOT rate > cap) END AS target FROM r),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size))::BIGINT ELSE 0 END AS epochs FROM g),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, floor(e.target)::BIGINT - e.epochs * e.source_size AS budget,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken, epochs FROM p
"""
