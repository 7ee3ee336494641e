"""From nearest neighbours to recommendations: filters, first hits, boosts, thresholds, feedback.

All steps work on many queries at once; a query's candidates are at most k times the over-fetch factor, so
windows over them are bounded. candidates: (query_id, id, distance, rank) and what was joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Over-fetch factors, boosts, threshold of similarity, weight of a favourite, and probability gates.
FETCH_FEEDBACK, FETCH = 10, 4
FILE_BOOST, LABEL_BOOST = 0.10, 0.05
STATS_TOP, ALPHA, LEAST_SIMILARITY = 10, 0.7, 0.75
FAVOURITE = 0.001
P_KEEP, P_USEFUL = 0.38, 0.51


def cosine_similarity(distance: Column) -> Column:
    return 1 - distance


def inverse_similarity(distance: Column) -> Column:
    return 1 / (1 + F.sqrt(F.greatest(distance, F.lit(0.0))))


def boost(file: Column, wanted_file: Column | None, labels: Column, wanted_labels: Column | None) -> Column:
    """+0.10 if the file name contains the wanted one, +0.05 if the labels contain the wanted ones; cases alike, empty wishes count nothing."""
    some = lambda c, wanted, gain: F.lit(0.0) if wanted is None else F.when((text.text(wanted) != "") & F.lower(text.text(c)).contains(F.lower(text.text(wanted))), gain).otherwise(0.0)
    return some(file, wanted_file, FILE_BOOST) + some(labels, wanted_labels, LABEL_BOOST)


def combined(similarity: Column, probability: Column) -> Column:
    """Similarity and probability in one number, for display."""
    return similarity + probability


def ranked(rows: DataFrame, *order: Column, name: str = "place", partition: str = "query_id") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(partition).orderBy(*order)))


def first_hits(candidates: DataFrame, said: Column, keep: Column) -> DataFrame:
    """Of the candidates that pass the filter, the nearest of each canonical text; a text that fails first may pass later."""
    kept = candidates.filter(keep & (said != "")).withColumn("__text", text.canonical(said))
    first = F.row_number().over(Window.partitionBy("query_id", "__text").orderBy("rank"))
    return kept.withColumn("__first", first).filter("__first = 1").drop("__text", "__first")


def with_feedback(candidates: DataFrame, feedback: DataFrame, key: Column, similarity: str = "similarity") -> DataFrame:
    """feedback(key, fav_count) -> fav_count (0 without one) and final = similarity + 0.001 * fav_count."""
    met = candidates.withColumn("__key", key).join(feedback.select(F.col("key").alias("__k"), "fav_count"), F.col("__key") == F.col("__k"), "left").drop("__key", "__k")
    met = met.withColumn("fav_count", F.coalesce("fav_count", F.lit(0)).cast("long"))
    return met.withColumn("final", F.col(similarity) + FAVOURITE * F.col("fav_count"))


def adaptive(items: DataFrame, k: int, similarity: str = "similarity") -> DataFrame:
    """Adds threshold and passed, and keeps k items a query: those at or above the threshold by rank, filled up with the others by rank.

    threshold = max(0.75, mean + 0.7 * population deviation) of the 10 largest similarities.
    """
    top = ranked(items, F.desc(similarity), F.asc("rank"), name="__top")
    query = Window.partitionBy("query_id")
    best = F.when(F.col("__top") <= STATS_TOP, F.col(similarity))
    stats = top.withColumn("threshold", F.greatest(F.lit(LEAST_SIMILARITY), F.avg(best).over(query) + ALPHA * F.stddev_pop(best).over(query)))
    judged = stats.withColumn("passed", F.col(similarity) >= F.col("threshold"))
    return ranked(judged, F.desc("passed"), F.asc("rank")).filter(F.col("place") <= k).drop("__top")


def reranked(items: DataFrame, score: Column, name: str = "score") -> DataFrame:
    """Items in the order of another scorer, ties by rank."""
    return ranked(items.withColumn(name, score), F.desc(name), F.asc("rank"))


def overlap_score(query: Column, body: Column) -> Column:
    """A scorer of pairs that needs no model: share of the body's distinct words that the query has."""
    a, b = (F.array_distinct(F.filter(F.split(text.words_only(c), " "), lambda w: w != "")) for c in (query, body))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(b)), F.lit(0.0))
