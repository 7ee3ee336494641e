"""Generic comments: texts that match a table of stock phrases, exactly or nearly.

The phrase table is an input (phrase, cap). Nothing compares every text with every phrase: exact and token
matches are hash joins, and a phrase can be near only to texts in a band of lengths, so phrases are
expanded to the lengths of their band and met by an equi-join on length. Texts are reduced to distinct ones
that are short enough for any phrase before that, and written once for the three ways to match.

Defined cases: null text is an empty text; an empty phrase matches an empty text; repeated phrases count once
(with the largest cap); an empty phrase table matches nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, text
from ..sources import work

# Similarity for texts of about the phrase's length, and for longer ones.
NEAR, STRICT = 80, 92
#: Most generic texts (none longer than a phrase reaches) that are broadcast; with more of them, texts within reach are shuffled.
FOUND = 100_000
#: A short phrase table of our own (phrase, longest text in which the phrase's one word makes a text generic). The caps 59, 112, 120 and 35.
PHRASES = [
    ("lgtm", 59), ("thanks", 59), ("thank you", None), ("done", 59), ("fixed", 112), ("updated", 120), ("ok", 59), ("yes", 59), ("no", 59), ("nit", None),
    ("good catch", None), ("looks good to me", None), ("makes sense", None), ("will do", None), ("same here", None), ("as discussed", None), ("ping", 59),
    ("ditto", 35), ("please fix the formatting of this line", None), ("this is not used anywhere", None), ("can you add a test for this", None), ("removed", 59),
]


def default_phrases(spark: SparkSession) -> DataFrame:
    phrases, caps = zip(*PHRASES)
    return spark.createDataFrame(pa.table({"phrase": pa.array(phrases, pa.string()), "cap": pa.array(caps, pa.int32())}))


def slack(m: Column) -> Column:
    """Difference in length that still counts as a typo: a fifth of the phrase, at least 2 and at most 4."""
    return F.greatest(F.lit(2), F.least(F.lit(4), F.floor(m * 0.2).cast("int")))


def normalised(phrases: DataFrame) -> DataFrame:
    """(p, m, cap, d): distinct normalised phrases with length and slack."""
    return phrases.groupBy(text.words_only("phrase").alias("p")).agg(F.max("cap").alias("cap")).withColumn("m", F.length("p")).withColumn("d", slack(F.col("m")))


def _scored(pairs: DataFrame, longest: int, score: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """pairs(n, p) with score(ratio, token_set_ratio), natively where a side is short enough. longest: characters of the longest phrase."""
    short = F.least(F.length("n"), F.length("p")) <= fuzzy.NATIVE
    native = pairs.filter(short).withColumn(name, score(fuzzy.ratio("n", "p"), fuzzy.token_set_ratio("n", "p")))
    if longest <= fuzzy.NATIVE:
        return native
    return native.unionByName(pairs.filter(~short).withColumn(name, score(fuzzy.ratio_long("n", "p"), fuzzy.token_set_ratio_long("n", "p"))))


def reach(table: DataFrame) -> tuple[int, int, int]:
    """Of a normalised phrase table: the longest text that a phrase can match, the longest phrase, and the largest slack."""
    most = F.greatest(_longest_text(), F.coalesce("cap", F.lit(0)))
    row = table.agg(F.max(most).alias("most"), F.max("m").alias("m"), F.max("d").alias("d")).first()
    return (-1, 0, 0) if row["most"] is None else (row["most"], row["m"], row["d"])


def _longest_text() -> Column:
    return F.greatest(F.col("m") + F.col("d"), F.floor(F.col("m") * (200 - STRICT) / STRICT).cast("int"))


def matches(few: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """few(n: distinct normalised texts within reach) and a normalised phrase table -> (n): texts that a phrase makes generic."""
    exact = few.join(table.select("p"), F.col("n") == F.col("p"), "left_semi")
    worded = few.withColumn("word", F.explode(F.array_distinct(F.split("n", " "))))
    capped = worded.join(table.filter("cap is not null and p <> ''"), (F.col("word") == F.col("p")) & (F.length("n") <= F.col("cap"))).select("n")
    banded = table.withColumn("size", F.explode(F.sequence(F.greatest(F.col("m") - F.col("d"), F.lit(0)), _longest_text())))
    pairs = few.join(banded, F.length("n") == F.col("size")).select("n", "p", "m", "d")
    typo = F.abs(F.length("n") - F.col("m")) <= F.col("d")
    hit = lambda ratio, by_tokens: F.when(typo, by_tokens >= NEAR).otherwise((F.length("n") > F.col("m") + F.col("d")) & (ratio >= STRICT))
    near = _scored(pairs, longest, hit, "hit").filter("hit").select("n")
    return exact.select("n").unionByName(capped).unionByName(near).distinct()


def with_generic(comments: DataFrame, phrases: DataFrame, text_col: str, name: str = "generic") -> DataFrame:
    """comments with a boolean column: the text is generic.

    Generic texts are found among the distinct ones, and comments meet them where they are. Where there are too many of them for
    that, texts beyond the reach of any phrase are not generic, and are neither shuffled nor joined.
    """
    table = normalised(phrases)
    most, longest, _ = reach(table)
    folder, n = work.shared_folder(comments.sparkSession, "generic"), text.words_only(text_col)
    few = work.written(comments.select(n.alias("n")).filter(F.length("n") <= most).distinct(), f"{folder}/texts")
    found = work.written(matches(few, table, longest), f"{folder}/found")
    keyed, hit = comments.withColumn("__n", n), F.col("__n") == F.col("n")
    if found.count() <= FOUND:
        return keyed.join(F.broadcast(found.withColumn("__hit", F.lit(True))), hit, "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__n", "n", "__hit")
    far = keyed.filter(F.length("__n") > most).withColumn(name, F.lit(False))
    judged = keyed.filter(F.length("__n") <= most).join(found.withColumn("__hit", F.lit(True)), hit, "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("n", "__hit")
    return far.unionByName(judged).drop("__n")


def audit(texts: DataFrame, phrases: DataFrame, shortest: int = 3) -> DataFrame:
    """texts(n) -> (n, score): generic by the fast rule, with the best ratio to any phrase.

    Fast rule: equal to a phrase; or 80 with a length within the longest phrase's slack of some phrase; or 92.
    A ratio of 80 needs lengths within 2 to 3, so only such pairs are scored; all others are below.
    """
    table = normalised(phrases)
    _, longest, slack_ = reach(table)
    fit = texts.filter(F.length("n") >= shortest)
    low, high = F.ceil(F.col("m") * NEAR / (200 - NEAR)).cast("int"), F.floor(F.col("m") * (200 - NEAR) / NEAR).cast("int")
    banded = table.filter("m > 0").withColumn("size", F.explode(F.sequence(low, high)))
    pairs = fit.join(banded, F.length("n") == F.col("size")).select("n", "p")
    best = _scored(pairs, longest, lambda ratio, _: ratio, "score").groupBy("n").agg(F.max("score").alias("score")).filter(F.col("score") >= NEAR)
    lengths = table.select(F.explode(F.sequence(F.greatest(F.col("m") - slack_, F.lit(0)), F.col("m") + slack_)).alias("size")).distinct().withColumn("close", F.lit(True))
    return best.join(lengths, F.length("n") == F.col("size"), "left").filter((F.col("score") >= STRICT) | F.coalesce("close", F.lit(False))).select("n", "score")


def is_near_phrase(n: str, phrase: str) -> Column:
    """The rule for a column and one given phrase (already normalised), by plain ratio."""
    m, spelled = len(phrase), "'" + phrase.replace("\\", "\\\\").replace("'", "\\'") + "'"
    d, score = max(2, min(4, int(m * 0.2))), fuzzy.ratio(n, spelled)
    gap = F.length(n) - m
    return (F.col(n) == phrase) | ((F.abs(gap) <= d) & (score >= NEAR)) | ((gap > d) & (gap <= m * 2 * (100 - STRICT) / STRICT) & (score >= STRICT))
