"""Labelled training pairs: positives from windows, negatives from other reviews, and exact splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import diff, text
from ..sources import work
from . import ranking

# How often a suggestion is repeated, the parts of the split, and the seed.
SUGGESTION_COPIES, TRAIN, DEV, SEED = 2, 0.8, 0.1, 42


def positives(records: DataFrame, copies: int = SUGGESTION_COPIES, window: int = diff.WINDOW, overlap: int = diff.OVERLAP) -> DataFrame:
    """records(record_id, pr_number, filename, labels, diff_text, suggestion_text, comment_text, commenter, generic)
    -> (record_id, window_no, copy_no, label, pr_number, commenter, diff, comment).

    Each window of a diff gives the suggestion ``copies`` times and, unless it is the same text, the comment if
    rule A keeps it (copy_no 0). Records without a diff give nothing.
    """
    r = records.select("record_id", text.text("pr_number").alias("pr_number"), text.text("commenter").alias("commenter"), text.text("filename").alias("fn"), text.text("labels").alias("lb"), text.strip("diff_text").alias("d"), text.strip("suggestion_text").alias("s"), text.strip("comment_text").alias("c"), "generic").filter("d <> ''")
    stays = (F.col("c") != "") & (F.col("c") != F.col("s")) & text.keep_for_training("c", F.col("generic"))
    r = r.withColumn("stays", stays)
    said = F.array_repeat(F.struct(F.col("s").alias("comment")), F.when(F.col("s") != "", copies).otherwise(0))
    none = F.array().cast("array<struct<comment:string,copy_no:int>>")
    numbered = F.transform(said, lambda x, i: F.struct(x["comment"].alias("comment"), (i + 1).alias("copy_no")))
    own = F.when(F.col("stays"), F.array(F.struct(F.col("c").alias("comment"), F.lit(0).alias("copy_no")))).otherwise(none)
    # What says nothing is not cut; a filter here would be moved down and judge every comment twice.
    rows = r.withColumn("said", F.concat(numbered, own)).withColumn("d", F.when(F.size("said") > 0, F.col("d")))
    rows = diff.windows(rows, "d", window, overlap).withColumn("one", F.explode("said"))
    return rows.select("record_id", "window_no", "one.copy_no", F.lit(1).alias("label"), "pr_number", "commenter", text.with_prefix("fn", "lb", "window_text").alias("diff"), "one.comment")


def negatives(rows: DataFrame, id_cols: list[str], seed: int = SEED) -> DataFrame:
    """For every positive a pair with the same diff and the comment of a random positive of another review.

    Rows are numbered in hash order; a row draws a number, and draws again while the row there is of its own
    review, so partners are uniform over the others. A round is a join on unique numbers, whatever the skew. Rows of a
    review that has more than half of all rows draw among the rows of the others, numbered by themselves, so that
    each round settles at least half of what is open. Raises if there is one review only.
    """
    folder = work.shared_folder(rows.sparkSession, "negatives")
    return _negatives(work.written(rows.withColumn("__at", F.monotonically_increasing_id()), f"{folder}/rows"), id_cols, seed, folder)


def _negatives(rows: DataFrame, id_cols: list[str], seed: int, folder: str) -> DataFrame:
    """negatives() of written rows with a number of their own (__at). Rounds draw on slim rows; texts meet once, at the end."""
    if rows.select("pr_number").distinct().limit(2).count() < 2:
        raise ValueError("negatives need rows of two reviews at least")
    key, slim = ranking.hash_key(seed, *[F.col(c) for c in id_cols]), rows.select(*id_cols, "pr_number", "__at")
    placed, n = ranking.numbered(slim, key, *id_cols)
    placed = work.written(placed, f"{folder}/numbered")
    largest = placed.groupBy("pr_number").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("pr_number", "n").alias("pr"), F.max("n").alias("n")).first()
    shown, done, k = ["__at", "pr_number", "row_no"], [], 0

    def drawn(open_: DataFrame, among: DataFrame, size: int, k: int) -> DataFrame:
        j = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(f"{seed}n{k}"), F.col("row_no").cast("string")).cast("binary")), 1, 13), 16, 10).cast("long"), F.lit(size))
        partner = among.select(F.col("row_no").alias("j"), F.col("pr_number").alias("other"), F.col("__at").alias("__their"))
        return work.written(open_.withColumn("j", j).join(partner, "j"), f"{folder}/round-{len(done)}")

    def settle(met: DataFrame) -> None:
        done.append(met.select("__at", "__their"))

    open_ = placed.select(shown)
    if 2 * largest["n"] > n:
        others, size = ranking.numbered(slim.filter(F.col("pr_number") != largest["pr"]), key, *id_cols)
        settle(drawn(open_.filter(F.col("pr_number") == largest["pr"]), work.written(others, f"{folder}/others"), size, 0))
        open_ = open_.filter(F.col("pr_number") != largest["pr"])
    while True:
        met, fits = drawn(open_, placed, n, k), F.col("other") != F.col("pr_number")
        settle(met.filter(fits))
        open_, k = met.filter(~fits).select(shown), k + 1
        if open_.isEmpty():
            break
    own, theirs = rows.select("__at", *id_cols, "pr_number", "diff"), rows.select(F.col("__at").alias("__their"), "commenter", "comment")
    return reduce(DataFrame.unionByName, done).join(own, "__at").join(theirs, "__their").select(*id_cols, F.lit(0).alias("label"), "pr_number", "commenter", "diff", "comment")


def with_negatives(rows: DataFrame, id_cols: list[str], seed: int = SEED) -> DataFrame:
    """Positives (written once) and a negative for each, with the columns that both have."""
    folder = work.shared_folder(rows.sparkSession, "both")
    rows = work.written(rows.withColumn("__at", F.monotonically_increasing_id()), f"{folder}/rows")
    shown = [*id_cols, "label", "pr_number", "commenter", "diff", "comment"]
    return rows.select(shown).unionByName(_negatives(rows, id_cols, seed, folder).select(shown))


def split(rows: DataFrame, id_cols: list[str], seed: int = SEED, train: float = TRAIN, dev: float = DEV) -> DataFrame:
    """rows with ``part``: train, dev and test by their number in hash order; sizes are exact, the rest is test. Rows are written once before they are counted and numbered."""
    rows = work.written(rows, f"{work.shared_folder(rows.sparkSession, 'split')}/rows")
    placed, n = ranking.numbered(rows, ranking.hash_key(seed, *[F.col(c) for c in id_cols]), *id_cols)
    a, b = int(n * train), int(n * dev)
    return placed.withColumn("part", F.when(F.col("row_no") < a, "train").when(F.col("row_no") < a + b, "dev").otherwise("test"))


def examples(rows: DataFrame, part: str) -> DataFrame:
    """Adds guid, '{part}-{number}'; labels of the test part are forced to '0'."""
    label = F.lit("0") if part == "test" else F.col("label").cast("string")
    return rows.withColumns({"guid": F.concat(F.lit(f"{part}-"), F.col("row_no").cast("string")), "label": label})
