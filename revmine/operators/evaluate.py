"""Evaluation of classifiers: confusion cells, reports, threshold sweeps and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import work

# Fixed value: up to so many texts that share a key are broadcast by their digests.
MOST_SHARED = 400_000


def _or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return _or_zero(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return _or_zero(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _or_zero(2 * tp, 2 * tp + fp + fn)


def counts(label: Column, predicted: Column) -> list[Column]:
    """tp, fp, fn, tn of 0/1 columns."""
    cell = lambda y, p, name: F.count_if((label == y) & (predicted == p)).alias(name)
    return [cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn")]


def cell(label: Column, predicted: Column) -> Column:
    """'tp', 'fp', 'fn' or 'tn'."""
    return F.when(predicted == 1, F.when(label == 1, "tp").otherwise("fp")).otherwise(F.when(label == 1, "fn").otherwise("tn"))


def summary(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy, precision, recall, F1 and the mean of accuracy and F1."""
    c = scored.agg(*counts(F.col(label), F.col(predicted)))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    out = c.select("tp", "fp", "fn", "tn", _or_zero(tp + tn, tp + fp + fn + tn).alias("acc"), precision(tp, fp).alias("precision"), recall(tp, fn).alias("recall"), f1(tp, fp, fn).alias("f1"))
    return out.withColumn("acc_and_f1", (F.col("acc") + F.col("f1")) / 2)


def confusion_matrix(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return scored.groupBy(label).pivot(predicted, [0, 1]).agg(F.count(F.lit(1))).select(label, F.coalesce("0", F.lit(0)).alias("predicted_0"), F.coalesce("1", F.lit(0)).alias("predicted_1"))


def report(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(class, precision, recall, f1, support) of each class, and their plain ('macro avg') and weighted averages, to 4 digits."""
    c = scored.agg(*counts(F.col(label), F.col(predicted)))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    side = lambda name, a, b, d: F.struct(F.lit(name).alias("class"), precision(a, b).alias("precision"), recall(a, d).alias("recall"), f1(a, b, d).alias("f1"), (a + d).alias("support"))
    rows = c.select(F.explode(F.array(side("0", tn, fn, fp), side("1", tp, fp, fn))).alias("r")).select("r.*")
    whole = rows.agg(*[F.avg(x).alias(x) for x in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), "*")
    weighted = rows.agg(*[_or_zero(F.sum(F.col(x) * F.col("support")), F.sum("support")).alias(x) for x in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), "*")
    return rows.unionByName(whole).unionByName(weighted).select("class", *[F.round(x, 4).alias(x) for x in ("precision", "recall", "f1")], "support")


def sweep(scored: DataFrame, steps: int = 100, label: str = "label", probability: str = "prob") -> DataFrame:
    """(threshold, tp, fp, fn, f1) for thresholds 0, 1/steps, ... 1 with predictions probability > threshold.

    Rows are counted once a step of probability; the (steps + 1)-row table of counts is summed from above.
    """
    spark = scored.sparkSession
    grid = spark.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    above = F.least(F.greatest(F.ceil(F.col(probability) * steps) - 1, F.lit(-1)), F.lit(steps)).cast("int")
    above = F.when(F.col(probability) > (above + 1) / F.lit(float(steps)), above + 1).when((above >= 0) & ~(F.col(probability) > above / F.lit(float(steps))), above - 1).otherwise(above)
    above = F.least(above, F.lit(steps))
    seen = scored.groupBy(above.alias("last")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    all_ = grid.join(seen, F.col("step") == F.col("last"), "left").select("step", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    from_ = Window.orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    total = seen.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("all_pos"))
    out = all_.select("step", F.sum("pos").over(from_).alias("tp"), F.sum("neg").over(from_).alias("fp")).join(F.broadcast(total))
    return out.select((F.col("step") / F.lit(float(steps))).alias("threshold"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn")).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def best(swept: DataFrame) -> DataFrame:
    """The first threshold of the largest F1; 0 where no F1 is above 0."""
    return swept.orderBy(F.desc("f1"), "threshold").limit(1).select(F.when(F.col("f1") > 0, F.col("threshold")).otherwise(0.0).alias("threshold"), "f1")


def sweep_pairs(pairs: DataFrame, similarities: list[float], probabilities: list[float]) -> DataFrame:
    """pairs(sim, prob, label) -> (sim_t, clf_t, precision, recall, f1, num_pairs): pairs with sim >= sim_t are kept, prob >= clf_t predicts 1.

    Both grids are given lists; each pair is counted once for every grid cell, combined before the shuffle.
    """
    cells = F.array(*[F.struct(F.lit(s).alias("sim_t"), F.lit(c).alias("clf_t")) for s in similarities for c in probabilities])
    met = pairs.withColumn("cell", F.explode(F.filter(cells, lambda x: F.col("sim") >= x["sim_t"]))).select("label", "cell.*", (F.col("prob") >= F.col("cell.clf_t")).cast("int").alias("predicted"))
    seen = met.groupBy("sim_t", "clf_t").agg(*counts(F.col("label"), F.col("predicted")), F.count(F.lit(1)).alias("num_pairs"))
    grid = pairs.sparkSession.createDataFrame([(s, c) for s in similarities for c in probabilities], "sim_t double, clf_t double")
    full = grid.join(seen, ["sim_t", "clf_t"], "left").na.fill(0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return full.select("sim_t", "clf_t", precision(tp, fp).alias("precision"), recall(tp, fn).alias("recall"), f1(tp, fp, fn).alias("f1"), F.col("num_pairs").cast("long").alias("num_pairs"))


def run_summary(lines: DataFrame, run: str = "run", line: str = "value", metrics: tuple[str, ...] = ("acc", "precision", "recall", "acc_and_f1", "f1")) -> DataFrame:
    """Log lines 'key = value' -> a row a run with the largest value of each metric."""
    found = lines.select(run, F.regexp_extract(line, r"^(\w+) +=", 1).alias("metric"), F.expr(f"try_cast(regexp_extract(`{line}`, '= *(-?[0-9.eE+-]+)', 1) AS double)").alias("v")).filter(F.col("metric").isin(*metrics) & F.col("v").isNotNull())
    return found.groupBy(run).pivot("metric", list(metrics)).agg(F.max("v"))


def first_errors(scored: DataFrame, n: int, order: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """The first n rows of each kind of error, with ``cell`` and ``rank``."""
    wrong = scored.withColumn("cell", cell(F.col(label), F.col(predicted))).filter(F.col("cell").isin("fp", "fn"))
    return wrong.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(*order))).filter(F.col("rank") <= n)


def frequencies(texts: DataFrame, column: str) -> DataFrame:
    """(comment, count), most frequent first, ties by text."""
    return texts.groupBy(F.col(column).alias("comment")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "comment")


def merged(counted: DataFrame, key: Column) -> DataFrame:
    """(comment, count) -> (norm, total_count, variants): counts of texts with one key summed, their texts listed in order."""
    return counted.groupBy(key.alias("norm")).agg(F.sum("count").alias("total_count"), F.array_sort(F.collect_list("comment")).alias("variants")).orderBy(F.desc("total_count"), "norm")


def merged_keys(texts: DataFrame, column: str, key: Column, most: int = MOST_SHARED) -> DataFrame:
    """(norm_key, total_count, variants_key): what merged(frequencies(texts, column), key) has, in no order, with md5 keys of norm and of the variants joined by '|'.

    Texts are told apart by SHA-256, so slim rows are counted and merged. Only the texts of a key that has several are read once
    more and brought together, met by their digests; all others stay where they are.
    """
    folder = work.shared_folder(texts.sparkSession, "merged")
    digest = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    rows = texts.select(digest(F.col(column)).alias("text_sha"), text.content_key(column).alias("text_key"), digest(key).alias("norm_sha"), text.content_key(key).alias("norm_key"))
    seen = work.written(rows.groupBy("text_sha", "text_key", "norm_sha", "norm_key").agg(F.count(F.lit(1)).alias("n")), f"{folder}/texts")
    own = F.min(F.when(F.col("text_sha").isNotNull(), F.col("text_key")))
    norms = seen.groupBy("norm_sha", "norm_key").agg(F.sum("n").alias("total_count"), F.count("text_sha").alias("variants"), F.coalesce(own, F.md5(F.lit("").cast("binary"))).alias("variants_key"))
    norms, shown = work.written(norms, f"{folder}/norms"), ["norm_key", "total_count", "variants_key"]
    several = norms.filter("variants > 1").drop("variants_key")
    shared = work.written(seen.filter("text_sha is not null").join(several, "norm_sha", "left_semi").select("text_sha", "norm_sha"), f"{folder}/shared")
    n = shared.count()
    if not n:
        return norms.select(shown)
    met = texts.select(digest(F.col(column)).alias("text_sha"), F.col(column).alias("text")).join(F.broadcast(shared) if n <= most else shared, "text_sha")
    joined = met.groupBy("norm_sha", "text").agg(F.lit(1)).groupBy("norm_sha").agg(text.content_key(F.array_join(F.array_sort(F.collect_list("text")), "|")).alias("variants_key"))
    return norms.filter("variants <= 1").select(shown).unionByName(several.join(joined, "norm_sha").select(shown))
