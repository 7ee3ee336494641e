"""Plans over frequencies, scores and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluate
from ..sources import readers
from . import inputs as sql
from .registry import query

_LOGIT = "((doc_id * 37) % 200 - 100) / 25.0"
#: Scored labels in DuckDB: table s(doc_id, label, prob, sim, predicted).
_SCORED = f"s0 AS (SELECT doc_id, quality AS label, 1 / (1 + exp(-({_LOGIT})::DOUBLE)) AS prob, ((doc_id * 53) % 100) / 100.0::DOUBLE AS sim FROM labels), s AS (SELECT *, (prob >= 0.47)::INT AS predicted FROM s0)"
_SIMS, _PROBS = [0.60, 0.65, 0.70, 0.75, 0.80], [0.45, 0.50, 0.55, 0.60, 0.65]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.table(spark, sf_dir, "labels")
    s = rows.select("doc_id", F.col("quality").alias("label"), text.softmax_positive(F.lit(0.0), F.expr(_LOGIT).cast("double")).alias("prob"), (F.expr("(doc_id * 53) % 100") / F.lit(100.0)).alias("sim"))
    return s.withColumn("predicted", (F.col("prob") >= 0.47).cast("int"))


@query(f'WITH {sql.COMMENTS}, {"k AS (SELECT " + sql.words_only("comment_text") + " AS comment FROM c WHERE " + sql.is_trivial_train("comment_text") + ")"} SELECT comment, count(*) AS "count" FROM k GROUP BY comment')
def comment_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each trivial comment occurs."""
    c = sql.comments(spark, sf_dir).filter(text.is_trivial_train("comment_text")).select(text.words_only("comment_text").alias("comment"))
    return evaluate.frequencies(c, "comment")


_KEY = sql.gsub(sql.gsub(f"lower({sql.strip('comment')})", f"[^a-z0-9{text.SPACE}]+"), f"[{text.SPACE}]+", " ")


@query(f"WITH {sql.COMMENTS}, f AS (SELECT comment_text AS comment, count(*) AS n FROM c GROUP BY 1) SELECT md5({_KEY}) AS norm_key, sum(n)::BIGINT AS total_count, md5(array_to_string(list_sort(list(comment)), '|')) AS variants_key FROM f GROUP BY {_KEY}")
def near_dup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of comments that differ in punctuation, case and spacing only, merged."""
    return evaluate.merged_keys(sql.comments(spark, sf_dir), "comment_text", text.merge_key("comment_text"))


_CELL = "CASE WHEN predicted = 1 THEN CASE WHEN label = 1 THEN 'tp' ELSE 'fp' END ELSE CASE WHEN label = 1 THEN 'fn' ELSE 'tn' END END"


@query(f'WITH {_SCORED} SELECT {_CELL} AS cell, count(*) AS n FROM s GROUP BY 1')
def confusion_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy(evaluate.cell(F.col("label"), F.col("predicted")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SCORED} SELECT label, count(*) FILTER (predicted = 0) AS predicted_0, count(*) FILTER (predicted = 1) AS predicted_1 FROM s GROUP BY label")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_matrix(scored(spark, sf_dir))


_COUNTS = "t AS (SELECT count(*) FILTER (label = 1 AND predicted = 1)::DOUBLE AS tp, count(*) FILTER (label = 0 AND predicted = 1)::DOUBLE AS fp, count(*) FILTER (label = 1 AND predicted = 0)::DOUBLE AS fn, count(*) FILTER (label = 0 AND predicted = 0)::DOUBLE AS tn FROM s)"


@query(f"""WITH {_SCORED}, {_COUNTS}, m AS (SELECT tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS acc, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM t)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, acc, precision, recall, f1, (acc + f1) / 2 AS acc_and_f1 FROM m""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(scored(spark, sf_dir))


@query(f"""WITH {_SCORED}, {_COUNTS}, r AS (SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fn + fp) AS f, tn + fp AS n FROM t UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM t)
SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, n::BIGINT AS support FROM r
UNION ALL SELECT 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), sum(n)::BIGINT FROM r
UNION ALL SELECT 'weighted avg', round(sum(p * n) / sum(n), 4), round(sum(r * n) / sum(n), 4), round(sum(f * n) / sum(n), 4), sum(n)::BIGINT FROM r""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report(scored(spark, sf_dir))


_SWEEP = """g AS (SELECT i / 100.0::DOUBLE AS threshold FROM (SELECT unnest(range(0, 101)) AS i)),
w AS (SELECT threshold, count(*) FILTER (label = 1 AND prob > threshold) AS tp, count(*) FILTER (label = 0 AND prob > threshold) AS fp, count(*) FILTER (label = 1 AND NOT prob > threshold) AS fn FROM g, s GROUP BY threshold),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM w)"""


@query(f"WITH {_SCORED}, {_SWEEP} SELECT threshold, tp, fp, fn, f1 FROM f")
def threshold_sweep_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sweep(scored(spark, sf_dir))


@query(f"WITH {_SCORED}, {_SWEEP} SELECT CASE WHEN f1 > 0 THEN threshold ELSE 0 END AS threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best(evaluate.sweep(scored(spark, sf_dir)))


@query(f"""WITH {_SCORED}, g AS (SELECT unnest({_SIMS})::DOUBLE AS sim_t), h AS (SELECT unnest({_PROBS})::DOUBLE AS clf_t),
k AS (SELECT sim_t, clf_t, count(*) FILTER (label = 1 AND prob >= clf_t)::DOUBLE AS tp, count(*) FILTER (label = 0 AND prob >= clf_t)::DOUBLE AS fp, count(*) FILTER (label = 1 AND prob < clf_t)::DOUBLE AS fn, count(*) AS num_pairs FROM g, h, s WHERE sim >= sim_t GROUP BY ALL)
SELECT sim_t, clf_t, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, num_pairs FROM k""")
def threshold_sweep_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sweep_pairs(scored(spark, sf_dir), _SIMS, _PROBS)


@query(f"WITH {_SCORED}, e AS (SELECT doc_id, {_CELL} AS cell FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY doc_id) AS rank FROM e WHERE cell IN ('fp', 'fn')) SELECT doc_id, cell, rank FROM r WHERE rank <= 5")
def error_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five false positives and false negatives."""
    return evaluate.first_errors(scored(spark, sf_dir), 5, ["doc_id"]).select("doc_id", "cell", "rank")


_LINE = "CASE event_id % 7 WHEN 0 THEN 'acc = ' || CAST(value AS STRING) WHEN 1 THEN 'precision = ' || CAST(value AS STRING) WHEN 2 THEN 'recall = ' || CAST(value AS STRING) WHEN 3 THEN 'acc_and_f1 = ' || CAST(value AS STRING) WHEN 4 THEN 'f1 = ' || CAST(value AS STRING) WHEN 5 THEN 'evaluate ' || event_type ELSE 'loss = 0.5' END"


@query("""WITH e AS (SELECT 'run-' || (user_id % 27)::STRING AS run, event_id % 7 AS k, value FROM events)
SELECT run, max(value) FILTER (k = 0) AS acc, max(value) FILTER (k = 1) AS precision, max(value) FILTER (k = 2) AS recall, max(value) FILTER (k = 3) AS acc_and_f1, max(value) FILTER (k = 4) AS f1 FROM e GROUP BY run""")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest value of each metric in the log lines of each run."""
    e = readers.table(spark, sf_dir, "events")
    return evaluate.run_summary(e.select(F.expr("'run-' || CAST(user_id % 27 AS STRING)").alias("run"), F.expr(_LINE).alias("value")))
