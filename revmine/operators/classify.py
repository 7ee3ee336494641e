"""The comment classifier: hashed word features and logistic regression; only this head is learned.

Features are fixed, so that training is a convex problem whose passes over the data are tree aggregates.
P(keep) is the sigmoid of the margin. (A linear model's raw prediction is (-m, m); its softmax would be
sigmoid(2m), so logits are written as (0, m).)
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import evaluate, ingest

FEATURES, PASSES, REGULAR = 1 << 14, 20, 0.001


def words(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("__words", F.filter(F.split(text.words_only(text_col), " "), lambda w: w != ""))


def train(examples: DataFrame, text_col: str = "text", label: str = "label", regular: float = REGULAR, passes: int = PASSES, features: int = FEATURES, warm: PipelineModel | None = None) -> PipelineModel:
    """A pipeline model; rows without a label or text are left out."""
    rows = words(examples.filter(F.col(label).isNotNull()), text_col).withColumn("__label", F.col(label).cast("double"))
    lr = LogisticRegression(featuresCol="__features", labelCol="__label", regParam=regular, maxIter=passes, probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction")
    return Pipeline(stages=[HashingTF(inputCol="__words", outputCol="__features", numFeatures=features), lr]).fit(rows)


def losses(model: PipelineModel) -> list[float]:
    """The loss at the start and after each pass of training."""
    return list(model.stages[-1].summary.objectiveHistory)


def feature_key(text_col: str, features: int = FEATURES) -> Column:
    """Key of a row's cached features: its text and the settings they depend on."""
    return text.content_key(text_col, F.lit(f"|{features}"))


def cached_features(df: DataFrame, path: str, text_col: str = "text", features: int = FEATURES) -> DataFrame:
    """df with key, features (a vector) and hit: whether the cache at path had them. Features of keys that it lacks are computed once a key and added."""
    keyed = df.withColumn("key", feature_key(text_col, features))
    try:
        cache = df.sparkSession.read.parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        cache = None
    known = cache.select("key") if cache is not None else keyed.select("key").limit(0)
    new = ingest.not_indexed(keyed.select("key", F.col(text_col).alias("__text")), known, "key")
    made = HashingTF(inputCol="__words", outputCol="features", numFeatures=features).transform(words(new, "__text")).select("key", "features")
    number = 0 if cache is None else cache.agg(F.max("number")).first()[0] + 1
    made.withColumn("number", F.lit(number)).write.mode("append").parquet(path)
    whole = df.sparkSession.read.parquet(path).select("key", "features", (F.col("number") < number).alias("hit"))
    return keyed.join(whole, "key")


def score(model: PipelineModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with logit0 (0), logit1 (margin) and p_keep."""
    out = model.transform(words(df, text_col))
    out = out.withColumns({"logit0": F.lit(0.0), "logit1": F.get(vector_to_array("__raw"), F.lit(1)), "p_keep": F.get(vector_to_array("__probability"), F.lit(1))})
    return out.drop("__words", "__features", "__raw", "__probability", "__prediction")


def grid(regulars: list[float], passes: list[int], features: list[int]) -> list[dict]:
    return [{"regular": r, "passes": p, "features": f} for r in regulars for p in passes for f in features]


def sweep(train_rows: DataFrame, dev_rows: DataFrame, runs: list[dict], finished: set[str] = frozenset(), text_col: str = "text", label: str = "label") -> DataFrame:
    """(run, acc, precision, recall, f1, acc_and_f1) for each run of the grid that is not finished yet; the best run by accuracy comes first."""
    out = None
    for run in runs:
        name = "_".join(f"{k}{v}" for k, v in run.items())
        if name in finished:
            continue
        model = train(train_rows, text_col, label, **run)
        scored = score(model, dev_rows, text_col).withColumn("predicted", (F.col("p_keep") >= 0.5).cast("int"))
        row = evaluate.summary(scored, label, "predicted").withColumn("run", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("acc"), "run") if out is not None else None


def save_best(models: dict[str, PipelineModel], accuracies: dict[str, float], folder: str) -> str:
    """Write every model as the last checkpoint, in order, and the most accurate one (the first of equals) as the best; gives the best one's name."""
    best = None
    for name, model in models.items():
        model.write().overwrite().save(f"{folder}/checkpoint-last")
        if best is None or accuracies[name] > accuracies[best]:
            best = name
            model.write().overwrite().save(f"{folder}/checkpoint-best")
    return best


def load(folder: str, which: str = "best") -> PipelineModel:
    return PipelineModel.load(f"{folder}/checkpoint-{which}")
