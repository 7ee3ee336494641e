"""A trained scorer of (diff, comment) pairs: logistic regression over how their words meet.

Features are expressions over the two word sets, so that scoring stays in the JVM; only their weights are learned.
A pretrained pair model behind a pandas UDF can take its place wherever a score Column is taken.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

REGULAR, PASSES = 0.001, 30
_FEATURES = ("shared", "share_of_comment", "share_of_diff", "long_shared", "comment_size", "diff_size")


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text.words_only(c), " "), lambda w: w != ""))


def features(pairs: DataFrame, diff: str = "diff", comment: str = "comment") -> DataFrame:
    """Adds the features of each pair, unless they are there; two empty texts share nothing. train() and score() take such rows without their texts."""
    if f"__{_FEATURES[0]}" in pairs.columns:
        return pairs
    sets = pairs.withColumns({"__a": _words(F.col(diff)), "__b": _words(F.col(comment))}).withColumn("__both", F.array_intersect("__a", "__b"))
    n = lambda c: F.size(c).cast("double")
    share = lambda whole: F.coalesce(F.try_divide(n("__both"), n(whole)), F.lit(0.0))
    found = {"shared": F.log1p(n("__both")), "share_of_comment": share("__b"), "share_of_diff": share("__a"), "long_shared": F.log1p(n(F.filter("__both", lambda w: F.length(w) >= 6))), "comment_size": F.log1p(n("__b")), "diff_size": F.log1p(n("__a"))}
    return sets.withColumns({f"__{k}": c for k, c in found.items()}).drop("__a", "__b", "__both")


def train(pairs: DataFrame, label: str = "label", diff: str = "diff", comment: str = "comment", regular: float = REGULAR, passes: int = PASSES) -> PipelineModel:
    """A pipeline model from labelled pairs; rows without a label are left out."""
    rows = features(pairs.filter(F.col(label).isNotNull()), diff, comment).withColumn("__label", F.col(label).cast("double"))
    lr = LogisticRegression(featuresCol="__features", labelCol="__label", regParam=regular, maxIter=passes, probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction")
    return Pipeline(stages=[VectorAssembler(inputCols=[f"__{k}" for k in _FEATURES], outputCol="__features"), lr]).fit(rows)


def score(model: PipelineModel, pairs: DataFrame, diff: str = "diff", comment: str = "comment", name: str = "p_pair") -> DataFrame:
    """pairs with the probability that the comment belongs to the diff."""
    out = model.transform(features(pairs, diff, comment)).withColumn(name, F.get(vector_to_array("__probability"), F.lit(1)))
    return out.select(*[c for c in pairs.columns if c.removeprefix("__") not in _FEATURES], name)
