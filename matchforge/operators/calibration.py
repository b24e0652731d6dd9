"""Calibration models fitted by Spark: outcomes, a binary model, and a pairwise ranker with grouped folds.

Features are standardised for the fit, so no feature is favoured for its unit, and
weights come back in the features' own units. No penalty: the weights are those
of the largest likelihood, to which plain gradient steps converge as well.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchforge.sources.shared import stored


def fitted(rows: DataFrame, features: list[str], label: str, family: str, intercept: bool = True, penalty: float = 0.0) -> LogisticRegressionModel:
    vectors = VectorAssembler(inputCols=features, outputCol="__x").transform(rows.select(*features, F.col(label).cast("double").alias("__y")))
    return LogisticRegression(featuresCol="__x", labelCol="__y", family=family, fitIntercept=intercept, regParam=penalty, standardization=True, maxIter=300, tol=1e-9).fit(vectors)


def outcome_weights(spark: SparkSession, model: LogisticRegressionModel, features: list[str]) -> DataFrame:
    """(feature, class, weight) of a multinomial model; the constant is the feature "1"."""
    matrix, constants = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    rows = [(f, k, float(matrix[k, i])) for i, f in enumerate(features) for k in range(len(constants))] + [("1", k, float(c)) for k, c in enumerate(constants)]
    return spark.createDataFrame(rows, "feature string, class int, weight double")


def with_probabilities(rows: DataFrame, model: LogisticRegressionModel, features: list[str]) -> DataFrame:
    """`rows` with p, an array of the probabilities of the classes."""
    vectors = VectorAssembler(inputCols=features, outputCol="__x").transform(rows)
    done = model.setFeaturesCol("__x").setProbabilityCol("__p").setPredictionCol("").setRawPredictionCol("").transform(vectors)
    return done.withColumn("p", vector_to_array("__p")).drop("__x", "__p")


def ranked_out_of_fold(pairs: DataFrame, features: list[str], folds: int, penalty: float = 0.01) -> DataFrame:
    """`pairs` (fold, differences right minus other) with score, by a model that saw no pair of the fold.

    A pair and its mirror image are the two classes, so the model needs no
    constant. Scores above zero put the right one first. Pairs are written once:
    else each fold's fit and scores would shuffle their way to them anew.
    """
    pairs = stored(pairs, "pairs")
    sides = [F.struct(*[(F.col(f) * sign).alias(f) for f in features], F.lit(label).alias("label")) for sign, label in ((1, 1), (-1, 0))]
    both = pairs.select("fold", F.inline(F.array(*sides)))
    out = None
    for k in range(folds):
        weights = fitted(both.filter(F.col("fold") != k), features, "label", "binomial", False, penalty).coefficients.toArray()
        own = pairs.filter(F.col("fold") == k).withColumn("score", sum((F.col(f) * float(w) for f, w in zip(features, weights, strict=True)), F.lit(0.0)))
        out = own if out is None else out.unionByName(own)
    return out
