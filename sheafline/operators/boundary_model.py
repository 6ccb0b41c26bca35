"""Learned boundary decisions: scaled features, balanced logistic regression or boosted trees."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.operators.boundaries import FEATURES, THRESHOLD

SEED, VALIDATION = 42, 0.2
KINDS = ("logistic_regression", "gradient_boosting")


def training_pairs(features: DataFrame, truth: DataFrame) -> DataFrame:
    """Features with ``label`` 1 for the same document and 0 for a boundary."""
    return features.join(truth.select("stream_id", "page_a", "page_b", (~F.col("is_boundary")).cast("double").alias("label")), ["stream_id", "page_a", "page_b"])


def divided(pairs: DataFrame, share: float = VALIDATION) -> tuple[DataFrame, DataFrame]:
    """Training and validation pairs by a hash of the pair, alike in both classes."""
    roll = F.pmod(F.xxhash64(F.lit(SEED), "stream_id", "page_a"), F.lit(10_000)) / 10_000.0
    return pairs.where(roll >= share), pairs.where(roll < share)


def first_streams(pages: DataFrame, n: int, order: str = "received_at") -> DataFrame:
    """Pages of the ``n`` streams that were met first, by their least ``order`` and then by id; null ``order`` comes last."""
    met = pages.groupBy("stream_id").agg(F.min(order).alias("met")).orderBy(F.asc_nulls_last("met"), "stream_id").limit(n)
    return pages.join(met.select("stream_id"), "stream_id", "left_semi")


def validation_counts(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """``is_boundary, said_boundary, pairs``: confusion of the model on pairs that it was not fitted on."""
    said = (vector_to_array("probability")[1] < THRESHOLD).alias("said_boundary")
    return model.transform(pairs).groupBy((F.col("label") == 0).alias("is_boundary"), said).agg(F.count("*").alias("pairs"))


def train(pairs: DataFrame, kind: str = "logistic_regression") -> PipelineModel:
    """Fitted pipeline; the scaler sees the training pairs only. Any other name is logistic regression."""
    counts = {r["label"]: r["n"] for r in pairs.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        raise ValueError("training needs pairs of both classes")
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1, total / (2.0 * counts[1.0])).otherwise(total / (2.0 * counts[0.0]))
    estimator = (
        GBTClassifier(featuresCol="scaled", weightCol="weight", maxIter=100, maxDepth=4, seed=SEED)
        if kind == "gradient_boosting"
        else LogisticRegression(featuresCol="scaled", weightCol="weight", maxIter=1000, regParam=1.0 / total, standardization=False)
    )
    stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), estimator]
    return Pipeline(stages=stages).fit(pairs.withColumn("weight", weight))


def learned_decisions(features: DataFrame, model: PipelineModel, threshold: float = THRESHOLD) -> DataFrame:
    """``stream_id, page_a, page_b, score, is_boundary, method``; the score is the chance of the same document."""
    p = vector_to_array("probability")[1]
    return model.transform(features).select("stream_id", "page_a", "page_b", p.alias("score"), (p < threshold).alias("is_boundary"), F.lit("learned").alias("method"))


def importances(model: PipelineModel) -> dict[str, float]:
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return dict(zip(FEATURES, map(float, values.toArray())))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | None:
    """The saved model, or nothing where none was saved."""
    try:
        return PipelineModel.load(path)
    except Exception as error:
        if "does not exist" in str(error) or "PATH_NOT_FOUND" in str(error) or "No such file" in str(error):
            return None
        raise
