"""Feature importance from Shapley values, with fallbacks from the model itself."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import OneVsRestModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscore.functions.scalars import feature_label, round_half_even
from tabscore.operators.reshape import to_matrix


def mean_abs(phi: DataFrame, keys: list[str]) -> DataFrame:
    """Mean |phi| over the rows, per key and feature."""
    return phi.groupBy(*keys, "feature").agg(F.avg(F.abs("phi")).alias("importance"))


def ranked(importance: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``rank``: largest first, equal values by feature name."""
    w = Window.partitionBy(*keys).orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(w))


def top_k(importance: DataFrame, keys: list[str], k: int) -> DataFrame:
    return ranked(importance, keys).where(F.col("rank") <= k)


def top_label(importance: DataFrame) -> DataFrame:
    """Chart label and value of each model's first feature."""
    top = top_k(importance, ["model"], 1)
    return top.select("model", feature_label(F.col("model"), F.col("feature")).alias("label"), "importance")


def matrix(importance: DataFrame, features: list[str], digits: int = 6) -> DataFrame:
    """Model x feature, rounded."""
    rounded = importance.withColumn("importance", round_half_even(F.col("importance"), digits))
    return to_matrix(rounded, "model", "feature", "importance", features)


def as_json(importance: DataFrame) -> DataFrame:
    """One JSON object per model: feature -> importance, in feature order."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "importance"))))
    return importance.groupBy("model").agg(F.to_json(pairs).alias("json"))


def native(spark: SparkSession, models: dict[str, Model], features: list[str]) -> DataFrame:
    """Importance a fitted model states about itself: ``model, feature, importance, source``.

    Tree models state it directly (one model per class: their mean); linear models give the largest |coefficient|
    over their classes; any other model gives zeros under the source ``N/A``.
    """
    rows = []
    for name, model in models.items():
        if isinstance(model, OneVsRestModel):
            per_class = [m.featureImportances.toArray() for m in model.models]
            values, source = sum(per_class) / len(per_class), "native"
        elif hasattr(model, "featureImportances"):
            values, source = model.featureImportances.toArray(), "native"
        elif hasattr(model, "coefficientMatrix"):
            values, source = abs(model.coefficientMatrix.toArray()).max(axis=0), "coefficients"
        else:
            values, source = [0.0] * len(features), "N/A"
        rows += [(name, f, float(v), source) for f, v in zip(features, values, strict=True)]
    return spark.createDataFrame(rows, "model string, feature string, importance double, source string")
