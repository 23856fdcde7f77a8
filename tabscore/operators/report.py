"""Result tables for reading: best model per metric and formatted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.scalars import format_metric, slug

# Metrics for which a smaller value is better, and the columns of each report.
LOWER_IS_BETTER = ["MAE", "RMSE", "MAPE", "Fairness"]
PERFORMANCE = ["MAE", "RMSE", "R2", "MAPE", "Accuracy"]


def _position(model: Column, models: list[str]) -> Column:
    return F.array_position(F.lit(models), model).cast("int")


def best_model(scores: DataFrame, models: list[str], skip: list[tuple[str, str]] = ()) -> DataFrame:
    """Best model per (dataset, metric); on a tie the first in model order.

    ``skip`` lists (dataset, metric) pairs that are not judged.
    """
    kept = scores.where(F.col("value").isNotNull())
    for dataset, metric in skip:
        kept = kept.where(~((F.col("dataset") == dataset) & (F.col("metric") == metric)))
    gain = F.when(F.col("metric").isin(LOWER_IS_BETTER), -F.col("value")).otherwise(F.col("value"))
    best = F.max(F.struct(gain.alias("gain"), (-_position(F.col("model"), models)).alias("o"), "model", "value"))
    return (
        kept.groupBy("dataset", "metric").agg(best.alias("b"))
        .select("dataset", "metric", F.col("b.model").alias("best_model"), F.col("b.value").alias("best_value"))
    )


def formatted(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per dataset and model, one text column per metric."""
    shown = scores.where(F.col("metric").isin(metrics)).withColumn(
        "text", format_metric(F.col("value"), F.col("metric"))
    )
    return shown.groupBy("dataset", "model").pivot("metric", metrics).agg(F.first("text"))


def performance_report(scores: DataFrame) -> DataFrame:
    return formatted(scores, PERFORMANCE)


def fairness_report(scores: DataFrame) -> DataFrame:
    return formatted(scores, ["Fairness"]).withColumnRenamed("Fairness", "Disparity")


def readiness_report(scores: DataFrame) -> DataFrame:
    return formatted(scores, ["Readiness"]).withColumnRenamed("Readiness", "Total_Readiness")


def by_dataset(report: DataFrame) -> DataFrame:
    """Add the slug under which each dataset's report is stored."""
    return report.withColumn("slug", slug(F.col("dataset")))


def write_reports(scores: DataFrame, path: str) -> None:
    """The three reports, one folder per dataset."""
    for name, table in (
        ("performance_metrics", performance_report(scores)),
        ("fairness_summary", fairness_report(scores)),
        ("readiness_summary", readiness_report(scores)),
    ):
        by_dataset(table).write.mode("overwrite").partitionBy("slug").option("header", True).csv(f"{path}/{name}")
