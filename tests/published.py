"""Scores published for five education tables: the report tests use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabscore.operators.reshape import scores_from_dict

METRICS = ["MAE", "RMSE", "R2", "MAPE", "Accuracy", "Fairness", "Readiness"]
MODEL_ORDER = ["XGBoost", "RandomForest", "LightGBM", "LogisticRegression"]

# Dataset, model, then one value per metric in the order above.
PUBLISHED = [
    ("Student Performance", "XGBoost", 0.7274, 1.9263, 0.7375, 1.04, 98.92, 0.4186, 18.69),
    ("Student Performance", "RandomForest", 1.1197, 2.1954, 0.6590, 1.63, 98.34, 0.2309, 17.30),
    ("Student Performance", "LightGBM", 0.7314, 1.9028, 0.7439, 1.04, 98.91, 0.4249, 17.72),
    ("Student Performance", "LogisticRegression", 1.1172, 2.2838, 0.6310, 1.62, 98.34, 0.4619, 17.16),
    ("University Ranking", "XGBoost", 368.81, 486.46, 0.2165, 35.09, 95.9, 0.0004, 18.79),
    ("University Ranking", "RandomForest", 368.04, 482.22, 0.2301, 34.76, 95.9, 0.0084, 18.80),
    ("University Ranking", "LightGBM", 364.51, 476.47, 0.2484, 35.11, 95.9, 0.0044, 18.79),
    ("University Ranking", "LogisticRegression", 939.08, 1088.19, -2.9204, 99.67, 10.7, 0.0014, 12.54),
    ("Enrollment", "XGBoost", 235251, 369604, 0.9970, 4.08, 99.7, 398335, 14.997),
    ("Enrollment", "RandomForest", 226740, 420093, 0.9961, 3.04, 99.6, 106705, 14.996),
    ("Enrollment", "LightGBM", 1975339, 2389779, 0.8734, 35.67, 87.3, 1584734, 14.873),
    ("Enrollment", "LogisticRegression", 6036301, 6349858, 0.1063, 245.16, 10.6, 3093992, 14.106),
    ("Dropout", "XGBoost", 0.306, 0.444, 0.4559, 1.355932e+09, 76.3, 0.0271, 18.81),
    ("Dropout", "RandomForest", 0.289, 0.414, 0.4932, 1.378531e+09, 77.3, 0.0065, 18.86),
    ("Dropout", "LightGBM", 0.303, 0.441, 0.4600, 1.401130e+09, 76.6, 0.0068, 18.83),
    ("Dropout", "LogisticRegression", 0.314, 0.454, 0.4434, 1.299435e+09, 75.6, 0.0087, 17.78),
    ("Budget Prediction", "XGBoost", 0.0815, 1.1606, 0.9318, 2.3151, 98.52, 0.0009, 19.90),
    ("Budget Prediction", "RandomForest", 1.5031, 22.0941, 0.2156, 38.8370, 77.40, 0.0008, 18.76),
    ("Budget Prediction", "LightGBM", 2.2800, 50.1843, 0.6690, 40.8317, 76.00, 0.0015, 19.20),
    ("Budget Prediction", "LogisticRegression", 0.1042, 1.3952, 0.9140, 2.8706, 97.86, 0.0011, 18.89),
]


def published_scores(spark: SparkSession) -> DataFrame:
    """Long table ``dataset, model, metric, value`` (140 rows)."""
    nested: dict[str, dict[str, dict[str, float]]] = {}
    for dataset, model, *values in PUBLISHED:
        nested.setdefault(dataset, {})[model] = dict(zip(METRICS, map(float, values), strict=True))
    return scores_from_dict(spark, nested)
