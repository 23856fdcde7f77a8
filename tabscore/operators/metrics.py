"""Scores of predictions: one grouped aggregate over ``(model, y, pred)``.

Every task reduces its rows to one record per model first, so a model that holds
most rows costs no more than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.scalars import clip, ratio_or

# The smallest step of a double at 1, and the floor of a clipped denominator.
DOUBLE_EPS = 2.220446049250313e-16
DENOMINATOR_FLOOR = 1e-8


def abs_error(y: Column, p: Column) -> Column:
    return F.abs(y - p)


def sq_error(y: Column, p: Column) -> Column:
    return (y - p) * (y - p)


def r2(y: Column, p: Column) -> Column:
    """1 - residual / total sum of squares, in one pass.

    The total comes from the mergeable population variance. A constant target
    gives 1 when every prediction is exact and 0 otherwise; one row gives NULL.
    """
    resid = F.sum(sq_error(y, p))
    total = F.var_pop(y) * F.count(y)
    return (
        F.when(F.count(y) < 2, F.lit(None).cast("double"))
        .when(total != 0, 1 - resid / total)
        .when(resid == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def mape_eps(y: Column, p: Column) -> Column:
    size = F.abs(y)
    return F.avg(abs_error(y, p) / F.when(size > DOUBLE_EPS, size).otherwise(F.lit(DOUBLE_EPS))) * 100


def mape_plain(y: Column, p: Column) -> Column:
    """Rows with a zero target are skipped."""
    return F.avg(F.abs(F.try_divide(y - p, y))) * 100


def mape_clipped(y: Column, p: Column) -> Column:
    return F.avg(F.abs((y - p) / clip(y, lo=DENOMINATOR_FLOOR))) * 100


def mape_zero_as_one(y: Column, p: Column) -> Column:
    return F.avg(F.abs((y - p) / F.when(y == 0, F.lit(1.0)).otherwise(y))) * 100


def relative_accuracy(y: Column, p: Column) -> Column:
    """1 - MAE / mean target within [0, 1]; 0 for a zero mean."""
    mean = F.avg(y)
    return F.when(mean == 0, F.lit(0.0)).otherwise(
        clip(1 - ratio_or(F.avg(abs_error(y, p)), mean), 0.0, 1.0)
    )


def share_equal(a: Column, b: Column) -> Column:
    return F.avg((a == b).cast("double"))


def threshold_accuracy(y: Column, p: Column, threshold: float) -> Column:
    """Share of rows that target and prediction put on the same side."""
    return share_equal(y <= threshold, p <= threshold)


def regression_columns(y: Column, p: Column) -> list[Column]:
    mse = F.avg(sq_error(y, p))
    return [
        F.count("*").alias("n"),
        F.avg(abs_error(y, p)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        r2(y, p).alias("r2"),
    ]


def mape_columns(y: Column, p: Column) -> list[Column]:
    return [
        mape_eps(y, p).alias("mape_eps"),
        mape_plain(y, p).alias("mape_plain"),
        mape_clipped(y, p).alias("mape_clipped"),
        mape_zero_as_one(y, p).alias("mape_zero_as_one"),
    ]


def _yp(y: str, p: str) -> tuple[Column, Column]:
    return F.col(y).cast("double"), F.col(p).cast("double")


def regression_metrics(preds: DataFrame, keys: list[str], y: str = "y", p: str = "pred") -> DataFrame:
    return preds.groupBy(*keys).agg(*regression_columns(*_yp(y, p)))


def mape_metrics(preds: DataFrame, keys: list[str], y: str = "y", p: str = "pred") -> DataFrame:
    return preds.groupBy(*keys).agg(*mape_columns(*_yp(y, p)))


# How a result table states "MAPE" and "Accuracy"; the five data sets differ in both.
MAPE_KINDS = {
    "eps": mape_eps,
    "plain": mape_plain,
    "clipped": mape_clipped,
    "zero_as_one": mape_zero_as_one,
}


def table_columns(
    y: Column, p: Column, mape: str = "eps", accuracy: str = "relative", threshold: float | None = None
) -> list[Column]:
    """Aggregates MAE, MSE, RMSE, R2, MAPE and Accuracy of a result table.

    ``accuracy`` is ``relative``, ``threshold`` (needs ``threshold``), ``r2`` or ``class``.
    """
    kinds = {
        "relative": lambda: relative_accuracy(y, p),
        "threshold": lambda: threshold_accuracy(y, p, threshold),
        "r2": lambda: r2(y, p),
        "class": lambda: share_equal(y, p),
    }
    mse = F.avg(sq_error(y, p))
    return [
        F.avg(abs_error(y, p)).alias("MAE"),
        mse.alias("MSE"),
        F.sqrt(mse).alias("RMSE"),
        r2(y, p).alias("R2"),
        MAPE_KINDS[mape](y, p).alias("MAPE"),
        kinds[accuracy]().alias("Accuracy"),
    ]


def metrics_table(preds: DataFrame, keys: list[str], y: str = "y", p: str = "pred", **options) -> DataFrame:
    """One row per model."""
    return preds.groupBy(*keys).agg(*table_columns(*_yp(y, p), **options))


def classification_metrics(preds: DataFrame, keys: list[str], y: str = "y", p: str = "pred") -> DataFrame:
    """Accuracy and support-weighted F1 per model.

    The first aggregate leaves one row per (model, class, predicted class); what
    follows works on those counts only.
    """
    pairs = preds.groupBy(*keys, F.col(y).alias("t"), F.col(p).alias("q")).agg(F.count("*").alias("n"))
    # Each pair counts once for its true class and once for its predicted class.
    sides = pairs.select(
        *keys,
        F.explode(
            F.array(
                F.struct(
                    F.col("t").alias("cls"),
                    F.when(F.col("t") == F.col("q"), F.col("n")).otherwise(0).alias("tp"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("given"),
                ),
                F.struct(
                    F.col("q").alias("cls"),
                    F.lit(0).cast("bigint").alias("tp"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("given"),
                ),
            )
        ).alias("s"),
    ).select(*keys, "s.*")
    classes = sides.groupBy(*keys, "cls").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("given").alias("given")
    )
    # F1 = 2 tp / (support + given); the denominator is positive for every class seen.
    f1 = 2.0 * F.col("tp") / (F.col("support") + F.col("given"))
    return classes.groupBy(*keys).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"),
    )


def metrics_long(table: DataFrame, keys: list[str], names: list[str], percent: tuple[str, ...] = ("Accuracy",)) -> DataFrame:
    """Long form for comparison charts; shares are stated in percent."""
    scaled = table.withColumns({c: F.col(c) * 100 for c in percent if c in names})
    return scaled.unpivot(keys, names, "metric", "value")


def actual_vs_predicted(wide: DataFrame, row: str, series: dict[str, str]) -> DataFrame:
    """Long series ``row, series, value`` from a target and prediction columns.

    ``series`` maps the shown name to its column.
    """
    named = wide.select(row, *[F.col(c).cast("double").alias(s) for s, c in series.items()])
    return named.unpivot([row], list(series), "series", "value")
