"""Error gaps between groups. Both groups are scored in the same pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.scalars import at_most, round_half_even
from tabscore.operators.metrics import sq_error


def gap_columns(
    group: str, a: object, b: object, score: Callable[[Column], Column], names: tuple[str, str], digits: int | None = None
) -> list[Column]:
    """Aggregates for two groups and their absolute gap; other groups are ignored.

    ``score`` maps a row mask to an aggregate. If either group has no row all
    three values are NULL.
    """
    va, vb = score(F.col(group) == F.lit(a)), score(F.col(group) == F.lit(b))
    both = va.isNotNull() & vb.isNotNull()

    def shown(c: Column) -> Column:
        return F.when(both, c if digits is None else round_half_even(c, digits))

    return [shown(va).alias(names[0]), shown(vb).alias(names[1]), shown(F.abs(va - vb)).alias("disparity")]


def rmse_gap(
    group: str, a: object, b: object, names: tuple[str, str] = ("a_rmse", "b_rmse"), digits: int | None = None,
    y: Column | None = None, p: Column | None = None,
) -> list[Column]:
    y = F.col("y") if y is None else y
    p = F.col("pred") if p is None else p
    err = sq_error(y.cast("double"), p.cast("double"))
    return gap_columns(group, a, b, lambda m: F.sqrt(F.avg(F.when(m, err))), names, digits)


def accuracy_gap(
    group: str, a: object, b: object, names: tuple[str, str] = ("a_accuracy", "b_accuracy")
) -> list[Column]:
    hit = (F.col("y") == F.col("pred")).cast("double")
    return gap_columns(group, a, b, lambda m: F.avg(F.when(m, hit)), names)


def group_rmse(preds: DataFrame, keys: list[str], group: str, a: object, b: object, **options) -> DataFrame:
    """RMSE of two groups per model, and the gap."""
    return preds.groupBy(*keys).agg(*rmse_gap(group, a, b, **options))


def threshold_rmse(
    preds: DataFrame, keys: list[str], group: str, a: object, b: object, threshold: float, **options
) -> DataFrame:
    """The same on 0/1 outcomes: is the value at most the threshold?"""
    sides = {"y": at_most(F.col("y"), threshold), "p": at_most(F.col("pred"), threshold)}
    return group_rmse(preds, keys, group, a, b, **sides, **options)


def group_accuracy(preds: DataFrame, keys: list[str], group: str, a: object, b: object, **options) -> DataFrame:
    """Share of right classes of two groups per model, and the gap."""
    return preds.groupBy(*keys).agg(*accuracy_gap(group, a, b, **options))


def rmse_spread(preds: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Any number of groups: smallest and largest RMSE and their difference."""
    err = sq_error(F.col("y").cast("double"), F.col("pred").cast("double"))
    per_group = preds.groupBy(*keys, group).agg(F.sqrt(F.avg(err)).alias("rmse"))
    return per_group.groupBy(*keys).agg(
        F.count("*").alias("groups"),
        F.min("rmse").alias("min_rmse"),
        F.max("rmse").alias("max_rmse"),
        (F.max("rmse") - F.min("rmse")).alias("disparity"),
    )


def attach_group(preds: DataFrame, attrs: DataFrame, key: str) -> DataFrame:
    """Group attribute by row key. Spark picks broadcast or sort-merge by real size."""
    return preds.join(attrs, key, "left")
