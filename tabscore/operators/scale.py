"""Scaling. The statistics are one row, read through a scalar subquery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardize(
    df: DataFrame, cols: list[str], fit_on: DataFrame | None = None, suffix: str = ""
) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes zero."""
    source = df if fit_on is None else fit_on
    stats = source.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in cols],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in cols],
        )
    ).scalar()

    def z(c: str) -> Column:
        sd = stats[f"s_{c}"]
        return (F.col(c) - stats[f"m_{c}"]) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)

    return df.withColumns({f"{c}{suffix}": z(c) for c in cols})


class MinMax:
    """Min-max scaling of one column, fitted on given rows, with its inverse."""

    def __init__(self, fit_on: DataFrame, col: str):
        self._b = fit_on.agg(
            F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
        ).scalar()

    def _span(self) -> Column:
        span = self._b["hi"] - self._b["lo"]
        return F.when(span == 0, F.lit(1.0)).otherwise(span)

    def scale(self, c: Column) -> Column:
        """In [0, 1] on the fitted rows; other rows may leave it."""
        return (c - self._b["lo"]) / self._span()

    def restore(self, c: Column) -> Column:
        return c * self._span() + self._b["lo"]
