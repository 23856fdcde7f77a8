"""Long, wide and stacked tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that a pivot may make.
MAX_COLUMNS = 10_000

SCORE_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def scores_from_dict(spark: SparkSession, nested: dict[str, dict[str, dict[str, float | None]]]) -> DataFrame:
    """Long score table from dataset -> model -> metric -> value."""
    rows = [
        (dataset, model, metric, None if v is None else float(v))
        for dataset, models in nested.items()
        for model, scores in models.items()
        for metric, v in scores.items()
    ]
    return spark.createDataFrame(rows, SCORE_SCHEMA)


def melt(df: DataFrame, ids: list[str], values: list[str], var: str, val: str) -> DataFrame:
    """Wide to long; missing cells are kept."""
    return df.unpivot(ids, values, var, val)


def column_values(df: DataFrame, col: str, most: int = MAX_COLUMNS) -> list:
    """Sorted distinct values of a column that become columns of a wide table; too many are an error, none is left out."""
    found = df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values: too many for columns")
    return sorted(r[0] for r in found)


def to_matrix(long: DataFrame, row: str | list[str], col: str, val: str, names: list[str]) -> DataFrame:
    """Long to wide with a known list of columns, so Spark need not look for them."""
    keys = [row] if isinstance(row, str) else row
    return long.groupBy(*keys).pivot(col, names).agg(F.first(val, ignorenulls=True))


def stack(tables: list[DataFrame]) -> DataFrame:
    """Append tables by column name; a column one of them lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def stack_tagged(tables: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    return stack([df.withColumn(tag, F.lit(name)) for name, df in tables.items()])
