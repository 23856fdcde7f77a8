"""Catalogue of named tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy access to the Parquet tables of one folder: ``t.orders``, ``t["orders"]``.

    A scan is left as it is, so that filters reach it. Profiles and benchmarks turn NaN
    into NULL, the one missing marker; ``catalogue`` does so for all tables.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self[name]

    def catalogue(self) -> dict[str, DataFrame]:
        return {n: nan_to_null(self[n]) for n in TABLE_NAMES}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, so that one missing marker is left."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(*[_quiet(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def _quiet(name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c).alias(name)
