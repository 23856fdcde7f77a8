"""Train/test splits, samples and control groups that depend on the row key alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.scalars import hash32
from tabscore.operators.ranks import hash_prefix_cut


def in_train(key: str, seed: int = 42, train_tenths: int = 8) -> Column:
    """True for about ``train_tenths`` tenths of the keys; a map-only predicate."""
    return hash32(F.col(key), seed) % 10 < train_tenths


def hash_split(df: DataFrame, key: str, seed: int = 42, train_tenths: int = 8) -> DataFrame:
    """Add ``is_train``. The same rows whatever the features, labels or partitions."""
    return df.withColumn("is_train", in_train(key, seed, train_tenths))


def exact_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_train``, with exactly ``ceil(test_share * n)`` test rows."""
    # The small term keeps a product such as 0.1 * 30 = 3.0000000000000004 from rounding up.
    test = hash_prefix_cut(df, key, lambda n: math.ceil(n * test_share - 1e-9), seed)
    return df.withColumn("is_train", ~test)


def temporal_split(df: DataFrame, year: str, first_test_year: int) -> tuple[DataFrame, DataFrame]:
    """Rows before the year, and rows from it on. Both filters reach the scan."""
    return df.where(F.col(year) < first_test_year), df.where(F.col(year) >= first_test_year)


def assign_group(key: str, a: str, b: str, salt: int | str = "group") -> Column:
    """Seeded even assignment to two groups, independent of the split: a control."""
    return F.when(hash32(F.col(key), salt) % 2 == 0, F.lit(a)).otherwise(F.lit(b))


def bounded_sample(df: DataFrame, key: str, n: int, seed: int | str = 42) -> DataFrame:
    """``n`` rows first by (hash of key, key). Each task keeps only its own best ``n``."""
    h = hash32(F.col(key), seed)
    return df.orderBy(h, F.col(key)).limit(n)
