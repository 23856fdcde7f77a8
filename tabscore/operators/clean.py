"""Column selection, missing values and simple encodings."""

from __future__ import annotations

import re

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscore.functions.scalars import as_text, to_number
from tabscore.operators.ranks import exact_medians, number_in_order, number_within
from tabscore.session import fetch_small, join_lookup, local_table, materialize


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]


def year_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.fullmatch(r"\d+", c)]


def existing(df: DataFrame, wanted: list[str]) -> list[str]:
    """Those of the wanted columns that the table has, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.na.drop(subset=subset)


def coerce(df: DataFrame, cols: list[str]) -> DataFrame:
    # A number that a double holds as its text states it needs no text.
    plain = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.IntegralType))}
    return df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) if c in plain else to_number(F.col(c)) for c in cols})


def label_codes(df: DataFrame, col: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Distinct texts of a column with codes 0..k-1 in code-point order.

    A missing value is the text ``nan``. ``fit_on`` limits the fit, e.g. to train rows.
    """
    source = df if fit_on is None else fit_on
    values = source.select(as_text(F.col(col)).alias("value")).distinct()
    return number_in_order(values, "value", "code")


def label_encode(df: DataFrame, col: str, out: str | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Replace a text column by its code; a value not seen in the fit gives NULL."""
    out = out or col
    codes = label_codes(df, col) if codes is None else codes
    key = f"__{col}_text"
    coded = join_lookup(
        df.withColumn(key, as_text(F.col(col))),
        codes.select(F.col("value").alias(key), F.col("code").alias(f"__{col}_code")),
        key,
    )
    return coded.withColumn(out, F.col(f"__{col}_code")).drop(key, f"__{col}_code")


def dictionary(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Codes of several text columns at once: ``column, value, code``, each column's from 0 in code-point order.

    One shuffle holds the distinct values of all columns; a missing value is the text ``nan``.
    """
    source = df if fit_on is None else fit_on
    cells = F.array(*[F.struct(F.lit(c).alias("column"), as_text(F.col(f"`{c}`")).alias("value")) for c in cols])
    return number_within(source.select(F.inline(cells)).distinct(), "column", "value")


def label_encode_all(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Replace text columns by their codes; a value not seen in the fit gives NULL.

    A small dictionary is fetched once and sent along for every column, so one pass over the
    rows applies all codes; a larger one is joined column by column.
    """
    if not cols:
        return df
    codes = dictionary(df, cols, fit_on) if codes is None else codes
    small = fetch_small(codes)
    if small is None:
        codes = materialize(codes, "dictionary")
    for i, c in enumerate(cols):
        key, code = f"__text_{i}", f"__code_{i}"
        if small is None:
            own = codes.where(F.col("column") == c).select(F.col("value").alias(key), F.col("code").alias(code))
        else:
            own = local_table(df.sparkSession, small.filter(pc.equal(small["column"], c)).select(["value", "code"]).rename_columns([key, code]))
            own = F.broadcast(own)
        df = df.withColumn(key, as_text(F.col(f"`{c}`"))).join(own, key, "left").withColumn(c, F.col(code)).drop(key, code)
    return df


def mean_impute(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fill each column with its mean. A column without any value is dropped.

    The means are one row, read through a scalar subquery: no join, no shuffle.
    """
    source = df if fit_on is None else fit_on
    counts = source.agg(*[F.count(c).alias(c) for c in cols]).first()
    empty = [c for c in cols if counts[c] == 0]
    keep = [c for c in cols if c not in empty]
    if not keep:
        return df.drop(*empty)
    means = source.agg(F.struct(*[F.avg(c).alias(c) for c in keep])).scalar()
    return df.drop(*empty).withColumns({c: F.coalesce(F.col(c).cast("double"), means[c]) for c in keep})


def median_impute(df: DataFrame, cols: list[str], fit_on: DataFrame) -> DataFrame:
    """Fill each column with the exact median of the fitted rows; an empty one is dropped."""
    medians = exact_medians(fit_on, cols)
    empty = [c for c, m in medians.items() if m is None]
    fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items() if m is not None}
    return df.drop(*empty).withColumns(fills)


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.na.fill(values)
