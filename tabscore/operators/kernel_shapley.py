"""Kernel Shapley values: a weighted least-squares fit over coalitions, for any model.

v(S) is the mean prediction over the background with the features in S taken from the
explained row. Coalitions are all of them, if they are no more than asked for, with their
kernel weights (m - 1) / (C(m, s) s (m - s)); else pairs of a coalition and its complement,
drawn with sizes by that weight. The values are the coefficients of the linear model of v that
has v(none) as constant and meets v(all). A row's normal equations are added up and solved in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.operators.shapley import _background_scores, _place, point
from tabscore.session import reach

COALITIONS = 2_048
# Coalitions up to which a formula's scores are columns of one row.
FEW_COALITIONS = 64


def kernel_weights(m: int) -> np.ndarray:
    """By size 1..m-1: the weight of all coalitions of that size together."""
    s = np.arange(1, m)
    return (m - 1) / (s * (m - s))


def coalitions(m: int, most: int = COALITIONS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions x features (0/1), neither empty nor full, and their weights; the same for every row."""
    if m < 2:
        return np.zeros((0, m), np.int8), np.zeros(0)
    if 2**m - 2 <= most:
        z = (np.arange(1, 2**m - 1)[:, None] >> np.arange(m) & 1).astype(np.int8)
        size = z.sum(axis=1)
        return z, kernel_weights(m)[size - 1] / np.array([comb(m, int(s)) for s in size])
    rng, share = np.random.default_rng([seed, m]), kernel_weights(m)
    sizes = rng.choice(np.arange(1, m), most // 2, p=share / share.sum())
    drawn = np.zeros((most // 2, m), np.int8)
    for row, s in zip(drawn, sizes):
        row[rng.choice(m, s, replace=False)] = 1
    z, times = np.unique(np.vstack([drawn, 1 - drawn]), axis=0, return_counts=True)
    return z, times.astype(float)


def solver(z: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Features x (empty, full, coalitions): the values of ``solve`` are this matrix times the scores, for every row."""
    m = z.shape[1]
    unit = np.eye(2 + len(z))
    return np.stack([solve(z, weight, one[2:], one[0], one[1]) for one in unit], axis=1).reshape(m, -1)


def solve(z: np.ndarray, weight: np.ndarray, v: np.ndarray, empty: float, full: float) -> np.ndarray:
    """The values that minimise the weighted squares and sum to ``full - empty``."""
    m = z.shape[1]
    if m == 1:
        return np.array([full - empty])
    last = z[:, -1:].astype(float)
    design = z[:, :-1] - last
    target = v - empty - last[:, 0] * (full - empty)
    normal = design.T @ (design * weight[:, None])
    phi = np.linalg.lstsq(normal, design.T @ (target * weight), rcond=None)[0]
    return np.append(phi, full - empty - phi.sum())


def shapley_kernel(
    df: DataFrame, key: str, features: list[str], score: Callable[[DataFrame], DataFrame] | None, bg: Column,
    most: int = COALITIONS, seed: int = 42, vector: str = "features", x: Column | None = None,
    formula: Callable[[list[Column]], Column] | None = None,
) -> DataFrame:
    """Values of any scored model: ``key, cls, feature, phi``.

    A model that is a column ``formula`` of the features needs no ``score``: where coalitions are few, they are
    columns of one row and only the background multiplies rows.

    Each row is scored once per coalition and background row and once as it is; scores are averaged
    over the background where they were made, so a row brings its v(S) to one task, in number bounded by ``most``.
    The coalitions are the same for every row, so the fit is solved once and applied to batches of rows.
    """
    m = len(features)
    reach(df.sparkSession)
    z, weight = coalitions(m, most, seed)
    fit = solver(z, weight)
    if formula is not None and len(z) <= FEW_COALITIONS:
        return _of_formula(df, key, features, formula, bg, z, fit, point(features) if x is None else x)
    if formula is not None:
        score = lambda d: d.withColumn("out", F.array(formula([F.get(vector_to_array(vector), F.lit(j)) for j in range(m)])))
    # Members of each coalition, as flags; row 0 stands for the full one.
    members = F.array(F.array(*[F.lit(True)] * m), *[F.lit([bool(c) for c in row]) for row in z]) if len(z) <= 64 else None
    placed = _place(df, key, point(features) if x is None else x)
    numbered = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(z)))).alias("s"))
    if members is not None:
        flagged = numbered.withColumn("in", F.get(members, F.col("s")))
    else:
        table = df.sparkSession.createDataFrame(pd.DataFrame({"s": np.arange(len(z) + 1), "in": [[True] * m, *z.astype(bool).tolist()]}), "s int, in array<boolean>")
        flagged = numbered.join(F.broadcast(table), "s")
    # The full coalition does not depend on the background: its first row stands for all.
    mixed = flagged.select("__row", "__key", "x", "s", "in", F.posexplode(bg).alias("i", "b")).filter("s > 0 or i = 0")
    mix = F.transform(F.arrays_zip("x", "b", "in"), lambda e: F.when(e["in"], e["x"]).otherwise(e["b"]))
    scored = score(mixed.select("__row", "__key", "s", array_to_vector(mix).alias(vector)))
    one = scored.select("__row", "__key", "s", F.posexplode_outer("out").alias("cls", "v"))
    means = one.groupBy("__row", "__key", "cls", "s").agg(F.avg("v").alias("v"))
    lists = means.groupBy("__row", "__key", "cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "v"))), lambda e: e["v"]).alias("v"))
    lists = lists.withColumn("empty", _background_scores(df, bg, score, vector)[F.col("cls")])

    @F.pandas_udf("array<double>")
    def fitted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, empty in batches:
            scores = np.stack(v.to_numpy()) if len(v) else np.zeros((0, len(z) + 1))
            told = np.hstack([empty.to_numpy(float)[:, None], scores])
            yield pd.Series(list(told @ fit.T))

    phis = lists.select(F.col("__key").alias(key), "cls", F.posexplode(fitted("v", "empty")).alias("j", "phi"))
    return phis.select(key, "cls", F.get(F.lit(features), F.col("j")).alias("feature"), "phi")


def _of_formula(df: DataFrame, key: str, features: list[str], formula: Callable[[list[Column]], Column], bg: Column, z: np.ndarray, fit: np.ndarray, x: Column) -> DataFrame:
    """The same values with all coalitions as columns: a row's mean scores come from one pass over the background."""
    m = len(features)
    sets = [np.zeros(m, bool), np.ones(m, bool), *z.astype(bool)]
    paired = _place(df, key, x).select("__row", "__key", "x", F.explode(bg).alias("b"))
    # A mean over the background counts every row of it: a score that is missing is no score of zero weight.
    missing = F.raise_error(F.lit("a score is missing: the formula needs every feature"))
    scored = paired.select("__row", "__key", *[F.coalesce(formula([F.col("x" if one[j] else "b")[j] for j in range(m)]).cast("double"), missing).alias(f"v{i}") for i, one in enumerate(sets)])
    means = scored.groupBy("__row", "__key").agg(*[F.avg(f"v{i}").alias(f"v{i}") for i in range(len(sets))])

    def value(j: int) -> Column:
        out = F.lit(0.0)
        for i, c in enumerate(fit[j]):
            out = out + float(c) * F.col(f"v{i}")
        return out

    phis = means.select(F.col("__key").alias(key), F.lit(0).alias("cls"), *[value(j).alias(f) for j, f in enumerate(features)])
    return phis.unpivot([key, "cls"], features, "feature", "phi")
