"""Sampled Shapley values of linear class probabilities at any width.

An explained row and a background row differ in few features of many (the terms of both
texts). A feature order walks from the background row to the explained one over these
features alone, and each step changes the margins of the classes by one product:
margins along an order are one running sum, no vector is built or scored. Orders come in pairs,
forwards and backwards, and all are used against every background row, as in ``shapley_sampled``.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame

from tabscore.operators.tree_shapley import explain_rows


def probabilities(margins: np.ndarray) -> np.ndarray:
    """Classes x steps: softmax of the margins; one margin is that of the second of two classes."""
    if len(margins) == 1:
        p = 1 / (1 + np.exp(-np.clip(margins[0], -700, 700)))
        return np.stack([1 - p, p])
    e = np.exp(margins - margins.max(axis=0))
    return e / e.sum(axis=0)


def values(x: np.ndarray, key: object, background: list[np.ndarray], weights: np.ndarray, offsets: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    """Classes x features for one row."""
    classes = 2 if len(weights) == 1 else len(weights)
    phi = np.zeros((classes, len(x)))
    for draw in range(pairs):
        rank = np.random.default_rng([seed, zlib.crc32(repr(key).encode()), draw]).permutation(len(x))
        for b in background:
            apart = np.flatnonzero(x != b)
            if not apart.size:
                continue
            order = apart[np.argsort(rank[apart])]
            start = (weights @ b + offsets)[:, None]
            for way in (order, order[::-1]):
                steps = np.cumsum(weights[:, way] * (x[way] - b[way]), axis=1)
                phi[:, way] += np.diff(probabilities(np.hstack([start, start + steps])), axis=1)
    return phi / (2 * pairs * max(len(background), 1))


def shapley_logistic(
    df: DataFrame, key: str, features: list[str], model: LogisticRegressionModel, background: list[np.ndarray], pairs: int = 10, seed: int = 42, vector: str = "features"
) -> DataFrame:
    """Estimated values of the class probabilities: ``key, cls, feature, phi``.

    Every feature of every row has a value (zero where it never differs); they sum to p(x)
    minus the mean p(b), whatever the number of pairs.
    """
    weights, offsets = model.coefficientMatrix.toArray(), np.asarray(model.interceptVector.toArray())
    return explain_rows(df, key, vector, features, lambda x, k: values(x, k, background, weights, offsets, pairs, seed))
