"""Shapley values of predictions against a bounded background sample.

v(S) is the mean prediction over the background with the features in S taken
from the explained row. Any number of rows may be explained: the rows are placed
by key once, while they are still small; each is then paired with the background,
scored and summed up inside its own task.
"""

from __future__ import annotations

from collections.abc import Callable
from math import factorial

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.operators.split import bounded_sample

MAX_BACKGROUND = 1000
MAX_EXACT_FEATURES = 10


def point(features: list[str]) -> Column:
    """The feature columns of a row as one array."""
    return F.array(*[F.col(f).cast("double") for f in features])


def background(
    df: DataFrame, features: list[str], key: str, n: int = 100, seed: int | str = 42, x: Column | None = None
) -> Column:
    """Array of ``n`` sampled feature rows, as a scalar subquery.

    ``x`` gives a row's features as an array where they are not single columns.
    """
    if n > MAX_BACKGROUND:
        raise ValueError(f"a background holds at most {MAX_BACKGROUND} rows")
    x = point(features) if x is None else x
    picked = bounded_sample(df.select(key, x.alias("x")), key, n, seed)
    return picked.agg(F.collect_list("x")).scalar()


def _place(df: DataFrame, key: str, x: Column) -> DataFrame:
    """Explained rows as ``__row, __key, x``, spread by row before they multiply.

    The rows are small now and many later. With the number of partitions stated,
    Spark does not merge them again by their present size, and the sums per row
    need no further shuffle. A repeated key is several rows, each explained on its own
    and none of them in one task with all others.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), x.alias("x")).repartition(n, "__row")


def coalition_weights(m: int) -> list[float]:
    """Weight of a coalition with s other members: s! (m-s-1)! / m!"""
    return [factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]


def _check(features: list[str]) -> int:
    if len(features) > MAX_EXACT_FEATURES:
        raise ValueError(f"exact values need at most {MAX_EXACT_FEATURES} features; use shapley_sampled")
    return len(features)


def shapley_exact(
    df: DataFrame, key: str, features: list[str], formula: Callable[[list[Column]], Column], bg: Column
) -> DataFrame:
    """Exact values for a model given as a column formula: ``key, feature, phi``.

    All coalitions are columns of one row, so only the background multiplies rows.
    """
    m = _check(features)
    w = coalition_weights(m)
    paired = _place(df, key, point(features)).select("__row", "__key", "x", F.explode(bg).alias("b"))
    values = {
        s: formula([F.col("x" if s >> j & 1 else "b")[j] for j in range(m)])
        for s in range(1 << m)
    }
    scored = paired.select("__row", "__key", *[v.alias(f"v{s}") for s, v in values.items()])

    def gain(j: int) -> Column:
        out = F.lit(0.0)
        for s in range(1 << m):
            if not s >> j & 1:
                out = out + w[s.bit_count()] * (F.col(f"v{s | 1 << j}") - F.col(f"v{s}"))
        return out

    phis = scored.groupBy("__row", "__key").agg(*[F.avg(gain(j)).alias(f) for j, f in enumerate(features)])
    return phis.select(F.col("__key").alias(key), *features).unpivot([key], features, "feature", "phi")


def shapley_linear(
    df: DataFrame, key: str, features: list[str], weights: dict[str, Column | float], fit_on: DataFrame
) -> DataFrame:
    """Values of a linear model: weight * (x - mean). Map-only."""
    means = fit_on.agg(F.struct(*[F.avg(f).alias(f) for f in features])).scalar()
    phis = df.select(
        key, *[((F.col(f) - means[f]) * weights[f]).alias(f) for f in features]
    )
    return phis.unpivot([key], features, "feature", "phi")


def prediction_output(model: Model) -> Callable[[DataFrame], DataFrame]:
    """Score function for the helpers below: appends ``out``, an array with one entry.

    They unpack it with an outer explode: a plain one makes Spark test the array
    first, and so predict every row twice.
    """

    def score(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("out", F.array(F.col("prediction")))

    return score


def probability_output(model: Model) -> Callable[[DataFrame], DataFrame]:
    """One entry per class: its probability, or its raw score where a model states no more."""

    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(df)
        column = "probability" if "probability" in scored.columns else "rawPrediction"
        return scored.withColumn("out", vector_to_array(column))

    return score


def shapley_model(
    df: DataFrame,
    key: str,
    features: list[str],
    score: Callable[[DataFrame], DataFrame],
    bg: Column,
    vector: str = "features",
) -> DataFrame:
    """Exact values for a fitted model: ``key, cls, feature, phi`` (``cls`` counts outputs).

    Each row is scored once per background row and mixed coalition, and once as
    it is; the scores of the background alone are the same for every row and are
    worked out once. A row is summed up where it was expanded.
    """
    m = _check(features)
    w = F.array(*[F.lit(c) for c in coalition_weights(m)])
    full = (1 << m) - 1
    # The full coalition does not depend on the background: the first row stands for all.
    masks = F.when(F.col("i") == 0, F.sequence(F.lit(1), F.lit(full))).otherwise(
        F.filter(F.sequence(F.lit(0), F.lit(full - 1)), lambda s: s > 0)
    )
    mixed = (
        _place(df, key, point(features))
        .select("__row", "__key", "x", F.posexplode(bg).alias("i", "b"))
        .select("__row", "__key", "x", "b", F.explode(masks).alias("mask"))
    )
    bit = [F.col("mask").bitwiseAND(F.lit(1 << j)) != 0 for j in range(m)]
    mix = F.array(*[F.when(bit[j], F.col("x")[j]).otherwise(F.col("b")[j]) for j in range(m)])
    scored = score(mixed.select("__row", "__key", "mask", array_to_vector(mix).alias(vector)))
    share = F.when(F.col("mask") == full, F.col("v")).otherwise(F.col("v") / F.size(bg)).alias("share")
    one = scored.select(
        "__row", "__key", "mask", F.bit_count("mask").alias("s"), F.posexplode_outer("out").alias("cls", "v")
    ).select("__row", "__key", "mask", "s", "cls", share)
    gains = [
        F.sum(F.when(bit[j], w[F.col("s") - 1]).otherwise(-F.get(w, F.col("s"))) * F.col("share")).alias(f"p{j}")
        for j in range(m)
    ]
    sums = one.groupBy("__row", "__key", "cls").agg(*gains)
    base = _background_scores(df, bg, score, vector)[F.col("cls")] * coalition_weights(m)[0]
    phis = sums.select(F.col("__key").alias(key), "cls", *[(F.col(f"p{j}") - base).alias(f) for j, f in enumerate(features)])
    return phis.unpivot([key, "cls"], features, "feature", "phi")


def _background_scores(df: DataFrame, bg: Column, score: Callable[[DataFrame], DataFrame], vector: str) -> Column:
    """Mean score of the background rows, one entry per output, as a scalar subquery."""
    rows = df.sparkSession.range(1).select(F.explode(bg).alias("b")).select(array_to_vector("b").alias(vector))
    means = score(rows).select(F.posexplode_outer("out").alias("cls", "v")).groupBy("cls").agg(F.avg("v").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("cls", "v")))
    return means.agg(F.transform(ordered, lambda e: e["v"])).scalar()


def shapley_sampled(
    df: DataFrame,
    key: str,
    features: list[str],
    score: Callable[[DataFrame], DataFrame],
    bg: Column,
    pairs: int = 10,
    seed: int = 42,
    vector: str = "features",
    x: Column | None = None,
) -> DataFrame:
    """Estimated values for many features: ``key, cls, feature, phi``.

    Each explained row draws ``pairs`` feature orders by hash and uses each forwards
    and backwards (Strumbelj and Kononenko, 2014), every time against all background
    rows, as v(S) is a mean over them. Features in which row and background row agree
    are left out of an order: switching them changes nothing. The estimate sums to f(x)
    minus the mean f(b), and every feature of every row has a value.
    """
    m = len(features)
    # One pair holds all orders of two features.
    pairs = min(pairs, 1) if m <= 2 else pairs
    hashes = F.array(
        *[F.struct(F.xxhash64(F.lit(seed), "__key", "draw", F.lit(j)), F.lit(j + 1).alias("j")) for j in range(m)]
    )
    order = F.transform(F.array_sort(hashes), lambda e: e["j"])
    ordered = (
        _place(df, key, point(features) if x is None else x)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("draw"))
        .select("*", order.alias("fwd"))
        .select("__row", "__key", "x", "draw", F.posexplode(F.array("fwd", F.reverse("fwd"))).alias("way", "order"))
    )
    apart = F.filter("order", lambda j: F.get("x", j - 1) != F.get("b", j - 1))
    drawn = (
        ordered.select("*", F.posexplode(bg).alias("i", "b"))
        .select("__row", "__key", "x", "b", ((F.col("draw") == 0) & (F.col("way") == 0) & (F.col("i") == 0)).alias("first"), apart.alias("order"))
        .withColumn("rank", F.transform(F.sequence(F.lit(1), F.lit(m)), lambda j: F.array_position("order", j)))
        .select("*", F.explode(F.sequence(F.lit(0), F.size("order"))).alias("step"))
    )
    mix = F.transform(
        F.arrays_zip("x", "b", "rank"),
        lambda e: F.when(e["rank"] <= F.col("step"), e["x"]).otherwise(e["b"]),
    )
    scored = score(drawn.select("__row", "__key", "first", "order", "step", array_to_vector(mix).alias(vector)))
    # A step adds its score to the feature just switched on and takes it from the next one.
    moves = F.array(
        F.struct(F.get("order", F.col("step") - 1).alias("j"), F.lit(1.0).alias("sign")),
        F.struct(F.get("order", F.col("step")).alias("j"), F.lit(-1.0).alias("sign")),
    )
    # Once a row, every feature gets a zero: one that never differs has the value zero.
    zeros = F.transform(F.sequence(F.lit(1), F.lit(m)), lambda j: F.struct(j.alias("j"), F.lit(0.0).alias("sign")))
    kind = "array<struct<j:int,sign:double>>"
    all_moves = F.when(F.col("first") & (F.col("step") == 0), F.concat(moves.cast(kind), zeros.cast(kind))).otherwise(moves.cast(kind))
    one = (
        scored.select("__row", "__key", all_moves.alias("moves"), F.posexplode_outer("out").alias("cls", "v"))
        .select("__row", "__key", "cls", "v", F.inline("moves"))
        .where("j is not null")
    )
    names = F.array(*[F.lit(f) for f in features])
    share = 2.0 * pairs * F.size(bg)
    return (
        one.groupBy("__row", "__key", "cls", "j").agg((F.sum(F.col("v") * F.col("sign")) / share).alias("phi"))
        .select(F.col("__key").alias(key), "cls", F.get(names, F.col("j") - 1).alias("feature"), "phi")
    )


def reduce_classes(phi: DataFrame, policy: str, cls: int = 1) -> DataFrame:
    """Outputs to one value per row and feature.

    ``class`` keeps one output, ``mean_abs`` averages |phi| over the outputs.
    """
    keys = [c for c in phi.columns if c not in ("cls", "phi")]
    if policy == "class":
        return phi.where(F.col("cls") == cls).select(*keys, "phi")
    if policy == "mean_abs":
        return phi.groupBy(*keys).agg(F.avg(F.abs("phi")).alias("phi"))
    raise ValueError(f"unknown policy {policy}")
