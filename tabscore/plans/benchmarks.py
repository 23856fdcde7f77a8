"""The ready-made benchmarks: clean, encode, split, fit, score, compare groups, explain.

Each takes a table as it was read and returns result tables. Statistics are
fitted on train rows unless ``fit_on="all"`` asks for the leaky published way.
Wide parameters default to the published ones; ``Effort`` makes a run smaller.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegressionModel, OneVsRestModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.scalars import above, at_most, choose, join_text
from tabscore.operators import (
    clean,
    fairness,
    importance,
    metrics,
    models,
    profile,
    readiness,
    reshape,
    scale,
    shapley,
    sparse_shapley,
    split,
    tfidf,
    tree_shapley,
)
from tabscore.operators.models import Member, Suite
from tabscore.operators.profile import BUDGET_COLUMNS, Declared
from tabscore.operators.ranks import exact_median
from tabscore.session import BROADCAST_ROWS, materialize
from tabscore.sources.csvio import write_csv, write_json
from tabscore.sources.tables import nan_to_null

MODEL = ["model"]
# Columns of the university ranking table and its split and threshold.
RANK_FEATURES = [
    "Teaching", "Research Environment", "Research Quality", "Industry Impact",
    "International Outlook", "Overall Score",
]
FIRST_TEST_YEAR = 2022
TOP_RANK = 200
# Labels that are fitted at the same time, each with its members.
PARALLEL_LABELS = 3


@dataclass(frozen=True)
class Effort:
    """Size of the fits and of the explanations."""

    trees: int = 200
    tree_depth: int = models.MAX_DEPTH
    rounds: int = 200
    depth: int = 4
    iterations: int = 100
    background: int = 100
    pairs: int = 10
    # "sampled" or "exact" Shapley values, "native" for what a model states itself, "none". Values of
    # trees come from their leaves, so "sampled" ones are exact there.
    explain: str = "sampled"
    # Rows explained for trees and for the linear model of the budget tables.
    tree_rows: int = 500
    linear_rows: int = 50


@dataclass
class Result:
    predictions: DataFrame
    metrics: DataFrame
    fairness: DataFrame
    readiness: DataFrame
    importance: DataFrame | None = None
    failures: dict[str, str] = field(default_factory=dict)
    extra: dict[str, DataFrame] = field(default_factory=dict)


def result_tables(r: Result) -> dict[str, DataFrame]:
    """All tables of a result by name; failures as rows."""
    spark = r.metrics.sparkSession
    out = {"metrics": r.metrics, "fairness": r.fairness, "readiness": r.readiness, **r.extra}
    if r.importance is not None:
        out["importance"] = r.importance
    out["failures"] = spark.createDataFrame(list(r.failures.items()), "model string, error string")
    return out


def long_result(r: Result) -> DataFrame:
    """Metrics, group gaps, readiness, importance and failures as ``part, label, model, name, value``."""

    def cells(part: str, df: DataFrame) -> DataFrame:
        keys = [c for c in ("label", "model") if c in df.columns]
        if part == "importance":
            long = df.select(*keys, F.col("feature").alias("name"), F.col("importance").cast("double").alias("value"))
        elif part == "failures":
            long = df.select(*keys, F.col("error").alias("name"), F.lit(None).cast("double").alias("value"))
        else:
            numbers = [c for c in clean.numeric_columns(df) if c not in keys]
            long = df.select(*keys, *[_double(c).alias(c) for c in numbers]).unpivot(keys, numbers, "name", "value")
        label = F.col("label") if "label" in keys else F.lit(None)
        return long.select(F.lit(part).alias("part"), label.cast("string").alias("label"), "model", "name", "value")

    tables = result_tables(r)
    return reshape.stack([cells(p, tables[p]) for p in ("metrics", "fairness", "readiness", "importance", "failures") if p in tables])


def write_result(r: Result, path: str) -> list[str]:
    """Write every table of a result as CSV and as JSON under ``path``; returns the folders."""
    folders = []
    for name, df in result_tables(r).items():
        for kind, write in (("csv", write_csv), ("json", write_json)):
            folders.append(f"{path.rstrip('/')}/{name}.{kind}")
            write(df, folders[-1])
    return folders


def with_key(df: DataFrame, key: str | None) -> tuple[DataFrame, str]:
    """The table with a row key. A made-up key is written with the rows, so it stays the same."""
    if key is not None:
        return df, key
    return materialize(df.withColumn("row_id", F.monotonically_increasing_id()), "keyed"), "row_id"


def _fit_rows(df: DataFrame, fit_on: str) -> DataFrame:
    return df if fit_on == "all" else df.where("is_train")


def two_vectors(df: DataFrame, features: list[str], fit_on: str) -> DataFrame:
    """Raw vector for trees, standardised vector for linear models; ``z_<i>`` holds the scaled values."""
    zs = [f"z_{i}" for i in range(len(features))]
    scaled = scale.standardize(df.withColumns(dict(zip(zs, map(_double, features)))), zs, fit_on=_z_source(df, features, zs, fit_on))
    raw = VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep")
    z = VectorAssembler(inputCols=zs, outputCol="scaled_features", handleInvalid="keep")
    return z.transform(raw.transform(scaled))


def _double(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def _z_source(df: DataFrame, features: list[str], zs: list[str], fit_on: str) -> DataFrame:
    return _fit_rows(df, fit_on).select(*[_double(f).alias(z) for f, z in zip(features, zs)])


def encode_and_impute(df: DataFrame, features: list[str], fit_on: str) -> tuple[DataFrame, list[str]]:
    """Codes for text columns, means for missing values; returns the features that are left."""
    texts = [f for f in clean.text_columns(df) if f in features]
    df = clean.label_encode_all(df, texts, fit_on=_fit_rows(df, fit_on))
    df = clean.mean_impute(df, features, fit_on=_fit_rows(df, fit_on))
    return df, [f for f in features if f in df.columns]


def feature_columns(df: DataFrame, other: tuple) -> list[str]:
    """Numeric and text columns that play no other part; columns of other types are no features."""
    usable = {*clean.numeric_columns(df), *clean.text_columns(df)}
    return [c for c in df.columns if c in usable and c not in other]


def class_values(df: DataFrame, col: str) -> list:
    """Sorted distinct class values; a linear model needs one row of weights for each."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"{col} has more than {BROADCAST_ROWS} classes")
    return sorted(r[0] for r in rows)


def class_code(c: Column, values: list) -> Column:
    return F.nullif(F.array_position(F.lit(values), c), F.lit(0)).cast("double") - 1


def class_decode(values: list):
    return lambda p: F.get(F.lit(values), p.cast("int"))


def explain_suite(
    suite: Suite, test: DataFrame, train: DataFrame, key: str, features: dict[str, list[str]], effort: Effort,
    output=shapley.prediction_output,
) -> DataFrame | None:
    """Mean |phi| per model and feature on the model's own features.

    Each explanation is written before the next one starts: a model whose explanation fails,
    while it is planned or while it runs, falls back to what it states itself. ``source``
    says how a value came about. ``features`` maps a vector column to the columns it is made of.
    """
    parts, drawn = [], {}
    for m in suite.members:
        if m.name not in suite.fitted:
            continue
        cols, model = features[m.features], suite.fitted[m.name]

        def explained(m=m, cols=cols, model=model) -> DataFrame:
            if effort.explain == "sampled" and output is shapley.prediction_output and has_trees(model):
                if m.features not in drawn:
                    drawn[m.features] = tree_shapley.background_rows(train, key, m.features, effort.background)
                return tree_shapley.tree_importance(test, key, cols, model, drawn[m.features], m.features)
            bg = shapley.background(train, cols, key, effort.background)
            if effort.explain == "exact":
                phi = shapley.shapley_model(test, key, cols, output(model), bg, m.features)
            else:
                phi = shapley.shapley_sampled(test, key, cols, output(model), bg, effort.pairs, vector=m.features)
            return importance.mean_abs(phi, [])

        parts.append(_or_native(suite, m.name, cols, effort, explained, test.sparkSession))
    return reshape.stack(parts) if parts else None


def has_trees(model) -> bool:
    """Whether a model's leaves give exact values."""
    if isinstance(model, OneVsRestModel):
        return all(has_trees(m) for m in model.models)
    return hasattr(model, "tree_table") or hasattr(model, "treeWeights")


def _or_native(suite: Suite, name: str, cols: list[str], effort: Effort, explained: Callable[[], DataFrame], spark) -> DataFrame:
    """The written explanation, or the model's own importance if that was asked for or the explanation failed."""
    if effort.explain not in ("sampled", "exact", "native"):
        raise ValueError(f"unknown way to explain: {effort.explain}")
    if effort.explain != "native":
        try:
            one = explained().select(F.lit(name).alias("model"), "feature", "importance", F.lit("shapley").alias("source"))
            return materialize(one, "importance")
        except Exception as e:  # noqa: BLE001 - the report goes on without this explanation
            if "OutOfMemoryError" in str(e):
                raise
            suite.failures[f"{name} explanation"] = str(e).splitlines()[0] if str(e) else type(e).__name__
    return importance.native(spark, {name: suite.fitted[name]}, cols)


def _named(imp: DataFrame | None, features: list[str]) -> DataFrame | None:
    """Put the real names in place of ``z_<i>``."""
    if imp is None:
        return None
    position = F.regexp_extract("feature", r"^z_(\d+)$", 1).try_cast("int")
    return imp.withColumn("feature", F.coalesce(F.get(F.lit(features), position), F.col("feature")))


def _trees(e: Effort) -> Member:
    return Member("RandomForest", lambda n: models.forest_regressor(e.trees, e.tree_depth), "raw_features")


def score_benchmark(
    df: DataFrame, target: str = "Exam_Score", key: str | None = None, fit_on: str = "train",
    group: str | None = None, groups: tuple[str, str] = ("GroupA", "GroupB"), effort: Effort = Effort(),
) -> Result:
    """Student scores: regression, with a linear model that takes each score for a class.

    Without a ``group`` column the two groups are drawn by hash, as a control.
    """
    df, key = with_key(clean.drop_missing(nan_to_null(df), [target]), key)
    df = split.hash_split(df.withColumn("y", _double(target)), key)
    features = feature_columns(df, (target, key, "y", "is_train", group))
    df, features = encode_and_impute(df, features, fit_on)
    grp = F.col(group) if group else split.assign_group(key, *groups)
    # Every fit, prediction and explanation reads this table: it is prepared once.
    df = materialize(two_vectors(df.withColumn("grp", grp), features, fit_on), "features")
    train, test = df.where("is_train"), df.where("not is_train")
    values = class_values(train, "y")
    e = effort
    suite = Suite(
        [
            Member("LogisticRegression", lambda n: models.logistic(n, e.iterations), "scaled_features", "y_class", class_decode(values)),
            _trees(e),
            Member(models.BOOSTED, lambda n: models.boosted_regressor(e.rounds, e.depth, 0.1), "raw_features"),
            Member(models.BOOSTED_ALT, lambda n: models.leaf_wise_trees(0, e.rounds, e.depth), "raw_features"),
        ]
    ).fit(train.withColumn("y_class", class_code(F.col("y"), values)), key)
    preds = materialize(suite.predict(test, [key, "y", "grp"]), "predictions")
    table = metrics.metrics_table(preds, MODEL, mape="eps", accuracy="relative")
    imp = _explained(suite, test, train, key, features, e)
    return Result(
        preds, table, fairness.group_rmse(preds, MODEL, "grp", *groups),
        readiness.readiness(table, readiness.r2_part(F.col("R2")), readiness.BOOSTED_FIRST, MODEL), imp, suite.failures,
    )


def _explained(suite, test, train, key, features, e, output=shapley.prediction_output):
    if e.explain == "none":
        return None
    zs = [f"z_{i}" for i in range(len(features))]
    imp = explain_suite(suite, test, train, key, {"raw_features": features, "scaled_features": zs}, e, output)
    return _named(imp, features)


def rank_benchmark(
    df: DataFrame, target: str = "Rank", features: list[str] = RANK_FEATURES, key: str | None = None,
    group: str | None = None, groups: tuple[str, str] = ("Public", "Private"),
    first_test_year: int = FIRST_TEST_YEAR, top: float = TOP_RANK, effort: Effort = Effort(iterations=1000, depth=6),
) -> Result:
    """University ranks: split by year; the linear model tells the top from the rest."""
    df = clean.coerce(nan_to_null(df), features)
    df = clean.drop_missing(df, [target, "Year", *[c for c in ("Name", "Country") if c in df.columns], *features])
    df, key = with_key(df.withColumns({"Year": F.col("Year").cast("int"), "y": _double(target)}), key)
    df = df.withColumn("is_train", F.col("Year") < first_test_year)
    grp = F.col(group) if group else split.assign_group(key, *groups)
    raw = VectorAssembler(inputCols=features, outputCol="raw_features").transform(df.withColumn("grp", grp))
    df = materialize(raw, "features")
    train, test = split.temporal_split(df, "Year", first_test_year)
    mm = scale.MinMax(train, "y")
    e = effort
    suite = Suite(
        [
            _trees(e),
            Member(models.BOOSTED, lambda n: models.boosted_regressor(e.rounds, e.depth, 0.3), "raw_features", "y_scaled", mm.restore),
            Member(models.BOOSTED_ALT, lambda n: models.leaf_wise_trees(0, e.rounds), "raw_features"),
            Member("LogisticRegression", lambda n: models.logistic(n, e.iterations), "raw_features", "y_top"),
        ]
    ).fit(train.withColumns({"y_scaled": mm.scale(F.col("y")), "y_top": at_most(F.col("y"), top).cast("double")}), key)
    preds = materialize(suite.predict(test, [key, "y", "grp"]), "predictions")
    table = metrics.metrics_table(preds, MODEL, mape="plain", accuracy="threshold", threshold=top)
    imp = None
    if e.explain != "none":
        trees = Suite([m for m in suite.members if m.name != "LogisticRegression"], fitted=suite.fitted, failures=suite.failures)
        parts = [explain_suite(trees, test, train, key, {"raw_features": features}, e)]
        if "LogisticRegression" in suite.fitted:
            weights = suite.fitted["LogisticRegression"].coefficients.toArray()
            phi = shapley.shapley_linear(test, key, features, {f: float(w) for f, w in zip(features, weights)}, train)
            linear = importance.mean_abs(phi, []).withColumn("model", F.lit("LogisticRegression"))
            parts.append(linear.withColumn("source", F.lit("shapley")))
        imp = reshape.stack([p for p in parts if p is not None])
    return Result(
        preds, table, fairness.threshold_rmse(preds, MODEL, "grp", *groups, top),
        readiness.readiness(table, readiness.share_part(F.col("Accuracy")), readiness.UNIFORM, MODEL), imp, suite.failures,
    )


def enrolment_benchmark(
    df: DataFrame, kind: str = "Type", fit_on: str = "train", effort: Effort = Effort(trees=100, rounds=100, depth=6, iterations=500),
) -> Result:
    """Enrolment by year and kind, from a table with one column per year."""
    years = clean.year_columns(df)
    texts = df.select(kind, *[F.col(f"`{y}`").cast("string").alias(y) for y in years])
    long = clean.drop_missing(reshape.melt(texts, [kind], years, "Year", "Enrollment"), ["Enrollment"])
    long = clean.coerce(long.withColumn("Year", F.col("Year").cast("int")), ["Enrollment"])
    df, key = with_key(clean.drop_missing(long, ["Enrollment"]), None)
    df = split.hash_split(clean.label_encode(df, kind).withColumn("y", F.col("Enrollment")), key)
    features = ["Year", kind]
    df = materialize(two_vectors(df, features, fit_on), "features")
    train, test = df.where("is_train"), df.where("not is_train")
    median = exact_median(train, "y")
    decode = lambda p: choose(p == 1, F.lit(median * 1.1), F.lit(median * 0.9))
    e = effort
    suite = Suite(
        [
            Member("RandomForest", lambda n: models.forest_regressor(e.trees, e.tree_depth), "scaled_features"),
            Member(models.BOOSTED, lambda n: models.boosted_regressor(e.rounds, e.depth, 0.3), "scaled_features"),
            Member(models.BOOSTED_ALT, lambda n: models.leaf_wise_trees(0, e.rounds), "scaled_features"),
            Member("LogisticRegression", lambda n: models.logistic(n, e.iterations), "scaled_features", "y_over", decode),
        ]
    ).fit(train.withColumn("y_over", above(F.col("y"), median).cast("double")), key)
    preds = materialize(suite.predict(test, [key, "y", kind]), "predictions")
    table = metrics.metrics_table(preds, MODEL, mape="plain", accuracy="r2")
    gap = fairness.group_rmse(preds, MODEL, kind, 0, 1, names=("Public_RMSE", "Private_RMSE"), digits=2)
    imp = _explained(suite, test, train, key, features, e)
    extra = {} if imp is None else {"importance_matrix": importance.matrix(imp, features)}
    return Result(
        preds, table, gap, readiness.readiness(table, F.col("R2"), readiness.UNIFORM, MODEL), imp, suite.failures, extra
    )


def _class_result(preds: DataFrame, keys: list[str], mape: str, groups: tuple[str, str], parts) -> dict:
    scores = metrics.classification_metrics(preds, keys)
    return {
        "metrics": scores,
        "regression": metrics.metrics_table(preds, keys, mape=mape, accuracy="class"),
        "fairness": fairness.group_accuracy(preds, keys, "grp", *groups),
        "readiness": readiness.readiness(scores, readiness.rounded_share_part(F.col("accuracy")), parts, keys),
    }


def class_members(
    classes: int, e: Effort, rate: float = 0.3, linear: str = "scaled_features", tree: str = "raw_features", share: float = 1.0, depth: int | None = None
) -> list[Member]:
    """The four families for ``classes`` classes.

    ``share`` of rows and columns is what a round of the first boosted one sees, ``depth`` bounds the leaf-wise trees.
    """
    return [
        Member("LogisticRegression", lambda n: models.logistic(n, e.iterations), linear),
        Member("RandomForest", lambda n: models.forest_classifier(e.trees, e.tree_depth), tree),
        Member(models.BOOSTED, lambda n: models.boosted_classes(classes, e.rounds, e.depth, rate, share, share), tree),
        Member(models.BOOSTED_ALT, lambda n: models.leaf_wise_trees(classes, e.rounds, depth), tree),
    ]


def class_benchmark(
    df: DataFrame, target: str = "Target", key: str | None = None, fit_on: str = "train",
    group: str | None = None, groups: tuple[str, str] = ("LowIncome", "HighIncome"),
    top: int = 10, effort: Effort = Effort(trees=100, rounds=100, depth=6, iterations=1000),
) -> Result:
    """Student dropout: several classes; trees see raw features, the linear model scaled ones."""
    df, key = with_key(clean.drop_missing(nan_to_null(df), [target]), key)
    df = split.hash_split(df, key)
    values = class_values(df, target)
    df = df.withColumn("y", class_code(F.col(target), values))
    features = feature_columns(df, (target, key, "y", "is_train", group))
    df, features = encode_and_impute(df, features, fit_on)
    grp = F.col(group) if group else split.assign_group(key, *groups)
    # Every fit, prediction and explanation reads this table: it is prepared once.
    df = materialize(two_vectors(df.withColumn("grp", grp), features, fit_on), "features")
    train, test = df.where("is_train"), df.where("not is_train")
    suite = Suite(class_members(len(values), effort)).fit(train, key)
    preds = materialize(suite.predict(test, [key, "y", "grp"]), "predictions")
    out = _class_result(preds, MODEL, "clipped", groups, readiness.TREES_FIRST)
    imp = _explained(suite, test, train, key, features, effort)
    extra = {"regression": out["regression"]}
    if imp is not None:
        extra["top_features"] = importance.top_k(imp, MODEL, top)
    return Result(preds, out["metrics"], out["fairness"], out["readiness"], imp, suite.failures, extra)


def label_benchmark(
    df: DataFrame, columns: Declared = BUDGET_COLUMNS, key: str | None = None, max_features: int = tfidf.MAX_FEATURES,
    stop_words: list[str] | None = None, group: str | None = None, groups: tuple[str, str] = ("LowIncome", "HighIncome"),
    top: int = 20, effort: Effort = Effort(tree_depth=10, depth=6, iterations=500),
) -> Result:
    """School budgets: text and numbers, several labels, every model for every label.

    Some labels are fitted at the same time. A sample of rows is explained: tree models exactly, from
    their leaves (forests in probabilities, boosted trees in margins), the linear model by feature orders over the
    terms that differ. ``source`` in the result says where a model's own importance stands in.
    """
    df, key = with_key(nan_to_null(df), key)
    df = split.hash_split(df, key)
    text, numeric = clean.existing(df, columns.text), clean.existing(df, columns.numeric)
    labels = clean.existing(df, columns.label)
    grp = F.col(group) if group else split.assign_group(key, *groups)
    df = df.withColumns({"combined_text": join_text(*[F.col(c) for c in text]), "grp": grp})
    df = clean.median_impute(df, numeric, fit_on=df.where("is_train"))
    numeric = clean.existing(df, numeric)
    df = scale.standardize(df, numeric, fit_on=df.where("is_train"))
    model = tfidf.fit_tfidf(df.where("is_train"), "combined_text", max_features, stop_words)
    wide = tfidf.assemble(model.vectors(df, "combined_text"), "tfidf", numeric)
    # Labels x models fits read the same features: the text work is done once.
    table = materialize(wide.select(key, "is_train", "grp", "features", *labels), "label-features")
    names = tfidf.feature_names(model, numeric)

    def one(label: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
        rows = clean.drop_missing(table, [label])
        values = class_values(rows, label)
        coded = rows.withColumn("y", class_code(F.col(label), values))
        members = class_members(len(values), effort, 0.1, "features", "features", 0.8, effort.depth)
        suite = Suite(members).fit(coded.where("is_train"), key)
        found = suite.predict(coded.where("not is_train"), [key, "y", "grp"]).withColumn("label", F.lit(label))
        imp = _label_importance(suite, coded, key, names, effort).withColumn("label", F.lit(label))
        return found, imp, {f"{label}: {m}": err for m, err in suite.failures.items()}

    with ThreadPoolExecutor(PARALLEL_LABELS) as pool:
        waiting = [pool.submit(inheritable_thread_target(df.sparkSession)(one), label) for label in labels]
        preds, imps, notes = (list(c) for c in zip(*[w.result() for w in waiting]))
    failures = {m: err for note in notes for m, err in note.items()}
    stacked = materialize(reshape.stack(preds), "predictions")
    out = _class_result(stacked, ["label", "model"], "zero_as_one", groups, readiness.TREES_FIRST)
    imp = reshape.stack(imps)
    extra = {"regression": out["regression"], "top_features": importance.top_k(imp, ["label", "model"], top)}
    return Result(stacked, out["metrics"], out["fairness"], out["readiness"], imp, failures, extra)


def _label_importance(suite: Suite, df: DataFrame, key: str, names: list[str], e: Effort) -> DataFrame:
    train, test = df.where("is_train"), df.where("not is_train")

    def explained(name: str) -> DataFrame:
        model = suite.fitted[name]
        if has_trees(model):
            bg = tree_shapley.background_rows(train, key, "features", e.background)
            return tree_shapley.tree_importance(split.bounded_sample(test, key, e.tree_rows), key, names, model, bg)
        picked = split.bounded_sample(test, key, e.linear_rows)
        if isinstance(model, LogisticRegressionModel):
            bg = tree_shapley.background_rows(train, key, "features", e.background)
            phi = sparse_shapley.shapley_logistic(picked, key, names, model, bg, e.pairs)
        else:
            x = vector_to_array("features")
            bg = shapley.background(train, names, key, e.background, x=x)
            phi = shapley.shapley_sampled(picked, key, names, shapley.probability_output(model), bg, e.pairs, x=x)
        return importance.mean_abs(shapley.reduce_classes(phi, "mean_abs"), [])

    return reshape.stack([_or_native(suite, n, names, e, partial(explained, n), df.sparkSession) for n in suite.fitted])


def profile_benchmark(
    datasets: dict[str, DataFrame],
    declared: dict[str, Declared] | None = None,
    tasks: dict[str, tuple[str, str]] | None = None,
) -> dict[str, DataFrame]:
    """All profile tables of a catalogue. The null counts are read from the data once."""
    cells = materialize(profile.column_profile(datasets, declared), "profile")
    columns = sorted({c for df in datasets.values() for c in df.columns})
    ratios = profile.distinct_ratio(datasets)
    return {
        "summary": profile.dataset_summary(cells, tasks or {}),
        "feature_types": profile.feature_types(cells),
        "feature_type_share": profile.feature_type_share(cells),
        "missing_total": profile.missing_total(cells),
        "missing_matrix": profile.missing_matrix(cells, columns),
        "missing_by_type": profile.missing_by_type(cells),
        "diversity": profile.diversity_summary(ratios),
    }
