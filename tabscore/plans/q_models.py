"""Model families and suites on the given tables.

Rounds and trees are kept few, so that a check takes seconds; they are parameters.
Fitted values have no SQL form, hence these queries state none.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.functions.scalars import above, at_most, choose
from tabscore.operators import importance, models, scale, split, tfidf
from tabscore.operators.models import Member, Suite
from tabscore.operators.ranks import exact_median
from tabscore.operators.reshape import stack
from tabscore.plans.q_features import STOP, documents, dual_features
from tabscore.plans.registry import query
from tabscore.plans.roles import FEATURES, THRESHOLD, code_of, sales, sales_features
from tabscore.session import materialize, spread

RAW, SCALED = "raw_features", "scaled_features"
# Rounds of the leaf-wise fits here; 200 are the default.
ROUNDS = 10
KEEP = ["row_id", "y", "segment"]


def regression_table(t) -> DataFrame:
    """Orders with both feature vectors, the target and two class targets."""
    median = exact_median(sales(t).where("is_train"), "y")
    df = dual_features(sales_features(t), FEATURES)
    return df.withColumns(
        {"small": at_most(F.col("y"), THRESHOLD).cast("double"), "over": above(F.col("y"), median).cast("double")}
    )


def fit_and_predict(df: DataFrame, members: list[Member], keep: list[str]) -> DataFrame:
    suite = Suite(members).fit(df.where("is_train"), keep[0])
    if suite.failures:
        raise RuntimeError(f"models failed: {suite.failures}")
    return suite.predict(df.where("not is_train"), keep)


def vectors_table(t) -> DataFrame:
    """Embedding vectors with ten classes."""
    return spread(t.embeddings, "vec_id").select(
        F.col("vec_id").alias("row_id"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").cast("double").alias("y"),
        split.in_train("vec_id").alias("is_train"),
    )


FLAG_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def flags_table(t) -> DataFrame:
    """Line items with the return flag as a three-class target.

    The table has no row key: the order key decides the split, so that items of
    one order stay together.
    """
    li = spread(t.lineitem).select(
        F.col("l_orderkey").alias("row_id"),
        *FLAG_FEATURES,
        code_of(F.col("l_returnflag"), ["A", "N", "R"]).alias("y"),
        split.in_train("l_orderkey").alias("is_train"),
    )
    point = F.array(*[F.col(c).cast("double") for c in FLAG_FEATURES])
    return li.select("row_id", "y", "is_train", array_to_vector(point).alias("features"))


@query("rf_regression")
def rf_regression(t):
    member = Member("RandomForest", lambda n: models.forest_regressor(10, 5), RAW)
    return fit_and_predict(regression_table(t), [member], KEEP)


@query("gbt_regression")
def gbt_regression(t):
    member = Member(models.BOOSTED, lambda n: models.boosted_regressor(5, 4, 0.1), RAW)
    return fit_and_predict(regression_table(t), [member], KEEP)


@query("gbt_regression_alt")
def gbt_regression_alt(t):
    member = Member(models.BOOSTED_ALT, lambda n: models.leaf_wise_trees(0, ROUNDS), RAW)
    return fit_and_predict(regression_table(t), [member], KEEP)


@query("rf_classification")
def rf_classification(t):
    member = Member("RandomForest", lambda n: models.forest_classifier(10, 5))
    return fit_and_predict(vectors_table(t), [member], ["row_id", "y"])


@query("gbt_classification")
def gbt_classification(t):
    """Softmax boosting as it is published: 200 rounds to depth 6, each on 0.8 of the rows and of the columns."""
    make = lambda n: models.boosted_classes(3, rows=0.8, columns=0.8)
    return fit_and_predict(flags_table(t), [Member(models.BOOSTED, make)], ["row_id", "y"])


@query("gbt_classification_alt")
def gbt_classification_alt(t):
    make = lambda n: models.leaf_wise_trees(3, ROUNDS)
    return fit_and_predict(flags_table(t), [Member(models.BOOSTED_ALT, make)], ["row_id", "y"])


@query("logistic_multinomial")
def logistic_multinomial(t):
    member = Member("LogisticRegression", lambda n: models.logistic(n, 50, family="multinomial"))
    return fit_and_predict(vectors_table(t), [member], ["row_id", "y"])


@query("logistic_binary")
def logistic_binary(t):
    member = Member("LogisticRegression", lambda n: models.logistic(n, 50, family="binomial"), SCALED, "small")
    return fit_and_predict(regression_table(t), [member], ["row_id", "small"])


@query("scaled_target_regression")
def scaled_target_regression(t):
    """Boosted trees learn the min-max scaled target; predictions are scaled back."""
    df = regression_table(t)
    mm = scale.MinMax(df.where("is_train"), "y")
    member = Member(models.BOOSTED, lambda n: models.boosted_regressor(5, 4, 0.1), RAW, "y_scaled", mm.restore)
    return fit_and_predict(df.withColumn("y_scaled", mm.scale(F.col("y"))), [member], KEEP)


def small_suite(median: float) -> list[Member]:
    """All four families; the linear one learns a class that is decoded to a value."""
    decode = lambda p: choose(p == 1, F.lit(median * 1.1), F.lit(median * 0.9))
    return [
        Member("LogisticRegression", lambda n: models.logistic(n, 20), SCALED, "over", decode),
        Member("RandomForest", lambda n: models.forest_regressor(5, 4), RAW),
        Member(models.BOOSTED, lambda n: models.boosted_regressor(3, 3, 0.1), RAW),
        Member(models.BOOSTED_ALT, lambda n: models.leaf_wise_trees(0, 3, 3), RAW),
    ]


@query("suite_predictions")
def suite_predictions(t):
    median = exact_median(sales(t).where("is_train"), "y")
    return fit_and_predict(regression_table(t), small_suite(median), KEEP)


@query("suite_failures")
def suite_failures(t):
    """One member names a column that is not there; the other one still runs."""
    members = [
        Member("RandomForest", lambda n: models.forest_regressor(3, 3), RAW),
        Member("Broken", lambda n: models.forest_regressor(3, 3), "no_such_vector"),
    ]
    suite = Suite(members).fit(regression_table(t).where("is_train"), "row_id")
    return suite.failure_table(t.spark)


@query("multilabel_suite")
def multilabel_suite(t):
    """Several targets on one feature table; the label is part of every row."""
    docs = split.hash_split(documents(t).join(t.labels, "doc_id"), "doc_id")
    model = tfidf.fit_tfidf(docs.where("is_train"), "text", 200, STOP)
    features = tfidf.assemble(
        scale.standardize(
            model.vectors(docs.withColumn("n_chars", F.col("n_chars").cast("double")), "text"),
            ["n_chars"], fit_on=docs.where("is_train"),
        ),
        "tfidf", ["n_chars"],
    ).select("doc_id", "is_train", "features", "quality", "toxic")
    members = [
        ("LogisticRegression", lambda n: models.logistic(n, 20)),
        ("RandomForest", lambda n: models.forest_classifier(5, 4)),
        (models.BOOSTED, lambda n: models.boosted_classes(2, 2, 3)),
        (models.BOOSTED_ALT, lambda n: models.leaf_wise_trees(2, 2, 3)),
    ]
    # Eight fits read the same features: they are written once, text work included.
    features = materialize(features, "text-features")
    return multilabel(features, ["quality", "toxic"], members, "doc_id")


def multilabel(features: DataFrame, targets: list[str], members: list, key: str, keep: list[str] | None = None) -> DataFrame:
    """Fit every model for every target; long predictions with ``label`` (and the key and target, unless other columns are kept)."""
    out = []
    for target in targets:
        df = features.where(F.col(target).isNotNull()).withColumn("y", F.col(target).cast("double"))
        suite = Suite([Member(n, make) for n, make in members]).fit(df.where("is_train"), key)
        preds = suite.predict(df.where("not is_train"), keep or [key, "y"])
        out.append(preds.withColumn("label", F.lit(target)))
    return stack(out)


@query("fallback_importance")
def fallback_importance(t):
    df = regression_table(t)
    members = [
        Member("RandomForest", lambda n: models.forest_regressor(5, 4), RAW),
        Member("LogisticRegression", lambda n: models.logistic(n, 20), SCALED, "over"),
    ]
    suite = Suite(members).fit(df.where("is_train"), "row_id")
    return importance.native(t.spark, suite.fitted, FEATURES)
