"""Shapley values and feature importance."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.operators import importance, kernel_shapley, models, shapley, sparse_shapley, split, tfidf, tree_shapley
from tabscore.operators.tree_shapley import TreeTable
from tabscore.plans.q_features import STOP, documents
from tabscore.plans.q_models import vectors_table
from tabscore.plans.registry import query
from tabscore.plans.roles import FEATURES, sales_features, sql_hash
from tabscore.session import materialize

EVENT_FEATURES = ["a", "b", "c"]
LINEAR = {"a": 1.0, "b": -2.0, "c": 0.5}
CLASS_WEIGHTS = [{"a": 1.0, "b": -2.0, "c": 0.5}, {"a": -1.0, "b": 0.5, "c": 0.0}, {"a": 0.0, "b": 1.5, "c": -0.5}]


def event_table(t) -> DataFrame:
    """Events as three numbers: value, the JSON field k, user."""
    return t.events.select(
        F.col("event_id").alias("row_id"),
        F.col("value").alias("a"),
        F.get_json_object("props", "$.k").cast("double").alias("b"),
        F.col("user_id").cast("double").alias("c"),
    )


def product_plus(x):
    """The explained formula: a * b + 2 c."""
    return x[0] * x[1] + 2.0 * x[2]


def event_phi(t) -> DataFrame:
    ev = event_table(t)
    return shapley.shapley_exact(ev, "row_id", EVENT_FEATURES, product_plus, shapley.background(ev, EVENT_FEATURES, "row_id"))


def both_phi(t) -> DataFrame:
    ev = event_table(t)
    linear = shapley.shapley_linear(ev, "row_id", EVENT_FEATURES, LINEAR, ev)
    return (
        event_phi(t).withColumn("model", F.lit("product"))
        .unionByName(linear.withColumn("model", F.lit("linear")))
    )


# For a * b + 2 c the values have a closed form, independent of the coalition sum.
EVENT_SQL = f"""
ev AS (
  SELECT event_id AS row_id, value AS a, (props->>'$.k')::double AS b, user_id::double AS c FROM events)
, bg AS (SELECT * FROM ev ORDER BY {sql_hash('row_id')}, row_id LIMIT 100)
, pm AS (
  SELECT ev.row_id, avg((ev.a - bg.a) * (ev.b + bg.b) / 2) AS pa, avg((ev.b - bg.b) * (ev.a + bg.a) / 2) AS pb,
         avg(2 * (ev.c - bg.c)) AS pc
  FROM ev CROSS JOIN bg GROUP BY ev.row_id)
, phi AS (
  SELECT row_id, 'a' AS feature, pa AS phi FROM pm UNION ALL SELECT row_id, 'b', pb FROM pm
  UNION ALL SELECT row_id, 'c', pc FROM pm)
, means AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM ev)
, lin AS (
  SELECT row_id, 'a' AS feature, a - ma AS phi FROM ev, means UNION ALL SELECT row_id, 'b', -2 * (b - mb) FROM ev, means
  UNION ALL SELECT row_id, 'c', 0.5::double * (c - mc) FROM ev, means)
, imp AS (
  SELECT 'product' AS model, feature, avg(abs(phi)) AS importance FROM phi GROUP BY feature
  UNION ALL SELECT 'linear', feature, avg(abs(phi)) FROM lin GROUP BY feature)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rank FROM imp)
"""


@query("shapley_exact", f"WITH {EVENT_SQL} SELECT row_id, feature, round(phi, 7) AS phi FROM phi")
def shapley_exact(t):
    return event_phi(t).withColumn("phi", F.round("phi", 7))


@query("shapley_linear", f"WITH {EVENT_SQL} SELECT row_id, feature, round(phi, 7) AS phi FROM lin")
def shapley_linear(t):
    ev = event_table(t)
    return shapley.shapley_linear(ev, "row_id", EVENT_FEATURES, LINEAR, ev).withColumn("phi", F.round("phi", 7))


def event_importance(t) -> DataFrame:
    return importance.mean_abs(both_phi(t), ["model"])


@query("importance_rank", f"""
WITH {EVENT_SQL} SELECT model, feature, round(importance, 4) AS importance, rank::int AS rank FROM ranked""")
def importance_rank(t):
    return importance.ranked(event_importance(t), ["model"]).withColumn("importance", F.round("importance", 4))


@query("top_feature", f"""
WITH {EVENT_SQL} SELECT model, feature, round(importance, 4) AS importance FROM ranked WHERE rank = 1""")
def top_feature(t):
    top = importance.top_k(event_importance(t), ["model"], 1)
    return top.select("model", "feature", F.round("importance", 4).alias("importance"))


@query("topk_features", f"""
WITH {EVENT_SQL} SELECT model, feature, rank::int AS rank, round(importance, 4) AS importance FROM ranked WHERE rank <= 2""")
def topk_features(t):
    return importance.top_k(event_importance(t), ["model"], 2).withColumn("importance", F.round("importance", 4))


@query("top_feature_label", f"""
WITH {EVENT_SQL}
SELECT model, model || chr(10) || '(' || feature || ')' AS label, round(importance, 4) AS importance FROM ranked WHERE rank = 1""")
def top_feature_label(t):
    return importance.top_label(event_importance(t)).withColumn("importance", F.round("importance", 4))


@query("importance_matrix", f"""
WITH {EVENT_SQL}
SELECT model, {", ".join(f"round(max(CASE WHEN feature = '{f}' THEN importance END), 4) AS {f}" for f in EVENT_FEATURES)}
FROM imp GROUP BY model""")
def importance_matrix(t):
    m = importance.matrix(event_importance(t), EVENT_FEATURES)
    return m.select("model", *[F.round(f, 4).alias(f) for f in EVENT_FEATURES])


@query("importance_json", f"""
WITH {EVENT_SQL}
SELECT model, '{{' || string_agg('"' || feature || '":' || round(importance, 2), ',' ORDER BY feature) || '}}' AS json
FROM imp GROUP BY model""")
def importance_json(t):
    return importance.as_json(event_importance(t).withColumn("importance", F.round("importance", 2)))


_CLASS_SQL = " UNION ALL ".join(
    f"SELECT {c} AS cls, '{f}' AS feature, {w[f]}::double * ({f} - m{f}) AS phi FROM ev, means"
    for c, w in enumerate(CLASS_WEIGHTS) for f in EVENT_FEATURES
)


@query("shapley_class_reduce", f"""
WITH {EVENT_SQL}, cp AS ({_CLASS_SQL})
SELECT 'class' AS policy, feature, round(avg(abs(phi)), 4) AS importance FROM cp WHERE cls = 1 GROUP BY feature
UNION ALL SELECT 'mean_abs', feature, round(avg(abs(phi)), 4) FROM cp GROUP BY feature""")
def shapley_class_reduce(t):
    ev = event_table(t)
    per_class = [
        shapley.shapley_linear(ev, "row_id", EVENT_FEATURES, w, ev).withColumn("cls", F.lit(c))
        for c, w in enumerate(CLASS_WEIGHTS)
    ]
    phi = per_class[0].unionByName(per_class[1]).unionByName(per_class[2])
    both = [
        importance.mean_abs(shapley.reduce_classes(phi, p), []).withColumn("policy", F.lit(p))
        for p in ("class", "mean_abs")
    ]
    return both[0].unionByName(both[1]).withColumn("importance", F.round("importance", 4))


@query("shapley_model")
def shapley_model(t):
    """Exact values of boosted trees for every test row, from their leaves."""
    df = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sales_features(t))
    train, test = df.where("is_train"), df.where("not is_train")
    model = models.boosted_regressor(5, 3, 0.1).setLabelCol("y").fit(train)
    bg = tree_shapley.background_rows(train, "row_id", "features")
    phi = tree_shapley.shapley_trees(test, "row_id", FEATURES, model, bg)
    return phi.select("row_id", "feature", "phi")


VECTOR_FEATURES = [f"v{i}" for i in range(64)]


def _explain_vectors(t, make, rows: int, pairs: int) -> DataFrame:
    df, x = vectors_table(t), vector_to_array("features")
    train, test = df.where("is_train"), df.where("not is_train")
    model = make(train.count()).setLabelCol("y").fit(train)
    bg = shapley.background(train, VECTOR_FEATURES, "row_id", 100, x=x)
    picked = split.bounded_sample(test, "row_id", rows)
    score = shapley.probability_output(model)
    return shapley.shapley_sampled(picked, "row_id", VECTOR_FEATURES, score, bg, pairs, x=x)


@query("shapley_sampled")
def shapley_sampled(t):
    """Class probabilities of a linear model: 50 sampled rows, 100 background rows."""
    return _explain_vectors(t, lambda n: models.logistic(n, 20, family="multinomial"), 50, 2)


@query("shapley_class_prob")
def shapley_class_prob(t):
    """Class probabilities of a full forest (100 trees), exactly, for a sample of 500 rows."""
    df = vectors_table(t)
    train = df.where("is_train")
    model = models.deep_forest().setLabelCol("y").fit(train)
    background = tree_shapley.background_rows(train, "row_id", "features")
    picked = split.bounded_sample(df.where("not is_train"), "row_id", 500)
    return tree_shapley.shapley_trees(picked, "row_id", VECTOR_FEATURES, model, background)


# Two trees stated by hand: (a <= 50: (b <= 5: 1, else 3), else 7) and (c <= 500: 2, else -1).
TWO_TREES = TreeTable(
    np.array([0, 1, -1, -1, -1, 2, -1, -1]), np.array([50.0, 5, 0, 0, 0, 500, 0, 0]), np.array([1, 2, -1, -1, -1, 6, -1, -1]),
    np.array([4, 3, -1, -1, -1, 7, -1, -1]), np.array([[0.0], [0], [1], [3], [7], [0], [2], [-1]]), np.array([0, 5]), np.zeros(1),
)


@query("shapley_two_trees", f"""
WITH {EVENT_SQL}
, p AS (
  SELECT ev.row_id, ev.a AS xa, ev.b AS xb, bg.a AS ba, bg.b AS bb,
         CASE WHEN ev.c <= 500 THEN 2 ELSE -1 END - CASE WHEN bg.c <= 500 THEN 2 ELSE -1 END AS pc FROM ev CROSS JOIN bg)
, v AS (
  SELECT row_id, pc, {", ".join(f"CASE WHEN {a}a <= 50 THEN CASE WHEN {b}b <= 5 THEN 1 ELSE 3 END ELSE 7 END AS f{a}{b}" for a in "xb" for b in "xb")} FROM p)
, s AS (
  SELECT row_id, avg((fxb - fbb + fxx - fbx) / 2.0::double) AS pa, avg((fbx - fbb + fxx - fxb) / 2.0::double) AS pb, avg(pc::double) AS pc FROM v GROUP BY row_id)
SELECT row_id, 'a' AS feature, round(pa, 7) AS phi FROM s UNION ALL SELECT row_id, 'b', round(pb, 7) FROM s UNION ALL SELECT row_id, 'c', round(pc, 7) FROM s""")
def shapley_two_trees(t):
    ev = event_table(t).withColumn("features", array_to_vector(F.array(*EVENT_FEATURES)))
    background = tree_shapley.background_rows(ev, "row_id", "features")
    phi = tree_shapley.shapley_trees(ev, "row_id", EVENT_FEATURES, TWO_TREES, background)
    return phi.select("row_id", "feature", F.round("phi", 7).alias("phi"))


@query("shapley_kernel", f"WITH {EVENT_SQL} SELECT row_id, feature, round(phi, 5) AS phi FROM phi")
def shapley_kernel(t):
    """With all coalitions the fit gives the exact values."""
    ev = event_table(t)
    bg = shapley.background(ev, EVENT_FEATURES, "row_id")
    phi = kernel_shapley.shapley_kernel(ev, "row_id", EVENT_FEATURES, None, bg, formula=product_plus)
    return phi.select("row_id", "feature", F.round("phi", 5).alias("phi"))


@query("shapley_text")
def shapley_text(t):
    """Class probabilities of a linear text model with up to 10,000 terms: 50 sampled rows, 100 background rows."""
    docs = split.hash_split(documents(t).join(t.labels.where("quality is not null"), "doc_id"), "doc_id")
    terms = tfidf.fit_tfidf(docs.where("is_train"), "text", stop_words=STOP)
    # Counts, fit, background and explained rows read these vectors: the text work is done once.
    df = materialize(terms.vectors(docs, "text", "features").select("doc_id", "is_train", "features", F.col("quality").cast("double").alias("y")), "text-features")
    train = df.where("is_train")
    model = models.logistic(train.count()).setLabelCol("y").fit(train)
    background = tree_shapley.background_rows(train, "doc_id", "features")
    picked = split.bounded_sample(df.where("not is_train"), "doc_id", 50)
    phi = sparse_shapley.shapley_logistic(picked, "doc_id", terms.vocabulary, model, background)
    return phi.where("cls = 1 and phi <> 0").select("doc_id", "feature", "phi")
