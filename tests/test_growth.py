"""Steps whose work must not grow faster than the table, and the same results as their plain forms."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabscore.operators import boosting, clean, importance, kernel_shapley, models, shapley, tfidf, tree_shapley


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_are_coerced_without_text(spark):
    df = spark.sql("select 0.1d as a, 2 as b, '3.5' as c union all select double('nan'), null, '1d' union all select -0.25d, 7, 'x'")
    got = clean.coerce(df, ["a", "b"])
    assert "RLIKE" not in plan(got) and "as string" not in plan(got)
    rows = sorted(clean.coerce(df, ["a", "b", "c"]).collect(), key=str)
    assert sorted(map(tuple, rows), key=str) == sorted([(0.1, 2.0, 3.5), (None, None, None), (-0.25, 7.0, None)], key=str)


def test_a_batch_of_rows_is_one_record(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, seen = rng.normal(size=(300, 3)), []
    sparse = [Vectors.sparse(3, [(j, float(v)) for j, v in enumerate(r) if j != i % 3]) for i, r in enumerate(x)]
    stored = np.stack([v.toArray() for v in sparse])
    grow = boosting._grow
    monkeypatch.setattr(boosting, "_grow", lambda state, *rest: seen.append(state.count()) or grow(state, *rest))
    for vectors, values in (([Vectors.dense(r) for r in x], x), (sparse, stored)):
        df = spark.createDataFrame([(i, v, float(r[0] > r[1])) for i, (v, r) in enumerate(zip(vectors, values))], ["k", "features", "label"]).coalesce(2)
        model = boosting.leaf_wise(2, 2, 0.3, 6).setLabelCol("label").fit(df)
        right = (model.table.score(values)[:, 0] > 0) == (values[:, 0] > values[:, 1])
        assert right.mean() > 0.8
    assert seen and max(seen) <= 8


def test_tree_importance_is_that_of_the_long_values(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(float) + (x[:, 2] > 1)
    # Repeated and missing keys count once, with the mean of their rows.
    keys = [None if i % 40 == 0 else i // 2 if i < 40 else i for i in range(120)]
    df = spark.createDataFrame([(k, Vectors.dense(r), float(c)) for k, r, c in zip(keys, x, y)], ["k", "features", "label"])
    model = models.forest_classifier(3, 3).setLabelCol("label").fit(df)
    background = list(x[:6])
    phi = tree_shapley.shapley_trees(df, "k", list("abc"), model, background)
    want = {r["feature"]: r["importance"] for r in importance.mean_abs(shapley.reduce_classes(phi, "mean_abs"), []).collect()}
    got = tree_shapley.tree_importance(df, "k", list("abc"), model, background)
    assert "Generate posexplode" not in plan(got)
    assert {r["feature"]: r["importance"] for r in got.collect()} == pytest.approx(want, abs=1e-12)
    assert tree_shapley.tree_importance(df.where("k < -1"), "k", list("abc"), model, background).count() == 0


def test_kernel_values_of_a_formula(spark):
    rng = np.random.default_rng(2)
    rows = [(i // 2, *map(float, r)) for i, r in enumerate(rng.normal(size=(10, 3)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    formula = lambda x: x[0] * x[1] + 2.0 * x[2]
    score = lambda d: d.withColumn("out", F.array(formula(vector_to_array("features"))))
    bg = shapley.background(df, list("abc"), "k", 4)

    def told(found):
        return sorted((r["k"], r["cls"], r["feature"], round(r["phi"], 7)) for r in found.collect())

    want = told(kernel_shapley.shapley_kernel(df, "k", list("abc"), score, bg))
    assert told(kernel_shapley.shapley_kernel(df, "k", list("abc"), None, bg, formula=formula)) == want
    z, weight = kernel_shapley.coalitions(5)
    v = rng.normal(size=len(z))
    assert kernel_shapley.solver(z, weight) @ np.concatenate([[0.3, 1.7], v]) == pytest.approx(kernel_shapley.solve(z, weight, v, 0.3, 1.7))
    with pytest.raises(Exception, match="a score is missing"):
        kernel_shapley.shapley_kernel(df.withColumn("a", F.when(F.col("k") > 0, F.col("a"))), "k", list("abc"), None, bg, formula=formula).collect()


def test_terms_are_counted_without_a_struct_each(spark):
    df = spark.createDataFrame([("ab cd ab",), ("cd",), (None,), ("",)], "text string")
    totals = tfidf.term_totals(df, "text", [])
    assert "struct" not in plan(totals)
    assert sorted(map(tuple, totals.collect())) == [("ab", 2, 1), ("ab cd", 1, 1), ("cd", 2, 2), ("cd ab", 1, 1)]
