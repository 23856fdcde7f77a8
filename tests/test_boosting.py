"""Boosted trees against a plain grower; tree, sparse and kernel Shapley values against all coalitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabscore.operators import boosting, clean, importance, kernel_shapley, models, ranks, shapley, sparse_shapley, tree_shapley
from tabscore.operators.boosting import Booster, Growth
from tabscore.operators.models import Member, Suite


def table(n=160, m=4, seed=0, sparse=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 9, (n, m)).astype(float)
    if sparse:
        x[rng.random((n, m)) < 0.6] = 0.0
    y = x[:, 0] * 2 - x[:, 1] + (x[:, 2] > 2) * x[:, 3] + rng.normal(size=n)
    return x, y


def frame(spark, x, y, sparse=False):
    rows = []
    for i, (row, target) in enumerate(zip(x, y)):
        at = np.flatnonzero(row)
        rows.append((i, Vectors.sparse(len(row), at.tolist(), row[at].tolist()) if sparse else Vectors.dense(row.tolist()), float(target)))
    return spark.createDataFrame(rows, ["k", "features", "label"])


def plain_boost(x, y, g: Growth):
    """The same growth with one node at a time, on all thresholds between values; returns margins."""
    n, trees = len(x), g.trees
    margin = np.full((n, trees), y.mean() if g.classes == 0 else 0.0)
    for _ in range(g.rounds):
        first, second = boosting.gradients(y, margin, g.classes)
        step = np.zeros_like(margin)
        for k in range(trees):
            gr, h = first[:, k], second[:, k]

            def part(rows):
                w = h[rows].sum() + g.l2
                return gr[rows].sum() ** 2 / w if w > 0 else 0.0

            def best(rows):
                found = None
                for f in range(x.shape[1]):
                    for t in np.unique(x[rows, f])[:-1]:
                        left, right = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                        if min(len(left), len(right)) < g.least_rows or min(h[left].sum(), h[right].sum()) < g.least_weight:
                            continue
                        gain = part(left) + part(right) - part(rows)
                        if gain > 1e-12 and (found is None or gain > found[0] * (1 + 1e-9)):
                            found = (gain, left, right)
                return found

            leaves, made = {0: (np.arange(n), 0, best(np.arange(n)))}, 1
            while g.leaves is None or len(leaves) < g.leaves:
                fit = [(-s[2][0], i) for i, s in leaves.items() if s[2] and (g.depth is None or s[1] < g.depth)]
                if not fit:
                    break
                _, i = min(fit)
                _, depth, (_, left, right) = leaves.pop(i)
                for rows in (left, right):
                    leaves[made] = (rows, depth + 1, best(rows))
                    made += 1
            for rows, _, _ in leaves.values():
                step[rows, k] = -g.rate * gr[rows].sum() / (h[rows].sum() + g.l2)
        margin = margin + step
    return margin


GROWTHS = [
    Growth(0, 4, 0.3, 6, None, least_rows=5),
    Growth(0, 3, 0.5, None, 3, l2=1.0, least_rows=1, least_weight=1.0),
    Growth(2, 3, 0.3, 7, 4, least_rows=8),
    Growth(3, 3, 0.3, None, 2, l2=1.0, least_rows=1, least_weight=1.0),
    Growth(3, 18, 0.1, 4, None, least_rows=20),
]


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("growth", GROWTHS, ids=str)
def test_boosting_equals_a_plain_grower(spark, growth, sparse):
    if sparse and growth.rounds > 4:
        pytest.skip("one long fit is enough")
    x, y = table(sparse=sparse)
    if growth.classes:
        y = np.digitize(y, np.quantile(y, [i / growth.classes for i in range(1, growth.classes)])).astype(float)
    model = Booster(growth).fit(frame(spark, x, y, sparse).repartition(3))
    assert model.table.score(x) == pytest.approx(plain_boost(x, y, growth), abs=1e-6)
    got = model.transform(frame(spark, x, y, sparse)).orderBy("k").collect()
    want = model.outputs(x)
    if growth.classes:
        assert [r["prediction"] for r in got] == want.argmax(axis=1).tolist()
        assert np.array([r["probability"].toArray() for r in got]) == pytest.approx(want) and want.sum(axis=1) == pytest.approx(1)
    else:
        assert [r["prediction"] for r in got] == pytest.approx(want[:, 0].tolist())


def test_sampled_rounds_missing_numbers_and_constants(spark):
    x, y = table(300)
    x[::7, 1] = np.nan
    df = frame(spark, np.hstack([x, np.ones((300, 1))]), y)
    model = models.level_wise(0, 12, 0.3, 4, rows=0.8, columns=0.8).fit(df)
    error = np.array([r["label"] - r["prediction"] for r in model.transform(df).collect()])
    assert (error**2).mean() < 0.4 * y.var() and model.featureImportances[4] == 0 and sum(model.featureImportances) == pytest.approx(1)
    flat = models.leaf_wise_trees(0, 2).fit(df.withColumn("label", F.lit(5.0)))
    assert {round(r["prediction"], 9) for r in flat.transform(df).collect()} == {5.0}
    with pytest.raises(ValueError):
        models.leaf_wise_trees(0, 2).fit(df.limit(0))


def test_dense_and_sparse_vectors_in_one_batch(spark):
    x, y = table(60, sparse=True)
    both = frame(spark, x[:30], y[:30]).union(frame(spark, x[30:], y[30:], True)).repartition(1)
    model = models.leaf_wise_trees(0, 1).fit(both)
    got = sorted(round(r["prediction"], 9) for r in model.transform(both).collect())
    assert got == sorted(round(float(v), 9) for v in model.outputs(x)[:, 0])


def test_boosted_members_do_not_depend_on_partitions(spark):
    x, y = table(200)
    df, found = frame(spark, x, np.digitize(y, [0, 8]).astype(float)).withColumnRenamed("label", "y"), []
    for n in (1, 5):
        suite = Suite([Member("b", lambda rows: models.boosted_classes(3, 3, 3, 0.3, 0.8, 0.8)), Member("l", lambda rows: models.leaf_wise_trees(3, 3))], partitions=4)
        wide = suite.fit(df.repartition(n), "k").predict_wide(df).orderBy("k")
        found.append([(r["b"], r["l"]) for r in wide.collect()])
        assert suite.failures == {}
    assert found[0] == found[1]


# ---- Shapley values ---------------------------------------------------------


def all_coalitions(f, x, background):
    """Exact values of f (dense rows -> rows x outputs) for one row."""
    m = len(x)
    masks = list(itertools.product([False, True], repeat=m))
    v = {s: f(np.where(s, x, background)).mean(axis=0) for s in masks}
    phi = np.zeros((len(v[masks[0]]), m))
    for j in range(m):
        for s in masks:
            if not s[j]:
                k = sum(s)
                phi[:, j] += math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (v[s[:j] + (True,) + s[j + 1 :]] - v[s])
    return phi


def spark_outputs(spark, model, column):
    def f(rows):
        df = spark.createDataFrame([(i, Vectors.dense(r.tolist())) for i, r in enumerate(rows)], ["i", "features"])
        out = model.transform(df).orderBy("i").collect()
        return np.array([np.atleast_1d(r[column].toArray() if hasattr(r[column], "toArray") else r[column]) for r in out])

    return f


@pytest.mark.parametrize("kind", ["forest", "classes", "boosted", "binary", "per_class", "leaf_wise", "softmax"])
def test_tree_values_equal_all_coalitions(spark, kind):
    m = 8 if kind in ("forest", "softmax") else 5
    x, y = table(150, m, 3)
    df, labels = frame(spark, x, y), np.digitize(y, [-2, 6]).astype(float)
    coded = frame(spark, x, labels)
    two = frame(spark, x, (y > 2).astype(float))
    model, column = {
        "forest": lambda: (models.forest_regressor(4, 6).fit(df), "prediction"),
        "classes": lambda: (models.forest_classifier(4, 5).fit(coded), "probability"),
        "boosted": lambda: (models.boosted_regressor(4, 3).fit(df), "prediction"),
        "binary": lambda: (models.boosted_classifier(3, 3).fit(two), "rawPrediction"),
        "per_class": lambda: (models.per_class(models.boosted_classifier(2, 3)).fit(coded), "rawPrediction"),
        "leaf_wise": lambda: (models.leaf_wise_trees(0, 3).fit(df), "prediction"),
        "softmax": lambda: (models.boosted_classes(3, 2, 4).fit(coded), None),
    }[kind]()
    nodes = tree_shapley.tree_table(model)
    if column:
        assert nodes.score(x[:20]) == pytest.approx(spark_outputs(spark, model, column)(x[:20]), abs=1e-9)
    names = [f"f{j}" for j in range(m)]
    background = tree_shapley.background_rows(df.where("k >= 100"), "k", "features", 6)
    got = tree_shapley.shapley_trees(df.where("k in (1, 2)"), "k", names, model, background).collect()
    assert len(got) == 2 * m * nodes.value.shape[1]
    told = {(r["k"], r["cls"], r["feature"]): r["phi"] for r in got}
    for k in (1, 2):
        want = all_coalitions(nodes.score, x[k], np.stack(background))
        assert np.array([[told[k, c, f] for f in names] for c in range(len(want))]) == pytest.approx(want, abs=1e-9)
        assert want.sum(axis=1) == pytest.approx(nodes.score(x[k : k + 1])[0] - tree_shapley.mean_output(nodes, background), abs=1e-9)


def test_trees_of_other_models_and_of_one_leaf(spark):
    x, y = table(40)
    with pytest.raises(TypeError):
        tree_shapley.tree_table(models.logistic(40, 5).fit(frame(spark, x, (y > 0).astype(float))))
    flat = models.forest_regressor(2, 3).fit(frame(spark, x, np.ones(40)))
    got = tree_shapley.shapley_trees(frame(spark, x, y).limit(3), "k", list("abcd"), flat, [x[0]]).collect()
    assert len(got) == 12 and all(r["phi"] == 0 for r in got)


@pytest.mark.parametrize("classes", [2, 3])
def test_sparse_values_of_a_linear_model(spark, classes):
    x, y = table(200, 5, 7, sparse=True)
    y = np.digitize(y, np.quantile(y, [i / classes for i in range(1, classes)])).astype(float)
    df = frame(spark, x, y, sparse=True)
    model = models.logistic(200, 30).fit(df)
    background = tree_shapley.background_rows(df.where("k >= 100"), "k", "features", 8)
    names = list("abcde")
    got = sparse_shapley.shapley_logistic(df.where("k < 2"), "k", names, model, background, pairs=150).collect()
    told = {(r["k"], r["cls"], r["feature"]): r["phi"] for r in got}
    f = spark_outputs(spark, model, "probability")
    for k in (0, 1):
        want = all_coalitions(f, x[k], np.stack(background))
        mine = np.array([[told[k, c, n] for n in names] for c in range(classes)])
        assert mine == pytest.approx(want, abs=0.01)
        assert mine.sum(axis=1) == pytest.approx(f(x[k : k + 1])[0] - f(np.stack(background)).mean(axis=0), abs=1e-9)


def test_kernel_values_equal_exact_ones(spark):
    names = ["x0", "x1", "x2", "x3"]
    x, y = table(60, 4, 9)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], ["k", *names, "label"])
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    model = models.forest_classifier(3, 4).setLabelCol("c").fit(vectors.withColumn("c", (F.col("label") > 3).cast("double")))
    bg, score, rows = shapley.background(df, names, "k", 4), shapley.probability_output(model), df.where("k < 3")
    exact = {(r["k"], r["cls"], r["feature"]): r["phi"] for r in shapley.shapley_model(rows, "k", names, score, bg).collect()}
    got = {(r["k"], r["cls"], r["feature"]): r["phi"] for r in kernel_shapley.shapley_kernel(rows, "k", names, score, bg).collect()}
    assert got.keys() == exact.keys() and all(got[i] == pytest.approx(exact[i], abs=1e-6) for i in exact)
    one = kernel_shapley.shapley_kernel(rows.select("k", "x0"), "k", ["x0"], lambda d: d.withColumn("out", F.array(F.lit(2.0))), shapley.background(df, ["x0"], "k", 4)).collect()
    assert [r["phi"] for r in one] == [0.0] * 3


def test_kernel_values_of_drawn_coalitions(spark):
    z, weight = kernel_shapley.coalitions(12, 200)
    assert len(z) == len(weight) <= 200 and set(map(tuple, z)) == {tuple(1 - r) for r in z} and (z.sum(axis=1) % 12 > 0).all()
    w = np.arange(12) - 4.0
    assert kernel_shapley.solve(z, weight, z @ w + 3, 3.0, 3 + w.sum()) == pytest.approx(w, abs=1e-8)
    names = [f"x{j}" for j in range(12)]
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(8, 12)))], ["k", *names])
    linear = lambda d: d.withColumn("out", F.array(F.aggregate(F.zip_with(shapley.vector_to_array("features"), F.lit(w.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)))
    phi = kernel_shapley.shapley_kernel(df.where("k = 0"), "k", names, linear, shapley.background(df, names, "k", 8), most=100).collect()
    x = np.array([r[1:] for r in df.orderBy("k").collect()])
    assert {r["feature"]: r["phi"] for r in phi} == pytest.approx({f: w[j] * (x[0, j] - x[:, j].mean()) for j, f in enumerate(names)}, abs=1e-8)


# ---- several columns at once ------------------------------------------------


@pytest.mark.parametrize("finish", [1, 7, 1_000_000])
def test_medians_of_all_columns(spark, finish):
    rng = np.random.default_rng(1)
    rows = [(float(a), int(b), None if i % 3 else float(c), None, float("nan") if i % 5 else 4.0) for i, (a, b, c) in enumerate(zip(rng.normal(size=400), rng.integers(0, 4, 400), rng.normal(size=400)))]
    df = spark.createDataFrame(rows, "`a.b` double, b int, c double, d double, e double")
    got = ranks.exact_medians(df, df.columns, finish)
    for i, c in enumerate(df.columns):
        values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        assert got[c] == (pytest.approx(float(np.median(values))) if values else None)
    assert ranks.exact_medians(df, []) == {} and ranks.exact_medians(df.limit(0), ["b"]) == {"b": None}


@pytest.mark.parametrize("small", [True, False])
def test_one_dictionary_for_all_text_columns(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(ranks, "fetch_small", lambda df: None)
        monkeypatch.setattr(clean, "fetch_small", lambda df: None)
    rows = [("b", "x", 1), ("a", None, 2), (None, "x", 3), ("c", "yy", 4), ("a", "nan", 5)]
    df = spark.createDataFrame(rows, "`t.1` string, u string, k int")
    got = clean.label_encode_all(df, ["t.1", "u"], fit_on=df.where("k < 5")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (0, 0, 2), (3, 1, 3), (2, 2, 4), (0, 0, 5)]
    assert clean.label_encode_all(df, []) is df


def test_importance_of_boosted_members(spark):
    x, y = table(120)
    model = models.leaf_wise_trees(0, 3).fit(frame(spark, x, y))
    got = importance.native(spark, {"l": model}, list("abcd")).collect()
    assert {r["source"] for r in got} == {"native"} and max(got, key=lambda r: r["importance"])["feature"] == "a"


def test_equal_rows_move_together_and_give_the_same_trees(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (400, 2)).astype(float)
    number = x[:, 0] + rng.normal(size=400)
    for classes, y in ((0, number), (3, rng.integers(0, 3, 400).astype(float))):
        growth, df = Growth(classes, 2, 0.3, 5, None, least_rows=5), frame(spark, x, y)
        seen, added_up = [], boosting._added_up
        with monkeypatch.context() as m:
            m.setattr(boosting, "_added_up", lambda state, *rest: seen.append(added_up(state, *rest)) or seen[-1])
            together = Booster(growth).fit(df).table.score(x)
        rows = seen[0].agg(F.count("*"), F.sum("n")).first()
        assert rows[0] <= 9 * max(classes, 1) and rows[1] == 400
        with monkeypatch.context() as m:
            m.setattr(boosting, "DIFFERENT", 0.0)
            assert Booster(growth).fit(df).table.score(x) == pytest.approx(together, abs=1e-9)


def test_many_rows_are_scored_and_explained_together(spark, monkeypatch):
    x, y = table(200)
    df = frame(spark, x, y)
    model, calls = models.leaf_wise_trees(0, 2).fit(df), []
    paths = tree_shapley.LeafPaths(model.tree_table())
    met = np.stack([paths.inside(b) for b in x[:7]])
    assert tree_shapley.few_sets(paths)
    want = np.stack([paths.values(row, met, 4) for row in x])
    assert tree_shapley.LeafTables(paths, met, 4).values(x) == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(tree_shapley, "explain_rows", lambda *a: calls.append(a))
    got = tree_shapley.shapley_trees(df, "k", list("abcd"), model, list(x[:7])).orderBy("k", "feature").collect()
    assert not calls and [r["phi"] for r in got] == pytest.approx(want.ravel().tolist(), abs=1e-12)
    matrices = [m for _, m in tree_shapley.dense_matrices(df.coalesce(1).select(F.unwrap_udt("features").alias("v")).toArrow()["v"].combine_chunks(), 1 << 20)]
    assert len(matrices) == 1 and matrices[0] == pytest.approx(x)
