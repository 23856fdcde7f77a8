"""Deep forests: passes over all rows and tasks that finish a node grow the same trees; large forests are explained by groups of trees."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabscore.operators import forest, models, tree_shapley
from tabscore.plans import q_explain


def rows(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, (n, 5)).astype(float)
    y = ((x[:, 0] > 20).astype(int) + (x[:, 1] > 30)).astype(float)
    y[::11] = rng.integers(0, 3, len(y[::11]))
    return x, y, spark.createDataFrame([(i, Vectors.dense(r.tolist()), float(c)) for i, (r, c) in enumerate(zip(x, y))], ["k", "features", "label"]).coalesce(2)


def test_passes_and_tasks_grow_the_same_trees(spark, monkeypatch):
    x, y, df = rows(spark)
    whole = forest.Forest(6, 30).fit(df)
    monkeypatch.setattr(forest, "NODE_ROWS", 40)
    monkeypatch.setattr(forest, "PASS_NODES", 5)
    split = forest.Forest(6, 30).fit(df)
    assert split.table.score(x) == pytest.approx(whole.table.score(x), abs=1e-12)
    assert len(split.table.feature) == len(whole.table.feature) and list(split.featureImportances) == pytest.approx(list(whole.featureImportances))
    p = whole.table.score(x)
    assert p.sum(axis=1) == pytest.approx(1) and (p.argmax(axis=1) == y).mean() > 0.85
    got = [(r["prediction"], r["probability"].toArray()) for r in whole.transform(df).orderBy("k").collect()]
    assert [g[0] for g in got] == p.argmax(axis=1).tolist() and np.array([g[1] for g in got]) == pytest.approx(p)


def test_a_tree_splits_as_told(spark):
    x, y, _ = rows(spark, 80, 3)
    dense, w = x.astype(np.int64), forest.bag(np.arange(80), 0, 1).astype(float)
    part = forest.grow(dense[w > 0], y[w > 0].astype(np.int64), w[w > 0], np.uint64(5), 3, 5, 41, 3)
    own, counts, weight = dense[w > 0], y[w > 0].astype(int), w[w > 0]

    def gini(m):
        c = np.bincount(counts[m], weight[m], 3)
        return c.sum() - (c**2).sum() / c.sum()

    def check(node, m, depth):
        assert part.counts[node] == pytest.approx(np.bincount(counts[m], weight[m], 3))
        gains = [gini(m) - gini(m & (own[:, f] <= t)) - gini(m & (own[:, f] > t)) for f in range(5) for t in np.unique(own[m, f])[:-1]]
        if part.left[node] < 0:
            assert depth == 3 or max(gains, default=0) < 1e-9
            return
        left = m & (own[:, part.feature[node]] <= part.cut[node])
        assert gini(m) - gini(left) - gini(m & ~left) == pytest.approx(max(gains))
        check(part.left[node], left, depth + 1)
        check(part.right[node], m & ~left, depth + 1)

    check(0, np.ones(len(own), bool), 0)


def test_groups_of_trees_give_the_values_of_all(spark, monkeypatch):
    x, _, df = rows(spark)
    table, names = forest.Forest(6, 30).fit(df).tree_table(), list("abcde")
    explain = lambda: [r["phi"] for r in tree_shapley.shapley_trees(df.where("k < 20"), "k", names, table, list(x[50:60])).orderBy("k", "cls", "feature").collect()]
    want = explain()
    monkeypatch.setattr(tree_shapley, "LEAVES_AT_ONCE", 30)
    assert len(list(tree_shapley.some_trees(table, 30))) > 2
    assert explain() == pytest.approx(want, abs=1e-12)
    sums = np.array(want).reshape(20, 3, 5).sum(axis=2)
    assert sums == pytest.approx(table.score(x[:20]) - table.score(x[50:60]).mean(axis=0), abs=1e-9)


def test_class_probabilities_come_from_a_full_deep_forest(spark, sf, monkeypatch):
    made, deep = [], models.deep_forest
    monkeypatch.setattr(q_explain.models, "deep_forest", lambda *a: made.append(deep(*a)) or made[-1])
    phi = q_explain.shapley_class_prob(q_explain_tables(spark, sf))
    assert (made[0].trees, made[0].depth, made[0].bins) == (100, models.MAX_DEPTH, models.BINS)
    found = phi.agg(F.countDistinct("row_id"), F.countDistinct("cls"), F.countDistinct("feature")).first()
    assert found[0] >= 1 and found[1] > 2 and found[2] == 64


def q_explain_tables(spark, sf):
    from tabscore.sources.tables import Tables

    return Tables(spark, sf)
