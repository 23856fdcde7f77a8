"""Fits that read rows that agree once, fits that the driver goes on with, and the sizes of two queries."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabscore.operators import boosting, models, shapley
from tabscore.operators.boosting import Booster, Growth
from tabscore.operators.models import Member, Suite
from tabscore.plans import q_models, q_suites
from tabscore.sources.tables import Tables


def repeated(spark, n=400):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (n, 2)).astype(float)
    z = x[:, 0] - 0.7 * x[:, 1] + rng.normal(size=n)
    vectors = [Vectors.dense(r.tolist()) if i % 2 else Vectors.sparse(2, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(x)]
    return spark.createDataFrame([(i, v, float(a), float(a > 0.5)) for i, (v, a) in enumerate(zip(vectors, z))], ["k", "features", "y", "c"])


MEMBERS = [
    Member("forest", lambda n: models.forest_classifier(1, 3).setBootstrap(False), "features", "c"),
    Member("boosted", lambda n: models.boosted_classes(2, 3, 2), "features", "c"),
    Member("alt", lambda n: models.leaf_wise_trees(2, 3, 3), "features", "c"),
    Member("linear", lambda n: LogisticRegression(regParam=0.01, maxIter=50), "features", "c"),
    Member("number", lambda n: models.boosted_regressor(4, 2)),
    Member("number_alt", lambda n: models.leaf_wise_trees(0, 4, 3)),
    Member("bagged", lambda n: models.forest_regressor(3, 3)),
]


def test_rows_that_agree_are_read_once_with_the_same_result(spark, monkeypatch):
    df, seen, cells = repeated(spark), [], models._cells
    monkeypatch.setattr(models, "_cells", lambda *a: seen.append(cells(*a)) or seen[-1])
    once = Suite(MEMBERS).fit(df, "k")
    assert once.failures == {} and once.repeated == {"features"}
    # Nine points in two forms: with the class, and alone with the mean number.
    assert sorted(d.count() <= 36 and d.agg(F.sum(models.COUNT)).first()[0] for d in seen) == [400, 400]
    with monkeypatch.context() as m:
        m.setattr(models, "CELLS_SHARE", 0.0)
        each = Suite(MEMBERS).fit(df, "k")
    assert each.repeated == set() and len(seen) == 2
    found, want = ([tuple(round(r[m.name], 6) for m in MEMBERS) for r in s.predict_wide(df).orderBy("k").collect()] for s in (once, each))
    assert len(found) == 400 and found == want


def test_fits_that_draw_rows_read_each_row():
    assert models.reads_cells(models.forest_classifier(3, 3)) is None
    assert models.reads_cells(models.boosted_classes(3, rows=0.8)) is None
    assert models.reads_cells(models.boosted_regressor_alt()) is None
    with pytest.raises(ValueError):
        models.boosted_classes(3, rows=0.8).setWeightCol("n").fit(_Frame())


class _Frame:
    """Enough of a table to be asked for its session."""

    class sparkSession:
        class sparkContext:
            environment: dict = {}


@pytest.mark.parametrize("growth", [Growth(0, 6, 0.3, 6, None, least_rows=5), Growth(3, 6, 0.3, None, 3, l2=1.0, least_rows=1, rows=0.8, columns=0.8)], ids=str)
def test_held_rows_handed_sums_and_dealt_blocks_give_the_same_trees(spark, monkeypatch, growth):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = x[:, 0] - x[:, 1] if growth.classes == 0 else np.digitize(x[:, 0], [-0.5, 0.5]).astype(float)
    df = spark.createDataFrame([(Vectors.dense(r.tolist()), float(v)) for r, v in zip(x, y)], ["features", "label"]).coalesce(2)
    states, grow = [], boosting._grow
    monkeypatch.setattr(boosting, "_grow", lambda state, *rest: states.append(type(state)) or grow(state, *rest))
    held = Booster(growth).fit(df).table.score(x)
    assert set(states) == {boosting.Held}
    for sums in (boosting.HANDED_SUMS, 0):
        monkeypatch.setattr(boosting, "HELD_CELLS", 0)
        monkeypatch.setattr(boosting, "HANDED_SUMS", sums)
        assert Booster(growth).fit(df).table.score(x) == pytest.approx(held, abs=1e-12)
    assert states[-1] is not boosting.Held


def test_two_features_have_their_orders_in_one_pair(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, -1.0, 0.5)], ["k", "a", "b"])
    bg = F.lit([[0.0, 0.0], [1.0, 1.0]])
    score = lambda d: d.withColumn("out", F.array(F.lit(0.0) + F.get(F.unwrap_udt("features")["values"], F.lit(0)) * F.get(F.unwrap_udt("features")["values"], F.lit(1))))
    one, ten = ({(r.k, r.feature): round(r.phi, 9) for r in shapley.shapley_sampled(df, "k", ["a", "b"], score, bg, n).collect()} for n in (1, 10))
    assert one == ten and len(one) == 4


def test_softmax_boosting_draws_rows_and_columns_for_200_rounds(monkeypatch):
    made = []
    monkeypatch.setattr(q_models, "flags_table", lambda t: None)
    monkeypatch.setattr(q_models, "fit_and_predict", lambda df, members, keep: made.extend(members))
    q_models.gbt_classification(None)
    g = made[0].make(100).growth
    assert (g.classes, g.rounds, g.depth, g.rate, g.rows, g.columns) == (3, 200, 6, 0.1, 0.8, 0.8)


def test_the_enrolment_runs_with_its_published_sizes(spark, sf, monkeypatch):
    seen = {}
    monkeypatch.setattr(q_suites.benchmarks, "long_result", lambda r: r)
    monkeypatch.setattr(q_suites.benchmarks, "models", _Noted(models, seen))
    monkeypatch.setattr(q_suites.benchmarks, "Suite", lambda members: [m.make(10) for m in members] and _stop())
    with pytest.raises(InterruptedError):
        q_suites.enrolment_suite(Tables(spark, sf))
    assert seen["forest_regressor"][0] == 100 and seen["forest_regressor"][1] == models.MAX_DEPTH
    assert seen["boosted_regressor"][:2] == (100, 6) and seen["leaf_wise_trees"] == (0, 100) and seen["logistic"] == (10, 500)


def _stop():
    raise InterruptedError


class _Noted:
    def __init__(self, inner, seen):
        self.inner, self.seen = inner, seen

    def __getattr__(self, name):
        found = getattr(self.inner, name)
        return (lambda *a, **k: self.seen.update({name: a}) or found(*a, **k)) if callable(found) else found
