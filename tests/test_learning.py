"""TF-IDF, Shapley values, model suites and the ready-made benchmarks."""

import itertools
import math

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabscore.operators import importance, models, shapley, tfidf
from tabscore.operators.models import Member, Suite
from tabscore.plans import benchmarks
from tabscore.plans.benchmarks import Effort
from tabscore.plans.roles import PRIORITIES
from tabscore.sources.tables import Tables

SMALL = Effort(trees=3, tree_depth=3, rounds=2, depth=3, iterations=8, background=5, pairs=1)


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa")], "doc long, text string")
    model = tfidf.fit_tfidf(docs, "text", stop_words=[])
    assert model.vocabulary == ["aa", "aa bb", "bb"]
    assert model.idf == pytest.approx([1.0, 1.405465, 1.405465], abs=1e-6)
    w = {(r["doc"], r["term"]): r["weight"] for r in model.weights(docs, "doc", "text").collect()}
    assert w[2, "aa"] == 1.0
    assert sum(v * v for (d, _), v in w.items() if d == 1) == pytest.approx(1.0)
    vec = {r["doc"]: r["tfidf"].toArray() for r in model.vectors(docs, "text").collect()}
    for d in (1, 2):
        assert [w.get((d, t), 0.0) for t in model.vocabulary] == pytest.approx(list(vec[d]))


def test_vocabulary_ties_go_to_the_first_term(spark):
    docs = spark.createDataFrame([("bb aa",)], "text string")
    top = tfidf.top_terms(tfidf.term_totals(docs, "text", []), 2)
    assert [r["term"] for r in top.collect()] == ["aa", "bb"]


def _bg(spark, values):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "k long, " + ", ".join(f"x{j} double" for j in range(len(values[0]))))
    return shapley.background(df, [f"x{j}" for j in range(len(values[0]))], "k", len(values))


def test_exact_shapley_by_hand(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 1.0)], "k long, x0 double, x1 double, x2 double")
    bg = _bg(spark, [(0.0, 0.0, 0.0)])
    phi = shapley.shapley_exact(df, "k", ["x0", "x1", "x2"], lambda x: x[0] * x[1] + 2 * x[2], bg)
    assert {r["feature"]: r["phi"] for r in phi.collect()} == pytest.approx({"x0": 3, "x1": 3, "x2": 2})


def test_linear_shapley_by_hand(spark):
    fit = spark.createDataFrame([(1.0, 1.0)], "a double, b double")
    df = spark.createDataFrame([(7, 3.0, 0.0)], "k long, a double, b double")
    phi = shapley.shapley_linear(df, "k", ["a", "b"], {"a": 1.0, "b": -2.0}, fit)
    assert {r["feature"]: r["phi"] for r in phi.collect()} == {"a": 2.0, "b": 2.0}


@pytest.fixture(scope="module")
def planted(spark):
    df = spark.range(400).select(
        F.col("id").alias("k"),
        *[(F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / 100.0).alias(f"x{j}") for j in range(4)],
    )
    df = df.withColumn("y", 3 * F.col("x0") - 2 * F.col("x1") + F.col("x0") * F.col("x2") * 0.5)
    df = df.withColumn("is_train", F.col("k") < 300)
    return VectorAssembler(inputCols=["x0", "x1", "x2", "x3"], outputCol="features").transform(df)


FEATURES = ["x0", "x1", "x2", "x3"]


@pytest.fixture(scope="module")
def forest(planted):
    return models.forest_regressor(5, 4).setLabelCol("y").fit(planted.where("is_train"))


def _predict(model, spark, points):
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "i long, x0 double, x1 double, x2 double, x3 double")
    out = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df))
    return [r["prediction"] for r in out.orderBy("i").collect()]


def test_model_shapley_against_brute_force(spark, planted, forest):
    test = planted.where("k in (301, 302)")
    bg = shapley.background(planted.where("is_train"), FEATURES, "k", 3)
    phi = shapley.shapley_model(test, "k", FEATURES, shapley.prediction_output(forest), bg)
    got = {(r["k"], r["feature"]): r["phi"] for r in phi.collect()}
    back = spark.range(1).select(bg.alias("b")).first()["b"]
    for row in test.collect():
        x = [row[f] for f in FEATURES]
        masks = list(itertools.product([0, 1], repeat=4))
        points = [[x[j] if m[j] else b[j] for j in range(4)] for m in masks for b in back]
        flat = _predict(forest, spark, points)
        v = {m: sum(flat[i * 3 : i * 3 + 3]) / 3 for i, m in enumerate(masks)}
        for j, f in enumerate(FEATURES):
            want = sum(
                math.factorial(sum(m)) * math.factorial(3 - sum(m)) / 24 * (v[m[:j] + (1,) + m[j + 1 :]] - v[m])
                for m in masks if not m[j]
            )
            assert got[row["k"], f] == pytest.approx(want, abs=1e-9)
        assert sum(got[row["k"], f] for f in FEATURES) == pytest.approx(v[1, 1, 1, 1] - v[0, 0, 0, 0], abs=1e-9)


def test_sampled_shapley_sums_up_and_ignores_unused(spark, planted):
    class Linear:
        def transform(self, df):
            from pyspark.ml.functions import vector_to_array

            a = vector_to_array("features")
            return df.withColumn("prediction", 3 * a[0] - 2 * a[1] + a[2])

    test = planted.where("k between 300 and 304")
    bg = _bg(spark, [(1.0, 1.0, 1.0, 1.0)])
    phi = shapley.shapley_sampled(test, "k", FEATURES, shapley.prediction_output(Linear()), bg, pairs=2)
    got = {(r["k"], r["feature"]): r["phi"] for r in phi.collect()}
    for r in test.collect():
        assert got[r["k"], "x0"] == pytest.approx(3 * (r["x0"] - 1))
        assert got[r["k"], "x3"] == pytest.approx(0)
        total = sum(got[r["k"], f] for f in FEATURES)
        assert total == pytest.approx(3 * (r["x0"] - 1) - 2 * (r["x1"] - 1) + r["x2"] - 1)


def test_class_reduction(spark):
    phi = spark.createDataFrame([(1, 0, "a", -2.0), (1, 1, "a", 4.0)], "k long, cls int, feature string, phi double")
    assert shapley.reduce_classes(phi, "class").first()["phi"] == 4.0
    assert shapley.reduce_classes(phi, "mean_abs").first()["phi"] == 3.0
    with pytest.raises(ValueError):
        shapley.reduce_classes(phi, "other")


def test_bounds_are_checked(spark):
    df = spark.range(3).withColumn("x0", F.lit(1.0))
    with pytest.raises(ValueError):
        shapley.background(df, ["x0"], "id", 5000)
    with pytest.raises(ValueError):
        shapley.shapley_exact(df, "id", ["x0"] * 11, lambda x: x[0], F.lit(None))


def test_importance_tables(spark):
    imp = spark.createDataFrame(
        [("m", "a", 1.0), ("m", "b", 2.0), ("m", "c", 2.0), ("n", "a", 0.0)], "model string, feature string, importance double"
    )
    top = {r["model"]: r["feature"] for r in importance.top_k(imp, ["model"], 1).collect()}
    assert top == {"m": "b", "n": "a"}
    assert importance.top_label(imp).where("model = 'm'").first()["label"] == "m\n(b)"
    assert importance.matrix(imp, ["a", "b"]).where("model = 'n'").first()["b"] is None
    assert importance.as_json(imp).where("model = 'n'").first()["json"] == '{"a":0.0}'


@pytest.mark.parametrize(
    "member",
    [
        Member("rf", lambda n: models.forest_regressor(10, 6)),
        Member("gbt", lambda n: models.boosted_regressor(10, 4, 0.3)),
        Member("gbt2", lambda n: models.boosted_regressor_alt(10, 5, 0.3)),
    ],
    ids=lambda m: m.name,
)
def test_regressors_beat_the_mean(planted, member):
    suite = Suite([member]).fit(planted.where("is_train"))
    preds = suite.predict(planted.where("not is_train"), ["y"])
    r = preds.agg((1 - F.sum((F.col("y") - F.col("pred")) ** 2) / (F.var_pop("y") * F.count("y"))).alias("r2")).first()
    assert r["r2"] > 0.5


@pytest.mark.parametrize(
    "name, make",
    [
        ("lr", lambda n: models.logistic(n, 50)),
        ("rf", lambda n: models.forest_classifier(10, 5)),
        ("gbt", lambda n: models.boosted_for(3, models.boosted_classifier(3, 3, 0.3))),
        ("gbt2", lambda n: models.boosted_for(2, models.boosted_classifier_alt(3, 3, 0.3))),
    ],
)
def test_classifiers_beat_the_majority(planted, name, make):
    cuts = 1 if name == "gbt2" else 2
    df = planted.withColumn("y", F.least(F.floor(F.col("x0") / (10 / (cuts + 1))), F.lit(cuts)).cast("double"))
    suite = Suite([Member(name, make)]).fit(df.where("is_train"))
    acc = suite.predict(df.where("not is_train"), ["y"]).agg(F.avg((F.col("y") == F.col("pred")).cast("int"))).first()[0]
    assert acc > 0.75


def test_failing_member_is_reported(spark, planted):
    suite = Suite([Member("bad", lambda n: models.forest_regressor(2, 2), "nope"), Member("ok", lambda n: models.forest_regressor(2, 2))])
    suite.fit(planted.where("is_train"))
    assert suite.names == ["ok"] and "nope" in suite.failures["bad"]
    assert suite.failure_table(spark).count() == 1


def test_native_importance(spark, planted, forest):
    lr = models.logistic(300, 10).setLabelCol("c").fit(planted.withColumn("c", (F.col("y") > 10).cast("double")))
    got = importance.native(spark, {"rf": forest, "lr": lr, "none": object()}, FEATURES)
    assert {r["model"]: r["source"] for r in got.collect()} == {"rf": "native", "lr": "coefficients", "none": "N/A"}


def _check(result, models_=4):
    assert result.failures == {}
    assert result.metrics.count() == models_
    assert result.fairness.count() == models_
    assert result.readiness.where("total_score is null").count() == 0


def test_score_benchmark(spark, sf):
    t = Tables(spark, sf)
    df = t.orders.select(
        F.round(F.col("o_totalprice") / 50_000).alias("Exam_Score"), "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_custkey",
    )
    r = benchmarks.score_benchmark(df, key="o_orderkey", effort=SMALL)
    _check(r)
    assert {x["feature"] for x in r.importance.collect()} == {"status", "o_custkey"}


def test_statistics_of_all_rows(spark):
    df = spark.createDataFrame([(1.0, True), (3.0, False)], "x double, is_train boolean")
    for fit_on, want in (("train", [0.0, 2.0]), ("all", [-1.0, 1.0])):
        out = benchmarks.two_vectors(df, ["x"], fit_on).orderBy("x").collect()
        assert [r["scaled_features"][0] for r in out] == want


def test_one_model_per_class_states_its_importance(spark, planted):
    df = planted.withColumn("c", F.floor(F.col("x0") / 4).cast("double"))
    model = models.per_class(models.boosted_classifier(2, 2)).setLabelCol("c").fit(df)
    top = importance.top_k(importance.native(spark, {"m": model}, FEATURES), ["model"], 1).first()
    assert top["feature"] == "x0" and top["source"] == "native"


def test_rank_benchmark(spark, sf):
    t = Tables(spark, sf)
    names = benchmarks.RANK_FEATURES
    df = t.part.select(
        F.col("p_name").alias("Name"), F.col("p_brand").alias("Country"), (F.lit(2020) + F.col("p_partkey") % 4).alias("Year"),
        (F.col("p_size") * 10).alias("Rank"),
        *[F.when(F.col("p_partkey") % 17 == 0, "n/a").otherwise((F.col("p_retailprice") + i).cast("string")).alias(f) for i, f in enumerate(names)],
    )
    r = benchmarks.rank_benchmark(df, effort=Effort(trees=3, tree_depth=3, rounds=2, depth=3, iterations=8, background=3))
    _check(r)
    assert r.importance.count() == 24


def test_enrolment_benchmark(spark, sf):
    t = Tables(spark, sf)
    wide = (
        t.orders.groupBy("o_orderkey", F.col("o_orderstatus").alias("Type")).pivot("o_orderpriority", PRIORITIES)
        .agg(F.sum("o_totalprice")).toDF("k", "Type", "1995", "1996", "1997", "1998", "1999").drop("k")
    )
    r = benchmarks.enrolment_benchmark(wide, effort=SMALL)
    _check(r)
    assert r.extra["importance_matrix"].count() == 4


def test_class_benchmark(spark, sf):
    t = Tables(spark, sf)
    df = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("Target"), "o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    r = benchmarks.class_benchmark(df, key="o_orderkey", effort=SMALL)
    _check(r)
    assert r.extra["regression"].count() == 4 and r.extra["top_features"].count() == 8


def test_label_benchmark(spark, sf):
    t = Tables(spark, sf)
    df = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.col("n_chars").cast("double").alias("FTE"), F.nullif("lang", F.lit("de")).alias("Text_1"),
        F.col("text").alias("Text_2"), F.col("quality").cast("string").alias("Function"), F.col("lang").alias("Use"),
    )
    r = benchmarks.label_benchmark(df, key="doc_id", max_features=50, effort=SMALL)
    _check(r, 8)
    assert set(r.metrics.columns) >= {"label", "model", "accuracy", "f1"}
    assert r.extra["top_features"].where("rank = 1").count() == 8


def test_profile_benchmark(spark, sf):
    t = Tables(spark, sf)
    out = benchmarks.profile_benchmark({"orders": t.orders, "labels": t.labels}, tasks={"orders": ("o_totalprice", "Regression")})
    assert out["summary"].count() == 2 and out["diversity"].count() == 2
    assert out["missing_total"].agg(F.sum("missing")).first()[0] == 0


class LinearScore:
    """2 x0 - x1 + 0.5 x2 as a score function."""

    def __call__(self, df):
        v = vector_to_array("features")
        return df.withColumn("out", F.array(2 * v[0] - v[1] + 0.5 * v[2]))


def test_sampled_shapley_is_unbiased_and_complete(spark):
    df = spark.range(60).select(
        F.col("id").alias("k"), *[(F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / 100.0).alias(f"x{j}") for j in range(2)], F.lit(4.0).alias("x2")
    )
    names = ["x0", "x1", "x2"]
    bg = shapley.background(df, names, "k", 60)
    phi = shapley.shapley_sampled(df, "k", names, LinearScore(), bg, pairs=1)
    assert phi.count() == 180  # a feature that never differs has a value too
    got = {r.feature: r.importance for r in importance.mean_abs(phi, []).collect()}
    want = {r.feature: r.importance for r in importance.mean_abs(shapley.shapley_linear(df, "k", names, {"x0": 2.0, "x1": -1.0, "x2": 0.5}, df), []).collect()}
    assert all(abs(got[f] - want[f]) <= 0.01 * want[f] + 1e-12 for f in names)


def test_a_repeated_key_is_explained_row_by_row(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 2.0), (2, 0.0, 1.0)], "k long, x0 double, x1 double").withColumn("x2", F.lit(0.0))
    names = ["x0", "x1", "x2"]
    bg = shapley.background(df, names, "k", 3)
    for phi in (shapley.shapley_model(df, "k", names, LinearScore(), bg), shapley.shapley_sampled(df, "k", names, LinearScore(), bg, pairs=1)):
        found = sorted((r.k, r.feature, round(r.phi, 9)) for r in phi.where("feature <> 'x2'").collect())
        assert found == [(1, "x0", round(2 / 3, 9))] * 2 + [(1, "x1", round(-1 / 3, 9))] * 2 + [(2, "x0", round(-4 / 3, 9)), (2, "x1", round(2 / 3, 9))]


def small_result(spark, explain="sampled"):
    df = spark.range(240).select(
        F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(7)) + F.lit(0.0)).alias("a"), F.concat(F.lit("t"), F.col("id") % 3).alias("b"),
        (F.col("id") % 2 == 0).alias("flag"), F.current_timestamp().alias("at"), F.when(F.col("id") % 9 == 0, float("nan")).otherwise(F.col("id") % 5).alias("c"),
        F.round(F.pmod(F.xxhash64("id"), F.lit(7)) / 2).alias("Exam_Score"),
    )
    effort = benchmarks.Effort(trees=3, tree_depth=3, rounds=2, depth=2, iterations=5, background=5, pairs=1, explain=explain)
    return benchmarks.score_benchmark(df, key="k", effort=effort)


def test_a_result_is_written_and_long(spark, tmp_path):
    from tabscore.sources import csvio

    r = small_result(spark)
    long = benchmarks.long_result(r).toPandas()
    assert set(long.part) == {"metrics", "fairness", "readiness", "importance"} and long.model.nunique() == 4
    # Booleans and timestamps are no features; NaN is missing and filled.
    assert set(long[long.part == "importance"].name) == {"a", "b", "c"}
    folders = benchmarks.write_result(r, str(tmp_path / "r"))
    assert len(folders) == 10
    assert csvio.read_csv(spark, f"{tmp_path}/r/metrics.csv").count() == r.metrics.count()
    assert spark.read.json(f"{tmp_path}/r/importance.json").count() == r.importance.count()


def test_a_failing_explanation_falls_back_while_running(spark, monkeypatch):
    def broken(model):
        return lambda df: df.withColumn("out", F.array(F.raise_error(F.lit("no explanation")).cast("double")))

    def broken_trees(rows, key, features, *_):
        failing = F.raise_error(F.lit("no explanation")).cast("double")
        return rows.select(key, F.lit(0).alias("cls"), F.lit(features[0]).alias("feature"), failing.alias("phi"))

    monkeypatch.setattr(benchmarks.tree_shapley, "shapley_trees", broken_trees)
    monkeypatch.setattr(shapley, "prediction_output", broken)
    monkeypatch.setattr(benchmarks._explained, "__defaults__", (broken,))
    r = small_result(spark)
    assert {k for k in r.failures} == {f"{m} explanation" for m in r.metrics.toPandas().model}
    assert {x.source for x in r.importance.select("source").distinct().collect()} & {"shapley"} == set()


def test_fits_do_not_depend_on_partitions(spark):
    df = spark.range(600).select(F.col("id").alias("k"), *[(F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / 100.0).alias(f"x{j}") for j in range(3)])
    df = df.withColumn("y", F.col("x0") * 2 - F.col("x1") + F.col("x2") * F.col("x0"))
    vectors = VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="features").transform(df)
    found = []
    for n in (1, 4, 9):
        suite = Suite([Member("f", lambda rows: models.forest_regressor(5, 6))], partitions=6).fit(vectors.repartition(n), "k")
        found.append([round(r.pred, 9) for r in suite.predict(vectors, ["k"]).orderBy("k").collect()])
    assert found[0] == found[1] == found[2]
