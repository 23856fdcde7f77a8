"""Hand-computed cases for the operators."""

import math

import published
import pytest
from pyspark.sql import functions as F

from tabscore.functions import scalars, text
from tabscore.operators import clean, fairness, metrics, profile, ranks, readiness, report, reshape, scale, split
from tabscore.operators.tfidf import Tfidf
from tabscore.session import join_lookup, scratch_path
from tabscore.sources import csvio, tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def preds(spark, ys, ps, groups=None):
    groups = groups or ["A"] * len(ys)
    data = [("m", float(y), float(p), g) for y, p, g in zip(ys, ps, groups)]
    return spark.createDataFrame(data, "model string, y double, pred double, grp string")


def one(df):
    return df.first().asDict()


def test_regression_metrics(spark):
    p = preds(spark, [1, 2, 3, 4], [1, 2, 4, 2])
    m = one(metrics.regression_metrics(p, ["model"]))
    assert m["mae"] == 0.75 and m["mse"] == 1.25
    assert m["rmse"] == pytest.approx(1.118033988749895) and m["r2"] == pytest.approx(0)
    t = one(metrics.metrics_table(p, ["model"]))
    assert t["MAPE"] == pytest.approx(20.833333333333332) and t["Accuracy"] == pytest.approx(0.7)


def test_mape_with_zero_target(spark):
    m = one(metrics.mape_metrics(preds(spark, [0, 1], [1, 1]), ["model"]))
    assert m["mape_plain"] == 0
    assert m["mape_clipped"] == pytest.approx(5e9)
    assert m["mape_zero_as_one"] == pytest.approx(50)


def test_relative_accuracy_of_zero_mean(spark):
    t = one(metrics.metrics_table(preds(spark, [-1, 1], [3, 4]), ["model"]))
    assert t["Accuracy"] == 0


def test_r2_of_constant_target(spark):
    assert one(metrics.regression_metrics(preds(spark, [5, 5], [5, 5]), ["model"]))["r2"] == 1
    assert one(metrics.regression_metrics(preds(spark, [5, 5], [5, 6]), ["model"]))["r2"] == 0
    assert one(metrics.regression_metrics(preds(spark, [5], [5]), ["model"]))["r2"] is None


def test_classification_metrics(spark):
    m = one(metrics.classification_metrics(preds(spark, [0, 0, 1, 2], [0, 1, 1, 1]), ["model"]))
    assert m["accuracy"] == 0.5 and m["f1"] == pytest.approx(0.4583333333333333)


def test_group_gap(spark):
    p = preds(spark, [0, 2, 1, 1], [0, 0, 0, 0], ["A", "A", "B", "B"])
    g = one(fairness.group_rmse(p, ["model"], "grp", "A", "B"))
    assert g["a_rmse"] == pytest.approx(math.sqrt(2)) and g["b_rmse"] == 1
    assert g["disparity"] == pytest.approx(0.41421356)
    n = one(fairness.rmse_spread(p, ["model"], "grp"))
    assert n["disparity"] == pytest.approx(g["disparity"])


def test_empty_group_gives_nulls(spark):
    p = preds(spark, [1, 2], [1, 1], ["A", "A"])
    g = one(fairness.group_rmse(p, ["model"], "grp", "A", "B"))
    assert (g["a_rmse"], g["b_rmse"], g["disparity"]) == (None, None, None)
    a = one(fairness.group_accuracy(p, ["model"], "grp", "A", "B"))
    assert a["disparity"] is None


def test_attach_group(spark):
    p = spark.createDataFrame([(1, 0.5), (2, 0.1)], "row_id long, pred double")
    attrs = spark.createDataFrame([(1, "A")], "row_id long, grp string")
    assert sorted(fairness.attach_group(p, attrs, "row_id").select("row_id", "grp").collect()) == [(1, "A"), (2, None)]


def test_label_encode(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "B")], "k int, c string")
    got = {r["k"]: r["c"] for r in clean.label_encode(df, "c").collect()}
    assert got == {1: 2, 2: 3, 3: 1, 4: 0}


def test_label_encode_unseen(spark):
    df = spark.createDataFrame([(1, "a"), (2, "z")], "k int, c string")
    codes = clean.label_codes(df, "c", fit_on=df.where("k = 1"))
    got = {r["k"]: r["c"] for r in clean.label_encode(df, "c", codes=codes).collect()}
    assert got == {1: 0, 2: None}


def test_numbering_by_partition_equals_window(spark):
    values = spark.range(1000).select(F.format_string("v%05d", F.col("id") * 7 % 1000).alias("v")).repartition(7)
    got = {r["v"]: r["code"] for r in ranks._number_by_partition(values, "v", "code").collect()}
    assert got == {f"v{i:05d}": i for i in range(1000)}


@pytest.mark.parametrize("strategy, expected", [("mean", 4.0), ("median", 2.5)])
def test_impute(spark, strategy, expected):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None), (None, None)], "x double, empty double")
    if strategy == "mean":
        out = clean.mean_impute(df, ["x", "empty"])
    else:
        out = clean.median_impute(df, ["x", "empty"], fit_on=df)
    assert out.columns == ["x"]
    assert sorted(r["x"] for r in out.collect()) == sorted([1.0, 2.0, 3.0, 10.0, expected])


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0), (10.0, 7.0)], "x double, c double")
    out = scale.standardize(df, ["x", "c"]).orderBy("x").collect()
    assert [r["x"] for r in out] == pytest.approx([-0.848528, -0.565685, -0.282843, 1.697056], abs=1e-6)
    assert {r["c"] for r in out} == {0.0}


def test_min_max(spark):
    train = spark.createDataFrame([(10.0,), (20.0,), (40.0,)], "x double")
    both = spark.createDataFrame([(10.0,), (20.0,), (40.0,), (55.0,)], "x double")
    mm = scale.MinMax(train, "x")
    out = both.withColumn("s", mm.scale(F.col("x"))).withColumn("back", mm.restore(F.col("s"))).orderBy("x").collect()
    assert [r["s"] for r in out] == pytest.approx([0, 1 / 3, 1, 1.5])
    assert [r["back"] for r in out] == pytest.approx([10, 20, 40, 55])
    flat = scale.MinMax(train.where("x = 10"), "x")
    assert train.select(flat.scale(F.lit(10.0)).alias("s")).first()["s"] == 0


def test_join_text(spark):
    df = spark.createDataFrame([("a", None, "b")], "a string, b string, c string")
    assert df.select(scalars.join_text(*[F.col(c) for c in "abc"])).first()[0] == "a  b"


def test_to_number(spark):
    df = spark.createDataFrame([(s,) for s in ["1.5", "x", "1e3", "2d", "NaN", None, " 7 "]], "s string")
    assert [r[0] for r in df.select(scalars.to_number(F.col("s"))).collect()] == [1.5, None, 1000.0, None, None, None, 7.0]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.5,), (9.0,)], "x double")
    assert [r[0] for r in df.select(scalars.clip(F.col("x"), 0.0, 1.0)).collect()] == [None, 0.0, 0.5, 1.0]


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (9 / 60000,)], "x double")
    got = df.select(scalars.round_half_even(F.col("x"), 0).alias("a"), scalars.round_half_even(F.col("x"), 4).alias("b")).collect()
    assert [r["a"] for r in got] == [0.0, 2.0, 2.0, 0.0]
    assert got[3]["b"] == 0.0001


@pytest.mark.parametrize(
    "value, metric, expected",
    [
        (235251.0, "MAE", "235.3K"), (6036301.0, "MAE", "6.04M"), (0.7274, "MAE", "0.7274"), (368.81, "RMSE", "368.81"),
        (1.04, "MAPE", "1.04%"), (None, "Fairness", "N/A"), (0.0004, "Fairness", "0.0004"), (398335.0, "Fairness", "398.3K"),
        (-2.9204, "R2", "-2.9204"), (98.92, "Accuracy", "98.92%"), (14.997, "Readiness", "15.00"), (1.5, "Other", "1.5"),
    ],
)
def test_format_metric(spark, value, metric, expected):
    df = spark.createDataFrame([(value, metric)], "v double, m string")
    assert df.select(scalars.format_metric(F.col("v"), F.col("m"))).first()[0] == expected


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
@pytest.mark.parametrize("finish", [1, 3, 1000])
def test_exact_median(spark, n, finish):
    import random
    import statistics

    rng = random.Random(n)
    values = [rng.choice([5.0, 5.0, 5.0, rng.uniform(0, 10)]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert ranks.exact_median(df, "x", finish_rows=finish) == statistics.median(values)


def test_median_of_nothing(spark):
    assert ranks.exact_median(spark.createDataFrame([(None,)], "x double"), "x") is None


@pytest.mark.parametrize("n", [1, 4, 5, 10, 1000])
def test_exact_split_size(spark, n):
    out = split.exact_split(spark.range(n), "id")
    assert out.where("not is_train").count() == math.ceil(n / 5)


def test_splits_ignore_partitions(spark):
    base = spark.range(500)
    want = None
    for parts in (1, 7, 50):
        df = base.orderBy(F.xxhash64("id", F.lit(parts))).repartition(parts)
        got = (
            rows(split.hash_split(df, "id")), rows(split.exact_split(df, "id")),
            rows(split.bounded_sample(df, "id", 20)), rows(df.select("id", split.assign_group("id", "a", "b"))),
        )
        want = want or got
        assert got == want


def test_temporal_split(spark):
    df = spark.createDataFrame([(2020,), (2022,), (2023,)], "y int")
    train, test = split.temporal_split(df, "y", 2022)
    assert rows(train) == [(2020,)] and rows(test) == [(2022,), (2023,)]


def test_readiness_forms(spark):
    df = spark.createDataFrame([("XGBoost", 0.7375, 0.5), ("RandomForest", -2.92, 0.5)], "model string, r2 double, acc double")

    def total(part, parts):
        return {r["model"]: r["total_score"] for r in readiness.readiness(df, part, parts, ["model"]).collect()}

    d1 = total(readiness.r2_part(F.col("r2")), readiness.BOOSTED_FIRST)
    assert d1["XGBoost"] == pytest.approx(18.69) and d1["RandomForest"] == pytest.approx(14.0)
    assert total(readiness.share_part(F.col("acc")), readiness.UNIFORM)["XGBoost"] == pytest.approx(16.5)
    assert total(readiness.rounded_share_part(F.col("acc")), readiness.TREES_FIRST)["RandomForest"] == pytest.approx(17.5)
    assert total(F.lit(0.997), readiness.UNIFORM)["XGBoost"] == pytest.approx(14.997)


def test_published_reports(spark):
    scores = published.published_scores(spark)
    assert scores.count() == 140
    perf = {(r["dataset"], r["model"]): r for r in report.performance_report(scores).collect()}
    assert perf["Enrollment", "XGBoost"]["MAE"] == "235.3K"
    assert perf["Dropout", "XGBoost"]["MAPE"] == "1355932000.00%"
    assert perf["University Ranking", "LogisticRegression"]["R2"] == "-2.9204"
    fair = {(r["dataset"], r["model"]): r["Disparity"] for r in report.fairness_report(scores).collect()}
    assert fair["Enrollment", "LightGBM"] == "1.58M"
    ready = {(r["dataset"], r["model"]): r["Total_Readiness"] for r in report.readiness_report(scores).collect()}
    assert ready["Budget Prediction", "XGBoost"] == "19.90"
    best = {
        (r["dataset"], r["metric"]): r["best_model"]
        for r in report.best_model(scores, published.MODEL_ORDER, skip=[("Dropout", "MAPE")]).collect()
    }
    assert ("Dropout", "MAPE") not in best and len(best) == 34
    assert best["Student Performance", "MAPE"] == "XGBoost"  # a tie with LightGBM
    assert best["University Ranking", "Accuracy"] == "XGBoost"  # a tie of three
    assert best["Enrollment", "Fairness"] == "RandomForest"
    slugs = {r["slug"] for r in report.by_dataset(report.fairness_report(scores)).collect()}
    assert "university_ranking" in slugs


def test_write_reports(spark, tmp_path):
    report.write_reports(published.published_scores(spark), str(tmp_path / "r"))
    back = spark.read.option("header", True).csv(str(tmp_path / "r" / "readiness_summary"))
    assert back.count() == 20 and "slug" in back.columns


def test_best_model_tie(spark):
    df = spark.createDataFrame([("d", "y", "MAE", 1.0), ("d", "x", "MAE", 1.0)], "dataset string, model string, metric string, value double")
    assert report.best_model(df, ["x", "y"]).first()["best_model"] == "x"


def test_profile_figures(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "b")], "n int, s string")
    cells = profile.column_profile({"d": df})
    summary = profile.dataset_summary(cells, {"d": ("n", "Regression")}).first()
    assert summary["pct_missing"] == 12.5 and summary["target"] == "n"
    assert summary["missing_per_column"] == {"n": 0, "s": 1}
    kinds = profile.feature_types(cells).first()
    assert kinds["pct_missing_categorical"] == 25.0 and kinds["pct_missing_text"] == 0.0
    ratios = {r["column"]: r["ratio"] for r in profile.distinct_ratio({"d": df}).collect()}
    assert ratios == {"n": 0.75, "s": 0.5}
    assert rows(profile.null_patterns(df)) == [("00", 3), ("01", 1)]


def test_distinct_ratio_of_odd_values(spark):
    long_text = "x" * 100
    df = spark.createDataFrame(
        [(0.0, long_text, [1, 2], None), (-0.0, long_text, [1, 2], None), (1.0, long_text + "y", [2, 1], None)],
        "d double, s string, a array<int>, e string",
    )
    got = {r["column"]: r["distinct"] for r in profile.distinct_ratio({"d": df}).collect()}
    assert got == {"d": 2, "s": 2, "a": 2, "e": 0}


def test_sketches_merge_within_their_error(spark):
    df = spark.range(60_000).selectExpr("id", "id % 700 AS few", "repeat(cast(id % 9000 AS string), 20) AS s", "if(id % 3 = 0, null, id) AS gaps", "cast(null AS string) AS none")
    parts = [profile.sketch_profile(df.where(f"id % 5 = {i}"), "d") for i in range(3)] + [profile.sketch_profile(df.where("id % 5 > 2"), "d")]

    def told(p):
        return {r["column"]: (r["rows"], r["distinct"]) for r in profile.sketch_ratio(p).collect()}

    nothing = profile.sketch_profile(df.where("false"), "d")
    for merged in (profile.merge_sketches(*parts), profile.merge_sketches(nothing, profile.merge_sketches(*parts[2:]), *parts[1::-1])):
        one = told(merged)
        for name, true in {"id": 60_000, "few": 700, "s": 9_000, "gaps": 40_000, "none": 0}.items():
            assert one[name][0] == 60_000 and abs(one[name][1] - true) <= profile.sketch_error() * true
    empty = profile.sketch_ratio(profile.sketch_profile(df.where("false"), "d")).collect()
    assert {(r["rows"], r["distinct"], r["ratio"]) for r in empty} == {(0, 0, 0.0)}


def test_diversity_ties(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "a int, b int, c int")
    r = profile.diversity_summary(profile.distinct_ratio({"d": df})).first()
    assert (r["max_feature"], r["min_feature"]) == ("b", "a")


def test_empty_table_profile(spark):
    df = spark.createDataFrame([], "a int, b string")
    r = profile.dataset_summary(profile.column_profile({"d": df}), {}).first()
    assert r["rows"] == 0 and r["pct_missing"] == 0.0


def test_csv_roundtrip_and_inference(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('id,x,s,mixed,none\n1,1.5,"a ""q"", b",1,\n2,NA,NA,x,\n3,n/a,c,3,nan\n')
    df = csvio.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "s": "string", "mixed": "string", "none": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, 1.5, 'a "q", b', "1", None), (2, None, None, "x", None), (3, None, "c", "3", None),
    ]
    out = str(tmp_path / "out")
    csvio.write_csv(df, out)
    assert rows(csvio.read_csv(spark, out, schema=df.schema).select("id", "s")) == rows(df.select("id", "s"))


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "x double, s string")
    assert sorted(r["x"] is None for r in tables.nan_to_null(df).collect()) == [False, True]


def test_stack_and_melt(spark):
    a = spark.createDataFrame([(1, "x")], "k int, label string")
    b = spark.createDataFrame([(2,)], "k int")
    assert sorted(rows(reshape.stack_tagged({"Train": a, "Test": b}).fillna("-").select("k", "label", "source"))) == [
        (1, "x", "Train"), (2, "-", "Test"),
    ]
    wide = spark.createDataFrame([("u", 1.0, None)], "Type string, `2001` double, `2002` double")
    assert clean.year_columns(wide) == ["2001", "2002"]
    assert reshape.melt(wide, ["Type"], ["2001", "2002"], "Year", "n").count() == 2


def test_words(spark):
    df = spark.createDataFrame([("The cat, a CAT über_2 x!",)], "t string")
    got = text.with_terms(df, "t", ["the"], "g").select(text.words(F.col("t")).alias("w"), "g").first()
    assert got["w"] == ["the", "cat", "cat", "über_2"]
    assert got["g"] == ["cat", "cat", "über_2", "cat cat", "cat über_2"]


@pytest.mark.parametrize("t, want", [("", []), ("one", ["one"]), ("the", [])])
def test_short_texts(spark, t, want):
    df = spark.createDataFrame([(t,)], "t string")
    assert text.with_terms(df, "t", ["the"]).first()["terms"] == want


def hot(spark):
    """A third of the rows share one key, one value and one gap."""
    i = F.col("id")
    return spark.range(3000).select(
        F.when(i % 3 == 0, 7).otherwise(i).alias("k"),
        F.when(i % 3 == 0, "hot").when(i % 3 == 1, F.concat(F.lit("v"), i % 5)).alias("c"),
        (i % 11).cast("double").alias("y"),
    )


def test_hot_value_encoding(spark):
    got = rows(clean.label_encode(hot(spark), "c").groupBy("c").count())
    # hot, nan, then v0..v4
    assert got[0] == (0, 1000) and got[1] == (1, 1000) and sum(n for _, n in got) == 3000


@pytest.mark.parametrize("max_rows", [0, 100])
def test_lookup_join_is_the_same_with_and_without_broadcast(spark, max_rows):
    lookup = spark.createDataFrame([("hot", 1), ("v1", 2)], "c string, n int")
    got = rows(join_lookup(hot(spark), lookup, "c", max_rows=max_rows).groupBy("n").count().na.fill(-1))
    assert got == [(-1, 1800), (1, 1000), (2, 200)]


def test_exact_split_with_a_hot_key_keeps_its_rows_together(spark):
    df = hot(spark)
    out = split.exact_split(df, "k")
    assert out.count() == 3000
    assert out.where("k = 7").select("is_train").distinct().count() == 1
    assert 600 <= out.where("not is_train").count() <= 1601


def test_hot_pattern_and_classes(spark):
    df = hot(spark)
    assert rows(profile.null_patterns(df.select("c"))) == [("0", 2000), ("1", 1000)]
    preds_ = df.select(F.lit("m").alias("model"), (F.col("k") == 7).cast("int").alias("y"), F.lit(1).alias("pred"))
    m = one(metrics.classification_metrics(preds_, ["model"]))
    share = m["accuracy"]
    assert m["n"] == 3000 and m["f1"] == pytest.approx(share * 2 * share / (1 + share))


def test_profile_reads_a_table_once(spark, sf):
    orders = tables.Tables(spark, sf).orders
    plan = profile.column_profile({"o": orders})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_filters_reach_the_scan(spark, sf):
    orders = tables.Tables(spark, sf).orders
    small = clean.drop_missing(orders, ["o_totalprice"]).where("o_totalprice > 1e5").select("o_orderkey")
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100000.0)" in plan and "o_orderpriority" not in plan


def test_splits_and_vectors_do_not_shuffle(spark, sf):
    t = tables.Tables(spark, sf)
    model = Tfidf(["aa", "bb"], [1, 1], 2, [])
    for df in (split.hash_split(t.orders, "o_orderkey"), split.exact_split(t.orders, "o_orderkey"), model.vectors(t.documents, "text")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


class _Session:
    """As much of a session as the scratch folder needs."""

    def __init__(self, master, folder=None):
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}
        self.sparkContext = type("C", (), {"master": master, "applicationId": master})


def test_scratch_folder():
    assert scratch_path(_Session("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/tabscore/x-")
    local = _Session("local[2]")
    a, b = scratch_path(local, "x"), scratch_path(local, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    with pytest.raises(ValueError):
        scratch_path(_Session("yarn"), "x")


def test_rows_without_a_key_have_a_place(spark):
    df = spark.createDataFrame([(i if i % 5 else None, i) for i in range(100)], "k long, v long")
    for out in (split.hash_split(df, "k"), split.exact_split(df, "k")):
        assert out.where("is_train is null").count() == 0 and out.count() == 100
    one = spark.createDataFrame([(i or None,) for i in range(50)], "k long")
    assert split.exact_split(one, "k").where("not is_train").count() == 10
    grouped = df.select(split.assign_group("k", "a", "b").alias("g")).groupBy("g").count().collect()
    assert sum(r["count"] for r in grouped) == 100 and None not in {r["g"] for r in grouped}


def test_csv_files_are_split_unless_a_value_spans_lines(spark, tmp_path):
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_text('a,b\n1,"x ""y"", z"\n2,"w"\n')
    broken.write_text('a,b\n1,"x\n""y"""\n2,w\n')
    assert not csvio.has_broken_lines(spark, str(plain)) and csvio.has_broken_lines(spark, str(broken))
    assert csvio.has_broken_lines(spark, [str(plain), str(broken)])
    assert rows(csvio.read_csv(spark, str(plain))) == [(1, 'x "y", z'), (2, "w")]
    assert rows(csvio.read_csv(spark, str(broken))) == [(1, 'x\n"y"'), (2, "w")]


def test_csv_keeps_blanks_quotes_and_line_breaks(spark, tmp_path):
    texts = ["  lead", "trail  ", "a\nb", 'say "x", then\r\n', "plain", None, "tab\there"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    csvio.write_csv(df, str(tmp_path / "c"))
    assert [r.t for r in csvio.read_csv(spark, str(tmp_path / "c"), schema=df.schema).orderBy("i").collect()] == texts


def test_profiles_count_nan_as_missing(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 1.5)], "k long, x double").write.parquet(str(tmp_path / "orders.parquet"))
    orders = tables.Tables(spark, str(tmp_path)).orders
    cells = {r["column"]: r["nulls"] for r in profile.column_profile({"orders": orders}).collect()}
    assert cells == {"k": 0, "x": 1}


def test_column_values_leave_none_out(spark):
    df = spark.createDataFrame([(3,), (1,), (None,), (3,)], "x long")
    assert reshape.column_values(df, "x") == [1, 3]
    with pytest.raises(ValueError, match="more than 1"):
        reshape.column_values(df, "x", most=1)


def test_a_lookup_with_long_texts_is_not_small(spark):
    from tabscore.session import fetch_small

    assert fetch_small(spark.createDataFrame([("x" * 256,)], "t string")).num_rows == 1
    assert fetch_small(spark.createDataFrame([("x" * 257,)], "t string")) is None
    big = spark.createDataFrame([("x" * 500, 1), ("y", 2)], "t string, v int")
    out = join_lookup(spark.createDataFrame([("x" * 500,), ("y",), ("z",)], "t string"), big, "t")
    assert sorted((r.t[0], r.v) for r in out.collect()) == [("x", 1), ("y", 2), ("z", None)]


def test_weights_move_no_text(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "aa"), (2, None)], "k long, text string")
    out = Tfidf(["aa", "bb"], [2, 1], 2, None).weights(docs, "k", "text")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k, r.term) for r in out.collect()) == [(1, "aa"), (1, "aa"), (1, "bb")]
