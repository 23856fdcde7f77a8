"""Metrics, fairness, readiness and report tables on simple predictors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.functions.scalars import format_metric
from tabscore.operators import clean, fairness, metrics, readiness, report, reshape
from tabscore.plans.registry import query
from tabscore.plans.roles import (
    CLASS_SQL,
    GROUP_A,
    GROUP_B,
    SEGMENTS,
    STAND_INS,
    STAND_INS_SQL,
    THRESHOLD,
    class_predictions,
    stand_in_predictions,
    stand_ins_long,
)

MODEL = ["model"]


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


R2_SQL = "1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y))"
MAE_SQL, RMSE_SQL = "avg(abs(y - pred))", "sqrt(avg((y - pred) * (y - pred)))"
MAPE_SQL = "avg(abs(y - pred) / CASE WHEN abs(y) > 2.220446049250313e-16 THEN abs(y) ELSE 2.220446049250313e-16 END) * 100"
REL_SQL = "CASE WHEN avg(y) = 0 THEN 0 ELSE greatest(0.0, least(1.0, 1 - avg(abs(y - pred)) / avg(y))) END"


def _gap_sql(err: str, group: str, a: object, b: object, names: str = "rmse", outer: str = "sqrt") -> str:
    a, b = (f"'{v}'" if isinstance(v, str) else v for v in (a, b))
    va = f"{outer}(avg({err}) FILTER (WHERE {group} = {a}))"
    vb = f"{outer}(avg({err}) FILTER (WHERE {group} = {b}))"
    return f"round({va}, 4) AS a_{names}, round({vb}, 4) AS b_{names}, round(abs({va} - {vb}), 4) AS disparity"


SQ = "(y - pred) * (y - pred)"


@query("flagship", f"""
WITH {STAND_INS_SQL}
SELECT model, count(*) AS n, round({MAE_SQL}, 4) AS mae, round({RMSE_SQL}, 4) AS rmse, round({R2_SQL}, 8) AS r2,
       {_gap_sql(SQ, 'segment', GROUP_A, GROUP_B)}
FROM preds GROUP BY model""")
def flagship(t):
    y, p = F.col("y"), F.col("pred")
    columns = [
        F.count("*").alias("n"), F.avg(metrics.abs_error(y, p)).alias("mae"),
        F.sqrt(F.avg(metrics.sq_error(y, p))).alias("rmse"), metrics.r2(y, p).alias("r2"),
    ]
    gap = fairness.rmse_gap("segment", GROUP_A, GROUP_B)
    out = stand_ins_long(t).groupBy("model").agg(*columns, *gap)
    return rounded(out, {"mae": 4, "rmse": 4, "r2": 8, "a_rmse": 4, "b_rmse": 4, "disparity": 4})


@query("metrics_regression", f"""
WITH {STAND_INS_SQL}
SELECT model, count(*) AS n, round({MAE_SQL}, 4) AS mae, round(avg({SQ}), 2) AS mse, round({RMSE_SQL}, 4) AS rmse,
       round({R2_SQL}, 8) AS r2 FROM preds GROUP BY model""")
def metrics_regression(t):
    out = metrics.regression_metrics(stand_ins_long(t), MODEL)
    return rounded(out, {"mae": 4, "mse": 2, "rmse": 4, "r2": 8})


@query("mape_variants", """
WITH p AS (
  SELECT l_linestatus AS model, l_discount AS y, l_tax AS pred FROM lineitem)
SELECT model,
  round(avg(abs(y - pred) / CASE WHEN abs(y) > 2.220446049250313e-16 THEN abs(y) ELSE 2.220446049250313e-16 END) * 100 / 1e12, 4) AS mape_eps,
  round(avg(CASE WHEN y <> 0 THEN abs((y - pred) / y) END) * 100, 6) AS mape_plain,
  round(avg(abs((y - pred) / CASE WHEN y < 1e-8 THEN 1e-8 ELSE y END)) * 100, 2) AS mape_clipped,
  round(avg(abs((y - pred) / CASE WHEN y = 0 THEN 1.0 ELSE y END)) * 100, 6) AS mape_zero_as_one
FROM p GROUP BY model""")
def mape_variants(t):
    """Discounts hold zeros, which is where the four forms differ."""
    p = t.lineitem.select(
        F.col("l_linestatus").alias("model"), F.col("l_discount").alias("y"), F.col("l_tax").alias("pred")
    )
    out = metrics.mape_metrics(p, MODEL).withColumn("mape_eps", F.col("mape_eps") / 1e12)
    return rounded(out, {"mape_eps": 4, "mape_plain": 6, "mape_clipped": 2, "mape_zero_as_one": 6})


@query("relative_accuracy", f"""
WITH {STAND_INS_SQL} SELECT model, round({REL_SQL}, 8) AS accuracy FROM preds GROUP BY model""")
def relative_accuracy(t):
    out = stand_ins_long(t).groupBy("model").agg(metrics.relative_accuracy(F.col("y"), F.col("pred")).alias("accuracy"))
    return rounded(out, {"accuracy": 8})


@query("threshold_accuracy", f"""
WITH {STAND_INS_SQL}
SELECT model, round(avg(((y <= 200000) = (pred <= 200000))::int), 8) AS accuracy FROM preds GROUP BY model""")
def threshold_accuracy(t):
    out = stand_ins_long(t).groupBy("model").agg(
        metrics.threshold_accuracy(F.col("y"), F.col("pred"), THRESHOLD).alias("accuracy")
    )
    return rounded(out, {"accuracy": 8})


TABLE_SQL = f"""round({MAE_SQL}, 4) AS "MAE", round(avg({SQ}), 2) AS "MSE", round({RMSE_SQL}, 4) AS "RMSE",
       round({R2_SQL}, 8) AS "R2", round({MAPE_SQL}, 6) AS "MAPE", round({R2_SQL}, 8) AS "Accuracy" """
TABLE_DIGITS = {"MAE": 4, "MSE": 2, "RMSE": 4, "R2": 8, "MAPE": 6, "Accuracy": 8}


@query("metrics_table", f"WITH {STAND_INS_SQL} SELECT model, {TABLE_SQL} FROM preds GROUP BY model")
def metrics_table(t):
    """The result table in which R2 is also the accuracy."""
    return rounded(metrics.metrics_table(stand_ins_long(t), MODEL, accuracy="r2"), TABLE_DIGITS)


@query("metrics_classification", f"""
WITH {CLASS_SQL},
names AS (SELECT DISTINCT model, y AS c FROM preds UNION SELECT DISTINCT model, pred FROM preds),
per AS (
  SELECT names.model, c, count(*) FILTER (WHERE y = c AND pred = c) AS tp, count(*) FILTER (WHERE y = c) AS support,
         count(*) FILTER (WHERE pred = c) AS given
  FROM names JOIN preds ON names.model = preds.model GROUP BY names.model, c)
SELECT model, sum(support)::bigint AS n, round(sum(tp) / sum(support)::double, 8) AS accuracy,
       round(sum(support * 2.0::double * tp / (support + given)) / sum(support), 8) AS f1
FROM per GROUP BY model""")
def metrics_classification(t):
    out = metrics.classification_metrics(class_predictions(t), MODEL)
    return rounded(out, {"accuracy": 8, "f1": 8})


@query("fairness_rmse", f"""
WITH {STAND_INS_SQL} SELECT model, {_gap_sql(SQ, 'segment', GROUP_A, GROUP_B)} FROM preds GROUP BY model""")
def fairness_rmse(t):
    out = fairness.group_rmse(stand_ins_long(t), MODEL, "segment", GROUP_A, GROUP_B)
    return rounded(out, {"a_rmse": 4, "b_rmse": 4, "disparity": 4})


@query("fairness_threshold_rmse", f"""
WITH {STAND_INS_SQL}, flags AS (
  SELECT model, segment, (y <= 200000)::int AS y, (pred <= 200000)::int AS pred FROM preds)
SELECT model, {_gap_sql(SQ, 'segment', GROUP_A, GROUP_B)} FROM flags GROUP BY model""")
def fairness_threshold_rmse(t):
    out = fairness.threshold_rmse(stand_ins_long(t), MODEL, "segment", GROUP_A, GROUP_B, THRESHOLD)
    return rounded(out, {"a_rmse": 4, "b_rmse": 4, "disparity": 4})


@query("fairness_by_column", f"""
WITH {STAND_INS_SQL},
codes AS (SELECT segment, row_number() OVER (ORDER BY segment) - 1 AS code FROM (SELECT DISTINCT segment FROM preds)),
g AS (SELECT model, sqrt(avg({SQ}) FILTER (WHERE code = 0)) AS a, sqrt(avg({SQ}) FILTER (WHERE code = 1)) AS b
      FROM preds JOIN codes USING (segment) GROUP BY model)
SELECT model, round_even(a, 2) AS a_rmse, round_even(b, 2) AS b_rmse, round_even(abs(a - b), 2) AS disparity FROM g""")
def fairness_by_column(t):
    """Groups are the codes 0 and 1 of a text column; the other codes are ignored."""
    # The codes come from the small table that holds the column, not from the predictions.
    codes = clean.label_codes(t.customer.select(F.col("c_mktsegment").alias("segment")), "segment")
    coded = clean.label_encode(stand_in_predictions(t), "segment", codes=codes)
    long = coded.unpivot(["segment", "y"], STAND_INS, "model", "pred")
    return fairness.group_rmse(long, MODEL, "segment", 0, 1, digits=2)


@query("fairness_accuracy", f"""
WITH {CLASS_SQL}
SELECT model, {_gap_sql('(y = pred)::int', 'grp', 'F', 'O', 'accuracy', '')} FROM preds GROUP BY model""")
def fairness_accuracy(t):
    out = fairness.group_accuracy(class_predictions(t), MODEL, "grp", "F", "O")
    return rounded(out, {"a_accuracy": 4, "b_accuracy": 4, "disparity": 4})


@query("fairness_ngroup", f"""
WITH {STAND_INS_SQL}, g AS (SELECT model, segment, {RMSE_SQL} AS r FROM preds GROUP BY model, segment)
SELECT model, count(*) AS groups, round(min(r), 4) AS min_rmse, round(max(r), 4) AS max_rmse,
       round(max(r) - min(r), 4) AS disparity FROM g GROUP BY model""")
def fairness_ngroup(t):
    out = fairness.rmse_spread(stand_ins_long(t), MODEL, "segment")
    return rounded(out, {"min_rmse": 4, "max_rmse": 4, "disparity": 4})


@query("fairness_matrix", f"""
WITH {STAND_INS_SQL} SELECT model, {", ".join(f"round({RMSE_SQL[:-1]}) FILTER (WHERE segment = '{s}')), 4) AS " + f'"{s}"' for s in SEGMENTS)}
FROM preds GROUP BY model""".replace("sqrt(avg((y - pred) * (y - pred))) FILTER", "sqrt(avg((y - pred) * (y - pred)) FILTER"))
def fairness_matrix(t):
    """Model x group matrix of errors."""
    per = stand_ins_long(t).groupBy("model", "segment").agg(
        F.sqrt(F.avg(metrics.sq_error(F.col("y"), F.col("pred")))).alias("rmse")
    )
    return reshape.to_matrix(rounded(per, {"rmse": 4}), "model", "segment", "rmse", reshape.column_values(t.customer, "c_mktsegment"))


# The hand-set parts of the query models: as in a pipeline in which one model reads better.
ONE_BETTER = readiness.Profile({"linear": 4})
TWO_BETTER = readiness.Profile({"const": 4, "group_mean": 4})


def _ready_sql(part: str, better: list[str], digits: int = 6, source: str = "preds") -> str:
    names = ", ".join(f"'{m}'" for m in better) or "''"
    return f"""
, a AS (SELECT model, {part} AS acc FROM {source} GROUP BY model)
SELECT model, CASE WHEN model IN ({names}) THEN 4 ELSE 3 END AS interpretability, 3 AS fairness, 4 AS scalability,
       round(acc, {digits}) AS accuracy, 4 AS data_quality,
       round(CASE WHEN model IN ({names}) THEN 4 ELSE 3 END + 3 + 4 + acc + 4, {digits}) AS total_score FROM a"""


def _ready(m: DataFrame, part, profile) -> DataFrame:
    out = readiness.readiness(m, part, profile, MODEL)
    return rounded(out, {"accuracy": 6, "total_score": 6})


@query("readiness_r2", f"""
WITH {STAND_INS_SQL} {_ready_sql(f'round_even(greatest(0.0, least(5.0, 5 * ({R2_SQL}))), 2)', ['linear'])}""")
def readiness_r2(t):
    m = metrics.regression_metrics(stand_ins_long(t), MODEL)
    return _ready(m, readiness.r2_part(F.col("r2")), ONE_BETTER)


@query("readiness_accuracy", f"""
WITH {STAND_INS_SQL} {_ready_sql('5 * avg(((y <= 200000) = (pred <= 200000))::int)', [])}""")
def readiness_accuracy(t):
    m = metrics.metrics_table(stand_ins_long(t), MODEL, accuracy="threshold", threshold=THRESHOLD)
    return _ready(m, readiness.share_part(F.col("Accuracy")), readiness.UNIFORM)


@query("readiness_raw", f"WITH {STAND_INS_SQL} {_ready_sql(R2_SQL, [])}")
def readiness_raw(t):
    m = metrics.regression_metrics(stand_ins_long(t), MODEL)
    return _ready(m, F.col("r2"), readiness.UNIFORM)


@query("readiness_rounded", f"WITH {CLASS_SQL} {_ready_sql('round_even(5 * avg((y = pred)::int), 2)', ['by_quantity'])}")
def readiness_rounded(t):
    m = metrics.classification_metrics(class_predictions(t), MODEL)
    return _ready(m, readiness.rounded_share_part(F.col("accuracy")), readiness.Profile({"by_quantity": 4}))


@query("actual_vs_predicted", f"""
WITH {STAND_INS_SQL}
SELECT row_id, 'Actual' AS series, y AS value FROM wide
UNION ALL SELECT row_id, model, round(pred, 4) FROM preds""")
def actual_vs_predicted(t):
    series = {"Actual": "y", **{m: m for m in STAND_INS}}
    long = metrics.actual_vs_predicted(stand_in_predictions(t), "row_id", series)
    return rounded(long, {"value": 4})


@query("metrics_long", f"""
WITH {STAND_INS_SQL}, m AS (SELECT model, {MAE_SQL} AS mae, {RMSE_SQL} AS rmse, {MAPE_SQL} AS mape, {REL_SQL} AS acc FROM preds GROUP BY model)
SELECT model, 'MAE' AS metric, round(mae, 4) AS value FROM m UNION ALL SELECT model, 'RMSE', round(rmse, 4) FROM m
UNION ALL SELECT model, 'MAPE', round(mape, 4) FROM m UNION ALL SELECT model, 'Accuracy', round(acc * 100, 4) FROM m""")
def metrics_long(t):
    table = metrics.metrics_table(stand_ins_long(t), MODEL).select("model", "MAE", "RMSE", "MAPE", "Accuracy")
    return rounded(metrics.metrics_long(table, MODEL, ["MAE", "RMSE", "MAPE", "Accuracy"]), {"value": 4})


# Report tables: each customer segment is one data set, each simple predictor one model.
SCORE_METRICS = ["MAE", "RMSE", "R2", "MAPE", "Accuracy", "Fairness", "Readiness"]


def segment_scores(t) -> DataFrame:
    """Long scores ``dataset, model, metric, value``; all seven metrics from one aggregate."""
    wide = stand_in_predictions(t)
    preds = wide.withColumn("dataset", F.concat(F.lit("Segment "), "segment")).unpivot(
        ["dataset", "priority", "y"], STAND_INS, "model", "pred"
    )
    y, p = F.col("y"), F.col("pred")
    gap = fairness.rmse_gap("priority", "1-URGENT", "5-LOW")
    m = preds.groupBy("dataset", "model").agg(*metrics.table_columns(y, p), *gap)
    index = readiness.readiness(
        m, readiness.r2_part(F.col("R2")), ONE_BETTER,
        ["dataset", "model", "MAE", "RMSE", "R2", "MAPE", (F.col("Accuracy") * 100).alias("Acc"), "disparity"],
    )
    final = index.select(
        "dataset", "model", "MAE", "RMSE", "R2", "MAPE", F.col("Acc").alias("Accuracy"),
        F.col("disparity").alias("Fairness"), F.col("total_score").alias("Readiness"),
    )
    return final.unpivot(["dataset", "model"], SCORE_METRICS, "metric", "value")


_PART = f"round_even(greatest(0.0, least(5.0, 5 * ({R2_SQL}))), 2)"
SCORES_SQL = STAND_INS_SQL + f"""
, sp AS (
  SELECT 'Segment ' || p.segment AS dataset, w.priority, p.y, p.model, p.pred
  FROM preds p JOIN wide w ON p.row_id = w.row_id)
, sm AS (
  SELECT dataset, model, {MAE_SQL} AS "MAE", {RMSE_SQL} AS "RMSE", {R2_SQL} AS "R2", {MAPE_SQL} AS "MAPE",
         100 * ({REL_SQL}) AS "Accuracy",
         abs(sqrt(avg({SQ}) FILTER (WHERE priority = '1-URGENT')) - sqrt(avg({SQ}) FILTER (WHERE priority = '5-LOW'))) AS "Fairness",
         CASE WHEN model = 'linear' THEN 4 ELSE 3 END + 3 + 4 + {_PART} + 4 AS "Readiness"
  FROM sp GROUP BY dataset, model)
, scores AS (
""" + " UNION ALL ".join(
    f"""SELECT dataset, model, '{m}' AS metric, "{m}"::double AS value FROM sm""" for m in SCORE_METRICS
) + ")"

_K = "CASE WHEN value >= 1000000 THEN printf('%.2fM', value / 1e6) ELSE printf('%.1fK', value / 1e3) END"
FORMAT_SQL = f"""CASE WHEN value IS NULL THEN 'N/A'
  WHEN metric IN ('MAE', 'RMSE') THEN CASE WHEN value >= 1000 THEN {_K} WHEN value < 1 THEN printf('%.4f', value) ELSE printf('%.2f', value) END
  WHEN metric = 'R2' THEN printf('%.4f', value)
  WHEN metric IN ('MAPE', 'Accuracy') THEN printf('%.2f', value) || '%'
  WHEN metric = 'Fairness' THEN CASE WHEN value >= 1000 THEN {_K} ELSE printf('%.4f', value) END
  WHEN metric = 'Readiness' THEN printf('%.2f', value) END"""


def _report_sql(metrics_: dict[str, str]) -> str:
    cols = ", ".join(
        f"""max(CASE WHEN metric = '{m}' THEN {FORMAT_SQL} END) AS "{out}" """ for m, out in metrics_.items()
    )
    return f"WITH {SCORES_SQL} SELECT dataset, model, {cols} FROM scores GROUP BY dataset, model"


@query("scores_long", f"WITH {SCORES_SQL} SELECT dataset, model, metric, round(value, 4) AS value FROM scores")
def scores_long(t):
    return rounded(segment_scores(t), {"value": 4})


@query("format_metric", f"WITH {SCORES_SQL} SELECT dataset, model, metric, {FORMAT_SQL} AS text FROM scores")
def format_metric_query(t):
    text = format_metric(F.col("value"), F.col("metric"))
    return segment_scores(t).select("dataset", "model", "metric", text.alias("text"))


_ORDER = "CASE model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(STAND_INS)) + " END"


@query("best_model", f"""
WITH {SCORES_SQL}
SELECT dataset, metric, model AS best_model, round(value, 4) AS best_value FROM (
  SELECT *, row_number() OVER (
    PARTITION BY dataset, metric
    ORDER BY CASE WHEN metric IN ('MAE', 'RMSE', 'MAPE', 'Fairness') THEN value ELSE -value END, {_ORDER}) AS rn
  FROM scores WHERE value IS NOT NULL AND NOT (dataset = 'Segment BUILDING' AND metric = 'MAPE'))
WHERE rn = 1""")
def best_model(t):
    best = report.best_model(segment_scores(t), STAND_INS, skip=[("Segment BUILDING", "MAPE")])
    return rounded(best, {"best_value": 4})


@query("report_performance", _report_sql({m: m for m in report.PERFORMANCE}))
def report_performance(t):
    return report.performance_report(segment_scores(t))


@query("report_fairness", _report_sql({"Fairness": "Disparity"}))
def report_fairness(t):
    return report.fairness_report(segment_scores(t))


@query("report_readiness", _report_sql({"Readiness": "Total_Readiness"}))
def report_readiness(t):
    return report.readiness_report(segment_scores(t))


@query("report_slug", f"""
WITH {SCORES_SQL}
SELECT lower(replace(dataset, ' ', '_')) AS slug, dataset, model,
       max(CASE WHEN metric = 'Readiness' THEN printf('%.2f', value) END) AS "Total_Readiness"
FROM scores GROUP BY dataset, model""")
def report_slug(t):
    return report.by_dataset(report.readiness_report(segment_scores(t)))
