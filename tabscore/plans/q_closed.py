"""Fits whose predictions have a closed form, so that SQL can state them.

On one 0/1 feature a tree of depth one predicts the mean, or the majority class, of each
side; further boosting rounds find nothing left to learn; an unpenalised logistic model
reproduces the rates. The Shapley values of any model sum to f(x) minus the mean f(b).
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.operators import models, scale, shapley
from tabscore.operators.models import Member, Suite
from tabscore.operators.reshape import stack
from tabscore.plans.q_models import multilabel
from tabscore.plans.registry import query
from tabscore.plans.roles import FEATURES, SALES_SQL, sales_features, sales_with_customer
from tabscore.session import spread


def sides(t) -> DataFrame:
    """Orders with one feature: whether the status is O."""
    s = sales_with_customer(t)
    flag = F.when(F.col("status") == "O", 1.0).otherwise(0.0)
    return s.select("row_id", "y", "is_train", flag.alias("side"), array_to_vector(F.array(flag)).alias("features"))


SIDES_SQL = SALES_SQL + ", sides AS (SELECT row_id, y, is_train, CASE WHEN status = 'O' THEN 1.0::double ELSE 0 END AS side FROM role)"
REGRESSORS = ["forest", "boosted", "boosted_alt", "scaled"]


@query("closed_form_regression", f"""
WITH {SIDES_SQL}, m AS (SELECT side, round(avg(y), 2) AS pred FROM sides WHERE is_train GROUP BY side)
SELECT model, side, pred FROM m CROSS JOIN (VALUES {", ".join(f"('{n}')" for n in REGRESSORS)}) AS names(model)
WHERE side IN (SELECT side FROM sides WHERE NOT is_train)""")
def closed_form_regression(t):
    """Forest, both boosted profiles and the scaled target (M1, M3, M5, M9, M10)."""
    df = sides(t)
    mm = scale.MinMax(df.where("is_train"), "y")
    members = [
        Member("forest", lambda n: models.forest_regressor(1, 1).setBootstrap(False)),
        Member("boosted", lambda n: models.boosted_regressor(3, 1)),
        Member("boosted_alt", lambda n: models.leaf_wise_trees(0, 1, 1, rate=1.0)),
        Member("scaled", lambda n: models.boosted_regressor(3, 1), "features", "y_scaled", mm.restore),
    ]
    df = df.withColumn("y_scaled", mm.scale(F.col("y")))
    preds = Suite(members).fit(df.where("is_train"), "row_id").predict(df.where("not is_train"), ["side"])
    return preds.select("model", "side", F.round("pred", 2).alias("pred")).distinct()


def flags(t) -> DataFrame:
    """Line items: one 0/1 feature, two labels of two and three classes."""
    side = F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)
    # Every core fits and predicts, even if the table is one small file.
    li = spread(t.lineitem).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"), side.alias("side"), array_to_vector(F.array(side)).alias("features"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("flag"),
        (F.col("l_quantity") > 20).cast("int").alias("large"),
    )
    return li.withColumn("is_train", F.lit(True))


FLAGS_SQL = """
f AS (SELECT CASE WHEN l_linestatus = 'O' THEN 1.0::double ELSE 0 END AS side,
             CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag, (l_quantity > 20)::int AS large FROM lineitem)
, c AS (SELECT 'flag' AS label, side, flag AS y, count(*) AS n FROM f GROUP BY ALL
        UNION ALL SELECT 'large', side, large, count(*) FROM f GROUP BY ALL)"""
CLASSIFIERS = ["forest", "boosted", "boosted_alt", "logistic"]


@query("closed_form_classes", f"""
WITH {FLAGS_SQL}, best AS (SELECT label, side, arg_max(y, n)::double AS pred FROM c GROUP BY ALL)
SELECT label, model, side, pred FROM best CROSS JOIN (VALUES {", ".join(f"('{n}')" for n in CLASSIFIERS)}) AS names(model)""")
def closed_form_classes(t):
    """All four families for labels of two and three classes (M2, M4, M6, M7, M11, M12)."""
    df = flags(t)
    out = []
    for label, classes in (("flag", 3), ("large", 2)):
        members = [
            ("forest", lambda n: models.forest_classifier(1, 1).setBootstrap(False)),
            ("boosted", lambda n, c=classes: models.boosted_classes(c, 3, 1, 0.3)),
            ("boosted_alt", lambda n, c=classes: models.leaf_wise_trees(c, 3, 1)),
            ("logistic", lambda n: LogisticRegression(regParam=0.0, maxIter=100, standardization=False)),
        ]
        # Train and test part are all rows: the majority is then that of the table.
        both = stack([df, df.withColumn("is_train", F.lit(False))])
        out.append(multilabel(both, [label], members, "row_id", ["side"]))
    return stack(out).select("label", "model", "side", "pred").distinct()


@query("closed_form_softmax", f"""
WITH {FLAGS_SQL}
, n1 AS (SELECT side, count(*) FILTER (flag = 0)::double AS n0, count(*) FILTER (flag = 1)::double AS n1, count(*) FILTER (flag = 2)::double AS n2, count(*)::double AS n FROM f GROUP BY side)
, w1 AS (SELECT *, {", ".join(f"-0.3 * (n / 3 - n{k}) / (n / 3 + 1) AS a{k}" for k in range(3))} FROM n1)
, p1 AS (SELECT *, {", ".join(f"exp(a{k}) / (exp(a0) + exp(a1) + exp(a2)) AS p{k}" for k in range(3))} FROM w1)
, w2 AS (SELECT *, {", ".join(f"a{k} - 0.3 * (n * p{k} - n{k}) / (n * 1.5 * p{k} * (1 - p{k}) + 1) AS b{k}" for k in range(3))} FROM p1)
SELECT side, {", ".join(f"round(exp(b{k}) / (exp(b0) + exp(b1) + exp(b2)), 6) AS p{k}" for k in range(3))} FROM w2""")
def closed_form_softmax(t):
    """Two rounds of three classes on one 0/1 feature: each side's leaves follow from its counts (M4)."""
    df = flags(t)
    model = models.boosted_classes(3, 2, 1, 0.3).setLabelCol("flag").fit(df)
    rows = df.groupBy("side").agg(F.first("features").alias("features"))
    p = vector_to_array("probability")
    return model.transform(rows).select("side", *[F.round(p[k], 6).alias(f"p{k}") for k in range(3)])


def crossed(t) -> DataFrame:
    """Orders with two 0/1 features: the status is O, the priority is urgent."""
    s = sales_with_customer(t)
    a = F.when(F.col("status") == "O", 1.0).otherwise(0.0)
    b = F.when(F.col("priority") == "1-URGENT", 1.0).otherwise(0.0)
    return s.select("row_id", "y", "is_train", a.alias("a"), b.alias("b"), array_to_vector(F.array(a, b)).alias("features"))


@query("closed_form_leaf_wise", f"""
WITH {SALES_SQL}
, c AS (SELECT CASE WHEN status = 'O' THEN 1.0::double ELSE 0 END AS a, CASE WHEN priority = '1-URGENT' THEN 1.0::double ELSE 0 END AS b, y FROM role WHERE is_train)
, cells AS (SELECT a, b, count(*) AS n, sum(y) AS s FROM c GROUP BY a, b)
, one AS (SELECT 'a' AS first, a AS side, sum(n) AS n, sum(s) AS s, sum(s * s / n) AS parts FROM cells GROUP BY a
          UNION ALL SELECT 'b', b, sum(n), sum(s), sum(s * s / n) FROM cells GROUP BY b)
, root AS (SELECT first FROM one GROUP BY first ORDER BY sum(s * s / n) DESC, first LIMIT 1)
, sides AS (SELECT side, s / n AS mean, parts - s * s / n AS gain FROM one JOIN root USING (first))
, split AS (SELECT side FROM sides ORDER BY gain DESC, side LIMIT 1)
SELECT a, b, round(CASE WHEN sides.side = (SELECT side FROM split) THEN cells.s / cells.n ELSE mean END, 2) AS pred
FROM cells CROSS JOIN root JOIN sides ON sides.side = CASE WHEN first = 'a' THEN a ELSE b END""")
def closed_form_leaf_wise(t):
    """Three leaves on two 0/1 features: of the two sides of the first split, the one with more to gain is split again (M5)."""
    df = crossed(t)
    model = models.leaf_wise(0, 1, 1.0, 3).setLabelCol("y").fit(df.where("is_train"))
    rows = df.where("is_train").groupBy("a", "b").agg(F.first("features").alias("features"))
    return model.transform(rows).select("a", "b", F.round("prediction", 2).alias("pred"))


@query("closed_form_probability", f"""
WITH {FLAGS_SQL}, r AS (SELECT side, y, n / sum(n) OVER (PARTITION BY side) AS p FROM c WHERE label = 'large')
SELECT side, round(p, 3) AS p FROM r WHERE y = 1""")
def closed_form_probability(t):
    """An unpenalised logistic model states the rate of each side (M7)."""
    model = LogisticRegression(labelCol="large", regParam=0.0, maxIter=100, tol=1e-9, standardization=False).fit(flags(t))
    rows = flags(t).select("side", "features").groupBy("side").agg(F.first("features").alias("features"))
    return model.transform(rows).select("side", F.round(vector_to_array("probability")[1], 3).alias("p"))


@query("shapley_adds_up", f"""
WITH {SALES_SQL} SELECT row_id, method, true AS adds_up FROM role CROSS JOIN (VALUES ('exact'), ('sampled')) AS m(method) WHERE NOT is_train""")
def shapley_adds_up(t):
    """Exact and sampled values of boosted trees, for every test row (X1, X1b)."""
    df = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sales_features(t))
    train, test = df.where("is_train"), df.where("not is_train")
    suite = Suite([Member("m", lambda n: models.boosted_regressor(5, 3, 0.1))]).fit(train, "row_id")
    model, score = suite.fitted["m"], shapley.prediction_output(suite.fitted["m"])
    bg = shapley.background(train, FEATURES, "row_id", 20)
    mean = shapley._background_scores(test, bg, score, "features")[0]
    fx = models.apply_model(model, test, "f").select(F.col("row_id").alias("k"), (F.col("f") - mean).alias("gap"))
    exact = shapley.shapley_model(test, "row_id", FEATURES, score, bg).withColumn("method", F.lit("exact"))
    sampled = shapley.shapley_sampled(test, "row_id", FEATURES, score, bg, 1).withColumn("method", F.lit("sampled"))
    sums = exact.unionByName(sampled).groupBy("row_id", "method").agg(F.sum("phi").alias("phi"))
    return sums.join(fx, F.col("row_id") == F.col("k")).select("row_id", "method", (F.abs(F.col("phi") - F.col("gap")) < 1e-3).alias("adds_up"))


@query("failures_noted", "SELECT 'Broken' AS model, true AS noted")
def failures_noted(t):
    """A member that can not be fitted is noted, the others run (X11)."""
    members = [Member("forest", lambda n: models.forest_regressor(1, 1)), Member("Broken", lambda n: models.forest_regressor(1, 1), "no_such_vector")]
    failed = Suite(members).fit(sides(t).where("is_train"), "row_id").failure_table(t.spark)
    return failed.select("model", F.col("error").contains("no_such_vector").alias("noted"))
