"""How the given tables play the parts of a benchmark: target, features, groups.

Each role is stated once for Spark and once as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.scalars import choose
from tabscore.operators.ranks import exact_median
from tabscore.operators.split import in_train
from tabscore.session import join_lookup, spread
from tabscore.sources.tables import Tables

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
GROUP_A, GROUP_B = "BUILDING", "MACHINERY"
THRESHOLD = 200_000.0
STAND_INS = ["const", "group_mean", "linear", "class_decode"]


def sql_hash(key: str, salt: int | str = 42) -> str:
    return f"('0x'||substr(md5('{salt}:'||coalesce(({key})::varchar, '')),1,8))::bigint"


def sales(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """One row per order, without the customer: key, target, year, priority, status."""
    return (t.orders if orders is None else orders).select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_totalprice").alias("y"),
        F.year("o_orderdate").alias("yr"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        in_train("o_orderkey").alias("is_train"),
    )


def sales_with_customer(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """The same with the customer's balance and segment.

    An order without a customer stays, with neither. A plain equi-join: Spark broadcasts the customers only if they are small and
    AQE splits a customer that holds most orders.
    """
    cust = t.customer.select(
        F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment")
    )
    return sales(t, orders).join(cust, "custkey", "left")


SALES_SQL = f"""
role AS (
  SELECT o_orderkey AS row_id, o_totalprice AS y, year(o_orderdate) AS yr, o_orderpriority AS priority,
         o_orderstatus AS status, c_acctbal AS acctbal, c_mktsegment AS segment,
         {sql_hash('o_orderkey')} % 10 < 8 AS is_train
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
"""


def code_of(c: Column, names: list[str]) -> Column:
    """Position of a value in a short fixed list."""
    return (F.array_position(F.lit(names), c) - 1).cast("double")


def sales_features(t: Tables) -> DataFrame:
    """Numeric features for the model queries: balance, year, priority code.

    A fit passes over its rows many times, so it should use every core even if
    the orders are one small file.
    """
    return sales_with_customer(t, spread(t.orders, "o_orderkey")).select(
        "row_id", "y", "segment", "is_train",
        F.coalesce("acctbal", F.lit(0.0)).alias("acctbal"),
        F.col("yr").cast("double").alias("yr"),
        code_of(F.col("priority"), PRIORITIES).alias("prio"),
    )


FEATURES = ["acctbal", "yr", "prio"]


def stand_in_predictions(t: Tables) -> DataFrame:
    """Test rows with four simple predictors, fitted on train rows only (wide form)."""
    role = sales_with_customer(t)
    train = role.where("is_train")
    median = exact_median(sales(t).where("is_train"), "y")
    fit = train.agg(
        F.struct(
            F.avg("y").alias("mean"),
            F.regr_slope("y", "acctbal").alias("b"),
            F.regr_intercept("y", "acctbal").alias("a"),
        )
    ).scalar()
    means = sales(t).where("is_train").groupBy("priority").agg(F.avg("y").alias("gm"))
    test = join_lookup(role.where("not is_train"), means, "priority")
    return test.select(
        "row_id", "y", "yr", "priority", "segment",
        fit["mean"].alias("const"),
        F.coalesce("gm", fit["mean"]).alias("group_mean"),
        F.coalesce(fit["a"] + fit["b"] * F.col("acctbal"), fit["mean"]).alias("linear"),
        choose(F.coalesce("acctbal", F.lit(0.0)) > 0, F.lit(median * 1.1), F.lit(median * 0.9)).alias("class_decode"),
    )


def stand_ins_long(t: Tables) -> DataFrame:
    return stand_in_predictions(t).unpivot(["row_id", "y", "segment"], STAND_INS, "model", "pred")


STAND_INS_SQL = SALES_SQL + f"""
, fit AS (
  SELECT avg(y) AS mean, regr_slope(y, acctbal) AS b, regr_intercept(y, acctbal) AS a, median(y) AS med
  FROM role WHERE is_train)
, gm AS (SELECT priority, avg(y) AS gm FROM role WHERE is_train GROUP BY priority)
, wide AS (
  SELECT row_id, y, yr, role.priority, segment, mean AS const, coalesce(gm, mean) AS group_mean,
         coalesce(a + b * acctbal, mean) AS linear, CASE WHEN acctbal > 0 THEN med * 1.1 ELSE med * 0.9 END AS class_decode
  FROM role LEFT JOIN gm ON role.priority = gm.priority CROSS JOIN fit WHERE NOT is_train)
, preds AS (
""" + " UNION ALL ".join(
    f"SELECT row_id, y, segment, '{m}' AS model, {m} AS pred FROM wide" for m in STAND_INS
) + ")"


def class_predictions(t: Tables) -> DataFrame:
    """Line items with a three-class target and rules as predictors (long form)."""
    q = F.col("l_quantity")
    flag = code_of(F.col("l_returnflag"), ["A", "N", "R"]).cast("int")
    return t.lineitem.select(
        flag.alias("y"),
        F.col("l_linestatus").alias("grp"),
        F.when(q < 17, 0).when(q < 34, 1).otherwise(2).alias("by_quantity"),
        F.lit(1).alias("always_one"),
    ).unpivot(["y", "grp"], ["by_quantity", "always_one"], "model", "pred")


CLASS_SQL = """
cls AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, l_linestatus AS grp, l_quantity AS q
  FROM lineitem)
, preds AS (
  SELECT y, grp, 'by_quantity' AS model, CASE WHEN q < 17 THEN 0 WHEN q < 34 THEN 1 ELSE 2 END AS pred FROM cls
  UNION ALL SELECT y, grp, 'always_one', 1 FROM cls)
"""
