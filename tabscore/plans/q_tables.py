"""Sources, sinks, projections, scalar functions and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscore.functions.scalars import above, at_most, choose, clip, join_text, round_half_even, text_to_int, to_number
from tabscore.operators import clean, reshape
from tabscore.operators.fairness import attach_group
from tabscore.operators.ranks import exact_median
from tabscore.operators.split import temporal_split
from tabscore.plans.registry import query
from tabscore.plans.roles import SALES_SQL, sales, sql_hash
from tabscore.session import scratch_path
from tabscore.sources import csvio

EVALS = sql_hash("o_orderkey") + " % 10 < 8"


def lineitem_with_gaps(t):
    """Line items with missing discounts and return flags."""
    return t.lineitem.withColumns(
        {
            "l_discount": F.nullif("l_discount", F.lit(0.0)),
            "l_returnflag": F.nullif("l_returnflag", F.lit("R")),
        }
    )


LINEITEM_GAPS_SQL = """
li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         nullif(l_discount, 0) AS l_discount, l_tax, nullif(l_returnflag, 'R') AS l_returnflag,
         l_linestatus, l_shipdate
  FROM lineitem)
"""


@query("csv_scan_na_tokens", """
SELECT c_custkey, c_name, CASE WHEN c_nationkey = 7 THEN NULL ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY') THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer""")
def csv_scan_na_tokens(t):
    seg = F.col("c_mktsegment")
    dirty = t.customer.select(
        "c_custkey",
        "c_name",
        F.when(F.col("c_nationkey") == 7, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        F.when(seg == "BUILDING", "NA").when(seg == "FURNITURE", "").when(seg == "MACHINERY", "null")
        .otherwise(seg).alias("c_mktsegment"),
    )
    path = scratch_path(t.spark, "csv-scan")
    csvio.write_csv(dirty, path)
    return csvio.read_csv(t.spark, path)


@query("sink_roundtrip_csv", """
SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, o_orderpriority,
       '  ' || o_orderstatus || ',"' || o_orderpriority || '"' || chr(10) || 'next ' AS note FROM orders""")
def sink_roundtrip_csv(t):
    """Blanks, commas, quotes and line breaks come back as they were."""
    note = F.concat(F.lit("  "), "o_orderstatus", F.lit(',"'), "o_orderpriority", F.lit('"\nnext '))
    out = t.orders.select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        "o_totalprice", "o_orderpriority", note.alias("note"),
    )
    path = scratch_path(t.spark, "csv-sink")
    csvio.write_csv(out, path)
    return csvio.read_csv(t.spark, path, schema=out.schema)


@query("sink_roundtrip_json", """
SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice FROM orders""")
def sink_roundtrip_json(t):
    out = t.orders.select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_totalprice"
    )
    path = scratch_path(t.spark, "json-sink")
    csvio.write_json(out, path)
    return t.spark.read.schema(out.schema).json(path)


@query("rows_to_json", """
SELECT to_json({'row_id': o_orderkey, 'status': nullif(o_orderstatus, 'P'), 'priority': o_orderpriority})::varchar AS json
FROM orders""")
def rows_to_json(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("row_id"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    return csvio.json_rows(rows)


@query("dropna_subset", f"""
WITH {LINEITEM_GAPS_SQL}
SELECT l_orderkey, l_partkey, l_discount, l_returnflag FROM li WHERE l_discount IS NOT NULL AND l_returnflag IS NOT NULL""")
def dropna_subset(t):
    full = clean.drop_missing(lineitem_with_gaps(t), ["l_discount", "l_returnflag"])
    return full.select("l_orderkey", "l_partkey", "l_discount", "l_returnflag")


@query("drop_target", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def drop_target(t):
    return t.customer.drop("c_acctbal")


@query("select_numeric", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""")
def select_numeric(t):
    return t.lineitem.select(*clean.numeric_columns(t.lineitem))


@query("project_features", "SELECT c_acctbal, c_nationkey, c_custkey FROM customer")
def project_features(t):
    return t.customer.select("c_acctbal", "c_nationkey", "c_custkey")


@query("select_existing", "SELECT o_orderkey, o_orderpriority FROM orders")
def select_existing(t):
    return t.orders.select(*clean.existing(t.orders, ["o_orderkey", "no_such_column", "o_orderpriority"]))


@query("temporal_split", """
SELECT o_orderkey AS row_id, CASE WHEN year(o_orderdate) < 2000 THEN 'train' ELSE 'test' END AS source FROM orders""")
def temporal(t):
    train, test = temporal_split(sales(t), "yr", 2000)
    return reshape.stack_tagged({"train": train, "test": test}).select("row_id", "source")


@query("melt_years", """
SELECT o_orderpriority AS priority, year(o_orderdate)::int AS year, round(sum(o_totalprice), 2) AS price
FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND year(o_orderdate) = 1999) GROUP BY 1, 2""")
def melt_years(t):
    s = sales(t)
    cell = F.when(~((F.col("priority") == "5-LOW") & (F.col("yr") == 1999)), F.col("y"))
    wide = (
        s.groupBy("priority").pivot("yr", reshape.column_values(s, "yr")).agg(F.sum(cell))
    )
    long = reshape.melt(wide, ["priority"], clean.year_columns(wide), "year", "price")
    kept = clean.drop_missing(long, ["price"])
    return kept.select("priority", F.col("year").cast("int").alias("year"), F.round("price", 2).alias("price"))


@query("union_tagged", """
SELECT o_orderkey AS row_id, CASE WHEN year(o_orderdate) < 2000 THEN o_orderstatus END AS status,
       CASE WHEN year(o_orderdate) < 2000 THEN 'Train' ELSE 'Test' END AS source
FROM orders""")
def union_tagged(t):
    train, test = temporal_split(sales(t), "yr", 2000)
    both = reshape.stack_tagged({"Train": train, "Test": test.drop("status")})
    return both.select("row_id", "status", "source")


@query("coerce_numeric", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS quantity FROM lineitem""")
def coerce_numeric(t):
    dirty = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
    )
    return dirty.withColumn("quantity", to_number(F.col("quantity")))


@query("text_to_int", """
SELECT o_orderkey, (o_totalprice::bigint // 100)::bigint AS whole FROM orders""")
def text_to_int_query(t):
    """Scientific notation to a truncated whole number."""
    sci = F.concat(F.round("o_totalprice").cast("bigint").cast("string"), F.lit("e-02"))
    return t.orders.select("o_orderkey", text_to_int(sci).alias("whole"))


@query("label_encode", f"""
WITH {LINEITEM_GAPS_SQL},
codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
          FROM (SELECT DISTINCT coalesce(l_returnflag, 'nan') AS v FROM li))
SELECT l_orderkey, l_linenumber, code AS l_returnflag FROM li JOIN codes ON coalesce(l_returnflag, 'nan') = v""")
def label_encode(t):
    li = lineitem_with_gaps(t).select("l_orderkey", "l_linenumber", "l_returnflag")
    return clean.label_encode(li, "l_returnflag")


@query("threshold_label", """
SELECT o_orderkey AS row_id, (o_totalprice <= 200000)::int AS small,
       (o_totalprice > (SELECT median(o_totalprice) FROM orders))::int AS over_median
FROM orders""")
def threshold_label(t):
    s = sales(t)
    return s.select(
        "row_id", at_most(F.col("y"), 200_000.0).alias("small"), above(F.col("y"), exact_median(s, "y")).alias("over_median")
    )


@query("class_to_value", f"""
WITH m AS (SELECT median(o_totalprice) AS med FROM orders WHERE {EVALS})
SELECT o_orderkey AS row_id, round(CASE WHEN o_orderpriority <= '2-HIGH' THEN med * 1.1 ELSE med * 0.9 END, 4) AS value
FROM orders, m WHERE NOT ({EVALS})""")
def class_to_value(t):
    s = sales(t)
    med = exact_median(s.where("is_train"), "y")
    pred = (F.col("priority") <= "2-HIGH").cast("int")
    value = choose(pred == 1, F.lit(med * 1.1), F.lit(med * 0.9))
    return s.where("not is_train").select("row_id", F.round(value, 4).alias("value"))


@query("clip_bounds", """
WITH v AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x FROM orders)
SELECT row_id, CASE WHEN x < 100000 THEN 100000.0 WHEN x > 300000 THEN 300000.0 ELSE x END AS both_sides,
       CASE WHEN x < 100000 THEN 100000.0 ELSE x END AS lower_only FROM v""")
def clip_bounds(t):
    x = F.when(F.col("status") != "P", F.col("y"))
    return sales(t).select(
        "row_id", clip(x, 100_000.0, 300_000.0).alias("both_sides"), clip(x, lo=100_000.0).alias("lower_only")
    )


@query("round_scores", "SELECT o_orderkey AS row_id, round_even(o_totalprice / 3, 2) AS third FROM orders")
def round_scores(t):
    return sales(t).select("row_id", round_half_even(F.col("y") / 3, 2).alias("third"))


@query("combine_text", """
SELECT doc_id, coalesce(nullif(lang, 'de'), '') || ' ' || source || ' ' || text AS combined FROM documents""")
def combine_text(t):
    return t.documents.select(
        "doc_id", join_text(F.nullif("lang", F.lit("de")), F.col("source"), F.col("text")).alias("combined")
    )


@query("fillna_const", f"""
WITH {LINEITEM_GAPS_SQL}
SELECT l_orderkey, l_linenumber, coalesce(l_discount, 0) AS l_discount, coalesce(l_returnflag, '') AS l_returnflag FROM li""")
def fillna_const(t):
    li = lineitem_with_gaps(t).select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag")
    return clean.fill(li, {"l_discount": 0.0, "l_returnflag": ""})


@query("attach_group", f"""
WITH {SALES_SQL} SELECT row_id, segment AS grp FROM role WHERE NOT is_train""")
def attach(t):
    preds = sales(t).where("not is_train").select("row_id", "custkey")
    attrs = t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("grp"))
    return attach_group(preds, attrs, "custkey").select("row_id", "grp")
