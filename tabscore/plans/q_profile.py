"""Profiles of the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.operators import profile
from tabscore.plans.q_tables import lineitem_with_gaps
from tabscore.plans.registry import query
from tabscore.session import spread

# A table with declared roles: documents, of which only a part has the labels.
PAPERS = profile.Declared(numeric=["n_chars", "absent"], text=["text"], label=["quality", "toxic"])
TASKS = {
    "lineitem": ("l_returnflag", "Classification"),
    "orders": ("o_totalprice", "Regression"),
    "papers": ("quality and toxic", "Several labels"),
}


def datasets(t) -> dict:
    # One join; a document without a quality label belongs to the test part.
    papers = t.documents.join(t.labels, "doc_id", "left")
    return {
        "lineitem": lineitem_with_gaps(t),
        "orders": t.orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))),
        "papers": papers.withColumn("source", F.when(F.col("quality").isNull(), "Test").otherwise("Train")),
    }


def wide_datasets(t) -> dict:
    """The same tables on all cores: a distinct count makes one record per cell."""
    gaps = datasets(t)
    return {**gaps, "lineitem": spread(gaps["lineitem"]), "orders": spread(gaps["orders"])}


DECLARED = {"papers": PAPERS}
COLUMNS = {
    "lineitem": {
        "l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric",
        "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric",
        "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "other",
    },
    "orders": {
        "o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric",
        "o_orderdate": "other", "o_orderpriority": "categorical",
    },
    "papers": {
        "doc_id": "categorical", "text": "text", "lang": "categorical", "source": "categorical", "n_chars": "numeric",
        "quality": "label", "toxic": "label",
    },
}
# The tag of the stacked table shares its name with a document column and replaces it.
SOURCES_SQL = """
lineitem_gaps AS (
  SELECT * REPLACE (nullif(l_discount, 0) AS l_discount, nullif(l_returnflag, 'R') AS l_returnflag) FROM lineitem)
, orders_gaps AS (SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders)
, papers_gaps AS (
  SELECT doc_id, text, lang, CASE WHEN quality IS NULL THEN 'Test' ELSE 'Train' END AS source, n_chars, quality, toxic
  FROM documents LEFT JOIN labels USING (doc_id))
"""


def _prof_rows() -> str:
    rows = [
        f"SELECT '{d}' AS dataset, {i} AS position, '{c}' AS \"column\", '{kind}' AS type, count(*) AS rows,"
        f" count(*) - count({c}) AS nulls FROM {d}_gaps"
        for d, cols in COLUMNS.items() for i, (c, kind) in enumerate(cols.items())
    ]
    return SOURCES_SQL + ", prof AS (" + " UNION ALL ".join(rows) + ")"


PROF_SQL = _prof_rows()
ALL_COLUMNS = sorted({c for cols in COLUMNS.values() for c in cols})


def prof(t):
    return profile.column_profile(datasets(t), DECLARED)


def _pct(kind: str, digits: int, fn: str = "round") -> str:
    return f"{fn}(coalesce(avg(nulls / rows::double) FILTER (WHERE type = '{kind}') * 100, 0), {digits})"


def _names(kind: str) -> str:
    order = '"column"' if kind == "categorical" else "position"
    return f"coalesce(string_agg(\"column\", ',' ORDER BY {order}) FILTER (WHERE type = '{kind}'), '')"


CATALOGUE_SQL = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                "l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text",
    "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


@query("profile_catalog", " UNION ALL ".join(
    f"SELECT '{n}' AS dataset, count(*) AS rows, {len(c.split())}::bigint AS columns, "
    f"({' + '.join(f'count(*) - count({x})' for x in c.split())})::bigint AS missing FROM {n}"
    for n, c in CATALOGUE_SQL.items()
))
def profile_catalog(t):
    p = profile.column_profile(t.catalogue())
    return p.groupBy("dataset").agg(
        F.max("rows").alias("rows"), F.count("*").alias("columns"), F.sum("nulls").alias("missing")
    )


@query("missing_total", f"WITH {PROF_SQL} SELECT dataset, sum(nulls)::bigint AS missing FROM prof GROUP BY dataset")
def missing_total(t):
    return profile.missing_total(prof(t))


@query("missing_map", f"""
WITH {PROF_SQL}
SELECT dataset, '{{' || string_agg('"' || "column" || '":' || nulls, ',' ORDER BY position) || '}}' AS missing_per_column
FROM prof GROUP BY dataset""")
def missing_map(t):
    m = profile.missing_map(prof(t))
    return m.select("dataset", F.to_json("missing_per_column").alias("missing_per_column"))


@query("missing_matrix", f"WITH {PROF_SQL} SELECT dataset, " + ", ".join(
    f"round(coalesce(max(CASE WHEN \"column\" = '{c}' THEN nulls / rows::double * 100 END), 0), 6) AS {c}" for c in ALL_COLUMNS
) + " FROM prof GROUP BY dataset")
def missing_matrix(t):
    m = profile.missing_matrix(prof(t), ALL_COLUMNS)
    return m.select("dataset", *[F.round(c, 6).alias(c) for c in ALL_COLUMNS])


@query("missing_by_type", f"WITH {PROF_SQL} SELECT dataset, " + ", ".join(
    f"{_pct(k, 6)} AS pct_missing_{k}" for k in profile.TYPES
) + " FROM prof GROUP BY dataset")
def missing_by_type(t):
    m = profile.missing_by_type(prof(t))
    return m.select("dataset", *[F.round(c, 6).alias(c) for c in m.columns if c != "dataset"])


@query("feature_types", f"WITH {PROF_SQL} SELECT dataset, sum(nulls)::bigint AS total_missing, " + ", ".join(
    f"count(*) FILTER (WHERE type = '{k}') AS n_{k}, {_names(k)} AS {k}_features, "
    f"{_pct(k, 2, 'round_even')} AS pct_missing_{k}" for k in profile.TYPES
) + " FROM prof GROUP BY dataset")
def feature_types(t):
    out = profile.feature_types(prof(t))
    return out.withColumns({f"{k}_features": F.array_join(f"{k}_features", ",") for k in profile.TYPES})


@query("feature_type_share", f"""
WITH {PROF_SQL}
SELECT dataset, type, count(*) AS columns, round(100.0::double * count(*) / sum(count(*)) OVER (PARTITION BY dataset), 6) AS pct
FROM prof WHERE type <> 'other' GROUP BY dataset, type""")
def feature_type_share(t):
    return profile.feature_type_share(prof(t)).withColumn("pct", F.round("pct", 6))


@query("dataset_summary", f"""
WITH {PROF_SQL}
SELECT dataset, max(rows) AS rows, count(*) AS columns, '(' || max(rows) || ', ' || count(*) || ')' AS shape,
       CASE dataset WHEN 'lineitem' THEN 'l_returnflag' WHEN 'orders' THEN 'o_totalprice' ELSE 'quality and toxic' END AS target,
       CASE dataset WHEN 'lineitem' THEN 'Classification' WHEN 'orders' THEN 'Regression' ELSE 'Several labels' END AS task,
       round_even(avg(nulls / rows::double) * 100, 2) AS pct_missing,
       {", ".join(f"count(*) FILTER (WHERE type = '{k}') AS n_{k}, {_names(k)} AS {k}_columns" for k in ("numeric", "text", "label"))},
       '{{' || string_agg('"' || "column" || '":' || nulls, ',' ORDER BY position) || '}}' AS missing_per_column
FROM prof GROUP BY dataset""")
def dataset_summary(t):
    out = profile.dataset_summary(prof(t), TASKS)
    shape = F.format_string("(%d, %d)", F.col("shape.rows"), F.col("shape.columns"))
    lists = {f"{k}_columns": F.array_join(f"{k}_columns", ",") for k in ("numeric", "text", "label")}
    return out.withColumns(
        {**lists, "shape": shape, "missing_per_column": F.to_json("missing_per_column")}
    )


RATIO_SQL = PROF_SQL + ", ratios AS (" + " UNION ALL ".join(
    f"SELECT '{d}' AS dataset, {i} AS position, '{c}' AS \"column\", count(*) AS rows, count(DISTINCT {c}) AS \"distinct\", "
    f"round_even(count(DISTINCT {c}) / count(*)::double, 4) AS ratio FROM {d}_gaps"
    for d, cols in COLUMNS.items() for i, c in enumerate(cols)
) + ")"


@query("distinct_ratio", f"""WITH {RATIO_SQL} SELECT dataset, position::bigint AS position, "column", rows, "distinct", ratio FROM ratios""")
def distinct_ratio(t):
    return profile.distinct_ratio(wide_datasets(t)).withColumn("position", F.col("position").cast("bigint"))


@query("distinct_sketch", f"""WITH {RATIO_SQL} SELECT dataset, position::bigint AS position, "column", rows, "distinct", true AS within FROM ratios""")
def distinct_sketch(t):
    """Sketches of two parts of each table, merged, held against the exact counts within the stated error."""
    wide, merged = wide_datasets(t), []
    for name, df in wide.items():
        first = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) % 2 == 0
        merged.append(profile.merge_sketches(profile.sketch_profile(df.where(first), name), profile.sketch_profile(df.where(~first), name)))
    told = profile.sketch_ratio(reduce(DataFrame.unionByName, merged)).select("dataset", "column", F.col("distinct").alias("estimate"))
    exact = profile.distinct_ratio(wide)
    within = F.abs(F.col("estimate") - F.col("distinct")) <= profile.sketch_error() * F.col("distinct")
    # One row a column of the profiled tables on either side.
    return exact.join(told, ["dataset", "column"]).select("dataset", F.col("position").cast("bigint").alias("position"), "column", "rows", "distinct", within.alias("within"))


@query("diversity_summary", f"""
WITH {RATIO_SQL}
SELECT dataset, round_even(avg(ratio), 4) AS avg_diversity,
       (max({{'r': ratio, 'o': -position, 'c': "column"}})).c AS max_feature, max(ratio) AS max_score,
       (min({{'r': ratio, 'o': position, 'c': "column"}})).c AS min_feature, min(ratio) AS min_score,
       string_agg("column" || '=' || printf('%.4f', ratio), ',' ORDER BY position) AS all_scores
FROM ratios GROUP BY dataset""")
def diversity_summary(t):
    out = profile.diversity_summary(profile.distinct_ratio(wide_datasets(t)))
    shown = F.transform(
        F.map_entries("all_scores"), lambda e: F.format_string("%s=%.4f", e["key"], e["value"])
    )
    return out.withColumn("all_scores", F.array_join(shown, ","))


@query("null_patterns", f"""
WITH {SOURCES_SQL}
SELECT concat({", ".join(f"({c} IS NULL)::int" for c in COLUMNS['lineitem'])}) AS pattern, count(*) AS rows
FROM lineitem_gaps GROUP BY 1""")
def null_patterns(t):
    return profile.null_patterns(lineitem_with_gaps(t))


@query("null_matrix", f"""
WITH {SOURCES_SQL} SELECT {", ".join(f"o.{c} IS NULL AS {c}" for c in COLUMNS['orders'])} FROM orders_gaps o""")
def null_matrix(t):
    return profile.null_matrix(datasets(t)["orders"])
