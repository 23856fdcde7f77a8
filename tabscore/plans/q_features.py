"""Imputation, scaling, splits, text features."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from tabscore.functions.text import drop_words, with_terms, words
from tabscore.operators import clean, scale, split, tfidf
from tabscore.operators.ranks import exact_median, exact_medians
from tabscore.plans.q_tables import LINEITEM_GAPS_SQL, lineitem_with_gaps
from tabscore.plans.registry import query
from tabscore.plans.roles import FEATURES, PRIORITIES, SALES_SQL, sales, sales_features, sales_with_customer, sql_hash
from tabscore.session import spread

# A short list, so that the SQL check can state it too; the library default is longer.
STOP = "the of and to in is it that for on with as at by an be this".split()
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
TOKENS_SQL = r"regexp_extract_all(lower(text), '([\p{L}\p{N}_]{2,})', 1)"
TERMS_SQL = f"""
toks AS (SELECT doc_id, n_chars, list_filter({TOKENS_SQL}, lambda w: NOT list_contains({STOP_SQL}, w)) AS w FROM documents)
, termed AS (
  SELECT doc_id, n_chars, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS terms
  FROM toks)
"""
DOC_TRAIN = sql_hash("doc_id") + " % 10 < 8"


def documents(t):
    """Documents, on all cores even if their file is a single split."""
    return spread(t.documents, "doc_id")


@query("impute_mean", f"""
WITH {LINEITEM_GAPS_SQL}
SELECT l_orderkey, l_linenumber, round(coalesce(l_discount, (SELECT avg(l_discount) FROM li)), 8) AS l_discount FROM li""")
def impute_mean(t):
    li = lineitem_with_gaps(t).select("l_orderkey", "l_linenumber", "l_discount")
    return clean.mean_impute(li, ["l_discount"]).withColumn("l_discount", F.round("l_discount", 8))


@query("impute_median_train", f"""
WITH {LINEITEM_GAPS_SQL},
m AS (SELECT median(l_discount) AS d FROM li WHERE {sql_hash('l_orderkey')} % 10 < 8)
SELECT l_orderkey, l_linenumber, coalesce(l_discount, d) AS l_discount FROM li, m""")
def impute_median_train(t):
    li = lineitem_with_gaps(t).select("l_orderkey", "l_linenumber", "l_discount")
    return clean.median_impute(li, ["l_discount"], fit_on=li.where(split.in_train("l_orderkey")))


@query("median_exact", """
SELECT median(o_totalprice) AS med_price, median(l.med) AS med_quantity
FROM orders, (SELECT median(l_quantity) AS med FROM lineitem) l""")
def median_exact(t):
    price = exact_median(t.orders, "o_totalprice")
    quantity = exact_median(t.lineitem, "l_quantity")
    return t.spark.range(1).select(F.lit(price).alias("med_price"), F.lit(quantity).alias("med_quantity"))


def _z(cols: str) -> str:
    return f"""SELECT row_id, round((y - my) / sy, 8) AS y, round((acctbal - ma) / sa, 8) AS acctbal
FROM role, (SELECT avg(y) my, stddev_pop(y) sy, avg(acctbal) ma, stddev_pop(acctbal) sa FROM role {cols})"""


@query("standardize_all", f"WITH {SALES_SQL} {_z('')}")
def standardize_all(t):
    s = sales_with_customer(t)
    z = scale.standardize(s, ["y", "acctbal"])
    return z.select("row_id", F.round("y", 8).alias("y"), F.round("acctbal", 8).alias("acctbal"))


@query("standardize_train", f"WITH {SALES_SQL} {_z('WHERE is_train')}")
def standardize_train(t):
    s = sales_with_customer(t)
    z = scale.standardize(s, ["y", "acctbal"], fit_on=s.where("is_train"))
    return z.select("row_id", F.round("y", 8).alias("y"), F.round("acctbal", 8).alias("acctbal"))


@query("minmax_roundtrip", f"""
WITH {SALES_SQL}
SELECT row_id, round((y - lo) / (hi - lo), 8) AS scaled, round(y, 4) AS restored
FROM role, (SELECT min(y) AS lo, max(y) AS hi FROM role WHERE is_train)""")
def minmax_roundtrip(t):
    s = sales(t)
    mm = scale.MinMax(s.where("is_train"), "y")
    scaled = s.withColumn("s", mm.scale(F.col("y")))
    return scaled.select(
        "row_id", F.round("s", 8).alias("scaled"), F.round(mm.restore(F.col("s")), 4).alias("restored")
    )


@query("hash_split", f"""
SELECT coalesce(row_id::varchar, 'none') AS row_id, ({sql_hash('row_id')} % 10 < 8)::int AS is_train
FROM (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END AS row_id FROM orders)""")
def hash_split(t):
    """Rows without a key have a place too."""
    key = F.col("o_orderkey")
    keyed = t.orders.select(F.when(key % 50 != 0, key).alias("row_id"))
    return _shown(split.hash_split(keyed, "row_id"))


def _shown(df):
    return df.select(F.coalesce(F.col("row_id").cast("string"), F.lit("none")).alias("row_id"), F.col("is_train").cast("int").alias("is_train"))


@query("exact_split", f"""
SELECT coalesce(row_id::varchar, 'none') AS row_id, (rn > ceil(0.2 * n))::int AS is_train FROM (
  SELECT row_id, count(*) OVER () AS n,
         row_number() OVER (ORDER BY {sql_hash('row_id')}, row_id NULLS LAST) AS rn
  FROM (SELECT nullif(o_orderkey, 1) AS row_id FROM orders))""")
def exact_split(t):
    keyed = t.orders.select(F.nullif("o_orderkey", F.lit(1)).alias("row_id"))
    return _shown(split.exact_split(keyed, "row_id"))


@query("assign_group", f"""
SELECT o_orderkey AS row_id, CASE WHEN {sql_hash('o_orderkey', 'group')} % 2 = 0 THEN 'GroupA' ELSE 'GroupB' END AS grp
FROM orders""")
def assign_group(t):
    return t.orders.select(
        F.col("o_orderkey").alias("row_id"), split.assign_group("o_orderkey", "GroupA", "GroupB").alias("grp")
    )


@query("bounded_sample", f"""
SELECT o_orderkey AS row_id, o_totalprice AS y FROM orders ORDER BY {sql_hash('o_orderkey')}, o_orderkey LIMIT 500""")
def bounded_sample(t):
    return split.bounded_sample(sales(t).select("row_id", "y"), "row_id", 500)


_PRIO_SQL = "CASE priority " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PRIORITIES)) + " END"


@query("dual_features", f"""
WITH {SALES_SQL},
f AS (SELECT row_id, is_train, acctbal, yr::double AS yr, ({_PRIO_SQL})::double AS prio FROM role),
s AS (SELECT avg(acctbal) m0, stddev_pop(acctbal) s0, avg(yr) m1, stddev_pop(yr) s1, avg(prio) m2, stddev_pop(prio) s2
      FROM f WHERE is_train)
SELECT row_id, acctbal AS raw0, yr AS raw1, prio AS raw2, round((acctbal - m0) / s0, 8) AS z0,
       round((yr - m1) / s1, 8) AS z1, round((prio - m2) / s2, 8) AS z2 FROM f, s""")
def dual_features_query(t):
    both = dual_features(sales_features(t), FEATURES)
    raw, z = vector_to_array("raw_features"), vector_to_array("scaled_features")
    return both.select(
        "row_id", *[raw[i].alias(f"raw{i}") for i in range(3)], *[F.round(z[i], 8).alias(f"z{i}") for i in range(3)]
    )


def dual_features(df, features, train="is_train"):
    """Raw vector for trees and standardised vector for linear models, side by side."""
    scaled = scale.standardize(df, features, fit_on=df.where(F.col(train)), suffix="__z")
    raw = VectorAssembler(inputCols=features, outputCol="raw_features")
    z = VectorAssembler(inputCols=[f"{f}__z" for f in features], outputCol="scaled_features")
    return z.transform(raw.transform(scaled)).drop(*[f"{f}__z" for f in features])


@query("tokenize", f"""
SELECT doc_id, len(w) AS n, array_to_string(w, ' ') AS tokens FROM (SELECT doc_id, {TOKENS_SQL} AS w FROM documents)""")
def tokenize(t):
    w = documents(t).select("doc_id", words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n"), F.array_join("w", " ").alias("tokens"))


@query("remove_stopwords", f"""
SELECT doc_id, array_to_string(list_filter({TOKENS_SQL}, lambda w: NOT list_contains({STOP_SQL}, w)), ' ') AS tokens
FROM documents""")
def remove_stopwords(t):
    kept = drop_words(words(F.col("text")), STOP)
    return documents(t).select("doc_id", F.array_join(kept, " ").alias("tokens"))


@query("ngrams_1_2", f"""
WITH {TERMS_SQL} SELECT doc_id, array_to_string(terms, '|') AS terms FROM termed""")
def ngrams_1_2(t):
    cut = with_terms(documents(t), "text", STOP)
    return cut.select("doc_id", F.array_join("terms", "|").alias("terms"))


def _vocab_sql(where: str = "", k: int = tfidf.MAX_FEATURES) -> str:
    return f"""
vocab AS (
  SELECT term, count(*) AS total, count(DISTINCT doc_id) AS docs
  FROM (SELECT doc_id, unnest(terms) AS term FROM termed {where}) GROUP BY term ORDER BY total DESC, term LIMIT {k})
, idf AS (
  SELECT term, ln((1 + (SELECT count(*) FROM documents {where}))::double / (1 + docs)) + 1 AS idf FROM vocab)
"""


def _weights_sql(where: str = "") -> str:
    return f"""
w AS (
  SELECT doc_id, term, count(*) * any_value(idf) AS w
  FROM (SELECT doc_id, unnest(terms) AS term FROM termed {where}) JOIN idf USING (term) GROUP BY doc_id, term)
, unit AS (
  SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
"""


@query("vocab_topk", f"WITH {TERMS_SQL}, {_vocab_sql()} SELECT term, total, docs FROM vocab")
def vocab_topk(t):
    return tfidf.top_terms(tfidf.term_totals(documents(t), "text", STOP))


@query("tfidf", f"""
WITH {TERMS_SQL}, {_vocab_sql()}, {_weights_sql()} SELECT doc_id, term, round(weight, 8) AS weight FROM unit""")
def tfidf_all(t):
    docs = documents(t)
    model = tfidf.fit_tfidf(docs, "text", stop_words=STOP)
    return model.weights(docs, "doc_id", "text").withColumn("weight", F.round("weight", 8))


@query("tfidf_train_apply", f"""
WITH {TERMS_SQL}, {_vocab_sql(f'WHERE {DOC_TRAIN}')}, {_weights_sql(f'WHERE NOT ({DOC_TRAIN})')}
SELECT doc_id, term, round(weight, 8) AS weight FROM unit""")
def tfidf_train_apply(t):
    docs = split.hash_split(documents(t), "doc_id")
    model = tfidf.fit_tfidf(docs.where("is_train"), "text", stop_words=STOP)
    out = model.weights(docs.where("not is_train"), "doc_id", "text")
    return out.withColumn("weight", F.round("weight", 8))


@query("assemble_features", f"""
WITH {TERMS_SQL}, {_vocab_sql()}, {_weights_sql()},
num AS (SELECT doc_id, (n_chars - m) / s AS z
        FROM documents, (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents)),
named AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS position FROM vocab)
SELECT position, term AS feature, count(*) AS nonzero, round(sum(weight), 6) AS total
FROM unit JOIN named USING (term) GROUP BY position, term
UNION ALL
SELECT (SELECT count(*) FROM vocab), 'n_chars', count(*) FILTER (z <> 0), round(sum(z * z), 6) FROM num""")
def assemble_features(t):
    """Column totals of the assembled sparse matrix (for the number: sum of squares)."""
    docs = documents(t).select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"))
    model = tfidf.fit_tfidf(docs, "text", stop_words=STOP)
    z = scale.standardize(model.vectors(docs, "text"), ["n_chars"], fit_on=docs)
    features = tfidf.assemble(z, "tfidf", ["n_chars"])
    names = tfidf.feature_names(model, ["n_chars"])
    stat = features.select(
        Summarizer.metrics("numNonZeros", "sum", "normL2").summary(F.col("features")).alias("s")
    ).select(
        vector_to_array("s.numNonZeros").alias("nz"), vector_to_array("s.sum").alias("sum"),
        vector_to_array("s.normL2").alias("l2"),
    )
    cells = stat.select(F.posexplode(F.arrays_zip("nz", "sum", "l2")).alias("position", "c"))
    table = t.spark.createDataFrame(list(enumerate(names)), "position int, feature string")
    last = F.col("position") == len(names) - 1
    total = F.when(last, F.col("c.l2") * F.col("c.l2")).otherwise(F.col("c.sum"))
    return cells.join(F.broadcast(table), "position").select(
        F.col("position").cast("bigint").alias("position"), "feature",
        F.col("c.nz").cast("bigint").alias("nonzero"), F.round(total, 6).alias("total"),
    )


@query("label_encode_all", """
WITH o AS (SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'nan') AS status, coalesce(o_orderpriority, 'nan') AS priority FROM orders)
SELECT o_orderkey, (dense_rank() OVER (ORDER BY status) - 1)::bigint AS status, (dense_rank() OVER (ORDER BY priority) - 1)::bigint AS priority FROM o""")
def label_encode_all(t):
    """Codes of several text columns from one dictionary."""
    df = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.col("o_orderpriority").alias("priority"))
    return clean.label_encode_all(df, ["status", "priority"])


@query("median_all", """
SELECT 'l_quantity' AS feature, median(l_quantity)::double AS median FROM lineitem UNION ALL SELECT 'l_extendedprice', median(l_extendedprice)::double FROM lineitem
UNION ALL SELECT 'l_discount', median(l_discount)::double FROM lineitem UNION ALL SELECT 'l_tax', median(l_tax)::double FROM lineitem""")
def median_all(t):
    """Medians of several columns, narrowed together."""
    found = exact_medians(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return t.spark.createDataFrame(list(found.items()), "feature string, median double")
