"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a table with the columns of
documents, the last one the packed pieces. ``run`` writes each stage's table to the
shared folder and reads it back. Rows with nulls, empty texts or repeated ids pass
through as each operator defines it; columns besides those of documents are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.llm.common import reach
from tabscore.llm.language import UNKNOWN, fit, predict
from tabscore.llm.packing import added_tokens, pack
from tabscore.llm.secrets import redact
from tabscore.llm.simhash import groups
from tabscore.llm.substrings import dedup_substrings
from tabscore.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# A text whose best language is less likely than this is no text in any learned language.
LEAST_SCORE = 0.4


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter or without a likely language go."""
    reach(spark)
    docs = _documents(docs)
    # The text passes through the prediction, so it is neither joined nor moved.
    told = predict(docs, fit(docs), COLUMNS)
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that operator 2 links (3-word shingles, 2 bits), the document with the smallest id stays.

    Repeated rows (same id and text) count as one. Rows without an id go where a document
    with one stands for their group; where none does, they stay, equal texts as one.
    """
    reach(spark)
    docs = _documents(docs)
    told = groups(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = materialize(told.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).count(), "stays")
    own = docs.withColumn("_own", F.xxhash64("text"))
    kept = own.join(stays, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_mark")), "left_semi")
    # Only repeated rows make a second move of the texts worth its cost.
    if not stays.filter("count > 1").isEmpty():
        kept = kept.withColumn("_whole", F.sha2("text", 256)).dropDuplicates(["doc_id", "_whole"])
    return kept.select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; the first copy of each stays."""
    reach(spark)
    return _counted(dedup_substrings(_documents(docs)))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return _counted(redact(_documents(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences along the curve."""
    reach(spark)
    return pack(_documents(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("secret_spans", secret_spans),
    ("packed", packed),
]

# Networks, rolling hashes and tokens have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
