"""TF-IDF with smoothed weights ln((1+n)/(1+df)) + 1 and rows of length 1."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.functions.text import with_terms

MAX_FEATURES = 10_000


def term_totals(docs: DataFrame, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """Per term: occurrences and documents. One shuffle, by term, after a local sum.

    Each document lists every occurrence once and every distinct term once, so no
    grouping by document is needed.
    """
    cut = with_terms(docs.select(text), text, stop_words, "t").select(F.size("t").alias("n"), F.concat("t", F.array_distinct("t")).alias("t"))
    occurs = F.col("pos") < F.col("n")
    return (
        cut.select("n", F.posexplode("t").alias("pos", "term"))
        .groupBy("term").agg(F.sum(occurs.cast("bigint")).alias("total"), F.sum((~occurs).cast("bigint")).alias("docs"))
    )


def top_terms(totals: DataFrame, k: int = MAX_FEATURES) -> DataFrame:
    """The ``k`` most frequent terms; on equal counts the term that sorts first."""
    return totals.orderBy(F.desc("total"), "term").limit(k)


@dataclass
class Tfidf:
    """A fitted vocabulary, at most ``max_features`` terms in term order."""

    vocabulary: list[str]
    doc_freq: list[int]
    n_docs: int
    stop_words: list[str] | None

    @property
    def idf(self) -> list[float]:
        return [math.log((1 + self.n_docs) / (1 + d)) + 1 for d in self.doc_freq]

    def vectors(self, docs: DataFrame, text: str, out: str = "tfidf") -> DataFrame:
        """Append a sparse vector per document. Map-only: nothing is shuffled."""
        counts = CountVectorizerModel.from_vocabulary(self.vocabulary, "__terms", "__counts")
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="__counts", outputCol="__w")
        unit = Normalizer(p=2.0, inputCol="__w", outputCol=out)
        cut = with_terms(docs, text, self.stop_words, "__terms")
        # A document without a text has no terms.
        cut = cut.withColumn("__terms", F.coalesce("__terms", F.array().cast("array<string>")))
        return unit.transform(weigh.transform(counts.transform(cut))).drop("__terms", "__counts", "__w")

    def weights(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """Long form ``key, term, weight`` of every document. Map-only: no text is moved."""
        vector = F.unwrap_udt("v")
        cells = self.vectors(docs.select(key, text), text, "v").select(key, vector.alias("s"))
        long = cells.select(key, F.inline(F.arrays_zip(F.col("s.indices").alias("i"), F.col("s.values").alias("weight"))))
        names = F.array(*[F.lit(t) for t in self.vocabulary]) if self.vocabulary else F.array().cast("array<string>")
        return long.select(key, F.get(names, F.col("i")).alias("term"), "weight")


def fit_tfidf(
    docs: DataFrame, text: str, max_features: int = MAX_FEATURES, stop_words: list[str] | None = None
) -> Tfidf:
    """Vocabulary and document frequencies of the given (train) documents.

    At most ``max_features`` rows reach the driver.
    """
    picked = top_terms(term_totals(docs, text, stop_words), max_features)
    rows = sorted((r["term"], r["docs"]) for r in picked.collect())
    return Tfidf([t for t, _ in rows], [d for _, d in rows], docs.count(), stop_words)


def assemble(df: DataFrame, tfidf: str, numeric: list[str], out: str = "features") -> DataFrame:
    """Text vector followed by the numeric columns, kept sparse."""
    return VectorAssembler(inputCols=[tfidf, *numeric], outputCol=out, handleInvalid="error").transform(df)


def feature_names(model: Tfidf, numeric: list[str]) -> list[str]:
    return [*model.vocabulary, *numeric]
