"""Quality rules with risk-controlled thresholds (operator 6).

Besides two fixed rules a text is judged by a few signals, each with a cutoff per
stratum (language). A cutoff is taken from a grid, the sharpest one that the labelled
holdout proves safe: if it rejected a share ``RISK`` or more of good texts, so few
rejections as were seen among the labelled good ones would have had an exact
binomial chance of at most ``DOUBT`` divided by the number of all tests (strata x
signals x grid, Bonferroni). The risk of a stratum is split evenly over its signals, so
all its cutoffs together reject at most ``RISK`` of its good texts. A stratum with too
few labels gets no cutoff and rejects nothing.

Only column expressions are used. Counts for all cutoffs come from one
aggregate with a map-side part; the cutoffs, one row a stratum, join back to
features without texts.

Defined results: a null text has no words and fails the base rules; a null language
is a stratum of its own; of repeated labels of one id the lowest counts; rows without
an id are judged but teach nothing; repeated rows give repeated rows and teach as one; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import column
from tabscore.session import join_lookup, materialize

LEAST_WORDS = 50
RISK = 0.05
DOUBT = 0.05
# Signal and its cutoffs, from sharp to mild; a text is rejected if the signal is above the cutoff.
SIGNALS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3),
    "dup_line_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "repeat_share": (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.45),
    "long_words": (7.0, 7.5, 8.0, 8.5, 9.0, 10.0, 11.0, 12.0, 14.0, 18.0),
    "short_words": (-5.0, -4.75, -4.5, -4.25, -4.0, -3.75, -3.5, -3.0, -2.5, -2.0),
}
WORD = r"[^\x20\x09-\x0D]+"


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Counts and signals of every row, without the text."""
    raw = F.coalesce(column(text).cast("string"), F.lit(""))
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), F.coalesce(column(stratum).cast("string"), F.lit("")).alias("stratum"), raw.alias("text"))
    split = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    windows = F.when(F.size("words") >= 3, F.transform(F.slice("words", 1, F.size("words") - 2), lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2))))
    counted = split.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0), lambda n, w: n + F.length(w)).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(windows, F.array().cast("array<string>")).alias("windows"),
    )
    # Only a text with a repeated window sorts its windows.
    sorted_windows = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    counted = counted.withColumn("sorted", sorted_windows).drop("windows")
    twice = F.filter("sorted", lambda s, j: (s["w"] == F.coalesce(F.get("sorted", j - 1)["w"], F.lit(""))) | (s["w"] == F.coalesce(F.get("sorted", j + 1)["w"], F.lit(""))))
    counted = counted.withColumn("starts", F.array_sort(F.transform(twice, lambda s: s["i"]))).drop("sorted")
    # Windows of three that start at these words cover so many words.
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + i + 3 - F.greatest(s["end"], i)).alias("n")), lambda s: s["n"])
    counted = counted.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counted.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("word_chars") / words).alias("long_words"),
        (-F.col("word_chars") / words).alias("short_words"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Chance of at most ``k`` hits in ``n`` draws of chance ``p``; 1 where k is beyond the mean."""
    odds = math.log(p / (1 - p))
    first = F.struct((n * math.log(1 - p)).alias("log"), F.exp(n * math.log(1 - p)).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        log = s["log"] + F.log((n - i + 1) / i) + odds
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(steps, first, step, lambda s: s["sum"]))


def cutoffs(rated: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """One row per ``stratum``: labelled good texts ``n``, and a cutoff (or null) of each signal."""
    marks = labels.select(column(doc_id).cast("long").alias("of"), column(quality).cast("int").alias("good")).filter("of is not null and good is not null")
    good = marks.groupBy("of").agg(F.min("good").alias("good")).filter("good = 1")
    held = rated.filter("not base_failed").join(good, F.col("doc_id") == F.col("of"), "left_semi")
    # Rows that repeat an id are no draws of their own: the largest of each signal counts.
    held = held.groupBy("doc_id", "stratum").agg(*[F.max(s).alias(s) for s in SIGNALS])
    sums = [F.sum(F.when(F.col(s) > c, 1).otherwise(0)).alias(f"{s}_{i}") for s, grid in SIGNALS.items() for i, c in enumerate(grid)]
    counts = materialize(held.groupBy("stratum").agg(F.count("*").alias("n"), *sums), "quality-counts")
    tests = counts.count() * sum(map(len, SIGNALS.values()))
    safe = []
    for s, grid in SIGNALS.items():
        proven = [F.when(binomial_tail(F.col(f"{s}_{i}"), F.col("n"), RISK / len(SIGNALS)) <= DOUBT / max(tests, 1), F.lit(c)) for i, c in enumerate(grid)]
        safe.append(F.coalesce(*proven).alias(f"{s}_cutoff"))
    return counts.select("stratum", "n", *safe)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base verdict and verdict of every row."""
    rated = materialize(features(docs), "quality-features")
    limits = cutoffs(rated, labels).drop("n")
    judged = join_lookup(rated, limits, "stratum")
    rejected = F.lit(False)
    for s in SIGNALS:
        rejected = rejected | F.coalesce(F.col(s) > F.col(f"{s}_cutoff"), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
