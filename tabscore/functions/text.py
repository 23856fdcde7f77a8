"""Text expressions on array columns: a row's words never leave the row."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: runs of two or more letters, digits or underscores.
WORD_PATTERN = r"([\p{L}\p{N}_]{2,})"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(1))


def english_stop_words() -> list[str]:
    """The list that ships with Spark; callers may pass their own."""
    return StopWordsRemover.loadDefaultStopWords("english")


def drop_words(tokens: Column, stop_words: list[str]) -> Column:
    """Remove stop words, keeping order and repeats."""
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda w: ~w.isin(stop_words))


def one_and_two_grams(tokens: Column) -> Column:
    """The words followed by the pairs of neighbours, joined by a blank."""
    firsts = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    seconds = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(firsts, seconds, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, pairs)


def with_terms(df: DataFrame, text: str, stop_words: list[str] | None = None, out: str = "terms") -> DataFrame:
    """Append the vocabulary terms of a text: words without stop words, and their pairs.

    The words are a column of their own first. As one nested expression they
    would be cut out of the text again for every use in the pairs.
    """
    stop = english_stop_words() if stop_words is None else stop_words
    tokens = df.withColumn("__words", drop_words(words(F.col(text)), stop))
    return tokens.withColumn(out, one_and_two_grams(F.col("__words"))).drop("__words")
