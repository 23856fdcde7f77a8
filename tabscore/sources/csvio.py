"""CSV and JSON sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscore.sources.tables import nan_to_null

# The missing-value tokens of the usual CSV readers.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def blank_na(c: Column, tokens: list[str] = NA_TOKENS) -> Column:
    """NULL where the text is one of the missing-value tokens."""
    return F.when(~c.isin(tokens), c)


def infer_types(strings: DataFrame) -> dict[str, str]:
    """Narrowest of bigint / double / string for each all-text column, in one pass.

    A column without any value stays a string. Only one row reaches the driver.
    """
    aggs = []
    for i, name in enumerate(strings.columns):
        c = F.col(f"`{name}`")
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.count(F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), c.try_cast("bigint"))).alias(f"i{i}"),
            F.count(F.when(~c.rlike(r"[dDfF]\s*$"), c.try_cast("double"))).alias(f"d{i}"),
        ]
    row = strings.agg(*aggs).first()
    out = {}
    for i, name in enumerate(strings.columns):
        n = row[f"n{i}"]
        if n and row[f"i{i}"] == n:
            out[name] = "bigint"
        elif n and row[f"d{i}"] == n:
            out[name] = "double"
        else:
            out[name] = "string"
    return out


def has_broken_lines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a quoted value may run over several lines: its first and last line have an odd number of quotes.

    Quotes inside quoted values are doubled, so they change no parity. A stray quote in an
    unquoted value counts as well, which costs speed, not rows.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    na_tokens: list[str] = NA_TOKENS,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV with a header row; NA tokens become NULL before any type is applied.

    Values are cast strictly to ``schema``. Without it one extra pass finds the types (the
    tokens would otherwise turn a numeric column into text). ``multi_line`` keeps line
    breaks inside quotes, at the price that one file is read by one task; without it files
    are split. By default a pass over the lines, split among tasks, decides. NaN counts as missing.
    """
    if multi_line is None:
        multi_line = has_broken_lines(spark, path)
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line}
    reader = spark.read.options(**options)
    if schema is not None:
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
        raw = reader.schema(text).csv(path)
        types = {f.name: f.dataType for f in schema}
    else:
        raw = reader.csv(path)
        types = None
    clean = raw.select(*[blank_na(F.col(f"`{c}`"), na_tokens).alias(c) for c in raw.columns])
    types = types or infer_types(clean)
    return nan_to_null(clean.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in clean.columns]))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header; every value is quoted with doubled quotes, blanks and line breaks stay."""
    options = {"header": True, "quote": '"', "escape": '"', "quoteAll": True}
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**options, **blanks).csv(path)


def json_rows(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON object per row, null fields kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(out))


def write_json(df: DataFrame, path: str) -> None:
    """JSON Lines part files: the record form that many tasks can write at once."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
