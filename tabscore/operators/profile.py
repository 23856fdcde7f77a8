"""Profiles of whole tables: missing cells, feature types, distinct values.

Each table is read once for its null counts, and every figure on missing cells
derives from that pass. Exact distinct counts take one more pass; estimated ones come from
sketches that can be kept and merged as files arrive.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscore.functions.scalars import round_half_even
from tabscore.operators.clean import existing, numeric_columns, text_columns
from tabscore.operators.reshape import stack, to_matrix
from tabscore.sources.tables import nan_to_null

# Registers of a distinct-value sketch, as a power of two: standard error 1.6 %.
SKETCH_LG_K = 12

TYPES = ["numeric", "categorical", "text", "label"]


@dataclass(frozen=True)
class Declared:
    """Column roles of a data set that states them; any named column may be absent.

    Columns in none of the lists are categorical.
    """

    numeric: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    label: list[str] = field(default_factory=list)


# Column roles of the school budget tables.
BUDGET_COLUMNS = Declared(
    numeric=["FTE", "Total"],
    text=[
        "Facility_or_Department", "Function_Description", "Fund_Description",
        "Job_Title_Description", "Location_Description", "Object_Description",
        "Position_Extra", "Program_Description", "SubFund_Description",
        "Sub_Object_Description", "Text_1", "Text_2", "Text_3", "Text_4",
    ],
    label=[
        "Function", "Object_Type", "Operating_Status", "Position_Type",
        "Pre_K", "Reporting", "Sharing", "Student_Type", "Use",
    ],
)


def columns_by_type(df: DataFrame, declared: Declared | None = None) -> dict[str, list[str]]:
    """Column names by feature type, from the schema or from declared roles."""
    if declared is None:
        return {"numeric": numeric_columns(df), "categorical": text_columns(df), "text": [], "label": []}
    named = {t: existing(df, getattr(declared, t)) for t in ("numeric", "text", "label")}
    known = {c for cols in named.values() for c in cols}
    rest = sorted(c for c in df.columns if c not in known)
    return {**named, "categorical": rest}


def column_profile(
    datasets: dict[str, DataFrame], declared: dict[str, Declared] | None = None
) -> DataFrame:
    """One row per data set and column: position, type, rows, nulls. One pass per table."""
    declared = declared or {}
    return stack([_one_profile(n, df, declared.get(n)) for n, df in datasets.items()])


def _one_profile(name: str, df: DataFrame, declared: Declared | None) -> DataFrame:
    df = nan_to_null(df)
    kinds = {c: t for t, cols in columns_by_type(df, declared).items() for c in cols}
    counts = df.agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.lit(kinds.get(c, "other")).alias("type"),
                (F.col("rows") - F.col(f"c{i}")).alias("nulls"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    return counts.select(F.lit(name).alias("dataset"), "rows", F.explode(cells).alias("c")).select(
        "dataset", "c.position", "c.column", "c.type", "rows", "c.nulls"
    )


def null_share() -> Column:
    """Share of missing cells of a profile row; 0 for an empty table."""
    return F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(F.lit(0.0))


def missing_total(profile: DataFrame) -> DataFrame:
    return profile.groupBy("dataset").agg(F.sum("nulls").alias("missing"))


def missing_map(profile: DataFrame) -> DataFrame:
    """Map column -> null count, in column order."""
    entries = F.array_sort(F.collect_list(F.struct("position", "column", "nulls")))
    pairs = F.transform(entries, lambda e: F.struct(e["column"], e["nulls"]))
    return profile.groupBy("dataset").agg(F.map_from_entries(pairs).alias("missing_per_column"))


def missing_matrix(profile: DataFrame, columns: list[str]) -> DataFrame:
    """Data set x column: percent missing; 0 where a data set lacks the column."""
    long = profile.select("dataset", "column", (null_share() * 100).alias("pct"))
    return to_matrix(long, "dataset", "column", "pct", columns).na.fill(0.0)


def missing_by_type(profile: DataFrame, digits: int | None = None) -> DataFrame:
    """Unweighted mean of the column rates inside each feature type, in percent."""
    def pct(t: str) -> Column:
        c = F.coalesce(F.avg(F.when(F.col("type") == t, null_share())) * 100, F.lit(0.0))
        return (c if digits is None else round_half_even(c, digits)).alias(f"pct_missing_{t}")

    return profile.groupBy("dataset").agg(*[pct(t) for t in TYPES])


def feature_types(profile: DataFrame) -> DataFrame:
    """Counts and name lists by feature type, total and rates of missing cells."""
    def names(t: str) -> Column:
        hits = F.array_sort(F.collect_list(F.when(F.col("type") == t, F.struct("position", "column"))))
        return F.transform(hits, lambda e: e["column"])

    def lists(t: str) -> Column:
        out = names(t)
        return (F.array_sort(out) if t == "categorical" else out).alias(f"{t}_features")

    counted = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES]
    base = profile.groupBy("dataset").agg(
        *counted, F.sum("nulls").alias("total_missing"), *[lists(t) for t in TYPES]
    )
    return base.join(missing_by_type(profile, digits=2), "dataset")


def feature_type_share(profile: DataFrame) -> DataFrame:
    """Share of each feature type among the typed columns, in percent."""
    typed = profile.where(F.col("type") != "other")
    total = F.sum(F.lit(1))
    wide = typed.groupBy("dataset").agg(
        total.alias("n"), *[F.count_if(F.col("type") == t).alias(t) for t in TYPES]
    )
    long = wide.unpivot(["dataset", "n"], TYPES, "type", "columns").where("columns > 0")
    return long.select("dataset", "type", "columns", (F.col("columns") * 100.0 / F.col("n")).alias("pct"))


def dataset_summary(profile: DataFrame, tasks: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per data set; ``tasks`` maps a data set to (target, task)."""
    def pick(i: int) -> Column:
        out = F.lit(None).cast("string")
        for name, pair in tasks.items():
            out = F.when(F.col("dataset") == name, F.lit(pair[i])).otherwise(out)
        return out

    def names(t: str) -> Column:
        hits = F.array_sort(F.collect_list(F.when(F.col("type") == t, F.struct("position", "column"))))
        return F.transform(hits, lambda e: e["column"])

    counted = ("numeric", "text", "label")
    base = profile.groupBy("dataset").agg(
        F.max("rows").alias("rows"),
        F.count("*").alias("columns"),
        round_half_even(F.avg(null_share()) * 100, 2).alias("pct_missing"),
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in counted],
        *[names(t).alias(f"{t}_columns") for t in counted],
    )
    return (
        base.join(missing_map(profile), "dataset")
        .withColumn("shape", F.struct("rows", "columns"))
        .withColumn("target", pick(0))
        .withColumn("task", pick(1))
    )


def null_matrix(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").isNull().alias(c) for c in df.columns])


def null_patterns(df: DataFrame) -> DataFrame:
    """Rows per combination of missing cells: 1 marks a missing cell, in column order.

    Rows are counted in each task before the shuffle, so a pattern that holds
    most rows is one record per task.
    """
    pattern = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns])
    return df.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("rows"))


def _identity(df: DataFrame, name: str) -> Column:
    """A value as bytes, equal for equal values; long ones become a SHA-256 digest.

    The digest keeps whole documents out of the shuffle.
    """
    c = F.col(f"`{name}`")
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0.0)).cast("string").cast("binary")  # -0.0 equals 0.0
    if isinstance(kind, T.StringType):
        b = c.cast("binary")
    elif isinstance(kind, T.BinaryType):
        b = c
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        b = F.to_json(c).cast("binary")
    else:
        return c.cast("string").cast("binary")
    return F.when(F.octet_length(b) > 40, F.unhex(F.sha2(b, 256))).otherwise(b)


def distinct_counts(df: DataFrame, name: str) -> DataFrame:
    """Distinct non-missing values per column: one scan, one shuffle of (column, value).

    Several ``count(distinct)`` in one aggregate would copy whole rows once per
    column; here a copy holds one short value, and repeats collapse before the shuffle.
    """
    df = nan_to_null(df)
    cells = F.array(
        *[F.struct(F.lit(i).alias("position"), _identity(df, c).alias("v")) for i, c in enumerate(df.columns)]
    )
    pairs = df.select(F.explode(cells).alias("c")).select("c.*").where("v is not null").distinct()
    found = pairs.groupBy("position").agg(F.count("*").alias("distinct"))
    # Start from the null counts, so that a column without any value is kept.
    return (
        _one_profile(name, df, None)
        .join(found, "position", "left")
        .select("dataset", "position", "column", "rows", F.coalesce("distinct", F.lit(0)).alias("distinct"))
    )


def distinct_ratio(datasets: dict[str, DataFrame], digits: int = 4) -> DataFrame:
    """Distinct values / rows per column, rounded."""
    per = [distinct_counts(df, n) for n, df in datasets.items()]
    ratio = F.when(F.col("rows") > 0, F.col("distinct") / F.col("rows")).otherwise(F.lit(0.0))
    return reduce(DataFrame.unionByName, per).withColumn("ratio", round_half_even(ratio, digits))


def sketch_profile(df: DataFrame, name: str, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """Rows, nulls and a sketch of the distinct values of every column: the part of a profile that can be kept.

    One scan; a task sends one sketch of at most ``2 ** lg_k`` bytes a column, no values. Profiles of
    files that arrive later are added by ``merge_sketches``, without reading the old files again.
    """
    df = nan_to_null(df)
    names = [f"`{c}`" for c in df.columns]
    found = df.agg(
        F.count("*").alias("rows"),
        *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(names)],
        *[F.hll_sketch_agg(_identity(df, c), F.lit(lg_k)).alias(f"s{i}") for i, c in enumerate(df.columns)],
    )
    cells = [
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), (F.col("rows") - F.col(f"c{i}")).alias("nulls"), F.col(f"s{i}").alias("sketch")
        )
        for i, c in enumerate(df.columns)
    ]
    return found.select(F.lit(name).alias("dataset"), "rows", F.explode(F.array(*cells)).alias("c")).select("dataset", "c.position", "c.column", "rows", "c.nulls", "c.sketch")


def merge_sketches(*profiles: DataFrame) -> DataFrame:
    """One profile of all rows that the given ones have seen. Another order of merging may move an estimate within its error."""
    return stack(list(profiles)).groupBy("dataset", "position", "column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("sketch").alias("sketch")
    )


def sketch_error(lg_k: int = SKETCH_LG_K, deviations: float = 4.0) -> float:
    """The relative error that an estimate keeps to: so many standard errors of a sketch with ``2 ** lg_k`` registers."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def sketch_ratio(profile: DataFrame, digits: int = 4) -> DataFrame:
    """As ``distinct_ratio``, from sketches: estimated distinct values, never more than the values that are there."""
    distinct = F.least(F.hll_sketch_estimate("sketch"), F.col("rows") - F.col("nulls"))
    ratio = F.when(F.col("rows") > 0, F.col("distinct") / F.col("rows")).otherwise(F.lit(0.0))
    return profile.select("dataset", "position", "column", "rows", distinct.alias("distinct")).withColumn("ratio", round_half_even(ratio, digits))


def diversity_summary(ratios: DataFrame, digits: int = 4) -> DataFrame:
    """Mean, largest and smallest ratio with their columns; ties go to the first column."""
    entries = F.array_sort(F.collect_list(F.struct("position", "column", "ratio")))
    pairs = F.transform(entries, lambda e: F.struct(e["column"], e["ratio"]))
    order = F.col("position")
    top = F.max(F.struct(F.col("ratio"), (-order).alias("o"), F.col("column")))
    low = F.min(F.struct(F.col("ratio"), order.alias("o"), F.col("column")))
    return ratios.groupBy("dataset").agg(
        round_half_even(F.avg("ratio"), digits).alias("avg_diversity"),
        top["column"].alias("max_feature"),
        top["ratio"].alias("max_score"),
        low["column"].alias("min_feature"),
        low["ratio"].alias("min_score"),
        F.map_from_entries(pairs).alias("all_scores"),
    )
