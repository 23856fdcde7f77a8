"""Column expressions. All are built-ins, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(key: Column, salt: int | str = 42) -> Column:
    """First 32 bits of ``md5('<salt>:<key>')`` as a bigint.

    Depends on the key alone, so splits and samples do not change with the
    partitioning, the file order or a retried task. A missing key hashes like an
    empty one, so that its row has a place too.
    """
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def to_number(c: Column) -> Column:
    """Number, or NULL where the text is none (NaN counts as missing).

    A trailing d or f is a Java literal suffix which the cast would accept.
    """
    text = c.cast("string")
    return F.nanvl(F.when(~text.rlike(r"[dDfF]\s*$"), text.try_cast("double")), F.lit(None))


def as_text(c: Column) -> Column:
    """Text of a value, with the word ``nan`` for a missing one."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def at_most(c: Column, threshold: float) -> Column:
    return (c <= F.lit(threshold)).cast("int")


def above(c: Column, threshold: float | Column) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (c > t).cast("int")


def choose(cond: Column, a: Column | float, b: Column | float) -> Column:
    return F.when(cond, a).otherwise(b)


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value on one or both sides; a NULL stays NULL (``least`` would skip it)."""
    out = c
    if lo is not None:
        out = F.when(c < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(c > F.lit(hi), F.lit(hi)).otherwise(out)
    return out


def ratio_or(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den``, or ``default`` where the denominator is zero."""
    return F.when(den != 0, num / den).otherwise(F.lit(default))


def round_half_even(c: Column, digits: int) -> Column:
    """Round halves to even on the binary value, as array libraries do.

    ``bround`` works on the shortest decimal text instead and rounds 9/60000 up.
    """
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def join_text(*cols: Column, sep: str = " ") -> Column:
    """Join texts; a missing one leaves an empty piece with its separators."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def text_to_int(c: Column) -> Column:
    """Integer part of a number written in any notation, such as ``1.5e+03``."""
    return c.cast("double").cast("bigint")


def slug(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit(" "), F.lit("_")))


def feature_label(model: Column, feature: Column) -> Column:
    """Two-line chart label: model, then its feature in brackets."""
    return F.format_string("%s\n(%s)", model, feature)


def format_metric(value: Column, metric: Column) -> Column:
    """Readable number by metric name.

    Errors and gaps of a thousand or more get a K or M suffix; shares get a
    percent sign; a missing value reads N/A.
    """
    def fixed(digits: int, c: Column = value, suffix: str = "") -> Column:
        return F.format_string(f"%.{digits}f{suffix}", c)

    thousands = F.when(value >= 1_000_000, fixed(2, value / 1e6, "M")).otherwise(fixed(1, value / 1e3, "K"))
    error = F.when(value >= 1000, thousands).when(value < 1, fixed(4)).otherwise(fixed(2))
    return (
        F.when(value.isNull(), F.lit("N/A"))
        .when(metric.isin("MAE", "RMSE"), error)
        .when(metric == "R2", fixed(4))
        .when(metric.isin("MAPE", "Accuracy"), fixed(2, value, "%%"))
        .when(metric == "Fairness", F.when(value >= 1000, thousands).otherwise(fixed(4)))
        .when(metric == "Readiness", fixed(2))
        .otherwise(value.cast("string"))
    )
