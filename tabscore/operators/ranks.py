"""Exact order statistics and dense numbering without one big sort in one task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscore.functions.scalars import hash32
from tabscore.session import fetch_small, local_table, materialize

# Values that one task may sort to finish a selection.
FINISH_ROWS = 1_000_000


def exact_median(df: DataFrame, col: str, finish_rows: int = FINISH_ROWS) -> float | None:
    """Exact median of a numeric column; midpoint of the two middle values."""
    return exact_medians(df, [col], finish_rows)[col]


@dataclass
class _Search:
    """One column's open interval around its middle rank: ``rank`` of the ``size`` values inside is wanted."""

    x: Column
    n: int
    rank: int
    size: int
    cuts: list[float]
    low: float | None = None
    high: float | None = None
    found: float | None = None
    after: float | None = None

    @property
    def inside(self) -> Column:
        held = F.lit(True)
        if self.low is not None:
            held = held & (self.x > self.low)
        return held if self.high is None else held & (self.x < self.high)


def exact_medians(df: DataFrame, cols: list[str], finish_rows: int = FINISH_ROWS) -> dict[str, float | None]:
    """Exact medians of numeric columns, None for one without values.

    The built-in exact median keeps every distinct value of a column in one task.
    Here each pass narrows an open interval around the middle rank of every column with a
    bounded quantile sketch and counts what lies below it, until the intervals hold few rows.
    One pass serves all columns, so their number does not change the number of passes; one
    row per pass reaches the driver.
    """
    doubles = [F.col(f"`{c}`").cast("double") for c in cols]
    rows = df.select(*[F.when(~F.isnan(d), d).alias(f"x{i}") for i, d in enumerate(doubles)])
    if not cols:
        return {}
    xs = {c: F.col(f"x{i}") for i, c in enumerate(cols)}
    near = [0.5 - 1e-3, 0.5 + 1e-3]
    first = rows.agg(*[F.struct(F.count(x).alias("n"), F.percentile_approx(x, near, 10_000).alias("q")).alias(f"s{i}") for i, x in enumerate(xs.values())]).first()
    searches = {c: _Search(x, s["n"], (s["n"] - 1) // 2, s["n"], s["q"]) for (c, x), s in zip(xs.items(), first) if s["n"]}
    share = max(1, finish_rows // max(len(searches), 1))
    while wide := [s for s in searches.values() if s.found is None and s.size > share]:
        _narrow(rows, wide)
        wide = [s for s in wide if s.found is None and s.size > share]
        if wide:
            at = [(s.rank + 0.5) / s.size for s in wide]
            probes = [[max(a - 1e-3, 0.0), min(a + 1e-3, 1.0)] for a in at]
            cuts = rows.agg(*[F.percentile_approx(F.when(s.inside, s.x), p, 10_000).alias(f"q{i}") for i, (s, p) in enumerate(zip(wide, probes))]).first()
            for s, q in zip(wide, cuts):
                s.cuts = q
    if left := [s for s in searches.values() if s.found is None]:
        lists = [F.slice(F.array_sort(F.collect_list(F.when(s.inside, s.x))), s.rank + 1, 2).alias(f"v{i}") for i, s in enumerate(left)]
        for s, v in zip(left, rows.agg(*lists).first()):
            s.found, s.after = v[0], v[1] if len(v) > 1 else None
    if open_ := [s for s in searches.values() if s.n % 2 == 0 and s.after is None]:
        # The upper middle value lies outside the last interval: the same value, or the next larger.
        told = [F.struct(F.count(F.when(s.x <= s.found, 1)).alias("upto"), F.min(F.when(s.x > s.found, s.x)).alias("next")).alias(f"t{i}") for i, s in enumerate(open_)]
        for s, t in zip(open_, rows.agg(*told).first()):
            s.after = s.found if t["upto"] > s.n // 2 else t["next"]
    return {c: None if c not in searches else _middle(searches[c]) for c in cols}


def _middle(s: _Search) -> float:
    return s.found if s.n % 2 else (s.found + s.after) / 2


def _narrow(rows: DataFrame, searches: list[_Search]) -> None:
    """One pass: where the wanted ranks lie, below, at, between or above the cuts."""
    counts = []
    for i, s in enumerate(searches):
        a, b = s.cuts
        parts = {"below": s.x < a, "at_a": s.x == a, "mid": (s.x > a) & (s.x < b), "at_b": s.x == b}
        counts.append(F.struct(*[F.count(F.when(s.inside & p, 1)).alias(name) for name, p in parts.items()]).alias(f"c{i}"))
    for s, c in zip(searches, rows.agg(*counts).first()):
        a, b = s.cuts
        below, upto_a = c["below"], c["below"] + c["at_a"]
        upto_mid = upto_a + c["mid"]
        upto_b = upto_mid + (c["at_b"] if b > a else 0)
        if below <= s.rank < upto_a:
            s.found = a
        elif upto_mid <= s.rank < upto_b:
            s.found = b
        elif s.rank < below:
            s.high, s.size = a, below
        elif s.rank < upto_mid:
            s.low, s.high, s.rank, s.size = a, b, s.rank - upto_a, c["mid"]
        else:
            s.low, s.rank, s.size = b, s.rank - upto_b, s.size - upto_b


def hash_prefix_cut(df: DataFrame, key: str, count: Callable[[int], int], salt: int | str) -> Column:
    """True for exactly ``count(rows)`` rows: those first by (hash of the key, key).

    The key should be unique; rows that share a key stay on one side. A missing key
    comes after all others of its hash value.

    Two histograms of at most 65,536 bins find the hash value at the border; the
    few rows that share this 32-bit value are settled by key. Only the
    histograms reach the driver, and the table is neither sorted nor shuffled.
    """
    keyed = df.select(F.col(key).alias("k"), hash32(F.col(key), salt).alias("h"))
    high, low = F.shiftright("h", 16), F.col("h").bitwiseAND(F.lit(65535))
    top = _border_bin(keyed.groupBy(high.alias("bin")).count(), lambda n: count(n))
    if top is None:
        return F.lit(False)
    want = top["left"]
    second = _border_bin(keyed.where(high == top["bin"]).groupBy(low.alias("bin")).count(), lambda n: want)
    edge = top["bin"] * 65536 + second["bin"]
    # Distinct keys of one 32-bit value: a handful, however often a key repeats.
    tied = keyed.where(F.col("h") == edge).groupBy(F.col("k").alias("bin")).count()
    last = _border_bin(tied, lambda n: second["left"])["bin"]
    h = hash32(F.col(key), salt)
    upto = F.lit(True) if last is None else F.coalesce(F.col(key) <= F.lit(last), F.lit(False))
    return (h < edge) | ((h == edge) & upto)


def _border_bin(bins: DataFrame, count: Callable[[int], int]) -> dict | None:
    """Bin (of a bounded number) in which the running count reaches the wanted one, and how many it must still give."""
    table = bins.toArrow().sort_by("bin")
    sizes = table["count"].to_numpy()
    upto = sizes.cumsum()
    want = count(int(upto[-1])) if len(upto) else 0
    if want <= 0:
        return None
    i = int(upto.searchsorted(want))
    return {"bin": table["bin"][i].as_py(), "left": int(want - upto[i] + sizes[i])}


def number_within(values: DataFrame, group: str, col: str, out: str = "code") -> DataFrame:
    """Dense numbers 0..k-1 for the distinct values of each group, in ascending order, all groups in one sort."""
    small = fetch_small(values.select(group, col))
    if small is not None:
        local = local_table(values.sparkSession, small)
        return local.select(group, col, (F.row_number().over(Window.partitionBy(group).orderBy(col)) - 1).cast("bigint").alias(out))
    return _number_groups_by_partition(values.select(group, col), group, col, out)


def _number_groups_by_partition(values: DataFrame, group: str, col: str, out: str) -> DataFrame:
    placed = materialize(values.orderBy(group, col).select(group, col, F.monotonically_increasing_id().alias("mid")), "ordered")
    part = F.shiftright("mid", 33)
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per group and partition of the sort that holds it: at most their two numbers together.
    starts = placed.groupBy(group, part.alias("part")).agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    starts = starts.select(F.col(group).alias("__group"), F.col("part").alias("__part"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    same = (F.col(group) == F.col("__group")) & (part == F.col("__part"))
    return placed.join(F.broadcast(starts), same).select(group, col, (F.col("start") + F.col("mid") - F.col("first")).alias(out))


def number_in_order(values: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Dense numbers 0..k-1 for distinct values in ascending order.

    A small set is numbered by one window. A large one is range-sorted, written
    once (so that partitions stay as they are) and numbered by adding to each
    row the sizes of the partitions before its own.
    """
    small = fetch_small(values.select(col))
    if small is not None:
        w = Window.orderBy(col)
        local = local_table(values.sparkSession, small)
        return local.select(col, (F.row_number().over(w) - 1).cast("bigint").alias(out))
    return _number_by_partition(values.select(col), col, out)


def _number_by_partition(values: DataFrame, col: str, out: str) -> DataFrame:
    placed = values.orderBy(col).select(col, F.monotonically_increasing_id().alias("mid"))
    stored = materialize(placed, "ordered")
    part = F.shiftright("mid", 33)
    within = F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort: bounded by spark.sql.shuffle.partitions.
    starts = (
        stored.groupBy(part.alias("part")).count()
        .select("part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("start"))
    )
    return (
        stored.withColumn("part", part)
        .join(F.broadcast(starts), "part")
        .select(col, (F.col("start") + within).alias(out))
    )
