"""Gradient boosting with leaf-wise trees and joint softmax, where Spark's own boosting has neither.

Rows are cut into bins once, sparse features by their stored entries only. A tree grows
best-first: of all leaves the one with the largest gain is split next, up to ``leaves`` leaves
and ``depth`` levels; with a depth and no bound on leaves this is the usual level-wise tree.
A round has one tree per class, grown side by side on the gradients of one softmax.

One pass over the rows sums gradients by (node, feature, bin), in each task first. It
serves every node that might be split soon, so a tree takes about as many passes as it has
levels, not one per leaf; nodes that were looked at too early are dropped again. Gradients are
whole numbers of a fixed scale, so sums do not depend on the order of rows or tasks.
Only the best split of each node reaches the driver; it states the sums of both children, so that
leaves which can not be split again need no pass. Margins are written every few rounds,
so that a pass applies few trees.

Rows that agree in all bins (and in their class) move together: where they are many, they are
added up to one row with a count once, before the first round. The sums stay the same, and a table with few
different rows costs its passes by these.

All rows of a batch are one record of packed columns, so a pass costs Spark little per row: the
rows are only taken apart in arrays. Where few rows are left, the driver holds their records and makes the
same passes without jobs; where a pass has few cells, the tasks hand their sums to the driver at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.operators.tree_shapley import TreeTable, dense_matrices
from tabscore.session import materialize, reach

# Rounds after which margins are written; cells of a dense piece of rows; keys a task holds before it adds them up.
WRITE_ROUNDS = 4
CELLS_AT_ONCE = 1 << 20
KEYS_AT_ONCE = 1 << 20
# Cells (node, feature, bin) that are added up over the tasks together.
BLOCK_CELLS = 1 << 16
# Rows are added up where at most this share of them differs; files and rows of a file that the others are written to.
DIFFERENT = 0.5
FILES, FILE_ROWS = 32, 1 << 20
# Columns up to which bins are looked up column by column.
FEW_COLUMNS = 256
# Cells (row, feature) up to which the driver holds the rows; sums that all tasks of a pass may hand to it.
HELD_CELLS = 1 << 18
HANDED_SUMS = 1 << 21
# Bits that a sum of gradients may fill.
SUM_BITS = 60
# ``t`` is the sum of a number's distances from the base, in whole steps; ``n`` counts the rows.
ENTRIES = "id long, y double, t long, n long, feature array<int>, bin array<int>"
# The rows of a batch as one record. Without ``id``, ``y`` and ``t`` these are zeros, without ``n`` ones; without ``feature`` every row stores every feature in order.
BLOCKS = "rows long, id binary, y binary, t binary, n binary, sizes binary, feature binary, bin binary, margin binary"
BLOCK_ROWS, BLOCK_ENTRIES = 1 << 14, 1 << 20


@dataclass(frozen=True)
class Growth:
    """What a fit is told: ``classes`` is 0 for numbers, else their count."""

    classes: int = 0
    rounds: int = 200
    rate: float = 0.1
    leaves: int | None = 31
    depth: int | None = None
    l2: float = 0.0
    least_rows: int = 20
    least_weight: float = 1e-3
    bins: int = 255
    rows: float = 1.0
    columns: float = 1.0
    seed: int = 42

    @property
    def trees(self) -> int:
        return self.classes if self.classes > 2 else 1


@dataclass
class Node:
    """A node while its tree grows; ``split`` is (gain, feature, bin) once it is known, None where there is none; ``parts`` are both sides' totals."""

    depth: int
    total: tuple[int, int, int] | None = None
    known: bool = False
    parts: tuple[tuple[int, int, int], tuple[int, int, int]] | None = None
    split: tuple[float, int, int] | None = None
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=lambda: [Node(0)])
    leaves: set[int] = field(default_factory=lambda: {0})
    done: bool = False

    def arrays(self, all_known: bool) -> tuple[np.ndarray, ...]:
        """Feature, bin, left, right by node; ``all_known`` follows splits that are not taken yet."""
        inner = self.inner()
        taken = [n.left >= 0 and (all_known or i in inner) for i, n in enumerate(self.nodes)]
        cells = [(n.split[1], n.split[2], n.left, n.right) if t else (-1, 0, -1, -1) for n, t in zip(self.nodes, taken)]
        return tuple(np.array(c, np.int64) for c in zip(*cells))

    def inner(self) -> set[int]:
        """The nodes that are split: those that lead to the leaves."""
        found, waiting = set(), [0]
        while waiting:
            at = waiting.pop()
            if at not in self.leaves and self.nodes[at].left >= 0:
                found.add(at)
                waiting += [self.nodes[at].left, self.nodes[at].right]
        return found


def descend(bins: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The node of each row of a dense bin matrix."""
    feature, cut, left, right = tree
    inner, own, asked = left >= 0, np.arange(len(left)), np.maximum(feature, 0)
    # A leaf leads to itself.
    ways = np.stack([np.where(inner, right, own), np.where(inner, left, own)], axis=1).ravel()
    flat, rows = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
    at = np.zeros(len(bins), np.int64)
    while inner[at].any():
        at = ways[2 * at + (flat[rows + asked[at]] <= cut[at])]
    return at


def gradients(y: np.ndarray, margin: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives: rows x trees."""
    if classes == 0:
        return margin - y[:, None], np.ones_like(margin)
    if classes <= 2:
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return p - y[:, None], p * (1 - p)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - (y[:, None] == np.arange(classes)), classes / (classes - 1) * p * (1 - p)


def sampled(ids: np.ndarray, turn: int, share: float, seed: int) -> np.ndarray:
    """A share of ids by a hash that depends on the round."""
    if share >= 1:
        return np.ones(len(ids), bool)
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn * 1_000_003 + seed) % (1 << 63))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(float) / (1 << 53) < share


class Bins:
    """Thresholds by feature: a value's bin is the number of thresholds below it."""

    def __init__(self, thresholds: list[np.ndarray]):
        self.thresholds = thresholds
        self.zero = np.array([np.searchsorted(t, 0.0) for t in thresholds], np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in thresholds])]).astype(np.int64)
        self.flat = np.concatenate([*thresholds, np.zeros(0)])

    def codes(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Bins of the entries of many rows: feature by feature where every row stores all of them in order."""
        width = len(self.thresholds)
        if not len(feature):
            return np.zeros(0, np.int64)
        if width > FEW_COLUMNS or len(feature) % width or not (feature.reshape(-1, width) == np.arange(width)).all():
            return self.code(feature, value)
        value = np.where(np.isnan(value), np.inf, value).reshape(-1, width)
        return np.stack([np.searchsorted(t, v) for t, v in zip(self.thresholds, value.T)], axis=1).ravel().astype(np.int64)

    def code(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Bins of entries; a missing number is beyond all thresholds."""
        low, high = self.starts[feature], self.starts[feature + 1]
        start = low.copy()
        value = np.where(np.isnan(value), np.inf, value)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            above = self.flat[np.minimum(middle, max(len(self.flat) - 1, 0))] < value if len(self.flat) else np.zeros(len(low), bool)
            low = np.where(open_ & above, middle + 1, low)
            high = np.where(open_ & ~above, middle, high)
        return low - start


def fit_bins(rows: DataFrame, width: int, most: int) -> Bins:
    """Thresholds from the stored entries ``feature, value``: all distinct values where there are few, else quantiles."""
    cells = rows.select(F.explode("e").alias("e")).select("e.feature", "e.value").filter("value is not null and not isnan(value)")
    counts = cells.groupBy("feature").agg(
        F.approx_count_distinct("value").alias("distinct"), F.max("value").alias("top"),
        F.percentile_approx("value", [i / most for i in range(1, most)], 10_000).alias("cuts"),
    ).collect()
    few = [r["feature"] for r in counts if r["distinct"] <= most // 2]
    exact = {}
    if few:
        wanted = cells.join(F.broadcast(rows.sparkSession.createDataFrame([(f,) for f in few], "feature int")), "feature")
        exact = {r["feature"]: r["v"] for r in wanted.groupBy("feature").agg(F.sort_array(F.collect_set("value")).alias("v")).collect()}
    thresholds: list[np.ndarray] = [np.zeros(0)] * width
    for r in counts:
        values = np.unique([*exact.get(r["feature"], r["cuts"]), 0.0])
        # Zeros need not be stored; the largest value separates nothing.
        thresholds[r["feature"]] = values[values < max(r["top"], 0.0)]
    return Bins(thresholds)


def _entries(vector: str):
    v = F.unwrap_udt(vector)
    at = F.coalesce(v["indices"], F.transform(F.sequence(F.lit(0), F.size(v["values"]) - 1), lambda i: i.cast("int")))
    return F.arrays_zip(at.alias("feature"), v["values"].alias("value"))


class BoostedModel:
    """A fitted ensemble: ``table`` scores and explains, ``featureImportances`` are total gains, summing to 1."""

    def __init__(self, table: TreeTable, classes: int, gains: np.ndarray, features: str):
        self.table, self.classes, self.features = table, classes, features
        self.featureImportances = DenseVector(gains / gains.sum() if gains.sum() > 0 else gains)

    def tree_table(self) -> TreeTable:
        return self.table

    def setFeaturesCol(self, name: str) -> "BoostedModel":
        self.features = name
        return self

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Predictions of dense rows, or class probabilities."""
        margin = self.table.score(x)
        if self.classes == 0:
            return margin
        if self.classes <= 2:
            p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            return np.hstack([1 - p, p])
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def transform(self, df: DataFrame) -> DataFrame:
        """Append ``prediction``, and ``probability`` for classes."""
        outputs = self.outputs
        reach(df.sparkSession)

        @F.arrow_udf("array<double>")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                found = [outputs(x) for _, x in dense_matrices(batch, CELLS_AT_ONCE)]
                flat = np.concatenate([np.zeros(0), *(o.ravel() for o in found)])
                each = len(flat) // len(batch) if len(batch) else 0
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * np.int32(each)), pa.array(flat))

        out = df.withColumn("__out", scored(F.unwrap_udt(self.features)))
        if self.classes == 0:
            return out.withColumn("prediction", F.col("__out")[0]).drop("__out")
        best = F.array_position("__out", F.array_max("__out")).cast("double") - 1
        return out.withColumns({"probability": array_to_vector("__out"), "prediction": best}).drop("__out")


class Booster:
    """Unfitted: ``Booster(Growth(...)).setFeaturesCol(...).setLabelCol(...).fit(df)``."""

    def __init__(self, growth: Growth, features: str = "features", label: str = "label", weight: str | None = None):
        self.growth, self.features, self.label, self.weight = growth, features, label, weight

    def setFeaturesCol(self, name: str) -> "Booster":
        self.features = name
        return self

    def setLabelCol(self, name: str) -> "Booster":
        self.label = name
        return self

    def setWeightCol(self, name: str) -> "Booster":
        """A whole number of equal rows that a row stands for."""
        self.weight = name
        return self

    def fit(self, df: DataFrame) -> BoostedModel:
        g = self.growth
        reach(df.sparkSession)
        if self.weight is not None and g.rows < 1:
            raise ValueError("a round draws rows, not sums of rows")
        n = F.lit(None).cast("long") if self.weight is None else F.col(self.weight).cast("long")
        source = df.select(F.monotonically_increasing_id().alias("id"), F.col(self.label).cast("double").alias("y"), n.alias("n"), _entries(self.features).alias("e"), F.unwrap_udt(self.features).alias("v"))
        source = source.filter("y is not null")
        # Stored once: ids and pieces stay as they are for all passes.
        rows = materialize(source.withColumn("width", F.coalesce("v.size", F.size("v.values"))).drop("v"), "boost-rows")
        each = F.coalesce("n", F.lit(1))
        n, mean, low, high, width = rows.agg(F.sum(each), F.avg("y") if self.weight is None else F.sum(F.col("y") * each) / F.sum(each), F.min("y"), F.max("y"), F.max("width")).first()
        if not n:
            raise ValueError("no rows to learn from")
        base = np.full(g.trees, mean if g.classes == 0 else 0.0)
        bins = fit_bins(rows, width, g.bins)
        # A residual seldom grows beyond the spread of the target; one more bit is left for it.
        largest = max(high - low, 1e-12) if g.classes == 0 else 2.0
        scale = 2.0 ** np.floor(SUM_BITS - np.ceil(np.log2(n + 1)) - np.ceil(np.log2(largest)) - 1)
        weight_scale = 2.0 ** np.floor(SUM_BITS - np.ceil(np.log2(n + 1)) - 2)
        state = materialize(_encode(rows, bins, base, scale, g), "boost-state")
        sums = _added_up(state, n, g, bins)
        if sums is not state:
            state = materialize(_packed(sums, bins, base, g), "boost-state")
        state = _held(state, width)
        every = 1 if isinstance(state, Held) else WRITE_ROUNDS
        fitted, recent, gains = [], [], np.zeros(width)
        for turn in range(g.rounds):
            grown = _grow(state, recent, turn, g, bins, (scale, weight_scale), gains, base)
            fitted.append(grown)
            recent.append(grown)
            if len(recent) == every and turn + 1 < g.rounds:
                state, recent = _advance(state, recent, bins), []
        return BoostedModel(_table(fitted, bins, base), g.classes, gains, self.features)


def _encode(rows: DataFrame, bins: Bins, base: np.ndarray, scale: float, growth: Growth) -> DataFrame:
    """The rows in bins, as ``BLOCKS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(2)
            cells = e.flatten()
            feature, value = cells.field("feature").to_numpy(zero_copy_only=False).astype(np.int64), cells.field("value").to_numpy(zero_copy_only=False).astype(float)
            code = bins.codes(feature, value)
            y = b.column(1).to_numpy()
            n = None if b.column(3).null_count else b.column(3).to_numpy()
            # Numbers are kept as sums only, classes as they are.
            t = np.rint((y - base[0]) * (1 if n is None else n) * scale).astype(np.int64) if growth.classes == 0 else None
            sizes = pc.fill_null(pc.list_value_length(e), 0).to_numpy(zero_copy_only=False)
            yield from _blocks(b.column(0).to_numpy(), y if growth.classes else None, t, n, sizes, feature, code, bins, base, growth)

    return rows.select("id", "y", "e", "n").mapInArrow(run, BLOCKS)


@dataclass
class Held:
    """Records of few rows, held by the driver."""

    batches: list[pa.RecordBatch]

    def count(self) -> int:
        return sum(b.num_rows for b in self.batches)


def _held(state: DataFrame, width: int) -> DataFrame | Held:
    """The records themselves where the rows have few cells."""
    rows = state.agg(F.sum("rows")).first()[0] or 0
    return state if rows * max(width, 1) > HELD_CELLS else Held(state.toArrow().to_batches())


def _blocks(ids, y, t, n, sizes, feature, code, bins: Bins, base: np.ndarray, growth: Growth) -> Iterator[pa.RecordBatch]:
    """Rows as records of at most ``BLOCK_ROWS`` rows and about ``BLOCK_ENTRIES`` entries."""
    kind, width, ends = _bin_kind(bins), len(bins.zero), np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        to = min(len(sizes), at + BLOCK_ROWS, max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_ENTRIES, side="right")) - 1))
        own, f = sizes[at:to], feature[ends[at] : ends[to]]
        dense = bool((own == width).all() and (f.reshape(-1, width) == np.arange(width)).all()) if width else True
        yield _record(
            to - at, None if growth.rows >= 1 else ids[at:to], *(None if v is None else v[at:to] for v in (y, t, n)),
            None if dense else own.astype(np.int32), None if dense else f.astype(np.int32), code[ends[at] : ends[to]].astype(kind),
            np.repeat(base[None, :], to - at, axis=0),
        )
        at = to


def _bin_kind(bins: Bins) -> np.dtype:
    return np.min_scalar_type(max((len(t) for t in bins.thresholds), default=0))


def _record(rows: int, *columns: np.ndarray | None) -> pa.RecordBatch:
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    packed = [pa.array([None if c is None else np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), *packed], names)


def _packed(sums: DataFrame, bins: Bins, base: np.ndarray, growth: Growth) -> DataFrame:
    """Rows that were added up, as ``BLOCKS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, y, t, n = (b.column(i).to_numpy() for i in range(4))
            feature, code = (b.column(i).flatten().to_numpy().astype(np.int64) for i in (4, 5))
            sizes = pc.list_value_length(b.column(4)).to_numpy(zero_copy_only=False)
            yield from _blocks(ids, y, t, n, sizes, feature, code, bins, base, growth)

    return sums.select(*[c.split()[0] for c in ENTRIES.split(", ")]).mapInArrow(run, BLOCKS)


def _added_up(state: DataFrame, n: int, growth: Growth, bins: Bins) -> DataFrame:
    """Rows with the same class and bins as one (``ENTRIES``); ``state`` itself where most differ, or where each round draws its own rows."""
    if growth.rows < 1:
        return state

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in _pieces(batch, bins):
                cell = _mixed(p.feature.astype(np.uint64) * np.uint64(1 << 32) + p.code.astype(np.uint64) + np.uint64(1))
                mark = _mixed(p.y.view(np.uint64))
                np.add.at(mark, p.row, cell)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(mark).view(np.int64))], ["mark"])

    different = state.mapInArrow(marks, "mark long").agg(F.approx_count_distinct("mark")).first()[0]
    if different > DIFFERENT * n:
        return state

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in _pieces(batch, bins):
                columns, sizes, feature, code = (p.ids, p.y, p.t, p.n), np.bincount(p.row, minlength=len(p.y)), p.feature, p.code
                if len(code) == p.dense.size:
                    # Rows of a piece that agree are one already.
                    cells = np.ascontiguousarray(np.hstack([p.dense, p.y.view(np.int64)[:, None]]))
                    _, first, same = np.unique(cells.view(np.dtype((np.void, cells.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
                    sums = [np.zeros(len(first), np.int64) for _ in "tn"]
                    for into, v in zip(sums, (p.t, p.n)):
                        np.add.at(into, same.ravel(), v)
                    width = p.dense.shape[1]
                    columns, sizes, feature, code = (p.ids[first], p.y[first], *sums), np.full(len(first), width), np.tile(np.arange(width), len(first)), p.dense[first].ravel()
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (feature, code)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *lists], [c.split()[0] for c in ENTRIES.split(", ")])

    rows = state.mapInArrow(entries, ENTRIES)
    sums = rows.groupBy("y", "feature", "bin").agg(F.min("id").alias("id"), F.sum("t").alias("t"), F.sum("n").alias("n"))
    files = max(FILES, -(-different // FILE_ROWS))
    # The order of the rows does not matter, but where they lie should not depend on the tasks.
    return materialize(sums.select("id", "y", "t", "n", "feature", "bin").repartition(files, "y", "bin"), "boost-rows")


def _mixed(h: np.ndarray) -> np.ndarray:
    """Whole numbers with all bits mixed."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Piece:
    """Some rows of a record: entries (row, feature, code) and the dense bin matrix."""

    ids: np.ndarray
    y: np.ndarray
    t: np.ndarray
    n: np.ndarray
    row: np.ndarray
    feature: np.ndarray
    code: np.ndarray
    dense: np.ndarray
    margin: np.ndarray


def _pieces(batch: pa.RecordBatch, bins: Bins) -> Iterator[Piece]:
    """The records of a batch, in pieces of about ``CELLS_AT_ONCE`` cells."""
    width, kind = len(bins.zero), _bin_kind(bins)
    step = max(1, CELLS_AT_ONCE // max(width, 1))
    for i in range(batch.num_rows):
        rows, *packed = (c[i] for c in batch.columns)
        rows = rows.as_py()
        ids, y, t, n, sizes, feature, code, margin = (
            None if c.as_py() is None else np.frombuffer(c.as_buffer(), k)
            for c, k in zip(packed, (np.int64, float, np.int64, np.int64, np.int32, np.int32, kind, float))
        )
        margin, code = margin.reshape(rows, -1), code.astype(np.int64)
        ends = np.arange(rows + 1) * width if sizes is None else np.concatenate([[0], np.cumsum(sizes)])
        for at in range(0, rows, step):
            to = min(rows, at + step)
            own, m = code[ends[at] : ends[to]], to - at
            if sizes is None:
                row, of = np.repeat(np.arange(m), width), np.tile(np.arange(width), m)
                dense = own.reshape(m, width)
            else:
                row, of = np.repeat(np.arange(m), sizes[at:to]), feature[ends[at] : ends[to]].astype(np.int64)
                dense = np.repeat(bins.zero[None, :], m, axis=0)
                dense[row, of] = own
            zeros = np.zeros(m, np.int64)
            yield Piece(
                zeros if ids is None else ids[at:to], np.zeros(m) if y is None else y[at:to], zeros if t is None else t[at:to],
                np.ones(m, np.int64) if n is None else n[at:to], row, of, own, dense, margin[at:to],
            )


def _moved(margin: np.ndarray, dense: np.ndarray, recent: list) -> np.ndarray:
    margin = margin.copy()
    for grown in recent:
        for k, (tree, value) in enumerate(grown):
            margin[:, k] += value[descend(dense, tree)]
    return margin


def _advance(state: DataFrame | Held, recent: list, bins: Bins) -> DataFrame | Held:
    """The rows with the margins after the recent trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                moved = np.concatenate([_moved(p.margin, p.dense, recent) for p in _pieces(b, bins)])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([moved.tobytes()], pa.binary())], b.schema.names)

    if isinstance(state, Held):
        return Held(list(run(iter(state.batches))))
    return materialize(state.mapInArrow(run, BLOCKS), "boost-state")


def _sum_keys(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    key, g, h, n = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return (key[starts], *[np.add.reduceat(v[order], starts) if len(key) else v for v in (g, h, n)])


def _found(
    state: DataFrame | Held, recent: list, trees: list[Tree], wanted: list[list[int]], turn: int, growth: Growth, bins: Bins, scales: tuple[float, float], base: np.ndarray
) -> list:
    """The best split of each wanted node, from sums by (node, feature, bin) over its rows; feature -1 has the node's totals. Nodes count on over all trees."""
    # A node's cells: its totals, then the bins of every feature.
    firsts = 1 + bins.starts + np.arange(len(bins.starts))
    cells = int(firsts[-1])
    shapes = [t.arrays(True) for t in trees]
    starts = np.cumsum([0] + [len(t.nodes) for t in trees])
    asked = np.sort(np.concatenate([s + np.array(own, np.int64) for s, own in zip(starts, wanted)]))
    place = np.full(starts[-1], -1)
    place[asked] = np.arange(len(asked))
    few = len(asked) * cells <= KEYS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        sums = [np.zeros(len(asked) * cells, np.int64) for _ in "ghn"] if few else []
        for batch in batches:
            for p in _pieces(batch, bins):
                n, now, cell = p.n, _moved(p.margin, p.dense, recent), firsts[p.feature] + p.code
                use = sampled(p.ids, turn, growth.rows, growth.seed)
                first, second = gradients(p.y, now, growth.classes)
                for k, tree in enumerate(shapes):
                    node = place[starts[k] + descend(p.dense, tree)]
                    mine = use & (node >= 0)
                    if not mine.any():
                        continue
                    if growth.classes == 0:
                        g = np.rint(n * (now[:, k] - base[k]) * scales[0]).astype(np.int64) - p.t
                    else:
                        g = n * np.rint(first[:, k] * scales[0]).astype(np.int64)
                    h = n * np.rint(second[:, k] * scales[1]).astype(np.int64)
                    if mine.all():
                        at, key = p.row, node[p.row] * cells + cell
                    else:
                        own = mine[p.row]
                        at = p.row[own]
                        key = node[at] * cells + cell[own]
                    total = node[mine] * cells
                    if few:
                        for into, v in zip(sums, (g, h, n)):
                            np.add.at(into, key, v[at])
                            np.add.at(into, total, v[mine])
                    else:
                        parts.append(_sum_keys([(key, g[at], h[at], n[at]), (total, g[mine], h[mine], n[mine])]))
                if sum(len(p[0]) for p in parts) > KEYS_AT_ONCE:
                    parts = [_sum_keys(parts)]
        if few:
            key = np.flatnonzero(sums[2])
            g, h, n = (v[key] for v in sums)
        elif parts:
            key, g, h, n = _sum_keys(parts)
        else:
            return
        blocks = key // BLOCK_CELLS
        at = _runs(blocks)
        offsets = pa.array(np.append(at, len(key)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (key, g, h, n)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks[at]), *lists], ["block", "key", "g", "h", "n"])

    def told(key: np.ndarray, values: list[np.ndarray]) -> dict[str, np.ndarray]:
        node, rest = np.divmod(key, cells)
        f = np.searchsorted(firsts, rest, side="right") - 1
        code = np.where(f >= 0, rest - firsts[np.maximum(f, 0)], 0)
        return dict(zip(("node", "feature", "bin", *"ghn"), (asked[node], f, code, *values)))

    def added(table: pa.Table) -> dict[str, np.ndarray]:
        key, *values = (pc.list_flatten(table.column(c)).to_numpy() for c in ("key", *"ghn"))
        if not len(key):
            return told(key, values)
        start = key.min()
        sums = [np.zeros(key.max() - start + 1, np.int64) for _ in values]
        for into, v in zip(sums, values):
            np.add.at(into, key - start, v)
        some = np.flatnonzero(sums[2])
        return told(start + some, [v[some] for v in sums])

    def best(cells: pd.DataFrame) -> pd.DataFrame:
        return best_splits(cells, growth, bins.zero, scales, turn)

    schema = "block long, key array<long>, g array<long>, h array<long>, n array<long>"
    if isinstance(state, Held):
        parts = list(run(iter(state.batches)))
        # One pass has added up its keys already.
        key, *values = (np.concatenate([np.zeros(0, np.int64), *(p.column(c).flatten().to_numpy() for p in parts)]) for c in ("key", *"ghn"))
        return best(pd.DataFrame(told(key, values))).to_dict("records")
    # Each task brings a block of cells at once; no more tasks than are needed, so that a block's parts stay few.
    tasks = max(FILES, 2 * state.sparkSession.sparkContext.defaultParallelism)
    parts = state.coalesce(tasks).mapInArrow(run, schema)
    if len(asked) * cells * tasks <= HANDED_SUMS:
        return best(pd.DataFrame(added(parts.toArrow()))).to_dict("records")
    sums = parts.groupBy("block").applyInArrow(lambda t: pa.table(added(t)), "node long, feature long, bin long, g long, h long, n long")
    kind = "node long, gain double, feature long, bin long, lg long, lh long, ln long, g long, h long, n long"
    # Nodes with few cells are looked at together.
    groups = -(-len(asked) * cells // KEYS_AT_ONCE)
    return sums.groupBy(F.col("node") % groups).applyInPandas(best, kind).collect()


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys starts."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def best_splits(cells: pd.DataFrame, growth: Growth, zero: np.ndarray, scales: tuple[float, float], turn: int) -> pd.DataFrame:
    """The best split of each node; equal gains go to the smaller feature, then to the smaller bin."""
    whole = cells[cells["feature"] < 0].sort_values("node")
    nodes, total = whole["node"].to_numpy(np.int64), [whole[c].to_numpy(np.int64) for c in "ghn"]
    out = {"node": nodes, "gain": np.zeros(len(nodes)), **{c: np.full(len(nodes), -1 if c == "feature" else 0) for c in ("feature", "bin", "lg", "lh", "ln")}, **dict(zip("ghn", total))}
    cells = cells[cells["feature"] >= 0]
    node, feature, code, g, h, n = (cells[c].to_numpy(np.int64) for c in ("node", "feature", "bin", *"ghn"))
    at = np.searchsorted(nodes, node)
    used = sampled(feature, 7 * turn + 1, growth.columns, growth.seed)
    used |= (np.bincount(at, used, len(nodes)) == 0)[at]
    at, feature, code, sums = at[used], feature[used], code[used], [v[used] for v in (g, h, n)]
    if not len(at):
        return pd.DataFrame(out)
    # Rows without a stored entry are in the bin of zero.
    order = np.lexsort((feature, at))
    own, of = at[order], feature[order]
    starts = _runs(own, of)
    rest = [t[own[starts]] - np.add.reduceat(v[order], starts) for t, v in zip(total, sums)]
    some = rest[2] > 0
    at, feature = np.append(at, own[starts][some]), np.append(feature, of[starts][some])
    code, sums = np.append(code, zero[of[starts][some]]), [np.append(v, r[some]) for v, r in zip(sums, rest)]
    order = np.lexsort((code, feature, at))
    at, feature, code = at[order], feature[order], code[order]
    starts = _runs(at, feature, code)
    sums = [np.add.reduceat(v[order], starts) for v in sums]
    at, feature, code = at[starts], feature[starts], code[starts]
    # Running sums by feature; whole numbers may wrap around on the way, their differences do not.
    first = np.repeat(f := _runs(at, feature), np.diff(np.append(f, len(at))))
    left = [c - c[first] + v[first] for c, v in ((np.cumsum(v), v) for v in sums)]
    gl, hl, nl = left
    gr, hr, nr = (t[at] - v for t, v in zip(total, left))

    def part(g, h):
        below = h / scales[1] + growth.l2
        return (g / scales[0]) ** 2 / np.where(below > 0, below, np.inf)

    gain = part(gl, hl) + part(gr, hr) - part(total[0], total[1])[at]
    least = max(growth.least_rows, 1)
    weight = growth.least_weight * (1 - 1e-9)
    fits = (nl >= least) & (nr >= least) & (hl / scales[1] >= weight) & (hr / scales[1] >= weight) & (gain > 1e-12)
    most = np.zeros(len(nodes))
    np.maximum.at(most, at[fits], gain[fits])
    # Gains that differ by rounding alone are equal.
    near = np.flatnonzero(fits & (gain >= most[at] * (1 - 1e-9)))
    which, place = np.unique(at[near], return_index=True)
    for c, v in zip(("gain", "feature", "bin", "lg", "lh", "ln"), (gain, feature, code, gl, hl, nl)):
        out[c][which] = v[near[place]]
    return pd.DataFrame(out)


def _grow(state: DataFrame | Held, recent: list, turn: int, growth: Growth, bins: Bins, scales: tuple[float, float], gains: np.ndarray, base: np.ndarray) -> list:
    """The trees of one round: arrays and leaf values (by node)."""
    trees = [Tree() for _ in range(growth.trees)]
    while not all(t.done for t in trees):
        wanted = [[i for i, n in enumerate(t.nodes) if not n.known] for t in trees]
        if any(wanted):
            found = _found(state, recent, trees, wanted, turn, growth, bins, scales, base)
            starts = np.cumsum([0] + [len(t.nodes) for t in trees])
            told = {r["node"]: r for r in found}
            for k, t in enumerate(trees):
                for i in wanted[k]:
                    node, r = t.nodes[i], told.get(int(starts[k]) + i)
                    node.known = True
                    if r is not None:
                        node.total = (r["g"], r["h"], r["n"])
                        if r["feature"] >= 0:
                            node.split = (r["gain"], r["feature"], r["bin"])
                            left = (r["lg"], r["lh"], r["ln"])
                            node.parts = (left, tuple(a - b for a, b in zip(node.total, left)))
        for t in trees:
            _choose(t, growth)
    out = []
    for t in trees:
        value = np.zeros(len(t.nodes))
        for i in t.leaves:
            g, h, _ = t.nodes[i].total or (0, 0, 0)
            weight = h / scales[1] + growth.l2
            value[i] = -growth.rate * (g / scales[0]) / weight if weight > 0 else 0.0
        for i in sorted(t.inner()):
            gain, feature, _ = t.nodes[i].split
            gains[feature] += gain
        out.append((t.arrays(False), value))
    return out


def _choose(t: Tree, growth: Growth) -> None:
    """Split leaves best-first as far as gains are known; then prepare the children of those that may follow."""
    most = growth.leaves or 1 << 62

    def open_leaves() -> list[int]:
        deep = growth.depth if growth.depth is not None else 1 << 62
        fit = [i for i in t.leaves if t.nodes[i].known and t.nodes[i].split and t.nodes[i].depth < deep]
        return sorted(fit, key=lambda i: (-t.nodes[i].split[0], i))

    while not t.done:
        if len(t.leaves) >= most and len(t.leaves) > 1:
            t.done = True
            return
        if any(not t.nodes[i].known for i in t.leaves):
            break
        choice = open_leaves()
        if not choice or len(t.leaves) >= most:
            t.done = True
            return
        node = t.nodes[choice[0]]
        _children(t, choice[0], growth)
        t.leaves = (t.leaves - {choice[0]}) | {node.left, node.right}
    # A pass costs the same for one node and for many.
    for i in open_leaves()[: max(0, most - len(t.leaves))]:
        _children(t, i, growth)


def _children(t: Tree, i: int, growth: Growth) -> None:
    """Nodes for both sides; one that is too deep or too small to be split is known from its totals."""
    if t.nodes[i].left < 0:
        t.nodes[i].left, t.nodes[i].right = len(t.nodes), len(t.nodes) + 1
        depth, least = t.nodes[i].depth + 1, 2 * max(growth.least_rows, 1)
        t.nodes += [Node(depth, total, total[2] < least or (growth.depth is not None and depth >= growth.depth)) for total in t.nodes[i].parts]


def _table(fitted: list, bins: Bins, base: np.ndarray) -> TreeTable:
    """All trees as one table with thresholds in place of bins."""
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    roots, at = [], 0
    for grown in fitted:
        for k, ((feature, cut, left, right), value) in enumerate(grown):
            inner = left >= 0
            roots.append(at)
            limits = np.array([bins.thresholds[f][c] if i else np.nan for f, c, i in zip(feature, cut, inner)])
            values = np.zeros((len(feature), len(base)))
            values[~inner, k] = value[~inner]
            for column, cells in zip(columns, (feature, limits, np.where(inner, left + at, -1), np.where(inner, right + at, -1), values)):
                column.append(cells)
            at += len(feature)
    feature, threshold, left, right, value = (np.concatenate(c) for c in columns)
    return TreeTable(feature, threshold, left, right, value, np.array(roots), base)


def leaf_wise(classes: int = 0, rounds: int = 200, rate: float = 0.1, leaves: int = 31, depth: int | None = None, seed: int = 42) -> Booster:
    """Best-first trees with large leaves: the second boosted family."""
    return Booster(Growth(classes, rounds, rate, leaves, depth, seed=seed))


def level_wise(classes: int = 0, rounds: int = 200, rate: float = 0.3, depth: int = 6, rows: float = 1.0, columns: float = 1.0, seed: int = 42) -> Booster:
    """Trees to a depth with a penalty on leaf values; several classes share one softmax: the first boosted family."""
    return Booster(replace(Growth(classes, rounds, rate, None, depth, seed=seed), l2=1.0, least_rows=1, least_weight=1.0, rows=rows, columns=columns))
