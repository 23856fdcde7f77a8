"""Exact Shapley values of tree ensembles, from their leaf paths.

A leaf is reached by a mix of an explained row x and a background row b if every
feature on its path lies in the leaf's interval in the row it was taken from. So for one
pair (x, b) a leaf is a small game: the features that only x satisfies must come
from x, those that only b satisfies from b, the others do not matter, and a feature that
neither satisfies closes the leaf. With p and q features of the first two kinds and value v,
each of the p features has the Shapley value v (p-1)! q! / (p+q)! and each of the q
features -v p! (q-1)! / (p+q)!. The sum over all leaves, averaged over the background, is the
exact value for v(S) as in ``shapley``: no coalition and no feature order is drawn.

The nodes of a fitted ensemble are a table, written with the model and read back, so they are no
larger than the model. Rows are placed by row and explained in their tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Model
from pyspark.ml.classification import OneVsRestModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscore.operators.importance import mean_abs
from tabscore.operators.shapley import reduce_classes
from tabscore.operators.split import bounded_sample
from tabscore.session import reach, scratch_path

# Pairs (background row, leaf) that a task looks at together.
PAIRS_AT_ONCE = 1 << 21
# Cells (leaf, condition, set of conditions) that are worked out once for all rows; cells (row, condition) that a task looks at together.
TABLE_CELLS = 1 << 19
CELLS_AT_ONCE = 1 << 20
MAX_BACKGROUND = 1000
# Leaves whose paths a task holds; rows that it explains by them before it takes the next ones.
LEAVES_AT_ONCE, ROWS_AT_ONCE = 1 << 16, 256
# Features up to which the sizes of a row's values are columns.
FEW_FEATURES = 64


@dataclass
class TreeTable:
    """Nodes of an ensemble: rows of a tree are next to each other, its root first.

    ``left`` and ``right`` are rows of this table, -1 for a leaf. A row goes left if its
    feature is at most ``threshold``. The ensemble's output is the sum of the ``value`` rows of the
    leaves reached (one column per output) plus ``base``.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Outputs of the dense rows ``x``: rows x outputs."""
        out = np.repeat(self.base[None, :], len(x), axis=0)
        for root in self.roots:
            at = np.full(len(x), root)
            while (open_ := self.left[at] >= 0).any():
                goes = x[np.arange(len(x)), np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(open_, np.where(goes, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out


def stack_tables(tables: list[TreeTable]) -> TreeTable:
    """One table with the outputs of all side by side."""
    starts = np.cumsum([0] + [len(t.feature) for t in tables])
    widths = np.cumsum([0] + [t.value.shape[1] for t in tables])
    value = np.zeros((starts[-1], widths[-1]))
    for t, s, w in zip(tables, starts, widths):
        value[s : s + len(t.feature), w : w + t.value.shape[1]] = t.value

    def moved(name: str) -> np.ndarray:
        return np.concatenate([np.where(getattr(t, name) >= 0, getattr(t, name) + s, -1) for t, s in zip(tables, starts)])

    joined = {n: np.concatenate([getattr(t, n) for t in tables]) for n in ("feature", "threshold", "base")}
    return TreeTable(joined["feature"], joined["threshold"], moved("left"), moved("right"), value, np.concatenate([t.roots + s for t, s in zip(tables, starts)]), joined["base"])


def some_trees(table: TreeTable, leaves: int) -> Iterator[TreeTable]:
    """The ensemble in parts of about so many leaves, without the base."""
    ends = np.append(table.roots[1:], len(table.feature))
    part = np.cumsum(np.add.reduceat(table.left < 0, table.roots)) // leaves
    for k in np.unique(part):
        own = np.flatnonzero(part == k)
        start, end = table.roots[own[0]], ends[own[-1]]
        left, right = (np.where(v[start:end] >= 0, v[start:end] - start, -1) for v in (table.left, table.right))
        yield TreeTable(table.feature[start:end], table.threshold[start:end], left, right, table.value[start:end], table.roots[own] - start, np.zeros(len(table.base)))


def tree_table(model: Model) -> TreeTable:
    """The nodes of a fitted ensemble.

    Outputs: the prediction of a regressor, the class probabilities of a forest, the
    margin of boosted trees (for two classes minus the margin, then the margin; for one model per class
    the margin of each class).
    """
    if hasattr(model, "tree_table"):
        return model.tree_table()
    if isinstance(model, OneVsRestModel):
        tables = [tree_table(m) for m in model.models]
        return stack_tables([TreeTable(t.feature, t.threshold, t.left, t.right, t.value[:, 1:], t.roots, t.base[1:]) for t in tables])
    if not hasattr(model, "treeWeights"):
        raise TypeError(f"{type(model).__name__} has no trees")
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    kinds = [f.name for f in nodes.schema]
    stats = F.col("impurityStats") if "impurityStats" in kinds else F.array(F.col("prediction"))
    split = F.col("split")
    rows = nodes.select(
        "treeID", "id", "prediction", stats.alias("stats"), "leftChild", "rightChild",
        split["featureIndex"].alias("feature"), split["leftCategoriesOrThreshold"].alias("threshold"), split["numCategories"].alias("categories"),
    ).orderBy("treeID", "id").toArrow()
    if any(c is not None and c >= 0 for c in rows["categories"].to_pylist()):
        raise ValueError("splits by categories have no leaf intervals")
    tree, left, right = (rows[c].to_numpy().astype(np.int64) for c in ("treeID", "leftChild", "rightChild"))
    roots = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    shift = roots[np.searchsorted(roots, np.arange(len(tree)), side="right") - 1]
    threshold = np.array([t[0] if t else np.nan for t in rows["threshold"].to_pylist()])
    weight = np.asarray(model.treeWeights)[tree][:, None]
    if "Classification" in type(model).__name__ and "Forest" in type(model).__name__:
        counts = np.array(rows["stats"].to_pylist(), float)
        value = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300) / len(roots)
    else:
        value = rows["prediction"].to_numpy()[:, None] * weight
        if "Forest" in type(model).__name__:
            value = value / len(roots)
        if "Classification" in type(model).__name__:
            value = np.hstack([-value, value])
    feature = np.where(left >= 0, rows["feature"].to_numpy().astype(np.int64), -1)
    return TreeTable(feature, threshold, np.where(left >= 0, left + shift, -1), np.where(left >= 0, right + shift, -1), value, roots, np.zeros(value.shape[1]))


class LeafPaths:
    """Leaves with the interval of every feature on their path; conditions of a leaf are next to each other."""

    def __init__(self, table: TreeTable):
        feature, limits, sizes, nodes = [], [], [], []
        inner, asked, threshold, ways = (v.tolist() for v in (table.left >= 0, table.feature, table.threshold, np.stack([table.left, table.right], axis=1)))
        for root in table.roots:
            waiting: list[tuple[int, dict[int, tuple[float, float]]]] = [(int(root), {})]
            while waiting:
                node, path = waiting.pop()
                if inner[node]:
                    f, t = asked[node], threshold[node]
                    a, b = path.get(f, (-np.inf, np.inf))
                    waiting.append((ways[node][1], {**path, f: (max(a, t), b)}))
                    waiting.append((ways[node][0], {**path, f: (a, min(b, t))}))
                elif path:
                    if len(path) > 63:
                        raise ValueError("a path holds more than 63 features")
                    feature.extend(path)
                    limits.extend(path.values())
                    sizes.append(len(path))
                    nodes.append(node)
        # Leaves with equally many conditions are next to each other.
        sizes = np.array(sizes, np.int64)
        order = np.argsort(sizes, kind="stable")
        first, self.sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.leaf = np.repeat(np.arange(len(order), dtype=np.int32), self.sizes)
        place = np.arange(len(feature)) - self.starts[self.leaf]
        moved = first[self.leaf] + place
        self.longest = int(sizes.max(initial=0))
        # One bit per condition; few bits take half the memory.
        self.kind = np.uint32 if self.longest <= 32 else np.uint64
        self.feature, self.bit = np.array(feature, np.int32)[moved], place.astype(self.kind)
        self.low, self.high = np.array(limits, float).reshape(-1, 2)[moved].T
        self.value = table.value[np.array(nodes, np.int64)[order]].reshape(len(order), table.value.shape[1])
        self.full = ((np.uint64(1) << self.sizes.astype(np.uint64)) - np.uint64(1)).astype(self.kind)

    def inside(self, x: np.ndarray) -> np.ndarray:
        """By leaf, one bit per condition that the dense row satisfies."""
        if not len(self.starts):
            return np.zeros(0, self.kind)
        v = x[self.feature]
        # A missing number goes right everywhere, as in the trees.
        fits = ~(v <= self.low) & ((v <= self.high) | (self.high == np.inf))
        return np.bitwise_or.reduceat(fits.astype(self.kind) << self.bit, self.starts)

    def values(self, x: np.ndarray, background: np.ndarray, width: int) -> np.ndarray:
        """Outputs x features: the exact values of one row; ``background`` holds ``inside`` of each background row."""
        own, share = self.inside(x), np.zeros(len(self.feature))
        step = max(1, PAIRS_AT_ONCE // max(len(background), 1))
        for at in range(0, len(own), step):
            mine, others = own[at : at + step], background[:, at : at + step]
            row, leaf = np.nonzero((mine | others) == self.full[at : at + step])
            a, b = mine[leaf], others[row, leaf]
            apart = np.flatnonzero(a != b)
            a, b, leaf = a[apart], b[apart], at + leaf[apart]
            only_x, only_b = a & ~b, b & ~a
            p, q = np.bitwise_count(only_x), np.bitwise_count(only_b)
            gain, loss = GAIN[p, q], GAIN[q, p]
            # Only the conditions of these leaves are added to.
            last = min(at + step, len(own)) - 1
            start, end = self.starts[at], self.starts[last] + self.sizes[last]
            place = self.starts[leaf] - start
            for i in range(self.sizes[last]):
                one = self.kind(1 << i)
                up, down = np.flatnonzero(only_x & one), np.flatnonzero(only_b & one)
                if up.size or down.size:
                    where = np.concatenate([place[up], place[down]])
                    share[start:end] += np.bincount(where + i, np.concatenate([gain[up], -loss[down]]), end - start)
        share /= max(len(background), 1)
        some = np.flatnonzero(share)
        feature, share, leaf = self.feature[some], share[some], self.leaf[some]
        return np.stack([np.bincount(feature, share * self.value[leaf, k], width) for k in range(self.value.shape[1])])


class LeafTables:
    """A row's share in each condition of each leaf, for every set of conditions that it may satisfy, averaged over the background.

    What a row gets from a leaf depends on that set alone. With few conditions a leaf there are few sets, so they
    are worked out once, and many rows are explained together.
    """

    def __init__(self, paths: LeafPaths, background: np.ndarray, width: int):
        self.paths, self.width = paths, width
        sizes = paths.sizes
        # A leaf's cells: by condition, then by set.
        self.size = (np.int64(1) << sizes)[paths.leaf]
        self.first = np.cumsum(self.size) - self.size
        self.share = np.zeros(int(self.size.sum()))
        for d in np.unique(sizes):
            leaves = np.flatnonzero(sizes == d)
            sets = np.arange(1 << int(d), dtype=np.uint64)
            places = self.first[paths.starts[leaves][:, None] + np.arange(int(d))][:, :, None] + sets.astype(np.int64)
            for others in background[:, leaves]:
                b = others[:, None]
                met = (sets | b) == sets[-1]
                only_x, only_b = sets & ~b, b & ~sets
                p, q = np.bitwise_count(only_x).astype(np.int64), np.bitwise_count(only_b).astype(np.int64)
                gain, loss = GAIN[p, q] * met, GAIN[q, p] * met
                for i in range(int(d)):
                    one = np.uint64(1) << np.uint64(i)
                    self.share[places[:, i]] += np.where(only_x & one, gain, 0.0) - np.where(only_b & one, loss, 0.0)
        self.share /= max(len(background), 1)
        self.order = np.argsort(paths.feature, kind="stable")

    def values(self, x: np.ndarray) -> np.ndarray:
        """Rows x outputs x features for dense rows."""
        paths, out = self.paths, np.zeros((len(x), self.paths.value.shape[1], self.width))
        if not len(paths.feature):
            return out
        v = x[:, paths.feature]
        fits = ~(v <= paths.low) & ((v <= paths.high) | (paths.high == np.inf))
        inside = np.add.reduceat(fits.astype(np.int64) << paths.bit.astype(np.int64), paths.starts, axis=1)
        share = self.share[self.first + inside[:, paths.leaf]][:, self.order]
        feature, leaf = paths.feature[self.order], paths.leaf[self.order]
        starts = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]])
        for k in range(out.shape[1]):
            out[:, k, feature[starts]] = np.add.reduceat(share * paths.value[leaf, k], starts, axis=1)
        return out


def few_sets(paths: LeafPaths) -> bool:
    """Whether the sets of conditions of all leaves are few enough to be tabled."""
    sizes = paths.sizes
    return paths.longest <= 20 and float((sizes * 2.0**sizes).sum()) <= TABLE_CELLS


# GAIN[p, q] = (p-1)! q! / (p+q)!, zero for p = 0.
GAIN = np.array([[factorial(p - 1) * factorial(q) / factorial(p + q) if p else 0.0 for q in range(64)] for p in range(64)])


def dense_rows(vectors: pa.Array) -> Iterator[np.ndarray]:
    """The rows of an unwrapped vector column (type, size, indices, values), one dense row at a time."""
    for v in vectors.to_pylist():
        yield dense_row(v["type"], v["size"], v["indices"], v["values"])


def dense_matrices(vectors: pa.Array, cells: int) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of an unwrapped vector column as dense matrices of about ``cells`` cells, each with the place of its first row."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return
    if vectors.field("type").null_count or vectors.null_count:
        raise ValueError("a row has no vector")
    sizes = pc.coalesce(vectors.field("size").cast(pa.int64()), pc.list_value_length(vectors.field("values")).cast(pa.int64()))
    width = pc.max(sizes).as_py()
    step = max(1, cells // max(width, 1))
    for at in range(0, len(vectors), step):
        part = vectors.slice(at, step)
        stored, values = pc.list_value_length(part.field("values")).to_numpy(zero_copy_only=False), part.field("values").flatten().to_numpy(zero_copy_only=False).astype(float)
        dense = part.field("type").to_numpy(zero_copy_only=False) == 1
        if dense.all() and (stored == width).all():
            yield at, values.reshape(len(part), width)
            continue
        row = np.repeat(np.arange(len(part)), stored)
        column = np.arange(len(values)) - np.repeat(np.cumsum(stored) - stored, stored)
        column[~dense[row]] = part.field("indices").filter(pa.array(~dense)).flatten().to_numpy(zero_copy_only=False)
        x = np.zeros((len(part), width))
        x[row, column] = values
        yield at, x


def dense_row(kind: int, size: float | None, indices, values) -> np.ndarray:
    """One vector; of its cells a dense one (kind 1) has only the values."""
    if kind == 1:
        return np.array(values, float)
    row = np.zeros(int(size))
    row[np.asarray(indices, np.int64)] = values
    return row


def background_rows(df: DataFrame, key: str, vector: str, n: int = 100, seed: int | str = 42) -> list[np.ndarray]:
    """``n`` sampled feature rows on the driver, the same rows as ``shapley.background``."""
    if n > MAX_BACKGROUND:
        raise ValueError(f"a background holds at most {MAX_BACKGROUND} rows")
    picked = bounded_sample(df.select(key, F.unwrap_udt(vector).alias("v")), key, n, seed).select("v").toArrow()
    return list(dense_rows(picked["v"].combine_chunks()))


def _placed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Keys and unwrapped vectors, spread by row: a row is much work, and a repeated key is several rows."""
    n = int(reach(df.sparkSession).conf.get("spark.sql.shuffle.partitions"))
    return df.select(F.col(key).alias("__key"), F.unwrap_udt(vector).alias("v"), F.monotonically_increasing_id().alias("__row")).repartition(n, "__row")


def _explained(df: DataFrame, key: str, vector: str, features: list[str], explain: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """``key, cls, feature, phi`` from ``explain``, which gives pieces of a batch: the first row and rows x outputs x features."""
    kind = df.schema[key].dataType
    placed = _placed(df, key, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for at, phi in explain(batch):
                rows, outputs, width = phi.shape
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows * outputs + 1, dtype=np.int32) * np.int32(width)), pa.array(phi.ravel()))
                cls = pa.array(np.tile(np.arange(outputs, dtype=np.int32), rows))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.arange(at, at + rows), outputs))), cls, lists], ["__key", "cls", "phi"])

    schema = T.StructType([T.StructField("__key", kind), T.StructField("cls", T.IntegerType()), T.StructField("phi", T.ArrayType(T.DoubleType()))])
    names = F.lit(features)
    long = placed.mapInArrow(run, schema).select(F.col("__key").alias(key), "cls", F.posexplode("phi").alias("j", "phi"))
    return long.select(key, "cls", F.get(names, F.col("j")).alias("feature"), "phi")


def explain_rows(df: DataFrame, key: str, vector: str, features: list[str], explain: Callable[[np.ndarray, object], np.ndarray]) -> DataFrame:
    """``key, cls, feature, phi`` from ``explain(dense row, key)``, which gives outputs x features."""

    def one_by_one(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for i, x in enumerate(dense_rows(batch.column(1))):
            yield i, np.asarray(explain(x, batch.column(0)[i].as_py()))[None]

    return _explained(df, key, vector, features, one_by_one)


def _explainer(features: list[str], paths: LeafPaths, background: list[np.ndarray]) -> Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]] | None:
    """Pieces of a batch explained together, where the leaves' sets of conditions can be tabled."""
    if not few_sets(paths):
        return None
    width = len(features)
    tables = LeafTables(paths, np.stack([paths.inside(b) for b in background]), width)
    cells = max(1, CELLS_AT_ONCE // max(len(paths.feature), width * paths.value.shape[1], 1))
    return lambda batch: ((at, tables.values(x)) for at, x in dense_matrices(batch.column(1), cells * width))


def _by_trees(table: TreeTable, background: list[np.ndarray], width: int) -> Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]:
    """Pieces of a batch explained by some trees after the others: no task holds the paths of all of them."""

    def explain(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        rows = list(dense_rows(batch.column(1)))
        for at in range(0, len(rows), ROWS_AT_ONCE):
            own = rows[at : at + ROWS_AT_ONCE]
            phi = np.zeros((len(own), table.value.shape[1], width))
            for part in some_trees(table, LEAVES_AT_ONCE):
                paths = LeafPaths(part)
                met = np.stack([paths.inside(b) for b in background])
                for i, x in enumerate(own):
                    phi[i] += paths.values(x, met, width)
            yield at, phi

    return explain


def shapley_trees(
    df: DataFrame, key: str, features: list[str], model: Model | TreeTable, background: list[np.ndarray], vector: str = "features", sizes: bool = False
) -> DataFrame:
    """Exact values of a tree ensemble for every row: ``key, cls, feature, phi`` (``cls`` counts outputs).

    Every feature of every row has a value; they sum to f(x) minus the mean of f over the background.
    ``sizes`` gives a row's mean |phi| over the outputs instead: ``key, feature, phi``, or one column ``p<j>`` a feature where rows are explained together.
    """
    table = model if isinstance(model, TreeTable) else tree_table(model)
    if (table.left < 0).sum() > LEAVES_AT_ONCE:
        phi = _explained(df, key, vector, features, _by_trees(table, background, len(features)))
        return reduce_classes(phi, "mean_abs") if sizes else phi
    paths = LeafPaths(table)
    together = _explainer(features, paths, background)
    if together is None:
        met, width = np.stack([paths.inside(b) for b in background]), len(features)
        phi = explain_rows(df, key, vector, features, lambda x, _: paths.values(x, met, width))
    elif not sizes or len(features) > FEW_FEATURES:
        phi = _explained(df, key, vector, features, together)
    else:
        return _row_sizes(df, key, vector, len(features), together)
    return reduce_classes(phi, "mean_abs") if sizes else phi


def _row_sizes(df: DataFrame, key: str, vector: str, width: int, together: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """``key, p0, p1, ...``: a row's values become one row of sizes in the task that made them."""
    names = [f"p{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, phi in together(batch):
                means = np.abs(phi).mean(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(means)), *map(pa.array, means.T)], ["__key", *names])

    schema = T.StructType([T.StructField("__key", df.schema[key].dataType), *[T.StructField(p, T.DoubleType()) for p in names]])
    return _placed(df, key, vector).mapInArrow(run, schema)


def tree_importance(df: DataFrame, key: str, features: list[str], model: Model | TreeTable, background: list[np.ndarray], vector: str = "features") -> DataFrame:
    """``feature, importance``: the mean over the keys of a key's mean |phi| over its rows and the outputs.

    No more than the explained rows is shuffled where a row is one row of sizes.
    """
    found = shapley_trees(df, key, features, model, background, vector, True)
    if "__key" not in found.columns:
        return mean_abs(found, [])
    sizes = [f"p{j}" for j in range(len(features))]
    by_key = found.groupBy("__key").agg(*[F.avg(p).alias(p) for p in sizes])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(p).alias("importance")) for f, p in zip(features, sizes)])
    return by_key.agg(*[F.avg(p).alias(p) for p in sizes], F.count("*").alias("n")).where("n > 0").select(F.inline(cells))


def mean_output(table: TreeTable, background: list[np.ndarray]) -> np.ndarray:
    """Mean output over the background, which the values start from."""
    return table.score(np.stack(background)).mean(axis=0)
