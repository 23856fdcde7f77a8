"""Hard negatives by cover trees over norm-augmented candidates (operator 11).

Components become whole numbers, so inner products are exact. One more coordinate
fills every candidate up to the longest norm: all lie on one sphere, and the angle
between an anchor and a node's centre, with the widest angle from that centre to the
rows below it (the covering radius), bounds every inner product below the node from
both sides.

The top level of the tree is dealt by Spark: centres spread out over a bounded sample,
every candidate in the cell of its nearest centre, the radius of each cell from all its
rows. An anchor is sent to the cells whose bounds meet what it looks for, no others.
A cell (or a slice of a large one) is one group of sorted rows, candidates first: the
task builds the lower levels from them and then streams the anchors through. Each level
halves the covering radius, or as far as ``CHILDREN`` centres bring it. A descent takes
the node with the best upper bound first, skips nodes outside all windows or below what
it holds, and scores the rows of leaves exactly.

Equal vectors of one label are one entry with the smallest ids of its group, so a large
group of copies is one row; entries with equal scores are ordered by their first ids,
which is enough for ties of any size.

Defined results: rows with a null id or label, a null vector, or a null or non-finite
component take no part, nor do vectors of another length than the most frequent one;
repeated rows (same id, label and vector) count once; an empty table, or one without
anchors, gives an empty one; vectors whose squared norm in whole numbers reaches 2^52
raise an error, as their products are no longer exact; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscore.llm.common import column
from tabscore.session import materialize

POSITIVES = 5
NEGATIVES = 5
EVERY = 100
# The window of a negative: 80 * positive <= 100 * negative <= 100 * positive.
LEAST_PERCENT = 80
SCALE = 256
CELL_ROWS = 4_096
CELLS = 512
SAMPLE_ROWS = 8_192
CHILDREN = 256
LEAF_ROWS = 32


# ---- the tree ---------------------------------------------------------------


class CoverTree:
    """Nodes over the rows of ``x``; ``longest`` bounds all norms, ``first`` orders equal scores."""

    def __init__(self, x: np.ndarray, label: np.ndarray, first: np.ndarray, longest: float, children: int = CHILDREN, leaf: int = LEAF_ROWS):
        self.x, self.label, self.first, self.longest = x, label, first, longest
        self.filled = fill(x, longest)
        self.centre, self.angle, self.low, self.high, self.below, self.rows = [], [], [], [], [], []
        rows = np.arange(len(x))
        waiting = [(self._node(rows, 0, self._chords(self.filled, 0)), rows)] if len(x) else []
        while waiting:
            node, rows = waiting.pop()
            own = self.filled[rows]
            near = self._chords(own, self.centre[node])
            radius = near.max()
            # The node's centre stays a centre; the row farthest from all centres becomes the next one.
            owner, centres = np.zeros(len(rows), np.int64), [self.centre[node]]
            while len(rows) > leaf and radius > 1e-7 * longest and near.max() > radius / 2 and len(centres) < children:
                far = int(rows[near.argmax()])
                away = self._chords(own, far)
                closer = away < near
                near[closer], owner[closer] = away[closer], len(centres)
                centres.append(far)
            if len(centres) == 1:
                self.rows[node] = rows
                continue
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
            for i, c in enumerate(centres):
                mine = order[cuts[i] : cuts[i + 1]]
                if mine.size:
                    child = self._node(rows[mine], c, near[mine])
                    self.below[node].append(child)
                    waiting.append((child, rows[mine]))
        self.below = [np.array(b, np.int64) for b in self.below]
        self.leaf = np.array([r is not None for r in self.rows])
        self.centre, self.angle = np.array(self.centre, np.int64), np.array(self.angle)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _chords(self, filled: np.ndarray, centre: int) -> np.ndarray:
        """Distances from a row: all lie on one sphere, so the product tells."""
        return np.sqrt(np.maximum(2 * (self.longest**2 - filled @ self.filled[centre]), 0))

    def _node(self, rows: np.ndarray, centre: int, away: np.ndarray) -> int:
        self.centre.append(centre)
        self.angle.append(angle(float(away.max(initial=0)), self.longest))
        self.low.append(self.label[rows].min())
        self.high.append(self.label[rows].max())
        self.below.append([])
        self.rows.append(None)
        return len(self.centre) - 1

    def search(self, q: np.ndarray, label: int, same: bool, windows: np.ndarray, k: int) -> list[list[tuple[int, int, int]]]:
        """For each window (low, high): the ``k`` best rows as (-score, first id, row), of the label or of all others.

        Nodes are taken best bound first, a few at a time and then more: where bounds are tight the first ones end
        the search, where they are not the rest is scored in large pieces.
        """
        held: list[list[tuple[int, int, int]]] = [[] for _ in windows]
        if not len(self.x) or not len(windows):
            return held
        need, top, norm = windows[:, 0].astype(float), windows[:, 1].astype(float), float(np.sqrt(q @ q))
        nodes, upper, width = np.zeros(1, np.int64), np.full(1, np.inf), 8
        while nodes.size:
            open_ = upper >= need.min()
            nodes, upper = nodes[open_], upper[open_]
            order = np.argsort(-upper, kind="stable")
            now, nodes, upper = nodes[order[:width]], nodes[order[width:]], upper[order[width:]]
            width *= 2
            leaves = [self.rows[i] for i in now[self.leaf[now]]]
            if leaves:
                rows = np.concatenate(leaves)
                rows = rows[(self.label[rows] == label) == same]
                self._hold(held, need, windows, rows, (self.x[rows] @ q).astype(np.int64), k)
            inner = now[~self.leaf[now]]
            if inner.size:
                child = np.concatenate([self.below[i] for i in inner])
                fit = (self.low[child] <= label) & (label <= self.high[child]) if same else (self.low[child] != label) | (self.high[child] != label)
                child = child[fit]
                below, above = bounds(self.x[self.centre[child]] @ q, self.angle[child], norm, self.longest)
                use = ((above[:, None] >= need) & (below[:, None] <= top)).any(axis=1)
                nodes, upper = np.concatenate([nodes, child[use]]), np.concatenate([upper, above[use]])
        return held

    def _hold(self, held, need, windows, rows, scores, k):
        use = np.flatnonzero(scores >= need.min())
        order = use[np.lexsort((self.first[rows[use]], -scores[use]))]
        falling = -scores[order]
        starts = np.searchsorted(falling, -windows[:, 1])
        for w, start in enumerate(starts):
            fit = [i for i in order[start : start + k] if scores[i] >= need[w]]
            if fit:
                held[w] = sorted(held[w] + [(-int(scores[i]), int(self.first[rows[i]]), int(rows[i])) for i in fit])[:k]
                if len(held[w]) == k:
                    need[w] = max(need[w], -held[w][-1][0])


def _distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def fill(x: np.ndarray, longest: float) -> np.ndarray:
    """The rows with the coordinate that brings them to the longest norm."""
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", x, x), 0))[:, None]])


def angle(chord: float | np.ndarray, longest: float) -> float | np.ndarray:
    return 2 * np.arcsin(np.minimum(chord / (2 * longest) * (1 + 1e-9), 1.0))


def bounds(dots: np.ndarray, wide: np.ndarray, norm: float | np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product with any row within the angle ``wide`` of a centre; a little wider for rounding."""
    reach = np.maximum(norm * longest, 1e-12)
    between = np.arccos(np.clip(dots / reach, -1, 1))
    slack = 1e-6 * reach
    return reach * np.cos(np.minimum(between + wide, np.pi)) - slack, reach * np.cos(np.maximum(between - wide, 0)) + slack


def spread_centres(x: np.ndarray, n: int, longest: float) -> np.ndarray:
    """``n`` rows of ``x``, each the farthest from those before it."""
    filled = fill(x, longest)
    picked, near = [0], _distance(filled, filled[0])
    while len(picked) < n and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, _distance(filled, filled[picked[-1]]))
    return x[picked]


# ---- Spark jobs ---------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` (after its change), ``x`` (whole numbers as doubles) and ``key`` of the rows that take part."""
    v = F.transform(column("embedding"), lambda e: e.cast("double"))
    rows = vectors.select(column("vec_id").cast("long").alias("vec_id"), column("label").cast("long").alias("label"), v.alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("v", lambda e: F.floor(F.lit(float(SCALE)) * e).cast("double"))
    return rows.select("vec_id", moved.alias("label"), whole.alias("x")).withColumn("key", F.sha2(F.to_json("x"), 256))


def _matrix(arrays: pa.Array) -> np.ndarray:
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arrays), -1) if len(arrays) else np.zeros((0, 0))


class Cells:
    """The top level: centres, and by cell the covering angle and the number of slices."""

    def __init__(self, centres: np.ndarray, longest: float):
        self.centres, self.longest, self.filled = centres, longest, fill(centres, longest)
        self.wide, self.slices = np.zeros(len(centres)), np.ones(len(centres), np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (fill(x, self.longest) @ self.filled.T).argmax(axis=1)
        return own, np.sqrt(((fill(x, self.longest) - self.filled[own]) ** 2).sum(axis=1))

    def place(self, entries: DataFrame) -> DataFrame:
        """Append ``cell`` and ``away``, the distance to its centre."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own, away = self.nearest(_matrix(b.column("x"))) if b.num_rows else (np.zeros(0, int), np.zeros(0))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(away, pa.float64())], [*b.schema.names, "cell", "away"])

        return entries.mapInArrow(run, "entry long, label long, first long, x array<double>, cell int, away double")

    def meeting(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows x cells: whether a cell's bounds meet the range of an anchor's windows."""
        norm = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
        below, above = bounds(q @ self.centres.T, self.wide[None, :], norm, self.longest)
        return (above >= low[:, None]) & (below <= high[:, None])

    def route(self, asked: DataFrame, home: bool | None) -> DataFrame:
        """A row per anchor and slice to look at: its nearest cell (``home``), all others, or all (None)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                q = _matrix(b.column("x"))
                low = np.array([min(v) if v else np.inf for v in b.column("low").to_pylist()], float)
                high = np.array([max(v) if v else -np.inf for v in b.column("high").to_pylist()], float)
                own = np.arange(len(self.centres)) == (q @ self.centres.T).argmax(axis=1)[:, None]
                meets = own if home else self.meeting(q, low, high) & (~own if home is False else True)
                row, cell = np.nonzero(meets)
                n = self.slices[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                out = pa.RecordBatch.from_arrays(b.columns, b.schema.names).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell, pa.int32()), pa.array(piece, pa.int32())], [*b.schema.names, "cell", "slice"])

        return asked.mapInArrow(run, "entry long, label long, x array<double>, low array<long>, high array<long>, cell int, slice int")


def _descend(placed: DataFrame, routed: DataFrame, same: bool, k: int, longest: float) -> DataFrame:
    """``asked``, ``high`` (of the window), ``entry``, ``score``: the ``k`` best of every slice for every window."""
    none = F.lit(None).cast("array<long>")
    rows = placed.select("cell", "slice", F.lit(0).alias("kind"), "entry", "label", "first", "x", none.alias("low"), none.alias("high"))
    rows = rows.unionByName(routed.select("cell", "slice", F.lit(1).alias("kind"), "entry", "label", F.lit(0).cast("long").alias("first"), "x", "low", "high"))
    dealt = rows.repartition("cell", "slice").sortWithinPartitions("cell", "slice", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, parts, tree, entries = None, [], None, None
        for b in batches:
            place = np.stack([b.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero(np.r_[True, (place[:, 1:] != place[:, :-1]).any(axis=0), True]) if b.num_rows else np.zeros(1, int)
            for start, end in zip(cuts[:-1], cuts[1:]):
                cell, piece, kind = place[:, start]
                one = b.slice(start, end - start)
                if (cell, piece) != where:
                    where, parts, tree = (cell, piece), [], None
                if kind == 0:
                    parts.append((one.column("entry").to_numpy(), one.column("label").to_numpy(), one.column("first").to_numpy(), _matrix(one.column("x"))))
                    continue
                if tree is None:
                    if not parts:
                        continue
                    entries, label, first, x = (np.concatenate(c) for c in zip(*parts))
                    tree, parts = CoverTree(x, label, first, longest), []
                out = []
                q = _matrix(one.column("x"))
                asked, labels = one.column("entry").to_numpy(), one.column("label").to_numpy()
                for i, (low, high) in enumerate(zip(one.column("low").to_pylist(), one.column("high").to_pylist())):
                    windows = np.array([low, high], np.int64).T.reshape(-1, 2)
                    for w, found in enumerate(tree.search(q[i], int(labels[i]), same, windows, k)):
                        out += [(asked[i], high[w], entries[row], -score) for score, _, row in found]
                columns = np.array(out, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.T], ["asked", "high", "entry", "score"])

    return dealt.mapInArrow(run, "asked long, high long, entry long, score long")


def _first_ids(found: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``asked``, ``high`` and ``list``: the first ``k`` rows (score, vec_id) among the entries found."""
    best = Window.partitionBy("asked", "high").orderBy(F.desc("score"), "vec_id", "entry")
    rows = found.join(ids, "entry").select("asked", "high", "score", "entry", F.explode("ids").alias("vec_id"))
    rows = rows.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k)
    return rows.groupBy("asked", "high").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score", "entry"))).alias("list"))


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``."""
    keyed = materialize(usable(vectors), "whole-vectors")
    spark = keyed.sparkSession
    lengths = keyed.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    keyed = keyed.filter(F.size("x") == (lengths[0]["n"] if lengths else 0))
    # One id more than asked: a row leaves itself out. The limit per group is applied before rows move.
    keep = max(positives + 1, negatives)
    own = keyed.select("key", "label", "vec_id").distinct()
    smallest = own.withColumn("at", F.row_number().over(Window.partitionBy("key", "label").orderBy("vec_id"))).filter(F.col("at") <= keep)
    ids = smallest.groupBy("key", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    anchors = keyed.filter(F.col("vec_id") % every == 0).select("key", "label", "vec_id").distinct()
    entries = keyed.groupBy("key", "label").agg(F.first("x").alias("x")).join(ids, ["key", "label"])
    entries = entries.join(anchors.select("key", "label", F.lit(True).alias("asks")).distinct(), ["key", "label"], "left")
    entries = materialize(entries.withColumn("entry", F.monotonically_increasing_id()).withColumn("first", F.col("ids")[0]), "entries")
    square = F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e)
    n, most = entries.agg(F.count("*"), F.max(square)).first()
    if n == 0:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if most >= 2.0**52:
        raise ValueError("components are too large for exact inner products")
    longest = max(math.sqrt(most), 1.0) * (1 + 1e-12)

    part = min(1.0, SAMPLE_ROWS / n)
    sample = entries.filter(F.pmod(F.xxhash64("key", "label"), F.lit(1 << 30)) <= int(part * (1 << 30))).select("key", "label", "x").limit(2 * SAMPLE_ROWS)
    picked = sample.toArrow().sort_by([("key", "ascending"), ("label", "ascending")]).combine_chunks()
    if picked.num_rows == 0:
        picked = entries.select("x").limit(1).toArrow().combine_chunks()
    wanted = min(CELLS, math.ceil(n / cell_rows))
    cells = Cells(spread_centres(_matrix(picked["x"].combine_chunks()), wanted, longest), longest)
    placed = materialize(cells.place(entries.select("entry", "label", "first", "x")), "cells")
    for r in placed.groupBy("cell").agg(F.max("away").alias("away"), F.count("*").alias("n")).collect():
        cells.wide[r["cell"]], cells.slices[r["cell"]] = angle(r["away"], longest), math.ceil(r["n"] / cell_rows)
    parts = F.element_at(F.lit([int(s) for s in cells.slices]), F.col("cell") + 1)
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("entry"), parts).cast("int"))

    asking = entries.filter("asks").select("entry", "label", "x")
    own_ids, k = entries.select("entry", "ids"), positives + 1
    everything = F.array(F.lit(-(1 << 62)).cast("long")), F.array(F.lit(1 << 62).cast("long"))
    # The anchor's own cell first: what is found there narrows where else to look.
    home = _descend(placed, cells.route(asking.withColumns({"low": everything[0], "high": everything[1]}), True), True, k, longest)
    home = materialize(home.select("asked", "entry", "score"), "home")
    least = home.withColumn("at", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "entry"))).filter(F.col("at") == k)
    narrowed = asking.join(least.select(F.col("asked").alias("entry"), F.col("score").alias("least")), "entry", "left")
    narrowed = narrowed.select("entry", "label", "x", F.array(F.coalesce("least", F.lit(-(1 << 62)))).alias("low"), everything[1].alias("high"))
    away = _descend(placed, cells.route(narrowed, False), True, k, longest)
    found = home.unionByName(away.select("asked", "entry", "score")).withColumn("high", F.lit(0).cast("long"))
    near = materialize(_first_ids(found, own_ids, k).select(F.col("asked").alias("entry"), F.col("list").alias("near")), "positives")

    # All anchors of an entry have the same positive scores: each leaves out one row of the same score.
    scores = F.filter(F.array_distinct("near.score"), lambda s: s >= 0)
    lows = F.transform("high", lambda s: F.call_function("div", s * LEAST_PERCENT + 99, F.lit(100)))
    windowed = asking.join(near, "entry").withColumn("high", scores).withColumn("low", lows).select("entry", "label", "x", "low", "high")
    far = _first_ids(_descend(placed, cells.route(windowed, None), False, negatives, longest), own_ids, negatives)
    far = far.groupBy(F.col("asked").alias("entry")).agg(F.collect_list(F.struct("high", "list")).alias("far"))

    each = anchors.join(entries.select("key", "label", "entry"), ["key", "label"]).join(near, "entry").join(far, "entry")
    others = F.slice(F.filter("near", lambda s: (s["vec_id"] != F.col("vec_id")) | (s["entry"] != F.col("entry"))), 1, positives)
    each = each.select(F.col("vec_id").alias("anchor_id"), F.explode(others).alias("p"), "far")
    fitting = F.flatten(F.transform(F.filter("far", lambda w: w["high"] == F.col("p.score")), lambda w: w["list"]))
    out = each.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode(fitting).alias("n"))
    return out.select("anchor_id", "positive_id", F.col("n.at").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
