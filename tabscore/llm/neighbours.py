"""Nearest neighbours by a hash-prefix forest (operator 9).

Each tree gives every vector a long hash string, the signs of its products with
random directions, and keeps the strings sorted. A query finds in each tree the
range of its longest matching prefix (the descent). Then all trees go up together, one
bit at a time: ranges widen to shorter prefixes and add candidates, which are scored
exactly. A query stops when a vector as near as its present k-th best would have been
met in some tree by now with probability ``FOUND``: clustered queries stop deep down,
queries without near neighbours climb further. So no candidate is cut off by a cap.

Inner products become angles by one more coordinate that fills every vector up to
the longest norm. Equal vectors are one entry with the smallest ids of its group,
so a group of copies, however large, is one leaf.

Spark deals the distinct vectors to shards of about ``SHARD_ROWS`` and the distinct
query vectors to blocks; each (shard, block) pair is one group in which the shard's
forest is built, searched and dropped. A query's shard results are merged by rank.

Defined results: rows with a null, zero, or partly null or non-finite vector, and rows
without an id, take no part; vectors of another length than the most frequent one
take no part either; repeated rows (same id and vector) count once; equal scores go to the
smaller id; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscore.llm.common import column
from tabscore.session import materialize

K = 20
TREES = 64
BITS = 32
FOUND = 0.96
SHARD_ROWS = 16_384
BLOCK_ROWS = 4_096
SEED = 20240503


class PrefixForest:
    """Sorted hash strings of one shard; vectors are rows of ``x``, ``longest`` bounds all norms."""

    def __init__(self, x: np.ndarray, longest: float, trees: int = TREES, bits: int = BITS):
        self.x, self.longest, self.trees, self.bits = x, longest, trees, bits
        rng = np.random.default_rng(SEED)
        self.directions = rng.standard_normal((x.shape[1] + 1, trees * bits)).astype(np.float32)
        rest = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", x, x), 0))
        self.codes, self.order = np.empty((trees, len(x)), np.uint32), np.empty((trees, len(x)), np.int32)
        codes = self._codes(np.hstack([x, rest[:, None]]).astype(np.float32))
        for t in range(trees):
            self.order[t] = np.argsort(codes[:, t], kind="stable")
            self.codes[t] = codes[self.order[t], t]

    def _codes(self, filled: np.ndarray) -> np.ndarray:
        out = np.empty((len(filled), self.trees), np.uint32)
        weights = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.uint32)
        for at in range(0, len(filled), 1024):
            signs = (filled[at : at + 1024] @ self.directions > 0).reshape(-1, self.trees, self.bits)
            out[at : at + 1024] = (signs * weights).sum(axis=2, dtype=np.uint32)
        return out

    def search(self, queries: np.ndarray, k: int, found: float = FOUND) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: its number, and rows and scores of all candidates met."""
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        codes = self._codes(np.hstack([queries, np.zeros((len(queries), 1))]).astype(np.float32))
        lows, highs = self._ranges(codes)
        for i, q in enumerate(queries):
            met = np.zeros(len(self.x), bool)
            rows, scores = np.zeros(0, np.int64), np.zeros(0)
            low, high = lows[:, i], highs[:, i]  # by depth and tree
            depth = int(np.flatnonzero((high > low).any(axis=1)).max(initial=0))
            while True:
                a, n = low[depth], high[depth] - low[depth]
                total = int(n.sum())
                flat = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(total)
                hit = self.order[np.repeat(np.arange(self.trees), n), flat]
                new = np.zeros(len(self.x), bool)
                new[hit] = True
                new = np.flatnonzero(new & ~met)
                if new.size:
                    met[new] = True
                    rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.x[new] @ q])
                if depth == 0 or len(rows) == len(self.x):
                    break
                up = depth - 1
                if len(scores) >= k:
                    near = float(np.partition(scores, len(scores) - k)[len(scores) - k]) / (norms[i] * self.longest)
                    same = 1 - math.acos(max(-1.0, min(1.0, near))) / math.pi
                    if 1 - (1 - same**depth) ** self.trees >= found:
                        break
                    # The next depth that could be enough: the ones between would only add what it holds anyway.
                    up = min(up, int(math.log(1 - (1 - found) ** (1 / self.trees)) / math.log(min(same, 1 - 1e-9))))
                depth = max(up, 0)
            yield i, rows, scores

    def _ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of every prefix length's range: (bits + 1) x queries x trees."""
        lows = np.zeros((self.bits + 1, len(codes), self.trees), np.int32)
        highs = np.full_like(lows, len(self.x))
        for t in range(self.trees):
            own = codes[:, t].astype(np.uint64)
            for depth in range(1, self.bits + 1):
                shift = np.uint64(self.bits - depth)
                first = (own >> shift) << shift
                lows[depth, :, t] = np.searchsorted(self.codes[t], first.astype(np.uint32), side="left")
                highs[depth, :, t] = np.searchsorted(self.codes[t], (first | ((np.uint64(1) << shift) - np.uint64(1))).astype(np.uint32), side="right")
        return lows, highs


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the rows that take part."""
    v = F.transform(column("embedding"), lambda e: e.cast("double"))
    rows = vectors.select(column("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.filter(finite & F.exists("v", lambda e: e != 0))


def nearest(vectors: DataFrame, every: int = 20, k: int = K, found: float = FOUND) -> DataFrame:
    """The ``k`` nearest other rows of each row whose id is divisible by ``every``.

    Returns ``query_id``, ``rank``, ``vec_id``, ``score``.
    """
    # Adding zero turns -0.0 into 0.0, so that equal vectors have equal bytes.
    rows = usable(vectors).withColumn("v", F.transform("v", lambda e: e + F.lit(0.0)))
    keyed = materialize(rows.select("vec_id", "v", F.sha2(F.to_json("v"), 256).alias("key")), "vectors")
    lengths = keyed.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = lengths[0]["n"] if lengths else 0
    keyed = keyed.filter(F.size("v") == size)
    # The smallest ids of each group of equal vectors: one more than asked, as a query leaves itself out.
    ids = keyed.select("key", "vec_id").distinct()
    spread = ids.groupBy("key", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("own"))
    members = spread.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("own"))), 1, k + 1).alias("ids"))
    distinct = materialize(keyed.groupBy("key").agg(F.first("v").alias("v")).join(members, "key").withColumn("entry", F.monotonically_increasing_id()), "distinct-vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    n, longest = distinct.agg(F.count("*"), F.max(norm)).first()
    asked = keyed.filter(F.col("vec_id") % every == 0).select("key", "vec_id").distinct()
    queries = distinct.select("key", "entry", "v").join(asked.select("key").distinct(), "key", "left_semi")
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(n / every / BLOCK_ROWS))
    place = F.xxhash64("key", F.lit("shard"))
    data = distinct.select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "entry", "v")
    wanted = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("at_shard"), F.pmod(F.xxhash64("key", F.lit("block")), F.lit(blocks)).cast("int").alias("at_block"), F.col("entry").alias("asked"), F.col("v").alias("q"))
    top = float(longest or 1.0) * (1 + 1e-9)

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            left = left.sort_values("entry")
            entries, x = left["entry"].to_numpy(), np.stack(left["v"].to_numpy())
            forest = PrefixForest(x, top)
            asked = right["asked"].to_numpy()
            for at in range(0, len(right), 256):
                q = np.stack(right["q"].to_numpy()[at : at + 256])
                for i, rows, scores in forest.search(q, k + 1, found):
                    if len(rows) > k + 1:
                        # Ties at the border stay: their order depends on ids.
                        border = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                        rows, scores = rows[scores >= border], scores[scores >= border]
                    out.append((np.full(len(rows), asked[at + i]), entries[rows], scores))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query", "entry", "score"), columns)))

    paired = data.groupBy("shard", "block").cogroup(wanted.groupBy("at_shard", "at_block"))
    met = paired.applyInPandas(search, "query long, entry long, score double")
    # Distinct vectors, ranked: the first k + 1 of them hold the k nearest rows.
    near = met.join(distinct.select("entry", "ids"), "entry")
    best = near.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]))).filter(F.col("at") <= k + 1)
    found_ids = best.select("query", "score", F.explode("ids").alias("vec_id"))
    ranked = found_ids.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("at") <= k + 1)
    lists = ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("list"))
    each = asked.join(distinct.select("key", F.col("entry").alias("query")), "key").join(lists, "query")
    own = F.filter("list", lambda s: s["vec_id"] != F.col("vec_id"))
    out = each.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(own, 1, k)).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
