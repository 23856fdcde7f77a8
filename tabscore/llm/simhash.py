"""SimHash near-duplicates over BK-trees (operator 2).

Each text has a 64-bit fingerprint: the majority of every bit over the hashes of
its word shingles. Texts whose fingerprints differ in at most ``RADIUS`` bits are
linked, and linked texts form components.

Candidates come from shards. Cut into ``RADIUS + 2`` blocks, two fingerprints that
differ in at most ``RADIUS`` bits agree on two whole blocks at least, so each
distinct fingerprint enters one shard per pair of blocks, named by their bits. Each
shard's fingerprints form BK-trees, whose children are keyed by their Hamming
distance to the parent; a search follows only the edges within the radius. A shard
larger than ``TREE_ROWS`` is cut into slices by hash. Each slice has a tree, and each pair of
slices is a group of its own: the tree of the one and the fingerprints of the other as
queries. So no group is larger than two slices, however many fingerprints a shard has.

A task returns spanning links of what it found, never all pairs. Components are
joined by alternating large and small stars on tables in the shared folder.

Defined results: a null or wordless text has fingerprint zero and is linked like any
other; fewer words than a shingle give one shingle of all; a null id takes part, and
the smallest non-null id names the component (null if there is none); repeated rows
stay; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import column, per_batch
from tabscore.session import materialize

SHINGLE = 3
RADIUS = 2
# Fingerprints in one tree; a larger shard is cut into several trees.
TREE_ROWS = 4_096
# Rows of whole shards that a task turns over at once, and pairs of query and node at once.
ROWS_AT_ONCE = 262_144
PAIRS_AT_ONCE = 262_144

# ---- fingerprints -----------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the whole text) and the signed 64-bit ``fp`` of each row; map-only."""
    whole = column(text).cast("string")
    source = docs.select(column(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("mark"), whole.alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(x) for x in batch.column(2).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["doc_id", "mark", "fp"])

    return source.mapInArrow(per_batch(run), "doc_id long, mark long, fp long")


# ---- BK-trees in arrays -------------------------------------------------------


class BKForest:
    """One BK-tree per group of distinct fingerprints; ``group`` is sorted and names each row's tree."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        self.fp = fp
        n = len(fp)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        self.groups, self.roots = group[starts], starts
        at = np.repeat(starts, np.diff(np.r_[starts, n]))
        waiting = np.setdiff1d(np.arange(n), starts, assume_unique=True)
        slots, nodes = [], []
        # A round puts one row under each (node, distance) that has no child yet; the others go down to it.
        while waiting.size:
            slot = at[waiting] * 65 + np.bitwise_count(fp[waiting] ^ fp[at[waiting]])
            taken, first, place = np.unique(slot, return_index=True, return_inverse=True)
            slots.append(taken)
            nodes.append(waiting[first])
            at[waiting] = waiting[first][place]
            waiting = np.delete(waiting, first)
        slot = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        node = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(slot)
        self.slot, self.node = slot[order], node[order]

    def search(self, query: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query row, tree row) within the radius, in bounded pieces."""
        found = np.searchsorted(self.groups, group)
        found = np.minimum(found, max(len(self.groups) - 1, 0))
        has = np.flatnonzero(self.groups[found] == group) if len(self.groups) else np.zeros(0, np.int64)
        work = [(has, self.roots[found[has]])] if has.size else []
        while work:
            q, v = work.pop()
            if q.size > PAIRS_AT_ONCE:
                work.append((q[PAIRS_AT_ONCE:], v[PAIRS_AT_ONCE:]))
                q, v = q[:PAIRS_AT_ONCE], v[:PAIRS_AT_ONCE]
            d = np.bitwise_count(query[q] ^ self.fp[v]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], v[near]
            low = np.searchsorted(self.slot, v * 65 + np.maximum(d - radius, 1))
            high = np.searchsorted(self.slot, v * 65 + np.minimum(d + radius, 64), side="right")
            n = high - low
            if (total := int(n.sum())) > 0:
                offset = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(total)
                work.append((np.repeat(q, n), self.node[offset]))


def union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of all pairs (a, b); ``root`` points each row to a row of its set, in the end the smallest."""
    while True:
        a, b = _find(root, a), _find(root, b)
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def _find(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = root[x]
        if (up == x).all():
            return x
        x = root[up]


def shard_links(fp: np.ndarray, group: np.ndarray, home: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, smaller-row fingerprint of its set) inside each group; ``home`` marks tree rows, ``asks`` queries."""
    tree = BKForest(fp[home], group[home])
    rows, queries = np.flatnonzero(home), np.flatnonzero(asks)
    root = np.arange(len(fp))
    for q, v in tree.search(fp[queries], group[queries], radius):
        q, v = queries[q], rows[v]
        other = q != v
        union(root, q[other], v[other])
    top = _find(root, np.arange(len(fp)))
    linked = top != np.arange(len(fp))
    return fp[linked], fp[top[linked]]


# ---- links and components as Spark jobs -----------------------------------------


def near_links(fps: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Spanning links ``a``, ``b`` between the distinct fingerprints ``fp`` within ``radius`` bits."""
    blocks = radius + 2
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in pair) for pair in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shards = F.array(*[F.struct(F.lit(i).alias("pair"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)])
    keyed = fps.select("fp", F.explode(shards).alias("s")).select("fp", "s.pair", "s.bits")
    large = keyed.groupBy("pair", "bits").count().filter(F.col("count") > tree_rows)
    large = large.select("pair", "bits", F.ceil(F.col("count") / tree_rows).cast("int").alias("trees"))
    placed = keyed.join(large, ["pair", "bits"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    # In the tree of its own slice for that slice and all later ones, and a query to the trees of all earlier ones.
    other = F.explode(F.sequence(F.lit(0), F.col("trees") - 1))
    placed = placed.select("pair", "bits", "fp", "own", other.alias("other"))
    placed = placed.select(
        "pair", "bits", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("slice"), "fp",
        (F.col("own") <= F.col("other")).alias("home"), (F.col("own") >= F.col("other")).alias("asks"),
    )
    shared = placed.repartition("pair", "bits", "tree", "slice").sortWithinPartitions("pair", "bits", "tree", "slice", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)))
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:
                parts = [np.concatenate(x) for x in zip(*held)]
                cut = _last_start(parts)
                if cut:
                    yield _links([x[:cut] for x in parts], radius)
                held, rows = [tuple(x[cut:] for x in parts)], len(parts[0]) - cut
        if rows:
            yield _links([np.concatenate(x) for x in zip(*held)], radius)

    return shared.mapInArrow(run, "a long, b long").distinct()


def _starts(parts: list[np.ndarray]) -> np.ndarray:
    apart = np.zeros(len(parts[0]) - 1, bool)
    for key in parts[:4]:
        apart |= key[1:] != key[:-1]
    return np.r_[True, apart]


def _last_start(parts: list[np.ndarray]) -> int:
    return int(np.flatnonzero(_starts(parts))[-1])


def _links(parts: list[np.ndarray], radius: int) -> pa.RecordBatch:
    group = np.cumsum(_starts(parts))
    several = np.bincount(group)[group] > 1
    fp, home, asks = parts[4][several].view(np.uint64), parts[5][several].astype(bool), parts[6][several].astype(bool)
    a, b = shard_links(fp, group[several], home, asks, radius)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``node`` and the smallest node ``root`` it is linked to, for all nodes with links.

    Alternates large and small stars until the links no longer change. Each round is
    written to the shared folder, so no lineage grows and a lost executor costs one round.
    """
    now = materialize(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("u", "v"))
        lowest = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("k"), F.least("v", "m").alias("m"))
        large = both.filter("u > v").join(lowest, F.col("v") == F.col("k")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.union(both.filter("u < v").join(lowest, F.col("v") == F.col("k")).select("v", F.col("m").alias("u"))).filter("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "k")
        small = large.join(least, F.col("v") == F.col("k")).select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        after = materialize(small.select("e.v", "e.u").filter("v <> u").distinct(), "links")
        before, state = state, _state(after)
        now = after
        if before == state:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _state(links: DataFrame) -> tuple[int, int]:
    n, total = links.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return n, int(total or 0)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``mark``, ``fp`` and ``component_id`` of every row."""
    marked = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(near_links(distinct.select("fp"), radius))
    labelled = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = labelled.select("fp", "root").join(names, "root").select(F.col("fp").alias("k"), "component_id")
    return marked.join(by_print, F.col("fp") == F.col("k")).select("doc_id", "mark", "fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row."""
    return groups(docs, doc_id, text, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
