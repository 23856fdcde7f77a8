"""Documents linked by the Jaccard similarity of their word shingles (operator 13).

Two sets of similarity 0.8 or more share a token among the first ``n - ceil(0.8 n) + 1``
of each, whatever one order the tokens of all sets are put in. Several such global orders
filter the pairs before any is verified:

1. Frequent tokens last, the others by hash. Documents meet by the tokens of these
   prefixes. Which tokens are frequent comes from a bounded sample, and then from the prefixes
   themselves, as long as a token there still has very many nodes; the order is valid with
   any such list, which only spares the meetings by common lines and passages. How many prefix tokens
   a pair shares bounds its overlap from above.
2. and 3. Two further orders by other hashes: a pair that is left must share a prefix
   token under each of them. Only then are the whole sets compared.

Equal sets are one node. Each node is first compared with the smallest node of its
tokens, if it shares enough tokens with it; in a few rounds, nodes of tokens with many nodes are compared with
the nearest node of another component. This ties families together. Then only pairs whose
nodes are not yet in one component are looked at, inside the task that holds a token's nodes: a node brings
a bitmap of its set, the bits that one node has and the other lacks are tokens not shared, and a pair leaves
the task only if these are few enough. A token with more than ``MEETING`` nodes is cut into slices by hash, and
each pair of slices is a group of its own, so no group is larger than that and no pair is lost.

A task holds the set of one node and streams those to compare with it; a node with many
partners goes to several tasks. Texts move, not sets: they are smaller.

Defined results: a null text, or one without words, has no set, ``n_shingles`` 0, and its own id
as component; fewer words than a shingle are one shingle of all; the smallest non-null id
names a component (null if there is none); repeated rows stay, each with the same result;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import column, per_batch
from tabscore.llm.simhash import components
from tabscore.session import materialize

WORDS = 5
PERCENT = 80
# Sampled documents, occurrences in them that make a token frequent, and tokens in the list at most.
SAMPLE_DOCS = 8_192
FREQUENT = 4
FREQUENT_TOKENS = 1_000_000
# Nodes of a token beyond which it counts as frequent as well, and how often the list may grow.
CROWD = 1_024
LISTS = 4
# Nodes that meet in one group, members that one task compares with a node, and nodes whose keys are broadcast.
MEETING = 512
MEMBERS = 64
BROADCAST_NODES = 500_000
# Words of bitmaps compared at once, and pairs of rows looked at at once.
WORDS_AT_ONCE = 1 << 20
PAIRS_AT_ONCE = 1 << 20
# Nodes of a token from which on its nodes are tied to their nearest ones first, and how often.
FAMILY = 32
ROUNDS = 4
# Bits of a set's bitmap: a power of two, at least twice its tokens.
LEAST_BITS = 256
# Words remembered by a worker, and the longest of them in bytes.
WORDS_KEPT, WORD_BYTES = 200_000, 48

_C = np.uint64(0x9E3779B97F4A7C15)
# Odd factors that make the second and the third order.
ORDERS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class WordHashes(dict):
    """64-bit hashes of words; short words are remembered, up to a number."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 11)
        if len(word) <= WORD_BYTES:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = value
        return value


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64) * _C
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * _C
        out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix_size(n: int | Column) -> int | Column:
    """Tokens of which two similar sets share one, under any global order."""
    if isinstance(n, Column):
        return n - F.call_function("div", PERCENT * n + 99, F.lit(100)).cast("int") + 1
    return n - (PERCENT * n + 99) // 100 + 1


def prefix(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The prefix under the first order: tokens of the sorted list ``frequent`` come last."""
    n = prefix_size(len(tokens))
    if not len(tokens):
        return tokens
    if len(frequent):
        last = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
        tokens = np.concatenate([tokens[~last], tokens[last]])
    return tokens[:n]


def order_prefixes(tokens: np.ndarray) -> list[np.ndarray]:
    """The prefixes under the further orders, as sorted tokens moved by the order's factor."""
    n = prefix_size(len(tokens))
    return [np.partition(moved, n - 1)[:n] if n < len(moved) else moved for moved in (_moved(tokens, f) for f in ORDERS)]


def _moved(tokens: np.ndarray, factor: np.uint64) -> np.ndarray:
    out = tokens * factor
    return out ^ (out >> np.uint64(32))


def _common(small: np.ndarray, large: np.ndarray) -> int:
    """How many distinct values two arrays share; ``large`` is sorted."""
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


def similar(a: np.ndarray, b: np.ndarray, b_prefixes: list[np.ndarray]) -> bool:
    """Whether two sets pass the further orders and are similar; ``b_prefixes`` are b's, sorted."""
    if PERCENT * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    for own, other in zip(order_prefixes(a), b_prefixes):
        if not _common(own, other):
            return False
    shared = _common(a, b)
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """One bit per token, as 64-bit words; halves laid over each other give the bitmap of half the size."""
    size = max(LEAST_BITS, 1 << int(2 * len(tokens) - 1).bit_length())
    place = (_moved(tokens, _C) & np.uint64(size - 1)).astype(np.int64)
    bits = np.zeros(size, np.uint8)
    bits[place] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(words: np.ndarray) -> np.ndarray:
    """Bitmaps (rows x words) of half the size."""
    half = words.shape[1] // 2
    return words[:, :half] | words[:, half:]


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By row: how many bits x has and y lacks; halves are laid over each other down to the smaller bitmap."""
    while x.shape[1] > y.shape[1]:
        x = folded(x)
    while y.shape[1] > x.shape[1]:
        y = folded(y)
    return np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)


def overlaps(n: np.ndarray, words: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest overlap that the bitmaps of rows (a, b) allow: tokens whose bits the other lacks are not shared."""
    sizes = np.array([len(w) for w in words], np.int64)
    most = np.zeros(len(a), np.int64)
    for size in np.unique(sizes[a]):
        for other in np.unique(sizes[b]):
            rows = np.flatnonzero((sizes[a] == size) & (sizes[b] == other))
            step = max(1, WORDS_AT_ONCE // max(size, other))
            for at in range(0, len(rows), step):
                r = rows[at : at + step]
                x, y = np.stack([words[i] for i in a[r]]), np.stack([words[i] for i in b[r]])
                most[r] = np.minimum(n[a[r]] - apart(x, y), n[b[r]] - apart(y, x))
    return most


def met_pairs(key: np.ndarray, part: np.ndarray, node: np.ndarray, n: np.ndarray, root: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Distinct pairs (a, b, n, m, tokens shared here, largest overlap) that can be similar and have two roots.

    Rows with one ``key`` (its columns are first, i, j, token) are a group; pairs are between the slices i and j.
    """
    starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
    ends = np.repeat(np.append(starts[1:], key.shape[1]), np.diff(np.append(starts, key.shape[1])))
    later = ends - np.arange(key.shape[1]) - 1
    _, first, code = np.unique(node, return_index=True, return_inverse=True)
    codes, times, at = [], [], 0
    before = np.concatenate([[0], np.cumsum(later)])
    while at < len(later):
        upto = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS_AT_ONCE, side="right")) - 1)
        a = np.repeat(np.arange(at, upto), later[at:upto])
        b = a + 1 + np.arange(len(a)) - np.repeat(before[at:upto] - before[at], later[at:upto])
        across = (key[1][a] == key[2][a]) | (part[a] != part[b])
        keep = across & (root[a] != root[b]) & (PERCENT * np.maximum(n[a], n[b]) <= 100 * np.minimum(n[a], n[b]))
        x, y = code[a[keep]], code[b[keep]]
        one, count = np.unique(np.minimum(x, y) * len(first) + np.maximum(x, y), return_counts=True)
        codes.append(one)
        times.append(count)
        at = upto
    if not codes:
        return np.zeros((0, 6), np.int64)
    pair, place = np.unique(np.concatenate(codes), return_inverse=True)
    shared = np.bincount(place, np.concatenate(times), len(pair)).astype(np.int64)
    a, b = first[pair // len(first)], first[pair % len(first)]
    words = [np.frombuffer(w, np.uint64) for w in bits]
    most = overlaps(n, words, a, b) if len(a) else np.zeros(0, np.int64)
    fit = (100 + PERCENT) * most >= PERCENT * (n[a] + n[b])
    return np.column_stack([node[a], node[b], n[a], n[b], shared, most])[fit]


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    known = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    return known.select("doc_id", _key(F.col("doc_id"), F.col("text")).alias("row"), "text")


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def frequent_tokens(source: DataFrame, rows: int) -> np.ndarray:
    """Tokens that occur often in a bounded sample of the documents, sorted."""
    share = min(1.0, SAMPLE_DOCS / max(rows, 1))
    picked = source.filter(F.pmod(F.xxhash64("row", F.lit("frequent")), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = WordHashes()
        found = [shingles(t, known) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([_signed(np.concatenate(found) if found else np.zeros(0, np.uint64))], ["token"])

    counted = picked.mapInArrow(per_batch(run), "token long").groupBy("token").count().filter(F.col("count") >= FREQUENT)
    # Groups of copies make all their tokens frequent: only the most frequent ones are of use.
    top = counted.orderBy(F.desc("count"), "token").limit(FREQUENT_TOKENS).select("token").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def marked_sets(source: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``doc_id``, ``row``, ``digest`` of the set (null without one), ``n``, ``prefix`` and ``bits`` of every document; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, known) for t in batch.column(2).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            prefixes = [prefix(s, frequent) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = _signed(np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64))
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "digest", "n", "prefix", "bits"])

        yield from per_batch(one)(batches)

    return source.mapInArrow(run, "doc_id long, row long, digest binary, n int, prefix array<long>, bits binary")


def _texts(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and ``text`` of the given nodes (node, row, digest): once or more, as rows may repeat."""
    need = F.broadcast(nodes) if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else nodes
    rows = source.select("row", "text").join(need.select("row", "node", "digest"), "row").select("node", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        for batch in batches:
            keep = []
            for i, (node, digest, text) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
                # A task passes a node on once; rows that only share the short key are not the node's.
                if node not in seen and hashlib.blake2b(shingles(text, known).tobytes(), digest_size=16).digest() == digest:
                    seen.add(node)
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["node", "text"]).take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, "node long, text string")


def verify(source: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links ``a``, ``b`` among the pairs ``a``, ``b`` of nodes."""
    wanted = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct()
    texts = materialize(_texts(source, nodes.join(wanted, "node", "left_semi").select("node", "row", "digest")), "texts")
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(spread, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    members = members.join(texts, "node").select("a", "part", F.lit(1).alias("kind"), "node", "text")
    heads = spread.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts, "node")
    heads = heads.select(F.col("node").alias("a"), "part", F.lit(0).alias("kind"), "node", "text")
    dealt = heads.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, head, tokens, prefixes = WordHashes(), None, None, []
        for batch in batches:
            found = []
            for a, _, kind, node, text in zip(*[c.to_pylist() for c in batch.columns]):
                if kind == 0:
                    if head != a:
                        head, tokens = a, shingles(text, known)
                        prefixes = [np.sort(p) for p in order_prefixes(tokens)]
                elif head == a and similar(shingles(text, known), tokens, prefixes):
                    found.append((a, node))
            columns = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(columns[:, 0]), pa.array(columns[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def possible(n: Column, m: Column, shared: Column) -> Column:
    """Whether sets of sizes n and m that share so many prefix tokens can be similar.

    The set whose prefix ends first in the order shares no other tokens up to there, so the
    overlap is at most ``shared`` plus what that set has beyond its prefix.
    """
    need = F.call_function("div", PERCENT * (n + m) + (99 + PERCENT), F.lit(100 + PERCENT))
    return shared + F.greatest(n - prefix_size(n), m - prefix_size(m)) >= need


def _alike(n: Column, m: Column) -> Column:
    return PERCENT * F.greatest(n, m) <= 100 * F.least(n, m)


def first_pairs(met: DataFrame) -> DataFrame:
    """Each node with the smallest node of its tokens, where they share enough of them."""
    lowest = met.groupBy("token").agg(F.min(F.struct("node", "n")).alias("low"))
    star = met.join(lowest, "token").filter(F.col("node") != F.col("low.node"))
    shared = star.groupBy(F.col("low.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("low.n").alias("m"))
    return shared.filter(_alike(F.col("n"), F.col("m")) & possible(F.col("n"), F.col("m"), F.col("shared"))).select("a", "b")


def later_pairs(met: DataFrame, nodes: DataFrame, roots: DataFrame, nearest: bool = False) -> DataFrame:
    """All pairs that share a prefix token, can be similar and are not yet in one component; with ``nearest`` one of them per node."""
    placed = met.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("first"), F.max("met").alias("most")).filter("low <> high")
    # Tokens with the same smallest node go together, so that a pair leaves once, not once for each token it shares. Where they have
    # many nodes, every pair of slices is one group.
    families = mixed.groupBy("first").agg(F.ceil(F.max("most") / MEETING).cast("int").alias("parts"))
    placed = placed.join(mixed.select("token", "first").join(families, "first"), "token").join(nodes.select("node", "bits"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cut = placed.select("first", "token", "node", "n", "root", "bits", own.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cut = cut.select("first", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "token", "part", "node", "n", "root", "bits")
    dealt = cut.repartition("first", "i", "j").sortWithinPartitions("first", "i", "j", "token", "node")

    def pairs(table: pa.Table) -> pa.RecordBatch:
        cells = {c: table.column(c).to_numpy().astype(np.int64) for c in ("first", "i", "j", "token", "part", "node", "n", "root")}
        key = np.stack([cells[c] for c in ("first", "i", "j", "token")])
        rows = met_pairs(key, cells["part"], cells["node"], cells["n"], cells["root"], table.column("bits").to_pylist())
        if nearest and len(rows):
            # The most similar partner by the bitmaps, of each node.
            near = np.argsort(-rows[:, 5] / (rows[:, 2] + rows[:, 3]), kind="stable")
            rows = rows[np.union1d(*[near[np.unique(rows[near, side], return_index=True)[1]] for side in (0, 1)])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], ["a", "b", "n", "m", "shared", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            token = np.stack([table.column(c).to_numpy() for c in ("first", "i", "j", "token")])
            last = np.flatnonzero(np.r_[True, (token[:, 1:] != token[:, :-1]).any(axis=0)])[-1]
            # The last group may go on in the next batch.
            if last:
                yield pairs(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held))

    found = dealt.mapInArrow(run, "a long, b long, n long, m long, shared long, most long")
    if nearest:
        ends = F.explode(F.array(F.struct(F.col("a").alias("of"), "a", "b"), F.struct(F.col("b").alias("of"), "a", "b")))
        like = (F.col("most") / (F.col("n") + F.col("m"))).alias("like")
        best = found.select(like, ends.alias("e")).groupBy("e.of").agg(F.max_by("e", F.struct("like", "e.a", "e.b")).alias("e"))
        return best.select("e.a", "e.b").distinct()
    shared = found.groupBy("a", "b", "n", "m").agg(F.sum("shared").alias("shared"))
    return shared.filter(possible(F.col("n"), F.col("m"), F.col("shared"))).select("a", "b")


def _sets(source: DataFrame, frequent: np.ndarray) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marked documents, nodes, and the prefix tokens that several nodes have."""
    marked = materialize(marked_sets(source, frequent), "sets")
    classes = marked.filter("digest is not null").groupBy("digest")
    classes = classes.agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    nodes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    tokens = nodes.select("node", "n", F.explode("prefix").alias("token"))
    several = tokens.groupBy("token").agg(F.count("*").alias("met")).filter("met > 1")
    return marked, nodes, materialize(tokens.join(several, "token"), "met")


def _crowded(met: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """Tokens with very many nodes that are not in the list yet, as far as the list has room."""
    room = FREQUENT_TOKENS - len(frequent)
    top = met.filter(F.col("met") > CROWD).groupBy("token").agg(F.max("met").alias("met")).orderBy(F.desc("met"), "token").limit(len(frequent) + max(room, 0))
    found = top.select("token").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    return np.setdiff1d(found, frequent)[: max(room, 0)]


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row."""
    source = _source(docs, doc_id, text)
    frequent = frequent_tokens(source, docs.count())
    marked, nodes, met = _sets(source, frequent)
    for _ in range(LISTS):
        more = _crowded(met, frequent)
        if not len(more):
            break
        frequent = np.union1d(frequent, more)
        marked, nodes, met = _sets(source, frequent)
    first = materialize(first_pairs(met), "pairs")
    links = materialize(verify(source, nodes, first), "links")
    roots = components(links)
    # Families are tied together by nearest nodes, so that few of their pairs are left.
    crowd = met.filter(F.col("met") >= FAMILY)
    for _ in range(ROUNDS if not crowd.isEmpty() else 0):
        more = materialize(verify(source, nodes, materialize(later_pairs(crowd, nodes, roots, True), "pairs")), "links")
        if more.isEmpty():
            break
        links = materialize(links.unionByName(more), "links")
        roots = components(links)
    later = materialize(later_pairs(met, nodes, roots), "pairs")
    if not later.isEmpty():
        links = materialize(links.unionByName(verify(source, nodes, later)), "links")
        roots = components(links)
    rooted = nodes.select("digest", "node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root").select("digest", "component_id")
    joined = marked.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
