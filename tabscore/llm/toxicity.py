"""Toxicity with a factorization machine over hashed terms (operator 7).

A text is the set of its lower-case terms, whole words and word beginnings of some
lengths, hashed to ``BUCKETS``. Besides a weight a term has a short vector, and each pair of terms in a text adds the product of their
vectors: an insult next to the mention of a group can count for more than both
alone, which no sum of weights can say. All pairs cost one pass, as
(sum v)^2 - sum v^2 over two.

The machine is trained in numpy on the driver, on at most about ``SAMPLE_TEXTS``
labelled texts chosen by a hash of the id. It knows the terms of at least ``LEAST_TEXTS`` of
them that tell the labels apart by ``LEAST_DEVIATION`` standard deviations, and both terms of each
pair that does so beyond what either of its terms tells: such a term may be as frequent under both
labels. Pairs are counted among the ``PAIR_TERMS`` most frequent terms, in blocks of matrix products, whatever
the length of a text. Scoring is map-only and reads every whole text.

Defined results: a null or empty text has the score of no terms; rows without an id
are scored but not learned from; of repeated labels of one id the highest counts, of
repeated rows the one with the smallest terms teaches; repeated rows give repeated rows; an empty table gives an empty one; without labels
of both kinds the score is the share of label 1 (0 without any). Other columns are
not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import column, held_out, learnable, per_batch

BUCKETS = 1 << 18
FACTORS = 4
SAMPLE_TEXTS = 12_000
LEAST_TEXTS = 5
LEAST_DEVIATION = 3.0
PAIR_TERMS, PAIR_BLOCK = 4_096, 512
PAIR_EVIDENCE = 36.0  # twice the log-likelihood ratio against either term's own rate: six standard deviations
BEGINNINGS = (4, 5, 6)
EPOCHS = 8
BATCH = 64
RATE = 0.05
DECAY = 0.002  # pull of weights and vectors to zero, each time their term is seen
CUTOFF = 0.7
TERMS_KEPT = 400_000

TERM = re.compile(r"[^\W\d_]+")


def bucket(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 7) % BUCKETS


class Buckets(dict):
    """Buckets of a word and its beginnings, the bounded memory of one process; with ``known`` only those."""

    def __init__(self, known: np.ndarray | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= TERMS_KEPT:
            self.clear()
        found = [bucket(word)] + [bucket(word[:n] + "*") for n in BEGINNINGS if len(word) >= n]
        made = self[word] = tuple(b for b in found if self.known is None or self.known[b])
        return made

    def of(self, text: str | None) -> np.ndarray:
        """The distinct buckets of a text, sorted."""
        found: set[int] = set()
        found.update(*[self[t] for t in set(TERM.findall((text or "").lower()))])
        return np.sort(np.fromiter(found, np.int64, len(found)))


@dataclass
class FactorizationMachine:
    """Intercept, and by bucket a weight and a vector; unknown buckets are zero."""

    bias: float
    weight: np.ndarray
    vectors: np.ndarray

    def margin(self, terms: np.ndarray) -> float:
        """Log-odds of label 1 for one text's buckets."""
        if terms.size == 0:
            return self.bias
        v = self.vectors[terms]
        total = v.sum(axis=0)
        return float(self.bias + self.weight[terms].sum() + 0.5 * (np.dot(total, total) - np.vdot(v, v)))

    def score(self, terms: np.ndarray) -> float:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(terms), -30, 30)))


def _evidence(hits: np.ndarray, seen: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Twice the log-likelihood ratio of ``hits`` out of ``seen`` against ``rate``, negative where they are fewer than expected."""
    share = hits / np.maximum(seen, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        told = np.where(hits > 0, hits * np.log(share / rate), 0.0) + np.where(hits < seen, (seen - hits) * np.log((1 - share) / (1 - rate)), 0.0)
    return 2 * told * np.sign(share - rate)


def pair_terms(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Terms of pairs whose rate of label 1 lies clearly above, or clearly below, the rates of both terms."""
    flat, row = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    seen = np.bincount(flat, minlength=BUCKETS)
    top = np.argsort(-seen, kind="stable")[:PAIR_TERMS]
    top = np.sort(top[seen[top] >= LEAST_TEXTS])
    rate = np.bincount(flat[labels[row] > 0], minlength=BUCKETS)[top] / seen[top]
    code = np.full(BUCKETS, -1)
    code[top] = np.arange(len(top))
    place, toxic, found = code[flat], labels > 0, np.zeros(len(top), bool)

    def block(start: int) -> np.ndarray:
        """Which text has which of the terms from ``start`` on."""
        inside = (place >= start) & (place < start + PAIR_BLOCK)
        out = np.zeros((len(texts), min(PAIR_BLOCK, len(top) - start)), np.float32)
        out[row[inside], place[inside] - start] = 1
        return out

    for i in range(0, len(top), PAIR_BLOCK):
        x = block(i)
        for j in range(i, len(top), PAIR_BLOCK):
            y = x if i == j else block(j)
            both, hits = (x.T @ y).astype(np.float64), (x[toxic].T @ y[toxic]).astype(np.float64)
            first = _evidence(hits, both, rate[i : i + PAIR_BLOCK, None])
            second = _evidence(hits, both, rate[None, j : j + PAIR_BLOCK])
            clear = (np.minimum(first, second) >= PAIR_EVIDENCE) | (np.maximum(first, second) <= -PAIR_EVIDENCE)
            clear &= both >= LEAST_TEXTS
            found[i : i + PAIR_BLOCK] |= clear.any(axis=1)
            found[j : j + PAIR_BLOCK] |= clear.any(axis=0)
    return top[found]


def gradients(fm: FactorizationMachine, texts: list[np.ndarray], labels: np.ndarray, toxic: float = 1.0) -> tuple:
    """Slopes of the log-loss over some texts, label 1 weighing ``toxic``: of the bias, the terms and how often they occur, of their weights and vectors."""
    sizes = np.array([len(t) for t in texts])
    flat = np.concatenate(texts)
    row = np.repeat(np.arange(len(texts)), sizes)
    v = fm.vectors[flat]
    total = np.zeros((len(texts), v.shape[1]), v.dtype)
    np.add.at(total, row, v)
    squares = np.bincount(row, (v * v).sum(axis=1), len(texts))
    linear = np.bincount(row, fm.weight[flat], len(texts))
    margin = fm.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares)
    slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) * np.where(labels > 0, toxic, 1.0)).astype(v.dtype)
    terms, place = np.unique(flat, return_inverse=True)
    counts = np.bincount(place, minlength=len(terms)).astype(v.dtype)
    d_vectors = np.zeros((len(terms), v.shape[1]), v.dtype)
    np.add.at(d_vectors, place, slope[row, None] * (total[row] - v))
    return float(slope.sum()), terms, counts, np.bincount(place, slope[row], len(terms)), d_vectors


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> FactorizationMachine:
    """Fit by AdaGrad on small batches; both labels weigh the same in all."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.0
    fm = FactorizationMachine(0.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))
    if share in (0.0, 1.0):
        fm.bias = 30.0 if share else -30.0
        return fm
    seen = np.bincount(np.concatenate(texts), minlength=BUCKETS)
    hits = np.bincount(np.concatenate([t for t, y in zip(texts, labels) if y]), minlength=BUCKETS)
    deviation = np.abs(hits - share * seen) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    known = (seen >= LEAST_TEXTS) & (deviation >= LEAST_DEVIATION)
    known[pair_terms(texts, labels)] = True
    texts = [t[known[t]] for t in texts]
    fm.vectors[known] = rng.normal(0, 0.01, (int(known.sum()), FACTORS))
    g_weight, g_vectors = np.full(BUCKETS, 1e-6, np.float32), np.full((BUCKETS, FACTORS), 1e-6, np.float32)
    g_bias = 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            d_bias, terms, counts, d_weight, d_vectors = gradients(fm, [texts[i] for i in pick], labels[pick], (1 - share) / share)
            d_weight = d_weight + DECAY * counts * fm.weight[terms]
            d_vectors += DECAY * counts[:, None] * fm.vectors[terms]
            g_weight[terms] += d_weight**2
            g_vectors[terms] += d_vectors**2
            fm.weight[terms] -= RATE * d_weight / np.sqrt(g_weight[terms])
            fm.vectors[terms] -= RATE * d_vectors / np.sqrt(g_vectors[terms])
            g_bias += d_bias**2
            fm.bias -= RATE * d_bias / np.sqrt(g_bias)
    return fm


def fit(docs: DataFrame, labels: DataFrame, texts: int = SAMPLE_TEXTS) -> FactorizationMachine:
    """A machine for ``labels.toxic`` (columns doc_id, toxic) over ``docs`` (doc_id, text)."""
    marks = labels.select(column("doc_id").cast("long").alias("id"), column("toxic").cast("int").alias("y")).filter(learnable(F.col("id")) & F.col("y").isin(0, 1))
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    share = min(1.0, texts / max(marks.count(), 1))
    marks = marks.filter(F.pmod(F.xxhash64("id", F.lit("toxicity sample")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = Buckets()
        terms = [known.of(t.as_py()) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int32()))], ["id", "terms"])

    # The small side holds the sampled ids only; texts become sets of numbers before they move.
    source = docs.select(column("doc_id").cast("long").alias("id"), column("text").cast("string").alias("text"))
    sampled = source.filter(F.col("id").isNotNull()).join(F.broadcast(marks), "id", "left_semi")
    one = sampled.mapInArrow(per_batch(hashed), "id long, terms array<int>").groupBy("id").agg(F.min("terms").alias("terms"))
    rows = one.join(marks, "id").toArrow().sort_by("id")
    terms = [np.asarray(t.values, np.int64) if len(t.values) else np.zeros(0, np.int64) for t in rows.column("terms")]
    return train(terms, rows.column("y").to_numpy().astype(np.float32))


def score(docs: DataFrame, fm: FactorizationMachine) -> DataFrame:
    """``doc_id`` and ``score`` of every whole text."""
    source = docs.select(column("doc_id").cast("long").alias("doc_id"), column("text").cast("string").alias("text"))
    # Only known buckets travel with the tasks: a bounded number.
    known = np.flatnonzero(fm.weight.astype(bool) | fm.vectors.any(axis=1))
    sent = fm.bias, known, fm.weight[known], fm.vectors[known]
    made: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            bias, at, weight, vectors = sent
            whole = FactorizationMachine(bias, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))
            whole.weight[at], whole.vectors[at] = weight, vectors
            made.extend((whole, Buckets(whole.weight.astype(bool) | whole.vectors.any(axis=1))))
        whole, buckets = made
        scores = [whole.score(buckets.of(t.as_py())) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return source.mapInArrow(per_batch(run), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUTOFF, 1).otherwise(0).alias("predicted"))
