"""Language identification with a byte convolutional network (operator 4).

Texts are cut into windows of ``WINDOW`` bytes. A window's bytes are embedded,
filters of several widths slide over them, the strongest answer of each filter is
kept, and a softmax layer turns these into a probability per language. A text's
probabilities are the mean over all its windows, weighted by their bytes.

The network is trained in numpy on the driver, on a bounded sample of labelled texts
(``SAMPLE_TEXTS`` a language at most in expectation, chosen by a hash of the id, and
``SAMPLE_WINDOWS`` windows of each, spread over the whole text, and at most ``MOST_LANGUAGES``
languages). Prediction is map-only, over every window of every text.

Defined results: a null text or one without a letter is ``und`` with score 0; rows
without an id are predicted but not learned from; repeated rows give repeated rows;
an empty table gives an empty one, and without any labelled text all is ``und``.
Other columns are not read. Ties between languages go to the first in the alphabet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import column, held_out, learnable, per_batch, utf8

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 8  # of each width
EMBEDDING = 8
SAMPLE_TEXTS = 1_000
SAMPLE_WINDOWS = 2
# Languages that are learned at most, the most frequent ones.
MOST_LANGUAGES = 256
EPOCHS = 6
BATCH = 64
UNKNOWN = "und"


@dataclass
class ByteNet:
    """Weights: byte embedding, filters as one matrix over the widest span, softmax layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Language probabilities of byte windows (rows x WINDOW)."""
        return _forward(self, windows)[-1]


def _spans(embedded: np.ndarray) -> np.ndarray:
    """Every span of the widest width as one row: rows x positions x (width * embedding)."""
    n, length, size = embedded.shape
    wide = max(WIDTHS)
    padded = np.zeros((n, length + wide - 1, size), np.float32)
    padded[:, :length] = embedded
    step = padded.strides
    return np.lib.stride_tricks.as_strided(padded, (n, length, wide * size), (step[0], step[1], step[2]))


def _forward(net: ByteNet, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(windows)
    spans = _spans(net.embedding[windows]).reshape(n * windows.shape[1], -1)
    answers = (spans @ net.filters).reshape(n, windows.shape[1], -1)
    place = answers.argmax(axis=1) if net.out.flags.writeable else None
    top = answers.max(axis=1) + net.bias
    hidden = np.maximum(top, 0)
    scores = hidden @ net.out + net.out_bias
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    return spans, place, top, hidden, p / p.sum(axis=1, keepdims=True)


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text of each and its bytes; the last one of a text is filled with zeros."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][owner] + index * WINDOW
    weight = np.minimum(WINDOW, offsets[1:][owner] - start)
    place = start[:, None] + np.arange(WINDOW)
    windows = data[np.minimum(place, max(len(data) - 1, 0))] if len(data) else np.zeros(place.shape, np.uint8)
    windows[np.arange(WINDOW) >= weight[:, None]] = 0
    return windows, owner, weight


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 1) -> ByteNet:
    """Fit the network with Adam on windows and the numbers of their languages; every language weighs the same."""
    rng = np.random.default_rng(seed)
    wide, size, k = max(WIDTHS), EMBEDDING, len(languages)
    mask = np.zeros((wide, size, len(WIDTHS) * FILTERS), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
    mask = mask.reshape(wide * size, -1)
    net = ByteNet(
        languages,
        rng.normal(0, 0.3, (256, size)).astype(np.float32),
        rng.normal(0, 0.2, mask.shape).astype(np.float32) * mask,
        np.zeros(mask.shape[1], np.float32),
        rng.normal(0, 0.2, (mask.shape[1], k)).astype(np.float32),
        np.zeros(k, np.float32),
    )
    net.embedding[0] = 0
    share = len(labels) / (k * np.maximum(np.bincount(labels, minlength=k), 1))
    weights = [net.embedding, net.filters, net.bias, net.out, net.out_bias]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x, y = windows[pick], labels[pick]
            n = len(y)
            spans, place, top, hidden, p = _forward(net, x)
            d = p.copy()
            d[np.arange(n), y] -= 1
            d *= (share[y] / n)[:, None].astype(np.float32)
            g_out, g_out_bias = hidden.T @ d, d.sum(axis=0)
            g_top = (d @ net.out.T) * (top > 0)
            rows = (np.arange(n)[:, None] * x.shape[1] + place).ravel()
            chosen = spans[rows].reshape(n, -1, wide * size)  # the span each filter answered to most
            g_filters = np.einsum("nfc,nf->cf", chosen, g_top, optimize=True).astype(np.float32) * mask
            g_spans = (g_top[:, :, None] * net.filters.T[None]).reshape(-1, size)
            bytes_at = place[:, :, None] + np.arange(wide)
            inside = (bytes_at < x.shape[1]).ravel()
            byte = np.take_along_axis(x[:, None, :], np.minimum(bytes_at, x.shape[1] - 1), axis=2).ravel()
            g_embedding = np.zeros_like(net.embedding)
            np.add.at(g_embedding, byte[inside], g_spans[inside])
            g_embedding[0] = 0
            step += 1
            for w, (m, v), g in zip(weights, moments, (g_embedding, g_filters, g_top.sum(axis=0), g_out, g_out_bias)):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    for w in weights:
        w.flags.writeable = False
    return net


def sample_windows(docs: DataFrame, labels: Column, texts: int = SAMPLE_TEXTS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, label numbers and labels of the training sample; one row a language is counted first."""
    known = docs.select(labels.cast("string").alias("y"), column("doc_id").alias("id"), column("text").cast("string").alias("text"))
    known = known.filter(learnable(F.col("id")) & F.col("y").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("y").count().orderBy(F.desc("count"), "y").limit(MOST_LANGUAGES)
    # One row a language: the shares become part of the expression, so no text moves by language.
    share = {r["y"]: texts / r["count"] for r in counts.collect()}
    languages = sorted(share)
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("y")) if share else F.lit(0.0)
    chance = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 30)) / F.lit(1 << 30)
    at = [((F.octet_length("text") - WINDOW) * F.lit((2 * i + 1) / (2 * SAMPLE_WINDOWS))).cast("int") for i in range(SAMPLE_WINDOWS)]
    raw = F.encode("text", "UTF-8")
    cut = F.array(*[F.substring(raw, F.greatest(a, F.lit(0)) + 1, F.lit(WINDOW)) for a in at])
    picked = known.select("y", cut.alias("windows"), chance.alias("chance"), wanted.alias("wanted")).filter("chance < wanted")
    # Only repeated ids can bring more rows than this; those first by hash count.
    picked = picked.orderBy("chance", "y", "windows").limit(2 * texts * max(len(languages), 1)).select("y", "windows").toArrow()
    flat = np.zeros((SAMPLE_WINDOWS * picked.num_rows, WINDOW), np.uint8)
    y = np.zeros(len(flat), np.int64)
    number = {x: i for i, x in enumerate(languages)}
    for i, (label, own) in enumerate(zip(picked.column(0).to_pylist(), picked.column(1).to_pylist())):
        for j, window in enumerate(own):
            flat[SAMPLE_WINDOWS * i + j, : len(window)] = np.frombuffer(window, np.uint8)
            y[SAMPLE_WINDOWS * i + j] = number[label]
    # In a fixed order, so that the fit does not depend on the order of tasks; only equal windows are tied.
    order = np.array(sorted(range(len(y)), key=lambda i: (y[i], flat[i].tobytes())), np.int64)
    return flat[order], y[order], languages


def fit(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> ByteNet | None:
    """A network for the languages of ``docs`` (columns doc_id, text, lang), or None without labelled texts."""
    windows, labels, languages = sample_windows(docs, column("lang"), texts)
    return train(windows, labels, languages) if len(labels) else None


def predict(docs: DataFrame, net: ByteNet | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, then ``lang_pred`` and ``score`` of every whole text."""
    text = column("text").cast("string")
    # Kept columns travel under plain names: Arrow tasks can not take dots in them.
    source = docs.select(*[column(k).alias(f"kept_{i}") for i, k in enumerate(keep)], F.when(text.rlike(r"\p{L}"), text).alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", lang_pred string, score double"
    carried = source.columns[:-1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1)
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if net is not None:
            data, offsets = utf8(texts)
            total = np.zeros((len(texts), len(net.languages)))
            # A long text has many windows: texts are taken by bytes, windows by dozens.
            for low, high in _by_bytes(offsets, 1 << 18):
                windows, owner, weight = cut_windows(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                for at in range(0, len(windows), 64):
                    p = net.probabilities(windows[at : at + 64])
                    np.add.at(total, low + owner[at : at + 64], p * weight[at : at + 64, None])
            some = total.sum(axis=1) > 0
            best = total.argmax(axis=1)
            scores[some] = (total.max(axis=1)[some] / total.sum(axis=1)[some])
            names = [net.languages[b] if s else UNKNOWN for b, s in zip(best, some)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.minimum(scores, 1.0))], [*carried, "lang_pred", "score"])

    return source.mapInArrow(per_batch(run), schema).toDF(*keep, "lang_pred", "score")


def _by_bytes(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    out, low = [], 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        out.append((low, high))
        low = high
    return out


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row."""
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
