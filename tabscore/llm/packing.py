"""Packing along a space-filling curve (operator 10).

Each document's hashed n-gram vector is projected to a few dimensions, and its cell
on a Hilbert curve becomes its sort key. A range sort by (key, id) puts similar
documents next to each other; each range then joins its documents end to end and
cuts the stream at every ``length`` ids. Only the last sequence of a range can be
short, so padding does not grow with the documents, and equal keys (copies) are
split by id. Texts move once; tokens are made after the move, in the task that packs
them. Sequence numbers start at the range's number times 2**40.

Defined results: a null or empty text is one end-of-text id; repeated rows are
packed each on its own; a null id sorts first; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import column, utf8

LENGTH = 2048
END_ID = 1
DIMENSIONS, BITS = 3, 10
BUCKETS = 1024
# Half-width of the cube that the projected unit vectors are cut to, per dimension.
REACH = 3.0
SEED = 20240502
# Words and their characters remembered per Python worker; longer words are not remembered.
WORDS_KEPT = 300_000
WORD_CHARS = 64
CHARS_KEPT = 4_000_000


def hashed_vectors(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Unit vectors of hashed 4-byte-gram counts, one a text; a text below 4 bytes has the zero vector."""
    n = len(offsets) - 1
    out = np.zeros((n, buckets), np.float32)
    if len(data) < 4:
        return out
    grams = data[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        grams |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    place = ((grams * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)
    for i in range(n):
        low, high = offsets[i], offsets[i + 1] - 3
        if high > low:
            counts = np.bincount(place[low:high], minlength=buckets)
            out[i] = counts / np.sqrt(np.dot(counts.astype(np.float64), counts))
    return out


def projection(buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((buckets, dimensions)).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of integer cells (rows x dimensions, each below 2**bits) along the Hilbert curve.

    From the axes to the transposed index and then its bits interleaved, all rows at once.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(texts: pa.Array) -> np.ndarray:
    """Hilbert keys of a batch of texts, a bounded number of vectors at a time."""
    plane, out = projection(), []
    for at in range(0, len(texts), 256):
        flat = hashed_vectors(*utf8(texts.slice(at, 256))) @ plane
        cells = np.clip((flat + REACH) * ((1 << BITS) / (2 * REACH)), 0, (1 << BITS) - 1).astype(np.int64)
        out.append(hilbert_key(cells))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Words(dict):
    """Token ids (little-endian 32-bit) by blank-bounded word, the bounded memory of one Python worker.

    The ranks file holds the vocabulary of the byte-level tokenizer of the same name.
    Texts are cut at the strings of ``added``, each one id; without it they are ordinary text.
    """

    def __init__(self, ranks_file: str, pattern: str, added: dict[str, int] | None = None):
        super().__init__()
        self.chars = 0
        self.added = added or {}
        # Of several at one place the longest counts.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("documents", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.whole(word)
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS_KEPT or self.chars >= CHARS_KEPT:
                self.clear()
                self.chars = 0
            self[word] = ids
            self.chars += len(word)
        return ids

    def text(self, text: str) -> bytes:
        """All ids of a text, the added tokens in it included."""
        if self.cut is None:
            return self.part(text)
        parts = self.cut.split(text)
        # Every second part is an added token.
        return b"".join([array("I", [self.added[p]]).tobytes() if i % 2 else self.part(p) if p else b"" for i, p in enumerate(parts)])

    def part(self, text: str) -> bytes:
        """All ids of ordinary text; a single blank between other characters always starts a new word."""
        words = text.split(" ")
        out, held = [], words[0]
        for word in words[1:]:
            # A blank next to another white space belongs to the run and does not part words.
            if word and held and not word[0].isspace() and not held[-1].isspace():
                out.append(held)
                held = " " + word
            else:
                held += " " + word
        out.append(held)
        return b"".join([self[w] for w in out])


_words: dict[tuple, Words] = {}


def words(ranks_file: str, pattern: str, added: dict[str, int] | None = None) -> Words:
    key = ranks_file, pattern, tuple(sorted((added or {}).items()))
    if key not in _words:
        _words[key] = Words(ranks_file, pattern, added)
    return _words[key]


def added_tokens(tokenizer_file: str) -> dict[str, int]:
    """Id by string of the added tokens that the tokenizer of a JSON file matches inside a text."""
    with open(tokenizer_file, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    for t in tokens:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"added token {t['content']!r} is not matched as it stands")
    return {t["content"]: t["id"] for t in tokens}


def pack(docs: DataFrame, ranks_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` ids, neighbours along the curve together.

    ``added`` has the id of each string that is one token wherever it stands (``added_tokens``).

    Returns ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``; with ``ids`` also the ids of each piece.
    """

    @F.arrow_udf("long")
    def key(texts: pa.Array) -> pa.Array:
        return pa.array(curve_keys(texts))

    source = docs.select(column(doc_id).cast("long").alias("doc_id"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    ranged = source.withColumn("key", key("text")).repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "text")
    end = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * ids
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(ranks_file, pattern, added)
        sequence, offset = TaskContext.get().partitionId() << 40, 0
        last, last_ids = None, end
        for batch in batches:
            rows: list[tuple] = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py()
                if value != last:  # copies stand next to each other
                    last, last_ids = value, known.text(value) + end if value else end
                n, start = len(last_ids) // 4, 0
                while start < n:
                    size = min(n - start, length - offset)
                    piece = last_ids[4 * start : 4 * (start + size)]
                    rows.append((doc, start, size, zlib.crc32(piece), n, sequence, offset) + (piece,) * ids)
                    start, offset = start + size, offset + size
                    if offset == length:
                        sequence, offset = sequence + 1, 0
            kinds = [pa.int64()] * 7 + [pa.binary()] * ids
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names)

    return ranged.mapInArrow(run, schema)
