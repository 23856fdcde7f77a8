"""Substring dedup by content-defined chunks (operator 1).

A gear rolling hash over the bytes of a text marks chunk borders, so equal passages
fall into equal chunks wherever they stand and an insertion shifts only the chunks
around it. Chunks are deduplicated by digest: the text with the smallest id keeps
its first copy, every other copy is a duplicate. Neighbouring duplicate chunks form
one span, and spans of at least ``MIN_SPAN`` bytes are cut out of the text.

Plan: one Python pass cuts the chunks and settles repeats inside one text. Digests
are counted with a map-side part, so a passage that stands in a third of all texts is
one record per task; only digests found in several texts are joined back, an
inner join whose hot keys Spark splits. The texts move once, by id.

Defined results: a null text has no chunks and comes back null; a text keeps at
least its first copy of everything, so texts below ``MIN_CHUNK`` bytes only lose
whole equal texts of ``MIN_SPAN`` bytes and more; rows without an id come before all
ids; rows that repeat an id count as one document and get the same treatment, each
with its own text; an empty table gives an empty one; other columns are kept as
they are; one that has the name of an added column comes back with ``_`` behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import beside, column, utf8, whole_row
from tabscore.session import materialize

MIN_CHUNK = 32
MEAN_BITS = 5  # a border after each byte with chance 1 / 2**5, so about 64 bytes a chunk
MAX_CHUNK = 512
# A passage of 50 words has about 300 bytes and loses the chunks that its two ends cut; a shorter run is a phrase or a line.
MIN_SPAN = 80
ADDED = ("n_removed", "n_spans", "spans")
NO_ID = -(2**63)

# The gear table: one random 16-bit value a byte value, drawn from a fixed seed.
GEAR = np.random.default_rng(20240501).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sum of the last 16 gear values, each shifted by its age."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint16(step)
        h = h + shifted
    return h


def borders(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text, the last one its length. Borders lie between characters."""
    n = len(data)
    if n == 0:
        return []
    # The top bits hold the most history. A border moves on to the next start of a character.
    marked = np.flatnonzero(gear_hash(data) >> np.uint16(16 - MEAN_BITS) == 0) + 1
    ends, start = [], 0
    for end in marked.tolist():
        while end - start > MAX_CHUNK:
            start = _on_character(data, start + MAX_CHUNK, n)
            ends.append(start)
        if end - start >= MIN_CHUNK:
            start = _on_character(data, end, n)
            ends.append(start)
    while n - start > MAX_CHUNK:
        start = _on_character(data, start + MAX_CHUNK, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def _on_character(data: np.ndarray, at: int, n: int) -> int:
    while at < n and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            data, offsets = utf8(part.column(2))
            rows, digests, starts, sizes, again = [], [], [], [], []
            for i in range(part.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                raw, start, seen = own.tobytes(), 0, set()
                for end in borders(own):
                    digest = xxhash.xxh3_128_digest(raw[start:end])
                    rows.append(i)
                    digests.append(digest)
                    starts.append(start)
                    sizes.append(end - start)
                    again.append(digest in seen)
                    seen.add(digest)
                    start = end
            take = pa.array(rows, pa.int32())
            columns = [part.column(0).take(take), part.column(1).take(take), pa.array(digests, pa.binary()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(again, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "mark", "digest", "start", "size", "again"])


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All chunks: ``doc``, ``mark`` (a hash of the whole text), ``digest``, ``start``, ``size``, and whether the text had it before."""
    source = docs.select(_doc(doc_id).alias("doc"), _mark(text).alias("mark"), column(text).cast("string").alias("text")).filter("text is not null")
    return source.mapInArrow(_chunks, "doc long, mark long, digest binary, start int, size int, again boolean")


def _doc(name: str) -> Column:
    return F.coalesce(column(name).cast("long"), F.lit(NO_ID).cast("long"))


def _mark(name: str) -> Column:
    return F.xxhash64(column(name).cast("string"))


def duplicate_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``mark`` and ``spans``, sorted byte ranges [start, end) to cut; only texts that have any."""
    cut = materialize(chunks(docs, doc_id, text), "chunks")
    owners = cut.groupBy("digest").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner < last").select(F.col("digest").alias("key"), "owner")
    shared = cut.filter("not again").join(owners, F.col("digest") == F.col("key")).filter("doc > owner")
    twice = shared.select("doc", "mark", "start", "size").union(cut.filter("again").select("doc", "mark", "start", "size"))
    # At most the chunks of one text meet in a group; repeated rows add none.
    grouped = twice.groupBy("doc", "mark").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("found"))
    return grouped.select("doc", "mark", _joined(F.col("found")).alias("spans")).filter(F.size("spans") > 0)


def _joined(found: Column) -> Column:
    """Neighbouring chunks as one span each, without those that are too short."""
    at = F.transform(found, lambda c, i: F.struct(c["start"].alias("start"), (c["start"] + c["size"]).alias("end"), i.alias("i")))
    first = F.filter(at, lambda c: (c["i"] == 0) | (F.get(found, c["i"] - 1)["start"] + F.get(found, c["i"] - 1)["size"] < c["start"]))
    last = F.filter(at, lambda c: (c["i"] == F.size(found) - 1) | (F.get(found, c["i"] + 1)["start"] > c["end"]))
    spans = F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))
    return F.filter(spans, lambda s: s["end"] - s["start"] >= MIN_SPAN)


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with the duplicate spans cut out of ``text``.

    Adds ``n_removed`` (characters cut out), ``n_spans`` and ``spans`` (byte ranges
    of the text before, ``start-end`` joined by commas).
    """
    spans = duplicate_spans(docs, doc_id, text).select(F.col("doc").alias("of"), F.col("mark").alias("whose"), "spans")
    own = docs.select(whole_row(docs).alias("row"), _doc(doc_id).alias("doc"), _mark(text).alias("mark"))
    both = own.join(spans, (F.col("doc") == F.col("of")) & (F.col("mark") == F.col("whose")), "left")
    raw = F.col("row")[text].cast("string")
    binary = F.encode(raw, "UTF-8")
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["end"]))), F.array(F.octet_length(raw)))
    kept_parts = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.decode(F.substring(binary, F.get(edges, 2 * i) + 1, F.get(edges, 2 * i + 1) - F.get(edges, 2 * i)), "UTF-8"))
    after = F.when(F.col("spans").isNull(), raw).otherwise(F.array_join(kept_parts, ""))
    both = both.select("row", raw.alias("before"), after.alias("after"), "spans")
    named = F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ","), F.lit(""))
    return both.select(
        *[(F.col("after") if c == text else F.col("row")[c]).alias(beside(c, ADDED)) for c in docs.columns],
        F.coalesce(F.length("before") - F.length("after"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")), F.lit(0)).cast("long").alias("n_spans"),
        named.alias("spans"),
    )
