"""How far the sources of a language are apart in their words (operator 12).

A document's terms carry its language, so that one CountVectorizer, with a least
number of documents and no other bound on the vocabulary, keeps a vocabulary per
language in one pass. Its sparse document vectors are added up by (language, source,
term); only these sums go on.

A group's share of a term is ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))``. A term
that a group lacks has the group's constant share ``z``, so the distance of two
groups needs no dense vectors: with sums over present terms only,

    sum |p - q| = V |z - y| + sum_p (|p - y| - |z - y|) + sum_q (|q - z| - |z - y|)
                  + sum_both (|p - q| - |p - y| - |z - q| + |z - y|).

The one-sided sums come from the few different values of p in a group, the last one
from blocks of terms, each of bounded size, in which the groups that share a term meet.

The vocabulary passes the driver and each task, as CountVectorizer does it: a token is
at most ``TOKEN_BYTES`` long (a longer one is its digest), and tokens are cut into
slices by hash, of about ``SLICE_TOKENS`` different ones, each with its own vectorizer.

Defined results: null text, language and source are ''; repeated rows are documents of
their own; a group without terms has zero counts; a language without kept terms has
value 0 for every pair; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscore.llm.common import column, per_batch, utf8
from tabscore.session import local_table, materialize

LEAST_DOCS = 30
TOP_TERMS = 50
# Fixed values of the share: scale and added count.
SCALE, ADDED = 1_000_000_000, 5
TOKEN_BYTES = 96
SLICE_TOKENS = 2_000_000
# One text of so many tells how many slices there are.
SAMPLED = 16
# Rows (source, term) of one block of terms.
BLOCK_ROWS = 1 << 16
LARGEST = 2**31 - 1
# Bytes of terms: ASCII letters and all bytes of other characters; only A-Z are lowered.
LETTERS = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
LOWER_CASE = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
# A token that is a digest starts with this; a term holds neither character.
DIGEST = "\u0000#"


def batch_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a batch of texts in order, and the number of terms of each text."""
    data, offsets = utf8(texts)
    inside = LETTERS[data]
    # A term starts at a letter that opens its text or follows a separator.
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    opens = offsets[:-1][np.diff(offsets) > 0]
    starts[opens] = inside[opens]
    firsts = np.flatnonzero(starts)
    kept = np.cumsum(inside) - inside
    bounds = np.append(kept[firsts], inside.sum()).astype(np.int64)
    letters = LOWER_CASE[data[inside]]
    found = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(letters)))
    return found, np.diff(np.searchsorted(firsts, offsets))


def _tokens(langs: pa.Array, found: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms with their languages in front, and which of them are digests."""
    own = langs.cast(pa.large_string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
    raw = pc.binary_join_element_wise(own, found, pa.scalar("\u0000", pa.large_string()))
    long = pc.greater(pc.binary_length(raw), TOKEN_BYTES).to_numpy(zero_copy_only=False)
    if long.any():
        digests = [DIGEST + hashlib.sha256(t.encode()).hexdigest() for t in raw.filter(pa.array(long)).to_pylist()]
        raw = pc.replace_with_mask(raw, pa.array(long), pa.array(digests, pa.large_string()))
    return raw, long


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(column(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], column("text").cast("string").alias("text"))


def tokens(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``tokens`` of every document; the last token is the empty string, which keeps a vocabulary from being empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, sizes = batch_terms(batch.column(2))
        raw, _ = _tokens(batch.column(0), found, sizes)
        ends = np.cumsum(sizes)
        places = np.insert(np.arange(len(raw)), ends, len(raw))
        every = pa.concat_arrays([raw, pa.array([""], pa.large_string())]).take(pa.array(places))
        offsets = np.concatenate([[0], ends + np.arange(1, len(sizes) + 1)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), every.cast(pa.string()))], ["lang", "source", "tokens"])

    return _named(docs).mapInArrow(per_batch(run), "lang string, source string, tokens array<string>")


def long_terms(docs: DataFrame) -> DataFrame:
    """``token`` and ``term`` for the digests."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, sizes = batch_terms(batch.column(2))
        raw, long = _tokens(batch.column(0), found, sizes)
        return pa.RecordBatch.from_arrays([c.filter(pa.array(long)).cast(pa.string()) for c in (raw, found)], ["token", "term"])

    return _named(docs).mapInArrow(per_batch(run), "token string, term string").distinct()


def _sums(part: DataFrame, least: int) -> DataFrame:
    """``lang``, ``source``, ``token``, ``n`` over one slice: vectors by CountVectorizer, added up by group."""
    model = CountVectorizer(inputCol="tokens", outputCol="counts", minDF=float(least), vocabSize=LARGEST).fit(part)
    vocabulary = pa.table({"index": pa.array(np.arange(len(model.vocabulary), dtype=np.int32)), "token": pa.array(model.vocabulary, pa.string())})
    vector = F.unwrap_udt("counts")
    entries = model.transform(part).select("lang", "source", F.explode(F.arrays_zip(vector["indices"].alias("index"), vector["values"].alias("value"))).alias("e"))
    sums = entries.groupBy("lang", "source", F.col("e.index").alias("index")).agg(F.sum(F.col("e.value").cast("long")).alias("n"))
    return sums.join(local_table(part.sparkSession, vocabulary).filter("token <> ''"), "index").select("lang", "source", "token", "n")


def group_counts(docs: DataFrame, least: int = LEAST_DOCS, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``: occurrences of the kept terms in the groups that have them."""
    spark, marked = docs.sparkSession, tokens(docs)
    if docs.select(F.lit(1)).limit(least).count() < least:
        return spark.createDataFrame([], "lang string, source string, term string, n long")
    # A kept token is in ``least`` texts, so it is in the sample with at least this chance; rare tokens make the count too high, never too low.
    sampled = tokens(docs.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SAMPLED)) == 0))
    distinct = sampled.select(F.explode("tokens").alias("t")).agg(F.approx_count_distinct("t")).first()[0]
    slices = max(1, math.ceil(distinct / (1 - (1 - 1 / SAMPLED) ** least) / slice_tokens))
    if slices == 1:
        summed = _sums(marked, least)
    else:
        # Every token is written once, beside the others of its slice; a vectorizer reads its slice alone.
        own = F.filter("tokens", lambda t: (t == "") | (F.pmod(F.xxhash64(t), F.lit(slices)) == F.col("slice")))
        cut = marked.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")).select("lang", "source", "slice", own.alias("tokens"))
        cut = materialize(cut, "tokens", "slice")
        summed = None
        for i in range(slices):
            one = materialize(_sums(cut.filter(F.col("slice") == i), least), "term-sums")
            summed = one if summed is None else summed.unionByName(one)
    summed = materialize(summed, "term-sums")
    long = F.startswith("token", F.lit(DIGEST)) & (F.octet_length("token") == len(DIGEST) + 64)
    plain = summed.filter(~long).select("lang", "source", F.substring_index("token", "\u0000", -1).alias("term"), "n")
    if summed.filter(long).isEmpty():
        return plain
    # Texts are looked through again for what the digests stand for.
    return plain.unionByName(summed.filter(long).join(long_terms(docs), "token").select("lang", "source", "term", "n"))


def share(n: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 V)), exactly."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + ADDED).cast("decimal(20,0)")
    below = (total + ADDED * vocabulary).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """The last sum of the identity over one block: rows (source, term, p, z) of one language."""
    frame = frame.sort_values(["term", "source"])
    source, names = pd.factorize(frame["source"], sort=True)
    p, z = frame["p"].to_numpy(np.int64), frame["z"].to_numpy(np.int64)
    term = pd.factorize(frame["term"])[0]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    ends = np.r_[starts[1:], len(term)]
    constant = np.zeros(len(names), np.int64)
    constant[source] = z
    out = []
    for a in range(len(names)):
        rows = np.flatnonzero(source == a)
        low, size = starts[term[rows]], (ends - starts)[term[rows]]
        partner = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        mine, za, zb = np.repeat(p[rows], size), constant[a], z[partner]
        extra = np.abs(mine - p[partner]) - np.abs(mine - zb) - np.abs(za - p[partner]) + np.abs(za - zb)
        # A block's sums stay far below 2^53, so the weights are exact.
        value = np.bincount(source[partner], extra, len(names)).astype(np.int64)
        met = np.flatnonzero((np.bincount(source[partner], minlength=len(names)) > 0) & (np.arange(len(names)) != a))
        out.append(pd.DataFrame({"lang": frame["lang"].iloc[0], "source": names[a], "item": names[met], "value": value[met]}))
    return pd.concat(out)


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, slice_tokens: int = SLICE_TOKENS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair`` has the distance to each other source of the language, part ``term`` the
    ``top`` terms that a group uses more than its language does.
    """
    counts = group_counts(docs, least, slice_tokens)
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    langs = whole.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _named(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all_total", F.lit(0)).alias("all_total"))
    groups = materialize(groups.withColumn("z", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))), "groups")
    rows = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    rows = materialize(rows.join(whole, ["lang", "term"]).withColumn("q", share(F.col("all_n"), F.col("all_total"), F.col("v"))).select("lang", "source", "term", "p", "q", "z"), "shares")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    words = rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    words = words.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    apart = F.abs(F.col("z") - F.col("y"))
    both = groups.join(other, "lang").filter("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * apart, F.lit(0)).alias("value"))
    # A group has few different shares: its counts are small numbers.
    values = rows.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("n"))
    sides = values.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (F.abs(F.col("p") - F.col("y")) - apart)).alias("value"))
    blocks = max(1, math.ceil(rows.count() / block_rows))
    placed = rows.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "source", "term", "p", "z")
    shared = placed.groupBy("lang", "block").applyInPandas(_shared, "lang string, source string, item string, value long")
    back = sides.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = both.unionByName(sides).unionByName(back).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    return pairs.withColumn("part", F.lit("pair")).unionByName(words.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
