"""Registered queries of the text operators, each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.llm.chat import format_chats
from tabscore.llm.common import reach
from tabscore.llm.divergence import ADDED, LEAST_DOCS, SCALE, TOP_TERMS, divergence
from tabscore.llm.jaccard import jaccard_components
from tabscore.llm.language import identify
from tabscore.llm.negatives import hard_negatives
from tabscore.llm.neighbours import nearest
from tabscore.llm.packing import added_tokens, pack
from tabscore.llm.pieces import encode_texts
from tabscore.llm.quality import DOUBT, LEAST_WORDS, RISK, SIGNALS, quality
from tabscore.llm.secrets import secrets
from tabscore.llm.simhash import near_duplicates
from tabscore.llm.substrings import dedup_substrings
from tabscore.llm.toxicity import toxicity
from tabscore.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(reach(spark), folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_substring_dedup")
def op1(t: Tables) -> DataFrame:
    return dedup_substrings(t.documents.select("doc_id", "text"))


@query("op2_simhash")
def op2(t: Tables) -> DataFrame:
    return near_duplicates(t.documents)


@query("op8_sentencepiece")
def op8(t: Tables) -> DataFrame:
    return encode_texts(t.documents, public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_packing")
def op10(t: Tables) -> DataFrame:
    return pack(t.documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


@query("op4_language")
def op4(t: Tables) -> DataFrame:
    return identify(t.documents)


@query("op7_toxicity")
def op7(t: Tables) -> DataFrame:
    return toxicity(t.documents, t.labels)


@query("op9_prefix_forest")
def op9(t: Tables) -> DataFrame:
    return nearest(t.embeddings)


SECRETS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, t, 'assign' AS kind, 0 AS n, string_split_regex(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS parts,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS hits,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS vals FROM d
  UNION ALL SELECT doc_id, t, 'access', 1, string_split_regex(t, 'AKIA[A-Z0-9]{16,}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}'), NULL FROM d
  UNION ALL SELECT doc_id, t, 'hex', 2, string_split_regex(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}'), NULL FROM d
  UNION ALL SELECT doc_id, t, 'jwt', 3, string_split_regex(t, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'), regexp_extract_all(t, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'), NULL FROM d
  UNION ALL SELECT doc_id, t, 'pem', 4, string_split_regex(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), NULL FROM d),
e AS (SELECT doc_id, kind, n, unnest(range(1, len(hits) + 1)) AS i, parts, hits, vals FROM m WHERE len(hits) > 0),
s AS (
  SELECT doc_id, kind, n, length(hits[i]) AS size, vals[i] AS val,
    sum(length(parts[i])) OVER w + sum(length(hits[i])) OVER w - length(hits[i]) AS start
  FROM e WINDOW w AS (PARTITION BY doc_id, n ORDER BY i)),
k AS (SELECT doc_id, kind, n, start::BIGINT AS a, (start + size)::BIGINT AS b FROM s
  WHERE (n = 0 AND length(val) >= 6) OR (n = 1 AND size >= 20) OR (n = 2 AND size >= 24) OR n > 2),
g AS (SELECT doc_id, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, n) FILTER (n < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, n) AS spans
  FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


@query("op5_secrets", SECRETS_SQL)
def op5(t: Tables) -> DataFrame:
    return secrets(t.documents)


_GRID = ", ".join(f"('{s}', {i}, {c!r}::DOUBLE)" for s, grid in SIGNALS.items() for i, c in enumerate(grid))

QUALITY_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols
  FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(3, after - i)) AS n FROM (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 3) AS after FROM r) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, stratum, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols / greatest(word_chars, 1) AS symbol_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
    n_repeat_words / greatest(n_words, 1) AS repeat_share, word_chars / greatest(n_words, 1) AS long_words, -word_chars / greatest(n_words, 1) AS short_words
  FROM c),
u AS (UNPIVOT (SELECT doc_id, stratum, base_failed, symbol_share, dup_line_share, repeat_share, long_words, short_words FROM f)
  ON symbol_share, dup_line_share, repeat_share, long_words, short_words INTO NAME signal VALUE v),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
grid(signal, i, c) AS (VALUES {_GRID}),
k AS (
  SELECT stratum, u.signal, i, c, count(*) AS n, count(*) FILTER (v > c) AS k
  FROM u JOIN good ON u.doc_id = good.doc_id JOIN grid ON u.signal = grid.signal WHERE NOT base_failed GROUP BY ALL),
p AS (SELECT {RISK}::DOUBLE / {len(SIGNALS)} AS p, {DOUBT}::DOUBLE / (SELECT count(*) FROM k) AS doubt),
tails AS (
  SELECT stratum, signal, i, c, n, k, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p.p) + (n - j) * ln(1 - p.p))) FROM range(0, k + 1) AS x(j)) AS tail
  FROM k, p WHERE k <= n * p.p),
cut AS (SELECT stratum, signal, arg_min(c, i) AS c FROM tails, p WHERE tail <= p.doubt GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM u JOIN cut ON u.stratum = cut.stratum AND u.signal = cut.signal WHERE v > cut.c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f
"""


@query("op6_quality", QUALITY_SQL)
def op6(t: Tables) -> DataFrame:
    return quality(t.documents, t.labels)


CHAT_SQL = r"""
WITH u AS (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, min(text) AS text FROM u GROUP BY ALL),
r AS (SELECT conv_id, turn - 1 AS turn, text AS result, sum(count(*)) OVER (PARTITION BY conv_id, turn) AS n_results
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, conversations.turn, text),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level
  FROM (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM c)),
b AS (SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.turn, r.turn) AS turn, l.conv_id IS NOT NULL AS called, r.conv_id IS NOT NULL AS answered, text, level, n_results, result
  FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.turn = r.turn),
a AS (
  SELECT conv_id, turn, CASE WHEN called THEN 'call' ELSE 'result' END AS kind, called, answered, text, level, n_results, result FROM b
  UNION ALL
  SELECT u.conv_id, u.turn, 'repeat', true, false, u.text, NULL, 0, NULL FROM u JOIN c ON u.conv_id = c.conv_id AND u.turn = c.turn AND u.text IS DISTINCT FROM c.text)
SELECT conv_id, conv_id || ':' || turn AS call_id, kind, CASE WHEN called THEN 'reply' END AS name, coalesce(level, -1)::BIGINT AS level, coalesce(n_results, 0)::BIGINT AS n_results,
  CASE WHEN answered THEN turn + 1 ELSE -1 END::BIGINT AS turn, called AND answered AS linked, called AND text IS NOT NULL AS valid,
  CASE WHEN called THEN '{"arguments":{"text":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || turn || '}' ELSE '{"arguments":null' END
    || ',"id":"' || conv_id || ':' || turn || '","name":' || CASE WHEN called THEN '"reply"' ELSE 'null' END || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || '}' AS call_json
FROM a
UNION ALL
SELECT DISTINCT conv_id, NULL, 'message', NULL, -1, 0, coalesce(turn, -1)::BIGINT, false, false,
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"turn":' || coalesce(turn::VARCHAR, 'null') || '}'
FROM conversations WHERE conv_id IS NULL OR turn IS NULL OR role IS NULL OR role NOT IN ('user', 'assistant')
"""


@query("op3_chat", CHAT_SQL)
def op3(t: Tables) -> DataFrame:
    """Without a level or turn: -1."""
    out = format_chats(t.conversations)
    return out.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("level", "turn")})


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, r.label = a.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT pos.anchor_id, pos.id AS positive_id, row_number() OVER (PARTITION BY pos.anchor_id, pos.id ORDER BY n.score DESC, n.id)::INT AS rank,
  n.id AS negative_id, pos.score AS positive_score, n.score AS negative_score
FROM pos JOIN p n ON n.anchor_id = pos.anchor_id AND NOT n.same AND 80 * pos.score <= 100 * n.score AND 100 * n.score <= 100 * pos.score
QUALIFY row_number() OVER (PARTITION BY pos.anchor_id, pos.id ORDER BY n.score DESC, n.id) <= 5
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11(t: Tables) -> DataFrame:
    return hard_negatives(t.embeddings)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DIVERGENCE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN kept ON t.lang = kept.lang AND t.term = kept.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n
  FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n, 1 + ({SCALE}::HUGEINT * (n + {ADDED})) // (sum(n) OVER w + {ADDED} * count(*) OVER w) AS p,
    1 + ({SCALE}::HUGEINT * (all_n + {ADDED})) // (sum(all_n) OVER w + {ADDED} * count(*) OVER w) AS q
  FROM grid WINDOW w AS (PARTITION BY lang, source)),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM kept)
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM f QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {TOP_TERMS}
"""


@query("op12_divergence", DIVERGENCE_SQL)
def op12(t: Tables) -> DataFrame:
    return divergence(t.documents)


JACCARD_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM d),
n AS MATERIALIZED (SELECT r, doc_id, len(sh) AS n FROM s),
t AS MATERIALIZED (SELECT r, unnest(sh) AS g FROM s),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT r, r FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM n JOIN reach ON reach.a = n.r JOIN n o ON o.r = reach.b GROUP BY n.r, n.doc_id, n.n
"""


@query("op13_jaccard_join", JACCARD_SQL)
def op13(t: Tables) -> DataFrame:
    return jaccard_components(t.documents)
