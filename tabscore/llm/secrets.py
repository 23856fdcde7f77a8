"""Secret scans with an incremental blob ledger (operator 5).

Every version of every path is addressed by the SHA-256 of its text. A (blob, rule
version) pair is scanned once: pairs in the ledger are left out, equal texts share
one scan, and the findings join back to all paths that hold the blob. Only column
expressions are used: the text between matches and the matches themselves give the
places of the spans.

Spans are code points, end exclusive. Base kinds are ``assign``, ``access`` and
``hex``; the ledger also holds rules for signed web tokens (``jwt``) and private key
headers (``pem``). ``redact`` masks whole private keys (version 2 of ``pem``).

Defined results: a null text is empty and has no spans; a null id is a path like any
other; repeated rows and equal texts share a scan and each get its spans; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import column, whole_row
from tabscore.session import materialize

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

# A private key from BEGIN to END; without END to the end of its base64, header lines of the key included. Lines may
# be parted by a written \n. Possessive parts keep long texts off the stack and the search linear.
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\s*+[A-Za-z]++-[A-Za-z]++:[^\r\n]*+)*+"
    r"(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+=*+|[ \t]*+(?:(?:[\r\n]|\\[nr])[ \t]*+)++[A-Za-z0-9+/]++=*+(?=[ \t]*+(?:[\r\n]|\\[nr]|$)))++|)"
)

# kind, version, pattern; the order is the order of kinds. A run too short to count can not hide a longer
# one for access and hex, so there the length is part of the pattern.
RULES = (
    ("assign", 1, ASSIGN),
    ("access", 1, r"AKIA[A-Z0-9]{16,}"),
    ("hex", 1, r"[0-9a-f]{24,}"),
    ("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
# What is masked: the whole key, not its first line.
MASKED = RULES[:-1] + (("pem", 2, PEM),)
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6
SPANS = "array<struct<start:int,kind:int,end:int>>"
MASK = "[SECRET]"


def rule_name(kind: str, version: int) -> str:
    return f"{kind}@{version}"


def _spans(text: Column, kind: int, pattern: str) -> Column:
    """Spans of all matches of one rule, leftmost and not overlapping."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(F.transform(between, F.length), F.transform(hits, F.length), lambda a, b: F.struct(a.alias("before"), b.alias("size")))
    if kind == 0:
        values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), F.length)
        sizes = F.zip_with(sizes, values, lambda s, v: F.struct(s["before"].alias("before"), s["size"].alias("size"), (v >= LEAST_VALUE).alias("counts")))
    else:
        sizes = F.transform(sizes, lambda s: F.struct(s["before"].alias("before"), s["size"].alias("size"), F.lit(True).alias("counts")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def step(state: Column, s: Column) -> Column:
        low = state["at"] + s["before"]
        high = low + F.coalesce(s["size"], F.lit(0))
        span = F.struct(low.alias("start"), F.lit(kind).alias("kind"), high.alias("end"))
        found = F.when(s["size"].isNotNull() & F.coalesce(s["counts"], F.lit(False)), F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(high.alias("at"), found.alias("found"))

    located = F.aggregate(sizes, start, step, lambda state: state["found"])
    return F.when(text.rlike(pattern), located).otherwise(F.array().cast(SPANS))


def scan_blobs(blobs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Findings ``blob``, ``rule``, ``spans`` of each rule named in ``rules`` of a row (columns blob, text, rules)."""
    text = F.col("text")
    done = [F.when(F.array_contains("rules", rule_name(k, v)), F.struct(F.lit(rule_name(k, v)).alias("rule"), _spans(text, i, p).alias("spans"))) for i, (k, v, p) in enumerate(rules)]
    return blobs.select("blob", F.explode(F.filter(F.array(*done), lambda f: f.isNotNull())).alias("f")).select("blob", "f.rule", "f.spans")


def address(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (null as empty) and ``blob`` of every row."""
    whole = F.coalesce(column(text).cast("string"), F.lit(""))
    return docs.select(column(doc_id).cast("long").alias("doc_id"), whole.alias("text"), F.sha2(whole, 256).alias("blob"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """The ledger (``blob``, ``rule``, ``spans``) with all unseen blob and rule-version pairs of ``versions`` scanned."""
    names = F.array(*[F.lit(rule_name(k, v)) for k, v, _ in rules])
    path = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    # One path stands for each blob: the smallest id. Found without moving a text.
    owners = versions.groupBy("blob").agg(F.min(path).alias("owner"))
    if ledger is not None:
        pairs = owners.select("blob", "owner", F.explode(names).alias("rule"))
        unseen = pairs.join(ledger.select("blob", "rule").distinct(), ["blob", "rule"], "left_anti")
        owners = unseen.groupBy("blob", "owner").agg(F.collect_set("rule").alias("rules"))
    else:
        owners = owners.withColumn("rules", names)
    owners = owners.select(F.col("blob").alias("of"), "owner", "rules")
    texts = versions.select("blob", "text", path.alias("path")).join(owners, (F.col("path") == F.col("owner")) & (F.col("blob") == F.col("of")))
    # Repeated rows of one path would be scanned again; they are few unless a row itself repeats, and count once below.
    fresh = scan_blobs(texts.select("blob", "text", "rules"), rules).distinct()
    return materialize(fresh if ledger is None else ledger.select("blob", "rule", "spans").union(fresh), "secret-ledger")


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", rules: tuple = RULES) -> DataFrame:
    """``doc_id``, ``blob`` and sorted ``found`` spans of every row, by the ledger."""
    versions = address(docs, doc_id, text)
    now = update_ledger(versions, ledger, rules)
    wanted = [rule_name(k, v) for k, v, _ in rules]
    # A blob has as many ledger rows as rules.
    known = now.filter(F.col("rule").isin(wanted) & (F.size("spans") > 0)).groupBy(F.col("blob").alias("of")).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    paths = versions.select("doc_id", "blob").join(known, F.col("blob") == F.col("of"), "left")
    return paths.select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("found"))


def _named(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k, _, _ in RULES])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Counts, digest of the base spans and all spans of every row."""
    found = find_secrets(docs, ledger)
    count = [_count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *count, F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("found")).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, each stretch of overlapping spans replaced by ``MASK``."""
    found = find_secrets(docs, None, doc_id, text, MASKED).filter(F.size("found") > 0)
    marks = found.select(F.col("blob").alias("of"), "found").distinct()
    own = docs.select(whole_row(docs).alias("row"), F.sha2(F.coalesce(column(text).cast("string"), F.lit("")), 256).alias("blob"))
    both = own.join(marks, F.col("blob") == F.col("of"), "left")
    raw = F.col("row")[text].cast("string")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(raw, state["at"] + 1, s["start"] - state["at"])
        made = F.when(fresh, F.concat(state["made"], gap, F.lit(MASK))).otherwise(state["made"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), made.alias("made"))

    masked = F.aggregate("found", begin, step, lambda state: F.concat(state["made"], F.substring(raw, state["at"] + 1, F.length(raw))))
    both = both.select("row", F.when(F.col("found").isNull(), raw).otherwise(masked).alias("masked"))
    return both.select(*[(F.col("masked") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
