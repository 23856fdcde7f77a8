"""Source divergence, hard negatives and the shingle join: against plain Python, with small bounds so that every path is taken."""

import math
import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from awkward import documents, no_documents, rows  # noqa: E402

from tabscore.llm import divergence, jaccard, negatives  # noqa: E402
from tabscore.llm.common import reach  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string"


def frame(spark, body):
    return reach(spark).createDataFrame(body, DOCS)


# ---- source divergence --------------------------------------------------------


def plain_divergence(body, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in body]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
    share = {}
    for (lang, source), c in counts.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        total = sum(c[t] for t in kept)
        share[lang, source] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
    out = set()
    groups = {(lang, source) for lang, source, _ in docs}
    for lang, source in groups:
        p, q = share[lang, source], share[lang, None]
        pairs = [(sum(abs(p[t] - share[lang, o][t]) for t in p), o) for la, o in groups if la == lang and o != source]
        words = [(p[t] - q[t], t) for t in p if counts[lang, source][t] > 0 and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", words, top)):
            for i, (value, item) in enumerate(sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most]):
                out.add((lang, source, part, item, value, i + 1))
    return out


def some_documents(n=240):
    rnd = random.Random(5)
    words = ["alpha", "BETA", "gämma", "ÄRGER", "中文", "x", "y", "it's", "a_b", "z" * 150, "ü" * 60, "end\x00of", "🙂", "tail2tail"]
    body = [(i, " ".join(rnd.choices(words, [rnd.random() ** 2 for _ in words], k=rnd.randrange(30))), rnd.choice(["en", "de", None, "long" * 40]), rnd.choice(["s1", "s2", "s3", None, ""])) for i in range(n)]
    return body + [(None, None, "en", "silent"), (1, "alpha", "xx", "alone"), (2, None, "yy", "s"), (2, None, "yy", "t"), *body[:20]]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_against_plain_sums(spark, small):
    body = some_documents()
    bounds = {"slice_tokens": 6, "block_rows": 4} if small else {}
    got = divergence.divergence(frame(spark, body), least=4, top=3, **bounds).collect()
    assert {tuple(r) for r in got} == plain_divergence(body, 4, 3) and len(got) == len(plain_divergence(body, 4, 3))


def test_divergence_of_awkward_rows(spark):
    body = [(i, t, lang, "src") for i, t, lang in [(r[0], r[1], r[2]) for r in rows()]]
    for least in (1, 2, 30):
        got = divergence.divergence(documents(reach(spark)), least=least).collect()
        assert {tuple(r) for r in got} == plain_divergence(body, least, 50)
    assert divergence.divergence(no_documents(spark)).count() == 0


# ---- hard negatives -----------------------------------------------------------


def plain_negatives(body, every=100, most=5):
    sizes = Counter()
    table = []
    for i, v, label in {(i, None if v is None else tuple(v), label) for i, v, label in body}:
        if i is None or label is None or not v or any(e is None or not math.isfinite(e) for e in v):
            continue
        table.append((i, tuple(math.floor(256 * e) for e in v), math.fmod(label + 1, 10) if i % 7 == 0 else label))
    for _, v, _ in {(t[0], t[1], t[2]): t for t in table}.values():
        sizes[len(v)] += 1
    size = min(sizes, key=lambda s: (-sizes[s], s)) if sizes else 0
    table = [t for t in table if len(t[1]) == size]
    out = []
    for a, q, label in table:
        if a % every:
            continue
        score = [(-sum(x * y for x, y in zip(q, v)), i, v, la) for i, v, la in table]
        others = sorted(s for s in score if (s[1], s[2], s[3]) != (a, q, label))
        for minus, p, _, _ in [s for s in others if s[3] == label][:most]:
            fit = [s for s in others if s[3] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus][:most]
            out += [(a, p, rank + 1, s[1], -minus, -s[0]) for rank, s in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, key string, entry long, x string"


def vectors(spark, body):
    return reach(spark).createDataFrame([(i, v, label, "k", 1, "x") for i, v, label in body], VECTORS)


@pytest.mark.parametrize("cell_rows", [40, 100_000])
def test_negatives_against_plain_products(spark, cell_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    x = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6)) * 0.15).astype(np.float32) / 3
    body = [(i * 5, v.tolist(), int(la)) for i, (v, la) in enumerate(zip(x, rng.integers(0, 3, 900)))]
    body += [(4_500 + 10 * i, body[7][1], 1 + i % 2) for i in range(60)]
    got = sorted(map(tuple, negatives.hard_negatives(vectors(spark, body), cell_rows=cell_rows).collect()))
    assert got and got == plain_negatives(body)


def test_negatives_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    body = [(i, [float(i % 4) / 4, 0.5, -0.25], i % 3) for i in range(0, 60)]
    body += [(100, None, 1), (200, [0.1, None, 0.2], 1), (300, [nan, 1.0, 1.0], 1), (400, [1.0, inf, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (500, [1.0, 1.0, 1.0], None)]
    body += [(600, [0.0, 0.0, 0.0], 2), (700, [-0.001, 0.0, -0.0], 2), (800, [0.5, 0.5, 0.5], 9), (800, [0.5, 0.5, 0.5], 9), (900, [1.0, 1.0], 1), (1000, [], 1), (1100, [-0.5, -0.5, 0.1], 0), (1200, [0.3, 0.3, 0.3], -1)]
    got = sorted(map(tuple, negatives.hard_negatives(vectors(spark, body), cell_rows=8).collect()))
    assert got == plain_negatives(body)
    df = vectors(spark, body)
    assert negatives.hard_negatives(df.limit(0)).count() == 0 and negatives.hard_negatives(df.filter("vec_id < 60 and vec_id > 0")).count() == 0
    with pytest.raises(ValueError):
        negatives.hard_negatives(vectors(spark, [(100, [1e9, 1.0, 1.0], 1)]))


def test_a_descent_skips_most_of_a_clustered_tree():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16)) * 100
    x = np.rint(centres[rng.integers(0, 60, 4_000)] + rng.normal(size=(4_000, 16)) * 4)
    label = rng.integers(0, 4, 4_000)
    longest = float(np.sqrt((x**2).sum(axis=1).max()))
    tree = negatives.CoverTree(x, label, np.arange(4_000), longest)
    met = []
    hold = tree._hold
    tree._hold = lambda held, need, windows, rows_, scores, k: (met.append(len(rows_)), hold(held, need, windows, rows_, scores, k))
    for q in range(0, 4_000, 400):
        for same in (True, False):
            fit = np.flatnonzero((label == label[q]) == same)
            scores = (x[fit] @ x[q]).astype(int)
            top = int(scores.max())
            windows = np.array([[-(1 << 60), 1 << 60], [top // 2, top - 100]])
            got = tree.search(x[q], int(label[q]), same, windows, 5)
            for (low, high), found in zip(windows, got):
                want = sorted((-int(s), int(i)) for s, i in zip(scores, fit) if low <= s <= high)[:5]
                assert [(s, i) for s, i, _ in found] == want
    assert sum(met) / 20 < 0.35 * 4_000


# ---- shingle join ---------------------------------------------------------------


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(body):
    sets = [shingle_set(t) for _, t, *_ in body]
    root = list(range(len(body)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, *_) in enumerate(body):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, len(s), least.get(top(i)) if s else d) for i, ((d, *_), s) in enumerate(zip(body, sets)))


def edited(rnd, words, least):
    first, now = shingle_set(" ".join(words)), list(words)
    while True:
        after = list(now)
        after[rnd.randrange(len(now))] = "edit" + str(rnd.random())
        s = shingle_set(" ".join(after))
        if len(first & s) < least * len(first | s):
            return now
        now = after


def families():
    """Chains, a family around one text, a template whose texts are a little too far apart, copies, a line in every text."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(3_000)]
    texts = []
    for _ in range(12):
        now = rnd.choices(words, k=120)
        for _ in range(5):
            texts.append(" ".join(now))
            now = edited(rnd, now, 0.8)
    base = rnd.choices(words, k=150)
    texts += [" ".join(edited(rnd, base, 0.87)) for _ in range(40)]
    template = rnd.choices(words, k=200)
    for _ in range(40):
        own = template[:174] + rnd.choices(words, k=26)
        texts += [" ".join(own)] + ([" ".join(edited(rnd, own, 0.8))] if rnd.random() < 0.4 else [])
    line = "this very common line stands in each of these texts and in many others too"
    texts += [line + " " + " ".join(rnd.choices(words, k=rnd.randrange(3, 25))) for _ in range(50)]
    texts += [line] * 6 + [line.upper() + "  \t"] * 3 + ["one two", "One  two", "one two three", "", None, " \n "] * 2
    rnd.shuffle(texts)
    return [(i if i % 17 else None, t, "en", "s") for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_components_against_all_pairs(spark, monkeypatch, small):
    if small:
        for name, value in {"MEETING": 4, "FAMILY": 3, "PAIRS_AT_ONCE": 50, "MEMBERS": 3, "BROADCAST_NODES": 0, "FREQUENT": 10_000, "WORDS_KEPT": 50}.items():
            monkeypatch.setattr(jaccard, name, value)
    body = families()
    assert Counter(map(tuple, jaccard.jaccard_components(frame(spark, body)).collect())) == plain_components(body)


def test_components_of_awkward_rows(spark):
    body = [(r[0], r[1]) for r in rows()]
    assert Counter(map(tuple, jaccard.jaccard_components(documents(reach(spark))).collect())) == plain_components(body)
    assert jaccard.jaccard_components(no_documents(spark)).count() == 0


def test_no_similar_pair_is_filtered():
    """The bound on the overlap and the further orders let every similar pair pass, and stop most others."""
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    known, passed, stopped = jaccard.WordHashes(), 0, 0
    frequent = np.unique(np.concatenate([jaccard.shingles(" ".join(words[i : i + 30]), known) for i in range(0, 300, 60)]))
    for _ in range(300):
        base = rnd.choices(words, k=rnd.randrange(5, 120))
        other = edited(rnd, base, rnd.choice([0.3, 0.8, 0.8, 0.85])) if rnd.random() < 0.7 else base[: rnd.randrange(3, len(base))]
        a, b = (jaccard.shingles(" ".join(w), known) for w in (base, other))
        shared = len(np.intersect1d(a, b))
        similar = 100 * shared >= 80 * (len(a) + len(b) - shared)
        met = len(np.intersect1d(jaccard.prefix(a, frequent), jaccard.prefix(b, frequent)))
        beyond = max(len(a) - jaccard.prefix_size(len(a)), len(b) - jaccard.prefix_size(len(b)))
        possible = met > 0 and met + beyond >= -(-80 * (len(a) + len(b)) // 180)
        assert jaccard.similar(a, b, [np.sort(p) for p in jaccard.order_prefixes(b)]) == similar
        assert possible or not similar
        passed, stopped = passed + similar, stopped + (not possible)
    assert passed > 50 and stopped > 30
