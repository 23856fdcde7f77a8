"""Language network, factorization machine, prefix forest: held-out accuracy, gradients by brute force, recall."""

import os
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from awkward import documents, no_documents, rows  # noqa: E402

from tabscore.llm import language, neighbours, toxicity  # noqa: E402
from tabscore.llm.common import held_out, learnable, utf8  # noqa: E402

SF = "/root/testdata/sf0.01"

# ---- language -------------------------------------------------------------


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return language.identify(docs).toPandas(), docs.select("doc_id", "lang").toPandas()


def test_language_accuracy_on_the_held_out_third(predicted):
    got, truth = predicted
    both = got.merge(truth, on="doc_id")
    assert len(got) == len(truth) and both.score.between(0, 1).all()
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.9


def test_language_of_awkward_rows(spark):
    net = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = language.predict(documents(spark), net, ("doc_id", "a.b")).collect()
    assert len(got) == len(rows())
    for r, row in zip(sorted(got, key=lambda r: repr(r.doc_id)), sorted(rows(), key=lambda r: repr(r[0]))):
        assert r.doc_id == row[0] and 0 <= r.score <= 1
    blank = {i for i, t, *_ in rows() if i is not None and not any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in got if r.doc_id is not None and r.lang_pred == "und"} == blank
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language.identify(no_documents(spark)).count() == 0


def test_language_without_labels(spark):
    got = language.identify(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in got} == {"und"} and len(got) == len(rows())


def test_windows_cover_every_byte():
    texts = pa.array(["a" * 600, None, "", "xyz", "b" * 256])
    windows, owner, weight = language.cut_windows(*utf8(texts))
    assert owner.tolist() == [0, 0, 0, 3, 4] and weight.tolist() == [256, 256, 88, 3, 256]
    assert bytes(windows[2][:88]) == b"a" * 88 and not windows[2][88:].any() and bytes(windows[3][:3]) == b"xyz"


def test_network_answers_as_written_out():
    rng = np.random.default_rng(5)
    x = rng.integers(97, 123, (300, language.WINDOW)).astype(np.uint8)
    net = language.train(x, rng.integers(0, 3, 300), ["a", "b", "c"], epochs=1)
    got = net.probabilities(x[:2])
    for row, p in zip(x[:2], got):
        e = np.vstack([net.embedding[row], np.zeros((max(language.WIDTHS) - 1, language.EMBEDDING))])
        top = [max(float((e[i : i + max(language.WIDTHS)].ravel() * net.filters[:, f]).sum()) for i in range(language.WINDOW)) for f in range(net.filters.shape[1])]
        s = np.maximum(np.array(top) + net.bias, 0) @ net.out + net.out_bias
        want = np.exp(s - s.max())
        assert np.allclose(p, want / want.sum(), atol=1e-5)


def test_sample_is_bounded_and_learnable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    windows, labels, names = language.sample_windows(docs, F.col("lang"), texts=20)
    assert len(windows) == len(labels) <= 2 * 20 * len(names) * language.SAMPLE_WINDOWS
    assert names == ["de", "en", "es", "fr"]


# ---- toxicity -------------------------------------------------------------


def test_toxicity_on_the_held_out_third(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.toxicity(some, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert got.score.between(0, 1).all()
    hit = got.predicted == 1
    assert (got.toxic[hit] == 1).mean() > 0.95 and hit[got.toxic == 1].mean() > 0.85


def test_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    fm = toxicity.FactorizationMachine(0.5, rng.normal(size=50), rng.normal(size=(50, 3)))
    terms = np.array([3, 7, 20, 41])
    want = 0.5 + fm.weight[terms].sum() + sum(fm.vectors[a] @ fm.vectors[b] for i, a in enumerate(terms) for b in terms[:i])
    assert np.isclose(fm.margin(terms), want)


def test_pairs_are_learned_that_weights_can_not_tell():
    """Insult and group together are toxic, each alone half of the time with another word is not."""
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for _ in range(1_500):
        a, b = rng.integers(0, 2, 2)
        noise = rng.integers(10, 30, 3)
        texts.append(np.unique(np.array([1 if a else 2, 3 if b else 4, *noise])))
        labels.append(float(a == b))
    labels = np.array(labels, np.float32)
    fm = toxicity.train(texts, labels, epochs=30)
    score = np.array([fm.score(t) for t in texts])
    assert ((score > 0.5) == labels).mean() > 0.95


def test_terms_of_telling_pairs_are_known_however_blocks_are_cut(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [np.unique(rng.integers(10, 200, 12)) for _ in range(2_000)]
    labels = (rng.random(2_000) < 0.1).astype(np.float32)
    assert toxicity.pair_terms(texts, labels).size == 0
    for i in range(0, 160, 2):
        # 5 and 6 together are toxic, each without the other is as toxic as any.
        texts[i] = np.unique(np.append(texts[i], [5, 6]))
        labels[i] = 1
        texts[i + 400], texts[i + 800] = np.append(texts[i + 400], 5), np.append(texts[i + 800], 6)
    assert {5, 6} <= set(toxicity.pair_terms(texts, labels).tolist())
    whole = toxicity.pair_terms(texts, labels).tolist()
    monkeypatch.setattr(toxicity, "PAIR_BLOCK", 7)
    assert toxicity.pair_terms(texts, labels).tolist() == whole


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(6)
    fm = toxicity.FactorizationMachine(0.2, rng.normal(size=12) / 3, rng.normal(size=(12, 3)) / 3)
    texts = [np.sort(rng.choice(12, n, replace=False)) for n in (4, 1, 0, 7)]
    labels = np.array([1.0, 0.0, 1.0, 0.0])

    def loss() -> float:
        p = np.array([fm.score(t) for t in texts])
        return float(-(2.5 * labels * np.log(p) + (1 - labels) * np.log(1 - p)).sum())

    d_bias, terms, counts, d_weight, d_vectors = toxicity.gradients(fm, texts, labels, 2.5)
    assert counts.tolist() == [sum(i in t for t in texts) for i in terms]
    step = 1e-5

    def slope(array: np.ndarray, at) -> float:
        array[at] += step
        up = loss()
        array[at] -= 2 * step
        down = loss()
        array[at] += step
        return (up - down) / (2 * step)

    for n, term in enumerate(terms):
        assert np.isclose(slope(fm.weight, term), d_weight[n], atol=1e-6)
        assert np.allclose([slope(fm.vectors, (term, f)) for f in range(3)], d_vectors[n], atol=1e-6)
    fm.bias += step
    up = loss()
    fm.bias -= 2 * step
    assert np.isclose((up - loss()) / (2 * step), d_bias, atol=1e-6)


def test_repeated_rows_teach_once(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs.union(docs).repartition(7), labels)
    assert one.bias == two.bias and (one.weight == two.weight).all() and (one.vectors == two.vectors).all()


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, None, 1), (None, 1, 1), (6, 1, None), (6, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(documents(spark), labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(no_documents(spark), labels).count() == 0
    assert toxicity.toxicity(documents(spark), labels.limit(0)).count() == len(rows())
    assert toxicity.Buckets().of(None).size == 0


def test_learning_leaves_the_held_out_third_alone(spark):
    ids = spark.range(200).select(F.col("id"), held_out(F.col("id")).alias("h"), learnable(F.col("id")).alias("l")).collect()
    assert all(r.h != r.l and r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in ids)
    none = spark.sql("select cast(null as long) id").select(held_out(F.col("id")).alias("h"), learnable(F.col("id")).alias("l")).first()
    assert not none.h and not none.l


# ---- neighbours -----------------------------------------------------------


def plain_nearest(table, every=20, k=20):
    """Ids and scores by comparing each query with all rows."""
    table = sorted({(i, tuple(v)) for i, v in table if i is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v)})
    ids, x = np.array([i for i, _ in table]), np.array([v for _, v in table], np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = np.array([float(np.dot(r, x[q])) for r in x])
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_over_all_embeddings(spark):
    rows_ = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    from tabscore.llm.queries import QUERIES

    got, want = by_query(QUERIES["op9_prefix_forest"](spark, SF)), plain_nearest(rows_)
    assert set(got) == set(want)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.9
    for q in got:
        assert len(got[q]) == len(want[q])


def test_neighbours_with_shards_blocks_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 300)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1_000, 12)) * rng.uniform(0.2, 3, (1_000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    table = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = by_query(neighbours.nearest(df, every=10)), plain_nearest(table, every=10)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert set(got) == set(want) and recall >= 0.9
    for q in got:
        scores = dict(want[q])
        assert all(abs(scores[i] - s) < 1e-9 for i, s in got[q] if i in scores)


def test_neighbours_of_awkward_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, key string, entry long, v string"
    body = [(i, [1.0, 2.0, 0.0]) for i in range(0, 90)]
    body += [(100, None), (120, [0.0, -0.0, 0.0]), (140, [1.0, None, 2.0]), (160, [float("nan"), 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    body += [(200, [0.5, 0.25, 1.0]), (200, [0.5, 0.25, 1.0]), (220, [-1.0, 0.0, 3.0]), (240, [1.0, 1.0]), (260, [])]
    df = spark.createDataFrame([(i, v, 1, "k", 1, "v") for i, v in body], schema)
    want = plain_nearest([(i, v) for i, v in body if v is None or len(v) == 3])
    assert by_query(neighbours.nearest(df)) == want
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert by_query(neighbours.nearest(df.filter("vec_id = 200"))) == {}
