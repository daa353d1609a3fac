"""Language mixtures and toxicity: held-out accuracy, mixtures, interactions, edges."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import language, toxicity
from leafmill.llm.common import held_out
from leafmill.llm.textkit import buffers

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(DATA):
        pytest.skip("tables absent")
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs.where(~held_out(F.col("doc_id"))))


def test_language_held_out(docs, model):
    rows = docs.where(held_out(F.col("doc_id")))
    got = language.predict(rows, model, "text", F.col("lang"))
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).head()
    assert right / n >= 0.98
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_mixture(docs, model):
    text = {r["lang"]: r["text"] for r in docs.where("n_chars > 2000").groupBy("lang").agg(F.max("text").alias("text")).collect()}
    half = text["de"][:1500] + " " + text["fr"][:1500]
    c = language.trigram_counts(*buffers(pa.array([half])))
    share = dict(zip(model.names, model.infer(c)[0].tolist()))
    assert 0.3 < share["de"] < 0.7 and 0.3 < share["fr"] < 0.7 and share["de"] + share["fr"] > 0.9


def test_language_edges(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "a"), (5, "é"), (5, "é"), (6, "the " * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(df, model, "text", F.col("doc_id")).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] in model.names and got[5][0] in model.names and got[6][0] == "en"
    assert language.predict(df.limit(0), model, "text", F.col("doc_id")).count() == 0
    none = language.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.predict(df, none, "text").collect()} == {"und"}
    one = language.train(df.withColumn("lang", F.lit("xx")))
    assert {r["lang_pred"] for r in language.predict(df.where("doc_id = 6"), one, "text").collect()} == {"xx"}


def test_toxicity_learns_pairs(spark):
    """An insult alone, or a group alone, is harmless; both together are not."""
    rows = []
    for i in range(1200):
        fill = f"filler words number {i % 37} and more"
        insult, group = i % 2 == 0, i % 4 < 2
        rows.append((i, f"{fill} {'vermin' if insult else ''} {'martians' if group else ''}", int(insult and group)))
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, machine, "text", F.col("doc_id")).collect()}
    wrong = sum((got[i] >= 0.5) != bool(y) for i, _, y in rows if i % 3 == 0)
    assert wrong <= 8


def test_em_against_brute_force():
    """Proportions of two languages against a search over all shares; the likelihood never falls."""
    import numpy as np

    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, (3, language.BUCKETS)).astype(float)
    model = language.LanguageMixture(["a", "b", "c"], counts, np.ones(3))
    for share in (0.3, 0.5, 0.8):
        c = (rng.multinomial(4000, share * model.p[0].astype(float) / model.p[0].sum() * 0.999999 + (1 - share) * model.p[1].astype(float) / model.p[1].sum() * 0.999999 + 1e-9)).astype(np.float32)[None]
        best = max(np.linspace(0, 1, 1001), key=lambda s: (c[0] * np.log(s * model.p[0] + (1 - s) * model.p[1])).sum())
        fitted, last = np.array([[0.5, 0.5, 0]], np.float32), -np.inf
        for _ in range(20):
            fitted, ll = model._fit(c, fitted)
            assert ll[0] >= last - 1e-2 * abs(ll[0]) / 1e3
            last = ll[0]
        assert abs(fitted[0, 0] - best) < 0.02
        chosen = model.infer(c)[0]
        assert chosen[2] == 0 and abs(chosen[0] - best) < 0.1


def test_language_score_carries_confidence(spark, model):
    df = spark.createDataFrame([("of th",), ("of the other and with the",), ("the " * 400,)], "text string")
    low, mid, high = (r["score"] for r in language.predict(df, model, "text").collect())
    assert low < high and mid <= high and high > 0.99


def test_clashing_names(spark, model):
    df = spark.createDataFrame([("the house", "kept", 5, 6)], "text string, __text string, score int, c0 int")
    got = language.predict(df, model, "text", F.col("__text"), F.col("score"), F.col("c0"), F.col("text"), keep_text=True)
    assert got.columns == ["__text", "score", "c0", "text", "lang_pred", "score", "text"]
    assert tuple(got.collect()[0])[:4] == ("kept", 5, 6, "the house")
    machine = toxicity.FactorizationMachine(__import__("numpy").zeros(0, int))
    got = toxicity.score(df, machine, "text", F.col("__text"), F.col("score"), F.col("c0"))
    assert tuple(got.collect()[0])[:3] == ("kept", 5, 6)


def test_machine_against_brute_force():
    """The margin against a sum over all pairs, and one step of the fit against numeric gradients."""
    import numpy as np

    rng = np.random.default_rng(1)
    m = toxicity.FactorizationMachine(np.arange(6))
    m.w0, m.w, m.v = 0.3, rng.normal(size=6), rng.normal(size=(6, toxicity.RANK))
    rows = [[0, 2, 5], [1], [], [0, 1, 2, 3, 4, 5]]
    doc, term = np.repeat(np.arange(4), [len(r) for r in rows]), np.array(sum(rows, []))

    def margins(w0, w, v):
        return np.array([w0 + sum(w[i] for i in r) + sum(v[i] @ v[j] for i in r for j in r if i < j) for r in rows])

    assert np.allclose(m.margin(doc, term, 4)[0], margins(m.w0, m.w, m.v))
    y = np.array([1.0, 0, 1, 0])
    loss = lambda w0, w, v: np.mean(np.log1p(np.exp(-(2 * y - 1) * margins(w0, w, v))))
    eps, want = 1e-6, np.zeros_like(m.v)
    for i in range(6):
        for f in range(toxicity.RANK):
            step = np.zeros_like(m.v)
            step[i, f] = eps
            want[i, f] = (loss(m.w0, m.w, m.v + step) - loss(m.w0, m.w, m.v - step)) / (2 * eps)
    margin, s = m.margin(doc, term, 4)
    err = 1 / (1 + np.exp(-margin)) - y
    pull = err[doc][:, None] * (s[doc] - m.v[term])
    assert np.allclose(np.stack([np.bincount(term, pull[:, f], 6) for f in range(toxicity.RANK)], axis=1) / 4, want, atol=1e-5)


def test_training_does_not_depend_on_layout_and_is_bounded(spark):
    rows = [(i, f"filler {i % 11} {'vermin' if i % 3 else 'bread'} {'martians' if i % 5 else 'salt'}", int(i % 3 > 0 and i % 5 > 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    a = toxicity.train(docs.repartition(1), labels, max_train_rows=300)
    b = toxicity.train(docs.repartition(7, "text"), labels, max_train_rows=300)
    assert (a.w == b.w).all() and (a.v == b.v).all() and a.w0 == b.w0


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "bad words"), (2, None), (3, ""), (3, ""), (4, "x " * 50_000)], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 1), (2, None)], 1.0), ([(1, 0)], 0.0)):
        machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores = [r["score"] for r in toxicity.score(docs, machine, "text").collect()]
        assert len(scores) == 5 and all(abs(s - want) < 1e-6 for s in scores)
    assert toxicity.score(docs.limit(0), machine, "text").count() == 0
