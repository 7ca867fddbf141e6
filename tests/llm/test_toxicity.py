import zlib

import numpy as np
from pyspark.sql import functions as F

from lendlens.llm.common import table
from lendlens.llm.toxicity import drop_toxic, fit, score_toxicity, word_keys

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    out = score_toxicity(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    assert all(r["score"] >= 0 and r["score"] <= 1 for r in rows)
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    ranks = np.empty(len(s))
    ranks[np.argsort(s)] = np.arange(len(s))
    auc = (ranks[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    p = np.array([r["predicted"] for r in rows])
    assert auc > 0.93 and y[p == 1].mean() > 0.85 and p[y == 1].mean() > 0.75
    held = {r["doc_id"]: r["held_out"] for r in out.select("doc_id", "held_out").limit(200).collect()}
    assert all(h == (zlib.crc32(str(k).encode()) % 4 == 2) for k, h in held.items())


def test_held_out_labels_change_nothing(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r["doc_id"]: r["score"] for r in score_toxicity(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in score_toxicity(docs, turned).collect()}


def test_risk_stays_non_negative():
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i:03d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(200)]

    def text(toxic):
        return " ".join([*rng.choice(vocabulary, 20), *(["vile"] if toxic else [])])

    toxic = [word_keys(text(True)) for _ in range(40)]
    mixed = [word_keys(text(i % 5 == 0)) for i in range(400)]
    model = fit(toxic, mixed, 0.2)
    assert np.mean([model.score(text(True)) > 0.5 for _ in range(50)]) > 0.9
    assert np.mean([model.score(text(False)) < 0.3 for _ in range(50)]) > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you vile thing", 1), (2, None, 1), (None, "", 1), (2, "x " * 100_000, 1), (2, None, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0, None), (None, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    out = score_toxicity(docs, labels)
    assert out.count() == 5 and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert score_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert drop_toxic(docs, labels.limit(0)).columns == docs.columns


def test_fit_against_a_plain_version():
    """Dense matrices, the risk written out, and its slope checked by differences."""
    from lendlens.llm import toxicity

    rng = np.random.default_rng(1)
    vocabulary = ["w" + "".join(rng.choice(list("abcdefgh"), 4)) for _ in range(60)]

    def text(toxic):
        return " ".join([*rng.choice(vocabulary, 12), *(["vile", "awful"] if toxic else ["fine"])])

    toxic, mixed = [word_keys(text(True)) for _ in range(30)], [word_keys(text(i % 4 == 0)) for i in range(200)]
    prior = 0.25
    model = fit(toxic, mixed, prior)
    P, U = (np.array([[k in set(d.tolist()) for k in model.keys.tolist()] + [True] for d in docs], float) for docs in (toxic, mixed))

    def parts(w):
        zp, zu = P @ w, U @ w
        return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()

    def slope(f, w):
        steps = np.eye(len(w)) * 1e-6
        return np.array([(f(w + s) - f(w - s)) / 2e-6 for s in steps])

    w = np.zeros(len(model.keys) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, decay, reversed_steps = 0.0, 0.0, max(3e-4, 0.03 / len(toxic)), 0
    for step in range(1, toxicity.STEPS + 1):
        clean = parts(w)[1]
        g = slope(lambda x: sum(parts(x)), w) if clean >= 0 else -slope(lambda x: parts(x)[1], w)
        reversed_steps += clean < 0
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - (toxicity.RATE * (1 - step / toxicity.STEPS) + 1e-3) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    np.testing.assert_allclose([*model.weights, model.bias], w, atol=2e-2)
    assert len(model.keys) >= 2


def test_sample_is_bounded_in_texts(spark):
    from lendlens.llm.toxicity import _sample

    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(500)], "doc_id long, text string")  # one id over many texts
    ids = docs.select("doc_id").distinct()
    assert len(_sample(docs, ids, 20)) == 20
