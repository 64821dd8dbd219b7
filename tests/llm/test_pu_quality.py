import numpy as np
import pytest

from starlace.llm.pu_quality import DECAY, NAMES, Linear, Sums, classify, features, fit, non_negative, plain, prior_of, scored


def test_features_by_hand():
    x = dict(zip(NAMES, features(["AB ab ab!\nx **", ""])[0]))
    assert x["upper"] == pytest.approx(2 / 14) and x["symbols"] == pytest.approx(2 / 14) and x["newlines"] == pytest.approx(1 / 14)
    assert x["distinct"] == pytest.approx(2 / 4) and x["all_upper"] == pytest.approx(1 / 4) and x["bang"] == pytest.approx(1 / 14)
    assert (features([""]) >= 0).all() and not features([""])[0][:10].any()


def test_batches_change_nothing(small):
    texts = [r.text for r in small.select("text").limit(40).collect()]
    assert np.allclose(features(texts), np.concatenate([features([t]) for t in texts]))


def local(xp, xu):
    """look and a model without weights, over arrays."""
    e = np.concatenate([xu, xu * xu], 1)
    blank = Linear(e.mean(0), e.std(0) + 1e-6, np.zeros(e.shape[1]), 0.0)
    d = e.shape[1] + 1
    return blank, d, lambda w: tuple(Sums.of(Sums.flat(blank.inputs(x), w), d) for x in (xp, xu))


def test_prior_and_risk():
    r = np.random.default_rng(0)
    make = lambda n, m: np.pad(r.normal(m, 1, (n, 2)), ((0, 0), (0, len(NAMES) - 2)))
    xp, xu = make(1500, 2.0), np.concatenate([make(3500, 2.0), make(1500, -2.0)])
    blank, d, look = local(xp, xu)
    first = blank.weighted(plain(look, d))
    bins = lambda z: np.bincount(np.minimum((1 / (1 + np.exp(-z)) * 1000).astype(int), 999), minlength=1000).astype(float)
    prior = prior_of(bins(first.margin(xp)), bins(first.margin(xu)))
    assert 0.6 < prior < 0.8
    model = blank.weighted(non_negative(look, d, prior))
    assert (model.margin(make(500, 2.0)) > 0).mean() > 0.95 and (model.margin(make(500, -2.0)) < 0).mean() > 0.95


def test_risk_against_brute_force():
    """What Newton's steps reach is no worse than what plain descent of the risk itself does."""
    r = np.random.default_rng(3)
    xp, xu = r.normal(0.7, 1, (300, len(NAMES))), np.concatenate([r.normal(0.7, 1, (500, len(NAMES))), r.normal(-0.4, 1, (300, len(NAMES)))])
    for prior in (0.3, 0.6):
        blank, d, look = local(xp, xu)
        p, u = blank.inputs(xp), blank.inputs(xu)
        decay = DECAY * np.append(np.ones(d - 1), 0)

        def risk(w):
            rest = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
            return prior * np.logaddexp(0, -(p @ w)).mean() + max(0, rest) + (decay * w * w).sum() / 2, rest

        w, best = np.zeros(d), np.inf
        for _ in range(4000):
            value, rest = risk(w)
            best = min(best, value)
            g = (1 / (1 + np.exp(-(u @ w)))) @ u / len(u) - prior * p.mean(0)
            w = w - 0.05 * ((g + decay * w) if rest >= 0 else -((1 / (1 + np.exp(-(u @ w)))) @ u / len(u) - prior * (1 / (1 + np.exp(-(p @ w)))) @ p / len(p)))
        got, rest = risk(non_negative(look, d, prior))
        assert got <= best + 0.02, prior


def test_sums_over_a_table_are_those_of_its_rows(spark, small):
    labels = spark.createDataFrame([(r.doc_id, 1) for r in small.limit(60).collect()], "doc_id long, quality int")
    got = fit(spark.createDataFrame([(r.doc_id, features([r.text or ""])[0].tolist()) for r in small.collect()], "id long, x array<float>").repartition(5), labels)
    ids = {r.doc_id for r in labels.collect()}
    rows = [(r.doc_id, features([r.text or ""])[0].astype(np.float32)) for r in small.collect()]
    x, good = np.stack([v for _, v in rows]), np.array([i in ids for i, _ in rows])
    blank, d, look = local(x[good].astype(float), x.astype(float))
    assert np.allclose(blank.mean, got.model.mean) and np.allclose(blank.scale, got.model.scale, rtol=1e-3)
    want = blank.weighted(non_negative(look, d, got.prior))
    assert np.allclose(want.margin(x), got.model.margin(x), atol=0.05)


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = scored(docs, labels.where("doc_id % 2 = 0"))
    rows = got.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_odd(spark, odd, none, clashing):
    labels = spark.createDataFrame([(1, 1), (6, 1), (6, 0), (None, 1), (7, None), (8, 1), (8, 1)], "doc_id long, quality int")
    got = classify(odd, labels, steps=20)
    assert got.count() == odd.count() and got.where("quality_score IS NULL").count() == 0
    nobody = spark.createDataFrame([], "doc_id long, quality int")
    assert classify(odd, nobody).where("keep AND quality_score IS NULL").count() == odd.count()
    assert classify(none, labels).count() == 0 and scored(none, labels).count() == 0
    assert classify(clashing, labels, steps=5).count() == odd.count()
