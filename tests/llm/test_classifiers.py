"""Classifiers: held-out accuracy, and what they must not look at."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
from llm.conftest import EDGES
from pyspark.sql import functions as F

from skarn.llm import quality, toxicity, training

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


def held_rows(spark, query, name):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", name)
    rows = query(spark, SF).where("held_out").join(labels, "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id)
    return rows.score.to_numpy(), rows[name].to_numpy(), rows.predicted.to_numpy()


def test_toxicity_held_out(spark):
    score, label, predicted = held_rows(spark, toxicity.op8_toxicity, "toxic")
    assert auc(score, label) > 0.94  # some labelled documents are junk without a word to tell them by
    assert (predicted == label).mean() > 0.95
    assert ((score >= 0) & (score <= 1)).all()


def test_quality_held_out(spark):
    score, label, predicted = held_rows(spark, quality.op10_quality, "quality")
    assert auc(score, label) > 0.99
    assert predicted[label == 1].mean() > 0.99 and predicted[label == 0].mean() < 0.1


def test_offending_sentences_are_found():
    docs = [(1, f"all is calm number {k}. you are a grumbleface today. fine words end it") for k in range(60)]
    docs += [(0, f"all is calm number {k}. the weather is mild today. fine words end it") for k in range(60)]
    model = toxicity.fit(docs)
    text = "the weather is mild. Oh you GRUMBLEFACE, you. all is calm"
    score, found = model.score(text)
    assert score > 0.5 and [text[a:b] for a, b, _ in found] == [" Oh you GRUMBLEFACE, you"]
    assert model.score("the weather is calm and mild. " * 500)[0] < 0.5
    assert model.score(None) == model.score("") == model.score("...") == (0.0, [])


def brute_noisy_or(w, bias, docs, decay=0.0):
    """(mean loss, scores): sentence by sentence, probability by probability."""
    scores, loss = [], 0.0
    for label, bag in docs:
        clear = 1.0
        for sentence in bag:
            clear *= 1 - 1 / (1 + math.exp(-(sum(w[f] for f in sentence) + bias)))
        scores.append(1 - clear)
        loss -= math.log(max(1 - clear, 1e-6) if label else clear)
    return loss / len(docs) + decay / 2 * sum(x * x for x in w), scores


def test_noisy_or_is_the_brute_force_one():
    """Loss against a loop over sentences, gradient against differences, scores against the product of the odds."""
    rng = np.random.default_rng(5)
    docs = [(int(rng.random() < 0.4), [rng.integers(0, 6, rng.integers(1, 4)).tolist() for _ in range(rng.integers(0 if k % 7 else 1, 5))]) for k in range(40)]
    docs = [(label if bag else 0, bag) for label, bag in docs]
    y = np.array([label for label, _ in docs], float)
    sizes = [len(s) for _, b in docs for s in b]
    doc, row = np.repeat(np.arange(len(docs)), [len(b) for _, b in docs]), np.repeat(np.arange(len(sizes)), sizes)
    x = np.array([f for _, b in docs for s in b for f in s])
    w = np.r_[rng.normal(0, 1, 6), -0.7]
    loss, gradient = toxicity.likelihood(w, y, doc, row, x, 0.01)
    assert loss == pytest.approx(brute_noisy_or(w[:-1], w[-1], docs, 0.01)[0], rel=1e-9)
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-5
        slope = (brute_noisy_or((w + step)[:-1], (w + step)[-1], docs, 0.01)[0] - brute_noisy_or((w - step)[:-1], (w - step)[-1], docs, 0.01)[0]) / 2e-5
        assert gradient[k] == pytest.approx(slope, rel=1e-4, abs=1e-7)


def test_toxicity_scores_are_the_brute_force_ones(spark):
    """The query's scores from its own model, every sentence scored by itself."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    again = toxicity.fit([(r.toxic, r.text) for r in docs.join(labels.where(~training.held_out(F.col("doc_id"))), "doc_id").orderBy("doc_id", "toxic").collect()])
    assert np.allclose(model.weights, again.weights, atol=1e-4) and model.bias == pytest.approx(again.bias, abs=1e-4)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.op8_toxicity(spark, sf).collect():
        clear = 1.0
        for sentence in re.split(r"[.!?\n]+", texts[r.doc_id]):
            z = sum(float(model.weights[toxicity.word_features(t)].sum()) for t in set(sentence.split()))
            clear *= 1 - 1 / (1 + math.exp(-(z + model.bias))) if any(model.weights[toxicity.word_features(t)].sum() for t in set(sentence.split())) else 1
        assert r.score == pytest.approx(1 - clear, abs=1e-6) and r.predicted == (r.score >= 0.5)


def test_risk_is_the_brute_force_one():
    """The non-negative unbiased risk row by row, and its gradient by differences, on both sides of zero."""
    rng = np.random.default_rng(2)
    p, u = rng.normal(0.5, 1, (30, 4)), rng.normal(-0.5, 1, (50, 4))
    soft = lambda z: math.log1p(math.exp(z))  # noqa: E731  loss of the label -1; that of +1 is soft(-z)

    def parts(w, prior):
        plus = sum(soft(-float(r @ w)) for r in p) / len(p)
        return prior * plus, sum(soft(float(r @ w)) for r in u) / len(u) - prior * sum(soft(float(r @ w)) for r in p) / len(p)

    signs = set()
    for prior in (0.1, 0.5, 0.95):
        for _ in range(4):
            w = rng.normal(0, 1, 4)
            plus, minus = parts(w, prior)
            loss, gradient = quality.risk(w, p, u, prior, 0.0)
            assert loss == pytest.approx(plus + max(0.0, minus), rel=1e-9)
            signs.add(minus < 0)
            for k in range(4):
                step = np.eye(4)[k] * 1e-6
                after, before = parts(w + step, prior), parts(w - step, prior)
                slope = (after[1] - before[1]) / 2e-6
                want = -slope if minus < 0 else slope + (after[0] - before[0]) / 2e-6
                assert gradient[k] == pytest.approx(want, rel=1e-4, abs=1e-6)
    assert signs == {True, False}


def test_quality_scores_are_the_brute_force_ones(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    weights, _ = quality.train(docs.select("doc_id", "text"), labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.op10_quality(spark, sf).collect():
        z = sum(a * b for a, b in zip(quality.Features().of(texts[r.doc_id]), weights, strict=True))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.predicted == (r.score >= 0.3)


def test_one_class_or_none():
    assert toxicity.fit([]).score("a b")[0] < 1e-6
    assert toxicity.fit([(0, "a b")]).score("a b")[0] < 1e-6
    empty = np.empty((0, quality.FEATURES))
    some = quality.Features().of("a b c")[None, :]
    for p, u in ((empty, empty), (empty, some), (some, empty), (some, some)):
        w, prior = quality.fit(p, u)
        assert np.isfinite(w).all() and 0 < prior < 1


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_estimate(share):
    rng = np.random.default_rng(1)
    n = 6000
    own = rng.random(n) < share
    u = np.where(own, rng.normal(2, 1, n), rng.normal(-2, 1, n))
    assert abs(quality.estimate_prior(rng.normal(2, 1, n), u) - share) < 0.06


def test_shapes_are_distinct():
    tokens = ["word", "word,", "word.", "word7", "word%", "word%%%", "Word", "WORD", "wOrd", "123", "|"]
    assert len({quality.shape(t) for t in tokens}) == len(tokens)


def test_held_out_fold(spark):
    rows = spark.range(200).select(training.held_out(F.col("id")).alias("h"), "id").collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 9)] + [(None, 1, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")
    for rows in (toxicity.score_toxicity(edges, labels), quality.score_quality(edges, labels)):
        found = rows.collect()
        assert sorted(r.doc_id or 0 for r in found) == sorted(i or 0 for i, _ in EDGES)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in found)
    carried = quality.score_quality(edges, labels, carry=True)
    assert carried.columns == ["doc_id", "text", "lang", "keep_id", "KEPT", "n_words", "ids", "a.b", "quality_text", "sieve `bits", "held_out", "score", "predicted"]
    for docs, own in ((nothing, labels), (edges, labels.where("doc_id = -1")), (nothing, labels.where("doc_id = -1"))):
        assert toxicity.score_toxicity(docs, own).count() == docs.count()
        assert quality.score_quality(docs, own).count() == docs.count()


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.expr("if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality)"))
    a, b = (quality.train(docs, x)[0] for x in (labels, flipped))
    assert np.allclose(a, b)
