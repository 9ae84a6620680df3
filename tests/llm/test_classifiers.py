"""Held-out accuracy of the two classifiers, and their rules on odd rows."""

import zlib

import numpy as np
import pytest

from sparkveil.llm import toxicity, weak_quality
from sparkveil.llm.queries import QUERIES
from tests.llm.helpers import docs, empty

LARGE = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    rows = QUERIES["op4_positive_unlabelled_toxicity"](spark, LARGE).collect()
    assert len(rows) == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    s, y = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    rank = s.argsort().argsort()
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.97 and ((s >= 0.5) == y).mean() > 0.96 and (s[y == 0] >= 0.5).mean() < 0.02


def test_risk_is_corrected_for_the_prior():
    """Hidden positives among the unlabelled do not drag the scorer down, and no clean label is needed."""
    rng = np.random.default_rng(4)

    def text(toxic):
        found = rng.choice(np.arange(100, 4000), 40, replace=False)
        return np.unique(np.append(found, rng.choice(5, 2) if toxic else [])).astype(np.int32)

    truth = rng.random(3000) < 0.3
    weights, bias = toxicity.train([text(True) for _ in range(600)], [text(t) for t in truth], 0.3, 1)
    fresh = rng.random(2000) < 0.3
    margins = np.array([weights[text(t)].sum() for t in fresh]) + bias
    assert ((margins > 0) == fresh).mean() > 0.97


def test_toxicity_of_odd_rows(spark):
    frame = docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    weights, bias = toxicity.fit(frame, none)
    assert not weights.any() and bias < -10
    bad = spark.createDataFrame([(1, 1, None), (None, 1, 1), (3, 1, 1), (5, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(frame, *toxicity.fit(frame, bad)).collect()
    assert len(rows) == frame.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2, 4)}) == 1
    assert toxicity.score(empty(spark), weights, bias).count() == 0
    assert toxicity.fit(empty(spark), bad)[1] == pytest.approx(np.log(2 / 1), abs=1)


def test_long_texts_count_to_the_end(spark):
    weights = np.zeros(toxicity.FEATURES, np.float32)
    weights[toxicity._parts(b"vile")] = 5
    frame = docs(spark, ["clean " * 300_000 + "vile", "clean " * 300_000], more=False)
    scores = {r.doc_id: r.score for r in toxicity.score(frame, weights, -2.0).collect()}
    assert scores[0] > 0.9 and scores[1] < 0.2


def test_quality_held_against_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    rows = QUERIES["op8_weak_label_quality"](spark, LARGE).collect()
    told = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert len(rows) == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    assert np.mean([k for k, q in told if q]) > 0.99 and np.mean([not k for k, q in told if not q]) > 0.8


def test_accuracies_are_recovered():
    rng = np.random.default_rng(9)
    truth, right = rng.random(20_000) < 0.7, np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    said = np.where(rng.random((len(truth), 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    said[rng.random(said.shape) < 0.2] = 2
    patterns, counts = np.unique(said, axis=0, return_counts=True)
    good, table = weak_quality.label_model(patterns, counts.astype(float))
    assert np.abs(table[:, 1, 1] - right).max() < 0.05 and np.abs(table[:, 0, 0] - right).max() < 0.05
    by = {tuple(p): g for p, g in zip(patterns, good)}
    assert np.mean([(by[tuple(s)] >= 0.5) == t for s, t in zip(said, truth)]) > 0.93


def test_quality_of_odd_rows(spark):
    frame = docs(spark)
    rows = weak_quality.judge(frame).collect()
    assert len(rows) == frame.count() and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and len(r.votes) == weak_quality.LABELLERS for r in rows)
    assert len({(r.votes, r.score) for r in rows if r.doc_id in (0, 1, 2, 4)}) == 1
    assert weak_quality.judge(empty(spark)).count() == 0
