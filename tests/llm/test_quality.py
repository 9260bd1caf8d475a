from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import quality, registry
from lectern.llm.common import table


def test_labellers_accuracies_are_found():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.75, 0.6, 0.85])
    votes = np.where(rng.random((20_000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, found, prior = quality.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(found - right[:, None]).max() < 0.05 and abs(prior - 0.7) < 0.03


def test_quality(spark, edges, edge_rows, clashing, nothing):
    out = quality.score(clashing).collect()
    assert len(out) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(nothing).count() == 0
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = [r for r in registry.QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").collect() if r["doc_id"] in labels]
    good = [r["score"] for r in rows if labels[r["doc_id"]]]
    bad = [r["score"] for r in rows if not labels[r["doc_id"]]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_posteriors_one_vote_at_a_time():
    """One round from the first accuracies, by Bayes' rule written out."""
    patterns, counts = np.array([[1, 0, -1], [1, 1, 1], [0, 0, -1]]), np.array([3.0, 5.0, 2.0])
    got, right, prior = quality.expectation_maximisation(patterns, counts, rounds=1)
    for row, p in zip(patterns, got):
        good, bad = 0.8, 0.2
        for v in row:
            good *= 1 if v < 0 else 0.8 if v else 0.2
            bad *= 1 if v < 0 else 0.2 if v else 0.8
        assert math.isclose(p, good / (good + bad))
    assert math.isclose(prior, float((counts * got).sum() / 10))
    hit, seen = 3 * got[0] + 5 * got[1], (counts * got).sum()
    assert math.isclose(right[0, 1], (hit + 8) / (seen + 10))


def test_scores_are_means_of_weights():
    rng = np.random.default_rng(4)
    of = quality.Scorer(rng.normal(size=quality.BUCKETS), 0.2)
    for text in ("Some Words words words", "", None, "x" * 500):
        words = (text or "").split()
        total = sum(of.weight[a] + of.weight[b] for a, b in map(quality.features, words)) + of.weight[quality.REPEAT] * sum(a == b for a, b in zip(words, words[1:]))
        assert math.isclose(of(text), 1 / (1 + math.exp(-(0.2 + total / max(1, len(words))))))
    assert quality.features("1" * 64 + "a") != quality.features("1" * 64 + "A")


def test_ties_and_repeated_rows(spark):
    rows = [(1, "A fine text of several words stands here.")] * 3 + [(1, "x"), (None, "x"), (None, None), (2, None), (2, "")]
    out = quality.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and len({(r["posterior"], r["score"]) for r in out if r["doc_id"] == 2}) == 1
    same = sorted((r["score"], r["posterior"]) for r in out if r["doc_id"] == 1)
    assert len(set(same)) == 2


@pytest.mark.parametrize("sample", [1, 5])
def test_sample_bounds_the_regression(edges, edge_rows, sample):
    assert quality.score(edges.withColumn("pattern", F.lit("mine")), sample).count() == len(edge_rows)
