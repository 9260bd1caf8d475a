from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import registry, toxicity
from lectern.llm.common import table


def test_toxicity_learns_misspellings():
    rng = np.random.default_rng(0)
    common = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(300)]
    clean = [" ".join(rng.choice(common, 60)) for _ in range(300)]
    bad = [" ".join([*rng.choice(common, 57), *rng.choice(["worthless", "pathetic"], 3)]) for _ in range(100)]
    model = toxicity.train(clean + bad, np.array([0] * 300 + [1] * 100))
    score = model.scorer()
    assert np.mean([score(t) for t in bad]) > 0.8 > 0.2 > np.mean([score(t) for t in clean])
    assert score(clean[0] + " worthlesss patheticc w0rthless") > score(clean[0])
    assert 0 <= score("") <= 1 and score(None) == score("")
    assert toxicity.train([], np.zeros(0, int)).bias == 0 and toxicity.train(["a"], np.array([1])).scorer()("a") > 0.5


def test_toxicity_of_edges(spark, edges, edge_rows, clashing, nothing):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (6, None), (7, 5), (9, 1), (9, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edges, labels)
    out = toxicity.score(clashing, model).collect()
    assert len(out) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(nothing, toxicity.fit(nothing, labels.limit(0))).count() == 0


def test_scores_are_means_of_means():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), -0.3)
    for text in ("Fine words HERE", "a", "", "1 2 3", "word " * 50 + "x" * 300):
        values = [np.mean([model.value[b] for b in toxicity.buckets(w)]) for w in toxicity.words(text)]
        assert np.isclose(model.scorer()(text), 1 / (1 + np.exp(0.3 - (np.mean(values) if values else 0))))


def test_long_runs_count_whole():
    assert toxicity.words("a" * 64 + "zz") != toxicity.words("a" * 64 + "qq")
    run = "".join(chr(97 + i % 26) for i in range(1000))
    grams = {w[i : i + n] for w in toxicity.words(run) for n in (3, 4, 5) for i in range(len(w) - n + 1)}
    assert grams == {run[i : i + n] for n in (3, 4, 5) for i in range(len(run) - n + 1)}
    assert all(len(w) <= toxicity.PIECE for w in toxicity.words(run + " short " + run)) and toxicity.words("ab " + "c" * 64) == ["ab", "c" * 64]


def test_sample_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 7), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert sorted((r["doc_id"], r["text"], r["y"]) for r in toxicity.labelled(docs, labels).collect()) == [(1, "a", 1), (2, None, 0)]


def test_clashing_columns(spark, clashing, edge_rows):
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0)
    assert toxicity.score(clashing.withColumn("y", F.lit(5)), model, "own").where("own = 0.5 and score = -1 and y = 5").count() == len(edge_rows)


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    rows = [r for r in registry.QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in labels]
    bad = [r["score"] for r in rows if labels[r["doc_id"]]]
    good = [r["score"] for r in rows if not labels[r["doc_id"]]]
    print("held out:", len(bad), sum(s >= 0.5 for s in bad), len(good), sum(s >= 0.5 for s in good))
    assert np.mean([[b > g for g in good] for b in bad]) > 0.9
    assert np.mean([g >= 0.5 for g in good]) < 0.05


def test_training_holds_no_copy_of_all_bags():
    """Beside the bags themselves, which it takes over, training before its first update holds little: no joined copy of them."""
    import tracemalloc

    rng = np.random.default_rng(2)
    bags = [(np.sort(rng.choice(toxicity.BUCKETS, 2000, replace=False)).astype(np.int32), np.ones(2000, np.float32)) for _ in range(2000)]
    held = sum(b.nbytes + w.nbytes for b, w in bags)
    tracemalloc.start()
    toxicity.train_bags(bags, np.arange(2000) % 2, updates=1, batch=8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not bags and peak < held + (40 << 20), (peak, held)
