"""The pipeline's stage takes its links from SimHash fingerprints first."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import simhash


def test_stage_links_by_fingerprints(spark, monkeypatch):
    """Near copies are joined by their fingerprints alone, and such pairs are not made again from bands."""
    base = [f"w{i}" for i in range(900)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:-1] + ["x"])), (2, " ".join(["y"] + base)), (3, " ".join(base[:450])), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    close = simhash._fingerprint_pairs(simhash._signed_rows(docs, 5)).collect()
    assert len(close) == 2
    monkeypatch.setattr(simhash, "_candidate_runs", lambda batches, partners: iter(()))
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == [0, 3, 4]


def _run_of(sets, key=5):
    columns = [[key] * len(sets), list(range(len(sets))), [len(s) for s in sets], list(range(len(sets))), [simhash.parity(np.array(sorted(s), np.uint64)) for s in sets]]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.binary())], ["key", "node", "n", "near", "parity"])


def _given(batch, size):
    parts = (batch.slice(i, size) for i in range(0, batch.num_rows, size))
    return [(u, v) for b in simhash._candidate_runs(parts, 48) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]


@pytest.mark.parametrize("size", [7, 1000])
def test_a_crowd_gives_few_pairs(size):
    """Sets around one passage share a band: pairs that can't be similar are not given, and a group of near copies gets a few links each."""
    r = random.Random(23)
    new = lambda k: {r.getrandbits(64) for _ in range(k)}
    passage, base = new(60), new(120)
    assert _given(_run_of([passage | new(60) for _ in range(600)]), size) == []
    pairs = _given(_run_of([base | new(3) for _ in range(600)]), size)
    assert len(pairs) == len(set(pairs)) <= 49 * 24 + 551 * (simhash.LINKS + 1)
    assert {v for _, v in pairs} == set(range(1, 600))


def test_a_short_run_loses_no_similar_pair():
    r = random.Random(29)
    base = [r.getrandbits(64) for _ in range(200)]
    sets = [set(r.sample(base, r.randrange(150, 200))) for _ in range(48)]
    similar = {(i, j) for j in range(48) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    given = set(_given(_run_of(sets), 1000))
    assert similar <= given and 0 < len(similar) < len(given) <= 48 * 47 // 2
