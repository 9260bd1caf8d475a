from __future__ import annotations

import numpy as np
import pytest

from lectern.llm import ann


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 24)).astype("float32")
    v[100:130] = v[100]
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] * 24), (905, [1.0, 2.0]), (None, [1.0] * 24), (906, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 10 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    assert set(got) == set(range(0, 700, 10))
    hits = 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(700), -np.round(s, 12)))[:5]
        hits += len(set(want) & {f[1] for f in found})
        assert [f[0] for f in sorted(found)] == [1, 2, 3, 4, 5] and all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
    assert hits >= 0.9 * 5 * len(got)
    assert [f[1] for f in sorted(got[100])] == [101, 102, 103, 104, 105]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_scan_abandons_none_of_the_nearest():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(64, 5000)), rng.normal(size=64)
    near = ((x - q[:, None]) ** 2).sum(axis=0)
    assert len(set(np.argsort(near)[:6]) & set(ann.scan(x, q, 6))) >= 5
    r = ann.rotation(16)
    assert np.allclose(r @ r.T, np.eye(16), atol=1e-9)


def brute(vectors, queries, k=5):
    """(vec_id, vector) rows of one dimension -> {query: [(vec_id, score)]}."""
    ids, m = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], float)
    out = {}
    for q, v in queries:
        s = (m * v).sum(axis=1) / np.sqrt((m * m).sum(axis=1) * (np.array(v) ** 2).sum())
        s[ids == q] = -9
        best = np.lexsort((ids, -s))[: min(k, (ids != q).sum())]
        out[q] = [(int(ids[i]), s[i]) for i in best]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_repeated_and_mixed_rows(spark, kind):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)).astype("float32" if kind == "float" else "float64"))]
    rows += [rows[0]] * 3 + [rows[44]] * 2 + [(5, rows[6][1])]
    odd = [(100, [1.0, 2.0]), (105, [1.0] * 9), (110, [])]
    df = spark.createDataFrame(rows + odd, f"vec_id long, embedding array<{kind}>").repartition(3)
    first = {}
    for i, v in sorted(rows):
        first.setdefault(i, v)
    want = brute(rows, [(i, v) for i, v in first.items() if i % 5 == 0])
    got = {}
    for r in ann.search(df, df.where("vec_id % 5 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for q, found in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in found] and np.allclose([s for _, s in got[q]], [s for _, s in found], rtol=0, atol=1e-14)


def test_recall_with_fewer_probes_than_lists(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(6000, 32)).astype("float32")
    lists = int(np.sqrt(6000)) // 2
    assert max(ann.PROBE_LEAST, np.ceil(ann.PROBE_SHARE * lists)) < 0.7 * lists
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    hits = sum(r["vec_id"] in {i for i, _ in want[r["query_id"]]} for r in ann.search(df, df.where("vec_id % 50 = 0")).collect())
    assert hits >= 0.9 * 5 * len(want)


def test_very_small_and_large_components(spark):
    """Squares that underflow or overflow: the direction counts alone."""
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 8)))]
    times = lambda v, x: (np.array(v) * x).tolist()
    plain = rows + [(50, rows[3][1]), (100, rows[4][1]), (150, rows[5][1])]
    tiny = [round(c / 2**20) * 5e-324 for c in times(rows[5][1], 2.0**40)]
    extreme = rows + [(50, times(rows[3][1], 1e-170)), (100, times(rows[4][1], 1e170)), (150, tiny)]
    want = brute(plain, [r for r in plain if r[0] % 50 == 0])
    df = spark.createDataFrame(extreme, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for q, found in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in found] and np.allclose([s for _, s in got[q]], [s for _, s in found], rtol=0, atol=1e-5)
