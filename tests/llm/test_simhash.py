from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lectern.llm import components, simhash


def brute_print(text, width=4):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_groups(values, linked):
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints(edge_rows):
    for row in edge_rows:
        assert simhash.fingerprint(row[1]) & (1 << 64) - 1 == brute_print(row[1])


def test_links_connect_what_brute_force_connects(spark):
    r = random.Random(1)
    near = lambda v, n: v ^ sum(1 << b for b in r.sample(range(64), n))
    seeds = [r.getrandbits(64) for _ in range(40)]
    values = {0, *seeds, *(near(s, r.randint(1, 9)) for s in seeds for _ in range(4)), *(near(seeds[0], 2) for _ in range(200))}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    root = {x["node"]: x["root"] for x in components.components(simhash.links(df)).collect()}
    got = [root.get(v, v) for v in signed]
    want = brute_groups(values, lambda a, b: bin(a ^ b).count("1") <= 4)
    same = lambda labels: {tuple(i for i, x in enumerate(labels) if x == y) for y in set(labels)}
    assert same(got) == same(want)


def test_chain_holds_every_pair():
    r = np.random.default_rng(2)
    for _ in range(500):
        x = np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(1, 5), replace=False)))
        assert any(simhash._viable(np.array([x]), np.array([i]))[0] for i in range(5))


def test_documents(edges, clashing, nothing, edge_rows):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(edges).collect())
    prints = [brute_print(r[1]) for r in edge_rows]
    groups = brute_groups(prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {g: min(edge_rows[i][0] for i in range(len(groups)) if groups[i] == g and edge_rows[i][0] is not None) for g in set(groups)}
    assert got == sorted((r[0] is None, r[0] or 0, least[g]) for r, g in zip(edge_rows, groups))
    assert simhash.near_duplicates(clashing).count() == len(edge_rows)
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_first(clashing)
    assert kept.columns == clashing.columns and kept.where("doc_id is null").count() == 0
    rows = [r["doc_id"] for r in kept.collect()]
    assert set(rows) >= {0, 3, 4, 5, 11} and not {1, 2, 6, 7, 8} & set(rows) and len(rows) == len(set(rows))


def test_rows_go_by_text_not_by_id(spark):
    text = "this is a text of more than five words in all"
    other = "here stands quite another one of as many words as that"
    rows = [(1, text), (5, text), (5, other), (5, other), (None, other), (None, "alone"), (7, None), (8, "")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept.collect()) == [(0, "alone"), (1, text), (5, other), (7, None)]


def test_crowded_keys_are_divided(spark, monkeypatch):
    """A third of the fingerprints share the first two segments: half of those at random, half in one dense group."""
    monkeypatch.setattr(simhash, "SAMPLED", 4)
    monkeypatch.setattr(simhash, "CROWD", 8)
    r = random.Random(11)
    base, low = r.getrandbits(64), (1 << 26) - 1
    values = {r.getrandbits(64) for _ in range(800)} | {r.getrandbits(64) & ~low | base & low for _ in range(200)}
    values |= {base ^ (1 << r.randrange(26, 64)) ^ (1 << r.randrange(26, 64)) for _ in range(200)}
    values |= {v ^ 3 << 40 for v in list(values)[:60]}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    keys = simhash.chain_keys(fps)
    assert simhash._divided(keys).count() > keys.count()
    root = {x["node"]: x["root"] for x in components.components(simhash.links(fps)).collect()}
    got = [root.get(v, v) for v in signed]
    want = brute_groups(signed, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 4)
    same = lambda labels: {tuple(i for i, x in enumerate(labels) if x == y) for y in set(labels)}
    assert same(got) == same(want)


def test_components_of_long_paths(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


def brute_similar(rows, width=5):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    groups = brute_groups(sets, lambda a, b: a == b or (a | b) and 5 * len(a & b) >= 4 * len(a | b))
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if groups[j] == groups[i]) for i in range(len(rows))}


def test_stage_finds_what_brute_force_jaccard_finds(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    rows = []
    for n in [*range(5, 40), *[120] * 40]:
        base = [word() for _ in range(n)]
        rows.append(base)
        for edits in (1, 2, 3):  # each changes five shingles at most
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(n)] = word()
            rows.append(copy)
        rows.append(base[: n - n // 10] + [word()])
    base = [word() for _ in range(100)]
    for _ in range(120):  # a run longer than PARTNERS
        copy = list(base)
        copy[r.randrange(100)] = word()
        rows.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    r.shuffle(rows)
    got = {x["doc_id"]: x["component"]["doc_id"] for x in simhash.similar_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = brute_similar(rows)
    assert got == want and len(set(want.values())) < len(rows) / 2
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(want.values()))


def test_crowded_bands_lose_no_link(spark, monkeypatch):
    """Texts around one passage share bands without being similar; among them are pairs, a chain, and groups by size."""
    monkeypatch.setattr(simhash, "PARTNERS", 0)
    monkeypatch.setattr(simhash, "BLOCK_HASHES", 1 << 12)
    r = random.Random(17)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    passage = [word() for _ in range(150)]
    rows = []
    for i in range(150):
        own = [word() for _ in range(45 + i % 40)]
        rows.append(passage + own)
        if i % 5 == 0:  # about 0.9 of the whole, at the other side of the run as likely as not
            rows.append(passage + own[:-3] + [word()])
        if i % 25 == 0:  # a chain whose ends are not similar
            rows += [passage + own + [word() for _ in range(k)] for k in (20, 40, 60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component"]["doc_id"] for x in simhash.similar_copies(docs).collect()}
    want = brute_similar(rows)
    assert got == want and 100 < len(set(want.values())) < len(rows)


def test_one_crowd_is_compared_whole(spark):
    """All sets under one key and nothing linked before: the blocks alone find what brute force finds."""
    r = random.Random(19)
    passage = [r.getrandbits(62) for _ in range(120)]
    sets = []
    for i in range(60):
        own = [r.getrandbits(62) for _ in range(40 + i)]
        sets += [passage + own] + ([passage + own[:-4]] if i % 4 == 0 else [])
    rows = list(enumerate(sets))
    crowds = spark.createDataFrame([(1, i, len(x)) for i, x in rows], "key long, node long, n long")
    hashes = spark.createDataFrame(rows, "want long, hashes array<long>")
    sure = spark.createDataFrame([], "u long, v long")
    root = {x["node"]: x["root"] for x in components.components(simhash.crowd_links(crowds, hashes, sure, 1 << 11)).collect()}
    want = brute_groups([set(x) for x in sets], lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    assert [root.get(i, i) for i, _ in rows] == want and 30 < len(set(want)) < len(sets)


def _pairs_of_runs(rows, partners):
    out, runs = set(), {}
    for key, node, n in rows:
        runs.setdefault(key, []).append((node, n))
    for run in runs.values():
        for k, (v, nv) in enumerate(run):
            near = run[max(0, k - partners) : k] + ([run[0]] if k > partners else [])
            out |= {(u, v) for u, nu in near if min(nu, nv) * 5 >= max(nu, nv) * 4 and u != v}
    return out


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_runs_over_batches(size):
    """Runs that go on over many batches give the pairs of one batch."""
    r = random.Random(size)
    rows, node = [], 0
    for key, length in enumerate([1, 2, 5, 60, 3, 200, 1, 1, 40]):
        for _ in range(length):
            rows.append((key * 7 - 20, r.choice([node, r.randrange(50)]), r.choice([100, 110, 130])))
            node += 1
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], ["key", "node", "n"]) for i in range(0, len(rows), size)]
    got = [(u, v) for b in simhash._candidate_runs(iter(batches), 6) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert set(got) == _pairs_of_runs(rows, 6)


def test_a_long_run_in_little_memory():
    """3 x 10^5 sets in one band: what is held does not grow with the run."""

    def batches():
        for k in range(30):
            ids = np.arange(k * 10_000, (k + 1) * 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(10_000, np.int64)), pa.array(ids), pa.array(np.full(10_000, 300))], ["key", "node", "n"])

    tracemalloc.start()
    n = sum(b.num_rows for b in simhash._candidate_runs(batches(), 48))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 300_000 * 48 - 49 * 48 and most < 50e6


def test_divided_runs_lose_no_link(spark, monkeypatch):
    """A band of 120 sets in parts of 30: groups are those of one run."""
    base = [f"w{i}" for i in range(80)]
    df = spark.createDataFrame([(i, " ".join(base[:70] + [f"x{i % 40}y{k}" for k in range(8)] + base[70:])) for i in range(120)], "doc_id long, text string")
    group = lambda: sorted((r["doc_id"], r["component"]["doc_id"]) for r in simhash.similar_copies(df).collect())
    whole = group()
    monkeypatch.setattr(simhash, "SPLIT_ROWS", 30)
    assert group() == whole
