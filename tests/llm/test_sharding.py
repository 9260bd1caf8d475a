from __future__ import annotations

import random
import zlib

from lectern.llm import sharding as S


def test_tree_against_a_list():
    r, tree, plain = random.Random(4), S.CapacityTree(), []
    for _ in range(3000):
        if plain and r.random() < 0.45:
            k = r.choice(plain)
            plain.remove(k)
            tree.remove(k)
        else:
            k = (r.randrange(500), r.randrange(10_000))
            if k not in plain:
                plain.append(k)
                tree.add(k)
        q = (r.randrange(520), -1)
        assert tree.ceiling(q) == min((k for k in plain if k >= q), default=None)


def brute_best_fit(sizes, bins, capacity):
    room = [capacity] * bins
    for s in sorted(sizes, reverse=True):
        fits = [(room[b], b) for b in range(bins) if room[b] >= s]
        if not fits:
            return None
        room[min(fits)[1]] -= s
    return sorted(room)


def test_histogram_equals_one_at_a_time():
    r = random.Random(5)
    for _ in range(200):
        sizes = [r.randint(1, 30) for _ in range(r.randint(1, 60))]
        bins, capacity = r.randint(1, 6), r.randint(20, 300)
        classes = sorted({(s, sizes.count(s)) for s in sizes}, reverse=True)
        got, want = S.best_fit(classes, bins, capacity), brute_best_fit(sizes, bins, capacity)
        assert (got is None) == (want is None)
        if got is not None:
            room = [capacity] * bins
            for s, b, n in got:
                room[b] -= s * n
            assert sorted(room) == want


def check(rows, texts, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots))) and 0 <= s < shards
    by_text = {}
    for r in rows:
        assert by_text.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]


def test_documents(edges, edge_rows, clashing, nothing):
    check(S.shard(edges, 4).collect(), [(r[0], r[1]) for r in edge_rows], 4)
    assert S.shard(clashing, 1).count() == len(edge_rows)
    assert S.shard(nothing).count() == 0


def test_sizes_near_equal(spark):
    from lectern.llm.common import table

    from ..conftest import SMALL

    docs = table(spark, SMALL, "documents")
    rows = S.shard(docs, 5).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 5)
    total = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(5)]
    assert max(total) < 1.02 * sum(total) / 5


def test_hot_groups_leave_the_others_near_equal(spark):
    r = random.Random(6)
    sizes = [r.randint(50, 400) for _ in range(4000)]
    for hot in ([sum(sizes) // 2], [sum(sizes) // 15], [sum(sizes) // 2] * 2 + [sum(sizes) // 20]):
        both = sizes + hot
        out = S.assign(sorted({(s, both.count(s)) for s in both}), 24)
        placed, room = [], [0] * 24
        for s, b, n in out:
            placed += [s] * n
            room[b] += s * n
        rest = sorted(room)[: 24 - len(hot)]
        assert sorted(placed) == sorted(both) and sorted(room)[24 - len(hot) :] == sorted(hot)
        assert max(rest) < 1.01 * sum(sizes) / len(rest)
    assert S.assign([(9, 1)], 3) == [(9, 2, 1)] and sorted(b for _, b, _ in S.assign([(9, 2)], 1)) == [0]
    texts = ["".join(r.choices("abcdef", k=r.randint(20, 90))) for _ in range(1200)]
    texts += ["copy" * 10] * (sum(len(t) + 8 for t in texts) // 2 // 48)
    rows = S.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    check(rows, list(enumerate(texts)), 24)
    total = sorted(sum(x["size"] for x in rows if x["shard"] == s) for s in range(24))
    assert total[22] < 1.05 * sum(total[:23]) / 23 and total[0] > 0.8 * sum(total[:23]) / 23
