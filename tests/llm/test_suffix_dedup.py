from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm import suffix_dedup as S


@pytest.mark.parametrize("seed", range(60))
def test_merged_transforms(seed):
    r = random.Random(seed)
    length = r.choice([5, 9, 20, 40])
    base = [bytes(r.choices(b"ab" if seed % 2 else b"abcdefgh", k=r.randint(length, 4 * length))) for _ in range(4)]
    parts = []
    for _ in range(r.randint(1, 14)):
        x = bytearray(r.choice(base))
        if r.random() < 0.6:
            x[r.randrange(len(x))] = r.choice(b"abz\x00\xff")
        parts.append(bytes(x + r.choice(base) if r.random() < 0.3 else x))
    parts = list(dict.fromkeys(parts))
    seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
    got = S.repeated_windows(parts, length, r.choice([1, 2, 3, 4]))
    for p, flags in zip(parts, got):
        assert flags.tolist() == [seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


def agrees(got, rows):
    want = sorted((i is None, i or 0, k) for (i, _), k in zip(rows, brute([t for _, t in rows])))
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["kept"])) for r in got.collect()) == want


def test_documents(edges, edge_rows, clashing, nothing):
    assert agrees(S.remove_repeats(edges), [r[:2] for r in edge_rows])
    out = S.remove_repeats(clashing)
    assert agrees(out, [r[:2] for r in edge_rows]) and out.schema["spans"].dataType.typeName() == "array"
    assert out.where("fp = -1 and copy = -1 and _found = -1").count() == len(edge_rows)
    assert S.remove_repeats(nothing).count() == 0


def ragged(n, seed=9):
    """A passage in many texts, each with other words around it, some of them equal; and a text that repeats itself."""
    r = random.Random(seed)
    words = lambda k: "".join(r.choices("abcdefgh ", k=k))
    passage, rows = words(330), []
    for i in range(n):
        rows.append((i, rows[-1][1] if i % 9 == 8 else words(r.randint(0, 300)) + passage[r.randint(0, 3) :] + words(r.randint(0, 300))))
    return [*rows, (n, "ab" * 700), (n + 1, words(50) + passage[40:290] * 3)]


@pytest.mark.parametrize("bound", [1, 3000, S.NAME_BYTES])
def test_crowded_names(spark, monkeypatch, bound):
    """Names over the bound are settled by counting windows, the others by merged transforms; the result is one."""
    monkeypatch.setattr(S, "NAME_BYTES", bound)
    rows = ragged(70)
    assert agrees(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), rows)


def test_a_hot_name_is_no_hot_task(spark):
    """One passage in 20,000 texts: kinds of its names reach no merge, and its owners no single task of a join."""
    passage = "".join(random.Random(1).choices("abcdefgh ", k=260))
    rows = [(i, f"{i:09d}" + passage + f"{i * 7:09d}") for i in range(20_000)]
    out = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    # Digits next to the passage are alike in many texts, so a few of the ends go too.
    kept = {r["doc_id"]: (r["kept"].decode(), [(s["begin"], s["end"]) for s in r["spans"]]) for r in out.collect()}
    assert len(kept) == len(rows)
    for i, text in rows:
        left, ((a, b),) = kept[i]
        assert left == text[:a] + text[b:] and a <= 9 and b >= 269


def test_spans_are_maximal(spark):
    text = "x" * 150 + "".join(map(str, range(200)))
    docs = spark.createDataFrame([(1, text), (2, "head" + text[:260]), (3, text[300:])], "doc_id long, text string")
    spans = {r["doc_id"]: [(s["begin"], s["end"]) for s in r["spans"]] for r in S.remove_repeats(docs).collect()}
    assert spans == {1: [(0, 260), (300, 640)], 2: [(4, 264)], 3: [(0, len(text) - 300)]}


def test_cut_characters_go_whole(spark):
    raw = "é".encode()
    df = spark.createDataFrame([(bytearray(raw[1:] + b"ab" + raw[:1]),)], "kept binary")
    assert df.select(S.whole_characters(df["kept"])).first()[0] == "ab"


def test_windows_of_a_crowded_name_travel_packed(spark, monkeypatch):
    """One row for each slice of a batch's windows, not one for each window; every window in the slice of its checksum."""
    import numpy as np

    monkeypatch.setattr(S, "NAME_BYTES", 1)
    monkeypatch.setattr(S, "PART_BYTES", 4096)
    made, stored = {}, S.stored

    def kept(df, label):
        out = stored(df, label)
        if label == "parts":
            made["parts"] = out[0].where("slice is not null").collect()
        return out

    monkeypatch.setattr(S, "stored", kept)
    rows = ragged(70)
    assert agrees(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)), rows)
    windows = [np.frombuffer(r["windows"], np.int64) for r in made["parts"]]
    assert sum(map(len, windows)) > 10 * len(windows) and max(r["slice"] for r in made["parts"]) > 0
    where = {}
    assert all(where.setdefault((r["name"], w), r["slice"]) == r["slice"] for r, ws in zip(made["parts"], windows) for w in ws.tolist())
