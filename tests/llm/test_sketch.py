from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import registry, sketch
from lectern.llm.common import table

from ..conftest import SMALL


def brute(text, width=sketch.WIDTH):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]

    def chained(parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode(), h)
        return h - (1 << 64) if h >> 63 else h

    if len(words) < width:
        hashes = {chained([" ".join(words)])} if words else set()
    else:
        hashes = {chained(words[i : i + width]) for i in range(len(words) - width + 1)}
    return sorted(h for h in hashes if h < -(1 << 63) + (1 << 64) // sketch.FRACTION)


def likeness(a, b, x, y):
    if x == y:
        return 1.0
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0


def spelled(hashes):
    return "".join(f"{h & (1 << 64) - 1:016x}" for h in hashes)


def contained(spark, a, b):
    of = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<long>")
    return spark.range(1).select(sketch.containment(of(a), of(b))).first()[0]


def test_sketches(spark, edges, edge_rows, clashing, nothing):
    got = {(r["doc_id"], r["text"]): r["sketch"] for r in sketch.fingerprints(edges).collect()}
    assert got == {(i, t or ""): brute(t) for i, t, *_ in edge_rows}
    assert (contained(spark, [], []), contained(spark, [], [1]), contained(spark, [1, 2], [2, 3, 4]), contained(spark, [1], [1])) == (None, None, 0.5, 1.0)
    assert sketch.fingerprints(nothing).count() == 0 and sketch.fingerprints(clashing).columns == clashing.columns


def test_short_texts_in_a_long_one(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(5000)]
    excerpts = [" ".join(words[i : i + 7]) for i in r.sample(range(4990), 200)]
    df = spark.createDataFrame([(t,) for t in excerpts], "t string").select(sketch.sketch(F.col("t")).alias("a"), sketch.sketch(F.lit(" ".join(words))).alias("b"))
    values = [x[0] for x in df.select(sketch.containment(F.col("a"), F.col("b"))).collect()]
    assert set(values) == {1.0, None} and values.count(None) < 60  # (1 - 1/2) ** 3 of them are unknown


def test_merged_sketches(spark):
    texts = ["a b c d e f g h", "x y z u v w p q r", ""]
    row = spark.createDataFrame([tuple(texts)], "a string, b string, c string").select(*[sketch.sketch(F.col(c)).alias(c) for c in "abc"])
    both, one = row.select(sketch.merged(F.col("a"), F.col("b")), sketch.merged(F.col("a"), F.col("c"))).first()
    assert both == sorted({*brute(texts[0]), *brute(texts[1])}) and one == brute(texts[0])


@pytest.mark.parametrize("ids", [[5], [1, 2, 3], [0, 1000, 1001, 10**12], list(range(3000)), [*range(20_000), 10**15]])
def test_next_rows(spark, ids):
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    out = sketch.with_next(df, ["text"])
    assert {r["doc_id"]: r["next_text"] for r in out.collect()} == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}


def test_parts_are_even_though_ids_are_not(spark):
    """A far id does not put all others into one part."""
    df = spark.createDataFrame([(i,) for i in [*range(50_000), 10**15]], "doc_id long").repartition(4)
    seen = []
    sketch.with_next(df, [], lambda rows: seen.append(rows) or rows)
    sizes = [r["count"] for r in seen[0].groupBy("_next_part").count().collect()]
    assert len(sizes) > 90 and max(sizes) < 700


def test_next_of_edges(spark, edges, edge_rows, clashing, nothing):
    assert sketch.with_next(nothing, ["text"]).count() == 0
    named = clashing.withColumns({n: F.lit(-1) for n in ("_id", "_part", "_copy", "next_text", "edited")})
    out = sketch.edited(sketch.with_next(named, ["text", "sketch"], sketch.fingerprints))
    rows = out.collect()
    assert len(rows) == len(edge_rows) and out.where("_id = -1 and _part = -1 and fp = -1").count() == len(rows)
    assert all(r["next_text"] is None and r["edited"] == r["text"][: len(r["text"]) - len(r["text"]) // 2] for r in rows if r["doc_id"] is None)
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    assert {r["next_text"] for r in sketch.with_next(twice, ["text"]).where("doc_id = 2").collect()} <= {"a", "b"}


def test_op4(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    ids = sorted(texts)
    got = registry.QUERIES["op4_fingerprints"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == ids
    for r in got:
        mine, after = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        half = len(mine) // 2
        edited = mine[: len(mine) - half] + after[:half]
        a, b, c = brute(mine), brute(edited), brute(after)
        want = (len(mine), hashlib.sha256(edited.encode()).hexdigest(), spelled(a), spelled(b), likeness(a, b, mine, edited), likeness(a, c, mine, after))
        assert tuple(r[k] for k in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) == want
