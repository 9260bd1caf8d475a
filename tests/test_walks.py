"""Blocks, windows and merged clips against loops, with segments in and out of order, and one long recording."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions.fold import rank_of, walk
from lectern.operators import chapters, scoring, windows

SEGMENTS = "video_id long, ord long, start_ms long, end_ms long, text string"
MEASURES = ["term_pm", "definition_pm", "rhetorical_pm", "self_pm"]


def segments(seed):
    r = random.Random(seed)
    out = []
    for v in range(6):
        at = 0
        for i in range(r.choice([1, 2, 30, 60])):
            at += r.choice([0, 500, 9000])
            long = r.choice([1000, 5000, 20_000, 200_000 if r.random() < 0.1 else 3000])
            out.append((v, i, at + (-r.randrange(3000) if seed % 2 else 0), at + long, "x" * r.choice([0, 5, 40, 300])))
    return out


def by_video(rows):
    return {v: sorted(r for r in rows if r[0] == v) for v in {r[0] for r in rows}}


def test_searches_and_walks(spark):
    df = spark.createDataFrame([([1, 3, 3, 7], 0), ([1, 3, 3, 7], 3), ([1, 3, 3, 7], 9), ([], 1)], "a array<int>, x int")
    assert [r[0] for r in df.select(rank_of(F.size("a"), lambda i: F.get("a", i), F.col("x"))).collect()] == [0, 3, 4, 0]
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([5, 9, 9, 9, 9],), ([2, 4, 4, 5, 5],), ([],)], "j array<int>")
    assert [r[0] for r in df.select(walk(F.col("j"), F.size("j"))).collect()] == [[0, 1, 2, 3, 4], [0], [0, 2, 4], []]


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_against_loops(spark, seed):
    rows = segments(seed)
    df = spark.createDataFrame(rows, SEGMENTS).repartition(3)
    blocks, made, merged = [], [], []
    r = random.Random(seed)
    marks = {(x[0], x[1]): (r.randrange(1000), *[r.randrange(1001) for _ in MEASURES], r.random() < 0.5, [r.choice("abc")]) for x in rows}
    for v, seg in by_video(rows).items():
        i = no = 0
        while i < len(seg):
            j, used = i + 1, len(seg[i][4].strip()) + 9
            while j < len(seg) and used + len(seg[j][4].strip()) + 9 <= 400:
                used += len(seg[j][4].strip()) + 9
                j += 1
            blocks.append((v, no, seg[i][1], seg[j - 1][1]))
            i, no = j, no + 1
        i, no = 0, 1
        while i < len(seg):
            last = i
            while last + 1 < len(seg) and seg[last + 1][3] - seg[i][2] <= 60_000:
                last += 1
            made.append((v, no, seg[i][1], seg[last][1]))
            if last == len(seg) - 1:
                break
            later = next((j for j in range(i + 1, len(seg)) if seg[j][2] >= seg[i][2] + 25_000), len(seg))
            i, no = min(later, last + 1), no + 1
        clips = []
        for x in sorted(seg, key=lambda x: (x[2], x[1])):
            m = marks[v, x[1]]
            if clips and max(clips[-1][1], x[3]) - clips[-1][0] <= 30_000:
                c = clips[-1]
                half = [(a + b) // 2 + ((a + b) % 2 and (a + b) // 2 % 2) for a, b in zip(c[3], m[1:5])]
                clips[-1] = (c[0], max(c[1], x[3]), max(c[2], m[0]), half, c[4] and m[5], list(dict.fromkeys(c[5] + m[6])), c[6] + 1)
            else:
                clips.append((x[2], x[3], m[0], list(m[1:5]), m[5], m[6], 1))
        merged += [(v, f"clip_{k:03d}", *c[:3], *c[3], c[4], tuple(c[5]), c[6]) for k, c in enumerate(clips, 1)]
    collect = lambda d: sorted(tuple(tuple(c) if isinstance(c, list) else c for c in x) for x in d.collect())
    assert collect(chapters.pack_blocks(df, 400)) == sorted(blocks)
    assert collect(windows.build_windows(df, 60_000, 25_000)) == sorted(made)
    scored = spark.createDataFrame([(*x[:4], *marks[x[0], x[1]]) for x in rows], f"video_id long, ord long, start_ms long, end_ms long, score_pm long, {', '.join(m + ' long' for m in MEASURES)}, self_contained boolean, tags array<string>")
    got = scoring.merge_clips(scored, 30_000).select("video_id", "clip_id", "start_ms", "end_ms", "score_pm", *MEASURES, "self_contained", "tags", "n_segments")
    assert collect(got) == sorted(merged)


def test_one_long_recording_in_proportion(spark):
    """Eight times the segments of one recording take far less than sixty-four times as long."""
    took = []
    for n in (12_500, 100_000):
        df = spark.range(n).select(F.lit(1).alias("video_id"), F.col("id").alias("ord"), (F.col("id") * 3000).alias("start_ms"), (F.col("id") * 3000 + 2900).alias("end_ms"), F.lit("some text").alias("text"))
        began = time.time()
        assert chapters.pack_blocks(df, 90).count() == n // 5
        assert windows.build_windows(df).agg(F.max("last_ord")).first()[0] == n - 1
        took.append(time.time() - began)
    assert took[1] < 25 * took[0]


def test_sentences_are_laid_out_without_a_shuffle(spark):
    """Times add up over many sentences of a text, with no exchange; blank parts and null texts have none."""
    from lectern.sources import views

    texts = [(1, "Ab cd. " * 700 + "x"), (2, None), (3, " . ! \n "), (4, "One.\n\n Two two? ")]
    got = views._sentences(spark.createDataFrame(texts, "video_id long, text string"), ["video_id"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in got.orderBy("video_id", "ord").collect():
        found.setdefault(r["video_id"], []).append((r["ord"], r["start_ms"], r["end_ms"], r["text"]))
    assert found[4] == [(0, 0, 640, "One."), (1, 740, 1620, "Two two?")] and 2 not in found
    assert len(found[1]) == 701
    at = 0
    for i, (o, a, b, t) in enumerate(found[1]):
        assert (o, a, b) == (i, at, at + 400 + 60 * len(t))
        at = b + 100


def test_candidates_carry_the_lines_they_reach(spark):
    """Of 2,000 lines of five seconds a candidate carries some tens, and is fitted as the rules say at either end of them."""
    lines = spark.range(2000).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("ord"), (F.col("id") * 5000).alias("start_ms"), (F.col("id") * 5000 + 4900).alias("end_ms"), F.lit("So it ends.").alias("text"))
    rows = [(1, k, a, b, 500, 500, 500, 500) for k, (a, b) in enumerate([(0, 2), (1000, 1001), (1990, 1999), (500, 560)])]
    cands = spark.createDataFrame(rows, "video_id long, window_no long, first long, last long, hook_pm long, complete_pm long, value_pm long, score_pm long")
    got = {r["window_no"]: (r["first"], r["last"], r["start_ms"], r["end_ms"]) for r in windows.fit_boundaries(cands, lines).collect()}
    assert got == {0: (0, 9, 0, 49_900), 1: (1000, 1009, 5_000_000, 5_049_900), 2: (1990, 1999, 9_950_000, 9_999_900), 3: (500, 517, 2_500_000, 2_589_900)}
