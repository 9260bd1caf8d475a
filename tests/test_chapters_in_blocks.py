"""Blocks that begin where the chapter before them did, against a replay recording by recording."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lectern.operators import chapters as C

SEGMENTS = "video_id long, ord long, start_ms long, end_ms long, text string"


def answers(v, i):
    """What is said of a segment: no chapter, one at another time, one without a title."""
    k = (i * 7 + v * 3) % 11
    return (i * 1000 + (i % 3) * 400, "" if k == 4 else f" T{i} ") if k in (0, 4, 9) else None


def replay(seg, budget):
    """Per recording: ask for a block, drop its last chapter if it may go on, begin again there."""
    out, idx, block = [], 0, 0
    while idx < len(seg):
        end, used = idx + 1, len(seg[idx][4].strip()) + 9
        while end < len(seg) and used + len(seg[end][4].strip()) + 9 <= budget:
            used += len(seg[end][4].strip()) + 9
            end += 1
        part, found = seg[idx:end], []
        said = [a for x in part if (a := answers(x[0], x[1])) and a[1].strip()]
        for k, (at, title) in enumerate(said):
            start = part[0][2] if k == 0 else min((x[2] for x in part), key=lambda s: (abs(s - at), s))
            if not found or start > found[-1][0]:
                found.append((start, title.strip()))
        if not found:
            return []
        after = end
        if end < len(seg) and len(found) > 1:
            carried = next(i for i in range(idx, end) if seg[i][2] >= found[-1][0])
            if carried > idx:
                found, after = found[:-1], carried
        out += [(block, *c) for c in found]
        idx, block = after, block + 1
    return [(b, k, *c) for k, (b, *c) in enumerate(out)]


def test_against_a_replay(spark):
    r = random.Random(2)
    rows = [(v, i, i * 1000, i * 1000 + 900, "x" * r.choice([0, 10, 60])) for v in range(12) for i in range(r.choice([1, 5, 40, 80]))]
    said = [(v, i, *a) for v, i, *_ in rows if (a := answers(v, i))]
    table = spark.createDataFrame(said, "v long, o long, at_ms long, title string")

    def find(block):
        return block.join(table, (F.col("video_id") == F.col("v")) & (F.col("ord") == F.col("o"))).select("video_id", "block_no", F.col("o").alias("point_no"), "at_ms", "title")

    got = {}
    for x in C.chapters_in_blocks(spark.createDataFrame(rows, SEGMENTS), find, 500).orderBy("video_id", "chapter_no").collect():
        got.setdefault(x["video_id"], []).append(tuple(x)[1:])
    want = {v: replay([x for x in rows if x[0] == v], 500) for v in range(12)}
    assert got == {v: c for v, c in want.items() if c} and any(c and c[-1][0] > 2 for c in want.values())
    assert C.chapters_in_blocks(spark.createDataFrame([], SEGMENTS), find).count() == 0


def test_only_open_recordings_go_on(spark, monkeypatch, tmp_path):
    """A round stores the rest of recordings that have more blocks, and no second copy of the block."""
    monkeypatch.setattr(C, "shared_folder", lambda _: str(tmp_path))
    rows = [(v, i, i * 1000, i * 1000 + 900, "x" * 60) for v in range(9) for i in range(40 if v == 8 else 3)]
    find = lambda b: b.where("ord % 4 = 0").select("video_id", "block_no", F.col("ord").alias("point_no"), F.col("start_ms").alias("at_ms"), F.lit("T").alias("title"))
    assert C.chapters_in_blocks(spark.createDataFrame(rows, SEGMENTS), find, 500).select("video_id").distinct().count() == 9
    rest = spark.read.parquet(str(tmp_path / "rest-1"))
    assert {r[0] for r in rest.select("video_id").distinct().collect()} == {8} and rest.count() < 40
