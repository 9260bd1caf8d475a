"""Track segments and keyframes: cases with answers worked out by hand."""

from __future__ import annotations

from lectern.operators import camera, segments, tracks

BOX = "clip_id long, n long, t_ms long, x long, y long, w long, h long, conf_pm long"


def frames(spark, xs, clip=1):
    """A sample a second; None has no face, a pair is (x, w)."""
    rows = []
    for n, x in enumerate(xs):
        x, w = x if isinstance(x, tuple) else (x, 100)
        rows.append((clip, n, n * 1000, x or 0, 50, w, 100, 0 if x is None else 900))
    return spark.createDataFrame(rows, BOX)


def clips(spark, *rows):
    return spark.createDataFrame(list(rows), "clip_id long, start_ms long, end_ms long")


def segmented(spark, xs, cuts=None, **how):
    found = segments.track_segments(tracks.shots(frames(spark, xs)), clips(spark, (1, 0, len(xs) * 1000)), cuts and spark.createDataFrame([(1, c) for c in cuts], "clip_id long, cut_ms long"), **how)
    return [(r["start_ms"], r["end_ms"], r["cx"]) for r in found.orderBy("segment_no").collect()]


def test_short_groups_join_the_longer_neighbour(spark):
    at = [0, 5000, 6000, 9000, 10_000, 11_000]
    rows = spark.createDataFrame([(1, t, i) for i, t in enumerate(at)] + [(2, 300, 0), (2, 800, 1)], "clip_id long, t_ms long, shot_no long")
    got = segments.absorb_short(rows, clips(spark, (1, 0, 15_000), (2, 0, 1000)))
    # Spans 5, 1, 3, 1, 1, 4 s: shot 1 joins 0 (6), then 3 joins 2 (4), then 4 joins 2 (5; its neighbours have 4 and 4).
    want = {(1, 0): (0, 0), (1, 1): (0, 0), (1, 2): (1, 6000), (1, 3): (1, 6000), (1, 4): (1, 6000), (1, 5): (2, 11_000), (2, 0): (0, 0), (2, 1): (0, 0)}
    assert {(r["clip_id"], r["shot_no"]): (r["group_no"], r["start_ms"]) for r in got.collect()} == want


def test_neighbours_of_one_framing_join(spark):
    assert segmented(spark, [100] * 5 + [900] + [105] * 5) == [(0, 11_000, 155.0)]
    assert segmented(spark, [100] * 5 + [900] * 5) == [(0, 5000, 150.0), (5000, 10_000, 950.0)]
    assert segmented(spark, [100] * 3 + [900] + [100] * 3, min_ms=0) == [(0, 3000, 150.0), (3000, 4000, 950.0), (4000, 7000, 150.0)]
    assert segmented(spark, [None] * 4) == [(0, 4000, None)]


def test_boundaries_lie_on_cuts(spark):
    xs = [100] * 5 + [900] * 5
    assert segmented(spark, xs, [3400, 4200, 4700]) == [(0, 4700, 150.0), (4700, 10_000, 950.0)]
    assert segmented(spark, xs, [5500])[0] == (0, 5500, 150.0)
    # No cut within half a second of the step: the speaker walked, so it is one shot. Median of both places.
    assert segmented(spark, xs, [3500]) == [(0, 10_000, 550.0)]
    # A face twice as large is another framing, with or without a cut; a stretch without a face is not.
    assert [s[:2] for s in segmented(spark, [100] * 5 + [(900, 200)] * 5, [9900])] == [(0, 5000), (5000, 10_000)]
    assert segmented(spark, [100] * 5 + [None] * 3 + [100] * 4, [9900]) == [(0, 12_000, 150.0)]
    assert [s[:2] for s in segmented(spark, [100] * 5 + [None] * 3 + [(100, 200)] * 4, [9900])] == [(0, 8000), (8000, 12_000)]


def test_clip_without_samples(spark):
    got = segments.track_segments(tracks.shots(frames(spark, [100])), clips(spark, (1, 0, 1000), (7, 500, 900)))
    assert [tuple(r) for r in got.where("clip_id = 7").collect()] == [(7, 0, 500, 900, False, None, None)]


def test_keyframes_keep_corners_only(spark):
    line = lambda *xs: [(i, float(x)) for i, x in enumerate(xs)]
    cases = [line(*range(50)), line(*[0] * 10, *range(1, 11), *[10] * 10), line(0, 0.4, 0.5, 0), line(0, 0, 1, 0, 1, 0, 0), line(3, 9), line(5)]
    df = spark.createDataFrame([(i, t, t, x) for i, c in enumerate(cases) for t, x in c], "clip_id long, i long, t long, x double")
    got = {}
    for r in camera.simplify(df, 0.5).orderBy("clip_id", "i").collect():
        got.setdefault(r["clip_id"], []).append(r["t"])
    # The last but two: 2 is farthest from the line 0-6, then 3 from 2-6 (0.75), then 4 from 3-6; 1 and 5 are off by 0.5 only.
    assert got == {0: [0, 49], 1: [0, 9, 19, 29], 2: [0, 3], 3: [0, 2, 3, 4, 6], 4: [0, 1], 5: [0]}
