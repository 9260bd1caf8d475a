"""Readers on files that the tests write."""

from __future__ import annotations

import json

from lectern.operators import evaluation
from lectern.sources import evaluation_sets as R


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def reference(tmp_path):
    piece = lambda a, b, c, d: {"source_start": a, "source_end": b, "short_start": c, "short_end": d}
    data = {
        "episodes": {"E1": {"path": "/v/1", "title": "One", "duration_sec": 99.5, "size_bytes": 10, "sha256": ""}, "E2": {"path": "/v/2", "duration_sec": 5}},
        "shorts": [
            {"id": "a", "episode": "E1", "pieces": [piece(100, 110, 0, 10), piece(120.25, 130, 10, 19.75)], "structure": {"montage": False, "reordered": True, "source_span": [100, 130]}},
            {"id": "b", "episode": "E2", "pieces": [piece(1, 2, 0, 1)]},
            {"id": "c", "episode": "E1", "pieces": [], "structure": {"montage": True}},
        ],
        "pipeline_clip_labels": [{"episode": "E2", "clip_id": "clip_001", "source_start": 0.5, "source_end": 3, "label": "keep"}],
    }
    (tmp_path / "set.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "broken.json").write_text("{nothing")


def test_reference_sets(spark, tmp_path):
    reference(tmp_path)
    t = R.read_reference_sets(spark, str(tmp_path))
    assert rows(t["episodes"], "file", "episode", "duration_ms", "bytes", "sha256") == [("set.json", "E1", 99_500, 10, None), ("set.json", "E2", 5000, None, None)]
    assert rows(t["shorts"], "episode", "short_no", "short_id", "montage", "reordered", "span_start_ms") == [("E1", 0, "a", False, True, 100_000), ("E1", 1, "c", True, False, None), ("E2", 0, "b", False, False, None)]
    assert rows(t["pieces"], "episode", "short_no", "piece", "source_start_ms", "short_end_ms") == [("E1", 0, 0, 100_000, 10_000), ("E1", 0, 1, 120_250, 19_750), ("E2", 0, 0, 1000, 1000)]
    assert rows(t["labels"], "episode", "clip_id", "start_ms", "end_ms", "label") == [("E2", "clip_001", 500, 3000, "keep")]


def test_runs_feed_the_evaluation(spark, tmp_path):
    (tmp_path / "sets").mkdir()
    reference(tmp_path / "sets")
    run = {"format": 1, "label": "x", "episodes": {"E1": {"clips": [{"clip_id": "clip_000", "start_time": 99, "end_time": 111, "score": 0.5}, {"id": "clip_001", "start": 120, "end": 131.5, "title": "t"}], "reviews": {"clip_000": "keep"}}, "E2": {}}}
    (tmp_path / "runs").mkdir()
    for name, body in (("first", json.dumps(run)), ("old", json.dumps(run | {"format": 0})), ("bad", "[")):
        (tmp_path / "runs" / f"{name}.json").write_text(body)
    t = R.read_runs(spark, str(tmp_path / "runs"))
    assert rows(t["runs"], "run", "readable") == [("bad", False), ("first", True), ("old", False)]
    assert rows(t["clips"], "run", "episode", "clip_no", "clip_id", "start_ms", "end_ms", "title", "score") == [("first", "E1", 0, "clip_000", 99_000, 111_000, "", 0.5), ("first", "E1", 1, "clip_001", 120_000, 131_500, "t", 0.0)]
    assert rows(t["reviews"], "run", "episode", "clip_id", "status") == [("first", "E1", "clip_000", "keep")]
    sets = R.read_reference_sets(spark, str(tmp_path / "sets"))
    best = evaluation.best_covering_clip(evaluation.coverage(t["clips"], sets["pieces"], "episode"), sets["shorts"], "episode")
    assert rows(best.fillna(-1), "episode", "short_no", "clip_no", "covered_pm") == [("E1", 0, 0, 506), ("E1", 1, -1, 0), ("E2", 0, -1, 0)]


def test_clip_metadata(spark, tmp_path):
    for name, body in (("clip_001.mp4", "x"), ("clip_000.mp4", "x"), ("clip_002.mp4", "x"), ("other.mp4", "x"), ("clip_000.meta.json", '{"title": "A", "n": 3}'), ("clip_001.meta.json", "{broken"), ("clip_009.meta.json", "{}")):
        (tmp_path / name).write_text(body)
    got = {r["clip_id"]: r["meta"] for r in R.read_clip_metadata(spark, str(tmp_path)).collect()}
    assert got == {"clip_000": {"title": "A", "n": "3"}, "clip_001": {}, "clip_002": {}}
