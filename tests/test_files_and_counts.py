"""Files against a reference set, counts on the way, progress of streams, keywords by a caller's model, resumption."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import functions as F

from lectern.operators import ops, outputs, quality, scoring
from lectern.sources.files import list_files
from lectern.streaming.progress import Progress


def test_sources_missing_of_another_size_or_content(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.mp4", b"one"), ("b.mp4", b"four"), ("c.mp4", b"same size"), ("d.mp4", b"plain")):
        (tmp_path / "in" / name).write_bytes(body)
    plain, hashed = list_files(spark, f"{tmp_path}/in"), list_files(spark, f"{tmp_path}/in", hashed=True)
    assert plain.columns == ["path", "bytes", "mtime"] and hashed.where("path like '%/a.mp4'").first()["sha256"] == hashlib.sha256(b"one").hexdigest()
    base = plain.first()["path"].rsplit("/", 1)[0]
    good = hashlib.sha256(b"one").hexdigest()
    rows = [("a.mp4", 3, good), ("b.mp4", 5, None), ("c.mp4", 9, good), ("d.mp4", 5, None), ("e.mp4", 1, good)]
    episodes = spark.createDataFrame([(f"{base}/{n}", s, h) for n, s, h in rows], "path string, size_bytes long, sha256 string")
    found = lambda *a: sorted((r["path"].rsplit("/", 1)[1], r["problem"]) for r in ops.source_check(episodes, *a).collect())
    assert found(plain) == [("b.mp4", "size"), ("e.mp4", "missing")]
    assert found(hashed, True) == [("b.mp4", "size"), ("c.mp4", "sha256"), ("e.mp4", "missing")]


def test_the_folder_against_its_limit(spark):
    files = spark.createDataFrame([("u/a", 1 << 30), ("u/b", 1 << 30), ("u/c", 3 << 20)], "path string, bytes long")
    freed = spark.createDataFrame([("u/a",)], "input_source string")
    got = ops.cleanup_summary(spark.range(4), freed, files, 1.0).first().asDict()
    assert got == {"jobs_cleaned": 4, "files": 1, "bytes": 1 << 30, "mb_hundredths": 102_400, "uploads_bytes": (1 << 30) + (3 << 20), "uploads_gb_hundredths": 100, "over_limit": True}
    assert not ops.cleanup_summary(spark.range(4), freed, files, 1.1).first()["over_limit"]


def test_counts_before_and_after_without_a_scan(spark):
    clips = spark.range(100).select((F.col("id") * 10).alias("score_pm")).union(spark.sql("select cast(null as bigint)"))
    kept, seen = scoring.counted_score_filter(clips, 450)
    assert kept.count() == 55 and seen.get == {"before": 101, "after": 55}


def test_progress_is_told(spark, tmp_path):
    told = []
    listener = Progress(lambda *x: told.append(x))
    spark.range(5).write.parquet(f"{tmp_path}/in")
    spark.streams.addListener(listener)
    try:
        query = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("noop").queryName("five").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if told and told[-1][1] == "completed":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told == [("five", "started", 0), ("five", "progress", 5), ("five", "completed", 5)]


def test_keywords_by_a_model_of_the_caller(spark):
    segments = spark.createDataFrame([(1, 1, "c d Apple"), (1, 0, "Big apple, a pie."), (2, 0, "x y")], "video_id long, ord long, text string")
    assert sorted(tuple(r) for r in outputs.keyword_candidates(segments).collect()) == [(1, "apple"), (1, "apple pie"), (1, "big"), (1, "big apple"), (1, "pie"), (1, "pie apple")]
    embed = lambda texts: [[t.lower().count("apple"), t.lower().count("pie")] for t in texts]
    got = [(r["term"], r["rank"]) for r in outputs.keywords(segments, embed, 5).orderBy("rank").collect()]
    # The whole text is (2, 1): apple and big apple are (1, 0), the pairs with pie (1, 1), pie (0, 1), big (0, 0).
    assert got == [("apple pie", 1), ("pie apple", 2), ("apple", 3), ("big apple", 4), ("pie", 5)]


def test_keywords_shuffle_no_term(spark, monkeypatch):
    """Only segments are dealt, once; equal cosines, zero vectors and several slices of recordings rank as the operator says."""
    monkeypatch.setattr(outputs, "TERMS_AT_ONCE", 3)
    segments = spark.createDataFrame([(v, 0, "aa bb cc dd" if v % 2 else "zz aa") for v in range(6)] + [(6, 0, "x y")], "video_id long, ord long, text string")
    found = outputs.keywords(segments, lambda texts: [[float(t.count("a")), 0.0] for t in texts], 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(r for v in range(6) for r in [(v, "aa", 1), (v, "aa bb" if v % 2 else "zz aa", 2)])


def test_videos_without_artifacts_resume_at_the_first_stage(spark):
    rules = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", True), (2, "b", True)], "video_id long, artifact string, ok boolean")
    videos = spark.createDataFrame([(1,), (2,), (3,)], "video_id long")
    plan = lambda *a, **k: sorted(tuple(r) for r in quality.resume_plan([(0, "a"), (1, "b")], rules, *a, **k).collect())
    assert plan() == [(1, 1)] and plan(videos) == [(1, 1), (3, 0)] and plan(videos, force=True) == [(1, 0), (2, 0), (3, 0)]
