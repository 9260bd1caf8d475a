"""Small cases with known answers, restated for tables of many recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chapters, evaluation, ops, quality, scoring, tracks, windows
from lectern.operators.answers import normalise_answers
from lectern.sources import transcripts


def rows(df):
    return [tuple(r) for r in df.collect()]


def regular(spark, n=60):
    return spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("ord"), (F.col("id") * 5500).alias("start_ms"), (F.col("id") * 5500 + 5000).alias("end_ms"), F.concat(F.lit("Sentence number "), "id", F.lit(".")).alias("text"))


def test_windows_cover_all_segments(spark):
    seg = regular(spark)
    w = windows.build_windows(seg, 60_000, 30_000).orderBy("window_no").collect()
    assert w[0]["first_ord"] == 0 and w[-1]["last_ord"] == 59
    assert all(b["first_ord"] <= a["last_ord"] + 1 and b["first_ord"] > a["first_ord"] for a, b in zip(w, w[1:]))


def test_one_long_segment_is_a_window(spark):
    seg = spark.createDataFrame([(1, 0, 0, 500_000, "a."), (1, 1, 500_100, 501_000, "b.")], "video_id long, ord long, start_ms long, end_ms long, text string")
    assert rows(windows.build_windows(seg).orderBy("window_no")) == [(1, 1, 0, 0), (1, 2, 1, 1)]


def test_selection_keeps_apart(spark):
    c = spark.createDataFrame([(1, 1, 0, 60_000, 900), (1, 2, 30_000, 90_000, 950), (1, 3, 61_000, 120_000, 800), (1, 4, 200_000, 260_000, 700), (1, 5, 300_000, 360_000, 200)], "video_id long, window_no long, start_ms long, end_ms long, score_pm long")
    assert [r["start_ms"] for r in windows.select_clips(c, 12, 300).orderBy("rank").collect()] == [30_000, 200_000]


def test_padding_stops_at_neighbours(spark):
    seg = spark.createDataFrame([(1, 0, 0, 10_000), (1, 1, 10_100, 20_000), (1, 2, 21_000, 30_000)], "video_id long, ord long, start_ms long, end_ms long")
    clip = spark.createDataFrame([(1, 1, 1, 10_100, 20_000)], "video_id long, first long, last long, start_ms long, end_ms long")
    assert rows(windows.pad_bounds(clip, seg).select("start_ms", "end_ms")) == [(10_000, 20_400)]


def test_coverage_and_iou(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 10_000), (1, 0, 20_000, 30_000)], "video_id long, short_no long, source_start_ms long, source_end_ms long")
    clips = spark.createDataFrame([(1, 0, 0, 30_000), (1, 1, 5000, 25_000), (1, 2, 0, 5000), (1, 3, 11_000, 19_000)], "video_id long, clip_no long, start_ms long, end_ms long")
    assert {r["clip_no"]: r["covered_pm"] for r in evaluation.coverage(clips, pieces).collect()} == {0: 1000, 1: 500, 2: 250}  # the last one touches no piece
    assert spark.range(1).select(evaluation.iou_pm(F.lit(0), F.lit(10), F.lit(5), F.lit(15))).first()[0] == 333


def test_shorts_of_recordings_without_clips_count(spark):
    """Two recordings with a short each, a clip in the first one only: the second is a miss, not absent."""
    pieces = spark.createDataFrame([(1, 0, 0, 10_000), (2, 0, 0, 10_000)], "video_id long, short_no long, source_start_ms long, source_end_ms long")
    clips = spark.createDataFrame([(1, 0, 0, 9000)], "video_id long, clip_no long, start_ms long, end_ms long")
    best = evaluation.best_covering_clip(evaluation.coverage(clips, pieces), pieces.select("video_id", "short_no"))
    assert rows(best.orderBy("video_id")) == [(1, 0, 0, 900), (2, 0, None, 0)]
    found = evaluation.find_shorts(best)
    total = evaluation.metrics(found, clips, clips.limit(0), found).where("video_id is null").first()
    assert (total["shorts"], total["hits"], total["hit_pm"]) == (2, 1, 500)
    assert rows(evaluation.missing_shorts(found)) == [(2, 0, 0, 1)]


def test_grid_starts_once(spark):
    track = spark.createDataFrame([(1, 0, 0), (1, 150, 30), (1, 330, 30)], "clip_id long, t_ms long, x long")
    assert rows(tracks.resample(track).orderBy("t_ms").select("t_ms", "x")) == [(0, 0), (100, 20), (200, 30), (300, 30)]


def test_rules_on_artifacts(spark):
    texts = [
        ("meta", '{"source": "a", "duration_sec": 2, "resolution": [1, 2], "fps": null}', 5), ("meta", '{"source": "a", "duration_sec": "2", "resolution": [1, 2], "fps": 1}', 4), ("meta", "[]", 2), ("meta", None, 0),
        ("transcript", '[{"start": 0, "end": 1, "text": ""}]', 5), ("transcript", "[1]", 2), ("transcript", "{", 1), ("scored", '[{"id": 1, "start": 0, "end": 1, "score": "x"}]', 4),
        ("crop", '[{"clip_id": 1, "start": 0, "end": 1, "frames": [], "fallback": true}]', 5), ("manifest", '{"total_clips": 0, "clips": []}', 5), ("manifest", '{"total_clips": 0.5, "clips": []}', 4), ("other", "{}", 2),
    ]
    df = spark.createDataFrame([(i, k, b) for i, (k, b, _) in enumerate(texts)], "video_id long, artifact string, body string")
    got = {r[0]: r[1] for r in quality.artifact_rules(df).groupBy("video_id").agg(F.count_if("ok")).collect()}
    assert got == {i: n for i, (_, _, n) in enumerate(texts)}


def test_terms_of_tags(spark):
    long = "terms:" + "x" * 12_000 + ",b"
    df = spark.createDataFrame([(["a", long],), (["a"],), (["terms:one"],)], "tags array<string>")
    assert [r["terms"] for r in quality.terms_of_tags(df).collect()] == [["x" * 12_000, "b"], [], ["one"]]


def test_text_flags(spark):
    cases = {"и вот": True, "То есть так": True, "Because of it": True, "The end.": False, "123": False, "Итак": False}
    df = spark.createDataFrame(list(cases.items()), "text string, want boolean")
    assert all(r[0] == r[1] for r in df.select(T.is_continuation(F.col("text")), "want").collect())
    flags = spark.createDataFrame([("Abc.",), ("… abc",), ("12",)], "text string").select(T.starts_sentence(F.col("text")), T.ends_sentence(F.col("text")))
    assert rows(flags) == [(True, True), (False, False), (True, False)]
    assert rows(spark.createDataFrame([("Привет мир",), ("hello",), ("12",)], "t string").select(T.language(F.col("t")))) == [("ru",), ("en",), ("unknown",)]


def test_cyrillic_markers(spark):
    seg = spark.createDataFrame([(1, 0, 0, 1000, "Производная — это предел. Почему это важно?")], "video_id long, ord long, start_ms long, end_ms long, text string")
    r = scoring.score_segments(seg, scoring.extract_terms(seg)).first()
    assert (r["definition_pm"], r["rhetorical_pm"]) == (500, 750) and "engaging" in r["tags"]


def test_merge_is_pairwise(spark):
    s = "video_id long, ord long, start_ms long, end_ms long, score_pm long, term_pm long, definition_pm long, rhetorical_pm long, self_pm long, self_contained boolean, tags array<string>"
    seg = spark.createDataFrame([(1, i, i * 10_000, i * 10_000 + 9000, v, v, 0, 0, 0, i != 1, [f"t{i % 2}"]) for i, v in enumerate((100, 200, 401))], s)
    r = scoring.merge_clips(seg, 60_000).first()
    assert (r["score_pm"], r["term_pm"], r["self_contained"], r["tags"], r["n_segments"]) == (401, 276, False, ["t0", "t1"], 3)  # (150 + 401) / 2 = 275.5, half to even


def test_single_key_equals_filtered(spark):
    a = regular(spark, 20)
    b = a.withColumn("video_id", F.lit(2).cast("long")).withColumn("text", F.lit("It is why."))
    both = rows(scoring.score_transcript(a.union(b), min_pm=0).where("video_id = 1").drop("tags"))
    assert sorted(both) == sorted(rows(scoring.score_transcript(a, min_pm=0).drop("tags")))


def test_answers_in_any_wrapping(spark):
    raw = [(1, '```json\n[{"id": "a"}]\n```'), (2, '<think>[2]</think>{"results": [{"id": "b"}]}'), (3, "no json"), (4, 'So: [{"id": "c"}] ok'), (5, "<think> [1]"), (6, None)]
    out = normalise_answers(spark.createDataFrame(raw, "k int, response string"))
    assert sorted((r["k"], r["id"], r["error"] is None) for r in out.collect()) == [(1, "a", True), (2, "b", True), (3, None, False), (4, "c", True), (5, None, False), (6, None, False)]


def test_thinning_and_blocks(spark):
    pts = spark.range(10).select(F.lit(1).alias("video_id"), F.col("id").alias("start_ms"))
    assert [r[0] for r in chapters.thin_evenly(pts, 4).select("start_ms").orderBy("start_ms").collect()] == [int(i * 2.5) for i in range(4)]
    seg = regular(spark, 5)
    assert rows(chapters.pack_blocks(seg, 1).orderBy("block_no")) == [(1, i, i, i) for i in range(5)]


def test_files(spark, tmp_path):
    (tmp_path / "talk.json").write_text('[{"id": "seg_0001", "start": 0.5, "end": 2, "text": "Hi.", "language": "en"}]')
    (tmp_path / "words.json").write_text('[{"id": "a", "start": 1, "end": 2, "text": "x y", "words": [{"word": "x", "start": 1, "end": 1.5}, {"word": "y", "start": 1.5, "end": 2}]}, {"id": "b", "start": 2, "end": 3, "text": "z"}]')
    got = rows(transcripts.read_transcripts(spark, f"{tmp_path}/*.json").orderBy("video", "ord"))
    assert got[0] == ("talk", 0, "seg_0001", 500, 2000, "Hi.", "en", None)
    assert [tuple(w) for w in got[1][7]] == [(1000, 1500, "x"), (1500, 2000, "y")] and got[2][7] is None
    lines = spark.createDataFrame([('{"event": "a", "job_id": 3, "k": 1}',), ("plain",), ("[1]",), (None,)], "value string")
    assert [(r["event"], r["extra"]) for r in transcripts.log_rows(lines).collect()] == [("a", {"k": "1"}), ("plain", {}), ("[1]", {}), (None, {})]


def test_fallback_prompts_and_review_terms(spark):
    chosen = spark.createDataFrame([(1, "clip_001", 0, 9, 800), (2, "clip_001", 0, 9, 800)], "video_id long, clip_id string, start_ms long, end_ms long, score_pm long")
    other = chosen.union(spark.createDataFrame([(3, "clip_001", 0, 9, 100)], chosen.schema))
    verdicts = spark.createDataFrame([(1, True), (2, False)], "video_id long, valid boolean")
    assert rows(windows.with_fallback(chosen, other, verdicts).select("video_id", "origin").orderBy("video_id")) == [(1, "windows"), (2, "heuristic"), (3, "heuristic")]
    prompts = spark.createDataFrame([(1, i, f"w{i}") for i in range(1, 4)], "video_id long, window_no long, prompt string")
    assert rows(windows.prompt_batches(prompts, "{{MIN_DURATION}}-{{MAX_DURATION}}: {{WINDOWS}}.", 2, 30_500, 60_000).orderBy("batch")) == [(1, 0, "30-60: w1\n\nw2."), (1, 1, "30-60: w3.")]
    clips = spark.createDataFrame([(1, 0, 760, ["terms:a,b,c,d", "x"]), (1, 1, 600, [])], "video_id long, clip_no long, score_pm long, tags array<string>")
    reviews = spark.createDataFrame([(1, 1, "keep")], "video_id long, clip_no long, status string")
    assert rows(ops.review_queue(clips, reviews).orderBy("clip_no")) == [(1, 0, "high", ["a", "b", "c"], "pending"), (1, 1, "medium", [], "keep")]
