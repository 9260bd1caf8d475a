"""What larger tables showed: each test fails on the code before its finding."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from lectern.operators import cues as U
from lectern.operators import outputs as P
from lectern.operators import scoring as S
from lectern.plans import ops_queries, scoring_queries

from .conftest import SMALL


def test_cleanup_summary_where_nothing_is_freed(spark, tmp_path):
    """One upload with an old finished job and a waiting one: the folder is summed although no file is freed."""
    con = duckdb.connect()
    con.execute("create table orders as select 5000 * k + 1 as o_orderkey, 1 as o_custkey, s as o_orderstatus, date '1995-01-01' as o_orderdate from (values (1, 'F'), (2, 'O')) t(k, s)")
    con.execute(f"copy orders to '{tmp_path}/orders.parquet'")
    got = ops_queries.QUERIES["cleanup_summary"](spark, str(tmp_path)).first()
    want = con.execute(ops_queries.SQL["cleanup_summary"]).fetchone()
    assert tuple(got) == want == (1, 0, 0, 0, 1037, 0, False)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_timed_in_their_rows(spark):
    segments = spark.createDataFrame([(1, 0, 0, 1000, "aa bbb\nc")], "video_id long, ord long, start_ms long, end_ms long, text string")
    plan = _plan(U.word_times(segments))
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_cues_of_clips_are_those_of_words(spark):
    """clip_cues against its three steps, with line breaks, cut clips, sentence ends and short tails."""
    r = random.Random(5)
    rows, at = [], 0
    for i in range(120):
        text = " ".join("".join(r.choices("abcdé", k=r.randrange(1, 12))) + r.choice(["", "", "", ".", "!", "\n", ' "']) for _ in range(r.randrange(1, 40)))
        rows.append((i % 3, i, at, at + 3000, text))
        at += 1000
    segments = spark.createDataFrame(rows, "video_id long, ord long, start_ms long, end_ms long, text string")
    clips = spark.createDataFrame([(v, k, 17_000 * k + 1234, 17_000 * k + 30_000) for v in range(4) for k in range(8)], "video_id long, clip_no long, start_ms long, end_ms long")
    want = U.cues(U.cue_numbers(U.words_in_clips(clips, U.word_times(segments))))
    got = U.clip_cues(clips, segments)
    assert sorted(got.collect()) == sorted(want.collect()) and got.where("cue_no > 1").count() > 50
    plan = _plan(U.clip_cues(clips, segments))
    assert plan.count("Exchange") == 2 and "Window" not in plan


def test_terms_are_counted_without_a_sort_by_term(spark):
    """Counts and first places are kept in hash tables; ties go by the first place, in whatever segment."""
    segments = spark.createDataFrame([(1, 1, "beta gamma delta"), (1, 0, "gamma that alpha"), (2, 70_000, "zeta zeta"), (2, 69_999, "iotas the abc")], "video_id long, ord int, text string")
    got = [tuple(r) for r in S.extract_terms(segments, 4).orderBy("video_id", "rank").collect()]
    assert got == [(1, "gamma", 10, 1), (1, "alpha", 5, 2), (1, "delta", 5, 3), (1, "that", 4, 4), (2, "zeta", 8, 1), (2, "iotas", 5, 2)]
    assert "SortAggregate" not in _plan(S.extract_terms(segments, 4))


def test_nearest_terms_do_not_shuffle_single_numbers(spark):
    """Vectors are joined whole, also those of unlike lengths; no exchange carries a row for each of their numbers."""
    terms = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "x")], "video_id long, term string")
    vectors = spark.createDataFrame([("a", [1, 0, 2]), ("b", [3, 1]), ("c", [0, 5, 1])], "term string, vector array<bigint>")
    got = [tuple(r) for r in P.nearest_terms(terms, vectors).orderBy("video_id", "rank").collect()]
    assert got == [(1, "c", 1), (1, "b", 2), (1, "a", 3), (2, "a", 1)]
    assert "posexplode" not in _plan(P.nearest_terms(terms, vectors))


def test_a_recording_is_scored_in_its_row(spark):
    """score_transcript deals segments and answers once and shuffles no term, score or clip; the same clips as step by step, also
    where segments lie within others, begin out of order or have no words, and answers come twice, late or for no segment."""
    r = random.Random(7)
    vocabulary = ["why", "gravity", "means", "it", "that", "curvature", "is", "почему", "это", "called", "important", "orbit", "?", "то", "есть"]
    lines, answers = [], []
    for v in range(9):
        at = 0
        for i in range(r.randrange(1, 60)):
            start = max(0, at + r.choice([0, 100, 100, -4000]))
            at = start + r.randrange(300, 40_000)
            lines.append((v, i, start, at + r.choice([0, 0, 30_000]), " ".join(r.choices(vocabulary, k=r.randrange(0, 14))) + "."))
            answers += [(v, i, k, r.choice(["n/a", "950", "120", None]), r.choice(["definition", "story", "", None]), r.randrange(1001)) for k in r.choice([[], [0], [1, 0], [None]])]
    answers += [(3, 999, 0, "900", "story", 900), (77, 0, 0, "900", "story", 900)]
    segments = spark.createDataFrame(lines, "video_id long, ord long, start_ms long, end_ms long, text string").repartition(3, "ord").localCheckpoint()
    answers = spark.createDataFrame(answers, "video_id long, ord long, answer_no long, llm_pm string, content_type string, virality_pm long").localCheckpoint()
    for given in (answers, None):
        scored = S.score_segments(segments, S.extract_terms(segments))
        scored = S.blend_answers(scored, given) if given is not None else scored
        want = S.top_clips(S.score_filter(S.duration_filter_or_all(S.merge_clips(scored)), 300))
        found = S.score_transcript(segments, given, min_pm=300)
        got = found.select(*want.columns).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want.collect())) and len({x["video_id"] for x in got}) > 5
        assert _plan(found).count("Exchange") == 1 and "Window" not in _plan(found) and "Join" not in _plan(found)
    row = segments.groupBy("video_id").agg(F.collect_list(F.struct("ord", "start_ms", "end_ms", "text")).alias("segments")).localCheckpoint()
    assert "Exchange" not in _plan(S.score_recordings(row))


def test_the_query_shuffles_nothing_by_key(spark):
    plan = _plan(scoring_queries.QUERIES["score_transcript"](spark, SMALL))
    assert "hashpartitioning" not in plan and plan.count("Scan parquet") == 1
