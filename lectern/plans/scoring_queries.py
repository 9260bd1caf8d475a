"""Queries of the scoring family with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..sources import views as V
from .oracle import sql


def _scored(spark, d):
    seg = V.segments(spark, d)
    return S.score_segments(seg, S.extract_terms(seg))


def _tags(df):
    return df.withColumn("tags", F.array_join("tags", "|"))


_PM = ["term_pm", "definition_pm", "rhetorical_pm", "self_pm", "score_pm"]

# Greedy merging as a recursion over the segments of a video, one at a time.
_HE = "(({a} + {b}) // 2 + CASE WHEN ({a} + {b}) % 2 = 1 AND ({a} + {b}) // 2 % 2 = 1 THEN 1 ELSE 0 END)"
_SUBS = ["term_pm", "definition_pm", "rhetorical_pm", "self_pm"]


def _merge_cte(source: str) -> dict[str, str]:
    subs = ", ".join(f"CASE WHEN fits THEN {_HE.format(a=f'm.{x}', b=f's.{x}')} ELSE s.{x} END AS {x}" for x in _SUBS)
    plain = ", ".join(_SUBS)
    return {
        "steps": f"""SELECT video_id, ord, 1 AS clip, start_ms, end_ms, score_pm, {plain}, self_contained, tags, 1 AS n_segments FROM {source} WHERE ord = 0
        UNION ALL SELECT s.video_id, s.ord, CASE WHEN fits THEN clip ELSE clip + 1 END, CASE WHEN fits THEN m.start_ms ELSE s.start_ms END, CASE WHEN fits THEN greatest(m.end_ms, s.end_ms) ELSE s.end_ms END,
          CASE WHEN fits THEN greatest(m.score_pm, s.score_pm) ELSE s.score_pm END, {subs}, CASE WHEN fits THEN m.self_contained AND s.self_contained ELSE s.self_contained END,
          CASE WHEN fits THEN list_concat(m.tags, list_filter(s.tags, lambda x: NOT list_contains(m.tags, x))) ELSE s.tags END, CASE WHEN fits THEN n_segments + 1 ELSE 1 END
        FROM steps m JOIN {source} s ON s.video_id = m.video_id AND s.ord = m.ord + 1, LATERAL (SELECT greatest(m.end_ms, s.end_ms) - m.start_ms <= 90000 AS fits)""",
        "merged": "SELECT *, 'clip_' || lpad(clip::VARCHAR, 3, '0') AS clip_id FROM steps QUALIFY row_number() OVER (PARTITION BY video_id, clip ORDER BY ord DESC) = 1",
    }


_MERGED = f"SELECT video_id, clip_id, start_ms, end_ms, {', '.join(_PM)}, self_contained, n_segments::BIGINT AS n_segments, array_to_string(tags, '|') AS tags"
_FALLBACK = "SELECT * FROM (SELECT *, end_ms - start_ms BETWEEN 45000 AND 90000 AS ok, max((end_ms - start_ms BETWEEN 45000 AND 90000)::INT) OVER (PARTITION BY video_id) AS any_ok FROM merged) WHERE ok OR any_ok = 0"


def score_transcript(spark, d):
    out = S.score_recordings(V.recordings(spark, d))
    return _tags(out).select("video_id", "clip_id", "start_ms", "end_ms", *_PM, "self_contained", "n_segments", "tags", "rank")


QUERIES = {
    "score_transcript": score_transcript,
    "global_terms": lambda s, d: S.extract_terms(V.segments(s, d)),
    "segment_scores": lambda s, d: _tags(_scored(s, d)).select("video_id", "ord", *_PM, "self_contained", "tags"),
    "blended_scores": lambda s, d: _tags(S.blend_answers(_scored(s, d), V.segment_answers(s, d))).select("video_id", "ord", "score_pm", "tags"),
    "answers_with_scores": lambda s, d: S.last_answers(V.segment_answers(s, d), ["video_id", "ord"], "answer_no").join(_scored(s, d).select("video_id", "ord", "score_pm").hint("merge"), ["video_id", "ord"], "left").select("video_id", "ord", "answer_no", "llm_pm", "content_type", "virality_pm", "score_pm"),
    "merged_clips": lambda s, d: _tags(S.merge_clips(_scored(s, d))).select("video_id", "clip_id", "start_ms", "end_ms", *_PM, "self_contained", "n_segments", "tags"),
    "clips_by_duration": lambda s, d: S.duration_filter(S.merge_clips(_scored(s, d))).select("video_id", "clip_id", "start_ms", "end_ms"),
    "clips_by_duration_or_all": lambda s, d: S.duration_filter_or_all(S.merge_clips(_scored(s, d))).select("video_id", "clip_id", "start_ms", "end_ms"),
    "clips_by_score": lambda s, d: S.score_filter(V.clips(s, d), 300).groupBy("video_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("score_pm").alias("total_pm")),
    "top_clips": lambda s, d: S.top_clips(V.clips(s, d), 5).select("video_id", "clip_no", "score_pm", "rank"),
    "best_segments": lambda s, d: S.best_segments(_scored(s, d)).select("video_id", "ord", "score_pm"),
    "answer_batches": lambda s, d: S.batches(V.segments(s, d)).groupBy("video_id", "batch").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count(F.lit(1)).alias("n")),
    "batch_verdicts": lambda s, d: S.batch_verdict(
        S.batches(V.segments(s, d)).select("video_id", "batch").distinct().withColumn("outcome", F.when((F.col("video_id") % 97 == 0) & (F.col("batch") == 0), "unavailable").when((F.col("video_id") * 7 + F.col("batch") * 3) % 5 < 2, "failed").otherwise("ok"))
    ),
}

SQL = {
    "score_transcript": sql(_MERGED + f", rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score_pm DESC, start_ms) AS rank FROM ({_FALLBACK}) WHERE score_pm >= 450) WHERE rank <= 12", True, **_merge_cte("blended")),
    "global_terms": sql("SELECT * FROM terms"),
    "segment_scores": sql(f"SELECT video_id, ord, {', '.join(_PM)}, self_contained, array_to_string(tags, '|') AS tags FROM scored"),
    "blended_scores": sql("SELECT video_id, ord, score_pm, array_to_string(tags, '|') AS tags FROM blended"),
    "answers_with_scores": sql("SELECT a.video_id, a.ord, answer_no, llm_pm, content_type, virality_pm, score_pm FROM (SELECT * FROM segment_answers QUALIFY row_number() OVER (PARTITION BY video_id, ord ORDER BY answer_no DESC) = 1) a LEFT JOIN scored s ON a.video_id = s.video_id AND a.ord = s.ord"),
    "merged_clips": sql(_MERGED + " FROM merged", True, **_merge_cte("scored")),
    "clips_by_duration": sql("SELECT video_id, clip_id, start_ms, end_ms FROM merged WHERE end_ms - start_ms BETWEEN 45000 AND 90000", True, **_merge_cte("scored")),
    "clips_by_duration_or_all": sql(f"SELECT video_id, clip_id, start_ms, end_ms FROM ({_FALLBACK})", True, **_merge_cte("scored")),
    "clips_by_score": sql("SELECT video_id, count(*) AS kept, sum(score_pm)::BIGINT AS total_pm FROM clips WHERE score_pm >= 300 GROUP BY video_id"),
    "top_clips": sql("SELECT video_id, clip_no, score_pm, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score_pm DESC, start_ms) AS rank FROM clips) WHERE rank <= 5"),
    "best_segments": sql("SELECT video_id, ord, score_pm FROM scored QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score_pm DESC, ord) <= 40"),
    "answer_batches": sql("SELECT video_id, ord // 15 AS batch, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n FROM segments GROUP BY ALL"),
    "batch_verdicts": sql("""SELECT video_id, count(*) AS batches, count(*) FILTER (o <> 'ok') AS failed, count(*) FILTER (o <> 'ok') * 2 <= count(*) AND count(*) FILTER (o = 'unavailable') = 0 AS valid FROM (
      SELECT video_id, CASE WHEN video_id % 97 = 0 AND b = 0 THEN 'unavailable' WHEN (video_id * 7 + b * 3) % 5 < 2 THEN 'failed' ELSE 'ok' END AS o FROM (SELECT DISTINCT video_id, ord // 15 AS b FROM segments)) GROUP BY video_id"""),
}
