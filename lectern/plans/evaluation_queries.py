"""Queries of the evaluation family with their DuckDB counterparts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import report as R
from ..sources import views as V
from ..sources.files import written
from .oracle import CTES, sql


def _covered(s, d, shift=0):
    return E.coverage(V.clips(s, d, shift), V.pieces(s, d))


def _best(s, d, shift=0):
    return E.best_covering_clip(_covered(s, d, shift), V.shorts(s, d))


def _found(s, d):
    return E.find_shorts(_best(s, d))


def _plain(s, d):
    return E.plain_shorts(V.shorts(s, d))


def _counted(s, d, run):
    """Plain shorts with the best clip of a run."""
    return E.find_shorts(E.best_covering_clip(E.coverage(V.run_clips(s, d, run), V.pieces(s, d)), _plain(s, d)))


def _matches(s, d):
    return E.label_matches(V.clips(s, d), V.interval_labels(s, d))


def _precise(s, d, clips=None):
    clips = V.clips(s, d) if clips is None else clips
    covered = E.coverage(clips, V.pieces(s, d)).join(_plain(s, d).select("video_id", "short_no").hint("merge"), ["video_id", "short_no"], "left_semi")
    return E.precision_members(clips.select("video_id", "clip_no"), covered, E.label_matches(clips, V.interval_labels(s, d)))


def _metrics(s, d, run=0):
    clips = V.run_clips(s, d, run)
    return E.metrics(_counted(s, d, run), clips, _precise(s, d, clips), V.run_episodes(s, d, run))


def _of_run(df, s, d, run=0):
    return df.join(V.run_episodes(s, d, run).hint("merge"), "video_id", "left_semi")


def _rated(s, d):
    return V.interval_labels(s, d).withColumnRenamed("label", "status")


def _report(s, d):
    """The second run's report against the first."""
    clips, before, after = V.run_clips(s, d, 1), written(_metrics(s, d, 0)), written(_metrics(s, d, 1))
    counted = [written(_of_run(_counted(s, d, run), s, d, run)) for run in (0, 1)]
    hooks = E.hook_checks(counted[1], clips, V.shorts(s, d), V.pieces(s, d)).join(V.shorts(s, d).select("video_id", "short_no", "reordered").hint("merge"), ["video_id", "short_no"])
    labels, reviews = E.label_matches(clips, V.interval_labels(s, d)), E.review_counts(_of_run(V.reviews(s, d), s, d, 1), "video_id")
    run = {"label": "second", "set": "talks", "app_version": "1", "git_commit": None, "created_at": "2024-01-01"}
    return R.render_report(run, after, E.missing_shorts(counted[1]), hooks, labels, E.median_duration(clips), reviews, against=("first", E.compare_metrics(before, after), E.compare_runs(*counted)))


_MATCHING = {
    "pairs": """SELECT video_id, pno, rno, iou, fine FROM (SELECT video_id, pno, rno, b * 1000 // (la + lb - b) AS iou, (b::HUGEINT * 1000000000000000000) // (la + lb - b) AS fine FROM (SELECT p.video_id, p.clip_no AS pno, r.clip_no AS rno, greatest(0, least(p.end_ms, r.end_ms) - greatest(p.start_ms, r.start_ms)) AS b,
        p.end_ms - p.start_ms AS la, r.end_ms - r.start_ms AS lb FROM clips p JOIN clips_b r ON p.video_id = r.video_id)) WHERE iou >= 300""",
    "walk": """SELECT video_id, -1::BIGINT AS pno, []::BIGINT[] AS used, NULL::BIGINT AS rno, NULL::BIGINT AS iou FROM videos
      UNION ALL SELECT w.video_id, w.pno + 1, CASE WHEN c.rno IS NULL THEN w.used ELSE list_append(w.used, c.rno) END, c.rno, c.iou
      FROM walk w LEFT JOIN LATERAL (SELECT q.rno, q.iou FROM pairs q WHERE q.video_id = w.video_id AND q.pno = w.pno + 1 AND NOT list_contains(w.used, q.rno) ORDER BY q.fine DESC, q.rno LIMIT 1) c ON true WHERE w.pno < 11""",
}

_METRICS = """SELECT video_id, shorts, hits, clips, precise, hits * 1000 // nullif(shorts, 0) AS hit_pm, precise * 1000 // nullif(clips, 0) AS precision_pm FROM (
      SELECT video_id, sum(s)::BIGINT AS shorts, sum(h)::BIGINT AS hits, sum(c)::BIGINT AS clips, sum(p)::BIGINT AS precise FROM (
        SELECT video_id, 1 AS s, found::INT AS h, 0 AS c, 0 AS p FROM counted UNION ALL SELECT video_id, 0, 0, 1, 0 FROM clips UNION ALL SELECT video_id, 0, 0, 0, 1 FROM precise UNION ALL SELECT video_id, 0, 0, 0, 0 FROM in_run) JOIN in_run USING (video_id)
      GROUP BY GROUPING SETS ((video_id), ()))"""
_TABLES = ["clips", "covered", "matches", "best", "found", "counted", "precise", "in_run"]


def _second(text: str) -> str:
    """text over the tables of the second run."""
    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(_TABLES)})\b", r"\1 \2_b", text)


#: The second run's tables, made from the first's.
_SECOND = {f"{n}_b": _second(CTES[n]).replace("% 13 <> 5", "% 13 <> 6") for n in _TABLES[1:]}

QUERIES = {
    "clip_segments": lambda s, d: E.overlapping_segments(V.clips(s, d), V.segments(s, d)).select("video_id", "clip_no", "ord", F.greatest("start_ms", "clip_start_ms").alias("from_ms"), F.least("end_ms", "clip_end_ms").alias("to_ms")),
    "clip_coverage": _covered,
    "label_matches": _matches,
    "precise_clips": _precise,
    "best_covering_clips": _best,
    "found_shorts": _found,
    "hook_checks": lambda s, d: E.hook_checks(_of_run(_counted(s, d, 0), s, d), V.run_clips(s, d), V.shorts(s, d), V.pieces(s, d)),
    "run_metrics": _metrics,
    "compare_metrics": lambda s, d: E.compare_metrics(_metrics(s, d, 0), _metrics(s, d, 1)),
    "run_report": _report,  # one text; a test holds it against a fixture
    "plain_shorts": lambda s, d: E.plain_shorts(V.shorts(s, d)).select("video_id", "short_no", "reordered"),
    "review_counts": lambda s, d: E.review_counts(V.reviews(s, d)),
    "median_clip_duration": lambda s, d: E.median_duration(V.clips(s, d)),
    "clips_by_label": lambda s, d: E.clips_by_label(_matches(s, d)),
    "compare_runs": lambda s, d: E.compare_runs(_of_run(_counted(s, d, 0), s, d), _of_run(_counted(s, d, 1), s, d, 1)),
    "iou_matching": lambda s, d: E.greedy_iou_matching(V.clips(s, d), V.clips(s, d, 3000), 300),
    "carried_ratings": lambda s, d: E.carry_over(V.clips(s, d), _rated(s, d)),
    "missing_episodes": lambda s, d: E.missing_episodes(V.videos(s, d), V.run_clips(s, d)),
    "missing_shorts": lambda s, d: E.missing_shorts(_of_run(_counted(s, d, 0), s, d)),
}

SQL = {
    "clip_segments": sql("SELECT c.video_id, clip_no, ord, greatest(s.start_ms, c.start_ms) AS from_ms, least(s.end_ms, c.end_ms) AS to_ms FROM clips c JOIN segments s ON c.video_id = s.video_id AND s.end_ms > c.start_ms AND s.start_ms < c.end_ms"),
    "clip_coverage": sql("SELECT * FROM covered"),
    "label_matches": sql("SELECT * FROM matches"),
    "precise_clips": sql("SELECT * FROM precise"),
    "best_covering_clips": sql("SELECT * FROM best"),
    "found_shorts": sql("SELECT * FROM found"),
    "hook_checks": sql("""SELECT f.video_id, f.short_no, f.clip_no, abs(c.start_ms - o.source_start_ms) <= 3000 AS hook_ok, CASE WHEN reordered THEN abs(c.start_ms - span_start_ms) <= 3000 END AS span_ok
      FROM counted f JOIN in_run USING (video_id) JOIN shorts s ON f.video_id = s.video_id AND f.short_no = s.short_no JOIN clips c ON f.video_id = c.video_id AND f.clip_no = c.clip_no
      LEFT JOIN (SELECT * FROM pieces QUALIFY row_number() OVER (PARTITION BY video_id, short_no ORDER BY short_start_ms, piece) = 1) o ON f.video_id = o.video_id AND f.short_no = o.short_no WHERE f.found"""),
    "run_metrics": sql(_METRICS),
    "compare_metrics": sql("""SELECT coalesce(a.video_id, b.video_id) AS video_id, a.hits AS hits_before, b.hits AS hits_after, a.shorts AS shorts_before, b.shorts AS shorts_after, a.precise AS precise_before, b.precise AS precise_after, a.clips AS clips_before, b.clips AS clips_after,
      a.precision_pm AS precision_pm_before, b.precision_pm AS precision_pm_after, b.hits - a.hits AS hits_change, b.precision_pm - a.precision_pm AS precision_pm_change, b.clips - a.clips AS clips_change
      FROM metrics_a a FULL JOIN metrics_b b ON a.video_id IS NOT DISTINCT FROM b.video_id""", **_SECOND, metrics_a=_METRICS, metrics_b=_second(_METRICS)),
    "plain_shorts": sql("SELECT video_id, short_no, reordered FROM shorts WHERE NOT montage"),
    "review_counts": sql("""SELECT *, keep * 1000 // nullif(rated, 0) AS keep_pm FROM (SELECT count(*) FILTER (status = 'keep') AS keep, count(*) FILTER (status = 'edit') AS edit, count(*) FILTER (status = 'reject') AS reject,
      count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status <> 'pending') AS rated FROM reviews)"""),
    "median_clip_duration": sql("SELECT video_id, median(end_ms - start_ms)::DOUBLE AS median_ms FROM clips GROUP BY video_id"),
    "clips_by_label": sql("SELECT video_id, label, string_agg(DISTINCT clip_no::VARCHAR, ',' ORDER BY clip_no::VARCHAR) AS clips FROM matches GROUP BY ALL").replace("string_agg(DISTINCT clip_no::VARCHAR, ',' ORDER BY clip_no::VARCHAR)", "array_to_string(list_sort(list(DISTINCT clip_no)), ',')"),
    "compare_runs": sql("""SELECT *, after_pm - before_pm AS delta_pm FROM (SELECT coalesce(a.video_id, b.video_id) AS video_id, coalesce(a.short_no, b.short_no) AS short_no, coalesce(a.covered_pm, 0) AS before_pm, coalesce(b.covered_pm, 0) AS after_pm
      FROM (SELECT * FROM counted JOIN in_run USING (video_id)) a FULL JOIN (SELECT * FROM counted_b JOIN in_run_b USING (video_id)) b ON a.video_id = b.video_id AND a.short_no = b.short_no)""", **_SECOND),
    "iou_matching": sql("SELECT video_id, pno AS pending_no, rno AS rated_no, iou AS iou_pm FROM walk WHERE rno IS NOT NULL", True, **_MATCHING),
    "carried_ratings": sql("""SELECT video_id, clip_no, label AS status, 'carried over, IoU ' || (iou_pm // 1000) || '.' || lpad((iou_pm // 10 % 100)::VARCHAR, 2, '0') AS notes FROM matches QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY clip_no) = 1"""),
    "missing_episodes": sql("SELECT video_id FROM videos WHERE video_id % 13 = 5 OR video_id % 11 = 7"),
    "missing_shorts": sql("SELECT video_id, short_no, covered_pm, row_number() OVER (PARTITION BY video_id ORDER BY covered_pm, short_no) AS rank FROM counted JOIN in_run USING (video_id) WHERE NOT found"),
}
