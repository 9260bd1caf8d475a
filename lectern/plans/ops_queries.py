"""Queries of the bookkeeping family with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import ops as O
from ..operators import quality as Q
from ..sources import views as V
from .oracle import sql


def _now():
    return F.lit("2001-08-10 00:00:00").cast("timestamp")


def _removed(s, d):
    return O.expired_jobs(V.jobs(s, d), _now())


def _clips_reviews(s, d):
    return V.clips(s, d), V.reviews(s, d)


def _updates(s, d):
    return V.reviews(s, d).where("video_id % 4 <> 0").select("video_id", "clip_no", (F.col("start_ms") + F.when(F.col("video_id") % 3 == 0, 100).otherwise(0)).alias("start_ms"), F.coalesce("end_ms", F.lit(0)).alias("end_ms"), F.lit("edit").alias("status"), F.when(F.col("video_id") % 5 == 0, "new").alias("notes"))


def _media(s, d):
    return V.segments(s, d).groupBy("video_id").agg((F.max("end_ms") + F.col("video_id") % 5 * 20_000 - 30_000).alias("duration_ms"))


def _chapters(s, d):
    rows = V.segments(s, d).where("ord % 9 = 0").withColumn("chapter_no", F.col("ord") / 9)
    return rows.select("video_id", F.col("chapter_no").cast("long").alias("chapter_no"), F.when((F.col("video_id") % 6 == 1) & (F.col("ord") == 18), 0).otherwise(F.col("start_ms")).alias("start_ms"))


STAGES = [(0, "meta"), (1, "transcript"), (2, "scored"), (3, "crop"), (4, "manifest")]


def _artifacts(s, d):
    """All five kinds, with faults of every rule among them."""
    v = F.col("video_id")
    put = lambda *x: F.concat(*[c if isinstance(c, Column) else F.lit(c) for c in x])
    some = lambda when, yes, no: F.when(when, yes).otherwise(no)
    bodies = {
        "meta": F.when(v % 7 == 0, "").otherwise(put('{"source": "a", "duration_sec": ', some(v % 4 == 1, '"9"', (v % 13).cast("string")), some(v % 5 == 0, "}", put(', "resolution": ', some(v % 8 == 3, "[1]", "[1, 2]"), ', "fps": null}')))),
        "transcript": F.when(v % 17 == 1, "[]").when(v % 19 == 2, '{"start": 1, "end": 2, "text": "x"}').otherwise(put('[{"start": 1, "end": 2', some(v % 11 == 0, "", put(some(v % 9 == 5, "", ', "text": "x"'), "}, 5]")))),
        "scored": put('[{"start": 0, "end": 9, "score": ', some(v % 6 == 0, '"0.5"', "0.5"), some(v % 9 == 4, "", ', "id": "s"'), "}]"),
        "crop": put('[{"clip_id": "c", "start": 0, "end": 9, "frames": ', some(v % 10 == 1, "{}", "[1]"), some(v % 9 == 2, "", ', "fallback": false'), "}]"),
        "manifest": put('{"total_clips": ', some(v % 15 == 2, "1.5", (v % 4 - 1).cast("string")), ', "clips": ', some(v % 14 == 3, "null", "[]"), "}"),
    }
    return V.videos(s, d).select("video_id", F.inline(F.array(*[F.struct(F.lit(k).alias("artifact"), b.alias("body")) for k, b in bodies.items()])))


def _beats(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select((F.col("user_id") % 50).alias("worker"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("running_job"))


def _notices(s, d):
    e = V.job_events(s, d)
    return e.where("event_type = 'stage_failed'").select("job_id", "stage", (F.col("id") % 4).alias("attempt"), F.col("id").alias("code"))


QUERIES = {
    "expired_jobs": lambda s, d: _removed(s, d).select("job_id"),
    "freed_uploads": lambda s, d: O.freed_uploads(V.jobs(s, d), _removed(s, d)),
    "orphan_uploads": lambda s, d: O.orphan_uploads(V.files(s, d), V.jobs(s, d), F.lit("2001-08-10 00:00:00").cast("timestamp")),
    "cleanup_summary": lambda s, d: O.cleanup_summary(_removed(s, d), O.freed_uploads(V.jobs(s, d), _removed(s, d)), V.files(s, d), 0.5),
    "job_page": lambda s, d: O.job_page(V.jobs(s, d), 7, 5, 1).select("job_id", "status", "total"),
    "dashboard": lambda s, d: O.dashboard(V.jobs(s, d)),
    "queue_state": lambda s, d: O.queue_state(V.jobs(s, d)),
    "reviewed_clips": lambda s, d: O.reviews_of_clips(*_clips_reviews(s, d)),
    "legacy_reviews": lambda s, d: O.legacy_reviews(V.reviews(s, d), V.reviews(s, d).where("video_id % 3 = 0")).select("video_id", "clip_no", "status"),
    "upserted_reviews": lambda s, d: O.upsert_reviews(V.reviews(s, d).where("video_id % 7 <> 0"), _updates(s, d)),
    "review_queue": lambda s, d: O.review_queue(*_clips_reviews(s, d)),
    "current_attempt": lambda s, d: O.current_attempt(V.job_events(s, d)).select("job_id", "id", "event_type", "stage"),
    "job_states": lambda s, d: O.job_states(V.job_events(s, d)),
    "terminal_events": lambda s, d: O.terminal_events(V.jobs(s, d), V.job_events(s, d)),
    "stage_durations": lambda s, d: O.stage_durations(V.job_events(s, d)),
    "run_warnings": lambda s, d: O.run_warnings(V.jobs(s, d), V.job_events(s, d).select("job_id").distinct(), O.reviews_of_clips(*_clips_reviews(s, d))),
    "worker_states": lambda s, d: O.worker_state(_beats(s, d), F.lit("2024-01-30 23:59:00").cast("timestamp")),
    "pending_checks": lambda s, d: O.pending_checks(V.jobs(s, d).select("job_id", F.col("completed_at").alias("requested_at"), F.col("sources_removed_at").alias("done_at"))).select("job_id"),
    "current_notices": lambda s, d: O.current_notices(_notices(s, d)).select("job_id", "stage", "code"),
    "flat_notices": lambda s, d: O.flatten_notices(_notices(s, d).groupBy("job_id", "stage").agg(F.collect_list(F.struct("attempt", "code")).alias("l")).groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "l"))).alias("notices"))),
    "jobs_after_delete": lambda s, d: O.without_jobs({"e": V.job_events(s, d)}, V.jobs(s, d).where("status = 'failed'"))["e"].groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
    "stale_outputs": lambda s, d: O.stale_outputs(V.clips(s, d).select("video_id", F.format_string("clip_%03d.mp4", F.col("clip_no") + 1).alias("name")), V.videos(s, d).where("video_id % 8 > 0").select("video_id", (F.col("video_id") % 14).alias("n_clips"))),
    "copyable_media": lambda s, d: O.copyable(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 > 0, "h264").alias("codec"), F.lit("yuv420p").alias("pix_fmt"), (F.col("p_partkey") % 9 * 180).alias("height"))).select("id", "can_copy"),
    "source_check": lambda s, d: O.source_check(V.files(s, d).select(F.when(F.col("bytes") % 10 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"), (F.col("bytes") + F.when(F.col("bytes") % 7 == 0, 1).otherwise(0)).alias("size_bytes")), V.files(s, d)),
    "transcript_complete": lambda s, d: Q.transcript_reaches_end(V.segments(s, d), _media(s, d)),
    "valid_chapters": lambda s, d: Q.valid_chapters(_chapters(s, d), _media(s, d)),
    "artifact_rules": lambda s, d: Q.artifact_rules(_artifacts(s, d)),
    "resume_plan": lambda s, d: Q.resume_plan(STAGES, Q.artifact_rules(_artifacts(s, d).where("video_id % 17 <> 4")), V.videos(s, d)),
    "cache_plan": lambda s, d: Q.cache_plan(
        V.segments(s, d).select("video_id", "ord", Q.content_key(F.col("text"), F.lit("cfg1")).alias("cache_key")),
        V.segments(s, d).where("video_id % 2 = 0").select(Q.content_key(F.col("text"), F.lit("cfg1")).alias("cache_key")),
    ),
}

SQL = {
    "expired_jobs": sql("SELECT job_id FROM gone", gone="SELECT * FROM jobs WHERE status IN ('completed', 'failed', 'cancelled') AND sources_removed_at IS NULL AND coalesce(completed_at, created_at) < TIMESTAMP '2001-08-10 00:00:00' - INTERVAL 30 DAY"),
    "queue_state": sql("SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, min(job_id) FILTER (status = 'running') AS running_job FROM jobs"),
    "job_page": sql("SELECT job_id, status, (SELECT count(*) FROM jobs WHERE user_id = 7) AS total FROM (SELECT * FROM jobs WHERE user_id = 7 ORDER BY created_at DESC, job_id DESC LIMIT 5 OFFSET 1)"),
    "dashboard": sql("""SELECT user_id, count(*) AS total, (count(*) FILTER (status = 'completed') * 200 + count(*)) // (2 * count(*)) AS completed_percent,
      (sum(epoch_us(completed_at) // 1000000 - epoch_us(started_at) // 1000000) FILTER (status = 'completed' AND completed_at IS NOT NULL) // count(*) FILTER (status = 'completed' AND completed_at IS NOT NULL))::BIGINT AS mean_seconds FROM jobs GROUP BY user_id"""),
    "reviewed_clips": sql("""SELECT c.video_id, c.clip_no, coalesce(r.status, 'pending') AS status, r.notes FROM clips c LEFT JOIN reviews r ON c.video_id = r.video_id AND c.clip_no = r.clip_no
      AND coalesce(abs(c.start_ms - r.start_ms) <= 50, true) AND coalesce(abs(c.end_ms - r.end_ms) <= 50, true)"""),
    "legacy_reviews": sql("SELECT video_id, clip_no, status FROM reviews WHERE status <> 'pending' AND video_id % 3 <> 0"),
    "upserted_reviews": sql("""SELECT coalesce(r.video_id, u.video_id) AS video_id, coalesce(r.clip_no, u.clip_no) AS clip_no, coalesce(u.start_ms, r.start_ms) AS start_ms, coalesce(u.end_ms, r.end_ms) AS end_ms, coalesce(u.status, r.status) AS status,
        CASE WHEN u.notes IS NOT NULL THEN u.notes WHEN u.status IS NOT NULL AND r.status IS NOT NULL AND (u.start_ms <> r.start_ms OR u.end_ms <> coalesce(r.end_ms, -1)) THEN NULL ELSE r.notes END AS notes
      FROM (SELECT * FROM reviews WHERE video_id % 7 <> 0) r FULL JOIN (SELECT video_id, clip_no, start_ms + CASE WHEN video_id % 3 = 0 THEN 100 ELSE 0 END AS start_ms, coalesce(end_ms, 0) AS end_ms, 'edit' AS status, CASE WHEN video_id % 5 = 0 THEN 'new' END AS notes
        FROM reviews WHERE video_id % 4 <> 0) u ON r.video_id = u.video_id AND r.clip_no = u.clip_no"""),
    "review_queue": sql("SELECT c.video_id, c.clip_no, CASE WHEN score_pm >= 750 THEN 'high' WHEN score_pm >= 550 THEN 'medium' ELSE 'low' END AS band, coalesce(status, 'pending') AS status FROM clips c LEFT JOIN reviews r ON c.video_id = r.video_id AND c.clip_no = r.clip_no"),
    "stage_durations": sql("""SELECT job_id, stage, id, CASE WHEN ok THEN split_part(nx, '_', 2) END AS outcome, CASE WHEN ok THEN epoch_us(nt) // 1000 - epoch_us(ts) // 1000 END AS took_ms FROM (
      SELECT *, lead(event_type) OVER w AS nx, lead(ts) OVER w AS nt, lead(event_type) OVER w IN ('stage_completed', 'stage_failed', 'stage_skipped') AS ok FROM job_events WINDOW w AS (PARTITION BY job_id, stage ORDER BY id)) WHERE event_type = 'stage_started'"""),
    "worker_states": sql("""SELECT worker, CASE WHEN 1706659140 - epoch_us(ts) // 1000000 > 45 THEN 'not_responding' WHEN running THEN 'busy' ELSE 'idle' END AS state FROM (
      SELECT user_id % 50 AS worker, max(ts) AS ts, max_by(event_type <> 'error', ts) AS running FROM events GROUP BY 1)"""),
    "pending_checks": sql("SELECT job_id FROM jobs WHERE completed_at IS NOT NULL AND (sources_removed_at IS NULL OR completed_at > sources_removed_at)"),
    "current_notices": sql("SELECT job_id, stage, id AS code FROM job_events WHERE event_type = 'stage_failed' QUALIFY id % 4 = max(id % 4) OVER (PARTITION BY job_id, stage)"),
    "flat_notices": sql("SELECT job_id, stage, id % 4 AS attempt, id AS code FROM job_events WHERE event_type = 'stage_failed'"),
    "jobs_after_delete": sql("SELECT event_type, count(*) AS n FROM job_events WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'failed') GROUP BY event_type"),
    "stale_outputs": sql("SELECT video_id, 'clip_' || lpad((clip_no + 1)::VARCHAR, 3, '0') || '.mp4' AS name FROM clips WHERE clip_no + 1 > CASE WHEN video_id % 8 > 0 THEN video_id % 14 ELSE 0 END"),
    "copyable_media": "SELECT p_partkey AS id, p_partkey % 3 > 0 AND p_partkey % 9 * 180 BETWEEN 1 AND 1080 AS can_copy FROM part",
    "source_check": sql("SELECT * FROM (SELECT CASE WHEN bytes % 10 = 0 THEN path || 'x' ELSE path END AS path, CASE WHEN bytes % 10 = 0 THEN 'missing' WHEN bytes % 7 = 0 THEN 'size' END AS problem FROM files) WHERE problem IS NOT NULL"),
    "transcript_complete": sql("SELECT video_id, e >= d - least(60000, greatest(10000, d // 10)) AND e * 100 <= d * 102 + 100000 AS complete FROM media", media="SELECT video_id, max(end_ms) AS e, max(end_ms) + video_id % 5 * 20000 - 30000 AS d FROM segments GROUP BY video_id"),
    "valid_chapters": sql("""SELECT video_id, bool_and(CASE WHEN b IS NULL THEN s = 0 ELSE s > b END AND s <= d) AS valid FROM (SELECT *, lag(s) OVER (PARTITION BY video_id ORDER BY ord) AS b FROM chaps) JOIN media USING (video_id) GROUP BY video_id""",
      media="SELECT video_id, max(end_ms) + video_id % 5 * 20000 - 30000 AS d FROM segments GROUP BY video_id", chaps="SELECT video_id, ord, CASE WHEN video_id % 6 = 1 AND ord = 18 THEN 0 ELSE start_ms END AS s FROM segments WHERE ord % 9 = 0"),
    "cache_plan": sql("SELECT video_id, ord, k AS cache_key, k IN (SELECT k FROM keyed WHERE video_id % 2 = 0) AS reuse FROM keyed", keyed="SELECT video_id, ord, sha256(text || ':cfg1') AS k FROM segments"),
}
_GONE = {"gone": "SELECT * FROM jobs WHERE status IN ('completed', 'failed', 'cancelled') AND sources_removed_at IS NULL AND coalesce(completed_at, created_at) < TIMESTAMP '2001-08-10 00:00:00' - INTERVAL 30 DAY",
         "freed": "SELECT input_source, count(*) FILTER (job_id IN (SELECT job_id FROM gone)) AS removed FROM jobs GROUP BY 1 HAVING count(*) FILTER (job_id NOT IN (SELECT job_id FROM gone) AND sources_removed_at IS NULL) = 0 AND count(*) FILTER (job_id IN (SELECT job_id FROM gone)) > 0"}
_ATT = {"now_events": "SELECT * FROM (SELECT *, max(CASE WHEN event_type = 'job_requeued' THEN id END) OVER (PARTITION BY job_id) AS since FROM job_events) WHERE since IS NULL OR id > since"}
# Which faults the texts of each kind have, as the rules name them.
_FAULTS = {
    "meta": ("v % 7 = 0", "false", "false", "v % 5 = 0", "v % 4 = 1 OR v % 13 = 0 OR v % 8 = 3"),
    "transcript": ("false", "v % 11 = 0 AND v % 17 <> 1 AND v % 19 <> 2", "v % 17 = 1 OR v % 19 = 2", "v % 9 = 5", "false"),
    "scored": ("false", "false", "false", "v % 9 = 4", "v % 6 = 0"),
    "crop": ("false", "false", "false", "v % 9 = 2", "v % 10 = 1"),
    "manifest": ("false", "false", "false", "false", "v % 15 = 2 OR v % 4 = 0 OR v % 14 = 3"),
}
_RULES = {"rules": " UNION ALL ".join(
    f"SELECT v AS video_id, '{kind}' AS artifact, '{rule}' AS rule, NOT ({' OR '.join(f'({x})' for x in faults[: i + 1])}) AS ok FROM (SELECT video_id AS v FROM videos)"
    for kind, faults in _FAULTS.items() for i, rule in enumerate(("not_empty", "parses", "shape", "has_keys", "values"))
)}
SQL |= {
    "freed_uploads": sql("SELECT * FROM freed", **_GONE),
    "orphan_uploads": sql("SELECT path, bytes FROM files WHERE path NOT LIKE '%.part' AND mtime < TIMESTAMP '2001-08-10 00:00:00' - INTERVAL 24 HOUR AND path NOT IN (SELECT input_source FROM jobs)"),
    "cleanup_summary": sql("""SELECT (SELECT count(*) FROM gone) AS jobs_cleaned, files, b::BIGINT AS bytes, (b * 100 + 524288) // 1048576 AS mb_hundredths, rest::BIGINT AS uploads_bytes, (rest * 100 + 536870912) // 1073741824 AS uploads_gb_hundredths, rest > 536870912 AS over_limit
      FROM (SELECT count(*) FILTER (named) AS files, coalesce(sum(bytes) FILTER (named), 0) AS b, coalesce(sum(bytes) FILTER (NOT named), 0) AS rest FROM (SELECT bytes, path IN (SELECT input_source FROM freed) AS named FROM files))""", **_GONE),
    "current_attempt": sql("SELECT job_id, id, event_type, stage FROM now_events", **_ATT),
    "job_states": sql("""SELECT a.job_id, attempt, stage, CASE WHEN last_event IS NULL THEN 'queued' WHEN last_event = 'job_completed' THEN 'completed' WHEN last_event = 'stage_failed' THEN 'failed' ELSE 'running' END AS status, coalesce(n, 0) AS events, last_id
      FROM (SELECT job_id, count(*) FILTER (event_type = 'job_requeued') + 1 AS attempt FROM job_events GROUP BY job_id) a LEFT JOIN (SELECT job_id, max_by(stage, id) AS stage, max_by(event_type, id) AS last_event, count(*) AS n, max(id) AS last_id FROM now_events GROUP BY job_id) b USING (job_id)""", **_ATT),
    "terminal_events": sql("SELECT job_id, 'job_' || status AS event_type FROM jobs WHERE status IN ('completed', 'failed', 'cancelled') AND job_id NOT IN (SELECT job_id FROM now_events WHERE event_type IN ('job_completed', 'job_failed', 'job_cancelled'))", **_ATT),
    "run_warnings": sql("""SELECT 'failed_jobs' AS kind, count(*) AS n FROM jobs WHERE status IN ('failed', 'cancelled') UNION ALL SELECT 'missing_jobs', count(*) FROM (SELECT DISTINCT job_id FROM job_events) WHERE job_id NOT IN (SELECT job_id FROM jobs)
      UNION ALL SELECT 'pending_reviews', count(*) FROM clips c LEFT JOIN reviews r ON c.video_id = r.video_id AND c.clip_no = r.clip_no AND coalesce(abs(c.start_ms - r.start_ms) <= 50, true) AND coalesce(abs(c.end_ms - r.end_ms) <= 50, true) WHERE coalesce(r.status, 'pending') = 'pending'"""),
    "artifact_rules": sql("SELECT * FROM rules", **_RULES),
    "resume_plan": sql("SELECT video_id, min(list_position(['meta', 'transcript', 'scored', 'crop', 'manifest'], artifact) - 1)::INT AS resume_from FROM rules WHERE NOT ok AND video_id % 17 <> 4 GROUP BY video_id UNION ALL SELECT video_id, 0 FROM videos WHERE video_id % 17 = 4", **_RULES),
}
