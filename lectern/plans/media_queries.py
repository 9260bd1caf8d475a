"""Queries on chapters, cues, tracks, sources and answers with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import camera as K_camera
from ..operators import chapters as C
from ..operators import cues as U
from ..operators import ops as O
from ..operators import segments as G
from ..operators import tracks as K
from ..sources import transcripts as R
from ..sources import views as V
from ..streaming import job_state as J
from ..streaming import live as L
from .oracle import sql


def _points(s, d):
    rows = V.segments(s, d).where("ord % 5 = 1")
    title = F.when(F.col("ord") % 25 == 1, "  ").otherwise(F.concat(F.lit(" Part "), "ord"))
    at = F.col("start_ms") + F.col("ord") % 7 * 1370 - F.when(F.col("ord") % 15 == 11, 60_000).otherwise(0)
    return rows.select("video_id", ((F.col("ord") - 1) / 5).cast("long").alias("point_no"), F.greatest(F.lit(0), at).alias("at_ms"), title.alias("title"))


def _media(s, d):
    return V.segments(s, d).groupBy("video_id").agg(F.max("end_ms").alias("duration_ms"))


def _cues(s, d):
    return U.clip_cues(V.clips(s, d), V.segments(s, d))


def _off_grid(s, d):
    return V.detections(s, d).withColumn("t_ms", F.col("t_ms") + F.col("n") % 7 * 37)


def _cuts(s, d):
    return V.detections(s, d).where("cut").select("clip_id", (F.col("t_ms") + 400).alias("cut_ms"))


def _spans(s, d):
    at = lambda edge, time: V.segments(s, d).select("video_id", F.col("ord").alias(edge), time).hint("merge")
    return C.pack_blocks(V.segments(s, d)).join(at("first_ord", "start_ms"), ["video_id", "first_ord"]).join(at("last_ord", "end_ms"), ["video_id", "last_ord"])


def _filmed(s, d):
    return V.detections(s, d).groupBy("clip_id").agg((F.min("t_ms") - 500).alias("start_ms"), (F.max("t_ms") + 1000).alias("end_ms"))


def _responses(s, d):
    seg = V.segments(s, d)
    item = F.to_json(F.struct(F.concat(F.lit("seg_"), "ord").alias("id"), (F.col("ord") * 37 % 1001).cast("string").alias("llm_score")))
    lists = seg.groupBy("video_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("j")))), lambda x: x["j"]), ", "), F.lit("]")).alias("j"))
    v, j = F.col("video_id"), F.col("j")
    text = F.when(v % 5 == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(v % 5 == 1, F.concat(F.lit("<think>[1]</think> "), j)).when(v % 5 == 2, F.concat(F.lit('Here: {"segments": '), j, F.lit("} Done."))).when(v % 5 == 3, F.concat(F.lit("<think> never closed "), j)).otherwise(j)
    return lists.select("video_id", text.alias("response"))


def _recogniser(s, d):
    parts = V.chunks(s, d)[1]
    item = F.to_json(F.struct(F.struct(F.col("start_ms").alias("from"), F.col("end_ms").alias("to")).alias("offsets"), F.when(F.col("ord") % 6 == 4, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit(" "))).alias("text")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("j")))), lambda x: x["j"]), ",")
    return parts.groupBy("video_id", "chunk").agg(F.concat(F.lit('{"transcription":['), listed, F.lit("]}")).alias("body"))


def _log_lines(s, d):
    e = V.job_events(s, d)
    obj = F.to_json(F.struct(F.lit("info").alias("level"), F.col("event_type").alias("event"), F.col("job_id").alias("job_id"), F.col("stage").alias("stage")))
    return e.select("id", F.when(F.col("id") % 9 == 0, F.concat(F.lit("plain "), "id")).otherwise(obj).alias("value"))


def _in_order(s, rows, column, files=4):
    """A folder of files with rows in order of column, written one after the other, as a stream and its folder."""
    base = J.shared_folder(s)
    bounds = rows.agg(F.min(column), F.max(column)).first()
    low, high = (x if isinstance(x, int) else x and int(x.timestamp()) for x in bounds) if bounds[0] is not None else (0, 0)
    value = F.col(column) if isinstance(bounds[0], int) or bounds[0] is None else F.unix_seconds(column)
    at = F.least(F.lit(files - 1), F.floor((value - low) * files / (high - low + 1)))
    for k in range(files):
        rows.where(at == k).coalesce(1).write.parquet(f"{base}/in/{k}")
    return base, s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")


def _stream(s, d):
    base, events = _in_order(s, V.job_events(s, d), "id")
    J.run_once(J.live_job_states(events), f"{base}/out", f"{base}/log")
    J.discard(s, f"{base}/in")
    return s.read.parquet(f"{base}/out")


def _progress_events(s, d):
    return V.job_events(s, d).withColumn("progress", F.when((F.col("event_type") == "stage_started") & (F.col("id") % 3 == 0), F.col("id") % 100))


def _flat(progress):
    """The map of stages as one text, in order of names."""
    pairs = F.transform(F.array_sort(F.map_entries("stages")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return progress.withColumn("stages", F.array_join(pairs, ","))


def _live_progress(s, d):
    base, events = _in_order(s, _progress_events(s, d), "id")
    J.run_once(L.job_progress_stream(events, V.STAGES), f"{base}/out", f"{base}/log", "update")
    J.discard(s, f"{base}/in")
    out = s.read.parquet(f"{base}/out")
    columns = [c for c in out.columns if c != "batch"]
    return _flat(out.groupBy("job_id").agg(F.max_by(F.struct(*columns), "batch").alias("l")).select("l.*"))


def _live_workers(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    beats = e.select((F.col("user_id") % 50).cast("string").alias("worker"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("running_job"))
    base, stream = _in_order(s, beats, "ts")
    J.run_once(L.worker_state_stream(stream), f"{base}/out", f"{base}/log", "update")
    J.discard(s, f"{base}/in")
    return s.read.parquet(f"{base}/out").groupBy("worker").agg(F.max_by("state", "at_ms").alias("state"))


def _styled(s, d):
    """Documents in the four looks, by recording."""
    lines = U.style_lines(U.style_table(s, {"box": {}})).union(U.older_style_lines(s))
    looks = F.array(*[F.lit(x) for x in ("box", "default", "modern", "minimal")])
    of_clip = V.clips(s, d).select("video_id", "clip_no", F.get(looks, (F.col("video_id") % 4).cast("int")).alias("style"))
    return U.ass_documents(_cues(s, d), lines, of_clip)


def _sixths(block):
    """Answers to a block: a chapter at its first segment and at every sixth one after it."""
    first = F.min("ord").over(Window.partitionBy("video_id"))
    rows = block.withColumn("_f", first).where((F.col("ord") - F.col("_f")) % 6 == 0)
    return rows.select("video_id", "block_no", F.col("ord").alias("point_no"), F.col("start_ms").alias("at_ms"), F.concat(F.lit("Part "), "ord").alias("title"))


QUERIES = {
    "chapters_in_blocks": lambda s, d: C.chapters_in_blocks(V.segments(s, d), _sixths, 10_000),
    "blocks": lambda s, d: C.pack_blocks(V.segments(s, d)),
    "snapped_points": lambda s, d: C.snap_to_segments(_points(s, d), V.segments(s, d)),
    "chapters": lambda s, d: C.normalise_chapters(_points(s, d), V.segments(s, d)),
    "even_chapters": lambda s, d: C.even_chapters(_media(s, d)),
    "chapter_texts": lambda s, d: C.chapter_text(C.even_chapters(_media(s, d)), _media(s, d)),
    "expected_chapters": lambda s, d: C.expected_chapters(_media(s, d)),
    "thinned_points": lambda s, d: C.thin_evenly(_points(s, d), 4, order=("at_ms", "point_no")).select("video_id", "point_no"),
    "leading_suggestions": lambda s, d: C.leading_suggestions(V.segments(s, d)),
    "block_quotas": lambda s, d: C.block_quota(C.pack_blocks(V.segments(s, d)), 10),
    "span_quotas": lambda s, d: C.span_quota(_spans(s, d)),
    "suggestions_in_bounds": lambda s, d: C.suggestions_in_bounds(_points(s, d), _media(s, d)).select("video_id", "point_no"),
    "word_times": lambda s, d: U.word_times(V.segments(s, d)),
    "clip_words": lambda s, d: U.words_in_clips(V.clips(s, d), U.word_times(V.segments(s, d))),
    "cues": _cues,
    "srt_documents": lambda s, d: U.srt_documents(_cues(s, d)),
    "ass_documents": _styled,
    "sample_grid": lambda s, d: K.sample_grid(V.clips(s, d)),
    "best_faces": lambda s, d: K.best_faces(V.detections(s, d).union(V.detections(s, d).withColumn("conf_pm", F.col("conf_pm") - 50).withColumn("x", F.col("x") + 300)), 1600, 900, 700),
    "moving_average": lambda s, d: K.moving_average(V.detections(s, d)),
    "shots": lambda s, d: K.shots(V.detections(s, d)).select("clip_id", "n", "shot_no"),
    "shot_boxes": lambda s, d: K.shot_boxes(K.shots(V.detections(s, d))),
    "track_fallbacks": lambda s, d: K.fallback_flags(V.detections(s, d)),
    "cuts_at_boundaries": lambda s, d: K.cuts_at_boundaries(K.shots(V.detections(s, d)), _cuts(s, d)),
    "absorbed_groups": lambda s, d: G.absorb_short(K.shots(V.detections(s, d)), _filmed(s, d)),
    "track_segments": lambda s, d: G.track_segments(K.shots(V.detections(s, d)), _filmed(s, d), _cuts(s, d)),
    "resampled_track": lambda s, d: K.resample(_off_grid(s, d)),
    "running_median": lambda s, d: K.running_median(V.detections(s, d)),
    "crop_windows": lambda s, d: K.crop_window(K.shot_boxes(K.shots(V.detections(s, d)))).select("clip_id", "shot_no", "crop_x", "crop_w"),
    "stitched_segments": lambda s, d: R.stitch_chunks(*V.chunks(s, d)).select("video_id", "seg_id", "start_ms", "end_ms"),
    "recogniser_segments": lambda s, d: R.recogniser_segments(_recogniser(s, d)),
    "chunk_plan": lambda s, d: R.chunk_plan(_media(s, d), 60_000),
    "log_rows": lambda s, d: R.log_rows(_log_lines(s, d)).select("id", "level", "event", F.col("extra")["stage"].alias("stage")),
    "normalised_answers": lambda s, d: A.normalise_answers(_responses(s, d)).select("video_id", "item_no", "id", "llm_score", "error"),
    "live_job_states": _stream,
    "job_progress": lambda s, d: _flat(O.job_progress(_progress_events(s, d), V.STAGES)),
    "live_job_progress": _live_progress,
    "live_worker_states": _live_workers,
    "analysed_prompts": lambda s, d: A.analyse(V.segments(s, d).select("video_id", "ord", F.col("text").alias("prompt")), lambda ps: [str(len(p) % 11) for p in ps]).select("video_id", "ord", "response", "error"),
}

_PROGRESS = {
    "pr_cur": "SELECT * FROM (SELECT *, max(id) FILTER (event_type = 'job_requeued') OVER (PARTITION BY job_id) AS since FROM job_events) WHERE since IS NULL OR id > since",
    "pr_open": "SELECT * FROM (SELECT *, min(id) FILTER (event_type = 'job_completed') OVER (PARTITION BY job_id) AS fin FROM pr_cur) WHERE fin IS NULL OR id <= fin",
    "pr_stage": "SELECT *, CASE WHEN event_type = 'stage_completed' THEN 100 WHEN event_type = 'stage_started' AND id % 3 = 0 THEN id % 100 END AS pct FROM pr_open WHERE event_type <> 'job_completed'",
    "pr_seen": "SELECT job_id, stage, substr(arg_max(event_type, id), 7) AS s FROM pr_stage GROUP BY ALL",
    "pr_whole": f"""SELECT j.job_id, string_agg(k.stage || '=' || coalesce(s, 'pending'), ',' ORDER BY k.stage) AS stages
      FROM (SELECT DISTINCT job_id FROM job_events) j CROSS JOIN (SELECT unnest([{", ".join(f"'{x}'" for x in V.STAGES)}]) AS stage) k LEFT JOIN pr_seen p ON p.job_id = j.job_id AND p.stage = k.stage GROUP BY j.job_id""",
    "pr_last": "SELECT job_id, arg_max(event_type, id) AS kind, count(*) AS events, max(id) AS last_id FROM pr_open GROUP BY ALL",
    "pr_now": "SELECT job_id, stage, pct AS progress FROM pr_stage QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY id DESC) = 1",
}
_PROGRESS_BODY = """SELECT a.job_id, attempt, stage, CASE WHEN kind IS NULL THEN 'queued' WHEN kind = 'job_completed' THEN 'completed' ELSE 'running' END AS status, progress, stages, coalesce(events, 0) AS events, last_id
      FROM (SELECT job_id, count(*) FILTER (event_type = 'job_requeued') + 1 AS attempt FROM job_events GROUP BY ALL) a JOIN pr_whole USING (job_id) LEFT JOIN pr_last USING (job_id) LEFT JOIN pr_now USING (job_id)"""

_SHOT = {
    "flagged": """SELECT *, CASE WHEN pc IS NULL THEN 0 WHEN (conf_pm > 0) <> (pc > 0) THEN 1 WHEN conf_pm > 0 AND (greatest(w, pw) * 100 > least(w, pw) * 135 OR abs((2 * x + w) - (2 * px + pw)) > greatest(w, pw)) THEN 1 ELSE 0 END AS f
      FROM (SELECT *, lag(conf_pm) OVER k AS pc, lag(w) OVER k AS pw, lag(x) OVER k AS px FROM detections WINDOW k AS (PARTITION BY clip_id ORDER BY n))""",
    "shot_rows": "SELECT *, sum(f) OVER (PARTITION BY clip_id ORDER BY n)::BIGINT AS shot_no FROM flagged",
    "boxes": """SELECT clip_id, shot_no, min(n) AS first_n, max(n) AS last_n, k * 2 >= count(*) AND k > 0 AS has_face, CASE WHEN k * 2 >= count(*) AND k > 0 THEN median(x + w / 2) FILTER (conf_pm > 0) END AS cx, CASE WHEN k * 2 >= count(*) AND k > 0 THEN median(w) FILTER (conf_pm > 0) END::DOUBLE AS w
      FROM (SELECT *, sum((conf_pm > 0)::INT) OVER (PARTITION BY clip_id, shot_no) AS k FROM shot_rows) GROUP BY clip_id, shot_no, k""",
}
_BLOCKS = {
    "walk": """SELECT video_id, 0::BIGINT AS ord, 0::BIGINT AS block_no, length(trim(text)) + 9 AS used FROM segments WHERE ord = 0
      UNION ALL SELECT s.video_id, s.ord, CASE WHEN ok THEN block_no ELSE block_no + 1 END, CASE WHEN ok THEN used ELSE 0 END + length(trim(text)) + 9 FROM walk w JOIN segments s ON s.video_id = w.video_id AND s.ord = w.ord + 1, LATERAL (SELECT w.used + length(trim(s.text)) + 9 <= 4000 AS ok) z""",
    "blocks": "SELECT video_id, block_no, min(ord) AS first_ord, max(ord) AS last_ord FROM walk GROUP BY ALL",
}
_POINTS = {
    "points": "SELECT video_id, (ord - 1) // 5 AS point_no, greatest(0, start_ms + ord % 7 * 1370 - CASE WHEN ord % 15 = 11 THEN 60000 ELSE 0 END) AS at_ms, CASE WHEN ord % 25 = 1 THEN '  ' ELSE ' Part ' || ord END AS title FROM segments WHERE ord % 5 = 1",
    "media": "SELECT video_id, max(end_ms) AS duration_ms FROM segments GROUP BY video_id",
    "snapped": "SELECT p.video_id, point_no, at_ms, title, s.start_ms FROM points p JOIN segments s ON p.video_id = s.video_id QUALIFY row_number() OVER (PARTITION BY p.video_id, point_no ORDER BY abs(s.start_ms - at_ms), s.start_ms) = 1",
    "evened": "SELECT video_id, i AS chapter_no, i * duration_ms // n AS start_ms, 'Part ' || (i + 1) AS title, 'Segment ' || (i + 1) || ' of ' || n AS summary FROM (SELECT *, greatest(1, duration_ms // 240000) AS n FROM media), unnest(range(0, n)) t(i)",
}
_WORDS = {
    "timed": """SELECT video_id, ord, word_no, s + d * (t - z) // a AS start_ms, s + d * t // a AS end_ms, word FROM (SELECT *, length(word) + 1 AS z, sum(length(word) + 1) OVER (PARTITION BY video_id, ord ORDER BY word_no)::BIGINT AS t, sum(length(word) + 1) OVER (PARTITION BY video_id, ord)::BIGINT AS a FROM (
      SELECT video_id, ord, start_ms AS s, end_ms - start_ms AS d, i - 1 AS word_no, l[i] AS word FROM (SELECT *, regexp_extract_all(text, '[^\\s]+') AS l FROM segments), unnest(range(1, len(l) + 1)) q(i)))""",
    "clip_words": """SELECT c.video_id, clip_no, ord, word_no, greatest(0, w.start_ms - c.start_ms) AS start_ms, least(c.end_ms, w.end_ms) - c.start_ms AS end_ms, word FROM clips c JOIN timed w ON c.video_id = w.video_id AND w.start_ms + w.end_ms BETWEEN 2 * c.start_ms AND 2 * c.end_ms""",
}

def _wrapped(words: str) -> str:
    return f"""list_reduce(list_transform({words}, lambda w: {{'n': length(w), 't': w}}), lambda a, b: CASE WHEN a.n + 1 + b.n > 26 THEN {{'n': b.n, 't': a.t || chr(10) || b.t}} ELSE {{'n': a.n + 1 + b.n, 't': a.t || ' ' || b.t}} END).t"""


SQL = {
    "blocks": sql("SELECT * FROM blocks", True, **_BLOCKS),
    "snapped_points": sql("SELECT video_id, point_no, at_ms, start_ms FROM snapped", **_POINTS),
    "chapters": sql("""SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY point_no) - 1 AS chapter_no, t AS start_ms, title FROM (SELECT *, max(t) OVER (PARTITION BY video_id ORDER BY point_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (
      SELECT video_id, point_no, trim(title) AS title, CASE WHEN row_number() OVER (PARTITION BY video_id ORDER BY point_no) = 1 THEN 0 ELSE start_ms END AS t FROM snapped WHERE trim(title) <> '')) WHERE m IS NULL OR t > m""", **_POINTS),
    "even_chapters": sql("SELECT * FROM evened", **_POINTS),
    "chapter_texts": sql("""SELECT video_id, string_agg(CASE WHEN duration_ms >= 3600000 THEN (x // 3600) || ':' || lpad((x // 60 % 60)::VARCHAR, 2, '0') ELSE CASE WHEN x < 6000 THEN lpad((x // 60)::VARCHAR, 2, '0') ELSE (x // 60)::VARCHAR END END || ':' || lpad((x % 60)::VARCHAR, 2, '0') || ' ' || title, chr(10) ORDER BY chapter_no) AS text
      FROM (SELECT e.*, start_ms // 1000 AS x, duration_ms FROM evened e JOIN media USING (video_id)) GROUP BY video_id""", **_POINTS),
    "expected_chapters": sql("SELECT video_id, greatest(1, duration_ms // 360000) AS low, greatest(1, duration_ms // 360000, (duration_ms + 119999) // 120000) AS high FROM media WHERE duration_ms >= 120000", **_POINTS),
    "thinned_points": sql("SELECT video_id, point_no FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY at_ms, point_no) - 1 AS r, count(*) OVER (PARTITION BY video_id) AS n FROM points) WHERE n <= 4 OR list_contains([0, n // 4, 2 * n // 4, 3 * n // 4], r)", **_POINTS),
    "leading_suggestions": sql("""SELECT video_id, ord, start_ms, CASE WHEN len(w) > 0 THEN 'Illustrative footage for: "' || array_to_string(w[1:6], ' ') || '"' ELSE 'Illustrative footage' END AS suggestion, array_to_string(w[1:3], ', ') AS keywords
      FROM (SELECT *, greatest(1, count(*) OVER (PARTITION BY video_id) // 10) AS step, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS w FROM segments) WHERE ord % step = 0 AND ord < step * 10"""),
    "block_quotas": sql("SELECT video_id, block_no, greatest(1, ((last_ord - first_ord + 1) * 10 + t - 1) // t)::BIGINT AS quota FROM (SELECT *, sum(last_ord - first_ord + 1) OVER (PARTITION BY video_id) AS t FROM blocks)", True, **_BLOCKS),
    "span_quotas": sql("SELECT b.video_id, block_no, greatest(1, round_even((l.end_ms - f.start_ms) / 60000, 0))::BIGINT AS quota FROM blocks b JOIN segments f ON f.video_id = b.video_id AND f.ord = first_ord JOIN segments l ON l.video_id = b.video_id AND l.ord = last_ord", True, **_BLOCKS),
    "suggestions_in_bounds": sql("SELECT video_id, point_no FROM points JOIN media USING (video_id) WHERE at_ms BETWEEN 0 AND duration_ms AND trim(title) <> ''", **_POINTS),
    "word_times": sql("SELECT * FROM timed", **_WORDS),
    "clip_words": sql("SELECT * FROM clip_words", **_WORDS),
    "sample_grid": sql("SELECT video_id, clip_no, t AS t_ms FROM clips, unnest(range(start_ms, end_ms + 1, 1000)) q(t)"),
    "best_faces": sql("SELECT clip_id, n, least(greatest(x, 0), 1599) AS x, 100 AS y, least(w, 1600 - least(greatest(x, 0), 1599)) AS w, least(h, 800) AS h, CASE WHEN conf_pm >= 700 THEN conf_pm ELSE 0 END AS conf_pm FROM detections"),
    "moving_average": sql("SELECT clip_id, n, " + ", ".join(f"CASE WHEN count(*) OVER (PARTITION BY clip_id) > 5 THEN (sum({c}) OVER k // count(*) OVER k)::BIGINT ELSE {c} END AS {c}" for c in "xywh") + ", conf_pm FROM detections WINDOW k AS (PARTITION BY clip_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "shots": sql("SELECT clip_id, n, shot_no FROM shot_rows", **_SHOT),
    "shot_boxes": sql("SELECT * FROM boxes", **_SHOT),
    "track_fallbacks": sql("SELECT clip_id, count(*) FILTER (conf_pm = 0) * 1000 // count(*) AS no_face_pm, count(*) FILTER (conf_pm = 0) * 1000 > 700 * count(*) AS fallback FROM detections GROUP BY clip_id"),
    "cuts_at_boundaries": sql("""SELECT e.clip_id, e.shot_no, max(c.cut_ms) AS cut_ms FROM (SELECT clip_id, shot_no, min(t_ms) AS f, lag(max(t_ms)) OVER (PARTITION BY clip_id ORDER BY shot_no) AS p FROM shot_rows GROUP BY clip_id, shot_no) e
      LEFT JOIN (SELECT clip_id, t_ms + 400 AS cut_ms FROM detections WHERE cut) c ON e.clip_id = c.clip_id AND c.cut_ms > p - 500 AND c.cut_ms <= f + 500 WHERE p IS NOT NULL GROUP BY ALL""", **_SHOT),
    "absorbed_groups": sql("""SELECT s.clip_id, s.shot_no, g.group_no, g.start_ms FROM (SELECT DISTINCT clip_id, shot_no FROM shot_rows) s JOIN (SELECT *, lead(no) OVER (PARTITION BY clip_id ORDER BY no) AS nx FROM (SELECT clip_id, i - 1 AS group_no, no[i] AS no, begun[i] AS start_ms FROM done, unnest(range(1, len(no) + 1)) q(i))) g
      ON s.clip_id = g.clip_id AND s.shot_no >= no AND (nx IS NULL OR s.shot_no < nx)""", True, **_SHOT,
      firsts="SELECT clip_id, shot_no, min(t_ms) AS t FROM shot_rows GROUP BY ALL",
      walk="""SELECT clip_id, list(shot_no ORDER BY shot_no) AS no, list_prepend(min(t) - 500, list(t ORDER BY shot_no)[2:]) AS begun, (SELECT max(t_ms) + 1000 FROM detections d WHERE d.clip_id = f.clip_id) AS e, true AS more FROM firsts f GROUP BY clip_id
        UNION ALL SELECT clip_id, CASE WHEN m THEN no[:gone - 1] || no[gone + 1:] ELSE no END, CASE WHEN m THEN begun[:gone - 1] || begun[gone + 1:] ELSE begun END, e, m FROM (
          SELECT *, len(begun) > 1 AND l[i] < 2000 AS m, CASE WHEN i = 1 THEN 2 WHEN i = len(l) OR l[i - 1] >= l[i + 1] THEN i ELSE i + 1 END AS gone FROM (SELECT *, list_position(l, list_min(l)) AS i FROM (SELECT *, list_transform(range(1, len(begun) + 1), lambda k: coalesce(begun[k + 1], e) - begun[k]) AS l FROM walk WHERE more)))""",
      done="SELECT clip_id, no, begun FROM walk WHERE NOT more"),
    "resampled_track": sql("""SELECT clip_id, t AS t_ms, CASE WHEN nt IS NULL THEN x ELSE x + floor((nx - x) * (t - s) / (nt - s))::BIGINT END AS x FROM (
      SELECT clip_id, s, x, lead(s) OVER k AS nt, lead(x) OVER k AS nx, min(s) OVER (PARTITION BY clip_id) AS f FROM (SELECT *, t_ms + n % 7 * 37 AS s FROM detections) WINDOW k AS (PARTITION BY clip_id ORDER BY s)),
      unnest(range(f + (s - f + 99) // 100 * 100, coalesce(nt, s + 1), 100)) q(t)"""),
    "running_median": sql("""SELECT clip_id, n, (2 * CASE WHEN c < 3 THEN x WHEN n = 1 THEN list_sort([x, a1, 2 * a1 - a2])[2] WHEN n = c THEN list_sort([x, b1, 2 * b1 - b2])[2] ELSE m END)::BIGINT AS x2 FROM (
      SELECT a.clip_id, a.n, a.x, c, a1, a2, b1, b2, median(b.x) AS m FROM (SELECT *, count(*) OVER (PARTITION BY clip_id) AS c, lead(x) OVER k AS a1, lead(x, 2) OVER k AS a2, lag(x) OVER k AS b1, lag(x, 2) OVER k AS b2 FROM detections WINDOW k AS (PARTITION BY clip_id ORDER BY n)) a
      JOIN detections b ON a.clip_id = b.clip_id AND b.n BETWEEN a.n - least(2, a.n - 1, c - a.n) AND a.n + least(2, a.n - 1, c - a.n) GROUP BY ALL)"""),
    "crop_windows": sql("SELECT clip_id, shot_no, greatest(0, least(1313, coalesce(floor(cx - 303.5)::BIGINT, 656))) AS crop_x, 607 AS crop_w FROM boxes", **_SHOT),
    "stitched_segments": sql("""SELECT s.video_id, 'seg_' || lpad(row_number() OVER (PARTITION BY s.video_id ORDER BY s.chunk, ord)::VARCHAR, 4, '0') AS seg_id, start_ms + o AS start_ms, end_ms + o AS end_ms FROM chunk_segments s
      JOIN (SELECT video_id, chunk, coalesce(sum(dur_ms) OVER (PARTITION BY video_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM chunks) c ON s.video_id = c.video_id AND s.chunk = c.chunk"""),
    "recogniser_segments": sql("SELECT video_id, chunk, start_ms, end_ms, text, row_number() OVER (PARTITION BY video_id, chunk ORDER BY ord) - 1 AS ord FROM chunk_segments WHERE ord % 6 <> 4"),
    "chunk_plan": sql("SELECT video_id, i AS chunk, i * 60000 AS start_ms, least(duration_ms, (i + 1) * 60000) AS end_ms FROM media, unnest(range(0, CASE WHEN duration_ms > 60000 THEN duration_ms // 60000 + 1 ELSE 1 END)) t(i)", **_POINTS),
    "log_rows": sql("SELECT id, CASE WHEN id % 9 > 0 THEN 'info' END AS level, CASE WHEN id % 9 = 0 THEN 'plain ' || id ELSE event_type END AS event, CASE WHEN id % 9 > 0 THEN stage END AS stage FROM job_events"),
    "normalised_answers": sql("""SELECT video_id, ord AS item_no, 'seg_' || ord AS id, (ord * 37 % 1001)::VARCHAR AS llm_score, NULL AS error FROM segments WHERE video_id % 5 <> 3
      UNION ALL SELECT DISTINCT video_id, NULL, NULL, NULL, 'no list of answers' FROM segments WHERE video_id % 5 = 3"""),
    "live_job_states": sql("""SELECT job_id, attempt, CASE WHEN e <> 'job_requeued' THEN stage END AS stage, CASE e WHEN 'job_requeued' THEN 'queued' WHEN 'job_completed' THEN 'completed' WHEN 'stage_failed' THEN 'failed' ELSE 'running' END AS status, CASE WHEN e <> 'job_requeued' THEN id END AS last_id
      FROM (SELECT job_id, count(*) FILTER (event_type = 'job_requeued') + 1 AS attempt, max_by(event_type, id) AS e, max_by(stage, id) AS stage, max(id) AS id FROM job_events GROUP BY job_id)"""),
    "chapters_in_blocks": sql("""SELECT video_id, block_no, row_number() OVER (PARTITION BY video_id ORDER BY block_no, o) - 1 AS chapter_no, start_ms, 'Part ' || o AS title FROM (
      SELECT video_id, block_no, unnest(range(idx, CASE WHEN carried THEN nxt ELSE stop END, 6)) AS o FROM (
        SELECT *, nxt < stop AS carried FROM (SELECT *, CASE WHEN stop >= n OR idx + 6 * ((stop - 1 - idx) // 6) = idx THEN stop ELSE idx + 6 * ((stop - 1 - idx) // 6) END AS nxt FROM ch_walk)))
      JOIN segments s USING (video_id) WHERE s.ord = o""", True,
      ch_sizes="SELECT video_id, ord, sum(length(trim(text)) + 9) OVER (PARTITION BY video_id ORDER BY ord) AS used, length(trim(text)) + 9 AS sz, count(*) OVER (PARTITION BY video_id) AS n FROM segments",
      ch_ends="SELECT video_id, idx, n, greatest(idx + 1, coalesce(m, n)) AS stop FROM (SELECT a.video_id, a.ord AS idx, a.n AS n, min(b.ord) AS m FROM ch_sizes a LEFT JOIN ch_sizes b ON a.video_id = b.video_id AND b.ord > a.ord AND b.used > a.used - a.sz + 10000 GROUP BY ALL)",
      ch_walk="""SELECT video_id, idx, n, stop, 0 AS block_no FROM ch_ends WHERE idx = 0 UNION ALL
        SELECT e.video_id, e.idx, e.n, e.stop, block_no + 1 FROM ch_walk w JOIN ch_ends e ON e.video_id = w.video_id AND e.idx = CASE WHEN w.idx + 6 * ((w.stop - 1 - w.idx) // 6) = w.idx THEN w.stop ELSE w.idx + 6 * ((w.stop - 1 - w.idx) // 6) END WHERE w.stop < w.n"""),
    "job_progress": sql(_PROGRESS_BODY, **_PROGRESS),
    "live_job_progress": sql(_PROGRESS_BODY, **_PROGRESS),
    "live_worker_states": sql("""SELECT worker, CASE WHEN epoch_us(latest) - 10000000 - epoch_us(ts) > 45000000 THEN 'not_responding' WHEN running THEN 'busy' ELSE 'idle' END AS state FROM (
      SELECT (user_id % 50)::VARCHAR AS worker, max(ts) AS ts, max_by(event_type <> 'error', ts) AS running FROM events GROUP BY 1), (SELECT max(ts) AS latest FROM events)"""),
    "analysed_prompts": sql("SELECT video_id, ord, (length(text) % 11)::VARCHAR AS response, NULL AS error FROM segments"),
    "cues": sql("SELECT * FROM cue_rows", True, **_WORDS, cue_words="SELECT *, row_number() OVER (PARTITION BY video_id, clip_no, ord ORDER BY word_no) AS k FROM clip_words",
      lay="""SELECT video_id, clip_no, ord, k, word, start_ms, end_ms, 0::BIGINT AS cue, 1::BIGINT AS line, length(word) AS width, false AS ended FROM cue_words WHERE k = 1
        UNION ALL SELECT w.video_id, w.clip_no, w.ord, w.k, w.word, w.start_ms, w.end_ms, CASE WHEN brk THEN cue + 1 ELSE cue END, CASE WHEN brk THEN 1 ELSE nl END, CASE WHEN brk OR nl > line THEN length(w.word) ELSE width + 1 + length(w.word) END,
          regexp_matches(w.word, '[.!?…]$') AND CASE WHEN brk THEN 1 ELSE nl END >= 2
        FROM lay l JOIN cue_words w ON w.video_id = l.video_id AND w.clip_no = l.clip_no AND w.ord = l.ord AND w.k = l.k + 1, LATERAL (SELECT CASE WHEN width + 1 + length(w.word) > 26 THEN line + 1 ELSE line END AS nl) a, LATERAL (SELECT ended OR nl > 3 AS brk) b""",
      last_cue="SELECT video_id, clip_no, ord, max(cue) AS c FROM lay GROUP BY ALL HAVING max(cue) > 0",
      shift=f"""SELECT l.video_id, l.clip_no, l.ord, list(word ORDER BY k) FILTER (cue = c - 1) AS p, list(word ORDER BY k) FILTER (cue = c) AS q, min(k) FILTER (cue = c) AS first_k FROM lay l JOIN last_cue m ON l.video_id = m.video_id AND l.clip_no = m.clip_no AND l.ord = m.ord WHERE cue >= c - 1 GROUP BY ALL
        UNION ALL SELECT video_id, clip_no, ord, p[:len(p) - 1], list_prepend(p[len(p)], q), first_k - 1 FROM shift WHERE len(p) > 1 AND length(array_to_string(q, ' ')) < 78 * 0.3 AND length(array_to_string(q, ' ')) + length(p[len(p)]) + 1 < length(array_to_string(p, ' '))
          AND NOT regexp_matches(p[len(p)], '[.!?…]$') AND len(string_split({_wrapped("list_prepend(p[len(p)], q)")}, chr(10))) <= 3""",
      placed="SELECT l.video_id, l.clip_no, l.ord, k, word, start_ms, end_ms, CASE WHEN k >= f THEN c ELSE cue END AS cue FROM lay l LEFT JOIN (SELECT video_id, clip_no, ord, c, min(first_k) AS f FROM shift JOIN last_cue USING (video_id, clip_no, ord) GROUP BY ALL) m ON l.video_id = m.video_id AND l.clip_no = m.clip_no AND l.ord = m.ord",
      cue_rows=f"""SELECT video_id, clip_no, ord, cue AS cue_no, s AS start_ms, coalesce(lead(s) OVER (PARTITION BY video_id, clip_no, ord ORDER BY cue), greatest(e, s + 300)) AS end_ms, {_wrapped("words")} AS text FROM (
        SELECT video_id, clip_no, ord, cue, min(start_ms) AS s, max(end_ms) AS e, list(word ORDER BY k) AS words FROM placed GROUP BY ALL)"""),
}
SQL["srt_documents"] = SQL["cues"].rsplit("SELECT * FROM cue_rows", 1)[0] + """SELECT video_id, clip_no, string_agg(n || chr(10) || a || ' --> ' || b || chr(10) || text || chr(10), chr(10) ORDER BY n) AS document FROM (SELECT *, row_number() OVER (PARTITION BY video_id, clip_no ORDER BY ord, cue_no) AS n,
  lpad((start_ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((start_ms % 1000)::VARCHAR, 3, '0') AS a,
  lpad((end_ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((end_ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((end_ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((end_ms % 1000)::VARCHAR, 3, '0') AS b FROM cue_rows) GROUP BY ALL"""

_LOOKS = [
  "Style: Default,Nimbus Mono PS,64,&H00FFFFFF,&H000000FF,&H404D4D4D,&H404D4D4D,-1,0,0,0,100,100,0,0,4,14.0,0,2,140,140,480,1",
  "Style: Default,Arial,48,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,1,2,10,10,50,1",
  "Style: Default,Arial,52,&H00FFFFFF,&H000000FF,&H00000000,&H80000000,1,0,0,0,100,100,0,0,3,0,0,2,20,20,60,1",
  "Style: Default,Arial,40,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,1,0,2,10,10,40,1"]
_HEAD = ["[Script Info]", "Title: Subtitles", "ScriptType: v4.00+", "PlayResX: 1080", "PlayResY: 1920", "WrapStyle: 2", "ScaledBorderAndShadow: yes", "", "[V4+ Styles]",
  "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"]
_EVENTS = ["", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"]
_CLOCK = "({0} // 3600000) || ':' || lpad(({0} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({0} // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad(({0} % 1000 // 10)::VARCHAR, 2, '0')"
SQL["ass_documents"] = SQL["cues"].rsplit("SELECT * FROM cue_rows", 1)[0] + f"""SELECT video_id, clip_no, '{"' || chr(10) || '".join(_HEAD)}' || chr(10) || [{", ".join(f"'{x}'" for x in _LOOKS)}][max(video_id) % 4 + 1] || chr(10) || '{"' || chr(10) || '".join(_EVENTS)}' || chr(10) || string_agg('Dialogue: 0,' || {_CLOCK.format("start_ms")} || ',' || {_CLOCK.format("end_ms")} || ',Default,,0,0,0,,' || replace(translate(text, '{{}}', '()'), chr(10), '\\N') || chr(10), '' ORDER BY ord, cue_no) AS document FROM cue_rows GROUP BY ALL"""


def _camera(s, d):
    """A path for each shot in which a walking face is seen."""
    walking = V.detections(s, d).withColumn("x", 700 + 20 * (F.col("n") % 40)).withColumn("w", F.lit(120))
    faces = K.shots(walking).where("conf_pm > 0").select("clip_id", "shot_no", "t_ms", (F.col("x") + F.col("w") / 2).alias("cx"))
    made, at = K_camera.camera_paths(faces, 607, 1920, keys=("clip_id", "shot_no")), f"{J.shared_folder(s)}/paths"
    made.write.parquet(at)  # read twice below
    paths = s.read.parquet(at)
    frames = K_camera.keyframes(paths, keys=("clip_id", "shot_no")).select("clip_id", "shot_no", F.size("keyframes").alias("keyframes"))
    return paths.join(frames.hint("merge"), ["clip_id", "shot_no"]).select("clip_id", "shot_no", "start_ms", "keyframes", F.size("path").alias("points"), F.round(F.array_min("path"), 1).alias("leftmost"), F.round(F.array_max("path"), 1).alias("rightmost"))


# Camera paths are iterated floating-point smoothing, track segments take medians of groups as they grow; tests hold each step against values worked out by hand.
QUERIES["camera_paths"] = _camera
