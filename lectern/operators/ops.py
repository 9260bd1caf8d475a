"""Bookkeeping tables: jobs, events, uploads, reviews, notices. Deletions and upserts give new snapshots or
plans; nothing is removed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import terms_of_tags

TERMINAL = ["completed", "failed", "cancelled"]

#: Seconds of silence after which a worker does not respond.
SILENT_SEC = 45
#: Events that close a job's attempt, and the status that they give it.
CLOSING = {"job_completed": "completed", "job_failed": "failed", "job_cancelled": "cancelled"}


def expired_jobs(jobs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Finished jobs whose sources are still there and whose end (or creation) is before now - days; none for
    days = 0."""
    if days <= 0:
        return jobs.limit(0)
    since = F.coalesce("completed_at", "created_at")
    return jobs.where(F.col("status").isin(TERMINAL) & F.col("sources_removed_at").isNull() & (since < now - F.make_dt_interval(F.lit(days))))


def freed_uploads(jobs: DataFrame, removed: DataFrame) -> DataFrame:
    """Uploads whose every referencing job is in `removed` or has lost its sources already."""
    gone = removed.select("job_id").withColumn("_gone", F.lit(True))
    rows = jobs.join(gone.hint("merge"), "job_id", "left")
    rows = rows.groupBy("input_source").agg(F.count_if(F.col("_gone").isNull() & F.col("sources_removed_at").isNull()).alias("in_use"), F.count_if("_gone").alias("removed"))
    return rows.where("in_use = 0 and removed > 0").select("input_source", "removed")


def orphan_uploads(files: DataFrame, jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Files that no job names, neither partial nor young: path and bytes."""
    old = files.where(~F.col("path").endswith(".part") & (F.col("mtime") < now - F.make_dt_interval(hours=F.lit(hours))))
    return old.join(jobs.select(F.col("input_source").alias("path")).hint("merge"), "path", "left_anti").select("path", "bytes")


def cleanup_summary(removed: DataFrame, freed: DataFrame, files: DataFrame, limit_gb: float = 50.0) -> DataFrame:
    """One row: jobs cleaned, files and bytes freed, megabytes to two places (in hundredths); bytes of the upload folder
    after that, gigabytes to two places (in hundredths), and whether they exceed limit_gb."""
    freed_file = F.coalesce("_freed", F.lit(False))
    named = freed.select(F.col("input_source").alias("path"), F.lit(True).alias("_freed")).distinct()
    sums = files.join(named.hint("merge"), "path", "left").agg(
        F.count_if(freed_file).alias("files"), F.coalesce(F.sum(F.when(freed_file, F.col("bytes"))), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(~freed_file, F.col("bytes"))), F.lit(0)).alias("uploads_bytes")
    )
    n = removed.agg(F.count(F.lit(1)).alias("jobs_cleaned"))
    names = ["jobs_cleaned", "files", "bytes", "uploads_bytes"]
    both = n.select("jobs_cleaned", *[F.lit(0).alias(c) for c in names[1:]]).union(sums.select(F.lit(0), *names[1:]))  # two rows
    hundredths = lambda c, unit: F.floor((F.col(c) * 100 + unit // 2) / unit)
    return both.agg(*[F.sum(c).alias(c) for c in names]).select(
        *names[:3], hundredths("bytes", 1 << 20).alias("mb_hundredths"), "uploads_bytes", hundredths("uploads_bytes", 1 << 30).alias("uploads_gb_hundredths"), (F.col("uploads_bytes") > int(limit_gb * (1 << 30))).alias("over_limit")
    )


def job_page(jobs: DataFrame, user_id: int, limit: int = 50, offset: int = 0) -> DataFrame:
    """A user's jobs, newest first, with the total."""
    mine = jobs.where(F.col("user_id") == user_id)
    page = mine.orderBy(F.desc("created_at"), F.desc("job_id")).offset(offset).limit(limit)
    total = mine.groupBy(F.col("user_id").alias("_u")).agg(F.count(F.lit(1)).alias("total"))
    return page.join(total.hint("merge"), F.col("user_id") == F.col("_u")).drop("_u")


def dashboard(jobs: DataFrame) -> DataFrame:
    """Per user: jobs, completed share in whole percent (half up), mean minutes of completed jobs with both
    times (in seconds, rounded down)."""
    took = F.when((F.col("status") == "completed") & F.col("started_at").isNotNull() & F.col("completed_at").isNotNull(), F.unix_seconds("completed_at") - F.unix_seconds("started_at"))
    n, done = F.count(F.lit(1)), F.count_if(F.col("status") == "completed")
    return jobs.groupBy("user_id").agg(n.alias("total"), F.floor((done * 200 + n) / (2 * n)).alias("completed_percent"), F.floor(F.sum(took) / F.count(took)).cast("long").alias("mean_seconds"))


def queue_state(jobs: DataFrame) -> DataFrame:
    """One row: jobs queued and running, and the running job of the least id."""
    running = F.col("status") == "running"
    return jobs.groupBy().agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(running).alias("running"), F.min(F.when(running, F.col("job_id"))).alias("running_job"))


def reviews_of_clips(clips: DataFrame, reviews: DataFrame, tolerance_ms: int = 50, key: str = "video_id") -> DataFrame:
    """Clips with the status of their review if it still describes them: bounds within the tolerance, an
    unknown bound agrees; otherwise pending."""
    c, r = clips.alias("c"), reviews.alias("r")
    near = lambda x: F.coalesce(F.abs(F.col(f"c.{x}") - F.col(f"r.{x}")) <= tolerance_ms, F.lit(True))
    on = (F.col(f"c.{key}") == F.col(f"r.{key}")) & (F.col("c.clip_no") == F.col("r.clip_no")) & near("start_ms") & near("end_ms")
    return c.join(r.hint("merge"), on, "left").select(f"c.{key}", "c.clip_no", F.coalesce("r.status", F.lit("pending")).alias("status"), "r.notes")


def legacy_reviews(metas: DataFrame, reviews: DataFrame, keys=("video_id", "clip_no")) -> DataFrame:
    """Decisions stored with the clips that the table lacks; pending ones are none."""
    return metas.where(F.col("status") != "pending").join(reviews.select(*keys).hint("merge"), list(keys), "left_anti")


def upsert_reviews(reviews: DataFrame, updates: DataFrame, keys=("video_id", "clip_no")) -> DataFrame:
    """The next snapshot: status and notes of an update win; if the clip under the number has changed, old
    notes are dropped."""
    u = updates.select(*keys, *[F.col(c).alias(f"u_{c}") for c in ("start_ms", "end_ms", "status", "notes")])
    rows = reviews.join(u.hint("merge"), list(keys), "full_outer")
    updated = F.col("u_status").isNotNull()
    changed = updated & ((F.col("u_start_ms") != F.col("start_ms")) | (F.col("u_end_ms") != F.coalesce("end_ms", F.lit(-1))))
    notes = F.coalesce("u_notes", F.when(~F.coalesce(changed, F.lit(False)), F.col("notes")))
    return rows.select(*keys, F.coalesce("u_start_ms", "start_ms").alias("start_ms"), F.coalesce("u_end_ms", "end_ms").alias("end_ms"), F.coalesce("u_status", "status").alias("status"), notes.alias("notes"))


def review_queue(clips: DataFrame, reviews: DataFrame, keys=("video_id", "clip_no")) -> DataFrame:
    """Clips with the band of their score and their review, `pending` without one; where clips have tags, with the first
    three of the terms among them."""
    band = F.when(F.col("score_pm") >= 750, "high").when(F.col("score_pm") >= 550, "medium").otherwise("low")
    terms = [F.slice("terms", 1, 3).alias("terms")] if "tags" in clips.columns else []
    clips = terms_of_tags(clips) if terms else clips
    return clips.join(reviews.select(*keys, "status").hint("merge"), list(keys), "left").select(*keys, band.alias("band"), *terms, F.coalesce("status", F.lit("pending")).alias("status"))


def current_attempt(events: DataFrame) -> DataFrame:
    """Events of each job after its last requeue."""
    since = F.max(F.when(F.col("event_type") == "job_requeued", F.col("id"))).over(Window.partitionBy("job_id"))
    return events.withColumn("_since", since).where(F.col("_since").isNull() | (F.col("id") > F.col("_since"))).drop("_since")


def job_states(events: DataFrame) -> DataFrame:
    """Batch view of the live state: attempt, last stage, status and number of events of the current attempt."""
    attempts = events.groupBy("job_id").agg((F.count_if(F.col("event_type") == "job_requeued") + 1).alias("attempt"))
    now = current_attempt(events)
    last = now.groupBy("job_id").agg(F.max_by("stage", "id").alias("stage"), F.max_by("event_type", "id").alias("last_event"), F.count(F.lit(1)).alias("events"), F.max("id").alias("last_id"))
    closed = F.col("last_event") == "job_completed"
    return attempts.join(last.hint("merge"), "job_id", "left").select("job_id", "attempt", "stage", F.when(F.col("last_event").isNull(), "queued").when(closed, "completed").when(F.col("last_event") == "stage_failed", "failed").otherwise("running").alias("status"), F.coalesce("events", F.lit(0)).alias("events"), "last_id")


def terminal_events(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """A closing event for finished jobs whose current attempt has none."""
    have = current_attempt(events).where(F.col("event_type").isin("job_completed", "job_failed", "job_cancelled")).select("job_id").distinct()
    return jobs.where(F.col("status").isin(TERMINAL)).join(have.hint("merge"), "job_id", "left_anti").select("job_id", F.concat(F.lit("job_"), "status").alias("event_type"))


def stage_durations(events: DataFrame) -> DataFrame:
    """Each start of a stage with the next event of the same job and stage, if that ends it."""
    w = Window.partitionBy("job_id", "stage").orderBy("id")
    rows = events.withColumn("_next", F.lead("event_type").over(w)).withColumn("_at", F.lead("ts").over(w)).where("event_type = 'stage_started'")
    ends = F.col("_next").isin("stage_completed", "stage_failed", "stage_skipped")
    ms = lambda c: F.floor(F.unix_micros(c) / 1000)
    return rows.select("job_id", "stage", "id", F.when(ends, F.substring_index("_next", "_", -1)).alias("outcome"), F.when(ends, ms("_at") - ms("ts")).alias("took_ms"))


def run_warnings(jobs: DataFrame, wanted: DataFrame, reviews: DataFrame, key: str = "job_id") -> DataFrame:
    """(kind, n): failed jobs, wanted ones without a job, pending reviews."""
    failed = jobs.where(F.col("status").isin("failed", "cancelled")).groupBy().agg(F.lit("failed_jobs").alias("kind"), F.count(F.lit(1)).alias("n"))
    absent = wanted.join(jobs.select(key).hint("merge"), key, "left_anti").groupBy().agg(F.lit("missing_jobs").alias("kind"), F.count(F.lit(1)).alias("n"))
    pending = reviews.where(F.col("status") == "pending").groupBy().agg(F.lit("pending_reviews").alias("kind"), F.count(F.lit(1)).alias("n"))
    return failed.union(absent).union(pending)


def worker_state(beats: DataFrame, now: Column, silent_sec: int = SILENT_SEC) -> DataFrame:
    """Per worker: never_started without a beat, not_responding after over silent_sec of silence, busy with a job, else
    idle. Of two beats at one time the one with a job counts."""
    last = beats.groupBy("worker").agg(F.max("ts").alias("ts"), F.max_by(F.col("running_job").isNotNull(), F.struct("ts", F.col("running_job").isNotNull())).alias("busy"))
    late = F.unix_micros(now) - F.unix_micros("ts") > silent_sec * 1_000_000
    return last.select("worker", F.when(F.col("ts").isNull(), "never_started").when(late, "not_responding").when(F.col("busy"), "busy").otherwise("idle").alias("state"))


def job_progress(events: DataFrame, stages: list[str]) -> DataFrame:
    """State of each job after its events (job_id, id, event_type, stage, progress): attempt, current stage and its progress,
    the last status of every stage, `pending` for those without one. Repeated ids count once; a closing event ends
    the attempt, what follows it before the next requeue does not count."""
    once = events.dropDuplicates(["job_id", "id"])
    attempts = once.groupBy("job_id").agg((F.count_if(F.col("event_type") == "job_requeued") + 1).alias("attempt"))
    now = current_attempt(once)
    ended = F.min(F.when(F.col("event_type").isin(list(CLOSING)), F.col("id"))).over(Window.partitionBy("job_id"))
    now = now.withColumn("_end", ended).where(F.col("_end").isNull() | (F.col("id") <= F.col("_end")))
    of_stage = ~F.col("event_type").isin(list(CLOSING))
    seen = now.where(of_stage).groupBy("job_id", "stage").agg(F.regexp_replace(F.max_by("event_type", "id"), "^stage_", "").alias("s"))
    seen = seen.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "s"))).alias("seen"))
    progress = F.when(F.col("event_type") == "stage_completed", 100).otherwise(F.col("progress"))
    last = now.groupBy("job_id").agg(
        F.max_by(F.when(of_stage, F.col("stage")), F.when(of_stage, F.col("id"))).alias("stage"),
        F.max_by(F.when(of_stage, progress), F.when(of_stage, F.col("id"))).cast("long").alias("progress"),
        F.max_by("event_type", "id").alias("kind"), F.count(F.lit(1)).alias("events"), F.max("id").alias("last_id"),
    )
    rows = attempts.join(last.hint("merge"), "job_id", "left").join(seen.hint("merge"), "job_id", "left")
    closed = F.create_map(*[F.lit(x) for pair in CLOSING.items() for x in pair])[F.coalesce("kind", F.lit(""))]
    status = F.when(F.col("kind").isNull(), "queued").otherwise(F.coalesce(closed, F.lit("running")))
    pending = F.create_map(*[F.lit(x) for s in stages for x in (s, "pending")]) if stages else F.create_map().cast("map<string,string>")
    have = F.coalesce("seen", F.create_map().cast("map<string,string>"))
    whole = F.map_concat(F.map_filter(pending, lambda k, _: ~F.map_contains_key(have, k)), have)
    return rows.select("job_id", "attempt", "stage", status.alias("status"), "progress", whole.alias("stages"), F.coalesce("events", F.lit(0)).cast("long").alias("events"), "last_id")


def pending_checks(requests: DataFrame) -> DataFrame:
    return requests.where("requested_at is not null and (done_at is null or requested_at > done_at)")


def current_notices(notices: DataFrame) -> DataFrame:
    """Notices of the last attempt of each job's stage."""
    last = F.max("attempt").over(Window.partitionBy("job_id", "stage"))
    return notices.withColumn("_last", last).where(F.col("attempt") == F.col("_last")).drop("_last")


def flatten_notices(packed: DataFrame) -> DataFrame:
    """job_id and a map of stage to a list of notices -> a row for each notice."""
    by_stage = packed.select("job_id", F.explode("notices").alias("stage", "_list"))
    return by_stage.select("job_id", "stage", F.explode("_list").alias("_n")).select("job_id", "stage", "_n.*")


def without_jobs(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """The next snapshots of tables with a job_id once the doomed jobs are deleted."""
    return {name: t.join(doomed.select("job_id").hint("merge"), "job_id", "left_anti") for name, t in tables.items()}


def stale_outputs(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Numbered clip files above the current number of clips of their video."""
    number = F.regexp_extract("name", r"^clip_(\d+)\.", 1)
    rows = files.withColumn("_n", F.when(number != "", number.cast("long")))
    return rows.join(counts.hint("merge"), "video_id", "left").where(F.col("_n") > F.coalesce("n_clips", F.lit(0))).select("video_id", "name")


def copyable(media: DataFrame, max_height: int = 1080) -> DataFrame:
    """Media whose video stream can be copied as it is."""
    ok = (F.col("codec") == "h264") & (F.col("pix_fmt") == "yuv420p") & (F.col("height") > 0) & (F.col("height") <= max_height)
    return media.withColumn("can_copy", F.coalesce(ok, F.lit(False)))


def source_check(episodes: DataFrame, files: DataFrame, hashed: bool = False) -> DataFrame:
    """(path, problem): listed files (path, size_bytes, and sha256 if hashed) that are missing, of another `size`, or of
    another `sha256`. files: as of list_files; a listed file without a checksum has its size compared alone."""
    have = files.select(F.col("path"), F.col("bytes").alias("_bytes"), *([F.col("sha256").alias("_sum")] if hashed else []))
    rows = episodes.join(have.hint("merge"), "path", "left")
    problem = F.when(F.col("_bytes").isNull(), "missing").when(F.col("_bytes") != F.col("size_bytes"), "size")
    problem = problem.when(F.col("sha256") != F.col("_sum"), "sha256") if hashed else problem
    return rows.select("path", problem.alias("problem")).where("problem is not null")
