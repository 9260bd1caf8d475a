"""Streams over files that the tests write, against the same events as a table."""

from __future__ import annotations

import os
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern.operators import ops as O
from lectern.sources import transcripts
from lectern.streaming import job_state as J
from lectern.streaming import live as L

START = datetime(2024, 1, 1)


def events(spark, tmp_path, closing=True):
    """40 events, ten of them delivered twice, in four files; a last one moves the watermark on."""
    kinds = ["job_requeued", "stage_started", "stage_completed", "job_completed"]
    rows = [(i % 5, i, START + timedelta(minutes=7 * i), kinds[i % 4], "score") for i in range(40)]
    rows += rows[5:15] + ([(99, 1000, START + timedelta(days=9), "stage_started", "score")] if closing else [])
    schema = "job_id long, id long, ts timestamp, event_type string, stage string"
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return rows, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_replayed_events_come_once(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    J.run_once(J.once_per_event(stream, "30 days"), f"{tmp_path}/out", f"{tmp_path}/log", "append")
    got = [(r["job_id"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted({(r[0], r[1]) for r in rows})


def test_hours_are_counted(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    J.run_once(J.events_per_hour(stream, "20 days"), f"{tmp_path}/out", f"{tmp_path}/log")
    got = {(r["w"], r["event_type"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").select(F.col("window.start").cast("string").alias("w"), "event_type", "n").collect()}
    assert got == Counter((str(r[2].replace(minute=0)), r[3]) for r in rows)


def test_live_states_equal_the_table(spark, tmp_path):
    _, stream = events(spark, tmp_path, closing=False)
    J.run_once(J.live_job_states(stream), f"{tmp_path}/out", f"{tmp_path}/log")
    table = J.live_job_states(spark.read.parquet(f"{tmp_path}/in/*"))
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(table.collect())


def test_log_lines_as_a_stream(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text('{"event": "a", "level": "info", "job_id": 3, "k": 1}\nplain\n')
    J.run_once(transcripts.log_rows(spark.readStream.text(f"{tmp_path}/logs")), f"{tmp_path}/out", f"{tmp_path}/log", "append")
    assert sorted((r["event"], r["extra"].get("k")) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", "1"), ("plain", None)]


STAGES = ["ingest", "score", "render"]


def job_log():
    """Five jobs that are requeued, fail, finish and go on after their end; repeats from earlier batches."""
    kinds = ["stage_started", "stage_progress", "stage_completed", "stage_failed", "stage_skipped", "job_requeued", "job_completed", "job_failed", "job_cancelled"]
    r = random.Random(5)
    rows = [(i % 5, i, k, None if k.startswith("job") else r.choice([*STAGES, "extra"]), r.randrange(100) if k == "stage_progress" else None) for i in range(160) for k in r.choices(kinds, [6, 3, 5, 2, 2, 2, 1, 1, 1])]
    parts = [rows[i : i + 20] for i in range(0, 160, 20)]
    parts[3] += parts[1][:7]
    return parts


def test_job_progress_after_every_prefix(spark, tmp_path):
    schema = "job_id long, id long, event_type string, stage string, progress long"
    for k, part in enumerate(job_log()):
        spark.createDataFrame(part, schema).repartition(1).write.parquet(f"{tmp_path}/in/{k}")
    for k in range(8):  # a file's time sets its place in the stream
        for f in (tmp_path / "in" / str(k)).glob("part-*"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    J.run_once(L.job_progress_stream(stream, STAGES), f"{tmp_path}/out", f"{tmp_path}/log", "update")
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    rows = []
    for k, part in enumerate(job_log()):
        rows += part
        live = {r["job_id"]: r for r in sorted((r for r in out if r["batch"] <= k), key=lambda r: r["batch"])}
        for want in O.job_progress(spark.createDataFrame(rows, schema), STAGES).collect():
            got = live[want["job_id"]].asDict()
            assert {c: got[c] for c in want.asDict()} == want.asDict(), (k, got, want)


def test_silent_workers_without_a_row(spark, tmp_path):
    """w1 falls silent while w2 goes on; w3 comes back late; the last states equal the table at the watermark."""
    at = lambda s: START + timedelta(milliseconds=round(s * 1000))
    batches = [
        [("w1", at(0), "job"), ("w2", at(1), None), ("w3", at(2), "job")],
        [("w1", at(10), None), ("w2", at(30), "job"), ("w2", at(29), None)],
        [("w2", at(54.5), "job")],
        [("w2", at(80), None), ("w4", at(80), "job"), ("w4", at(80), None), ("w5", at(84), None)],
        [("w3", at(100), None), ("w2", at(111), None)],
        [("w2", at(130), "job"), ("w4", at(126), None)],
    ]
    schema = "worker string, ts timestamp, running_job string"
    for k, part in enumerate(batches):
        spark.createDataFrame(part, schema).repartition(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in (tmp_path / "in" / str(k)).glob("part-*"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    J.run_once(L.worker_state_stream(stream, 45, "0 seconds"), f"{tmp_path}/out", f"{tmp_path}/log", "update")
    out = sorted((r["batch"], r["at_ms"], r["worker"], r["state"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    base = int(START.timestamp() * 1000) if START.tzinfo else round((START - datetime(1970, 1, 1)).total_seconds() * 1000)
    w = lambda name: [(s, (a - base) / 1000) for _, a, x, s in out if x == name]
    assert w("w1") == [("busy", 0), ("idle", 10), ("not_responding", 55.001)]
    assert w("w2") == [("idle", 1), ("busy", 30), ("idle", 80), ("busy", 130)]
    assert w("w3") == [("busy", 2), ("not_responding", 47.001), ("idle", 100)]
    assert w("w4") == [("busy", 80), ("idle", 126)]  # the beat came before the watermark had passed 125 s
    assert w("w5") == [("idle", 84), ("not_responding", 129.001)]  # after the last row of all
    table = O.worker_state(spark.createDataFrame([r for b in batches for r in b], schema), F.lit("2024-01-01 00:02:10").cast("timestamp"))
    last = {x: s for _, _, x, s in out}
    assert last == {r["worker"]: r["state"] for r in table.collect()}
