"""Live views of event streams. The functions take a streaming (or a stored) DataFrame."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .live import STATE_STORE


def shared_folder(spark: SparkSession) -> str:
    """A new folder for a stream's files below spark.checkpoint.dir; a temporary one on a local master only."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='lectern-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete files of a stream that nothing will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def live_job_states(events: DataFrame) -> DataFrame:
    """Per job: attempt, stage and status after its latest event. One aggregation whose state is a count and
    the latest event of each job, so it needs no Python and runs in update or complete mode."""
    latest = F.max(F.struct("id", "event_type", "stage")).alias("l")
    rows = events.groupBy("job_id").agg((F.count_if(F.col("event_type") == "job_requeued") + 1).alias("attempt"), latest)
    kind = F.col("l.event_type")
    status = F.when(kind == "job_requeued", "queued").when(kind == "job_completed", "completed").when(kind == "stage_failed", "failed").otherwise("running")
    return rows.select("job_id", "attempt", F.when(kind != "job_requeued", F.col("l.stage")).alias("stage"), status.alias("status"), F.when(kind != "job_requeued", F.col("l.id")).alias("last_id"))


def once_per_event(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """A replayed event is delivered once: duplicates of (job_id, id) within the watermark go."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "id"])


def events_per_hour(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Counts by hour and kind; an hour closes when the watermark passes its end."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Process what is there and stop; every batch replaces the table at path (complete) or is added to it, with its number
    in the column `batch` (append, update).

    path and checkpoint have to lie in storage that the driver and all executors share."""

    def write(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(path)
        else:  # a batch that runs again after a failure replaces its own rows
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings it was started with
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
