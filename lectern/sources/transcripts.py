"""Readers and shapers of transcript and log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = "array<struct<id:string,start:double,end:double,text:string,language:string,words:array<struct<start:double,end:double,word:string>>>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSON files, each an array of segments -> video (the file's name), ord, start_ms, end_ms, text, language, words
    (start_ms, end_ms, word; null without stamps)."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("video"), "value")
    rows = raw.select("video", F.posexplode(F.from_json("value", SEGMENT)).alias("ord", "s"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    stamp = lambda c: F.round(c * 1000).cast("long")
    words = F.transform("s.words", lambda w: F.struct(stamp(w["start"]).alias("start_ms"), stamp(w["end"]).alias("end_ms"), w["word"].alias("word")))
    return rows.select("video", "ord", F.col("s.id").alias("id"), ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), F.col("s.text").alias("text"), F.col("s.language").alias("language"), words.alias("words"))


def recogniser_segments(raw: DataFrame) -> DataFrame:
    """Recogniser output (video_id, chunk, body: JSON with transcription[].offsets{from,to} and text) -> segments
    with stripped texts; empty ones are dropped."""
    parsed = F.from_json("body", "transcription array<struct<offsets:struct<`from`:bigint,`to`:bigint>,text:string>>")
    rows = raw.select("video_id", "chunk", F.posexplode(parsed["transcription"]).alias("_p", "t"))
    rows = rows.select("video_id", "chunk", "_p", F.col("t.offsets.from").alias("start_ms"), F.col("t.offsets.to").alias("end_ms"), F.trim("t.text").alias("text")).where("text <> ''")
    ord_ = F.row_number().over(Window.partitionBy("video_id", "chunk").orderBy("_p")) - 1
    return rows.withColumn("ord", ord_.cast("long")).drop("_p")


def stitch_chunks(chunks: DataFrame, segments: DataFrame, key: str = "video_id") -> DataFrame:
    """Segments with times of their chunk (and of their words, where segments has that column) moved behind the chunks
    before it, and numbered seg_0001 onward; a language stays."""
    before = F.sum("dur_ms").over(Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = chunks.select(key, "chunk", F.coalesce(before, F.lit(0)).alias("_at"))
    rows = segments.join(offsets.hint("merge"), [key, "chunk"])
    number = F.row_number().over(Window.partitionBy(key).orderBy("chunk", "ord"))
    kept = ["language"] if "language" in segments.columns else []
    if "words" in segments.columns:
        moved = lambda w: F.struct((w["start_ms"] + F.col("_at")).alias("start_ms"), (w["end_ms"] + F.col("_at")).alias("end_ms"), w["word"].alias("word"))
        kept.append(F.transform("words", moved).alias("words"))
    return rows.select(key, F.format_string("seg_%04d", number).alias("seg_id"), "chunk", "ord", (F.col("start_ms") + F.col("_at")).alias("start_ms"), (F.col("end_ms") + F.col("_at")).alias("end_ms"), "text", *kept)


def chunk_plan(media: DataFrame, chunk_ms: int = 1_800_000, key: str = "video_id") -> DataFrame:
    """Audio chunks of a recording: one if it fits, else duration div length + 1 (the last may be empty)."""
    d = F.col("duration_ms")
    n = F.when(d > chunk_ms, F.floor(d / chunk_ms) + 1).otherwise(F.lit(1)).cast("long")
    rows = media.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.select(key, "chunk", (F.col("chunk") * chunk_ms).alias("start_ms"), F.least(d, (F.col("chunk") + 1) * chunk_ms).alias("end_ms"))


def log_rows(lines: DataFrame, value: Column | None = None) -> DataFrame:
    """JSON log lines -> timestamp, level, event and the other fields as a map without job_id. Lines that are no
    JSON object keep their text as the event. Works on tables and streams alike."""
    text = F.col("value") if value is None else value
    fields = F.when(F.trim(text).startswith("{"), F.from_json(text, "map<string,string>"))
    rest = F.map_filter(fields, lambda k, _: ~k.isin("timestamp", "level", "event", "job_id"))
    kept = [c for c in lines.columns if c != "value"]
    return lines.select(*kept, fields["timestamp"].alias("timestamp"), fields["level"].alias("level"), F.coalesce(F.when(fields.isNotNull(), fields["event"]), F.when(fields.isNull(), text)).alias("event"), F.coalesce(rest, F.create_map().cast("map<string,string>")).alias("extra"))
